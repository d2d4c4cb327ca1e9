"""Readers and writers: PLY, npy and npz, poses, times, matches, layouts, meshes."""
