import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.sources import arrays, ply, texts

HEAD = "ply\nformat {} 1.0\ncomment TextureFile tex.png\nelement vertex 3\nproperty float x\nproperty float y\nproperty uchar red\nelement face 2\nproperty list uchar int vertex_indices\nend_header\n"
ROWS, FACES = [(0.5, 1.0, 7), (1.5, -2.0, 255), (0.0, 3.25, 0)], [[0, 1, 2], [2, 1, 0, 1]]


@pytest.fixture(params=["ascii", "binary_little_endian", "binary_big_endian"])
def path(request, tmp_path):
    kind = request.param
    body = HEAD.format(kind).encode()
    if kind == "ascii":
        body += "".join(f"{x} {y} {r}\n" for x, y, r in ROWS).encode() + "".join(f"{len(f)} {' '.join(map(str, f))}\n" for f in FACES).encode()
    else:
        o = "<" if "little" in kind else ">"
        body += b"".join(struct.pack(f"{o}ffB", *r) for r in ROWS) + b"".join(struct.pack(f"{o}B{len(f)}i", len(f), *f) for f in FACES)
    p = tmp_path / "a.ply"
    p.write_bytes(body)
    return str(p)


def test_read_ply(spark, path):
    ply.register(spark)
    got = spark.read.format("ply").option("rows_per_task", 2).load(path)
    assert [tuple(r) for r in got.collect()] == ROWS
    assert spark.read.format("ply").option("columns", "red,x").load(path).columns == ["red", "x"]
    faces = spark.read.format("ply").option("element", "face").load(path)
    assert [r[0] for r in faces.collect()] == FACES
    assert ply.describe(spark, path).count() == 4
    with open(path, "rb") as f:
        data = f.read()
    assert ply.parse(data, "face") == [(f,) for f in FACES]
    with pytest.raises(Exception, match="blue"):
        spark.read.format("ply").option("columns", "blue").load(path).collect()


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_write_ply(spark, tmp_path, kind):
    ply.register(spark)
    df = spark.createDataFrame([(1, 0.25, [1, 2]), (2, -3.5, [])], "id int, x double, v array<int>")
    to = str(tmp_path / "out")
    df.write.format("ply").mode("append").option("format_name", kind).save(to)
    assert sorted(tuple(r) for r in spark.read.format("ply").load(to).collect()) == [(1, 0.25, [1, 2]), (2, -3.5, [])]


def test_npz(spark, tmp_path):
    np.savez(tmp_path / "img1_img2_matches.npz", keypoints0=np.arange(6.0).reshape(3, 2), matches_p=np.array([1, -1, 0]))
    np.save(tmp_path / "one.npy", np.asfortranarray(np.arange(4.0).reshape(2, 2)))
    x = arrays.read_arrays(spark, str(tmp_path))
    assert {r["name"]: r["shape"] for r in x.collect()} == {"keypoints0": [3, 2], "matches_p": [3], "one": [2, 2]}
    assert x.where("name = 'one'").first()["data"] == [0.0, 1.0, 2.0, 3.0]
    k = x.where("name = 'keypoints0'").select(arrays.points2(F.col("data")).alias("p")).first()["p"]
    assert [(p["x"], p["y"]) for p in k] == [(0, 1), (2, 3), (4, 5)]
    m = x.where("name = 'matches_p'").select(arrays.index_pairs(F.col("data")).alias("p"), arrays.image_pair(F.col("path")).alias("n")).first()
    assert [tuple(p) for p in m["p"]] == [(0, 1), (2, 0)] and tuple(m["n"]) == ("img1", "img2")
    to = str(tmp_path / "made")
    arrays.write_arrays(x, to)
    assert np.load(os.path.join(to, "keypoints0.npy")).shape == (3, 2)


def test_waveform(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<3H", 1, 513, 65535)),)], "b binary")
    assert df.select(arrays.unpacked_waveform(F.col("b")).alias("w")).first()["w"] == [1.0, 513.0, 65535.0]


def test_texts(spark, tmp_path):
    (tmp_path / "poses.txt").write_text(" ".join(map(str, range(32))) + "\n1 2 3\n")
    assert texts.pose_matrices(spark, str(tmp_path / "poses.txt")).count() == 2
    (tmp_path / "pairs.txt").write_text("a\nb\n2\nx.png\ny.png\n0 1 1 2 3 4 5 6 7 8\n\n0 2 1 2 3 4 5 6 7 8\n")
    views, pairs = texts.line_pairs(spark, str(tmp_path / "pairs.txt"))
    assert views.count() == 2 and [(r["v1"], r["v2"], r["q"]["y2"]) for r in pairs.collect()] == [(0, 1, 8.0)]
    (tmp_path / "times.txt").write_text("0 0.0 1.0\n1 0.5 0\n2 1.0 3.0\n")
    assert [r["exposure"] for r in texts.frame_times(spark, str(tmp_path / "times.txt")).orderBy("id").collect()] == [1.0, 2.0, 3.0]
    (tmp_path / "cams.txt").write_text("c1 " + " ".join(map(str, range(12))) + "\n\n")
    r = texts.named_poses(spark, str(tmp_path / "cams.txt")).first()
    assert r["name"] == "c1" and r["t"] == [0.0, 1.0, 2.0] and len(r["r"]) == 9


def test_obj(spark, tmp_path):
    v = spark.createDataFrame([(5, 0.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0), (9, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, [5, 7, 9])], "fid long, v array<long>")
    texts.write_obj(v, f, str(tmp_path / "o"))
    lines = [line for p in sorted(os.listdir(tmp_path / "o")) if p.startswith("part") for line in (tmp_path / "o" / p).read_text().splitlines()]
    assert lines == ["v 0.0 0.0 0.0", "v 1.0 0.0 0.0", "v 0.0 1.0 0.0", "f 1 2 3"]
