"""npy and npz files: one row per array, read by `binaryFile`, so any store that Spark reads will do."""

from __future__ import annotations

import io
import os
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, name string, shape array<int>, kind string, fortran boolean, data array<double>"


def _arrays(path: str, content: bytes):
    """(name, array) of a file: an npz archive's members, or the one array of an npy file."""
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                yield name.removesuffix(".npy"), np.load(io.BytesIO(archive.read(name)), allow_pickle=False)
    else:
        yield os.path.splitext(os.path.basename(path))[0], np.load(io.BytesIO(content), allow_pickle=False)


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """path, name, shape, kind, fortran, data (values row by row); only the named arrays if names are given."""

    def read(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, a in _arrays(p, content):
                    if names is None or name in names:
                        rows.append((p, name, list(a.shape), a.dtype.str, bool(np.isfortran(a)), a.astype(float).ravel(order="C")))
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "kind", "fortran", "data"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(path).select("path", "content").mapInPandas(read, SCHEMA)


def rows_of(data: Column, width: int) -> Column:
    """A flat array as an array of rows of `width` values."""
    n = F.floor(F.size(data) / width).cast("int")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    rows = F.transform(at, lambda k: F.slice(data, k * width + 1, width))
    return F.when(n > 0, rows).otherwise(F.slice(rows, 1, 0))


def points2(data: Column) -> Column:
    return F.transform(rows_of(data, 2), lambda r: F.struct(F.get(r, F.lit(0)).alias("x"), F.get(r, F.lit(1)).alias("y")))


def segments(data: Column) -> Column:
    """n x 2 x 2 values as segments."""
    names = ("x1", "y1", "x2", "y2")
    return F.transform(rows_of(data, 4), lambda r: F.struct(*[F.get(r, F.lit(k)).alias(n) for k, n in enumerate(names)]))


def index_pairs(data: Column) -> Column:
    """(i, j) of a match vector; -1 is unmatched."""
    at = F.transform(data, lambda m, i: F.struct(i.alias("i"), m.cast("int").alias("j")))
    return F.filter(at, lambda p: p.j >= 0)


def matrix_pairs(data: Column, width: int) -> Column:
    """(i, j) of the set cells of a flat match matrix."""
    at = F.transform(data, lambda m, k: F.struct(F.floor(k / width).cast("int").alias("i"), (k % width).cast("int").alias("j"), m.alias("m")))
    return F.transform(F.filter(at, lambda p: p.m > 0), lambda p: F.struct(p.i.alias("i"), p.j.alias("j")))


def image_pair(path: Column) -> Column:
    """left, right of a file named `<left>_<right>_*.npz`."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(F.regexp_extract(name, r"^([^_]+)_", 1).alias("left"), F.regexp_extract(name, r"^[^_]+_([^_.]+)", 1).alias("right"))


def write_arrays(df: DataFrame, folder: str, archive: bool = False) -> None:
    """Rows (name, shape, data) as npy files of a mounted folder, or one npz per task."""

    def write(rows):
        from pyspark import TaskContext

        os.makedirs(folder, exist_ok=True)
        made = {r["name"]: np.array(r["data"], float).reshape(r["shape"]) for r in rows}
        if archive and made:
            np.savez(os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}.npz"), **made)
        elif not archive:
            for name, a in made.items():
                np.save(os.path.join(folder, f"{name}.npy"), a)

    df.select("name", "shape", "data").foreachPartition(write)


def unpacked_waveform(samples: Column) -> Column:
    """Packed little-endian 16-bit waveform samples as doubles, in expressions: two bytes a sample."""
    hexed = F.hex(samples)
    n = F.floor(F.length(hexed) / 4).cast("int")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    value = lambda k: F.conv(F.concat(F.substring(hexed, k * 4 + 3, F.lit(2)), F.substring(hexed, k * 4 + 1, F.lit(2))), 16, 10).cast("double")
    return F.when(n > 0, F.transform(at, value))
