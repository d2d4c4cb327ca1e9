"""Text formats of cameras, frames, line pairs and layouts, and their writers; all by Spark's text reader and expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions.strings import base_name

NUMBER = r"[^\s,;]+"


def numbers(line: Column) -> Column:
    """The numbers of a line, NULL for what is none."""
    return F.transform(F.regexp_extract_all(line, F.lit(f"({NUMBER})"), F.lit(1)), lambda w: w.try_cast("double"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content: for files that are one record."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0), line of each file. A file is one record here; use it for headers and lists, not for bulk data."""
    x = whole_files(spark, path)
    return x.select("path", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line"))


def pose_matrices(spark: SparkSession, path: str, size: int = 16) -> DataFrame:
    """path, idx, m: each run of `size` numbers; an incomplete tail is dropped."""
    x = whole_files(spark, path).select("path", numbers(F.col("content")).alias("n"))
    at = F.sequence(F.lit(0), F.greatest(F.floor(F.size("n") / size).cast("int") - 1, F.lit(0)))
    m = x.select("path", "n", F.explode(at).alias("idx")).select("path", "idx", F.slice("n", F.col("idx") * size + 1, size).alias("m"))
    return m.where(F.size("m") == size)


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """path, name, t, r: three translation, then nine rotation values per file."""
    x = whole_files(spark, path).select("path", numbers(F.col("content")).alias("n")).where(F.size("n") >= 12)
    return x.select("path", base_name(F.col("path")).alias("name"), F.slice("n", 1, 3).alias("t"), F.slice("n", 4, 9).alias("r"))


def named_poses(spark: SparkSession, path: str) -> DataFrame:
    """name, t, r: lines `name t(3) r(9)`."""
    x = spark.read.text(path).where(F.trim("value") != "")
    n = numbers(F.regexp_replace(F.trim("value"), r"^\S+", ""))
    return x.select(F.regexp_extract(F.trim("value"), r"^(\S+)", 1).alias("name"), n.alias("n")).where(F.size("n") == 12).select("name", F.slice("n", 1, 3).alias("t"), F.slice("n", 4, 9).alias("r"))


def timed_transforms(spark: SparkSession, path: str) -> DataFrame:
    """idx, m: lines of an index and sixteen matrix values."""
    x = spark.read.text(path).select(numbers(F.col("value")).alias("n")).where(F.size("n") == 17)
    return x.select(F.get("n", F.lit(0)).alias("idx"), F.slice("n", 2, 16).alias("m"))


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """id, ts, exposure (0 where missing), gap-filled."""
    from skerry.operators.windows import exposure_filled

    x = spark.read.text(path).select(numbers(F.col("value")).alias("n")).where(F.size("n").isin(2, 3))
    x = x.select(F.get("n", F.lit(0)).cast("long").alias("id"), F.get("n", F.lit(1)).alias("ts"), F.coalesce(F.get("n", F.lit(2)), F.lit(0.0)).alias("exposure"))
    return exposure_filled(x)


def line_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """views (view, path) and pairs (v1, v2, p, q): three header lines, the third holding the number of views, their paths,
    then ten numbers a row; blank lines are passed over, rows with a view out of range dropped."""
    x = numbered_lines(spark, path).where(F.trim("line") != "").withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1)
    n = x.where("at = 2").select("path", F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("n"))
    x = x.join(n, "path")
    views = x.where("at >= 3 and at < 3 + n").select((F.col("at") - 3).alias("view"), F.trim("line").alias("view_path"))
    v = x.where("at >= 3 + n").select("n", numbers(F.col("line")).alias("v")).where(F.size("v") == 10)
    names = ("x1", "y1", "x2", "y2")
    seg = lambda a: F.struct(*[F.get("v", F.lit(a + k)).alias(c) for k, c in enumerate(names)])
    pairs = v.select(F.get("v", F.lit(0)).cast("int").alias("v1"), F.get("v", F.lit(1)).cast("int").alias("v2"), seg(2).alias("p"), seg(6).alias("q"), "n")
    ok = F.col("v1").between(0, F.col("n") - 1) & F.col("v2").between(0, F.col("n") - 1)
    return views, pairs.where(ok).drop("n")


def layouts(spark: SparkSession, path: str) -> DataFrame:
    """path, layout, line_id, x1, y1, x2, y2: files of lines of four numbers."""
    x = numbered_lines(spark, path).select("path", "line_no", numbers(F.col("line")).alias("v")).where(F.size("v") == 4)
    ids = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return x.select("path", base_name(F.col("path")).alias("layout"), ids.alias("line_id"), *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, size, modified of files, without their content."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return r.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def vertex_line() -> Column:
    return F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("double").cast("string") for c in "xyz"]).alias("line")


def write_obj(vertices: DataFrame, faces: DataFrame, path: str, material: str | None = None) -> None:
    """`v` lines by vertex, then `f` lines with ids counted from 1, groups by `material` (a column of faces) if given. Lines
    carry their order through a range partitioning, so the parts of the folder make the file in name order."""
    from skerry.operators.graph import dense_ids
    from skerry.operators.mesh import remapped

    v = dense_ids(vertices, "vid", "new")
    f = remapped(faces, v.select("vid", (F.col("new") + 1).alias("new")))
    if material:
        f = f.join(faces.select("fid", F.col(material).alias("m")), "fid")
    else:
        f = f.withColumn("m", F.lit(""))
    lines = v.select(F.lit(0).alias("k"), F.lit("").alias("m"), F.col("new").alias("o"), vertex_line())
    lines = lines.union(f.select(F.lit(2), "m", F.col("fid").cast("long"), F.concat(F.lit("f "), F.array_join(F.transform("v", lambda i: i.cast("string")), " "))))
    if material:
        lines = lines.union(f.select("m").distinct().select(F.lit(2), "m", F.lit(-1).cast("long"), F.concat(F.lit("usemtl "), "m")))
    lines.repartitionByRange("k", "m", "o").sortWithinPartitions("k", "m", "o").select("line").write.mode("overwrite").text(path)


def write_xyz(df: DataFrame, path: str) -> None:
    df.select(vertex_line()).write.mode("overwrite").text(path)


def write_numbers(df: DataFrame, columns: list[str], path: str, by: str | None = None) -> None:
    """Columns as blank-separated lines, one folder per value of `by` if given."""
    line = F.array_join(F.transform(F.array(*[F.col(c).cast("string") for c in columns]), lambda s: F.coalesce(s, F.lit("nan"))), " ").alias("line")
    w = df.select(*([by] if by else []), line).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def write_matrix(df: DataFrame, m: str, path: str, width: int = 4) -> None:
    """Matrices as lines of `width` numbers."""
    from .arrays import rows_of

    df.select(F.array_join(F.transform(rows_of(F.col(m), width), lambda r: F.array_join(F.transform(r, lambda v: v.cast("string")), " ")), "\n").alias("line")).write.mode("overwrite").text(path)


def write_histogram(bins: DataFrame, path: str) -> None:
    bins.select(F.col("bin").alias("Bin"), F.col("n").alias("Values")).write.mode("overwrite").csv(path, header=True)


def write_trajectory(poses: DataFrame, path: str, keyframes_only: bool = False) -> None:
    """ts, t, q columns of valid poses."""
    x = poses.where("valid" if not keyframes_only else "valid and keyframe")
    x.orderBy("ts").select("ts", "tx", "ty", "tz", "qx", "qy", "qz", "qw").write.mode("overwrite").csv(path, sep=" ")


def camera_axes(cams: DataFrame, size: float = 0.1, points: int = 100) -> DataFrame:
    """name, axis, k, x, y, z, r, g, b: points along the three axes of cameras (t: centre, r: rows of the rotation)."""
    x = cams.select("name", "t", "r", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("axis"))
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = lambda c: F.get("t", F.lit(c)) + F.get("r", (F.col("axis") * 3 + c).cast("int")) * F.col("k") * (size / max(points - 1, 1))
    colour = [F.when(F.col("axis") == k, 255).otherwise(0).alias(n) for k, n in enumerate("rgb")]
    return x.select("name", "axis", "k", *[at(k).alias(n) for k, n in enumerate("xyz")], *colour)


def write_entity(kind: str, path: str, vertices: DataFrame, faces: DataFrame | None = None, textured: bool = False) -> None:
    """A cloud or an untextured mesh becomes PLY, a textured mesh OBJ."""
    if kind == "mesh" and textured:
        write_obj(vertices, faces, path)
        return
    vertices.write.format("ply").mode("append").option("element", "vertex").save(path)
    if faces is not None:
        faces.select(F.col("v").alias("vertex_indices")).write.format("ply").mode("append").option("element", "face").save(re.sub(r"/*$", "", path) + ".faces")
