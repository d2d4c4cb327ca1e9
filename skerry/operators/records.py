"""Linking of cameras, images, layouts, lines, matches and tracks: name joins, look-ups by several keys, nests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import geometry as G
from skerry.functions.strings import base_name
from skerry.plans.iterate import numbered


def by_base_name(left: DataFrame, right: DataFrame, left_path: str, right_path: str, pick: str, last: bool = False) -> DataFrame:
    """Left rows with the right row of the same base name: the first (or last) in the order of `pick`."""
    best = (F.max_by if last else F.min_by)(F.struct("*"), F.col(pick))
    r = right.groupBy(base_name(F.col(right_path)).alias("base")).agg(best.alias("match"))
    return left.withColumn("base", base_name(F.col(left_path))).join(r, "base", "left").drop("base")


def resolved(rows: DataFrame, names: DataFrame, columns: list[str]) -> DataFrame:
    """Rows all of whose name columns are known in `names` (name, id), with an id column for each."""
    for c in columns:
        rows = rows.join(names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")), c)
    return rows


def pair_lookup(pairs: DataFrame, records: DataFrame, a: str, b: str) -> DataFrame:
    """Records of unordered pairs, whichever way round either side has them."""
    ends = lambda d: d.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    return ends(pairs).select("lo", "hi").distinct().join(ends(records), ["lo", "hi"]).drop("lo", "hi")


def looked_up(left: DataFrame, right: DataFrame, keys: list[str], value: str, missing: object = -1) -> DataFrame:
    return left.join(right.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(missing)))


def two_hops(left: DataFrame, first: DataFrame, second: DataFrame, key1: str, key2: str) -> DataFrame:
    return left.join(first, key1).join(second, key2)


def nested_views(cameras: DataFrame, layouts: DataFrame, points: DataFrame, key: str = "cam_id") -> DataFrame:
    """One row per camera with its layout's segments and points as sorted arrays, track ids unset."""
    s = layouts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("line_id", "x1", "y1", "x2", "y2", F.lit(-1).alias("track")))).alias("segments"))
    p = points.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("point_id", "u", "v", F.lit(-1).alias("track")))).alias("points"))
    return cameras.join(s, key, "left").join(p, key, "left")


def nearest_line(lines: DataFrame, candidates: DataFrame, key: str, angle: float = 5.0, distance: float = 5.0, others: bool = False) -> DataFrame:
    """key, line_id, match, measure: of the candidates in the same `key` the one of least angle + distance, both under
    their limits, -1 without any; `others` passes over a candidate of the line's own id."""
    side = lambda s: G.segment(*[F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")])
    x = lines.select(key, "line_id", F.struct("*").alias("p")).join(candidates.select(key, F.struct("*").alias("q")), key)
    x = x.where("p.line_id <> q.line_id") if others else x
    x = x.withColumn("m", G.segment_measure(side("p"), side("q"))).where((F.col("m.angle") < angle) & (F.col("m.mean") < distance))
    best = x.groupBy(key, "line_id").agg(F.min(F.struct((F.col("m.angle") + F.col("m.mean")).alias("measure"), F.col("q.line_id").alias("match"))).alias("b"))
    return lines.select(key, "line_id").join(best, [key, "line_id"], "left").select(key, "line_id", F.coalesce("b.match", F.lit(-1)).alias("match"), "b.measure")


def near_flags(lines: DataFrame, key: str, angle: float, distance: float) -> DataFrame:
    """Lines with `near`: whether a line of smaller id in the same layout is within both limits."""
    side = lambda s: G.segment(*[F.col(f"{s}.{c}") for c in ("x1", "y1", "x2", "y2")])
    x = lines.select(key, F.struct("*").alias("p")).join(lines.select(key, F.struct("*").alias("q")), key).where("q.line_id < p.line_id")
    x = x.withColumn("m", G.segment_measure(side("p"), side("q"))).where((F.col("m.angle") <= angle) & (F.col("m.mean") <= distance))
    hit = x.select(key, F.col("p.line_id").alias("line_id")).distinct().withColumn("near", F.lit(True))
    return lines.join(hit, [key, "line_id"], "left").withColumn("near", F.coalesce("near", F.lit(False)))


def label_by_samples(lines: DataFrame, raster: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: the commonest raster label (img, i, j, v) along each line, ties to the smaller, -1 off the raster."""
    from .aggregates import mode
    from .windows import segment_cells

    at = segment_cells(lines, keys).join(raster.select(F.col("img").alias(keys[0]), F.col("i").alias("u"), F.col("j").alias("v"), F.col("v").alias("label")), [keys[0], "u", "v"], "left")
    at = at.select(*keys, F.coalesce("label", F.lit(-1)).alias("label"))
    return mode(at, keys, "label").select(*keys, "label")


def first_sharing_group(rows: DataFrame, groups: DataFrame, key: str, item: str, group: str) -> DataFrame:
    """key, group: the smallest group that shares an item with the row, -1 if none."""
    x = rows.join(groups.select(item, group), item).groupBy(key).agg(F.min(group).alias(group))
    return rows.select(key).distinct().join(x, key, "left").withColumn(group, F.coalesce(F.col(group), F.lit(-1)))


def nested_tracks(observations: DataFrame, points: DataFrame, key: str = "track_id") -> DataFrame:
    """Tracks with their point and sorted observations; one polygon makes a plane, two an intersection line, else none."""
    o = observations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("view_id", "u", "v"))).alias("observations"), F.sort_array(F.collect_set("polygon")).alias("polygons"))
    kind = F.when(F.size("polygons") == 1, "plane").when(F.size("polygons") == 2, "intersection").otherwise("none")
    return points.join(o, key).withColumn("kind", kind)


def recast(observations: DataFrame, rays: DataFrame, key: str = "track_id") -> DataFrame:
    """Observations whose polygon differs from their track's first one take that one and its ray hit (view_id, polygon, t); no hit is NaN."""
    first = observations.groupBy(key).agg(F.min_by("polygon", "view_id").alias("first"))
    x = observations.join(first, key).withColumn("moved", F.col("polygon") != F.col("first"))
    hit = rays.select("view_id", F.col("polygon").alias("first"), F.col("t").alias("new_t"))
    x = x.join(hit, ["view_id", "first"], "left")
    t = F.when(F.col("moved"), F.coalesce("new_t", F.lit(float("nan")))).otherwise(F.col("t"))
    return x.select(key, "view_id", F.col("first").alias("polygon"), t.alias("t"))


def nearest_hit(rays: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Rays (ray_id, key, origin, direction) against the triangles (face_id, key, a, b, c) of the same scene part `key`:
    ray_id, face_id of the nearest hit or -1."""
    t = G.ray_triangle(F.col("origin"), F.col("direction"), F.col("a"), F.col("b"), F.col("c"))
    x = rays.join(polygons, key).withColumn("t", t).where("t is not null")
    best = x.groupBy("ray_id").agg(F.min(F.struct("t", "face_id")).alias("m"))
    return rays.select("ray_id").join(best, "ray_id", "left").select("ray_id", F.coalesce("m.face_id", F.lit(-1)).alias("face_id"), "m.t")


def match_indices(matches: Column) -> Column:
    """(i, match[i]) of a match vector, -1 being unmatched."""
    at = F.transform(matches, lambda m, i: F.struct(i.alias("i"), m.alias("m")))
    return F.filter(at, lambda p: p.m >= 0)


def view_groups(views: DataFrame, key: str, degrees: float) -> DataFrame:
    """view_id, near: the views of the same `key` whose direction (dx, dy, dz) is nearer than an angle, sorted."""
    from skerry.functions.vectors import angle_degrees, vec

    v = views.select(key, F.col("view_id").alias("a"), vec("dx", "dy", "dz").alias("p"))
    w = views.select(key, F.col("view_id").alias("b"), vec("dx", "dy", "dz").alias("q"))
    x = v.join(w, key).where((F.col("a") != F.col("b")) & (angle_degrees(F.col("p"), F.col("q")) < degrees))
    return x.groupBy(key, F.col("a").alias("view_id")).agg(F.sort_array(F.collect_list("b")).alias("near"))


def descriptor_matches(a: DataFrame, b: DataFrame, key: str, most: int = 25) -> DataFrame:
    """key, i, j, distance: nearest binary descriptor (array of longs) of the other image by Hamming distance below `most`."""
    d = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, v: s + v)
    x = a.select(key, F.col("item").alias("i"), F.col("descriptor").alias("p")).join(b.select(key, F.col("item").alias("j"), F.col("descriptor").alias("q")), key)
    x = x.groupBy(key, "i").agg(F.min(F.struct(d(F.col("p"), F.col("q")).alias("distance"), "j")).alias("m")).where(F.col("m.distance") < most)
    return x.select(key, "i", "m.j", "m.distance")


def ordered_files(names: DataFrame) -> DataFrame:
    """path, id: files by leading number if every name starts with one, else by name; ids from 0. """
    n = names.withColumn("base", base_name(F.col("path")))
    every = n.agg(F.coalesce(F.bool_and(F.col("base").rlike("^[0-9]+")), F.lit(False)).alias("every"))
    x = n.crossJoin(F.broadcast(every))  # one row
    x = x.select("path", "base", F.when(F.col("every"), F.regexp_extract("base", "^([0-9]+)", 1).try_cast("bigint")).alias("number"))
    return numbered(x, ["number", "base", "path"], "id").select("path", "id")
