"""Triangle meshes as tables: vertices (vid, x, y, z) and faces (fid, v: array of three vertex ids)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions import geometry as G
from skerry.functions import vectors as V

from skerry.plans.iterate import Scratch

from .spatial import cell, size_for


def corners(faces: DataFrame) -> DataFrame:
    return faces.select("fid", F.posexplode("v").alias("corner", "vid"))


def with_points(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, a, b, c: faces with their corners' points. One join on the vertex and one partial aggregate per face."""
    at = corners(faces).join(vertices.select("vid", V.vec("x", "y", "z").alias("p")), "vid")
    pick = lambda k, n: F.first(F.when(F.col("corner") == k, F.col("p")), ignorenulls=True).alias(n)
    return at.groupBy("fid").agg(pick(0, "a"), pick(1, "b"), pick(2, "c"))


def face_measures(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """fid, normal (unit), area, volume (signed, against the origin)."""
    x = with_points(vertices, faces)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return x.select("fid", V.normalize(V.cross(V.sub(b, a), V.sub(c, a))).alias("normal"), G.triangle_area(a, b, c).alias("area"), G.signed_volume(a, b, c).alias("volume"))


def totals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return face_measures(vertices, faces).agg(F.sum("area").alias("area"), F.sum("volume").alias("volume"), F.count("*").alias("faces"))


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vid, normal: unit sum of the cross products of the faces around, so larger faces weigh more."""
    x = with_points(vertices, faces)
    n = V.cross(V.sub(F.col("b"), F.col("a")), V.sub(F.col("c"), F.col("a")))
    x = corners(faces).join(x.select("fid", n.alias("n")), "fid").groupBy("vid").agg(*[F.sum(f"n.{c}").alias(c) for c in "xyz"])
    return x.select("vid", V.normalize(V.vec("x", "y", "z")).alias("normal"))


def directed_edges(faces: DataFrame) -> DataFrame:
    v = F.col("v")
    sides = F.array(*[F.struct(F.get(v, F.lit(k)).alias("a"), F.get(v, F.lit((k + 1) % 3)).alias("b")) for k in range(3)])
    return faces.select("fid", F.explode(sides).alias("e")).select("fid", "e.a", "e.b")


def edge_usage(faces: DataFrame) -> DataFrame:
    """a < b, n: faces at each undirected edge."""
    return directed_edges(faces).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


def edge_classes(faces: DataFrame) -> DataFrame:
    """One row: edges, border (one face), shared (two), multiple (more)."""
    n = lambda c: F.count(F.when(c, 1))
    u = F.col("n")
    return edge_usage(faces).agg(F.count("*").alias("edges"), n(u == 1).alias("border"), n(u == 2).alias("shared"), n(u > 2).alias("multiple"))


def vertex_classes(faces: DataFrame) -> DataFrame:
    """vid, class: non-manifold if at an edge of more than two faces, border if at one of a single face, else inner."""
    u = edge_usage(faces)
    e = u.select(F.col("a").alias("vid"), "n").union(u.select(F.col("b").alias("vid"), "n")).groupBy("vid").agg(F.max("n").alias("high"), F.min("n").alias("low"))
    return e.select("vid", F.when(F.col("high") > 2, "non_manifold").when(F.col("low") == 1, "border").otherwise("inner").alias("class"))


def adjacency(faces: DataFrame) -> DataFrame:
    """f1 < f2: faces that share an edge, each pair once."""
    e = directed_edges(faces).select("fid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = e.join(e.withColumnRenamed("fid", "other"), ["a", "b"]).where("fid < other")
    return x.select(F.col("fid").alias("f1"), F.col("other").alias("f2")).distinct()


def half_edges(faces: DataFrame) -> DataFrame:
    """fid, a, b, opposite: the face on the other side that runs the edge backwards, if any (the smallest)."""
    e = directed_edges(faces)
    back = e.groupBy(F.col("b").alias("a"), F.col("a").alias("b")).agg(F.min("fid").alias("opposite"))
    return e.join(back, ["a", "b"], "left")


def seam_edges(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """f1, f2, a, b: edges between adjacent faces of different labels (fid, label)."""
    e = directed_edges(faces).select("fid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(labels, "fid")
    o = e.select("a", "b", F.col("fid").alias("f2"), F.col("label").alias("l2"))
    return e.join(o, ["a", "b"]).where("fid < f2 and label <> l2").select(F.col("fid").alias("f1"), "f2", "a", "b")


def merged_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices of equal coordinates become the one of smallest id; faces follow."""
    first = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("new"))
    move = vertices.join(first, ["x", "y", "z"]).select("vid", "new")
    return vertices.join(first.select(F.col("new").alias("vid")), "vid", "left_semi"), remapped(faces, move)


def remapped(faces: DataFrame, move: DataFrame) -> DataFrame:
    """Faces with vertex ids replaced by `move` (vid, new)."""
    at = corners(faces).join(move, "vid").groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("corner", "new"))).alias("c"))
    return at.select("fid", F.transform("c", lambda x: x.new).alias("v"))


def turned(v: Column) -> Column:
    """A face's corners from the smallest id on, winding kept."""
    k = (F.array_position(v, F.array_min(v)) - 1).cast("int")
    return F.concat(F.slice(v, k + 1, 3), F.slice(v, 1, k))


def distinct_faces(faces: DataFrame) -> DataFrame:
    """One face of each corner cycle: the smallest id."""
    best = faces.groupBy(turned(F.col("v")).alias("key")).agg(F.min("fid").alias("fid")).select("fid")
    return faces.join(best, "fid", "left_semi")


def without_degenerate(faces: DataFrame) -> DataFrame:
    return faces.where(F.size(F.array_distinct("v")) == 3)


def without_unused(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    return vertices.join(corners(faces).select("vid").distinct(), "vid", "left_semi")


def cleaned(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vertices, degenerate faces, repeated faces, faces at edges of more than two, and unused vertices go, in this order."""
    vertices, faces = merged_vertices(vertices, faces)
    faces = distinct_faces(without_degenerate(faces))
    bad = edge_usage(faces).where("n > 2").select("a", "b")
    e = directed_edges(faces).select("fid", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    faces = faces.join(e.join(bad, ["a", "b"]).select("fid").distinct(), "fid", "left_anti")
    return without_unused(vertices, faces), faces


def clustered(vertices: DataFrame, faces: DataFrame, size: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """Simplify: the vertices of a grid cell become their mean, faces follow, degenerate and repeated ones go."""
    c = vertices.select("*", cell(size).alias("c"))
    mean = c.groupBy("c").agg(F.min("vid").alias("new"), *[F.avg(a).alias(a) for a in "xyz"])
    move = c.join(mean.select("c", "new"), "c").select("vid", "new")
    return mean.select(F.col("new").alias("vid"), "x", "y", "z"), distinct_faces(without_degenerate(remapped(faces, move)))


def clipped(vertices: DataFrame, faces: DataFrame, axis: str, at: float, keep_above: bool = True) -> DataFrame:
    """fid, part, a, b, c: the pieces of faces on one side of an axis-aligned plane, crossing ones cut into one or two."""
    s = 1.0 if keep_above else -1.0
    x = with_points(vertices, faces)
    side = lambda p: (p[axis] - at) * s
    ring = F.array("a", "b", "c")
    after = F.array("b", "c", "a")

    def cut(p: Column, q: Column) -> Column:
        t = F.try_divide(side(p), side(p) - side(q))
        kept = F.when(side(p) >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0))
        cross = F.when((side(p) >= 0) != (side(q) >= 0), F.array(V.lerp3(p, q, t))).otherwise(F.slice(F.array(p), 1, 0))
        return F.concat(kept, cross)

    poly = F.flatten(F.zip_with(ring, after, cut))
    x = x.select("fid", poly.alias("p")).where(F.size("p") >= 3)
    x = x.select("fid", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 2)).alias("k"))
    return x.select("fid", (F.col("k") - 1).alias("part"), F.get("p", F.lit(0)).alias("a"), F.get("p", F.col("k")).alias("b"), F.get("p", F.col("k") + 1).alias("c"))


def surface_samples(vertices: DataFrame, faces: DataFrame, per_area: float, seed: int) -> DataFrame:
    """fid, k, x, y, z: points spread by area; the count of a face is its share rounded by a seeded draw."""
    x = with_points(vertices, faces).withColumn("area", G.triangle_area(F.col("a"), F.col("b"), F.col("c")))
    draw = lambda n: F.pmod(F.xxhash64(F.lit(seed), F.lit(n), "fid", "k"), F.lit(1 << 40)) / float(1 << 40)
    x = x.withColumn("k", F.lit(0)).withColumn("n", F.floor(F.col("area") * per_area + draw(0)).cast("int")).where("n > 0")
    x = x.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("u", F.sqrt(draw(1))).withColumn("w", draw(2))
    at = lambda c: (1 - F.col("u")) * F.col(f"a.{c}") + F.col("u") * (1 - F.col("w")) * F.col(f"b.{c}") + F.col("u") * F.col("w") * F.col(f"c.{c}")
    return x.select("fid", "k", *[at(c).alias(c) for c in "xyz"])


def _near_faces(points: DataFrame, boxes: DataFrame, size: float, within: float) -> DataFrame:
    """Points and the faces whose box (low_x to high_z) grown by `within` holds them. A face is put into the at most 8 cells
    that its grown box touches of the least level (`size` times a power of two) whose cells are as large as that box, and a
    point into its cell of each level that faces have."""
    wide = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in "xyz"]) + 2.0 * within
    t = boxes.withColumn("level", F.greatest(F.ceil(F.log2(wide / size)), F.lit(-40)).cast("int"))
    levels = sorted(r["level"] for r in t.where("level is not null").select("level").distinct().collect())  # a few dozen at most
    step = F.lit(size) * F.pow(F.lit(2.0), F.col("level"))
    for c in "xyz":
        t = t.withColumn(f"c{c}", F.explode(F.sequence(F.floor((F.col(f"low_{c}") - within) / step), F.floor((F.col(f"high_{c}") + within) / step))))
    p = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    p = p.select("*", *[F.floor(F.col(c) / step).alias(f"c{c}") for c in "xyz"])
    x = p.join(t, ["level", "cx", "cy", "cz"])
    for c in "xyz":
        x = x.where((F.col(c) >= F.col(f"low_{c}") - within) & (F.col(c) <= F.col(f"high_{c}") + within))
    return x


def mesh_distance(points: DataFrame, vertices: DataFrame, faces: DataFrame, size: float, most: float) -> DataFrame:
    """pid, fid, distance: nearest face within `most`, ties to the smaller fid; `size` is a cell's at level 0.

    Round by round: a point is done when its nearest face is no farther than the round's reach, which all faces whose grown
    boxes hold it guarantee; the others go on with four times the reach, until that is `most`."""
    scratch = Scratch(points.sparkSession)
    ends = [F.col(f"{p}.{c}") for p in "abc" for c in "xyz"]
    boxes = with_points(vertices, faces).select("*", *[f(*ends[k::3]).alias(f"{n}_{c}") for k, c in enumerate("xyz") for f, n in ((F.least, "low"), (F.greatest, "high"))])
    boxes, _ = scratch.cut(boxes.where("a is not null and b is not null and c is not null"))
    going, _ = scratch.cut(points.select("pid", "x", "y", "z"))
    first = size_for(points, 1.0) / 4.0
    reach, done = most, None
    while reach / 4.0 > first:
        reach /= 4.0
    while True:
        x = _near_faces(going, boxes, size, min(reach, most) * (1.0 + 1e-9))
        d2 = G.point_triangle_distance2(V.vec("x", "y", "z"), F.col("a"), F.col("b"), F.col("c"))
        x = x.groupBy("pid").agg(F.min(F.struct(d2.alias("d2"), "fid")).alias("m"))
        x = x.select("pid", "m.fid", F.sqrt("m.d2").alias("distance")).where(F.col("distance") <= min(reach, most))
        x, _ = scratch.cut(x)
        done = x if done is None else done.unionByName(x)
        if reach >= most:
            return done
        going, _ = scratch.cut(going.join(x.select("pid"), "pid", "left_anti"))
        if not going.limit(1).count():
            return done
        reach *= 4.0


def visible_faces(faces: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces whose corners are all among `seen` (vid), under a dense numbering of the vertices used: faces, (vid, new)."""
    from .filters import faces_inside
    from .graph import dense_ids

    kept = faces_inside(faces, seen.select(F.col("vid").alias("pid")))
    move = dense_ids(corners(kept).select("vid").distinct(), "vid", "new").select("vid", "new")
    return remapped(kept, move), move


def face_view_costs(vertices: DataFrame, faces: DataFrame, views: DataFrame, most_angle: float = 80.0) -> DataFrame:
    """fid, view_id, quality: area over squared distance for faces turned to a view (view_id, centre) by less than an angle.
    Views are cameras: a table that is broadcast only up to 10,000 rows."""
    from skerry.plans.iterate import small

    x = with_points(vertices, faces)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    middle = V.scale(V.add(V.add(a, b), c), 1.0 / 3.0)
    x = x.select("fid", middle.alias("m"), V.cross(V.sub(b, a), V.sub(c, a)).alias("n"), G.triangle_area(a, b, c).alias("area"))
    to = V.sub(F.col("centre"), F.col("m"))
    x = x.join(small(views.select("view_id", "centre"), 10_000)).withColumn("angle", V.angle_degrees(F.col("n"), to))
    return x.where(F.col("angle") < most_angle).select("fid", "view_id", F.try_divide(F.col("area"), V.dot(to, to)).alias("quality"), "angle")


def clamped_costs(costs: DataFrame, share: float = 0.99) -> DataFrame:
    """fid, view_id, cost: one less quality over its binned percentile, at least 0."""
    from .fields import binned_percentile

    p = binned_percentile(costs, "quality", share)
    x = costs.crossJoin(F.broadcast(p))  # one row
    return x.select("fid", "view_id", (1.0 - F.least(F.lit(1.0), F.try_divide(F.col("quality"), F.col("percentile")))).alias("cost"))


def grid_triangles(cells: DataFrame, step: float) -> DataFrame:
    """Triangles of a raster i, j, h: two for each full square, corners as points."""
    p = cells.where("h is not null").select("i", "j", V.vec(F.col("i") * step, F.col("j") * step, F.col("h")).alias("p"))
    at = lambda di, dj, n: p.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("p").alias(n))
    x = p.withColumnRenamed("p", "p00")
    for di, dj, n in ((1, 0, "p10"), (0, 1, "p01"), (1, 1, "p11")):
        x = x.join(at(di, dj, n), ["i", "j"])
    two = F.array(F.struct(F.col("p00").alias("a"), F.col("p10").alias("b"), F.col("p11").alias("c")), F.struct(F.col("p00").alias("a"), F.col("p11").alias("b"), F.col("p01").alias("c")))
    return x.select("i", "j", F.posexplode(two).alias("half", "t")).select("i", "j", "half", "t.a", "t.b", "t.c")
