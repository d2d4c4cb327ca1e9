"""Named queries of functions, graphs, meshes, rasters, records, streams and files."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions import camera, colour, distributions
from skerry.functions import geometry as G
from skerry.functions import vectors as V
from skerry.operators import aggregates, fitting, graph, images, mesh, records, spatial, surfaces
from skerry.plans.catalog import P, R, micros, one, points, query, r6, t
from skerry.plans.iterate import Scratch

# --- functions -----------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, c AS (SELECT pid, x, y, z, nx, ny, nz, y*nz-z*ny AS cx, z*nx-x*nz AS cy, x*ny-y*nx AS cz, sqrt(x*x+y*y+z*z) AS l FROM p)
SELECT pid, {R('x*nx+y*ny+z*nz')} AS dot, {R('cx')} AS cx, {R('cy')} AS cy, {R('cz')} AS cz, {R('l')} AS length, {R('x/l')} AS ux, {R('x+(nx-x)*0.3')} AS lx,
{R('least(greatest(x, -0.1), 0.1)')} AS clamped, {R('x-floor(x)')} AS part, {R('x-trunc(x/0.07)*0.07')} AS remainder, {R('x-nx*2*(x*nx+y*ny+z*nz)')} AS rx,
{R('sqrt((x-nx)*(x-nx)+(y-ny)*(y-ny)+(z-nz)*(z-nz))')} AS apart, {R('degrees(acos(greatest(-1, least(1, (x*nx+y*ny+z*nz)/(l*sqrt(nx*nx+ny*ny+nz*nz))))))')} AS angle FROM c""")
def vector_functions(spark, sf_dir):
    a, b = V.vec("x", "y", "z"), V.vec("nx", "ny", "nz")
    x = points(spark, sf_dir).select("pid", "x", a.alias("a"), b.alias("b"))
    a, b = F.col("a"), F.col("b")
    c = V.cross(a, b)
    return x.select(
        "pid", r6(V.dot(a, b)).alias("dot"), r6(c.x).alias("cx"), r6(c.y).alias("cy"), r6(c.z).alias("cz"), r6(V.length(a)).alias("length"), r6(V.normalize(a).x).alias("ux"),
        r6(V.lerp3(a, b, 0.3).x).alias("lx"), r6(V.clamp(F.col("x"), -0.1, 0.1)).alias("clamped"), r6(V.fraction(F.col("x"))).alias("part"), r6(V.fmod(F.col("x"), 0.07)).alias("remainder"),
        r6(V.reflect(a, b).x).alias("rx"), r6(V.distance(a, b)).alias("apart"), r6(V.angle_degrees(a, b)).alias("angle"),
    )


_SEG = f"WITH {P}, s AS (SELECT pid, x AS x1, y AS y1, z AS x2, nx AS y2, 0.1 AS u1, ny AS v1, nz AS u2, 0.2 AS v2 FROM p)"


def _segments(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir)
    return p.select("pid", G.segment("x", "y", "z", "nx").alias("s"), G.segment(F.lit(0.1), F.col("ny"), F.col("nz"), F.lit(0.2)).alias("q"))


@query(f"""{_SEG}, l AS (SELECT pid, y2-y1 AS a, x1-x2 AS b, -((y2-y1)*x1+(x1-x2)*y1) AS c, v2-v1 AS d, u1-u2 AS e, -((v2-v1)*u1+(u1-u2)*v1) AS f FROM s)
SELECT pid, round((b*f-e*c)/(a*e-d*b), 4) AS x, round((d*c-a*f)/(a*e-d*b), 4) AS y FROM l WHERE abs(a*e-d*b) > 0.001""")
def line_intersect(spark, sf_dir):
    x = _segments(spark, sf_dir).select("pid", G.line_through(F.col("s")).alias("p"), G.line_through(F.col("q")).alias("q"))
    x = x.where(F.abs(F.col("p.a") * F.col("q.b") - F.col("q.a") * F.col("p.b")) > 0.001).select("pid", G.intersect_lines(F.col("p"), F.col("q")).alias("i"))
    return x.select("pid", F.round("i.x", 4).alias("x"), F.round("i.y", 4).alias("y"))


@query(f"""{_SEG}, d AS (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM s), k AS (SELECT *, greatest(0, least((-0.1-x1)/dx, (0.1-x1)/dx), least((-0.1-y1)/dy, (0.1-y1)/dy)) AS lo,
least(1, greatest((-0.1-x1)/dx, (0.1-x1)/dx), greatest((-0.1-y1)/dy, (0.1-y1)/dy)) AS hi FROM d) SELECT pid, {R('x1+lo*dx')} AS x1, {R('y1+lo*dy')} AS y1, {R('x1+hi*dx')} AS x2, {R('y1+hi*dy')} AS y2 FROM k WHERE lo <= hi""")
def segment_clip(spark, sf_dir):
    x = _segments(spark, sf_dir).select("pid", G.clip_to_box(F.col("s"), -0.1, -0.1, 0.1, 0.1).alias("c")).where("c is not null")
    return x.select("pid", *[r6(f"c.{n}").alias(n) for n in ("x1", "y1", "x2", "y2")])


@query(f"""{_SEG}, l AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS n, sqrt((u2-u1)*(u2-u1)+(v2-v1)*(v2-v1)) AS m FROM s),
d AS (SELECT pid, n, m, (x2-x1)*(u2-u1)+(y2-y1)*(v2-v1) AS dp, abs((x2-x1)*(y1-v1)-(x1-u1)*(y2-y1))/n AS a, abs((x2-x1)*(y1-v2)-(x1-u2)*(y2-y1))/n AS b,
abs((u2-u1)*(v1-y1)-(u1-x1)*(v2-v1))/m AS c, abs((u2-u1)*(v1-y2)-(u1-x2)*(v2-v1))/m AS d FROM l)
SELECT pid, {R('degrees(acos(least(1, abs(dp)/(n*m))))')} AS angle, {R('(a+b+c+d)/4')} AS mean, {R('greatest(a,b,c,d)')} AS greatest, {R('CASE WHEN n <= m THEN least(c,d) ELSE least(a,b) END')} AS least_short FROM d""")
def segment_measures(spark, sf_dir):
    x = _segments(spark, sf_dir).select("pid", G.segment_measure(F.col("s"), F.col("q")).alias("m"))
    return x.select("pid", *[r6(f"m.{n}").alias(n) for n in ("angle", "mean", "greatest", "least_short")])


@query(f"""{_SEG} SELECT pid, ((x2-x1)*(v1-y1)-(y2-y1)*(u1-x1))*((x2-x1)*(v2-y1)-(y2-y1)*(u2-x1)) < 0 AND ((u2-u1)*(y1-v1)-(v2-v1)*(x1-u1))*((u2-u1)*(y2-v1)-(v2-v1)*(x2-u1)) < 0 AS crossing FROM s""")
def segment_crossing(spark, sf_dir):
    return _segments(spark, sf_dir).select("pid", G.segments_cross(F.col("s"), F.col("q")).alias("crossing"))


@query(f"""WITH {P}, n AS (SELECT pid, nx, ny, nz, CASE WHEN nz < 0 THEN -1 ELSE 1 END AS up, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM p),
d AS (SELECT pid, degrees(acos(least(1, abs(nz)/l))) AS dip, degrees(atan2(nx*up, ny*up)) AS a FROM n), e AS (SELECT pid, dip, CASE WHEN a < 0 THEN a + 360 ELSE a END AS direction FROM d)
SELECT pid, {R('dip')} AS dip, {R('direction')} AS direction, {R('CASE WHEN direction < 90 THEN direction + 270 ELSE direction - 90 END')} AS strike FROM e""")
def dip_direction(spark, sf_dir):
    x = points(spark, sf_dir).select("pid", V.vec("nx", "ny", "nz").alias("n"))
    return x.select("pid", r6(G.dip_direction(F.col("n")).dip).alias("dip"), r6(G.dip_direction(F.col("n")).direction).alias("direction"), r6(G.strike_dip(F.col("n")).strike).alias("strike"))


@query(f"""WITH {P} SELECT pid, {R('degrees(atan2(y, x))')} AS yaw, {R('degrees(asin(z/sqrt(x*x+y*y+z*z)))')} AS pitch, {R('sqrt(x*x+y*y+z*z)')} AS range, {R('atan2(y, x)*0.5')} AS arc, {R('sqrt(x*x+y*y)-0.5')} AS off FROM p""")
def spherical_coordinates(spark, sf_dir):
    x = points(spark, sf_dir).select("pid", V.vec("x", "y", "z").alias("p"))
    s, u = G.spherical(F.col("p")), G.unroll_cylinder(F.col("p"), 0.5)
    return x.select("pid", r6(s.yaw).alias("yaw"), r6(s.pitch).alias("pitch"), r6(s.range).alias("range"), r6(u.x).alias("arc"), r6(u.z).alias("off"))


@query(f"""WITH {P}, b AS (SELECT pid, ((0.2-0.3)*(x+0.2)+(-0.2-0.1)*(y-0.3))/((0.2-0.3)*(-0.3+0.2)+(-0.2-0.1)*(-0.2-0.3)) AS u,
((0.3+0.2)*(x+0.2)+(-0.3+0.2)*(y-0.3))/((0.2-0.3)*(-0.3+0.2)+(-0.2-0.1)*(-0.2-0.3)) AS v FROM p) SELECT pid, {R('u')} AS u, {R('v')} AS v, u >= 0 AND v >= 0 AND 1-u-v >= 0 AS inside FROM b""")
def barycentric(spark, sf_dir):
    a, b, c = (G.point2(F.lit(p), F.lit(q)) for p, q in ((-0.3, -0.2), (0.1, 0.2), (-0.2, 0.3)))
    k = G.barycentric(F.col("x"), F.col("y"), a, b, c)
    x = points(spark, sf_dir).select("pid", "x", "y", k.alias("k"))
    return x.select("pid", r6("k.u").alias("u"), r6("k.v").alias("v"), G.point_in_triangle(F.col("x"), F.col("y"), a, b, c).alias("inside"))


@query(f"""WITH {P}, c AS (SELECT pid, x*0.8-y*0.6+0.1 AS a, x*0.6+y*0.8-0.2 AS b, z+1.5 AS d FROM p), e AS (SELECT pid, a/d AS u, b/d AS v, d FROM c),
f AS (SELECT *, 1+0.1*(u*u+v*v)+0.01*(u*u+v*v)*(u*u+v*v) AS k FROM e) SELECT pid, {R('500*u*k+320')} AS u, {R('500*v*k+240')} AS v, {R('d')} AS depth, 500*u*k+320 BETWEEN 0 AND 639 AND 500*v*k+240 BETWEEN 0 AND 479 AS inside FROM f""")
def camera_projection(spark, sf_dir):
    r = F.array(*[F.lit(v) for v in (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)])
    q = camera.to_camera(r, V.vec(0.1, -0.2, 1.5), V.vec("x", "y", "z"))
    x = points(spark, sf_dir).select("pid", q.alias("q"))
    x = x.select("pid", camera.project(F.col("q"), 500.0, 500.0, 320.0, 240.0, 0.1, 0.01).alias("i"))
    return x.select("pid", r6("i.u").alias("u"), r6("i.v").alias("v"), r6("i.depth").alias("depth"), camera.inside_image(F.col("i.u"), F.col("i.v"), 640, 480).alias("inside"))


@query(f"WITH {P} SELECT pid, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM p")
def pose_round_trip(spark, sf_dir):
    r = camera.axis_angle_matrix(V.vec(0.3, -0.5, 0.7))
    x = points(spark, sf_dir).select("pid", V.vec("x", "y", "z").alias("p"), r.alias("r"), V.vec(0.1, 0.2, -0.4).alias("t"))
    x = x.select("pid", "r", "t", camera.to_camera(F.col("r"), F.col("t"), F.col("p")).alias("q"))
    x = x.select("pid", camera.to_world(F.col("r"), F.col("t"), F.col("q")).alias("w"))
    return x.select("pid", *[r6(f"w.{c}").alias(c) for c in "xyz"])


@query("""WITH c AS (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, (p_partkey * 3) % 256 AS b, p_retailprice AS v FROM part), n AS (SELECT *, (v - 900) / 1200.0 AS q FROM c),
m AS (SELECT *, CASE WHEN q < 0 OR q > 1 THEN -1 ELSE q END AS p FROM n)
SELECT p_partkey, round(0.299 * r + 0.587 * g + 0.114 * b, 4) AS luma, round(p, 6) AS place, round(least(greatest(1.5 - abs(4 * p - 3), 0), 1), 6) AS red FROM m""")
def colour_functions(spark, sf_dir):
    x = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_partkey") * 3 % 256).alias("b"), colour.normalised(F.col("p_retailprice"), 900.0, 2100.0).alias("p"))
    return x.select("p_partkey", F.round(colour.luma(F.col("r"), F.col("g"), F.col("b")), 4).alias("luma"), F.round("p", 6).alias("place"), F.round(colour.jet(F.col("p")).r, 6).alias("red"))


@query("""SELECT event_id, round(exp(-0.5 * power((value - 50) / 20, 2)) / (20 * sqrt(2 * pi())), 8) AS normal, round((1.5 / 60) * power(value / 60, 0.5) * exp(-power(value / 60, 1.5)), 8) AS weibull,
round(exp(-value / 20) * (1 + value / 20), 8) AS tail FROM events WHERE value > 0""")
def distribution_functions(spark, sf_dir):
    v = F.col("value")
    e = t(spark, sf_dir, "events").where("value > 0")
    return e.select("event_id", F.round(distributions.normal_pdf(v, 50.0, 20.0), 8).alias("normal"), F.round(distributions.weibull_pdf(v, 1.5, 60.0), 8).alias("weibull"), F.round(distributions.chi_square_tail(v / 10.0, 4), 8).alias("tail"))


@query()
def error_function(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", F.round(distributions.erf(F.col("c_acctbal") / 3000.0), 9).alias("erf"))


@query("""SELECT vec_id, round(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 6) AS spread, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE)), 5) AS square, len(list_distinct(embedding)) <> len(embedding) AS repeats FROM embeddings""")
def array_functions(spark, sf_dir):
    e = F.transform("embedding", lambda v: v.cast("double"))
    x = t(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return x.select("vec_id", F.round(V.array_extremes(F.col("e")).range, 6).alias("spread"), F.round(V.array_dot(F.col("e"), F.col("e")), 5).alias("square"), V.has_repeats(F.col("e")).alias("repeats"))


# --- graphs --------------------------------------------------------------------------------------------------------

_NEAR = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"
_REACH = "e AS (SELECT a.pid AS a, b.pid AS b FROM p a, p b WHERE {d} <= {r} * {r})"


def _near_edges(spark, sf_dir, radius: float) -> DataFrame:
    p = points(spark, sf_dir).select("pid", "x", "y", "z")
    return spatial.radius_join(p, p, radius).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"))


@query(f"""WITH RECURSIVE {P}, {_REACH.format(d=_NEAR, r=0.06)}, c AS (SELECT pid AS id, pid AS root FROM p UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id)
SELECT id, min(root) AS component_id FROM c GROUP BY id""")
def components(spark, sf_dir):
    return graph.connected(_near_edges(spark, sf_dir, 0.06))


@query(f"""WITH RECURSIVE {P}, {_REACH.format(d=_NEAR, r=0.09)}, l AS (SELECT e.a, e.b FROM e JOIN p s ON s.pid = e.a JOIN p q ON q.pid = e.b WHERE s.label = q.label),
c AS (SELECT pid AS id, pid AS root FROM p UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id) SELECT id, min(root) AS component_id FROM c GROUP BY id""")
def label_components(spark, sf_dir):
    nodes = points(spark, sf_dir).select(F.col("pid").alias("id"), "label")
    return graph.connected_within_labels(_near_edges(spark, sf_dir, 0.09), nodes)


@query(f"""WITH RECURSIVE {P}, {_REACH.format(d=_NEAR, r=0.07)}, k AS (SELECT a FROM e GROUP BY a HAVING count(*) >= 4), ce AS (SELECT e.* FROM e JOIN k ON k.a = e.a JOIN k j ON j.a = e.b),
c AS (SELECT a AS id, a AS root FROM k UNION SELECT ce.b, c.root FROM c JOIN ce ON ce.a = c.id), g AS (SELECT id, min(root) AS cluster FROM c GROUP BY id),
o AS (SELECT e.a, e.b, row_number() OVER (PARTITION BY e.a ORDER BY {_NEAR}, e.b) AS r FROM e JOIN p a ON a.pid = e.a JOIN p b ON b.pid = e.b WHERE e.a NOT IN (SELECT a FROM k) AND e.b IN (SELECT a FROM k))
SELECT p.pid, coalesce(g.cluster, h.cluster, -1) AS cluster FROM p LEFT JOIN g ON g.id = p.pid LEFT JOIN o ON o.a = p.pid AND o.r = 1 LEFT JOIN g h ON h.id = o.b""")
def dbscan(spark, sf_dir):
    return graph.dbscan(points(spark, sf_dir).select("pid", "x", "y", "z"), 0.07, 4)


_EVERY_MATCH = "m AS (SELECT l_orderkey AS va, l_partkey AS ia, l_suppkey AS vb, l_linenumber + l_partkey AS ib FROM lineitem)"


@query(f"""WITH RECURSIVE {_EVERY_MATCH}, e AS (SELECT va * 4294967296 + ia AS a, vb * 4294967296 + ib AS b FROM m), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
c AS (SELECT a AS id, a AS root FROM u UNION SELECT u.b, c.root FROM c JOIN u ON u.a = c.id AND c.root < u.b), g AS (SELECT id, min(root) AS track FROM c GROUP BY id),
n AS (SELECT track, count(*) AS n, count(DISTINCT id // 4294967296) AS v FROM g GROUP BY track) SELECT track, n, n <> v AS conflict FROM n WHERE n >= 2""")
def tracks(spark, sf_dir):
    """Tracks over every order line, the keys themselves as views and items."""
    x = t(spark, sf_dir, "lineitem")
    m = x.select(F.col("l_orderkey").alias("view_a"), F.col("l_partkey").alias("item_a"), F.col("l_suppkey").alias("view_b"), (F.col("l_linenumber") + F.col("l_partkey")).alias("item_b"))
    return graph.tracks(m).groupBy("track", "conflict").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {P}, {_REACH.format(d=_NEAR, r=0.08)}, c(id, seed, d) USING KEY (id) AS (SELECT pid, pid, 0 FROM p WHERE pid IN (SELECT min(pid) FROM p GROUP BY label)
UNION SELECT e.b, min(c.seed), min(c.d) + 1 FROM c JOIN e ON e.a = c.id LEFT JOIN recurring.c k ON k.id = e.b WHERE k.id IS NULL GROUP BY e.b)
SELECT id, CAST(d AS DOUBLE) AS distance, seed FROM c""")
def breadth_first(spark, sf_dir):
    """Until no node is reached any more; of several nearest seeds the smallest."""
    seeds = points(spark, sf_dir).groupBy("label").agg(F.min("pid").alias("id")).select("id")
    return graph.search(_near_edges(spark, sf_dir, 0.08), seeds).select("id", "distance", "seed")


@query("""WITH a AS (SELECT l_suppkey AS i, l_partkey % 200 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), b AS (SELECT p_partkey % 200 AS k, p_size AS j, count(*)::DOUBLE AS w FROM part GROUP BY 1, 2)
SELECT i, j, round(sum(v * w), 4) AS v FROM a JOIN b USING (k) GROUP BY 1, 2""")
def sparse_matmul(spark, sf_dir):
    a = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), (F.col("l_partkey") % 200).alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = t(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 200).alias("i"), F.col("p_size").alias("j")).agg(F.count("*").cast("double").alias("v"))
    return graph.sparse_multiply(a, b).select("i", "j", F.round("v", 4).alias("v"))


@query()
def spanning_forest(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "x", "y", "z")
    e = spatial.radius_join(p, p, 0.08).where("a.pid < b.pid").select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"), F.col("d2").alias("w"))
    return graph.spanning_forest(e)


@query()
def normal_orientation(spark, sf_dir):
    return graph.oriented_by_tree(points(spark, sf_dir).select("pid", "nx", "ny", "nz"), _near_edges(spark, sf_dir, 0.08).where("a < b"))


@query()
def potts_labels(spark, sf_dir):
    p = points(spark, sf_dir)
    costs = p.select(F.col("pid").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("label"), "nx").withColumn("cost", F.abs(F.col("nx") * 10 - F.col("label") + 1.5)).drop("nx")
    return graph.potts(costs, _near_edges(spark, sf_dir, 0.08).where("a < b"), 0.4)


@query(f"""WITH {P}, {_REACH.format(d=_NEAR, r=0.08)} SELECT e.a AS id, {R('avg(p.nx)')} AS v FROM e JOIN p ON p.pid = e.b WHERE e.a <> e.b GROUP BY e.a""")
def neighbour_average(spark, sf_dir):
    e = _near_edges(spark, sf_dir, 0.08).where("a < b")
    v = points(spark, sf_dir).select(F.col("pid").alias("id"), F.col("nx").alias("v"))
    ends = e.select(F.col("a").alias("id")).union(e.select("b")).distinct()
    return graph.averaged(v, e).join(ends, "id").select("id", r6("v").alias("v"))


@query(f"""WITH RECURSIVE {P}, v AS (SELECT DISTINCT floor(x / 0.1) AS a, floor(y / 0.1) AS b, floor(z / 0.1) AS c FROM p),
k AS (SELECT *, row_number() OVER (ORDER BY a, b, c) AS id FROM v), e AS (SELECT s.id AS s, q.id AS q FROM k s JOIN k q ON abs(s.a - q.a) <= 1 AND abs(s.b - q.b) <= 1 AND abs(s.c - q.c) <= 1),
r AS (SELECT id, id AS root FROM k UNION SELECT e.q, r.root FROM r JOIN e ON e.s = r.id), g AS (SELECT id, min(root) AS g FROM r GROUP BY id), n AS (SELECT g, count(*) AS n FROM g GROUP BY g)
SELECT n, count(*) AS components FROM n GROUP BY n""")
def voxel_components(spark, sf_dir):
    p = points(spark, sf_dir)
    c = p.select(*[F.floor(F.col(a) / 0.1).alias(f"v{a}") for a in "xyz"])
    n = graph.grid_components(c).groupBy("component").agg(F.count("*").alias("n"))
    return n.groupBy("n").agg(F.count("*").alias("components"))


# --- fits ----------------------------------------------------------------------------------------------------------


@query()
def group_planes(spark, sf_dir):
    return fitting.group_planes(points(spark, sf_dir), "label")


@query()
def eigen_features(spark, sf_dir):
    return fitting.eigen_features(fitting.knn_eigen(points(spark, sf_dir), 10))


@query()
def quadric_fit(spark, sf_dir):
    return fitting.quadric(points(spark, sf_dir), "label")


@query()
def surface_curvature(spark, sf_dir):
    return fitting.curvature(points(spark, sf_dir), 0.15)


@query()
def sphere_fit(spark, sf_dir):
    c, r = fitting.sphere(points(spark, sf_dir))
    return one(spark, x=float(c[0]), y=float(c[1]), z=float(c[2]), radius=float(r))


@query()
def ransac_plane(spark, sf_dir):
    return spark.createDataFrame([{k: float(v) for k, v in fitting.ransac_plane(points(spark, sf_dir), 0.05).items()}])


@query()
def icp_alignment(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "x", "y", "z")
    r = [[math.cos(0.05), -math.sin(0.05), 0.0], [math.sin(0.05), math.cos(0.05), 0.0], [0.0, 0.0, 1.0]]
    turn, shift, rms = fitting.icp(fitting.moved(p, np.array(r), [0.01, -0.01, 0.005]), p, rounds=6)
    return one(spark, rms=float(rms), angle=float(math.atan2(turn[1, 0], turn[0, 0])), dx=float(shift[0]))


@query()
def colour_outliers(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_extendedprice")
    return fitting.colour_outliers(x, "l_suppkey", "l_extendedprice", 4, 1.8).groupBy("l_suppkey").agg(F.count(F.when(F.col("inlier"), 1)).alias("inliers"))


# --- meshes --------------------------------------------------------------------------------------------------------

_FACES = "f AS (SELECT event_id AS fid, [user_id % n, (event_id * 7 + user_id) % n, (event_id * 13) % n] AS v FROM events, (SELECT count(*) AS n FROM embeddings))"
_GOOD = "g AS (SELECT * FROM f WHERE v[1] <> v[2] AND v[2] <> v[3] AND v[1] <> v[3])"
_EDGES = "d AS (SELECT fid, v[1] AS a, v[2] AS b FROM g UNION ALL SELECT fid, v[2], v[3] FROM g UNION ALL SELECT fid, v[3], v[1] FROM g)"


def _mesh(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = t(spark, sf_dir, "events")
    n = t(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    e = e.crossJoin(F.broadcast(n))  # one row
    f = e.select(F.col("event_id").alias("fid"), F.array(F.col("user_id") % F.col("n"), (F.col("event_id") * 7 + F.col("user_id")) % F.col("n"), F.col("event_id") * 13 % F.col("n")).alias("v"))
    return points(spark, sf_dir).select(F.col("pid").alias("vid"), "x", "y", "z"), f


def _good(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    v, f = _mesh(spark, sf_dir)
    return v, mesh.without_degenerate(f)


@query(f"WITH {_FACES} SELECT fid FROM f WHERE len(list_distinct(v)) = 3")
def nondegenerate_faces(spark, sf_dir):
    return mesh.without_degenerate(_mesh(spark, sf_dir)[1]).select("fid")


@query(f"WITH {_FACES}, {_GOOD}, {_EDGES} SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM d GROUP BY 1, 2")
def edge_usage(spark, sf_dir):
    return mesh.edge_usage(_good(spark, sf_dir)[1])


@query(f"""WITH {_FACES}, {_GOOD}, {_EDGES}, u AS (SELECT count(*) AS n FROM d GROUP BY least(a, b), greatest(a, b))
SELECT count(*) AS edges, count(*) FILTER (WHERE n = 1) AS border, count(*) FILTER (WHERE n = 2) AS shared, count(*) FILTER (WHERE n > 2) AS multiple FROM u""")
def edge_usage_classes(spark, sf_dir):
    return mesh.edge_classes(_good(spark, sf_dir)[1])


@query(f"""WITH {_FACES}, {_GOOD}, {_EDGES} SELECT DISTINCT x.fid AS f1, y.fid AS f2 FROM d x JOIN d y ON least(x.a, x.b) = least(y.a, y.b) AND greatest(x.a, x.b) = greatest(y.a, y.b) AND x.fid < y.fid""")
def face_adjacency(spark, sf_dir):
    return mesh.adjacency(_good(spark, sf_dir)[1])


@query(f"""WITH {_FACES}, {_GOOD} SELECT max(fid) AS fid FROM g GROUP BY list_sort(v)""")
def faces_largest_id(spark, sf_dir):
    from skerry.operators.filters import keep_largest_id

    return keep_largest_id(_good(spark, sf_dir)[1]).select("fid")


@query(f"""WITH {_FACES}, {_GOOD}, r AS (SELECT fid, CASE WHEN v[1] < v[2] AND v[1] < v[3] THEN [v[1], v[2], v[3]] WHEN v[2] < v[1] AND v[2] < v[3] THEN [v[2], v[3], v[1]] ELSE [v[3], v[1], v[2]] END AS k FROM g) SELECT min(fid) AS fid FROM r GROUP BY k""")
def distinct_faces(spark, sf_dir):
    return mesh.distinct_faces(_good(spark, sf_dir)[1]).select("fid")


_CORNERS = f"{P}, {_FACES}, {_GOOD}, t AS (SELECT g.fid, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS vx, c.y-a.y AS vy, c.z-a.z AS vz, a.x AS x, a.y AS y, a.z AS z FROM g JOIN p a ON a.pid = g.v[1] JOIN p b ON b.pid = g.v[2] JOIN p c ON c.pid = g.v[3]), n AS (SELECT *, uy*vz-uz*vy AS nx, uz*vx-ux*vz AS ny, ux*vy-uy*vx AS nz FROM t)"


@query(f"WITH {_CORNERS} SELECT fid, {R('0.5*sqrt(nx*nx+ny*ny+nz*nz)')} AS area, {R('nx/sqrt(nx*nx+ny*ny+nz*nz)')} AS nx, {R('(x*nx+y*ny+z*nz)/6')} AS volume FROM n")
def face_measures(spark, sf_dir):
    return mesh.face_measures(*_good(spark, sf_dir)).select("fid", r6("area").alias("area"), r6("normal.x").alias("nx"), r6("volume").alias("volume"))


@query(f"""WITH {_CORNERS}, c AS (SELECT unnest(g.v) AS vid, nx, ny, nz FROM g JOIN n ON n.fid = g.fid), s AS (SELECT vid, sum(nx) AS a, sum(ny) AS b, sum(nz) AS c FROM c GROUP BY vid)
SELECT vid, round(a/sqrt(a*a+b*b+c*c), 5) AS nx, round(b/sqrt(a*a+b*b+c*c), 5) AS ny FROM s""")
def vertex_normals(spark, sf_dir):
    return mesh.vertex_normals(*_good(spark, sf_dir)).select("vid", F.round("normal.x", 5).alias("nx"), F.round("normal.y", 5).alias("ny"))


@query(f"""WITH {_FACES}, u AS (SELECT DISTINCT unnest(v) AS vid FROM f) SELECT vid FROM u""")
def used_vertices(spark, sf_dir):
    return mesh.without_unused(*_mesh(spark, sf_dir)).select("vid")


@query(f"""WITH {P} SELECT count(*) AS n, {R('sum(mx)')} AS x FROM (SELECT avg(x) AS mx FROM p GROUP BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1))""")
def clustered_vertices(spark, sf_dir):
    v, _ = mesh.clustered(*_mesh(spark, sf_dir), 0.1)
    return v.agg(F.count("*").alias("n"), r6(F.sum("x")).alias("x"))


@query()
def mesh_clip(spark, sf_dir):
    return mesh.clipped(*_good(spark, sf_dir), "x", 0.0)


@query()
def mesh_cleaned(spark, sf_dir):
    return mesh.cleaned(*_mesh(spark, sf_dir))[1]


@query()
def mesh_point_distance(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "x", "y", "z")
    near = spatial.knn_join(p, p, 2).groupBy(F.col("a.pid").alias("fid")).agg(F.sort_array(F.collect_list("b.pid")).alias("n"))
    faces = near.where(F.size("n") == 2).select("fid", F.concat(F.array("fid"), "n").alias("v"))
    return mesh.mesh_distance(p, p.withColumnRenamed("pid", "vid"), faces, 0.1, 0.05)


@query()
def face_view_costs(spark, sf_dir):
    middle = points(spark, sf_dir).groupBy("label").agg(*[(F.avg(c) * 20.0).alias(c) for c in "xyz"])
    views = middle.select(F.col("label").alias("view_id"), V.vec("x", "y", "z").alias("centre"))
    return mesh.clamped_costs(mesh.face_view_costs(*_good(spark, sf_dir), views))


# --- rasters -------------------------------------------------------------------------------------------------------

_IMAGE = "m AS (SELECT 0 AS img, user_id AS i, event_id % 40 AS j, max(value) AS v FROM events GROUP BY 2, 3)"


def _image(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").groupBy(F.lit(0).alias("img"), F.col("user_id").alias("i"), (F.col("event_id") % 40).alias("j")).agg(F.max("value").alias("v"))


@query(f"WITH {_IMAGE} SELECT a.i, a.j, max(b.v) AS high, min(b.v) AS low FROM m a JOIN m b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY 1, 2")
def raster_morphology(spark, sf_dir):
    m = _image(spark, sf_dir)
    return images.dilated(m).select("i", "j", F.col("v").alias("high")).join(images.eroded(m).select("i", "j", F.col("v").alias("low")), ["i", "j"])


@query(f"WITH {_IMAGE} SELECT i // 2 AS i, j // 2 AS j, round(avg(v), 4) AS v FROM m GROUP BY 1, 2")
def raster_pyramid(spark, sf_dir):
    return images.pyramid_level(_image(spark, sf_dir)).select("i", "j", F.round("v", 4).alias("v"))


@query(f"WITH {_IMAGE} SELECT a.i, a.j, CAST(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) AS BIGINT) AS d2 FROM m a JOIN m b ON b.v > 150 AND abs(a.i - b.i) <= 4 AND abs(a.j - b.j) <= 4 GROUP BY 1, 2 HAVING min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) <= 16")
def raster_distance(spark, sf_dir):
    m = _image(spark, sf_dir).withColumn("v", F.when(F.col("v") > 150, 1).otherwise(0))
    return images.squared_distances(m, 4).select("i", "j", F.col("d2").cast("long").alias("d2"))


@query(f"WITH {_IMAGE} SELECT a.i, a.j, CAST(min((a.i - b.i) * (a.i - b.i) + (a.j - b.j) * (a.j - b.j)) AS BIGINT) AS d2 FROM m a JOIN m b ON b.v > 150 GROUP BY 1, 2")
def raster_distance_whole(spark, sf_dir):
    """`raster_distance` however far the nearest set cell is."""
    m = _image(spark, sf_dir).withColumn("v", F.when(F.col("v") > 150, 1).otherwise(0))
    return images.squared_distances(m).select("i", "j", F.col("d2").cast("long").alias("d2"))


@query(f"""WITH {_IMAGE}, b AS (SELECT i // 8 AS bi, j // 8 AS bj, i, j, v, row_number() OVER (PARTITION BY i // 8, j // 8 ORDER BY v DESC, i, j) AS r FROM m) SELECT i, j, v FROM b WHERE r = 1""")
def raster_block_best(spark, sf_dir):
    return images.best_of_blocks(_image(spark, sf_dir), 8).where("level = 0").select("i", "j", "v")


@query()
def raster_components(spark, sf_dir):
    return images.image_components(_image(spark, sf_dir).where("v > 120"))


@query()
def raster_chamfer(spark, sf_dir):
    m = _image(spark, sf_dir).withColumn("v", F.when(F.col("v") > 250, 1).otherwise(0))
    return images.chamfer_distances(m)


@query(f"""WITH {P}, s AS (SELECT pid, floor(degrees(atan2(y, x)) / 10) AS i, floor(degrees(asin(z / sqrt(x*x+y*y+z*z))) / 10) AS j, sqrt(x*x+y*y+z*z) AS d FROM p) SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY i, j ORDER BY d, pid) AS r FROM s) WHERE r = 1""")
def scan_z_buffer(spark, sf_dir):
    x = points(spark, sf_dir).select("pid", G.spherical(V.vec("x", "y", "z")).alias("s")).select("pid", "s.*")
    return images.z_buffer(x, 10.0).select("pid")


# --- records -------------------------------------------------------------------------------------------------------


@query(r"""WITH n AS (SELECT page_id, regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^.]*$', '') AS base FROM pages) SELECT a.page_id, min(b.page_id) AS first FROM n a JOIN n b USING (base) GROUP BY a.page_id""")
def base_name_join(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    return records.by_base_name(p, p, "url", "url", "page_id").select("page_id", F.col("match.page_id").alias("first"))


@query("""SELECT o_orderkey, coalesce(n_regionkey, -1) AS n_regionkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey""")
def two_hop_lookup(spark, sf_dir):
    c = t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    x = records.looked_up(t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"], "n_nationkey")
    return records.looked_up(x, t(spark, sf_dir, "nation"), ["n_nationkey"], "n_regionkey").select("o_orderkey", "n_regionkey")


@query(f"""WITH {P}, s AS (SELECT pid, label, x AS x1, y AS y1, z AS x2, nx AS y2 FROM p), q AS (SELECT a.pid, b.pid AS other, a.x2-a.x1 AS ux, a.y2-a.y1 AS uy, b.x2-b.x1 AS vx, b.y2-b.y1 AS vy, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM s a JOIN s b ON a.label = b.label AND a.pid <> b.pid),
m AS (SELECT pid, other, degrees(acos(least(1, abs(ux*vx+uy*vy)/(sqrt(ux*ux+uy*uy)*sqrt(vx*vx+vy*vy))))) AS angle, (abs(ux*(ay1-by1)-(ax1-bx1)*uy)/sqrt(ux*ux+uy*uy) + abs(ux*(ay1-by2)-(ax1-bx2)*uy)/sqrt(ux*ux+uy*uy) + abs(vx*(by1-ay1)-(bx1-ax1)*vy)/sqrt(vx*vx+vy*vy) + abs(vx*(by1-ay2)-(bx1-ax2)*vy)/sqrt(vx*vx+vy*vy))/4 AS d FROM q)
SELECT s.pid, coalesce(arg_min(m.other, m.angle + m.d), -1) AS match FROM s LEFT JOIN m ON m.pid = s.pid AND m.angle < 5 AND m.d < 5 GROUP BY s.pid""")
def nearest_line(spark, sf_dir):
    s = points(spark, sf_dir).select("label", F.col("pid").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("x2"), F.col("nx").alias("y2"))
    return records.nearest_line(s, s, "label", others=True).select(F.col("line_id").alias("pid"), "match")


@query(f"""WITH {P} SELECT a.pid AS view_id, array_to_string(list_sort(list(b.pid)), ',') AS near FROM p a JOIN p b ON a.label = b.label AND a.pid <> b.pid
WHERE degrees(acos(greatest(-1, least(1, (a.x*b.x+a.y*b.y+a.z*b.z)/(sqrt(a.x*a.x+a.y*a.y+a.z*a.z)*sqrt(b.x*b.x+b.y*b.y+b.z*b.z)))))) < 45 GROUP BY a.pid""")
def view_angle_groups(spark, sf_dir):
    v = points(spark, sf_dir).select("label", F.col("pid").alias("view_id"), F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))
    return records.view_groups(v, "label", 45.0).select("view_id", F.array_join(F.transform("near", lambda p: p.cast("string")), ",").alias("near"))


@query("""SELECT l_orderkey, count(*) AS n, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS views FROM lineitem GROUP BY 1""")
def nested_tracks(spark, sf_dir):
    o = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("view_id"), F.col("l_linenumber").alias("u"), F.col("l_quantity").alias("v"), F.lit(0).alias("polygon"))
    x = records.nested_tracks(o, o.select("track_id").distinct())
    views = F.array_distinct(F.transform("observations", lambda p: p.view_id))  # observations are sorted by view
    return x.select(F.col("track_id").alias("l_orderkey"), F.size("observations").cast("long").alias("n"), F.array_join(F.transform(views, lambda p: p.cast("string")), ",").alias("views"))


@query("SELECT c.c_custkey, coalesce(min(o.o_orderkey), -1) AS grp FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def first_sharing_group(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("item"))
    return records.first_sharing_group(c, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), F.col("o_orderkey").alias("grp")), "c_custkey", "item", "grp")


@query("SELECT url AS path, row_number() OVER (ORDER BY base, url) - 1 AS id FROM (SELECT DISTINCT url, regexp_replace(list_extract(string_split(url, '/'), -1), '\\.[^.]*$', '') AS base FROM pages)")
def ordered_files(spark, sf_dir):
    x = t(spark, sf_dir, "pages").select(F.col("url").alias("path")).distinct()
    return records.ordered_files(x).select("path", F.col("id").cast("long").alias("id"))


# --- streams and files ---------------------------------------------------------------------------------------------


def _frames(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("id"), (micros("ts") / 1e6).alias("ts"), (F.col("value") / 100.0).alias("x"), F.lit(0.0).alias("y"))


@query()
def keyframes(spark, sf_dir):
    from skerry.streaming.keyframes import replay

    return replay(_frames(spark, sf_dir), rate=1e-4, motion=1.0, cost=5000.0)


@query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf_dir):
    from skerry.streaming.keyframes import windowed_counts as counts

    x = counts(t(spark, sf_dir, "events").select("ts", "event_type", "value"), "ts", "1 day", "1 day", "event_type")
    return x.select(micros("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {P} SELECT pid, x, y, z FROM p")
def ply_round_trip(spark, sf_dir):
    from skerry.sources import ply

    ply.register(spark)
    path = f"{Scratch(spark).root}/points.ply"
    points(spark, sf_dir).select(F.col("pid").cast("int").alias("pid"), "x", "y", "z").write.format("ply").mode("append").save(path)
    return spark.read.format("ply").load(path).select(F.col("pid").cast("long").alias("pid"), "x", "y", "z")


# --- surfaces ------------------------------------------------------------------------------------------------------


@query()
def isosurface(spark, sf_dir):
    v = aggregates.scatter_tsdf(points(spark, sf_dir), 0.1, 0.2)
    return surfaces.isosurface(v.select("cx", "cy", "cz", F.col("tsdf").alias("v")), 0.1)


@query()
def label_triangulation(spark, sf_dir):
    return surfaces.delaunay(points(spark, sf_dir), "label", 0.3)


@query()
def moving_least_squares(spark, sf_dir):
    return surfaces.moving_least_squares(points(spark, sf_dir), 0.12)


@query()
def planar_regions(spark, sf_dir):
    return surfaces.planar_regions(points(spark, sf_dir), 0.1, 20.0, 0.03)


@query()
def graph_partitions(spark, sf_dir):
    seeds = points(spark, sf_dir).groupBy("label").agg(F.min("pid").alias("id")).select("id")
    return surfaces.partitions(_near_edges(spark, sf_dir, 0.12).where("a < b"), seeds, 2)
