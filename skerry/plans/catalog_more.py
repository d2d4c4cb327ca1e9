"""Named queries of levels, shapes, adjustment tables and small formats, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skerry.functions import vectors as V
from skerry.operators import adjust, levels, shapes, spatial
from skerry.plans.catalog import D2, P, R, one, points, query, r6, t
from skerry.plans.catalog_functions import _TRI, cells, place, spread, turn, vectors
from skerry.plans.catalog_models import _EDGES, _FACES, _GOOD, _good, _mesh
from skerry.plans.iterate import Scratch

# --- levels and neighbourhoods -------------------------------------------------------------------------------------


@query(f"WITH {P}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM p), l AS (SELECT unnest([1,2,3,4,5,6]) AS level) "
       "SELECT level, count(DISTINCT (least(floor((x-lx)/s*2097152),2097151)::BIGINT >> (21 - level), least(floor((y-ly)/s*2097152),2097151)::BIGINT >> (21 - level), least(floor((z-lz)/s*2097152),2097151)::BIGINT >> (21 - level))) AS cells FROM p, b, l GROUP BY level")  # fmt: skip
def occupied_cells(spark, sf_dir):
    return levels.cells_by_level(points(spark, sf_dir), 6)


@query(f"WITH {P}, b AS (SELECT greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM p) SELECT least(greatest(round(log2(s / (0.05 * 2.5))), 1), 21)::INT AS level, true AS between FROM b")
def chosen_levels(spark, sf_dir):
    p = points(spark, sf_dir)
    n = {r["level"]: r["cells"] for r in levels.cells_by_level(p).collect()}
    best = levels.level_for_count(p, 100)
    return one(spark, level=levels.level_for_radius(levels.cube_side(p), 0.05), between=all(abs(n[best] - 100) <= abs(c - 100) for c in n.values()))


@query(f"""WITH {P}, a AS (SELECT *, CASE WHEN x > (SELECT quantile_disc(x, 0.5) FROM p) THEN 3 ELSE 2 END AS l1 FROM p), b AS (SELECT *, 2 * l1 + CASE WHEN y > quantile_disc(y, 0.5) OVER (PARTITION BY l1) THEN 1 ELSE 0 END AS l2 FROM a)
SELECT pid, (2 * l2 + CASE WHEN z > quantile_disc(z, 0.5) OVER (PARTITION BY l2) THEN 1 ELSE 0 END)::BIGINT AS leaf FROM b""")
def median_leaves(spark, sf_dir):
    return levels.median_leaves(points(spark, sf_dir), 3).select("pid", "leaf")


@query(f"""WITH {P}, x AS (SELECT label AS leaf, {', '.join(f'min({c}) AS l{c}, max({c}) AS h{c}' for c in 'xyz')} FROM p WHERE x > 0.1 OR label < 3 GROUP BY label)
SELECT a.leaf AS a, b.leaf AS b FROM x a JOIN x b ON a.leaf < b.leaf AND {' AND '.join(f'a.l{c} <= b.h{c} AND b.l{c} <= a.h{c}' for c in 'xyz')}""")
def touching_boxes(spark, sf_dir):
    p = points(spark, sf_dir).where("x > 0.1 or label < 3").withColumn("leaf", F.col("label"))
    return levels.touching_leaves(p)


PLANES = [(1.0, 0.5, 0.0, 0.1), (-1.0, 0.2, 0.3, 0.15), (0.0, -0.4, 1.0, 0.12)]
_IN = " AND ".join(f"({a}*x + {b}*y + {c}*z + {d} >= 0)" for a, b, c, d in PLANES)


@query(f"WITH {P} SELECT pid FROM p WHERE {_IN}")
def frustum_by_cells(spark, sf_dir):
    return levels.in_frustum_by_cells(points(spark, sf_dir), 0.1, PLANES).select("pid")


@query(f"WITH {P}, m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM p WINDOW w AS (PARTITION BY label)) SELECT label, {R('sqrt(max((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)))')} AS radius FROM m GROUP BY label")
def largest_radius(spark, sf_dir):
    return levels.largest_radius(points(spark, sf_dir), "label").select("label", r6("radius").alias("radius"))


@query(f"WITH {P} SELECT a.pid, {R(f'(power(avg(b.x-a.x),2)+power(avg(b.y-a.y),2)+power(avg(b.z-a.z),2))/avg({D2})')} AS moment FROM p a JOIN p b ON {D2} <= 0.01 AND {D2} > 0 GROUP BY a.pid")
def first_moment(spark, sf_dir):
    return levels.first_moment(points(spark, sf_dir), 0.1).select("pid", r6("moment").alias("moment"))


@query(f"""WITH {P}, f AS (SELECT label, arg_min(nx, pid) AS fx, arg_min(ny, pid) AS fy, arg_min(nz, pid) AS fz FROM p GROUP BY label), s AS (SELECT label, sum(nx*s) AS x, sum(ny*s) AS y, sum(nz*s) AS z FROM (SELECT p.*, CASE WHEN nx*fx+ny*fy+nz*fz < 0 THEN -1 ELSE 1 END AS s FROM p JOIN f USING (label)) GROUP BY label)
SELECT label, {spread('n', 'x/sqrt(x*x+y*y+z*z)', 'y/sqrt(x*x+y*y+z*z)', 'z/sqrt(x*x+y*y+z*z)')} FROM s""")
def aligned_normals(spark, sf_dir):
    return levels.aligned_mean_normal(points(spark, sf_dir), "label").select("label", *cells("n", F.col("normal")))


@query(f"WITH {P} SELECT pid FROM p a WHERE label = 1 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label = 2 AND {D2} < 0.01)")
def far_candidates(spark, sf_dir):
    p = points(spark, sf_dir)
    return levels.far_candidates(p.where("label = 1"), p.where("label = 2"), 0.1).select("pid")


@query(f"""WITH {P}, k AS (SELECT a.pid, b.pid AS near, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM p a, p b WHERE a.label % 2 = 0 AND b.label % 2 = 1), g AS (SELECT pid, near AS parent FROM k WHERE r = 1)
SELECT g.pid, parent, {R('CASE WHEN c.label % 4 = 0 THEN 0.5 * c.x + 0.5 * u.x ELSE u.x END')} AS v FROM g JOIN p c ON c.pid = g.pid JOIN p u ON u.pid = parent""")
def values_pushed_down(spark, sf_dir):
    p = points(spark, sf_dir)
    low, high = p.where("label % 2 = 0"), p.where("label % 2 = 1")
    _, parent = levels.with_parents(low, high, 2)
    children = low.join(parent, "pid").select("pid", "parent", (F.col("label") % 4 == 0).alias("good"), F.col("x").alias("v"))
    return levels.pushed_down(children, high.select("pid", F.col("x").alias("v")), "v").select("pid", "parent", r6("v").alias("v"))


@query(f"""WITH {P}, k AS (SELECT a.pid, b.pid AS near, b.x, b.label, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM p a, p b WHERE a.pid <> b.pid), m AS (SELECT pid, count(*) AS n, quantile_disc(x, 0.5) AS m FROM k WHERE r <= 6 AND label % 3 > 0 GROUP BY pid)
SELECT p.pid, {R('CASE WHEN n >= 3 THEN m ELSE x END')} AS v FROM p LEFT JOIN m USING (pid)""")
def medians_of_good(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("good", F.col("label") % 3 > 0).withColumn("v", F.col("x"))
    near, _ = levels.with_parents(p, p, 6)
    return levels.median_of_good(p, near, "v").select("pid", r6("v").alias("v"))


@query(f"""WITH {P}, k AS (SELECT a.pid, b.nx AS v, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM p a, p b), o AS (SELECT pid, count(*) FILTER (WHERE v <= -0.1) AS a, count(*) FILTER (WHERE v > -0.1 AND v <= 0.1) AS b, count(*) FILTER (WHERE v > 0.1) AS c FROM k WHERE r <= 12 GROUP BY pid)
SELECT pid, {R('power(a-3,2)/3+power(b-6,2)/6+power(c-3,2)/3')} AS chi2 FROM o""")
def local_chi_square(spark, sf_dir):
    return levels.local_chi_square(points(spark, sf_dir), "nx", 12, [-0.1, 0.1], [0.25, 0.5, 0.25]).select("pid", r6("chi2").alias("chi2"))


@query("""WITH h AS (SELECT event_id % 12 AS bin, count(*) AS o, 100.0 * (1 + event_id % 12) AS e FROM events GROUP BY 1, 3) SELECT round(sum(power(o - e, 2) / e), 6) AS chi2, count(*) AS classes FROM h""")
def chi_square_classes(spark, sf_dir):
    h = t(spark, sf_dir, "events").groupBy((F.col("event_id") % 12).alias("bin")).agg(F.count("*").alias("o")).withColumn("e", 100.0 * (1 + F.col("bin")))
    return levels.chi_square(h, "e", "o", 5.0).select(F.round("chi2", 6).alias("chi2"), "classes")


# --- shapes --------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT pid, true AS through FROM p WHERE pid % 3 = 0")
def sphere_of_four(spark, sf_dir):
    """Spheres through a point and three more of its numbers; each must hold all four."""
    a, b = F.col("a"), F.col("b")
    four = [a, b, V.add(V.cross(a, b), V.vec(0.1, 0.2, 0.3)), V.vec(0.5, -0.4, 0.3)]
    x = vectors(spark, sf_dir).where("pid % 3 = 0").select("pid", *[p.alias(f"p{k}") for k, p in enumerate(four)])
    x = x.withColumn("s", shapes.sphere_of_four(*[F.col(f"p{k}") for k in range(4)]))
    off = F.greatest(*[F.abs(V.distance(F.col(f"p{k}"), V.vec("s.x", "s.y", "s.z")) - F.col("s.r")) / (1.0 + F.col("s.r")) for k in range(4)])
    return x.select("pid", F.coalesce(off < 1e-6, F.lit(True)).alias("through"))


@query(f"""WITH {P}, d AS (SELECT pid, x-0.1 AS x, y+0.05 AS y, z AS z FROM p) SELECT pid, {R('sqrt(x*x+y*y+z*z)-0.3')} AS sphere, {R('sqrt(x*x+y*y)-0.3')} AS cylinder, {R('sqrt(x*x+y*y)*cos(0.4)-z*sin(0.4)')} AS cone, {R('sqrt(power(sqrt(x*x+y*y)-0.3,2)+z*z)-0.1')} AS torus FROM d""")
def shape_residuals(spark, sf_dir):
    c, u = [0.1, -0.05, 0.0], [0.0, 0.0, 2.0]
    r = {"sphere": [*c, 0.3], "cylinder": [*c, *u, 0.3], "cone": [*c, *u, 0.4], "torus": [*c, *u, 0.3, 0.1]}
    return points(spark, sf_dir).select("pid", *[r6(shapes.RESIDUALS[k](p)).alias(k) for k, p in r.items()])


def _laid(spark, sf_dir, kind: str):
    """The points' first two numbers as angles on a shape whose parameters are known."""
    p = points(spark, sf_dir).select("pid", (F.col("x") * 8.0).alias("s"), (F.col("y") * 8.0).alias("q"))
    s, q = F.col("s"), F.col("q")
    x, y, z, wanted, start = {
        "sphere": (F.cos(s) * F.cos(q), F.sin(s) * F.cos(q), F.sin(q), [0.5, -0.2, 0.1, 1.0], [0.6, -0.1, 0.0, 0.9]),
        "cylinder": (F.cos(s), F.sin(s), q, [0.5, -0.2, 0.0, 0.0, 0.0, 1.0, 1.0], [0.55, -0.15, 0.0, 0.05, 0.02, 1.0, 0.9]),
        "cone": (F.abs(q) * F.cos(s), F.abs(q) * F.sin(s), 2.0 * F.abs(q), [0.5, -0.2, 0.1, 0.0, 0.0, 1.0, math.atan(0.5)], [0.45, -0.15, 0.0, 0.05, 0.0, 1.0, 0.5]),
        "torus": ((2.0 + 0.5 * F.cos(q)) * F.cos(s), (2.0 + 0.5 * F.cos(q)) * F.sin(s), 0.5 * F.sin(q), [0.5, -0.2, 0.1, 0.0, 0.0, 1.0, 2.0, 0.5], [0.45, -0.15, 0.0, 0.03, 0.02, 1.0, 1.9, 0.6]),
    }[kind]
    shift = {"cylinder": (0.5, -0.2, 0.0)}.get(kind, (0.5, -0.2, 0.1))
    return p.select("pid", *[(c + d).alias(n) for c, d, n in zip((x, y, z), shift, "xyz", strict=True)]), wanted, start


@query("SELECT unnest(['cone', 'cylinder', 'sphere', 'torus']) AS kind, true AS exact, true AS sizes")
def shape_fits(spark, sf_dir):
    """Fits find the shapes that points were laid on: no residual is left, and radii or angles are the known ones."""
    rows = []
    for kind in ("cone", "cylinder", "sphere", "torus"):
        df, wanted, start = _laid(spark, sf_dir, kind)
        p, rms = shapes.fitted(df, kind, start, rounds=40)
        n = 2 if kind == "torus" else 1
        rows.append((kind, rms < 1e-6, all(abs(abs(a) - b) < 1e-5 for a, b in zip(p[-n:], wanted[-n:], strict=True))))
    return spark.createDataFrame(rows, "kind string, exact boolean, sizes boolean")


@query("SELECT true AS centre, true AS radius")
def robust_sphere(spark, sf_dir):
    """A quarter of the points is taken off the sphere; the rest tells it."""
    df, wanted, _ = _laid(spark, sf_dir, "sphere")
    df = df.withColumn("z", F.when(F.col("pid") % 4 == 0, F.col("z") * 2.5 + 0.7).otherwise(F.col("z")))
    p, _ = shapes.robust_sphere(df)
    return one(spark, centre=bool(np.abs(np.array(p[:3]) - wanted[:3]).max() < 1e-3), radius=abs(p[3] - 1.0) < 1e-3)


@query("SELECT unnest(['plane', 'sphere']) AS kind, true AS found")
def detected_shapes(spark, sf_dir):
    """A plane and a sphere in one cloud, by their oriented points."""
    p = points(spark, sf_dir).select("pid", "x", "y")
    flat = p.select("pid", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"), F.lit(3.0).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    ball, _, _ = _laid(spark, sf_dir, "sphere")
    ball = ball.where("pid % 3 > 0").select((F.col("pid") + 1_000_000).alias("pid"), "x", "y", "z", (F.col("x") - 0.5).alias("nx"), (F.col("y") + 0.2).alias("ny"), (F.col("z") - 0.1).alias("nz"))
    least = max(int(0.4 * p.count()), 1)
    found, rows = shapes.detected(flat.unionByName(ball), ["plane", "sphere"], 0.01, least, most=3)
    n = {r["shape"]: r["count"] for r in rows.groupBy("shape").count().collect()}
    good = lambda k: any(f["kind"] == k and f["rows"] >= least and n[i] == f["rows"] for i, f in enumerate(found))
    return spark.createDataFrame([(k, good(k)) for k in ("plane", "sphere")], "kind string, found boolean")


@query(f"WITH {P}, d AS (SELECT abs(sqrt(power(x-0.1,2)+y*y+z*z)-0.3)/0.1 AS d, abs(sqrt(power(x-0.1,2)+y*y+z*z)-0.31)/0.1 AS e FROM p) SELECT {R('sum(1-d) FILTER (WHERE d <= 1)')} AS score, count(*) FILTER (WHERE d <= 1 AND e <= 1) >= 0.9 * greatest(count(*) FILTER (WHERE d <= 1), count(*) FILTER (WHERE e <= 1)) AS same FROM d")
def shape_scores(spark, sf_dir):
    p = points(spark, sf_dir)
    a, b = [0.1, 0.0, 0.0, 0.3], [0.1, 0.0, 0.0, 0.31]
    same = shapes.equivalent(p, ("sphere", a), ("sphere", b), 0.1)
    return shapes.weighted_score(p, "sphere", a, 0.1).select(r6("score").alias("score")).crossJoin(F.broadcast(same))  # one row each


@query(f"WITH {P}, e AS (SELECT min(0.6*x+0.8*y) AS u0, max(0.6*x+0.8*y) AS u1, min(z) AS v0, max(z) AS v1 FROM p) SELECT round(u0, 6) + 0.0 AS u0, round(u1, 6) + 0.0 AS u1, round(v0, 6) + 0.0 AS v0, round(v1, 6) + 0.0 AS v1, (floor((u1-u0)/0.05)+1)::BIGINT AS nu, (floor((v1-v0)/0.05)+1)::BIGINT AS nv FROM e")
def plane_bitmap(spark, sf_dir):
    return shapes.plane_bitmap(points(spark, sf_dir), (0.6, 0.8, 0.0), (0.0, 0.0, 1.0), 0.05).select(*[r6(c).alias(c) for c in ("u0", "u1", "v0", "v1")], "nu", "nv")


@query("WITH g AS (SELECT unnest(range(6)) AS i), h AS (SELECT unnest(range(6)) AS j), q AS (SELECT p_partkey AS k, p_size / 10.0 AS c FROM part WHERE p_size > 40) SELECT k, i::INT AS i, j::INT AS j, round(c + 2*(-1+2*i/5.0) - (-1+2*j/5.0) + c*power(-1+2*i/5.0,2) + 0.5*(-1+2*i/5.0)*(-1+2*j/5.0) - c*power(-1+2*j/5.0,2), 6) + 0.0 AS z FROM q, g, h")
def quadric_grids(spark, sf_dir):
    c = F.col("p_size") / 10.0
    q = t(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("k"), *[v.alias(f"c{n}") for n, v in enumerate((c, F.lit(2.0), F.lit(-1.0), c, F.lit(0.5), 0.0 - c))])
    return shapes.quadric_grid(q, "k", -1.0, 1.0, 5).select("k", "i", "j", r6("z").alias("z"))


# --- adjustment ----------------------------------------------------------------------------------------------------

_CAM = f"WITH {P}, q AS (SELECT pid, 0.8*x-0.6*y AS rx, 0.6*x+0.8*y AS ry, z AS rz, 0.8*x-0.6*y+0.1 AS a, 0.6*x+0.8*y-0.2 AS b, z+1.5 AS c, nx, ny FROM p)"


def _seen(spark, sf_dir):
    r = adjust.point_residual(turn(), V.vec(0.1, -0.2, 1.5), 500.0, 320.0, 240.0, place(), 300.0 + 10.0 * F.col("nx"), 200.0 + 10.0 * F.col("ny"))
    return points(spark, sf_dir).select("pid", "label", r.alias("r")).select("pid", "label", "r.*")


@query(f"{_CAM} SELECT pid, {R('500*a/c+20-10*nx')} AS du, {R('500*b/c+40-10*ny')} AS dv, {spread('a', '-500*a/(c*c)*ry', '500/c*rz+500*a/(c*c)*rx', '-500/c*ry', names='012')}, {spread('b', '-500*b/(c*c)*ry-500/c*rz', '500*b/(c*c)*rx', '500/c*rx', names='012')}, "
       f"{R('500/c')} AS a3, {R('-500*a/(c*c)')} AS a5, {R('500/c*0.8')} AS pa0, {R('-500*b/(c*c)')} AS pb2 FROM q")  # fmt: skip
def point_residuals(spark, sf_dir):
    return _seen(spark, sf_dir).select("pid", *[r6(c).alias(c) for c in ("du", "dv", "a0", "a1", "a2", "b0", "b1", "b2", "a3", "a5", "pa0", "pb2")])


@query(f"{_CAM}, r AS (SELECT p.label, 500*a/c+20-10*q.nx AS du, 500*b/c+40-10*q.ny AS dv, 500/c AS g, -500*a/(c*c) AS e, -500*b/(c*c) AS f FROM q JOIN p USING (pid)) SELECT label, {R('sum(g*g)/1e6')} AS h33, {R('sum(e*e+f*f)/1e6')} AS h55, {R('sum(g*e)/1e6')} AS h35, {R('sum(g*du)/1e6')} AS g3, {R('sum(e*du+f*dv)/1e6')} AS g5 FROM r GROUP BY label")
def normal_blocks(spark, sf_dir):
    n = adjust.normal_blocks(_seen(spark, sf_dir), "label", ("a", "b"), 6)
    pick = lambda i, j, name: r6(F.max(F.when((F.col("i") == i) & (F.col("j") == j), F.col("h"))) / 1e6).alias(name)
    return n.groupBy("label").agg(pick(3, 3, "h33"), pick(5, 5, "h55"), pick(3, 5, "h35"), pick(3, -1, "g3"), pick(5, -1, "g5"))


@query(f"{_CAM} SELECT pid, {R('0.6*(500*a/c+320)+0.8*(500*b/c+240)-350')} AS d0, {R('0.6*(500*0.1/1.5+320)+0.8*(500*-0.2/1.5+240)-350')} AS d1 FROM q")
def line_residuals(spark, sf_dir):
    r = adjust.line_residual(turn(), V.vec(0.1, -0.2, 1.5), 500.0, 320.0, 240.0, place(), V.vec(0.0, 0.0, 0.0), F.lit(0.6), F.lit(0.8), F.lit(-350.0))
    return points(spark, sf_dir).select("pid", r.alias("r")).select("pid", r6("r.d0").alias("d0"), r6("r.d1").alias("d1"))


@query(f"WITH {P} SELECT pid, true AS in_both, true AS along FROM p")
def two_view_lines(spark, sf_dir):
    """The line of two planes lies in both, its direction too."""
    a, b = F.col("a"), F.col("b")
    x = vectors(spark, sf_dir).select("pid", "a", "b", adjust.two_view_line(a, b, F.lit(0.3), F.lit(-0.2)).alias("l"))
    in_both = (F.abs(V.dot(a, F.col("l.point")) + 0.3) < 1e-6) & (F.abs(V.dot(b, F.col("l.point")) - 0.2) < 1e-6)
    along = (F.abs(V.dot(a, F.col("l.direction"))) < 1e-9) & (F.abs(V.dot(b, F.col("l.direction"))) < 1e-9)
    return x.select("pid", in_both.alias("in_both"), along.alias("along"))


@query(f"WITH {P}, k AS (SELECT pid, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM p) SELECT pid, degrees(acos(least(1, abs(nx)/l))) <= 60 AND greatest(0.05, sqrt(power(0.05+ny,2)+nz*nz)) <= 0.15 AS same FROM k")
def lines_in_space(spark, sf_dir):
    p = V.vec(0.0, 0.0, 0.0)
    q = V.vec(F.lit(0.0), F.lit(0.05), F.lit(0.0))
    s = adjust.same_line_3d(p, V.vec(1.0, 0.0, 0.0), q, V.add(q, F.col("b")), 60.0, 0.15)
    return vectors(spark, sf_dir).select("pid", s.alias("same"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey % 4 > 0 THEN 'keep' WHEN o_custkey % 4 >= 2 AND o_custkey % 5 >= 2 THEN 'marginalise' ELSE 'drop' END AS route FROM orders")
def point_routes(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("inliers"), (F.col("o_custkey") % 5).alias("seen"), (F.col("o_orderstatus") == "O").alias("host_stays"))
    return adjust.routed(o).select("o_orderkey", "route")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def points_with_residuals(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select("o_orderkey")
    return adjust.with_residuals(o, t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_IMAGE = "m AS (SELECT event_id % 40 AS i, event_id // 40 % 25 AS j, max(value) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH {_IMAGE}, s AS (SELECT event_id AS key, user_id % 40 + 0.25 AS u, event_id % 25 + 0.5 AS v, value FROM events), c AS (SELECT key, value, u - floor(u) AS fu, v - floor(v) AS fv, floor(u) + a AS i, floor(v) + b AS j, a, b FROM s, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)),
q AS (SELECT key, value, count(m.v) AS n, sum(m.v * (CASE WHEN a = 1 THEN fu ELSE 1 - fu END) * (CASE WHEN b = 1 THEN fv ELSE 1 - fv END)) AS w, sum(m.v * (2 * a - 1) * (CASE WHEN b = 1 THEN fv ELSE 1 - fv END)) AS gu FROM c LEFT JOIN m ON m.i = c.i AND m.j = c.j GROUP BY key, value)
SELECT key, round(CASE WHEN n = 4 THEN w - 1.1 * value - 2 END, 6) AS r, round(gu, 6) AS gu, CASE WHEN n < 4 THEN 'oob' WHEN abs(w - 1.1 * value - 2) > 200 THEN 'outlier' ELSE 'in' END AS state FROM q""")
def photometric_residuals(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    m = e.groupBy(F.lit(0).alias("img"), (F.col("event_id") % 40).alias("i"), (F.floor(F.col("event_id") / 40) % 25).alias("j")).agg(F.max("value").alias("v"))
    s = e.select(F.col("event_id").alias("key"), F.lit(0).alias("img"), (F.col("user_id") % 40 + 0.25).alias("u"), (F.col("event_id") % 25 + 0.5).alias("v"), "value")
    return adjust.photometric(m, s, 1.1, 2.0, 50.0).select("key", F.round("r", 6).alias("r"), F.round("gu", 6).alias("gu"), "state")


_CORNERS = "t AS (SELECT f.fid, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS byy, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM f JOIN p a ON a.pid = f.v[1] JOIN p b ON b.pid = f.v[2] JOIN p c ON c.pid = f.v[3])"


@query(f"""WITH {P}, {_FACES}, {_CORNERS}, w AS (SELECT unnest([0, 1]) AS view_id), m AS (SELECT fid, view_id, ax, ay, az, bx, byy, bz, cx, cy, cz, (ax+bx+cx)/3 AS mx, (ay+byy+cy)/3 AS my, (az+bz+cz)/3 AS mz, 0.2 * view_id AS s FROM t, w),
n AS (SELECT *, (byy-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(byy-ay)*(cx-ax) AS nz, -s-mx AS vx, -my AS vy, -1.5-mz AS vz FROM m),
g AS (SELECT *, degrees(acos(greatest(-1, least(1, (nx*vx+ny*vy+nz*vz)/(sqrt(nx*nx+ny*ny+nz*nz)*sqrt(vx*vx+vy*vy+vz*vz)))))) AS angle, mz+1.5 AS depth FROM n WHERE vx*vx+vy*vy+vz*vz <= 4 AND nx*nx+ny*ny+nz*nz > 0),
i AS (SELECT fid, view_id, depth, floor((500*(mx+s)/depth+320)/8) AS i, floor((500*my/depth+240)/8) AS j FROM g WHERE angle < 75 AND {' AND '.join(f'500*({a}x+s)/({a}z+1.5)+320 BETWEEN 0 AND 639 AND 500*{b}/({a}z+1.5)+240 BETWEEN 0 AND 479' for a, b in (('a', 'ay'), ('b', 'byy'), ('c', 'cy')))})
SELECT fid, view_id FROM (SELECT *, min(depth) OVER (PARTITION BY view_id, i, j) AS front FROM i) WHERE depth <= 1.01 * front""")
def views_of_faces(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    eye = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    views = spark.range(2).select(F.col("id").cast("int").alias("view_id"), eye.alias("r"), V.vec(F.col("id") * 0.2, F.lit(0.0), F.lit(1.5)).alias("t"), F.lit(500.0).alias("f"), F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"))
    return adjust.views_of_faces(v, f, views, 2.0, 640, 480).select("fid", "view_id")


@query(f"""WITH {_FACES}, {_GOOD}, {_EDGES}, e AS (SELECT DISTINCT fid, fid % 3 AS l, least(a, b) AS a, greatest(a, b) AS b FROM d WHERE fid % 3 < 2), s AS (SELECT DISTINCT p.a, p.b FROM e p JOIN e q ON p.a = q.a AND p.b = q.b AND p.l <> q.l) SELECT a AS vid, b AS other FROM s UNION ALL SELECT b, a FROM s""")
def seams_between_labels(spark, sf_dir):
    v, f = _good(spark, sf_dir)
    return adjust.seam_edges_of_labels(f, f.select("fid", (F.col("fid") % 3).alias("label")), v, 0, 1)


_PROJECTIONS = "r AS (SELECT user_id AS vid, event_id % 5 AS patch, event_id AS fid, value AS u FROM events)"


@query(f"WITH {_PROJECTIONS}, m AS (SELECT vid, patch, arg_min(u, fid) AS u, count(DISTINCT fid) AS faces FROM r GROUP BY 1, 2) SELECT a.vid AS a, b.vid AS b, a.patch, a.u AS ua, b.u AS ub, a.faces FROM m a JOIN m b ON b.vid = a.vid + 1 AND a.patch = b.patch")
def projected_edges(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("user_id").alias("vid"), (F.col("event_id") % 5).alias("patch"), F.col("value").alias("u"), F.lit(0.0).alias("v"), F.array("event_id").alias("faces"))
    m = adjust.merged_projections(e)
    edges = m.select(F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"))
    x = adjust.edge_projections(m, edges).join(m.select(F.col("vid").alias("a"), "patch", F.size("faces").cast("long").alias("faces")), ["a", "patch"])
    return x.select("a", "b", "patch", F.col("pa.u").alias("ua"), F.col("pb.u").alias("ub"), "faces")


@query(f"""{_TRI} SELECT pid, power(4, greatest(ceil(log2(0.5*l/0.005)/2), 0))::BIGINT AS parts, {R('0.5*l')} AS area FROM k WHERE l > 0.001""")
def subdivided_faces(spark, sf_dir):
    """Numbers of parts by area, and that the parts' areas add up to it."""
    from skerry.functions.geometry import triangle_area

    x = vectors(spark, sf_dir).select(F.col("pid").alias("fid"), "a", "b", V.vec(0.1, 0.2, 0.3).alias("c")).where(triangle_area(F.col("a"), F.col("b"), F.col("c")) > 0.0005)
    s = adjust.subdivided(x, 0.005)
    return s.groupBy(F.col("fid").alias("pid")).agg(F.count("*").alias("parts"), r6(F.sum(triangle_area(F.col("a"), F.col("b"), F.col("c")))).alias("area"))


# --- formats -------------------------------------------------------------------------------------------------------


@query("SELECT l_suppkey::INT AS col, l_partkey::INT AS row, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2")
def sparse_round_trip(spark, sf_dir):
    from skerry.sources import tables

    m = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("col"), F.col("l_partkey").cast("int").alias("row")).agg(F.sum("l_quantity").alias("value"))
    path = f"{Scratch(spark).root}/sparse"
    tables.write_sparse(m, path)
    return tables.read_sparse(spark, path)


@query(f"WITH {P} SELECT pid, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z, 1.5 AS f FROM p")
def camera_round_trip(spark, sf_dir):
    from skerry.sources import tables

    x = points(spark, sf_dir).select("pid", tables.camera_text(place(), turn(), F.lit(1.5)).alias("text"))
    x = x.select("pid", tables.parsed_camera(F.col("text")).alias("c"))
    return x.select("pid", r6("c.t.x").alias("x"), r6("c.t.y").alias("y"), r6("c.t.z").alias("z"), F.col("c.f").alias("f"))


@query("SELECT n_name AS name, n_nationkey AS r, 2 AS stops, 0.5 AS last FROM nation")
def scale_round_trip(spark, sf_dir):
    from skerry.sources import tables

    stop = lambda pos, r: F.struct(F.lit(pos).alias("pos"), r.cast("int").alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b"))
    n = t(spark, sf_dir, "nation").select(tables.scale_xml(F.col("n_name"), F.array(stop(0.0, F.col("n_nationkey")), stop(0.5, F.lit(1)))).alias("xml"))
    x = n.select(tables.parsed_scale(F.col("xml")).alias("s"))
    return x.select("s.name", F.get("s.stops", F.lit(0)).r.alias("r"), F.size("s.stops").alias("stops"), F.get("s.stops", F.lit(1)).pos.alias("last"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[64]::DOUBLE AS b, 64 AS n FROM embeddings")
def raw_vectors(spark, sf_dir):
    """Vectors as little-endian bytes and back."""
    from skerry.sources import tables

    def packed(batches):
        for pdf in batches:
            yield pdf.assign(embedding=[np.asarray(v, "<f4").tobytes() for v in pdf["embedding"]])

    x = t(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(packed, "vec_id long, embedding binary")
    x = x.select("vec_id", tables.floats_of(F.col("embedding")).alias("v"))
    return x.select("vec_id", F.get("v", F.lit(0)).alias("a"), F.get("v", F.lit(63)).alias("b"), F.size("v").alias("n"))
