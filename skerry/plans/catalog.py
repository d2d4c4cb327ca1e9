"""Named queries over the driver's tables, each with the SQL that says the same where SQL can.

Stand-ins: points are the first three components of `embeddings`, scalar fields are prices and event values, views are
suppliers, observations are order lines, faces are triples made from event ids, paths are page addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.functions import strings
from skerry.operators import aggregates, fields, filters, sets, spatial, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), e(3).alias("nx"), e(4).alias("ny"), e(5).alias("nz"), "label")


P = """p AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
 embedding[4]::DOUBLE AS nx, embedding[5]::DOUBLE AS ny, embedding[6]::DOUBLE AS nz, label FROM embeddings)"""
D2 = "((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))"


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + 0.0


def R(expr: str) -> str:  # noqa: N802
    return f"(round({expr}, 6) + 0.0)"


# --- row selection -------------------------------------------------------------------------------------------------


@query("SELECT event_id, value FROM events WHERE value > 50 AND value < 150")
def band_filter(spark, sf_dir):
    return filters.band(t(spark, sf_dir, "events"), "value", 50.0, 150.0).select("event_id", "value")


@query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE value > 50 AND value < 150)")
def band_complement(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "value")
    return filters.complement(e, filters.band(e, "value", 50.0, 150.0), "event_id").select("event_id")


@query("SELECT c_custkey FROM customer WHERE c_acctbal IS NULL OR c_acctbal < 0 OR c_acctbal > 5000")
def sf_range_outside(spark, sf_dir):
    return t(spark, sf_dir, "customer").where(filters.in_range(F.col("c_acctbal"), 0.0, 5000.0, outside=True)).select("c_custkey")


@query("SELECT event_id, value BETWEEN 100 AND 300 AS visible FROM events")
def visible_flag(spark, sf_dir):
    return filters.visible(t(spark, sf_dir, "events"), "value", 100.0, 300.0).select("event_id", "visible")


@query(f"WITH {P} SELECT pid FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.15 AND z BETWEEN -0.2 AND 0.1")
def box_filter(spark, sf_dir):
    return filters.in_box(points(spark, sf_dir), (-0.1, -0.1, -0.2), (0.1, 0.15, 0.1)).select("pid")


RING = [(-0.2, -0.15), (0.18, -0.2), (0.25, 0.1), (0.02, 0.02), (-0.1, 0.22)]
_SIDES = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(RING, RING[1:] + RING[:1], strict=True))


@query(f"""WITH {P}, s(px, py, qx, qy) AS (VALUES {_SIDES}) SELECT pid FROM p, s
GROUP BY pid, x, y HAVING sum(CASE WHEN (py > y) <> (qy > y) AND x < px + (y - py) * (qx - px) / (qy - py) THEN 1 ELSE 0 END) % 2 = 1""")
def polygon_filter(spark, sf_dir):
    return filters.in_polygon(points(spark, sf_dir), RING).select("pid")


@query("""SELECT o_custkey, count(*) AS group_size, CASE WHEN count(*) < 8 THEN 'removed' WHEN count(*) >= 12 THEN 'structure' ELSE 'objects' END AS route
FROM orders GROUP BY o_custkey""")
def route_by_size(spark, sf_dir):
    return filters.route_by_size(t(spark, sf_dir, "orders").select("o_custkey"), "o_custkey", 8, 12).distinct()


@query(f"""WITH {P}, k AS (SELECT a.pid, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM p a, p b WHERE a.pid <> b.pid),
m AS (SELECT pid, avg(d) AS md FROM k WHERE r <= 5 GROUP BY pid), g AS (SELECT avg(md) + stddev_pop(md) AS lim FROM m)
SELECT pid, {R('md')} AS mean_distance, md <= lim AS kept FROM m, g""")
def stat_outlier_filter(spark, sf_dir):
    return filters.statistical_outliers(points(spark, sf_dir)).select("pid", r6("mean_distance").alias("mean_distance"), "kept")


@query("""WITH m AS (SELECT median(value) AS med FROM events), o AS (SELECT event_id, abs(value - med) AS off FROM events, m), s AS (SELECT median(off) AS mad FROM o)
SELECT event_id FROM o, s WHERE off / (1.4826 * mad + 1e-6) < 1.5""")
def mad_outlier_filter(spark, sf_dir):
    return filters.mad_inliers(t(spark, sf_dir, "events").select("event_id", "value"), "value", 1.5).select("event_id")


@query("""WITH v AS (SELECT * FROM lineitem WHERE l_returnflag = 'R') SELECT l_orderkey, count(*) AS n FROM v GROUP BY l_orderkey HAVING count(*) >= 2""")
def observed_enough(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").alias("ok"))
    return filters.observed_enough(x, "l_orderkey", "ok").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query(f"WITH {P}, c AS (SELECT *, min(z) OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1)) AS low FROM p) SELECT pid, z <= low AS seen FROM c")
def depth_buffer(spark, sf_dir):
    return filters.depth_visible(points(spark, sf_dir), 0.1).select("pid", "seen")


@query()
def greedy_thinning(spark, sf_dir):
    return filters.thinned(points(spark, sf_dir), 0.08).select("pid")


@query()
def plane_noise_filter(spark, sf_dir):
    return filters.plane_noise(points(spark, sf_dir), 0.12, 1.5).select("pid")


# --- spatial joins -------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT a.pid, count(*) AS n FROM p a, p b WHERE {D2} <= 0.05 * 0.05 GROUP BY a.pid")
def radius_join_count(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.radius_join(p, p, 0.05).groupBy(F.col("a.pid").alias("pid")).agg(F.count("*").alias("n"))


@query(f"""WITH {P}, k AS (SELECT a.pid, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS rank FROM p a, p b WHERE a.pid <> b.pid)
SELECT pid, other, {R('d2')} AS d2, rank FROM k WHERE rank <= 4""")
def knn_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.knn_join(p, p, 4).select(F.col("a.pid").alias("pid"), F.col("b.pid").alias("other"), r6("d2").alias("d2"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {P}, k AS (SELECT a.pid, b.pid AS nearest_pid, sqrt({D2}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r
FROM p a, p b WHERE a.label < 5 AND b.label >= 5) SELECT pid, nearest_pid, {R('d')} AS distance FROM k WHERE r = 1""")
def nn_distance(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.nearest(p.where("label < 5"), p.where("label >= 5")).select("pid", "nearest_pid", r6("distance").alias("distance"))


@query(f"WITH {P} SELECT a.pid AS a, b.pid AS b FROM p a, p b WHERE sqrt({D2}) BETWEEN 0.06 AND 0.08")
def annulus_pairs(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.annulus_join(p, p, 0.07, 0.01).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"))


@query(f"WITH {P} SELECT a.pid FROM p a WHERE a.label < 5 AND EXISTS (SELECT 1 FROM p b WHERE b.label >= 5 AND {D2} < 0.06 * 0.06)")
def exists_within(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.exists_within(p.where("label < 5"), p.where("label >= 5"), 0.06).select("pid")


@query(f"WITH {P} SELECT a.pid FROM p a WHERE a.label < 5 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label >= 5 AND {D2} < 0.06 * 0.06)")
def none_within(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.none_within(p.where("label < 5"), p.where("label >= 5"), 0.06).select("pid")


@query(f"""WITH {P} SELECT a.pid, count(*) AS n, {R('avg(b.label)')} AS label FROM p a, p b WHERE {D2} <= 0.1 * 0.1 GROUP BY a.pid""")
def attribute_transfer(spark, sf_dir):
    p = points(spark, sf_dir)
    return spatial.transfer(p.select("pid", "x", "y", "z"), p, "label", 0.1).select("pid", "n", r6("label").alias("label"))


@query(f"""WITH {P}, w AS (SELECT a.pid, exp({D2} / -0.0008) AS w, b.nx AS v FROM p a, p b WHERE {D2} <= 0.06 * 0.06)
SELECT pid, {R('sum(w * v) / sum(w)')} AS nx FROM w GROUP BY pid""")
def gaussian_smoothing(spark, sf_dir):
    return spatial.smoothed(points(spark, sf_dir), "nx", 0.02).select("pid", r6("nx").alias("nx"))


@query(f"""WITH {P}, g AS (SELECT a.pid, avg((b.nx-a.nx)*(b.x-a.x)/{D2}) AS gx, avg((b.nx-a.nx)*(b.y-a.y)/{D2}) AS gy, avg((b.nx-a.nx)*(b.z-a.z)/{D2}) AS gz
FROM p a, p b WHERE {D2} <= 0.1 * 0.1 AND {D2} > 0 GROUP BY a.pid) SELECT pid, {R('sqrt(gx*gx+gy*gy+gz*gz)')} AS gradient FROM g""")
def gradient_norm(spark, sf_dir):
    return spatial.gradient_norm(points(spark, sf_dir), "nx", 0.1).select("pid", r6("gradient").alias("gradient"))


@query(f"""WITH {P}, q AS (SELECT *, (x*1 + y*2 + z*2)/3 AS u FROM p) SELECT pid FROM q WHERE x*x + y*y + z*z - u*u <= 0.01 AND u BETWEEN 0 AND 0.2""")
def cylinder_query(spark, sf_dir):
    return spatial.cylinder(points(spark, sf_dir), (0, 0, 0), (1, 2, 2), 0.1, 0.2, positive_only=True).select("pid")


@query(f"WITH {P}, k AS (SELECT a.pid, a.nx - b.nx AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, b.pid) AS r FROM p a, p b WHERE a.label < 5 AND b.label >= 5) SELECT pid, {R('d')} AS diff FROM k WHERE r = 1")
def field_difference(spark, sf_dir):
    p = points(spark, sf_dir)
    x = spatial.knn_join(p.where("label < 5"), p.where("label >= 5"), 1, include_self=True)
    return x.select(F.col("a.pid").alias("pid"), r6(F.col("a.nx") - F.col("b.nx")).alias("diff"))


_EVENTS = "q AS (SELECT user_id, event_id, epoch(ts) AS at FROM events WHERE event_type <> 'click'), s AS (SELECT user_id, epoch(ts) AS at, value FROM events WHERE event_type = 'click')"


def _asof(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("at", micros("ts") / 1e6)
    q = e.where("event_type <> 'click'").select("user_id", "event_id", "at")
    return q, e.where("event_type = 'click'").select("user_id", "at", "value")


@query(f"""WITH {_EVENTS} SELECT q.event_id, {R('max(s.at) FILTER (WHERE s.at <= q.at)')} AS at0, {R('min(s.at) FILTER (WHERE s.at >= q.at)')} AS at1 FROM q LEFT JOIN s USING (user_id)
GROUP BY q.event_id""")
def asof_bracket(spark, sf_dir):
    q, s = _asof(spark, sf_dir)
    return spatial.asof_bracket(q, s, "user_id", "at", "value").select("event_id", r6("at0").alias("at0"), r6("at1").alias("at1"))


@query(f"""WITH {_EVENTS}, b AS (SELECT q.event_id, q.at, max(s.at) FILTER (WHERE s.at <= q.at) AS a0, min(s.at) FILTER (WHERE s.at >= q.at) AS a1,
arg_max(s.value, s.at) FILTER (WHERE s.at <= q.at) AS v0, arg_min(s.value, s.at) FILTER (WHERE s.at >= q.at) AS v1 FROM q LEFT JOIN s USING (user_id) GROUP BY q.event_id, q.at)
SELECT event_id, round(v0 + (v1 - v0) * CASE WHEN a1 = a0 THEN 0 ELSE (b.at - a0) / (a1 - a0) END, 4) AS v FROM b""")
def asof_lerp(spark, sf_dir):
    q, s = _asof(spark, sf_dir)
    return spatial.asof_lerp(q, s, "user_id", "at", "value").select("event_id", F.round("v", 4).alias("v"))


@query("""WITH c AS (SELECT p_partkey, p_size::BIGINT AS i, p_partkey % 1024 AS j, CAST(floor(p_retailprice) AS BIGINT) % 1024 AS k FROM part), b AS (SELECT unnest(range(0, 21))::INT AS n)
SELECT p_partkey, CAST(sum((((i >> n) & 1) << (3 * n)) + (((j >> n) & 1) << (3 * n + 1)) + (((k >> n) & 1) << (3 * n + 2))) AS BIGINT) AS code FROM c, b GROUP BY p_partkey""")
def morton_codes(spark, sf_dir):
    x = t(spark, sf_dir, "part")
    k = F.floor("p_retailprice").cast("long") % 1024
    return x.select("p_partkey", spatial.morton(F.col("p_size"), F.col("p_partkey") % 1024, k).alias("code"))


@query("SELECT p_partkey, p_size::BIGINT AS i, p_partkey % 1024 AS j FROM part")
def morton_decode(spark, sf_dir):
    c = spatial.morton_cell(spatial.morton(F.col("p_size"), F.col("p_partkey") % 1024, F.lit(7)))
    return t(spark, sf_dir, "part").select("p_partkey", c.i.alias("i"), c.j.alias("j"))


# --- aggregates ----------------------------------------------------------------------------------------------------


@query("""SELECT count(*) AS n, count(c_acctbal) AS n_valid, round(avg(c_acctbal), 6) AS mean, round(avg(c_acctbal * c_acctbal), 2) AS mean_square, min(c_acctbal) AS low,
max(c_acctbal) AS high, round(var_pop(c_acctbal), 2) AS variance FROM customer""")
def sf_stats(spark, sf_dir):
    x = fields.statistics(t(spark, sf_dir, "customer"), "c_acctbal")
    return x.select("n", "n_valid", F.round("mean", 6).alias("mean"), F.round("mean_square", 2).alias("mean_square"), "low", "high", F.round("variance", 2).alias("variance"))


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(CAST(floor((value - lo) * 20 / (hi - lo)) AS INT), 19) AS bin FROM events, e)
SELECT CAST(g.bin AS INT) AS bin, count(b.bin) AS n FROM range(20) g(bin) LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin""")
def sf_hist(spark, sf_dir):
    return fields.histogram(t(spark, sf_dir, "events"), "value", 20)


@query("""WITH e AS (SELECT min(value) AS lo, max(value) AS hi, count(*) AS total FROM events), b AS (SELECT CAST(floor((value - lo) / (hi - lo) * 9999) AS BIGINT) AS bin FROM events, e),
c AS (SELECT bin, sum(count(*)) OVER (ORDER BY bin) AS c FROM b GROUP BY bin) SELECT round(lo + min(bin) * (hi - lo) / 9999, 6) AS percentile FROM c, e WHERE c > total * 0.9 GROUP BY lo, hi""")
def sf_percentile_bins(spark, sf_dir):
    return fields.binned_percentile(t(spark, sf_dir, "events"), "value", 0.9).select(F.round("percentile", 6).alias("percentile"))


def one(spark: SparkSession, **values) -> DataFrame:
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


@query("SELECT median(l_extendedprice) AS value FROM lineitem")
def exact_median(spark, sf_dir):
    return one(spark, value=fields.median(t(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query("SELECT min(v) AS value FROM (SELECT o_totalprice AS v FROM orders ORDER BY v DESC LIMIT (SELECT CAST(ceil(count(*) * 0.05) AS BIGINT) FROM orders))")
def rank_from_top(spark, sf_dir):
    return one(spark, value=fields.rank_from_top(t(spark, sf_dir, "orders"), "o_totalprice", 0.05))


@query("SELECT round(1.5 * sqrt(v), 6) AS threshold FROM (SELECT value AS v, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM events) WHERE r = CAST(floor(0.7 * n) AS BIGINT) + 1")
def energy_threshold(spark, sf_dir):
    return one(spark, threshold=round(fields.energy_threshold(t(spark, sf_dir, "events"), "value"), 6))


@query("""WITH f AS (SELECT avg(value) AS m, var_pop(value) AS v FROM events) SELECT round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events, f WHERE abs(value - m) < 1.5 * sqrt(v)""")
def robust_normal_fit(spark, sf_dir):
    return fields.fit_normal(t(spark, sf_dir, "events"), "value", 1.5).select(F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


def _chi() -> str:
    from statistics import NormalDist

    cuts = " + ".join(f"CASE WHEN z > {NormalDist().inv_cdf(j / 8)!r} THEN 1 ELSE 0 END" for j in range(1, 8))
    return f"""WITH f AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events), z AS (SELECT (value - m) / s AS z FROM events, f),
n AS (SELECT {cuts} AS j, count(*) AS n FROM z GROUP BY 1) SELECT round(sum(n * n) * 8.0 / sum(n) - sum(n), 6) AS chi_square, CAST(sum(n) AS BIGINT) AS n FROM n"""


@query(_chi())
def chi_square_normal(spark, sf_dir):
    return fields.chi_square_normal(t(spark, sf_dir, "events"), "value").select(F.round("chi_square", 6).alias("chi_square"), "n")


@query()
def k_means_1d(spark, sf_dir):
    found = fields.k_means_1d(t(spark, sf_dir, "customer"), "c_acctbal", 4)
    return spark.createDataFrame(list(enumerate(found)), "j int, centre double")


@query()
def weibull_fit(spark, sf_dir):
    shape, size = fields.fit_weibull(t(spark, sf_dir, "events"), "value")
    return one(spark, shape=shape, scale=size)


@query(f"WITH {P} SELECT {', '.join(R(f'avg({a})') + f' AS {a}' for a in 'xyz')} FROM p")
def centroid(spark, sf_dir):
    return aggregates.centroid(points(spark, sf_dir)).select(*[r6(a).alias(a) for a in "xyz"])


_PAIRS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


@query(f"WITH {P} SELECT {', '.join(R(f'covar_pop({a}, {b})') + f' AS {a}{b}' for a, b in _PAIRS)} FROM p")
def covariance(spark, sf_dir):
    return aggregates.covariance(points(spark, sf_dir)).select(*[r6(a + b).alias(a + b) for a, b in _PAIRS])


@query(f"WITH {P} SELECT {', '.join(R(f'covar_pop({a}, n{b})') + f' AS {a}{b}' for a in 'xyz' for b in 'xyz')} FROM p")
def cross_covariance(spark, sf_dir):
    p = points(spark, sf_dir)
    q = p.select("pid", *[F.col(f"n{c}").alias(c) for c in "xyz"])
    return aggregates.cross_covariance(p.select("pid", "x", "y", "z"), q).select(*[r6(a + b).alias(a + b) for a in "xyz" for b in "xyz"])


@query(f"""WITH {P} SELECT CAST(floor(x / 0.1) AS BIGINT) AS cx, CAST(floor(y / 0.1) AS BIGINT) AS cy, CAST(floor(z / 0.1) AS BIGINT) AS cz, {R('avg(x)')} AS x, {R('avg(y)')} AS y, {R('avg(z)')} AS z, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def voxel_centroid(spark, sf_dir):
    return aggregates.voxel_centroids(points(spark, sf_dir), 0.1).select("cx", "cy", "cz", *[r6(a).alias(a) for a in "xyz"], "n")


@query(f"""WITH {P}, c AS (SELECT pid, floor(x / 0.1) AS cx, floor(y / 0.1) AS cy, floor(z / 0.1) AS cz, power(x - (floor(x / 0.1) + 0.5) * 0.1, 2) + power(y - (floor(y / 0.1) + 0.5) * 0.1, 2) + power(z - (floor(z / 0.1) + 0.5) * 0.1, 2) AS d FROM p)
SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY cx, cy, cz ORDER BY d, pid) AS r FROM c) WHERE r = 1""")
def voxel_nearest_center(spark, sf_dir):
    return aggregates.voxel_nearest(points(spark, sf_dir), 0.1).select("pid")


@query(f"WITH {P}, c AS (SELECT DISTINCT floor(x / 0.1) AS a, floor(y / 0.1) AS b, floor(z / 0.1) AS c FROM p) SELECT (SELECT count(*) FROM p) AS n, count(*) AS cells, round((SELECT count(*) FROM p) / count(*), 6) AS per_cell FROM c")
def points_per_cell(spark, sf_dir):
    return aggregates.per_cell(points(spark, sf_dir), 0.1).select("n", "cells", F.round("per_cell", 6).alias("per_cell"))


@query("""WITH c AS (SELECT p_size AS i, p_partkey % 64 AS j, (p_partkey * 7) % 64 AS k FROM part), l AS (SELECT unnest([18, 19, 20, 21]) AS level),
g AS (SELECT level, i::BIGINT >> (21 - level)::INT AS a, j::BIGINT >> (21 - level)::INT AS b, k::BIGINT >> (21 - level)::INT AS c, count(*) AS n FROM c, l GROUP BY 1, 2, 3, 4)
SELECT level, count(*) AS cells, max(n) AS most, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM g GROUP BY level""")
def octree_level_rollup(spark, sf_dir):
    x = t(spark, sf_dir, "part").select(F.col("p_size").alias("i"), (F.col("p_partkey") % 64).alias("j"), (F.col("p_partkey") * 7 % 64).alias("k"))
    return aggregates.level_statistics(x, [18, 19, 20, 21]).select("level", "cells", "most", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


_RASTER = "SELECT CAST(floor(x / 0.1 + 0.5) AS BIGINT) AS i, CAST(floor(y / 0.1 + 0.5) AS BIGINT) AS j, count(*) AS n, min(z) AS low, max(z) AS high, avg(z) AS mean, stddev_pop(z) AS deviation FROM p GROUP BY 1, 2"


@query(f"WITH {P}, r AS ({_RASTER}) SELECT i, j, n, {R('low')} AS low, {R('high')} AS high, {R('mean')} AS mean, {R('deviation')} AS deviation FROM r")
def raster_stats(spark, sf_dir):
    return aggregates.raster(points(spark, sf_dir), 0.1).select("i", "j", "n", *[r6(c).alias(c) for c in ("low", "high", "mean", "deviation")])


@query(f"""WITH {P}, r AS ({_RASTER}), e AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, avg(mean) AS fill FROM r),
gi AS (SELECT unnest(range(i0, i1 + 1)) AS i FROM e), gj AS (SELECT unnest(range(j0, j1 + 1)) AS j FROM e)
SELECT gi.i, gj.j, {R('coalesce(mean, fill)')} AS h FROM gi CROSS JOIN gj CROSS JOIN e LEFT JOIN r ON r.i = gi.i AND r.j = gj.j""")
def raster_fill(spark, sf_dir):
    return aggregates.filled_raster(aggregates.raster(points(spark, sf_dir), 0.1), policy="mean").select("i", "j", r6("h").alias("h"))


@query()
def raster_interpolate(spark, sf_dir):
    return aggregates.filled_raster(aggregates.raster(points(spark, sf_dir), 0.1), policy="interpolate").select("i", "j", r6("h").alias("h"))


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def mode_label(spark, sf_dir):
    return aggregates.mode(t(spark, sf_dir, "events"), ["user_id"], "event_type")


@query("""WITH c AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_linenumber) AS r FROM c)
SELECT l_suppkey, coalesce(max(l_linenumber) FILTER (WHERE r = 1), -1) AS first, coalesce(max(l_linenumber) FILTER (WHERE r = 2), -1) AS second FROM r GROUP BY l_suppkey""")
def top2_per_group(spark, sf_dir):
    return aggregates.top_two(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber")


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2 HAVING count(*) >= 3")
def having_pairs(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return aggregates.pairs_with(x, "a", "b", 3)


@query("SELECT l_orderkey, count(l_suppkey) AS n, count(DISTINCT l_suppkey) AS views FROM lineitem GROUP BY 1 HAVING count(l_suppkey) <> count(DISTINCT l_suppkey)")
def conflict_filter(spark, sf_dir):
    return aggregates.conflicted(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def views_by_tracks(spark, sf_dir):
    return aggregates.views_by_tracks(t(spark, sf_dir, "lineitem"), "l_suppkey", 6)


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS price FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice"))
    return aggregates.weighted_mean(x, ["l_suppkey"], "price", "l_quantity").select("l_suppkey", F.round("price", 4).alias("price"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def prefix_rollup(spark, sf_dir):
    return aggregates.cube_rollup(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").withColumn("total", F.round("total", 2))


@query(f"WITH {P} SELECT a.pid, count(*) - 1 AS n FROM p a, p b WHERE {D2} <= 0.1 * 0.1 GROUP BY a.pid")
def neighbour_density(spark, sf_dir):
    return aggregates.neighbour_counts(points(spark, sf_dir), 0.1).select("pid", "n")


@query("""WITH RECURSIVE o AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
f AS (SELECT user_id, r, v::DOUBLE AS t, 1::DOUBLE AS w FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.r, (f.t * f.w + o.v) / (f.w + 1), f.w + 1 FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
SELECT user_id, round(arg_max(t, r), 4) AS tsdf, round(max(w), 4) AS weight FROM f GROUP BY user_id""")
def tsdf_fold(spark, sf_dir):
    x = t(spark, sf_dir, "events").withColumn("w", F.lit(1.0))
    return aggregates.tsdf_fold(x, ["user_id"], "event_id", "value", "w").select("user_id", F.round("tsdf", 4).alias("tsdf"), F.round("weight", 4).alias("weight"))


@query()
def tsdf_scatter(spark, sf_dir):
    return aggregates.scatter_tsdf(points(spark, sf_dir), 0.1, 0.2)


# --- ordered work --------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT event_type, row_number() OVER (ORDER BY n DESC, event_type) - 1 AS new FROM c)
SELECT event_id, new FROM events JOIN r USING (event_type)""")
def relabel_by_freq(spark, sf_dir):
    return windows.relabelled(t(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "new").select("event_id", F.col("new").cast("long").alias("new"))


@query("""WITH s AS (SELECT user_id, abs(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value) AS d FROM events) SELECT user_id, round(coalesce(sum(d), 0), 4) AS length FROM s GROUP BY 1""")
def path_length(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("zero", F.lit(0.0))
    return windows.path_length(e, "user_id", ["ts", "event_id"], "value", "zero").select("user_id", F.round("length", 4).alias("length"))


@query("""WITH l AS (SELECT user_id, event_id, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT event_id, CAST(sum(CASE WHEN d > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM l""")
def gap_split(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("at", micros("ts") / 1e6)
    return windows.split_at_gaps(e, "user_id", ["ts", "event_id"], "at", 3600.0).select("event_id", "part")


@query("""WITH l AS (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(CASE WHEN value > 5 THEN value - 5 ELSE (greatest(a - 5, 0) + greatest(b - 5, 0)) / 2 END, 4) AS exposure FROM l WHERE a IS NOT NULL AND b IS NOT NULL""")
def exposure_gapfill(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("id")
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.greatest(F.col("value") - 5, F.lit(0.0)).alias("exposure"))
    x = windows.exposure_means(e, "user_id").withColumn("inner", F.lag("id").over(w).isNotNull() & F.lead("id").over(w).isNotNull())
    return x.where("inner").select(F.col("id").alias("event_id"), F.round("exposure", 4).alias("exposure"))


@query("SELECT event_id, age FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 7")
def sliding_last7(spark, sf_dir):
    return windows.recent(t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], 7).select("event_id", F.col("age").cast("long").alias("age"))


@query("SELECT s_suppkey, unnest(range(0, 5)) AS k, round(s_acctbal + (1000 - s_acctbal) * unnest(range(0, 5)) / 4.0, 4) AS v FROM supplier")
def even_samples(spark, sf_dir):
    x = t(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(windows.even_samples(F.col("s_acctbal"), F.lit(1000.0), 5)).alias("k", "v"))
    return x.select("s_suppkey", F.col("k").cast("long").alias("k"), F.round("v", 4).alias("v"))


@query()
def path_resample(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("at", micros("ts") / 1e8)
    return windows.resampled(e, "user_id", ["ts", "event_id"], "at", "value", 100.0)


@query()
def convex_hulls(spark, sf_dir):
    return windows.convex_hull(points(spark, sf_dir), "label")


# --- sets ----------------------------------------------------------------------------------------------------------

_CELLS = f"WITH {P}, a AS (SELECT DISTINCT CAST(floor(x / 0.05) AS BIGINT) AS i, CAST(floor(y / 0.05) AS BIGINT) AS j FROM p WHERE label < 5), b AS (SELECT DISTINCT CAST(floor(x / 0.05) AS BIGINT) AS i, CAST(floor(y / 0.05) AS BIGINT) AS j FROM p WHERE label >= 5)"


def _cells(spark, sf_dir):
    p = points(spark, sf_dir).select(F.floor(F.col("x") / 0.05).alias("i"), F.floor(F.col("y") / 0.05).alias("j"), "label")
    return p.where("label < 5"), p.where("label >= 5")


@query(f"{_CELLS} SELECT * FROM a EXCEPT SELECT * FROM b")
def cells_only_in_a(spark, sf_dir):
    return sets.only_in_first(*_cells(spark, sf_dir), ["i", "j"])


@query(f"{_CELLS} SELECT i, j, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT i, j, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def cells_sym_diff(spark, sf_dir):
    return sets.symmetric_difference(*_cells(spark, sf_dir), ["i", "j"])


@query(f"{_CELLS} SELECT (SELECT count(*) FROM a) AS in_a, (SELECT count(*) FROM b) AS in_b, (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b")
def cell_counts(spark, sf_dir):
    return sets.compare_counts(*_cells(spark, sf_dir), ["i", "j"])


@query("SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'none' FROM supplier")
def append_reconcile(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return sets.append(a, b, {"segment": "none"})


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey")
def unordered_pair_dedupe(spark, sf_dir):
    return sets.distinct_pairs(t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), "a", "b")


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT x.l_orderkey, x.l_suppkey AS a, y.l_suppkey AS b FROM s x JOIN s y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey""")
def pairs_in_lists(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return sets.all_pairs_in_lists(x, "l_orderkey", "s")


# --- text ----------------------------------------------------------------------------------------------------------


@query(r"""SELECT page_id, list_extract(string_split(url, '/'), -1) AS file_name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent,
regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^.]*$', '') AS base, CASE WHEN url LIKE '%/' THEN url ELSE url || '/' END AS slashed FROM pages""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select("page_id", strings.file_name(u).alias("file_name"), strings.parent(u).alias("parent"), strings.base_name(u).alias("base"), strings.with_slash(u).alias("slashed"))


@query(r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[/?&=.:]+'), lambda x: x <> ''), '|') AS parts FROM pages")
def split_compress(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.array_join(strings.split_compress(F.col("url"), "/?&=.:"), "|").alias("parts"))


@query(r"""SELECT p_partkey, lower(p_name) AS low, upper(p_brand) AS up, replace(p_type, ' ', '_') AS joined, instr(p_name, 'a') - 1 AS at, regexp_matches(p_name, '^[0-9]') AS digit,
NOT regexp_matches(p_name, '[ \r\t\n]') AS solid, p_size || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS place FROM part""")
def string_functions(spark, sf_dir):
    n = F.col("p_name")
    return t(spark, sf_dir, "part").select(
        "p_partkey", F.lower(n).alias("low"), F.upper("p_brand").alias("up"), F.replace(F.col("p_type"), F.lit(" "), F.lit("_")).alias("joined"), strings.find(n, F.lit("a")).cast("long").alias("at"),
        strings.starts_with_digit(n).alias("digit"), strings.is_solid(n).alias("solid"), strings.ordinal(F.col("p_size")).alias("place"),
    )
