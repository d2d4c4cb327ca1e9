"""Cases that once went wrong."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skerry.functions import distributions, strings
from skerry.functions import geometry as G
from skerry.operators import fields, graph, mesh, sets, windows
from skerry.plans.iterate import numbered


def test_labels_of_neighbours_of_one_parity_settle(spark):
    costs = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.3), (2, 0, 0.3), (2, 1, 0.0)], "id long, label int, cost double")
    edges = spark.createDataFrame([(0, 2)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.potts(costs, edges, 1.0).collect()}
    assert got[0] == got[2]
    with pytest.raises(RuntimeError):
        graph.potts(costs, edges, 1.0, rounds=0)


def test_order_statistics_with_infinite_values(spark):
    of = lambda *v: spark.createDataFrame([(float(x),) for x in v], "v double")
    inf = math.inf
    assert [fields.kth(of(1, 2, inf, -inf, 5), "v", k) for k in range(5)] == [-inf, 1.0, 2.0, 5.0, inf]
    assert fields.kth(of(-1.7e308, 1.7e308, 3.0), "v", 1) == 3.0 and fields.kth(of(inf, inf), "v", 1) == inf
    assert fields.kth(of(5e-324, 0.0, 5e-324), "v", 1) == 5e-324


def test_small_tails_keep_their_digits(spark):
    r = spark.range(1).select(distributions.erfc(F.lit(8.0)).alias("a"), distributions.erfc(F.lit(-8.0)).alias("b"), distributions.erfc(F.lit(0.0)).alias("c")).first()
    assert r["a"] == pytest.approx(math.erfc(8.0), rel=1e-9) and r["b"] == 2.0 and r["c"] == 1.0


def test_numbers_run_over_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("m"))
    got = numbered(df, ["m", "k"], "place").collect()
    assert [(r["m"], r["k"]) for r in sorted(got, key=lambda r: r["place"])] == sorted((r["m"], r["k"]) for r in got)
    assert sorted(r["place"] for r in got) == list(range(1000))
    assert numbered(df.where("false"), ["k"], "place").count() == 0


def test_exposures_of_several_captures(spark):
    rows = [(1, 0, 2.0), (1, 1, 0.0), (1, 2, 0.0), (1, 3, 4.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 3.0), (3, 0, 0.0), (3, 1, 6.0)]
    df = spark.createDataFrame([(c, i, float(i), e) for c, i, e in rows], "c int, id int, ts double, exposure double")
    got = {(r["c"], r["id"]): r["exposure"] for r in windows.exposure_filled(df, "c").collect()}
    assert [got[1, k] for k in range(4)] == [2.0, 2.0, 3.0, 4.0]
    assert [got[2, k] for k in range(3)] == [0.0, 0.0, 0.0] and [got[3, k] for k in range(2)] == [6.0, 6.0]


def test_segments_once_whichever_end_comes_first(spark):
    df = spark.createDataFrame([(1, 5, 0, 0, 1, 1), (1, 6, 1, 1, 0, 0), (2, 7, 0, 0, 1, 1)], "layout_id int, line_id int, x1 int, y1 int, x2 int, y2 int")
    assert sorted(r["line_id"] for r in sets.distinct_segments(df).collect()) == [5, 7]


def test_ply_refuses_ids_that_do_not_fit(spark, tmp_path):
    from skerry.sources import ply

    ply.register(spark)
    df = spark.createDataFrame([(1 << 31, 0.0)], "pid long, x double")
    with pytest.raises(Exception, match="32 bits"):
        df.write.format("ply").mode("append").save(str(tmp_path / "a.ply"))


def test_numbers_are_printed_as_c_prints_them(spark):
    values = [0.0, -0.0, -0.0001, 0.0005, 0.0015, 0.0625, 0.1875, -0.0625, 2.0005, 0.9996, 999.9995, 0.9995, 123456789.0625, 4503599627370495.5, 1e15, 1e16, 123456789012345678.0, 4.35e-320, 560.21 / 3, math.inf, -math.inf, math.nan]
    values += [k / 16 for k in range(-40, 40)] + [k / 2000 for k in range(-1000, 1000)]
    x = spark.createDataFrame(list(enumerate(values)) + [(-1, None)], "k long, v double").select("k", strings.fixed(F.col("v")).alias("t"), strings.equation(F.col("v"), F.lit(1.0), -F.col("v")).alias("e"))
    got = {r["k"]: (r["t"], r["e"]) for r in x.collect()}
    assert got.pop(-1) == (None, None)
    assert {k: t for k, (t, _) in got.items()} == {k: f"{v:.3f}" for k, v in enumerate(values)}
    assert got[0][1] == "0.000 * x + 1.000 * y + -0.000 = 0"


@pytest.mark.parametrize("smooth", [0.7, -0.7])
def test_labels_of_a_crowd_settle_in_few_rounds(spark, smooth):
    """All are neighbours of all: one node a round would take as many rounds as nodes that move."""
    n, rng = 60, random.Random(5)
    cost = [[rng.random() * 3, rng.random() * 3, rng.random() * 2] for _ in range(n)]
    costs = spark.createDataFrame([(i, k, c) for i, row in enumerate(cost) for k, c in enumerate(row)], "id long, label int, cost double")
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)] + [(0, 1), (2, 2)], "a long, b long")
    got = {r["id"]: r["label"] for r in graph.potts(costs, edges, smooth, rounds=12 if smooth > 0 else 100).collect()}
    assert sorted(got) == list(range(n))
    at = lambda i, k: cost[i][k] + smooth * sum(got[j] != k for j in range(n) if j != i)
    assert all(at(i, got[i]) <= min(at(i, k) for k in range(3)) + 1e-9 for i in range(n))
    total = lambda of: sum(cost[i][of[i]] for i in range(n)) + smooth * sum(of[i] != of[j] for i in range(n) for j in range(i))
    assert total(got) <= total([min(range(3), key=row.__getitem__) for row in cost])


@pytest.mark.parametrize("angle, distance, least", [(4.0, 0.03, 4), (25.0, 0.05, 12), (100.0, 0.01, 2)])
def test_segment_clusters_by_brute_force(spark, angle, distance, least):
    rng = random.Random(9)
    rows = [[rng.gauss(0, 0.2) for _ in range(4)] for _ in range(150)] + [[0.1, 0.1, 0.1, 0.1]] + [[rng.gauss(0, 0.2), 3.0 + 0.01 * i, 9.0, 3.0 + 0.01 * i] for i in range(6)]
    pairs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pid long, x1 double, y1 double, x2 double, y2 double")
    side = lambda e: G.segment(*[F.col(f"{e}.{c}") for c in ("x1", "y1", "x2", "y2")])
    m = pairs.alias("a").crossJoin(pairs.alias("b")).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b"), G.segment_measure(side("a"), side("b")).alias("m")).where("a <> b and m.mean is not null")
    near = {(r["a"], r["b"]): r["m"]["mean"] for r in m.collect() if r["m"]["angle"] <= angle and r["m"]["mean"] <= distance}
    of = {i: [b for (a, b) in near if a == i] for i in range(len(rows))}
    core = {i for i in of if len(of[i]) + 1 >= least}
    label = {i: i for i in core}
    while any(label[j] < label[i] for i in core for j in of[i] if j in core):
        label = {i: min([label[i]] + [label[j] for j in of[i] if j in core]) for i in core}
    want = {}
    for i in of:
        to = [j for j in of[i] if j in core]
        want[i] = label[i] if i in core else label[min(to, key=lambda j: (near[i, j], j))] if to else -1
    odd = spark.createDataFrame([(900, None, 0.0, 1.0, 1.0), (901, math.nan, 0.0, 1.0, 1.0), (902, math.inf, 0.0, 1.0, 1.0)], pairs.schema)
    got = {r["pid"]: r["cluster"] for r in graph.dbscan_segments(pairs.union(odd), angle, distance, least).collect()}
    assert got == want | {900: -1, 901: -1, 902: -1}


def test_few_segments_are_candidates_of_each_other(spark):
    x = spark.range(1000).select(F.col("id").alias("pid"), *[F.rand(k).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))])
    assert graph._segment_candidates(x, 3.0, 0.02)[0].count() < 0.03 * 1000 * 1000


def test_mesh_distance_takes_few_faces_a_point_and_the_nearest(spark):
    rng = random.Random(3)
    at = [[rng.gauss(0, 0.1) for _ in range(3)] for _ in range(400)]
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(at)], "vid long, x double, y double, z double")
    near = lambda i: sorted(sorted(range(400), key=lambda j: (math.dist(at[i], at[j]), j))[1:3])
    f = spark.createDataFrame([(i, [i, *near(i)]) for i in range(0, 400, 2)] + [(999, [0, 1, 2]), (1000, [0, 1, 7777])], "fid long, v array<long>")
    p = spark.createDataFrame([(i, *[c + rng.choice([0.0, 0.02, 0.4]) for c in q]) for i, q in enumerate(at)] + [(500, None, 0.0, 0.0)], "pid long, x double, y double, z double")
    t = mesh.with_points(v, f).where("a is not null and b is not null and c is not null")
    d2 = G.point_triangle_distance2(F.struct("x", "y", "z"), F.col("a"), F.col("b"), F.col("c"))
    want = p.crossJoin(t).groupBy("pid").agg(F.min(F.struct(d2.alias("d2"), "fid")).alias("m")).select("pid", "m.fid", F.sqrt("m.d2").alias("distance")).where("distance <= 0.05")
    want = {r["pid"]: (r["fid"], r["distance"]) for r in want.collect()}
    got = mesh.mesh_distance(p, v, f, 0.1, 0.05).collect()
    assert len(got) == len(want) and {r["pid"]: (r["fid"], r["distance"]) for r in got} == want
    boxes = t.select("*", *[g(*[F.col(f"{e}.{c}") for e in "abc"]).alias(f"{n}_{c}") for c in "xyz" for g, n in ((F.least, "low"), (F.greatest, "high"))])
    assert mesh._near_faces(p, boxes, 0.1, 0.005).count() < 0.2 * p.count() * t.count()
