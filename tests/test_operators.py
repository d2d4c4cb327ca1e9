"""Small cases by hand and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators import aggregates, fields, filters, fitting, graph, images, mesh, records, sets, spatial, windows
from skerry.plans import catalog, catalog_models


def cloud(spark, pts):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "pid long, x double, y double, z double")


@pytest.fixture(scope="module")
def pts():
    return np.random.default_rng(3).random((120, 3))


def distances(p):
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def test_grid_with_outlier(spark):
    grid = [*itertools.product(range(3), repeat=3), (50, 50, 50)]
    kept = filters.statistical_outliers(cloud(spark, grid), 5).where("not kept").select("pid").collect()
    assert [r["pid"] for r in kept] == [27]


def test_knn_matches_brute_force(spark, pts):
    d = distances(pts)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(pts)) for j in np.lexsort((np.arange(len(pts)), d[i]))[:6]}
    got = {(r["a"], r["b"]) for r in spatial.knn_join(cloud(spark, pts), cloud(spark, pts), 6, size=0.02).select(F.col("a.pid").alias("a"), F.col("b.pid").alias("b")).collect()}
    assert got == want


def test_nearest_of_empty_and_limited(spark, pts):
    p = cloud(spark, pts)
    assert spatial.knn_join(p, p.where("false"), 2).count() == 0
    far = spatial.nearest(p, cloud(spark, [(100, 100, 100)]), max_distance=5.0).collect()
    assert len(far) == len(pts) and all(r["distance"] == 5.0 and r["nearest_pid"] is None for r in far)


def test_thinned_is_greedy_by_id(spark, pts):
    d, kept = distances(pts), []
    for i in range(len(pts)):
        if all(d[i, j] >= 0.2 for j in kept):
            kept.append(i)
    assert sorted(r["pid"] for r in filters.thinned(cloud(spark, pts), 0.2).collect()) == kept


def test_morton_round_trip(spark):
    r = spark.range(1).select(spatial.morton_cell(spatial.morton(F.lit(2097151), F.lit(0), F.lit(1234567))).alias("c")).first()["c"]
    assert (r["i"], r["j"], r["k"]) == (2097151, 0, 1234567)


def test_fields_skip_invalid(spark):
    nan = float("nan")
    r = fields.statistics(spark.createDataFrame([(1.0,), (2.0,), (nan,), (4.0,), (None,)], "v double"), "v").first()
    assert (r["n"], r["n_valid"], r["low"], r["high"]) == (5, 3, 1.0, 4.0) and r["mean"] == pytest.approx(7 / 3)
    r = fields.statistics(spark.createDataFrame([(nan,)], "v double"), "v").first()
    assert (r["n_valid"], r["mean"], r["low"]) == (0, 0.0, None)
    empty = spark.createDataFrame([], "v double")
    assert fields.histogram(empty, "v").count() == 0 and fields.median(empty, "v") is None


def test_kth_and_median(spark):
    rng = random.Random(1)
    v = [rng.choice((rng.random(), 0.5, -3.0, 1e9)) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert [fields.kth(df, "v", k) for k in (0, 7, 200, 399)] == [sorted(v)[k] for k in (0, 7, 200, 399)]
    assert fields.kth(df, "v", 400) is None
    assert fields.median(df, "v") == pytest.approx(float(np.median(v)))


def test_k_means_separates(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 10.0, 10.2, -5.0)], "v double")
    assert fields.k_means_1d(df, "v", 2, skip_negative=True) == pytest.approx([0.1, 10.1])


def test_weibull_recovers(spark):
    v = 3.0 * np.random.default_rng(5).weibull(2.0, 4000)
    shape, size = fields.fit_weibull(spark.createDataFrame([(float(x),) for x in v], "v double"), "v")
    assert shape == pytest.approx(2.0, rel=0.05) and size == pytest.approx(3.0, rel=0.05)


def test_components_and_tracks(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9), (8, 7)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in graph.connected(e, spark.createDataFrame([(20,)], "id long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9, 20: 20}
    m = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 2, 5), (0, 2, 1, 3), (1, 3, 0, 4)], "view_a long, item_a long, view_b long, item_b long")
    t = graph.tracks(m).groupBy("track", "conflict").count().collect()
    assert sorted((r["conflict"], r["count"]) for r in t) == [(False, 3), (True, 3)]


def test_long_chain_components(spark):
    ids = list(range(300))
    random.Random(2).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r["component_id"] for r in graph.connected(e).collect()} == {0}


def test_dbscan_brute_force(spark, pts):
    d = distances(pts)
    core = [(d[i] <= 0.15).sum() >= 4 for i in range(len(pts))]
    label = list(range(len(pts)))
    moved = True
    while moved:
        moved = False
        for i, j in itertools.product(range(len(pts)), repeat=2):
            if core[i] and core[j] and d[i, j] <= 0.15 and label[j] < label[i]:
                label[i], moved = label[j], True
    want = {}
    for i in range(len(pts)):
        near = [j for j in range(len(pts)) if core[j] and d[i, j] <= 0.15]
        want[i] = label[i] if core[i] else label[min(near, key=lambda j: (d[i, j], j))] if near else -1
    assert {r["pid"]: r["cluster"] for r in graph.dbscan(cloud(spark, pts), 0.15, 4).collect()} == want


def test_segment_dbscan(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 0.0), (1, 0.0, 0.2, 10.0, 0.2), (2, 5.0, -5.0, 5.0, 5.0)], "pid long, x1 double, y1 double, x2 double, y2 double")
    assert {r["pid"]: r["cluster"] for r in graph.dbscan_segments(s, 5.0, 0.5, 2).collect()} == {0: 0, 1: 0, 2: -1}


def test_spanning_forest_weight(spark):
    rng = random.Random(4)
    e = [(a, b, rng.random()) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.5]
    got = sum(r["w"] for r in graph.spanning_forest(spark.createDataFrame(e, "a long, b long, w double")).collect())
    root = list(range(12))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = 0.0
    for a, b, w in sorted(e, key=lambda x: x[2]):
        if find(a) != find(b):
            root[find(a)], want = find(b), want + w
    assert got == pytest.approx(want)


def test_search_and_potts(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0)], "a long, b long, w double")
    got = {r["id"]: r["distance"] for r in graph.search(e, spark.createDataFrame([(0,)], "id long"), "w").collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 2.0}
    costs = spark.createDataFrame([(0, 0, 0.0), (0, 1, 1.0), (1, 0, 0.6), (1, 1, 0.5), (2, 0, 0.0), (2, 1, 1.0)], "id long, label long, cost double")
    labels = graph.potts(costs, e.select("a", "b"), 0.3)
    assert {r["id"]: r["label"] for r in labels.collect()} == {0: 0, 1: 0, 2: 0}
    assert graph.energy(costs, e.select("a", "b"), labels, 0.3).first()["total"] == pytest.approx(0.6)


def test_conjugate_gradient(spark):
    a = np.array([[4.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, 5.0]])
    m = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(3) for j in range(3)], "i long, j long, v double")
    x = graph.conjugate_gradient(m, spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, v double"), tolerance=1e-10)
    assert [r["v"] for r in x.orderBy("i").collect()] == pytest.approx(np.linalg.solve(a, [1.0, 2.0, 3.0]).tolist())


def tetrahedron(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, [0, 2, 1]), (1, [0, 1, 3]), (2, [0, 3, 2]), (3, [1, 2, 3])], "fid long, v array<long>")
    return v, f


def test_tetrahedron(spark):
    v, f = tetrahedron(spark)
    r = mesh.totals(v, f).first()
    assert r["volume"] == pytest.approx(1 / 6) and r["area"] == pytest.approx(1.5 + math.sqrt(3) / 2)
    e = mesh.edge_classes(f).first()
    assert (e["edges"], e["shared"], e["border"]) == (6, 6, 0)
    assert mesh.adjacency(f).count() == 6
    half = mesh.clipped(v, f, "x", 0.5)
    assert half.groupBy("fid").count().count() == 3


def test_face_identity(spark):
    f = spark.createDataFrame([(0, [0, 1, 2]), (1, [2, 0, 1]), (2, [0, 2, 1]), (3, [0, 0, 1])], "fid long, v array<long>")
    assert sorted(r["fid"] for r in mesh.distinct_faces(mesh.without_degenerate(f)).collect()) == [0, 2]
    assert [r["fid"] for r in filters.keep_largest_id(mesh.without_degenerate(f)).collect()] == [2]


def test_fits(spark):
    rng = np.random.default_rng(8)
    xy = rng.random((200, 2))
    plane = cloud(spark, np.column_stack([xy, 0.5 * xy[:, 0] - 0.25 * xy[:, 1] + 1.0]))
    p = fitting.group_planes(plane.withColumn("g", F.lit(1)), "g").first()
    assert p["rms"] == pytest.approx(0, abs=1e-6) and abs(p["nx"] / p["nz"]) == pytest.approx(0.5)
    d = rng.standard_normal((300, 3))
    c, r = fitting.sphere(cloud(spark, d / np.linalg.norm(d, axis=1)[:, None] * 2.0 + [1, 2, 3]))
    assert list(c) == pytest.approx([1, 2, 3]) and r == pytest.approx(2.0)
    noisy = np.vstack([np.column_stack([xy, np.full(200, 0.3)]), rng.random((80, 3)) * 5])
    assert fitting.ransac_plane(cloud(spark, noisy), 0.01)["inliers"] >= 200
    q = fitting.quadric(cloud(spark, np.column_stack([xy, xy[:, 0] ** 2 + 2 * xy[:, 1]])).withColumn("g", F.lit(1)), "g").first()
    assert [q[f"c{k}"] for k in range(6)] == pytest.approx([0, 0, 2, 1, 0, 0], abs=1e-6)


def test_icp_recovers_motion(spark, pts):
    a = 0.03
    r = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    target = cloud(spark, pts)
    turn, _, rms = fitting.icp(fitting.moved(target, r, np.array([0.005, 0.0, -0.005])), target, rounds=15)
    assert rms < 0.01 and np.allclose(turn @ r, np.eye(3), atol=0.02)


def test_windows(spark):
    f = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 0.0), (2, 2.0, 3.0), (3, 3.0, 0.0)], "id long, ts double, exposure double")
    assert [r["exposure"] for r in windows.exposure_filled(f).orderBy("id").collect()] == [1.0, 2.0, 3.0, 3.0]
    dark = f.withColumn("exposure", F.lit(0.0))
    assert {r["exposure"] for r in windows.exposure_filled(dark).collect()} == {0.0}
    sq = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 4.0, 0.0), (1, 2, 4.0, 4.0)], "k long, o long, x double, y double")
    assert windows.path_length(sq, "k", ["o"], "x", "y", closed=True).first()["length"] == pytest.approx(8 + math.sqrt(32))
    assert [r["at"] for r in windows.resampled(sq, "k", ["o"], "x", "y", 3.0).orderBy("at").collect()] == [0.0, 3.0, 6.0]
    hull = windows.convex_hull(spark.createDataFrame([(1, float(x), float(y)) for x in range(4) for y in range(4)], "k long, x double, y double"), "k")
    assert {(r["x"], r["y"]) for r in hull.collect()} == {(0, 0), (3, 0), (3, 3), (0, 3)}


def test_tsdf_weights(spark):
    a = spark.createDataFrame([(1, 0, 1.0, 1.0), (1, 1, 3.0, 2.0)], "v long, o long, t double, w double")
    run = lambda w: aggregates.tsdf_fold(a, ["v"], "o", "t", "w", as_written=w).first()["tsdf"]
    assert run(False) == pytest.approx(7 / 3) and run(True) == pytest.approx(4 / 3)


def test_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "c int")
    b = spark.createDataFrame([(1,), (3,)], "c int")
    assert sorted((r["c"], r["side"]) for r in sets.symmetric_difference(a, b, ["c"], multiset=True).collect()) == [(1, "a"), (2, "a"), (3, "b")]
    with pytest.raises(ValueError, match="column"):
        sets.with_columns_checked(a, "c", F.lit(1))
    v, f = tetrahedron(spark)
    vs, fs = sets.append_meshes([v, v], [f, f])
    assert vs.count() == 8 and fs.agg(F.max(F.array_max("v"))).first()[0] == 7


def test_records(spark):
    names = lambda ps: spark.createDataFrame([(p,) for p in ps], "path string")
    order = lambda ps: [r["path"] for r in records.ordered_files(names(ps)).orderBy("id").collect()]
    assert order(["10.png", "2.png", "1.png"]) == ["1.png", "2.png", "10.png"]
    assert order(["a10.png", "a2.png", "a1.png"]) == ["a1.png", "a10.png", "a2.png"]
    a = spark.createDataFrame([(1, 0, [0b1111]), (1, 1, [0])], "k long, item long, descriptor array<long>")
    b = spark.createDataFrame([(1, 5, [0b0111]), (1, 6, [-1])], "k long, item long, descriptor array<long>")
    assert [(r["i"], r["j"], r["distance"]) for r in records.descriptor_matches(a, b, "k").orderBy("i").collect()] == [(0, 5, 1), (1, 5, 3)]


def test_images(spark):
    on = {(0, 0), (0, 1), (5, 5)}
    m = spark.createDataFrame([(0, i, j, 1.0 if (i, j) in on else 0.0) for i in range(7) for j in range(7)], "img long, i long, j long, v double")
    want = {(i, j): min((i - a) ** 2 + (j - b) ** 2 for a, b in on) for i in range(7) for j in range(7)}
    assert {(r["i"], r["j"]): r["d2"] for r in images.squared_distances(m, 6).collect()} == {k: d for k, d in want.items() if d <= 36}
    assert images.image_components(m).groupBy("component").count().count() == 2
    assert images.dilated(m).where("v = 1").count() == 6 + 9


def test_tracks_take_every_match(spark):
    """Union by hand over all rows of lineitem: no observation is left out."""
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").collect()
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for o, p, s, n in rows:
        a, b = sorted((root((o, p)), root((s, n + p))))
        parent[b] = a
    members = {}
    for x in list(parent):
        members.setdefault(root(x), []).append(x)
    want = sorted((k[0] << 32 | k[1], len({v for v, _ in m}) < len(m), len(m)) for k, m in members.items() if len(m) > 1)
    got = catalog_models.tracks(spark, sf).collect()
    assert sorted((r["track"], r["conflict"], r["n"]) for r in got) == want
    assert sum(r["n"] for r in got) == len({(o, p) for o, p, _, _ in rows} | {(s, n + p) for _, p, s, n in rows})


def test_distances_reach_the_whole_image(spark):
    rng = random.Random(8)
    cells = {(i, j) for i in range(30) for j in range(12) if rng.random() < 0.7} | {(i, 0) for i in range(30)}
    on = {(0, 0), min(c for c in cells if c[1] > 8)}
    m = spark.createDataFrame([(0, i, j, int((i, j) in on)) for i, j in cells] + [(1, 3, 3, 0)], "img int, i long, j long, v int")
    got = {(r["img"], r["i"], r["j"]): r["d2"] for r in images.squared_distances(m).collect()}
    assert got == {(0, i, j): min((i - a) ** 2 + (j - b) ** 2 for a, b in on) for i, j in cells} and max(got.values()) > 400
    steps, front = dict.fromkeys(on, 0), on
    while front:
        front = {c for i, j in front for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if c in cells and c not in steps}
        steps |= dict.fromkeys(front, max(steps.values()) + 1)
    got = {(r["i"], r["j"]): r["steps"] for r in images.chamfer_distances(m).collect()}
    assert got == steps and max(steps.values()) > 5


def test_chamfer_query_reaches_all_connected_cells(spark):
    sf = "/root/testdata/sf0.001"
    value = {}
    for u, e, v in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", "value").collect():
        value[u, e % 40] = max(v, value.get((u, e % 40), v))
    steps = front = {c: 0 for c, v in value.items() if v > 250}
    while front:
        front = {c: s + 1 for (i, j), s in front.items() for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)) if c in value and c not in steps}
        steps = steps | front
    assert {(r["i"], r["j"]): r["steps"] for r in catalog_models.raster_chamfer(spark, sf).collect()} == steps and max(steps.values()) > 5


def test_search_query_goes_to_the_end(spark):
    """The last round of the whole search finds nothing nearer: no edge leads out of what it reached, or makes it shorter."""
    sf = "/root/testdata/sf0.001"
    x = {r["pid"]: r for r in catalog.points(spark, sf).collect()}
    edges = [(r["a"], r["b"]) for r in catalog_models._near_edges(spark, sf, 0.08).select("a", "b").collect()]
    near = {k: set() for k in x}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    best = {min(k for k in x if x[k]["label"] == c): None for c in {r["label"] for r in x.values()}}
    best = {k: (0, k) for k in best}
    front = set(best)
    while front:
        step = {}
        for a in front:
            for b in near[a]:
                step[b] = min(step.get(b, (math.inf, 0)), (best[a][0] + 1, best[a][1]))
        front = {b for b, v in step.items() if v < best.get(b, (math.inf, 0))}
        best |= {b: step[b] for b in front}
    assert {r["id"]: (r["distance"], r["seed"]) for r in catalog_models.breadth_first(spark, sf).collect()} == best
