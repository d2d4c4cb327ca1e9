import math

import pytest
from pyspark.sql import functions as F

from skerry.functions import camera, colour, distributions, strings
from skerry.functions import geometry as G
from skerry.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_erf_against_math(spark):
    xs = [-6.0, -2.9, -1.0, -1e-3, 0.0, 0.5, 2.99, 3.0, 3.5, 5.0, 30.0]
    got = [r["v"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(distributions.erf(F.col("x")).alias("v")).collect()]
    assert got == pytest.approx([math.erf(x) for x in xs], abs=1e-11)


@pytest.mark.parametrize(("freedom", "x", "want"), [(1, 3.841458820694124, 0.05), (2, 5.991464547107979, 0.05), (5, 11.070497693516351, 0.05), (10, 18.307038053275146, 0.05)])
def test_chi_square_tail(spark, freedom, x, want):
    assert value(spark, distributions.chi_square_tail(F.lit(x), freedom)) == pytest.approx(want, abs=1e-9)


def test_axis_angle_round_trip(spark):
    for v in ((0.3, -0.2, 0.9), (0.0, 0.0, 0.0), (0.0, math.pi, 0.0)):
        r = value(spark, camera.matrix_axis_angle(camera.axis_angle_matrix(V.vec(*v))))
        assert (r["x"], r["y"], r["z"]) == pytest.approx(v, abs=1e-6)


def test_inverse_and_singular(spark):
    m = [2.0, 0.0, 1.0, 0.0, 3.0, 0.0, 1.0, 0.0, 1.0]
    assert value(spark, camera.inverse(F.array(*map(F.lit, m)))) == pytest.approx([1, 0, -1, 0, 1 / 3, 0, -1, 0, 2])
    assert value(spark, camera.inverse(F.array(*[F.lit(1.0)] * 9))) is None


def test_undistort_undoes_distortion(spark):
    x, y, k1, k2 = 0.2, -0.1, 0.08, 0.01
    r2 = x * x + y * y
    d = 1 + k1 * r2 + k2 * r2 * r2
    got = value(spark, camera.undistort(F.lit(x * d), F.lit(y * d), k1, k2))
    assert (got["x"], got["y"]) == pytest.approx((x, y), abs=1e-8)


def test_behind_camera_is_null(spark):
    assert value(spark, camera.project(V.vec(0, 0, -1), 1.0, 1.0, 0.0, 0.0)) is None


def test_depth_points_skip_holes(spark):
    got = value(spark, camera.depth_points(F.array(*map(F.lit, (0, 1000, 2000, 0))), 2, 1.0, 1.0, 0.0, 0.0))
    assert [(p["x"], p["y"], p["z"]) for p in got] == [(1.0, 0.0, 1.0), (0.0, 2.0, 2.0)]


def test_degenerate_geometry_gives_null(spark):
    s = G.segment(*map(F.lit, (1.0, 1.0, 1.0, 1.0)))
    assert value(spark, G.line_distance(s, F.lit(0.0), F.lit(0.0))) is None
    assert value(spark, V.normalize(V.vec(0, 0, 0))) is None
    assert value(spark, G.plane_through(V.vec(0, 0, 0), V.vec(1, 1, 1), V.vec(2, 2, 2))) is None


def test_ray_hits_triangle(spark):
    tri = V.vec(0, 0, 5), V.vec(2, 0, 5), V.vec(0, 2, 5)
    assert value(spark, G.ray_triangle(V.vec(0.2, 0.2, 0), V.vec(0, 0, 1), *tri)) == pytest.approx(5.0)
    assert value(spark, G.ray_triangle(V.vec(3, 3, 0), V.vec(0, 0, 1), *tri)) is None


def test_point_triangle_distance(spark):
    tri = V.vec(0, 0, 0), V.vec(1, 0, 0), V.vec(0, 1, 0)
    assert value(spark, G.point_triangle_distance2(V.vec(0.2, 0.2, 2), *tri)) == pytest.approx(4.0)
    assert value(spark, G.point_triangle_distance2(V.vec(-3, 0, 0), *tri)) == pytest.approx(9.0)


def test_colour_ramp_and_ranges(spark):
    stops = [(0.0, (0, 0, 0)), (0.5, (100, 0, 0)), (1.0, (100, 200, 0))]
    got = value(spark, colour.ramp(F.lit(0.75), stops))
    assert (got["r"], got["g"], got["b"]) == (100, 100, 0)
    assert value(spark, colour.normalised(F.lit(5.0), 0.0, 4.0)) == -1.0
    assert value(spark, colour.normalised(F.lit(-2.0), -4.0, 4.0, symmetric=True)) == 0.25


def test_strings(spark):
    assert value(spark, strings.split_compress(F.lit(",a;;b,"), ",;")) == ["a", "b"]
    assert value(spark, strings.base_name(F.lit("/x/y.tar.gz"))) == "y.tar"
    assert value(spark, strings.find(F.lit("abc"), F.lit(""))) == -1
    assert [value(spark, strings.ordinal(F.lit(n))) for n in (1, 2, 3, 4, 11, 12, 21, 113)] == ["1st", "2nd", "3rd", "4th", "11th", "12th", "21st", "113th"]
    assert value(spark, strings.index_of(F.array(F.lit("a"), F.lit("b")), F.lit("z"))) == -1
