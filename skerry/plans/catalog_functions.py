"""Named queries of single functions and small operators, most over the points in the embeddings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import camera, colour, distributions, strings
from skerry.functions import geometry as G
from skerry.functions import vectors as V
from skerry.operators import aggregates, fields, filters, fitting, graph, images, mesh, records, sets, spatial, windows
from skerry.plans.catalog import D2, P, R, micros, one, points, query, r6, t
from skerry.plans.catalog_models import _EDGES, _FACES, _GOOD, _good, _mesh, _near_edges, _segments



def place():
    return V.vec("x", "y", "z")


def normal():
    return V.vec("nx", "ny", "nz")

_SEG = f"WITH {P}, s AS (SELECT pid, x AS x1, y AS y1, z AS x2, nx AS y2, 0.1 AS u1, ny AS v1, nz AS u2, 0.2 AS v2 FROM p)"


def vectors(spark, sf_dir):
    return points(spark, sf_dir).select("pid", "x", "y", "z", place().alias("a"), normal().alias("b"))


def cells(name: str, c, names: str = "xyz") -> list:
    return [r6(c[k]).alias(f"{name}{k}") for k in names]


def spread(name: str, *exprs: str, names: str = "xyz") -> str:
    return ", ".join(f"{R(e)} AS {name}{k}" for e, k in zip(exprs, names, strict=True))


# --- vectors -------------------------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT pid, {spread('s', 'x-nx', 'y-ny', 'z-nz')}, {spread('m', 'x*nx', 'y*ny', 'z*nz')}, {spread('n', '-x', '-y', '-z')}, {spread('a', 'abs(x)', 'abs(y)', 'abs(z)')} FROM p")
def vector_components(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return vectors(spark, sf_dir).select("pid", *cells("s", V.sub(a, b)), *cells("m", V.mul(a, b)), *cells("n", V.negate(a)), *cells("a", V.abs3(a)))


@query(f"""WITH {P}, s AS (SELECT *, greatest(0, least(1, (x + 0.2) / 0.4)) AS t FROM p) SELECT pid, {R('(x-nx)*(x-nx)+(y-ny)*(y-ny)+(z-nz)*(z-nz)')} AS d2, {R('x+(nx-x)*0.25')} AS l,
{R('t*t*(3-2*t)')} AS s, {R('CASE WHEN x > 0 THEN 1/sqrt(x) END')} AS r, floor(x*10)::BIGINT AS fx, floor(y*10)::BIGINT AS fy, floor(z*10)::BIGINT AS fz FROM s""")
def vector_scalars(spark, sf_dir):
    x, a, b = vectors(spark, sf_dir), F.col("a"), F.col("b")
    f = V.floor3(V.scale(a, 10.0))
    return x.select("pid", r6(V.distance2(a, b)).alias("d2"), r6(V.lerp(a.x, b.x, 0.25)).alias("l"), r6(V.smoothstep(-0.2, 0.2, a.x)).alias("s"), r6(V.rsqrt(a.x)).alias("r"), *[f[c].alias(f"f{c}") for c in "xyz"])


@query(f"""WITH {P} SELECT pid, {spread('p', 'x+nx', 'y+ny', 'z+nz')}, {spread('m', 'x-nx', 'y-ny', 'z-nz')}, {spread('t', 'x*nx', 'y*ny', 'z*nz')}, {spread('d', 'CASE WHEN nx<>0 THEN x/nx END', 'CASE WHEN ny<>0 THEN y/ny END', 'CASE WHEN nz<>0 THEN z/nz END')} FROM p""")
def array_arithmetic(spark, sf_dir):
    x = points(spark, sf_dir).select("pid", F.array("x", "y", "z").alias("a"), F.array("nx", "ny", "nz").alias("b"))
    put = lambda n, op: [r6(F.get(V.array_each(F.col("a"), F.col("b"), op), F.lit(k))).alias(f"{n}{c}") for k, c in enumerate("xyz")]
    return x.select("pid", *put("p", "+"), *put("m", "-"), *put("t", "*"), *put("d", "/"))


@query(f"""WITH {P} SELECT pid, x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1 AS inside,
{R('sqrt(power(greatest(nx-x-0.1, x-nx-0.1, 0),2)+power(greatest(ny-y-0.1, y-ny-0.1, 0),2)+power(greatest(nz-z-0.1, z-nz-0.1, 0),2))')} AS gap FROM p""")
def box_predicates(spark, sf_dir):
    x, a, b = vectors(spark, sf_dir), F.col("a"), F.col("b")
    h = V.vec(0.05, 0.05, 0.05)
    boxes = V.box_distance(V.sub(a, h), V.add(a, h), V.sub(b, h), V.add(b, h))
    return x.select("pid", V.inside_box(a, V.vec(-0.1, -0.1, -0.1), V.vec(0.1, 0.1, 0.1)).alias("inside"), r6(boxes).alias("gap"))


# --- planar and spatial geometry -----------------------------------------------------------------------------------


@query(f"""{_SEG}, l AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS n, sqrt((u2-u1)*(u2-u1)+(v2-v1)*(v2-v1)) AS m FROM s)
SELECT pid, {R('n')} AS n, {R('abs((x2-x1)*(y1-v1)-(x1-u1)*(y2-y1))/n')} AS d0, {R('abs((x2-x1)*(y1-v2)-(x1-u2)*(y2-y1))/n')} AS d1,
{R('abs((u2-u1)*(v1-y1)-(u1-x1)*(v2-v1))/m')} AS d2, {R('abs((u2-u1)*(v1-y2)-(u1-x2)*(v2-v1))/m')} AS d3, {R('degrees(acos(least(1,abs((x2-x1)*(u2-u1)+(y2-y1)*(v2-v1))/(n*m))))')} AS angle FROM l""")
def segment_ends(spark, sf_dir):
    s, q = F.col("s"), F.col("q")
    d = G.end_distances(s, q)
    return _segments(spark, sf_dir).select("pid", r6(G.segment_length(s)).alias("n"), *[r6(c).alias(f"d{k}") for k, c in enumerate(d)], r6(G.folded_angle(s, q)).alias("angle"))


@query(f"""{_SEG}, k AS (SELECT *, greatest(0, least(1, ((u1-x1)*(x2-x1)+(v1-y1)*(y2-y1))/((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t FROM s)
SELECT pid, {R('power(u1-x1-t*(x2-x1),2)+power(v1-y1-t*(y2-y1),2)')} AS d2, {R('greatest(least(greatest(x1,x2),greatest(u1,u2))-greatest(least(x1,x2),least(u1,u2)),0)/least(abs(x2-x1),abs(u2-u1))')} AS overlap FROM k""")
def point_segment(spark, sf_dir):
    s, q = F.col("s"), F.col("q")
    return _segments(spark, sf_dir).select("pid", r6(G.point_segment_distance2(s, q.x1, q.y1)).alias("d2"), r6(G.overlap_ratio(s.x1, s.x2, q.x1, q.x2)).alias("overlap"))


_TRI = f"""WITH {P}, c AS (SELECT pid, x, y, z, nx, ny, nz, (ny-y)*(0.3-z)-(nz-z)*(0.2-y) AS cx, (nz-z)*(0.1-x)-(nx-x)*(0.3-z) AS cy, (nx-x)*(0.2-y)-(ny-y)*(0.1-x) AS cz FROM p),
k AS (SELECT *, sqrt(cx*cx+cy*cy+cz*cz) AS l FROM c)"""


@query(f"""{_TRI} SELECT pid, {R('0.5*l')} AS area, {R('(x*(ny*0.3-nz*0.2)+y*(nz*0.1-nx*0.3)+z*(nx*0.2-ny*0.1))/6')} AS volume, {spread('n', 'cx/l', 'cy/l', 'cz/l')}, {R('-(cx*x+cy*y+cz*z)/l')} AS d,
{R('(cx*0.5+cy*0.4+cz*0.6-(cx*x+cy*y+cz*z))/l')} AS off FROM k WHERE l > 0.001""")
def plane_of_triangle(spark, sf_dir):
    a, b, c = F.col("a"), F.col("b"), V.vec(0.1, 0.2, 0.3)
    x = vectors(spark, sf_dir).where(G.triangle_area(a, b, c) > 0.0005).withColumn("f", G.plane_through(a, b, c))
    off = G.plane_distance(V.vec(0.5, 0.4, 0.6), F.col("f.n"), F.col("f.d"))
    return x.select("pid", r6(G.triangle_area(a, b, c)).alias("area"), r6(G.signed_volume(a, b, c)).alias("volume"), *cells("n", F.col("f.n")), r6("f.d").alias("d"), r6(off).alias("off"))


@query(f"""WITH {P} SELECT pid, {R('CASE WHEN abs(nz) > 1e-12 AND (0.3-z)/nz >= 0 THEN (0.3-z)/nz END')} AS t FROM p WHERE abs(nz) > 0.001""")
def ray_to_plane(spark, sf_dir):
    x = vectors(spark, sf_dir).where(F.abs("b.z") > 0.001)
    return x.select("pid", r6(G.ray_plane(F.col("a"), F.col("b"), V.vec(0.0, 0.0, 1.0), F.lit(-0.3))).alias("t"))


@query(f"""WITH {P}, h AS (SELECT pid, (0.25-z) AS t, x+(0.25-z)*nx*0.1 AS u, y+(0.25-z)*ny*0.1 AS v FROM p), b AS (SELECT *, (u+0.5)/1.0 AS e, (v+0.5)/1.0 AS f FROM h)
SELECT pid, {R('CASE WHEN e>=0 AND f>=0 AND e+f<=1 AND t>0 THEN t END')} AS t FROM b WHERE abs(e+f-1) > 1e-9""")
def ray_to_triangle(spark, sf_dir):
    corners = [V.vec(*c) for c in ((-0.5, -0.5, 0.25), (0.5, -0.5, 0.25), (-0.5, 0.5, 0.25))]
    ray = V.vec(F.col("b.x") * 0.1, F.col("b.y") * 0.1, F.lit(1.0))
    return vectors(spark, sf_dir).select("pid", r6(G.ray_triangle(F.col("a"), ray, *corners)).alias("t"))


@query(f"""WITH {P}, a AS (SELECT pid, nx, ny, nz, x, y, z FROM p) SELECT pid, {spread('n', 'sin(radians(30*x))*sin(radians(300*y))', 'sin(radians(30*x))*cos(radians(300*y))', 'cos(radians(30*x))')},
{spread('u', 'CASE WHEN x*nx+y*ny+z*nz < 0 THEN -x ELSE x END', 'CASE WHEN x*nx+y*ny+z*nz < 0 THEN -y ELSE y END', 'CASE WHEN x*nx+y*ny+z*nz < 0 THEN -z ELSE z END')} FROM a""")
def normals_of_dip(spark, sf_dir):
    x = vectors(spark, sf_dir)
    return x.select("pid", *cells("n", G.normal_of_dip(F.col("x") * 30.0, F.col("y") * 300.0)), *cells("u", G.fold_upwards(F.col("a"), F.col("b"))))


@query(f"""WITH {P}, k AS (SELECT pid, x, y, z, sqrt(x*x+y*y)*sin(0.5)-z*cos(0.5) AS s, atan2(y,x)*sin(0.5) AS t FROM p) SELECT pid, {R('s*sin(t)')} AS u, {R('-s*cos(t)')} AS v, {R('sqrt(x*x+y*y)*cos(0.5)+z*sin(0.5)')} AS off FROM k""")
def cone_unrolled(spark, sf_dir):
    u = G.unroll_cone(F.col("a"), 0.5)
    return vectors(spark, sf_dir).select("pid", r6(u.x).alias("u"), r6(u.y).alias("v"), r6(u.z).alias("off"))


@query(f"""WITH {P}, k AS (SELECT pid, (x+0.5) AS u, (y+0.5) AS v FROM p) SELECT pid, {R('u*1+v*2+(1-u-v)*3')} AS a, {R('u*4+v*6+(1-u-v)*5')} AS b, {R('u*9+v*8+(1-u-v)*7')} AS c FROM k""")
def blended_vertices(spark, sf_dir):
    k = G.barycentric(F.col("x"), F.col("y"), *(G.point2(F.lit(p), F.lit(q)) for p, q in ((0.5, -0.5), (-0.5, 0.5), (-0.5, -0.5))))
    x = points(spark, sf_dir).select("pid", k.alias("k"))
    b = G.blend3(F.col("k"), V.vec(1.0, 4.0, 9.0), V.vec(2.0, 6.0, 8.0), V.vec(3.0, 5.0, 7.0))
    return x.select("pid", r6(b.x).alias("a"), r6(b.y).alias("b"), r6(b.z).alias("c"))


# --- cameras -------------------------------------------------------------------------------------------------------

TURN = (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)


def turn():
    return F.array(*[F.lit(v) for v in TURN])


@query(f"""WITH {P} SELECT pid, {spread('q', '2*(x*0.8-y*0.6)+0.1', '2*(x*0.6+y*0.8)-0.2', '2*z+0.5')}, {spread('c', '0.1+(x-0.1)*3', '0.2+(y-0.2)*3', '0.3+(z-0.3)*3')}, {spread('r', 'x*0.8+y*0.6', '-x*0.6+y*0.8', 'z')},
{spread('i', 'x+(nx-x)*0.3', 'y+(ny-y)*0.3', 'z+(nz-z)*0.3')}, {R('x*x*0.02')} AS uncertainty FROM p""")
def similarity_motions(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    x = vectors(spark, sf_dir)
    return x.select(
        "pid", *cells("q", camera.similarity(turn(), V.vec(0.1, -0.2, 0.5), 2.0, a)), *cells("c", camera.scale_about(a, V.vec(0.1, 0.2, 0.3), 3.0)), *cells("r", camera.rotate(camera.transpose(turn()), a)),
        *cells("i", camera.interpolate_pose(a, b, F.lit(0.3))), r6(camera.depth_uncertainty(F.col("x"), 100.0, 0.5)).alias("uncertainty"),
    )


@query(f"""WITH {P}, d AS (SELECT *, x*(y*nz-z*ny) AS k FROM p) SELECT pid, {R('x*(y*nz-z*ny)-y*(nx*nz-z*nx)+z*(nx*ny-y*nx)')} AS det, {R('-z')} AS s1, {R('y')} AS s2, {R('-x')} AS s5, true AS inverse FROM d""")
def matrix_functions(spark, sf_dir):
    """Determinant of rows (x y z), (nx y z), (nx ny nz); the skew matrix of a point; and that an inverse is one."""
    m = F.array("x", "y", "z", "nx", "y", "z", "nx", "ny", "nz")
    good = F.array(*[F.lit(v) + F.col(c) for v, c in zip((3.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 3.0), ("x", "y", "z", "nx", "y", "z", "nx", "ny", "nz"), strict=True)])
    x = points(spark, sf_dir).select("pid", m.alias("m"), good.alias("g"), place().alias("a"), normal().alias("b")).withColumn("i", camera.inverse(F.col("g")))
    back = camera.rotate(F.col("i"), camera.rotate(F.col("g"), F.col("a")))
    s = camera.skew(F.col("a"))
    return x.select("pid", r6(camera.determinant(F.col("m"))).alias("det"), *[r6(F.get(s, F.lit(k))).alias(f"s{k}") for k in (1, 2, 5)], (V.distance(back, F.col("a")) < 1e-9).alias("inverse"))


@query(f"WITH {P} SELECT pid, {R('x')} AS x, {R('y')} AS y, {R('z')} AS z FROM p")
def axis_angle_round_trip(spark, sf_dir):
    x = vectors(spark, sf_dir).withColumn("r", camera.axis_angle_matrix(F.col("a"))).withColumn("v", camera.matrix_axis_angle(F.col("r")))
    return x.select("pid", *[r6(f"v.{c}").alias(c) for c in "xyz"])


@query(f"""WITH {P}, f AS (SELECT pid, x, y, z+1.5 AS z FROM p) SELECT pid, {R('(100*x+50-32)/500*z')} AS bx, {R('(100*y+50-24)/400*z')} AS byy, {R('z')} AS bz, z BETWEEN 1.4 AND 1.6 AND abs(x) <= z*0.1 AND abs(y) <= z*0.08 AS seen FROM f""")
def back_projection(spark, sf_dir):
    q = V.vec("x", "y", F.col("z") + 1.5)
    x = points(spark, sf_dir).select("pid", q.alias("q"))
    b = camera.back_project(100.0 * F.col("q.x") + 50.0, 100.0 * F.col("q.y") + 50.0, F.col("q.z"), 500.0, 400.0, 32.0, 24.0)
    return x.select("pid", r6(b.x).alias("bx"), r6(b.y).alias("byy"), r6(b.z).alias("bz"), camera.in_frustum(F.col("q"), 0.1, 0.08, 1.4, 1.6).alias("seen"))


@query(f"WITH {P} SELECT pid, {R('x')} AS x, {R('y')} AS y FROM p")
def undistorted(spark, sf_dir):
    r2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    d = 1.0 + 0.05 * r2 + 0.01 * r2 * r2
    x = points(spark, sf_dir).select("pid", camera.undistort(F.col("x") * d, F.col("y") * d, 0.05, 0.01, rounds=16).alias("u"))
    return x.select("pid", r6("u.x").alias("x"), r6("u.y").alias("y"))


@query("""WITH e AS (SELECT event_id, [user_id % 3, event_id % 5, 0, user_id % 7] AS d FROM events), u AS (SELECT event_id, unnest([0,1,2,3]) AS i, unnest(d) AS d FROM e)
SELECT event_id, count(*) AS n, round(sum((i % 2 - 1) / 10.0 * (d / 1000.0)), 9) + 0.0 AS sx, round(sum((i // 2 - 2) / 20.0 * (d / 1000.0)), 9) + 0.0 AS sy, round(sum(d / 1000.0), 9) + 0.0 AS sz FROM u WHERE d > 0 GROUP BY 1""")
def depth_raster_points(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.array(F.col("user_id") % 3, F.col("event_id") % 5, F.lit(0), F.col("user_id") % 7).alias("d"))
    x = e.select("event_id", F.explode(camera.depth_points(F.col("d"), 2, 10.0, 20.0, 1.0, 2.0)).alias("p"))
    return x.groupBy("event_id").agg(F.count("*").alias("n"), *[(F.round(F.sum(f"p.{c}"), 9) + 0.0).alias(f"s{c}") for c in "xyz"])


# --- colours, distributions, texts ---------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, (p_partkey * 3) % 256 AS b, p_retailprice AS v, least(greatest((p_retailprice - 900) / 1200.0, 0), 1) AS s, (p_size - 25) / 25.0 AS q FROM part)
SELECT p_partkey, round((r+g+b)/3.0, 6) AS mean, floor(127.5*(1+sin(v*(6.283185307179586/100)))+0.5)::INT AS wave, floor(r*s)::INT AS ir, floor(g*s)::INT AS ig, floor(b*s)::INT AS ib,
floor(CASE WHEN q <= 0 THEN 0 + 100 * (least(greatest(q, -1), 0) + 1) WHEN q <= 1 THEN 100 + 155 * least(greatest(q, 0), 1) ELSE 255 END + 0.5)::INT AS ramp FROM c""")
def colour_tables(spark, sf_dir):
    x = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5).alias("r"), (F.col("p_partkey") % 256).alias("g"), (F.col("p_partkey") * 3 % 256).alias("b"), F.col("p_retailprice").alias("v"), ((F.col("p_size") - 25) / 25.0).alias("q"))
    i = colour.with_intensity(F.col("r"), F.col("g"), F.col("b"), F.col("v"), 900.0, 2100.0)
    stops = [(-1.0, (0, 0, 0)), (0.0, (100, 0, 0)), (1.0, (255, 0, 0))]
    return x.select("p_partkey", F.round(colour.composite(F.col("r"), F.col("g"), F.col("b")), 6).alias("mean"), colour.wave(F.col("v"), 100.0).r.alias("wave"), i.r.alias("ir"), i.g.alias("ig"), i.b.alias("ib"), colour.ramp(F.col("q"), stops).r.alias("ramp"))


@query(f"""WITH {P}, n AS (SELECT pid, x, y, CASE WHEN nz < 0 THEN -1 ELSE 1 END AS up, nx, ny, nz, sqrt(nx*nx+ny*ny+nz*nz) AS l FROM p), a AS (SELECT *, degrees(atan2(nx*up, ny*up)) AS d FROM n)
SELECT pid, {R('CASE WHEN d < 0 THEN d+360 ELSE d END')} AS h, {R('degrees(acos(least(1,abs(nz)/l)))/90')} AS s, {R('x*0.75+nx*0.25')} AS b0, {R('y*0.75+ny*0.25')} AS b1 FROM a""")
def colour_of_normals(spark, sf_dir):
    h = colour.hsv_of_normal(normal())
    b = colour.blend_images(F.array("x", "y"), F.array("nx", "ny"), 0.25)
    return points(spark, sf_dir).select("pid", r6(h.h).alias("h"), r6(h.s).alias("s"), r6(F.get(b, F.lit(0))).alias("b0"), r6(F.get(b, F.lit(1))).alias("b1"))


@query("""SELECT event_id, round(1 - exp(-power(value / 60, 1.5)), 8) AS weibull, round(exp(-0.5 * value / 10), 8) AS weight, round(1 / (1 + 0) * exp(-value / 10) * (1 + value / 10 + value * value / 200), 8) AS tail FROM events WHERE value > 0""")
def distribution_tails(spark, sf_dir):
    v = F.col("value")
    e = t(spark, sf_dir, "events").where("value > 0")
    return e.select("event_id", F.round(distributions.weibull_cdf(v, 1.5, 60.0), 8).alias("weibull"), F.round(distributions.mahalanobis_weight(v / 10.0), 8).alias("weight"), F.round(distributions.chi_square_tail(v / 5.0, 6), 8).alias("tail"))


@query("""WITH RECURSIVE x AS (SELECT event_id, value / 100.0 AS v FROM events WHERE value < 200 AND event_id % 10 = 0), k(event_id, v, n, term, total) AS (SELECT event_id, v, 0, v, v FROM x UNION ALL
SELECT event_id, v, n + 1, -term * v * v / (n + 1), total - term * v * v / ((n + 1) * (2 * n + 3)) FROM k WHERE n < 60) SELECT event_id, round(2 / sqrt(pi()) * total, 8) AS erf, round(1 - 2 / sqrt(pi()) * total, 8) AS erfc, round(0.5 * (1 + 2 / sqrt(pi()) * total), 8) AS cdf FROM k WHERE n = 60""")
def error_functions(spark, sf_dir):
    v = F.col("value") / 100.0
    e = t(spark, sf_dir, "events").where("value < 200 and event_id % 10 = 0")
    return e.select("event_id", F.round(distributions.erf(v), 8).alias("erf"), F.round(distributions.erfc(v), 8).alias("erfc"), F.round(distributions.normal_cdf(v, 0.0, 2.0**-0.5), 8).alias("cdf"))


@query(r"""WITH n AS (SELECT page_id, url, list_extract(string_split(url, '/'), -1) AS f FROM pages) SELECT page_id, replace(url, '/', '\') AS back, regexp_extract(f, '\.([^.]*)$', 1) AS ext, regexp_replace(f, '_[^_]*$', '') AS cut,
regexp_replace(f, '\.[^.]*$', '') = regexp_replace(list_extract(string_split('x/' || f, '/'), -1), '\.[^.]*$', '') AS same, (page_id % 3)::BIGINT - CASE WHEN page_id % 3 = 2 THEN 3 ELSE 0 END AS place FROM n""")
def path_texts(spark, sf_dir):
    p = t(spark, sf_dir, "pages").select("page_id", "url")
    f, back = strings.file_name(F.col("url")), F.translate("url", "/", "\\")
    x = p.select("page_id", "url", f.alias("f"), back.alias("back"))
    x = x.where(strings.forward_slashes(F.col("back")) == F.col("url"))
    kinds = F.array(F.lit(0), F.lit(1))
    return x.select("page_id", "back", strings.extension(F.col("f")).alias("ext"), strings.without_last_token(F.col("f")).alias("cut"), strings.same_base_name(F.col("url"), F.concat(F.lit("x/"), F.col("f"))).alias("same"), strings.index_of(kinds, (F.col("page_id") % 3).cast("int")).alias("place"))


@query("SELECT event_id, printf('%.3f * x + %.3f * y + %.3f = 0', value, value / 3, -value) AS line, [regexp_replace(list_extract(string_split(event_type, '/'), -1), '\\.[^.]*$', '')][1] AS base FROM events")
def line_texts(spark, sf_dir):
    v = F.col("value")
    return t(spark, sf_dir, "events").select("event_id", strings.equation(v, v / 3.0, -v).alias("line"), F.get(strings.base_names(F.array("event_type")), F.lit(0)).alias("base"))


# --- selections, fields, sets --------------------------------------------------------------------------------------


@query(f"WITH {P} SELECT pid FROM p WHERE abs((x-0.05)*0.8+(y)*0.6) <= 0.1 AND abs(-(x-0.05)*0.6+y*0.8) <= 0.12 AND abs(z) <= 0.15")
def oriented_box(spark, sf_dir):
    return spatial.oriented_box(points(spark, sf_dir), (0.05, 0.0, 0.0), ((0.8, 0.6, 0.0), (-0.6, 0.8, 0.0), (0.0, 0.0, 1.0)), (0.1, 0.12, 0.15)).select("pid")


@query(f"WITH {P}, k AS (SELECT pid, ((x-0.1)*3+y*4)/5 AS a, (x-0.1)*(x-0.1)+y*y+z*z AS d FROM p) SELECT pid, {R('a')} AS along FROM k WHERE d-a*a <= 0.04 AND a >= 0")
def along_ray(spark, sf_dir):
    return spatial.along_ray(points(spark, sf_dir), (0.1, 0.0, 0.0), (3.0, 4.0, 0.0), 0.2).select("pid", r6("along").alias("along"))


@query(f"""WITH {P}, b AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS s FROM p),
g AS (SELECT pid, least(floor((x-lx)/s*8),7)::INT AS i, least(floor((y-ly)/s*8),7)::INT AS j, least(floor((z-lz)/s*8),7)::INT AS k FROM p, b)
SELECT pid, ((i&1)+(j&1)*2+(k&1)*4+((i>>1)&1)*8+((j>>1)&1)*16+((k>>1)&1)*32+((i>>2)&1)*64+((j>>2)&1)*128+((k>>2)&1)*256)::BIGINT AS code FROM g""")
def morton_index(spark, sf_dir):
    """Codes of three levels of the cube around all points, in the order of the index."""
    return spatial.indexed(points(spark, sf_dir), level=3).select("pid", "code")


@query(f"WITH {P} SELECT {', '.join(f'min({c}) AS low_{c}, max({c}) AS high_{c}' for c in 'xyz')} FROM p")
def bounding_box(spark, sf_dir):
    return aggregates.box(points(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def top_rows_of_groups(spark, sf_dir):
    x = filters.top_per_group(t(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")], 2)
    return x.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def selected_rows(spark, sf_dir):
    ids = t(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return filters.subset(t(spark, sf_dir, "orders"), ids, "o_custkey").select("o_orderkey", "o_totalprice")


@query(f"WITH {_FACES} SELECT fid FROM f WHERE v[1] % 3 > 0 AND v[2] % 3 > 0 AND v[3] % 3 > 0")
def faces_of_vertices(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    return filters.faces_inside(f, v.where("vid % 3 > 0").select(F.col("vid").alias("pid"))).select("fid")


@query("""WITH s AS (SELECT event_type AS layout_id, event_id AS line_id, user_id % 4 AS a, user_id % 3 AS b, event_id % 4 AS c, event_id % 3 AS d FROM events)
SELECT min(line_id) AS line_id FROM s GROUP BY layout_id, CASE WHEN (a, b) <= (c, d) THEN (a, b, c, d) ELSE (c, d, a, b) END""")
def distinct_segments(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    s = e.select(F.col("event_type").alias("layout_id"), F.col("event_id").alias("line_id"), *[(F.col(c) % m).alias(n) for c, m, n in (("user_id", 4, "x1"), ("user_id", 3, "y1"), ("event_id", 4, "x2"), ("event_id", 3, "y2"))])
    return sets.distinct_segments(s).select("line_id")


@query(f"""WITH {_FACES}, m AS (SELECT max(fid) + 1 AS n FROM f) SELECT fid, 0 AS part, v[1] AS a FROM f UNION ALL SELECT fid + n, 1, v[1] + (SELECT max(vec_id) + 1 FROM embeddings) FROM f, m""")
def meshes_in_one(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    _, faces = sets.append_meshes([v, v], [f, f])
    return faces.select("fid", "part", F.get("v", F.lit(0)).alias("a"))


@query("""WITH p AS (SELECT least(l_suppkey, l_partkey % 100 + 1) AS a, greatest(l_suppkey, l_partkey % 100 + 1) AS b, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_suppkey <> l_partkey % 100 + 1)
SELECT a, b, count(*) AS items, min(o) AS first FROM p GROUP BY a, b HAVING count(*) >= 3""")
def nested_pair_items(spark, sf_dir):
    x = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    x = aggregates.nested_pairs(x, "a", "b", ["o", "n"], 3)
    return x.select("a", "b", F.size("items").cast("long").alias("items"), F.get("items", F.lit(0)).o.alias("first"))


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size - 3 > 0 THEN 1 + floor((p_size - 3) / 2.5 + 0.5) END::BIGINT, -1) AS n FROM part""")
def grid_sizes(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.coalesce(aggregates.grid_size(F.col("p_size") - 3.0, 2.5), F.lit(-1)).cast("long").alias("n"))


@query("""WITH r AS (SELECT DISTINCT event_id FROM events WHERE value > 0), x AS (SELECT row_number() OVER (ORDER BY value, event_id) AS r, value FROM events)
SELECT (SELECT value FROM x WHERE r = 18) AS low, (SELECT median(value) FROM events) AS middle, (SELECT value FROM x WHERE r = (SELECT count(*) - ceil(count(*) * 0.1) + 1 FROM x)) AS top""")
def order_statistics(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("value")
    return one(spark, low=fields.kth(e, "value", 17), middle=fields.median(e, "value"), top=fields.rank_from_top(e, "value", 0.1))


# --- graphs, tracks, frames ----------------------------------------------------------------------------------------


@query("WITH d AS (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) - 1 AS id FROM (SELECT DISTINCT l_suppkey FROM lineitem)) SELECT l_orderkey, l_linenumber, l_partkey, id FROM lineitem JOIN d USING (l_suppkey)")
def dense_numbers(spark, sf_dir):
    x = graph.dense_ids(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", "id")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "id")


_MATRIX = "m AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_quantity").alias("v"))


@query(f"WITH {_MATRIX} SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM m UNION ALL SELECT j, i, -2 * v FROM m) GROUP BY i, j")
def sparse_sum(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    return graph.sparse_add(m, graph.sparse_transpose(m), -2.0)


@query(f"WITH {_MATRIX} SELECT i, v, (SELECT sum(a.v * a.v) FROM m a WHERE a.i = a.j) AS dot FROM m WHERE i = j")
def sparse_diagonals(spark, sf_dir):
    d = graph.sparse_diagonal(_matrix(spark, sf_dir))
    return d.crossJoin(F.broadcast(graph.sparse_dot(d, d).withColumnRenamed("v", "dot")))  # one row


@query(f"""WITH {P}, e AS (SELECT a.pid AS a, b.pid AS b FROM p a, p b WHERE {D2} <= 0.0064 AND a.pid < b.pid), l AS (SELECT pid, label FROM p), c AS (SELECT pid, k AS label, CASE WHEN k = label THEN 0.0 ELSE 1.0 + k / 10.0 END AS cost FROM l, range(10) r(k))
SELECT round((SELECT sum(cost) FROM c JOIN l ON c.pid = l.pid AND c.label = l.label % 3), 6) AS unary, (SELECT 0.5 * count(*) FROM e JOIN l p ON p.pid = e.a JOIN l q ON q.pid = e.b WHERE p.label % 3 <> q.label % 3) AS pairwise, (SELECT count(DISTINCT label % 3) FROM l) AS used""")
def label_energy(spark, sf_dir):
    p = points(spark, sf_dir).select("pid", "label")
    k = F.explode(F.sequence(F.lit(0), F.lit(9)))
    costs = p.select(F.col("pid").alias("id"), F.col("label").alias("own"), k.alias("label"))
    costs = costs.select("id", "label", F.when(F.col("label") == F.col("own"), 0.0).otherwise(1.0 + F.col("label") / 10.0).alias("cost"))
    e = graph.energy(costs, _near_edges(spark, sf_dir, 0.08).where("a < b"), p.select(F.col("pid").alias("id"), (F.col("label") % 3).alias("label")), 0.5)
    return e.select(F.round("unary", 6).alias("unary"), "pairwise", "used")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT a.o_custkey % 97 AS a, b.o_custkey % 97 AS b FROM orders a JOIN orders b ON a.o_orderkey // 300 = b.o_orderkey // 300 AND a.o_custkey % 97 < b.o_custkey % 97 AND a.o_orderstatus = 'P' AND b.o_orderstatus = 'P'),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT DISTINCT o_custkey % 97, o_custkey % 97 FROM orders WHERE o_orderstatus = 'P'), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a) SELECT a AS key, min(b) AS group_id FROM r GROUP BY a""")
def overlapping_groups(spark, sf_dir):
    o = t(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return graph.overlap_groups(o.select((F.col("o_custkey") % 97).alias("key"), F.floor(F.col("o_orderkey") / 300).alias("item")).distinct(), "key", "item")


@query("""WITH f AS (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS e, ts FROM events), p AS (SELECT *, last_value(CASE WHEN e > 0 THEN e END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
lead(CASE WHEN e > 0 THEN e END) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM f), g AS (SELECT *, CASE WHEN e > 0 THEN e ELSE coalesce((before + after) / 2, before, after, 0) END AS x FROM p)
SELECT user_id, event_id AS id, round(CASE WHEN min(x) OVER (PARTITION BY user_id) > 0 THEN x ELSE 0 END, 6) AS exposure FROM g""")
def exposure_filled(spark, sf_dir):
    f = t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("exposure"))
    return windows.exposure_filled(f, "user_id").select("user_id", "id", F.round("exposure", 6).alias("exposure"))


@query("""WITH s AS (SELECT event_id, floor(value / 10) AS x1, user_id % 20 AS y1, floor(value / 10) + event_id % 7 - 3 AS x2, user_id % 20 + event_id % 5 AS y2 FROM events), n AS (SELECT *, greatest(abs(x2 - x1), abs(y2 - y1), 1)::INT AS n FROM s),
k AS (SELECT *, unnest(range(n + 1)) AS k FROM n) SELECT event_id, k::INT AS k, floor(x1 + (x2 - x1) * k / n + 0.5)::BIGINT AS u, floor(y1 + (y2 - y1) * k / n + 0.5)::BIGINT AS v FROM k""")
def segment_pixels(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    x1, y1 = F.floor(F.col("value") / 10), F.col("user_id") % 20
    s = e.select("event_id", x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + F.col("event_id") % 7 - 3).cast("double").alias("x2"), (y1 + F.col("event_id") % 5).cast("double").alias("y2"))
    return windows.segment_cells(s, ["event_id"])


# --- meshes --------------------------------------------------------------------------------------------------------


@query(f"WITH {_FACES}, {_GOOD}, {_EDGES} SELECT fid, a, b FROM d")
def directed_edges(spark, sf_dir):
    return mesh.directed_edges(_good(spark, sf_dir)[1])


@query(f"""WITH {_FACES}, {_GOOD}, {_EDGES}, u AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM d GROUP BY 1, 2), w AS (SELECT a AS vid, n FROM u UNION ALL SELECT b, n FROM u)
SELECT vid, CASE WHEN max(n) > 2 THEN 'non_manifold' WHEN min(n) = 1 THEN 'border' ELSE 'inner' END AS class FROM w GROUP BY vid""")
def vertex_classes(spark, sf_dir):
    return mesh.vertex_classes(_good(spark, sf_dir)[1])


@query(f"WITH {_FACES}, {_GOOD}, {_EDGES} SELECT d.fid, d.a, d.b, coalesce(min(o.fid), -1) AS opposite FROM d LEFT JOIN d o ON o.a = d.b AND o.b = d.a GROUP BY d.fid, d.a, d.b")
def half_edges(spark, sf_dir):
    return mesh.half_edges(_good(spark, sf_dir)[1]).select("fid", "a", "b", F.coalesce("opposite", F.lit(-1).cast("long")).alias("opposite"))


@query(f"""WITH {_FACES}, {_GOOD}, {_EDGES}, e AS (SELECT DISTINCT fid, least(a, b) AS a, greatest(a, b) AS b FROM d) SELECT p.fid AS f1, q.fid AS f2, p.a, p.b FROM e p JOIN e q ON p.a = q.a AND p.b = q.b AND p.fid < q.fid AND p.fid % 3 <> q.fid % 3""")
def seam_edges(spark, sf_dir):
    f = _good(spark, sf_dir)[1]
    return mesh.seam_edges(f, f.select("fid", (F.col("fid") % 3).alias("label")))


@query(f"""WITH {P}, {_FACES}, m AS (SELECT floor(x * 20) AS x, floor(y * 20) AS y, floor(z * 20) AS z, pid FROM p), r AS (SELECT m.pid, k.new FROM m JOIN (SELECT x, y, z, min(pid) AS new FROM m GROUP BY 1, 2, 3) k USING (x, y, z))
SELECT fid, a.new AS a, b.new AS b, c.new AS c FROM f JOIN r a ON a.pid = v[1] JOIN r b ON b.pid = v[2] JOIN r c ON c.pid = v[3]""")
def merged_vertices(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    _, f = mesh.merged_vertices(v.select("vid", *[F.floor(F.col(c) * 20).alias(c) for c in "xyz"]), f)
    return f.select("fid", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("abc")])


@query(f"WITH {_FACES}, {_GOOD}, i AS (SELECT *, list_position(v, list_min(v)) AS k FROM g) SELECT fid, v[k] AS a, v[k % 3 + 1] AS b, v[(k + 1) % 3 + 1] AS c FROM i")
def turned_faces(spark, sf_dir):
    f = _good(spark, sf_dir)[1].select("fid", mesh.turned(F.col("v")).alias("v"))
    return f.select("fid", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("abc")])


@query(f"""WITH {P}, {_FACES}, s AS (SELECT pid FROM p WHERE x > -0.1), k AS (SELECT f.* FROM f WHERE v[1] IN (FROM s) AND v[2] IN (FROM s) AND v[3] IN (FROM s)), u AS (SELECT DISTINCT unnest(v) AS vid FROM k), n AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS new FROM u)
SELECT fid, a.new AS a, b.new AS b, c.new AS c FROM k JOIN n a ON a.vid = v[1] JOIN n b ON b.vid = v[2] JOIN n c ON c.vid = v[3]""")
def visible_part_of_mesh(spark, sf_dir):
    v, f = _mesh(spark, sf_dir)
    f, _ = mesh.visible_faces(f, v.where("x > -0.1").select("vid"))
    return f.select("fid", *[F.get("v", F.lit(k)).alias(c) for k, c in enumerate("abc")])


@query("""WITH m AS (SELECT event_id % 40 AS i, event_id // 40 % 25 AS j, max(value) AS h FROM events GROUP BY 1, 2), q AS (SELECT a.i, a.j, a.h AS h00, b.h AS h10, c.h AS h01, d.h AS h11 FROM m a JOIN m b ON b.i = a.i + 1 AND b.j = a.j JOIN m c ON c.i = a.i AND c.j = a.j + 1 JOIN m d ON d.i = a.i + 1 AND d.j = a.j + 1)
SELECT i, j, 0 AS half, i * 0.5 AS ax, h00 AS az, h10 AS bz, h11 AS cz FROM q UNION ALL SELECT i, j, 1, i * 0.5, h00, h11, h01 FROM q""")
def grid_triangles(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    m = e.groupBy((F.col("event_id") % 40).alias("i"), (F.floor(F.col("event_id") / 40) % 25).alias("j")).agg(F.max("value").alias("h"))
    return mesh.grid_triangles(m, 0.5).select("i", "j", "half", F.col("a.x").alias("ax"), F.col("a.z").alias("az"), F.col("b.z").alias("bz"), F.col("c.z").alias("cz"))


@query(f"""WITH {P}, {_FACES}, t AS (SELECT fid, a.x AS ax, a.y AS ay, a.z AS az, b.x-a.x AS ex, b.y-a.y AS ey, b.z-a.z AS ez, c.x-a.x AS gx, c.y-a.y AS gy, c.z-a.z AS gz FROM f JOIN p a ON a.pid = v[1] JOIN p b ON b.pid = v[2] JOIN p c ON c.pid = v[3]),
s AS (SELECT fid, 0.5*sqrt(power(ey*gz-ez*gy,2)+power(ez*gx-ex*gz,2)+power(ex*gy-ey*gx,2)) AS area FROM t) SELECT fid, true AS near, true AS inside FROM s WHERE floor(area*200) > 0 OR area*200 - floor(area*200) > 2""")
def surface_samples(spark, sf_dir):
    """Faces sure of a sample by their area, whether their counts are those of the area, and whether samples lie in their planes."""
    v, f = _mesh(spark, sf_dir)
    x = mesh.surface_samples(v, f, 200.0, 3).join(mesh.with_points(v, f), "fid")
    n = V.cross(V.sub(F.col("b"), F.col("a")), V.sub(F.col("c"), F.col("a")))
    off = F.abs(V.dot(n, V.sub(V.vec("x", "y", "z"), F.col("a"))))
    x = x.groupBy("fid").agg(F.count("*").alias("n"), F.max(off).alias("off"), F.first(V.length(n) * 100.0).alias("due"))
    return x.where("due >= 1").select("fid", (F.abs(F.col("n") - F.col("due")) <= 1).alias("near"), (F.col("off") < 1e-9).alias("inside"))


# --- images --------------------------------------------------------------------------------------------------------

_IMAGE = "m AS (SELECT 0 AS img, event_id % 40 AS i, event_id // 40 AS j, max(value) AS v FROM events GROUP BY 2, 3)"


def _picture(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return e.groupBy(F.lit(0).alias("img"), (F.col("event_id") % 40).alias("i"), F.floor(F.col("event_id") / 40).alias("j")).agg(F.max("value").alias("v"))


@query(f"WITH {_IMAGE} SELECT a.i, a.j, round(avg(b.v), 6) AS v FROM m a JOIN m b ON abs(a.i - b.i) <= 2 AND abs(a.j - b.j) <= 2 GROUP BY a.i, a.j")
def box_means(spark, sf_dir):
    return images.box_mean(_picture(spark, sf_dir), 2).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_IMAGE}, h AS (SELECT i, j, CASE WHEN (i + j) % 4 > 0 THEN v END AS v FROM m), n AS (SELECT a.i, a.j, avg(b.v) AS w FROM h a JOIN h b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j) SELECT i, j, round(coalesce(v, w), 6) AS v FROM h JOIN n USING (i, j)")
def filled_cells(spark, sf_dir):
    m = _picture(spark, sf_dir).withColumn("v", F.when((F.col("i") + F.col("j")) % 4 > 0, F.col("v")))
    return images.filled(m, 1).select("i", "j", F.round("v", 6).alias("v"))


@query(f"WITH {_IMAGE} SELECT i, j, round((lead(v) OVER (PARTITION BY j ORDER BY i) - lag(v) OVER (PARTITION BY j ORDER BY i)) / 2, 6) AS di, round((lead(v) OVER (PARTITION BY i ORDER BY j) - lag(v) OVER (PARTITION BY i ORDER BY j)) / 2, 6) AS dj FROM m")
def raster_gradients(spark, sf_dir):
    return images.gradients(_picture(spark, sf_dir)).select("i", "j", F.round("di", 6).alias("di"), F.round("dj", 6).alias("dj"))


@query(f"WITH {_IMAGE}, b AS (SELECT i // 8 AS bi, j // 8 AS bj, quantile_cont(v, 0.5) + 7 AS q FROM m GROUP BY 1, 2) SELECT a.bi, a.bj, round(power(avg(b.q), 2), 4) AS threshold FROM b a JOIN b ON abs(a.bi - b.bi) <= 1 AND abs(a.bj - b.bj) <= 1 GROUP BY a.bi, a.bj")
def block_thresholds(spark, sf_dir):
    return images.block_thresholds(_picture(spark, sf_dir), 8).select("bi", "bj", F.round("threshold", 4).alias("threshold"))


@query(f"WITH {_IMAGE} SELECT i, j, round((least(floor(v), 255) * 0.5 + 3) / (1 + (i + j) % 3), 6) AS v FROM m")
def corrected_images(spark, sf_dir):
    m = _picture(spark, sf_dir)
    shade = m.select("i", "j", (1.0 + (F.col("i") + F.col("j")) % 3).alias("w"))
    return images.corrected(m.withColumn("v", F.floor("v")), [k * 0.5 + 3.0 for k in range(256)], shade).select("i", "j", F.round("v", 6).alias("v"))


@query("SELECT least(power(2, ceil(log2(greatest(sqrt(sum(p_size * (p_partkey % 50 + 1))), max(greatest(p_size, p_partkey % 50 + 1)), 256)))), 8192)::INT AS side FROM part")
def atlas_size(spark, sf_dir):
    return images.atlas_size(t(spark, sf_dir, "part").select(F.col("p_size").alias("w"), (F.col("p_partkey") % 50 + 1).alias("h")))


# --- fits, checked by what makes them right ------------------------------------------------------------------------


@query(f"""WITH {P}, m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x)+var_pop(y)+var_pop(z) AS trace FROM p GROUP BY label) SELECT label, n, {R('mx')} AS mx, {R('my')} AS my, {R('mz')} AS mz, {R('trace')} AS trace, true AS is_eigen, true AS ordered FROM m""")
def eigen_of_groups(spark, sf_dir):
    """Means and trace by SQL; that the normal is an eigenvector is checked against the covariance itself."""
    g = points(spark, sf_dir).groupBy("label").agg(*fitting.moments())
    e = fitting.eigen(g, "label").select("label", "n", *[F.col(c) for c in ("mx", "my", "mz", "l1", "l2", "l3", "nx", "ny", "nz")])
    x = e.join(g.select("label", "xx", "xy", "xz", "yy", "yz", "zz"), "label")
    rows = (("xx", "xy", "xz", "nx"), ("xy", "yy", "yz", "ny"), ("xz", "yz", "zz", "nz"))
    ok = F.lit(True)
    for a, b, c, n in rows:
        ok = ok & (F.abs(F.col(a) * F.col("nx") + F.col(b) * F.col("ny") + F.col(c) * F.col("nz") - F.col("l3") * F.col(n)) < 1e-9)
    return x.select("label", "n", r6("mx").alias("mx"), r6("my").alias("my"), r6("mz").alias("mz"), r6(F.col("l1") + F.col("l2") + F.col("l3")).alias("trace"), ok.alias("is_eigen"), ((F.col("l1") >= F.col("l2")) & (F.col("l2") >= F.col("l3"))).alias("ordered"))


@query(f"""WITH {P}, g AS (SELECT label, count(*) AS n FROM p WHERE label < 9 GROUP BY label HAVING count(*) >= 2) SELECT label, n, true AS is_line FROM g""")
def track_lines(spark, sf_dir):
    """Lines through groups: their direction is the greatest eigenvector, so no other direction has more variance."""
    p = points(spark, sf_dir).where("label < 9")
    f = fitting.track_lines(p, "label")
    d = p.join(f, "label")
    along = sum(((F.col(c) - F.col(f"m{c}")) * F.col(f"d{c}") for c in "xyz"), F.lit(0.0))
    off2 = sum(((F.col(c) - F.col(f"m{c}")) * (F.col(c) - F.col(f"m{c}")) for c in "xyz"), F.lit(0.0)) - along * along
    x = d.groupBy("label", "n").agg(F.sqrt(F.avg(off2)).alias("rms"), F.first("rms").alias("told"), *[F.var_pop(c).alias(f"v{c}") for c in "xyz"], F.var_pop(along).alias("v"))
    return x.select("label", "n", ((F.abs(F.col("rms") - F.col("told")) < 1e-9) & (F.col("v") >= F.greatest("vx", "vy", "vz") - 1e-12)).alias("is_line"))


@query("SELECT true AS turned, true AS shifted, true AS scaled, true AS exact")
def rigid_motion(spark, sf_dir):
    """A motion laid on the points is found again."""
    p = points(spark, sf_dir)
    q = camera.similarity(turn(), V.vec(0.1, -0.2, 0.5), 1.5, F.col("a"))
    pairs = p.select(place().alias("a")).select("a", q.alias("q")).select(*[F.col(f"a.{c}").alias(f"a{c}") for c in "xyz"], *[F.col(f"q.{c}").alias(f"b{c}") for c in "xyz"])
    r, shift, s, rms = fitting.rigid_transform(pairs, scaled=True)
    near = lambda got, want: all(abs(float(a) - b) < 1e-9 for a, b in zip(got, want, strict=True))
    return one(spark, turned=near(r.ravel(), TURN), shifted=near(shift, (0.1, -0.2, 0.5)), scaled=near([s], [1.5]), exact=rms < 1e-6)


# --- records -------------------------------------------------------------------------------------------------------


@query(f"""WITH {P}, s AS (SELECT pid, label, x AS x1, y AS y1, z AS x2, nx AS y2 FROM p), q AS (SELECT a.pid, b.pid AS other, a.x2-a.x1 AS ux, a.y2-a.y1 AS uy, b.x2-b.x1 AS vx, b.y2-b.y1 AS vy, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM s a JOIN s b ON a.label = b.label AND b.pid < a.pid),
m AS (SELECT pid, degrees(acos(least(1, abs(ux*vx+uy*vy)/(sqrt(ux*ux+uy*uy)*sqrt(vx*vx+vy*vy))))) AS angle, (abs(ux*(ay1-by1)-(ax1-bx1)*uy)/sqrt(ux*ux+uy*uy) + abs(ux*(ay1-by2)-(ax1-bx2)*uy)/sqrt(ux*ux+uy*uy) + abs(vx*(by1-ay1)-(bx1-ax1)*vy)/sqrt(vx*vx+vy*vy) + abs(vx*(by1-ay2)-(bx1-ax2)*vy)/sqrt(vx*vx+vy*vy))/4 AS d FROM q)
SELECT pid, pid IN (SELECT pid FROM m WHERE angle <= 10 AND d <= 0.1) AS near FROM s""")
def near_line_flags(spark, sf_dir):
    s = points(spark, sf_dir).select("label", F.col("pid").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("x2"), F.col("nx").alias("y2"))
    return records.near_flags(s, "label", 10.0, 0.1).select(F.col("line_id").alias("pid"), "near")


@query(f"""WITH {P}, s AS (SELECT pid, label, x AS x1, y AS y1, z AS x2, nx AS y2 FROM p), c AS (SELECT pid, label, x1 + 0.01 AS x1, y1 + 0.005 AS y1, x2 - 0.01 AS x2, y2 AS y2 FROM s WHERE pid % 2 = 0),
q AS (SELECT a.pid, b.pid AS other, a.x2-a.x1 AS ux, a.y2-a.y1 AS uy, b.x2-b.x1 AS vx, b.y2-b.y1 AS vy, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM s a JOIN c b ON a.label = b.label),
m AS (SELECT pid, other, degrees(acos(least(1, abs(ux*vx+uy*vy)/(sqrt(ux*ux+uy*uy)*sqrt(vx*vx+vy*vy))))) AS angle, (abs(ux*(ay1-by1)-(ax1-bx1)*uy)/sqrt(ux*ux+uy*uy) + abs(ux*(ay1-by2)-(ax1-bx2)*uy)/sqrt(ux*ux+uy*uy) + abs(vx*(by1-ay1)-(bx1-ax1)*vy)/sqrt(vx*vx+vy*vy) + abs(vx*(by1-ay2)-(bx1-ax2)*vy)/sqrt(vx*vx+vy*vy))/4 AS d FROM q)
SELECT s.pid, coalesce(arg_min(m.other, m.angle + m.d), -1) AS match FROM s LEFT JOIN m ON m.pid = s.pid AND m.angle < 20 AND m.d < 0.05 GROUP BY s.pid""")
def nearest_candidate_line(spark, sf_dir):
    s = points(spark, sf_dir).select("label", F.col("pid").alias("line_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("x2"), F.col("nx").alias("y2"))
    c = s.where("line_id % 2 = 0").select("label", "line_id", (F.col("x1") + 0.01).alias("x1"), (F.col("y1") + 0.005).alias("y1"), (F.col("x2") - 0.01).alias("x2"), "y2")
    return records.nearest_line(s, c, "label", 20.0, 0.05).select(F.col("line_id").alias("pid"), "match")


@query("""WITH o AS (SELECT l_orderkey AS t, l_suppkey AS v, l_partkey % 3 AS g, l_linenumber AS u, l_quantity AS w FROM lineitem), n AS (SELECT t, count(*) AS n, count(DISTINCT g) AS k, min(v) AS first FROM o GROUP BY t)
SELECT o_orderkey AS track_id, n, CASE k WHEN 1 THEN 'plane' WHEN 2 THEN 'intersection' ELSE 'none' END AS kind, first FROM orders JOIN n ON t = o_orderkey""")
def tracks_with_observations(spark, sf_dir):
    o = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("view_id"), F.col("l_linenumber").alias("u"), F.col("l_quantity").alias("v"), (F.col("l_partkey") % 3).alias("polygon"))
    x = records.nested_tracks(o, t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("track_id")))
    return x.select("track_id", F.size("observations").cast("long").alias("n"), "kind", F.get("observations", F.lit(0)).view_id.alias("first"))


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS t, l_suppkey AS v, min(l_partkey) % 3 AS g FROM lineitem GROUP BY 1, 2), f AS (SELECT t, arg_min(g, v) AS first FROM o GROUP BY t)
SELECT o.t AS track_id, v AS view_id, first AS polygon, CASE WHEN g = first THEN 1.0 WHEN v % 2 = 0 THEN v * 10.0 + first ELSE -1.0 END AS t FROM o JOIN f USING (t)""")
def recast_observations(spark, sf_dir):
    o = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track_id"), F.col("l_suppkey").alias("view_id")).agg((F.min("l_partkey") % 3).alias("polygon")).withColumn("t", F.lit(1.0))
    s = t(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("view_id"), F.explode(F.array(*[F.lit(k).cast("long") for k in range(3)])).alias("polygon"))
    x = records.recast(o, s.withColumn("t", F.col("view_id") * 10.0 + F.col("polygon")))
    return x.select("track_id", "view_id", "polygon", F.when(F.isnan("t"), -1.0).otherwise(F.col("t")).alias("t"))


@query("""WITH x AS (SELECT event_id, [user_id % 3 - 1, event_id % 4 - 1, user_id % 5 - 2] AS m FROM events), u AS (SELECT event_id, unnest([0, 1, 2]) AS i, unnest(m) AS m FROM x) SELECT event_id, i, m FROM u WHERE m >= 0""")
def match_vectors(spark, sf_dir):
    m = F.array(F.col("user_id") % 3 - 1, F.col("event_id") % 4 - 1, F.col("user_id") % 5 - 2)
    return t(spark, sf_dir, "events").select("event_id", F.explode(records.match_indices(m)).alias("p")).select("event_id", "p.i", "p.m")


@query("""WITH n AS (SELECT 'user' || u AS name, u AS id FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 4 > 0)) SELECT event_id, a.id AS a_id, b.id AS b_id FROM events JOIN n a ON a.name = 'user' || user_id JOIN n b ON b.name = 'user' || (event_id % 200)""")
def resolved_names(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    names = e.where("user_id % 4 > 0").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"), F.col("user_id").alias("id")).distinct()
    rows = e.select("event_id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("user"), (F.col("event_id") % 200).cast("string")).alias("b"))
    return records.resolved(rows, names, ["a", "b"]).select("event_id", "a_id", "b_id")


@query("""WITH r AS (SELECT event_id, user_id % 30 AS a, event_id % 30 AS b FROM events), p AS (SELECT DISTINCT least(n_nationkey, n_regionkey * 5 + 2) AS lo, greatest(n_nationkey, n_regionkey * 5 + 2) AS hi FROM nation) SELECT event_id FROM r JOIN p ON lo = least(a, b) AND hi = greatest(a, b)""")
def pair_records(spark, sf_dir):
    r = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 30).alias("a"), (F.col("event_id") % 30).alias("b"))
    p = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("a"), (F.col("n_regionkey") * 5 + 2).cast("long").alias("b"))
    return records.pair_lookup(p, r, "a", "b").select("event_id")


@query("""SELECT c_custkey AS cam_id, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS segments, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), 0) AS points FROM customer""")
def nested_views(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    lay = o.select(F.col("o_custkey").alias("cam_id"), F.col("o_orderkey").alias("line_id"), *[F.lit(float(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])
    pts = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("cam_id"), F.col("o_orderkey").alias("point_id"), F.lit(0.0).alias("u"), F.lit(1.0).alias("v"))
    x = records.nested_views(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cam_id")), lay, pts)
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return x.select("cam_id", F.greatest(n("segments"), F.lit(0).cast("long")).alias("segments"), F.greatest(n("points"), F.lit(0).cast("long")).alias("points"))


@query(f"""WITH {P}, r AS (SELECT pid, label, x, y, z FROM p), g AS (SELECT label, k, -0.4 + 0.2 * k AS h FROM (SELECT DISTINCT label FROM p), range(5) t(k)) SELECT r.pid AS ray_id, coalesce(arg_min(g.k, g.h - r.z), -1)::BIGINT AS face_id FROM r LEFT JOIN g ON g.label = r.label AND g.h > r.z AND r.x >= -1 AND r.y >= -1 GROUP BY r.pid""")
def nearest_hits(spark, sf_dir):
    """Rays upwards against five large triangles that lie over each other."""
    p = points(spark, sf_dir)
    rays = p.select(F.col("pid").alias("ray_id"), "label", place().alias("origin"), V.vec(0.0, 0.0, 1.0).alias("direction"))
    h = -0.4 + 0.2 * F.col("face_id")
    faces = p.select("label").distinct().withColumn("face_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    faces = faces.select("label", "face_id", V.vec(F.lit(-1.0), F.lit(-1.0), h).alias("a"), V.vec(F.lit(9.0), F.lit(-1.0), h).alias("b"), V.vec(F.lit(-1.0), F.lit(9.0), h).alias("c"))
    return records.nearest_hit(rays, faces, "label").select("ray_id", "face_id")


@query("""WITH d AS (SELECT event_id, event_type AS k, user_id * 7919 AS w FROM events WHERE event_id < 400), m AS (SELECT a.event_id AS i, b.event_id AS j, bit_count(xor(a.w, b.w * 3)) AS h FROM d a JOIN d b USING (k)), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY h, j) AS r FROM m) SELECT i, j, h AS distance FROM r WHERE r = 1 AND h < 8""")
def descriptor_matches(spark, sf_dir):
    """Descriptors stand in for image features: the first 400 events are the two small images' features."""
    d = t(spark, sf_dir, "events").where("event_id < 400")
    a = d.select(F.col("event_type").alias("k"), F.col("event_id").alias("item"), F.array(F.col("user_id") * 7919).alias("descriptor"))
    b = d.select(F.col("event_type").alias("k"), F.col("event_id").alias("item"), F.array(F.col("user_id") * 7919 * 3).alias("descriptor"))
    return records.descriptor_matches(a, b, "k", 8).select("i", "j", F.col("distance"))


@query("""WITH r AS (SELECT i, j, arg_max(l, (n, -l)) AS label FROM (SELECT event_id % 40 AS i, event_id // 40 % 25 AS j, min(user_id % 4) AS l, 1 AS n FROM events GROUP BY 1, 2) GROUP BY 1, 2), s AS (SELECT event_id, user_id % 40 AS u, event_id % 25 AS v FROM events),
c AS (SELECT event_id, u + k AS u, v FROM s, range(6) t(k)), l AS (SELECT event_id, coalesce(label, -1) AS label, count(*) AS n FROM c LEFT JOIN r ON i = u AND j = v GROUP BY 1, 2) SELECT event_id, arg_min(label, (-n, label)) AS label FROM l GROUP BY 1""")
def labels_along_lines(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    r = e.groupBy(F.lit(0).alias("img"), (F.col("event_id") % 40).alias("i"), (F.floor(F.col("event_id") / 40) % 25).alias("j")).agg(F.min(F.col("user_id") % 4).alias("v"))
    u, v = (F.col("user_id") % 40).cast("double"), (F.col("event_id") % 25).cast("double")
    s = e.select(F.lit(0).alias("img"), "event_id", u.alias("x1"), v.alias("y1"), (u + 5.0).alias("x2"), v.alias("y2"))
    return records.label_by_samples(s, r, ["img", "event_id"]).select("event_id", "label")


@query(f"""WITH {P}, c AS (SELECT pid, floor(x / 0.2)::BIGINT AS cx, floor(y / 0.2)::BIGINT AS cy, floor(z / 0.2)::BIGINT AS cz FROM p) SELECT DISTINCT cx, cy, cz, true AS there FROM c""")
def random_of_voxels(spark, sf_dir):
    """One point for each occupied voxel, and it is one of the voxel's own."""
    x = aggregates.voxel_random(points(spark, sf_dir), 0.2, 5).join(points(spark, sf_dir).select("pid", spatial.cell(0.2).alias("own")), "pid")
    return x.select("cx", "cy", "cz", ((F.col("own.cx") == F.col("cx")) & (F.col("own.cy") == F.col("cy")) & (F.col("own.cz") == F.col("cz"))).alias("there"))


@query(f"""WITH RECURSIVE {P}, n AS (SELECT a.pid AS a, min(b.pid) AS b FROM p a JOIN p b ON b.pid < a.pid AND {D2} < 0.0036 GROUP BY a.pid) SELECT count(*) AS rows, count(*) FILTER (WHERE pid NOT IN (SELECT a FROM n)) AS clear FROM p""")
def close_repeats(spark, sf_dir):
    """All rows are there, and a point without any nearer smaller one is never called a repeat."""
    p = points(spark, sf_dir)
    x = aggregates.close_repeats(p, 0.06).select("pid", "repeated")
    near = spatial.radius_join(p, p, 0.06, strict=True).where("b.pid < a.pid").select(F.col("a.pid").alias("pid")).distinct().withColumn("near", F.lit(True))
    return x.join(near, "pid", "left").agg(F.count("*").alias("rows"), F.count(F.when(F.col("near").isNull() & ~F.col("repeated"), 1)).alias("clear"))


@query(f"""WITH {P}, s AS (SELECT pid, x AS x1, y AS y1, z AS x2, nx AS y2 FROM p) SELECT count(*) AS n, true AS whole FROM s""")
def segment_clusters(spark, sf_dir):
    """Every segment has a cluster, and each cluster is named by its own smallest core."""
    s = points(spark, sf_dir).select("pid", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("z").alias("x2"), F.col("nx").alias("y2"))
    c = graph.dbscan_segments(s, 3.0, 0.02, 3)
    named = c.where("cluster >= 0").groupBy("cluster").agg(F.max((F.col("pid") == F.col("cluster")).cast("int")).alias("own"))
    return c.agg(F.count("*").alias("n")).crossJoin(F.broadcast(named.agg(F.coalesce(F.min("own") == 1, F.lit(True)).alias("whole"))))  # one row


@query("SELECT epoch_us(ts) AS ts, event_id FROM events")
def event_times(spark, sf_dir):
    return t(spark, sf_dir, "events").select(micros("ts").alias("ts"), "event_id")
