"""Rasters as tables (img, i, j, v): neighbourhoods are joins on shifted cells, pyramids and distances are grouped passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.plans.iterate import Scratch

KEY = ["img", "i", "j"]


def scattered(df: DataFrame, reach: int = 1, cross: bool = False) -> DataFrame:
    """Each cell's value at the cells around it."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if not cross or abs(a) + abs(b) <= reach]
    at = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps])
    x = df.select("img", "i", "j", "v", F.explode(at).alias("s"))
    return x.select("img", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"), "v", (F.abs("s.a") + F.abs("s.b")).alias("steps"))


def dilated(df: DataFrame) -> DataFrame:
    """Greatest value in the 3x3 square, over the cells there are."""
    return scattered(df).groupBy(*KEY).agg(F.max("v").alias("v")).join(df.select(*KEY), KEY, "left_semi")


def eroded(df: DataFrame) -> DataFrame:
    return scattered(df).groupBy(*KEY).agg(F.min("v").alias("v")).join(df.select(*KEY), KEY, "left_semi")


def box_mean(df: DataFrame, reach: int = 1) -> DataFrame:
    return scattered(df, reach).groupBy(*KEY).agg(F.avg("v").alias("v")).join(df.select(*KEY), KEY, "left_semi")


def filled(df: DataFrame, rounds: int) -> DataFrame:
    """Cells without a value take the mean of their valued neighbours, from the rims inwards, for some rounds."""
    scratch, now = Scratch(df.sparkSession), df.select(*KEY, F.col("v").cast("double").alias("v"))
    for _ in range(rounds):
        near = scattered(now.where("v is not null")).groupBy(*KEY).agg(F.avg("v").alias("m"))
        now, _ = scratch.cut(now.join(near, KEY, "left").select(*KEY, F.coalesce("v", "m").alias("v")))
        if not now.where("v is null").limit(1).count():
            break
    return now


def pyramid_level(df: DataFrame) -> DataFrame:
    """Half the size: means of 2x2 cells."""
    return df.groupBy("img", F.floor(F.col("i") / 2).alias("i"), F.floor(F.col("j") / 2).alias("j")).agg(F.avg("v").alias("v"))


def gradients(df: DataFrame) -> DataFrame:
    """Central differences; NULL at the rims."""
    wi, wj = Window.partitionBy("img", "j").orderBy("i"), Window.partitionBy("img", "i").orderBy("j")
    return df.withColumn("di", (F.lead("v").over(wi) - F.lag("v").over(wi)) / 2.0).withColumn("dj", (F.lead("v").over(wj) - F.lag("v").over(wj)) / 2.0)


def block_thresholds(df: DataFrame, block: int = 32, share: float = 0.5, extra: float = 7.0) -> DataFrame:
    """img, bi, bj, threshold: the blocks' quantile of v plus a constant, averaged over the 3x3 blocks around, squared."""
    b = [F.floor(F.col(c) / block).alias(c) for c in "ij"]
    q = df.groupBy("img", *b).agg((F.expr(f"percentile(v, {share})") + extra).alias("v"))  # block * block values at most
    return box_mean(q).select("img", F.col("i").alias("bi"), F.col("j").alias("bj"), (F.col("v") * F.col("v")).alias("threshold"))


def best_of_blocks(df: DataFrame, block: int) -> DataFrame:
    """The cell of greatest v per block, ties to the first cell; at block sizes 1, 2 and 4 times `block` with `level`."""
    out = None
    for level in range(3):
        size = block << level
        b = [F.floor(F.col(c) / size).alias(f"b{c}") for c in "ij"]
        best = df.groupBy("img", *b).agg(F.max_by(F.struct("i", "j", "v"), F.struct("v", -F.col("i"), -F.col("j"))).alias("m"))
        best = best.select("img", F.lit(level).alias("level"), "m.*")
        out = best if out is None else out.unionByName(best)
    return out


def squared_distances(df: DataFrame, most: int | None = None) -> DataFrame:
    """img, i, j, d2: exact squared distance of each cell to the nearest set one (v > 0), up to `most` cells if given: two
    axis passes, each a grouped minimum, as in separable transforms. Without `most` the first pass looks both ways along
    each column of the rows there are, and the second compares a row's cells with its columns. Images without a set cell
    give no rows."""
    if most is None:
        grid = df.select("img", "i").distinct().join(df.where("v > 0").select("img", "j").distinct(), "img")
        on = df.where("v > 0").select(*KEY, F.col("i").alias("at"))
        way = Window.partitionBy("img", "j").orderBy("i")
        before = F.last("at", True).over(way.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first("at", True).over(way.rowsBetween(0, Window.unboundedFollowing))
        first = grid.join(on, KEY, "left").select(*KEY, F.least(F.col("i") - before, after - F.col("i")).cast("long").alias("g"))
        cols = first.select("img", "i", F.col("j").alias("k"), (F.col("g") * F.col("g")).alias("d2"))
        return df.select(*KEY).join(cols, ["img", "i"]).groupBy(*KEY).agg(F.min(F.col("d2") + (F.col("j") - F.col("k")) * (F.col("j") - F.col("k"))).alias("d2"))
    span = F.sequence(F.lit(-most), F.lit(most))
    rows = df.where("v > 0").select("img", "i", "j", F.explode(span).alias("s"))
    first = rows.groupBy("img", (F.col("i") + F.col("s")).alias("i"), "j").agg(F.min(F.col("s") * F.col("s")).alias("d2"))
    cols = first.select("img", "i", "j", "d2", F.explode(span).alias("s"))
    both = cols.groupBy("img", "i", (F.col("j") + F.col("s")).alias("j")).agg(F.min(F.col("d2") + F.col("s") * F.col("s")).alias("d2"))
    return df.select(*KEY).join(both, KEY).where(F.col("d2") <= most * most)


def chamfer_distances(df: DataFrame, most: int | None = None) -> DataFrame:
    """img, i, j, steps: city-block distance to the nearest set cell by rounds of growth, until no cell is reached any more
    or for `most` rounds."""
    scratch = Scratch(df.sparkSession)
    cells, _ = scratch.cut(df.select(*KEY))
    done, path = scratch.cut(df.where("v > 0").select(*KEY, F.lit(0).alias("steps")))
    front, k = done, 0
    while most is None or k < most:
        k += 1
        grown = scattered(front.select(*KEY, F.lit(1).alias("v")), cross=True).select(*KEY).distinct()
        front, _ = scratch.cut(grown.join(cells, KEY, "left_semi").join(done, KEY, "left_anti").withColumn("steps", F.lit(k)))
        if not front.limit(1).count():
            break
        old = path
        done, path = scratch.cut(done.unionByName(front))
        if k > 1:
            scratch.drop(old)
    return done


def image_components(df: DataFrame, wrap: int | None = None) -> DataFrame:
    """img, i, j, component of set cells, 8-connected; `wrap` joins column 0 to the last of that many."""
    from .graph import connected

    n = 1 << 20
    j = F.pmod(F.col("j"), F.lit(wrap)) if wrap else F.col("j")
    code = lambda c: F.col("img").cast("long") * (n * n) + F.col("i") * n + c
    on = df.where("v > 0").select(*KEY)
    a = on.withColumn("id", code(F.col("j")))
    near = scattered(on.withColumn("v", code(F.col("j")))).select(code(j).alias("b"), F.col("v").alias("a"))
    e = near.join(a.select(F.col("id").alias("b")), "b", "left_semi").where("a < b")
    return a.join(connected(e, a.select("id")), "id").select(*KEY, F.col("component_id").alias("component"))


def z_buffer(points: DataFrame, step: float) -> DataFrame:
    """i, j, pid, range: of points yaw, pitch, range, the nearest per angular cell."""
    cell = [F.floor(F.col(c) / step).alias(n) for c, n in (("yaw", "i"), ("pitch", "j"))]
    return points.groupBy(*cell).agg(F.min_by(F.struct("pid", "range"), F.struct("range", "pid")).alias("m")).select("i", "j", "m.*")


def corrected(df: DataFrame, response: list[float], vignette: DataFrame | None = None) -> DataFrame:
    """Grey values through an inverse response table, over a vignette table (i, j, w)."""
    table = F.array(*[F.lit(float(v)) for v in response])
    x = df.withColumn("v", F.get(table, F.least(F.greatest(F.col("v"), F.lit(0)), F.lit(len(response) - 1)).cast("int")))
    if vignette is None:
        return x
    return x.join(vignette, ["i", "j"]).withColumn("v", F.try_divide("v", "w")).drop("w")


def packed(sizes: DataFrame, width: int) -> list[tuple[int, int, int, int]]:
    """Shelf packing of rectangles (id, w, h) by falling height: (id, shelf, x, y). Patches of one atlas, a driver-side list."""
    out, x, y, tall = [], 0, 0, 0
    shelf = 0
    for r in sorted(sizes.collect(), key=lambda r: (-r["h"], -r["w"], r["id"])):
        if x + r["w"] > width:
            x, y, tall, shelf = 0, y + tall, 0, shelf + 1
        out.append((r["id"], shelf, x, y))
        x, tall = x + r["w"], max(tall, r["h"])
    return out


def atlas_size(sizes: DataFrame, least: int = 256, most: int = 8192) -> DataFrame:
    """One row, side: the smallest power of two that holds the total area and the longest side."""
    a = sizes.agg(F.sum(F.col("w") * F.col("h")).alias("area"), F.max(F.greatest("w", "h")).alias("side"))
    need = F.greatest(F.sqrt("area"), F.col("side").cast("double"), F.lit(float(least)))
    return a.select(F.least(F.pow(F.lit(2.0), F.ceil(F.log2(need))), F.lit(float(most))).cast("int").alias("side"))
