"""Small text and binary formats: sparse tables, raw vectors, camera files, grey and colour rasters, colour scales."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header of a sparse table, and that of a camera colour scale's root element.
SPARSE_HEADER = "SPT 0.2"


def write_sparse(table: DataFrame, path: str) -> None:
    """One folder of text: a first line with the header, columns, rows and entries; then one line `column row value` each."""
    n = table.agg(F.coalesce(F.max("col") + 1, F.lit(0)).alias("c"), F.coalesce(F.max("row") + 1, F.lit(0)).alias("r"), F.count("*").alias("n"))
    head = n.select(F.format_string(f"{SPARSE_HEADER} %d %d %d", "c", "r", "n").alias("value"))
    body = table.select(F.concat_ws(" ", F.col("col").cast("string"), F.col("row").cast("string"), F.col("value").cast("string")).alias("value"))
    head.coalesce(1).write.text(f"{path}/header")
    body.write.text(f"{path}/entries")


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """col, row, value. Raises when the header isn't that of a sparse table."""
    head = spark.read.text(f"{path}/header").first()
    if head is None or not head["value"].startswith(SPARSE_HEADER):
        raise ValueError(f"{path} holds no sparse table")
    w = F.split("value", " ")
    return spark.read.text(f"{path}/entries").select(F.get(w, F.lit(0)).cast("int").alias("col"), F.get(w, F.lit(1)).cast("int").alias("row"), F.get(w, F.lit(2)).cast("double").alias("value"))


def floats_of(content: Column, width: int = 4) -> Column:
    """A binary column of little-endian floats (4 bytes) or doubles (8) as an array of doubles, in the JVM: sign, exponent and
    fraction are taken from the bits. A rest shorter than a number is passed over."""
    hexed, n = F.hex(content), F.floor(F.octet_length(content) / width).cast("int")
    at = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n)
    byte = lambda i, k: F.conv(F.substr(hexed, 2 * (i * width + k) + 1, F.lit(2)), 16, 10).cast("long")

    def number(i: Column) -> Column:
        bits = sum((F.shiftleft(byte(i, k), 8 * k) for k in range(width)), F.lit(0).cast("long"))
        size, bias, top = (23, 127, 0xFF) if width == 4 else (52, 1023, 0x7FF)
        sign = F.when(F.shiftright(bits, 8 * width - 1).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        power = F.shiftright(bits, size).bitwiseAND(F.lit(top))
        part = bits.bitwiseAND(F.lit((1 << size) - 1)).cast("double") / float(1 << size)
        usual = sign * (1.0 + part) * F.pow(F.lit(2.0), (power - bias).cast("double"))
        tiny = sign * part * F.pow(F.lit(2.0), F.lit(float(1 - bias)))
        odd = F.when(part == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
        return F.when(power == top, odd).when(power == 0, tiny).otherwise(usual)

    return F.transform(at, number)


def read_vectors(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """path, data: one row per file of raw little-endian numbers."""
    return spark.read.format("binaryFile").load(path).select("path", floats_of(F.col("content"), width).alias("data"))


def camera_text(t: Column, r: Column, f: Column) -> Column:
    """A camera file's two lines: translation and rotation row by row; focal length with five fixed numbers of a plain pinhole."""
    number = lambda c: c.cast("double").cast("string")
    first = F.concat_ws(" ", *[number(t[c]) for c in "xyz"], *[number(F.get(r, F.lit(k))) for k in range(9)])
    return F.concat(first, F.lit("\n"), F.concat_ws(" ", number(f), F.lit("0 0 1 0.5 0.5")), F.lit("\n"))


def parsed_camera(text: Column) -> Column:
    """t, r, f of a camera file's text; NULL without all its numbers."""
    w = F.filter(F.split(text, r"\s+"), lambda s: s != "")
    n = F.transform(w, lambda s: s.try_cast("double"))
    t = F.struct(*[F.get(n, F.lit(k)).alias(c) for k, c in enumerate("xyz")])
    return F.when(F.size(n) >= 13, F.struct(t.alias("t"), F.slice(n, 4, 9).alias("r"), F.get(n, F.lit(12)).alias("f")))


def scale_xml(name: Column, stops: Column) -> Column:
    """A colour scale as XML: stops are structs (pos, r, g, b)."""
    step = F.transform(stops, lambda s: F.format_string('<step pos="%s" r="%d" g="%d" b="%d"/>', s.pos.cast("string"), s.r, s.g, s.b))
    safe = F.replace(F.replace(F.replace(name, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<scale name="'), safe, F.lit('">'), F.array_join(step, ""), F.lit("</scale>"))


def parsed_scale(xml: Column) -> Column:
    """name and stops of such a scale."""
    text = lambda path: F.xpath(xml, F.lit(path))
    number = lambda c: F.transform(text(f"/scale/step/@{c}"), lambda v: v.cast("double"))
    stops = F.zip_with(F.arrays_zip(number("pos").alias("pos"), number("r").alias("r")), F.arrays_zip(number("g").alias("g"), number("b").alias("b")), lambda p, q: F.struct(p.pos.alias("pos"), p.r.cast("int").alias("r"), q.g.cast("int").alias("g"), q.b.cast("int").alias("b")))
    return F.struct(F.xpath_string(xml, F.lit("/scale/@name")).alias("name"), stops.alias("stops"))


def scale_table(stops: list[tuple[float, tuple[int, int, int]]], size: int = 1024) -> list[tuple[int, int, int]]:
    """A colour scale sampled at `size` even places from 0 to 1, between stops by straight lines."""
    out = []
    for k in range(size):
        p, colour = k / (size - 1), stops[-1][1]
        for (a, x), (b, y) in zip(stops, stops[1:], strict=False):
            if p <= b:
                share = min(max((p - a) / (b - a), 0.0), 1.0) if b > a else 1.0
                colour = tuple(int(u + (v - u) * share + 0.5) for u, v in zip(x, y, strict=True))
                break
        out.append(tuple(colour))
    return out


RASTER = "path string, width int, height int, channels int, most int, data array<int>"


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, most, data: binary or plain grey and colour maps (P2, P3, P5, P6), 8 or 16 bits, a file a row."""
    import numpy as np

    def decode(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                words, at = [], 0
                while len(words) < 4:
                    while content[at : at + 1].isspace():
                        at += 1
                    if content[at : at + 1] == b"#":
                        at = content.index(b"\n", at)
                        continue
                    end = at
                    while not content[end : end + 1].isspace():
                        end += 1
                    words.append(content[at:end])
                    at = end
                kind, (w, h, most) = words[0], map(int, words[1:])
                channels = 3 if kind in (b"P3", b"P6") else 1
                if kind in (b"P2", b"P3"):
                    data = np.array(content[at:].split(), int)
                else:
                    data = np.frombuffer(content, ">u2" if most > 255 else "u1", w * h * channels, at + 1)
                rows.append((name, w, h, channels, most, data[: w * h * channels].astype(np.int32)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "most", "data"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.p[gpn]m").load(path).select("path", "content").mapInPandas(decode, RASTER)


def pnm_bytes(width: int, height: int, data: list[int], most: int = 255) -> bytes:
    """A grey map's file."""
    import numpy as np

    return f"P5\n{width} {height}\n{most}\n".encode() + np.array(data).astype(">u2" if most > 255 else "u1").tobytes()


def choice(text: str, options: list[str]) -> str:
    """One of the named options; raises with all of them for any other text."""
    if text not in options:
        raise ValueError(f"{text!r} is none of {', '.join(options)}")
    return text
