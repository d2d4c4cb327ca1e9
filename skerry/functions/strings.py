"""Text and path helpers as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_compress(s: Column, delimiters: str) -> Column:
    """Parts between any of the delimiter characters; runs of them count once, empty ends go."""
    return F.filter(F.split(s, "[" + re.escape(delimiters) + "]+"), lambda p: p != "")


def with_slash(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What stands before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"\.([^.]*)$", 1)


def without_last_token(name: Column) -> Column:
    return F.regexp_replace(name, r"_[^_]*$", "")


def base_names(paths: Column) -> Column:
    return F.transform(paths, base_name)


def same_base_name(a: Column, b: Column) -> Column:
    return base_name(a) == base_name(b)


def index_of(items: Column, value: Column) -> Column:
    """Place of the first equal item from 0, or -1."""
    return F.coalesce(F.array_position(items, value) - 1, F.lit(-1).cast("long"))


def find(s: Column, part: Column) -> Column:
    """Place of the first occurrence from 0, or -1; an empty part is found nowhere."""
    return F.when(F.length(part) == 0, -1).otherwise(F.instr(s, part) - 1)


def starts_with_digit(s: Column) -> Column:
    return s.rlike("^[0-9]")


def is_solid(s: Column) -> Column:
    """No blank, return, tab or newline anywhere."""
    return ~s.rlike(r"[ \r\t\n]")


def ordinal(n: Column) -> Column:
    teen = F.pmod(n, F.lit(100)).between(11, 13)
    last = F.pmod(n, F.lit(10))
    return F.concat(n.cast("string"), F.when(teen, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th"))


def fixed(v: Column) -> Column:
    """A double with three decimals as C prints it: by its exact binary value, exact halves to the even digit, the sign of
    -0.0 and of negatives that round to zero kept; nan, inf and -inf in words (a NaN's sign can't be seen here); NULL for
    NULL. From 2^63 on the digits are those of the shortest text, filled up with zeros."""
    size = F.abs(v)
    a = F.when(size < 2.0**63, size)
    whole = F.floor(a)
    part = (a - whole.cast("double")) * 2.0**26  # its first 26 bits and the rest times 1000 are both exact
    high = F.floor(part)
    n, left = F.shiftright(high * 1000, 26), (high * 1000).bitwiseAND(F.lit((1 << 26) - 1))
    rest, half = (part - high.cast("double")) * 1000.0, (F.lit(1 << 25) - left).cast("double")
    n = n + F.when((rest > half) | ((rest == half) & (n % 2 == 1)), 1).otherwise(0)
    text = F.concat((whole + F.floor(n / 1000)).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))
    text = F.when(size == math.inf, "inf").when(F.isnan(v), "nan").otherwise(F.coalesce(text, F.format_string("%.3f", size)))
    return F.when(v.isNotNull(), F.concat(F.when((v < 0) | ((v == 0) & (v.cast("string") == "-0.0")), "-").otherwise(""), text))


def equation(a: Column, b: Column, c: Column) -> Column:
    """NULL if a number is missing."""
    return F.concat(fixed(a), F.lit(" * x + "), fixed(b), F.lit(" * y + "), fixed(c), F.lit(" = 0"))


def natural_order(name: Column, all_numeric: Column) -> list[Column]:
    """Sort keys for names: by leading number when all names have one, else by text."""
    number = F.when(all_numeric, F.regexp_extract(name, "^([0-9]+)", 1).try_cast("bigint"))
    return [number.asc_nulls_last(), name.asc()]
