"""Shared pieces of the training-data operators: tables, words and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.iterate import Scratch, components, let, small

__all__ = ["WORD", "Scratch", "components", "fold", "let", "small", "table"]

#: Words of every operator here: runs of anything but blank, tab, newline, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column | str, of: int = 5) -> Column:
    """crc32 of the id's decimal text, modulo `of`; a null id falls in fold 0."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(of)
