"""From raw documents to token ids, stage after stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe_transducer, budget_mix, chosen_path, divergence_rules, entropy_secrets
from skerry.llm.common import Scratch

#: The stages sample similarity by hashed paths and take hashed prefixes, which SQL can't say; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The whole row goes through the rules in the place of its id.

    Null, empty and short texts go (under 50 words); very long ones are judged whole. Each of repeated rows is judged for
    itself. Other columns come out as they went in, whatever their names. An empty table gives an empty one.
    """
    judged = divergence_rules.judge(docs.select(F.struct("*").alias("doc_id"), "text", "lang"))
    return judged.where("kept").select("doc_id.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that of the smallest id (nulls last), one row if it is repeated.

    Texts without words (null, empty, blank) are near to nothing and stay. Rows without an id take part like others.
    Other columns come out as they went in. An empty table gives an empty one.
    """
    return chosen_path.first_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked; the length follows the text (null for a null text, which stays null).

    Every row stays, repeated ones too, with its other columns, but n_chars is counted anew. Long texts are masked whole.
    """
    return entropy_secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents to the target weights; one taken in two epochs is there twice, one not taken is gone.

    Null and empty texts have no tokens and go with the prefix they fall in; null languages and sources are nodes of their
    own. Repeated rows count each for itself. Other columns come out as they went in. An empty table gives an empty one.
    """
    taken = budget_mix.mix_documents(docs).where("epochs > 0")
    return taken.select("row.all", F.explode(F.sequence(F.lit(1), F.col("epochs").cast("int")))).select("all.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and whether they decode to its text. Workers stay between stages, so they keep less.

    A null or empty text has no ids and decodes to itself. Each row gives one row, in whole, with doc_id, lang and source.
    """
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode(docs, path, public_tokenizers.PATTERN, ["doc_id", "lang", "source"], kept=bpe_transducer.KEPT_LESS)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written as Parquet to the shared folder and read again by the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = scratch.cut(docs)
    return docs
