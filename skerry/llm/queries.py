"""The queries of these operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from . import bpe_transducer, budget_mix, cap_filters, chosen_path, compression_quality, divergence_rules, entropy_secrets, html_mincut, pitman_yor, reply_trees
from .common import table
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_compression_quality(spark, sf_dir):
    return compression_quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe_transducer(spark, sf_dir):
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode_decode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, ["doc_id"])


def op3_divergence_rules(spark, sf_dir):
    x = divergence_rules.judge(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_reply_trees(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return reply_trees.digest(reply_trees.format_conversations(rows.unionByName(reply_trees.probe(spark))))


def op5_html_mincut(spark, sf_dir):
    return html_mincut.extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_budget_mix(spark, sf_dir):
    x = budget_mix.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return x.select("row.doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def op7_chosen_path(spark, sf_dir):
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op8_entropy_secrets(spark, sf_dir):
    return entropy_secrets.scan(table(spark, sf_dir, "documents"))


def op9_cap_filters(spark, sf_dir):
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_pitman_yor(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_compression_quality,
        op2_bpe_transducer,
        op3_divergence_rules,
        op4_reply_trees,
        op5_html_mincut,
        op6_budget_mix,
        op7_chosen_path,
        op8_entropy_secrets,
        op9_cap_filters,
        op10_pitman_yor,
    )
}
