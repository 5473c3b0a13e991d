"""One registered query per operator, over its whole table, beside its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from motley.llm import (bpe, fuzzy_lines, hard_negatives, license_scan, ngram_join, packing, perspectives, prefix_trie, quality_model,
                        quality_rules, simhash, topk, url_rules)
from motley.llm.common import table


def op1_quality(spark, sf_dir):
    """Quality score of every document, learnt from the labels that are not held out."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark, sf_dir):
    """Number and digest of every text's ids, and the digest of the bytes they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN,
                      emit=("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_packing(spark, sf_dir):
    """Place of every document, one token per UTF-8 byte, in sequences of three permitted sizes."""
    return packing.pack(table(spark, sf_dir, "documents"), F.octet_length("text"))


def op4_perspectives(spark, sf_dir):
    """Every dialogue from the perspective of each participant, with the spans to learn."""
    found = perspectives.render(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return found.withColumn("mask_spans", F.array_join(spans, ",")).drop("mask")


def op5_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate group of every document."""
    return simhash.groups(table(spark, sf_dir, "documents"))


def op6_fuzzy_lines(spark, sf_dir):
    """Every document without the lines that repeat, or nearly repeat, an earlier one."""
    docs = fuzzy_lines.drop_repeats(table(spark, sf_dir, "documents"), removed_col="n_removed", short=True)
    return docs.select("doc_id", "text", "n_removed")


def op7_url_filter(spark, sf_dir):
    """Rule and verdict for every page's url."""
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op9_topk(spark, sf_dir):
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return topk.search(table(spark, sf_dir, "embeddings"))


def op8_quality_rules(spark, sf_dir):
    """Counts and verdicts of the quality rules for every document."""
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).drop("failed")


def op10_license_scan(spark, sf_dir):
    """Places of phrases, and labels of phrases and templates, in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations with the totals of its subtree."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_ngram_join(spark, sf_dir):
    """Shingle count and group of near copies of every document."""
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    """Negatives near the positives of every vector whose id is divisible by 50; a seventh of the labels moves on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_packing": op3_packing,
    "op4_perspectives": op4_perspectives,
    "op5_simhash": op5_simhash,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_topk": op9_topk,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ngram_join": op12_ngram_join,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op4_perspectives": perspectives.oracle(),
    "op7_url_filter": url_rules.oracle(),
    "op8_quality_rules": quality_rules.oracle(),
    "op9_topk": topk.oracle(),
    "op11_prefix_trie": prefix_trie.oracle(),
    "op12_ngram_join": ngram_join.oracle(),
    "op13_hard_negatives": hard_negatives.oracle(),
}
