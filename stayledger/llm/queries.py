"""One query per operator: the whole intended table, production parameters, full result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe_automaton, dual_tree, embedding_dedup, html_wrapper, line_frequency, line_runs, masked_lm, ordinal_quality, pii_anchors, simhash,
               source_mix, token_alignment, toxicity)
from .common import table
from .oracles import ORACLES


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.fit(docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.quality(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned texts, with the number of lines each has lost."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.without_repeats(docs).select("doc_id", "n_removed", "text")


def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe_automaton.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratings = ordinal_quality.graded(table(spark, sf_dir, "labels"))
    return ordinal_quality.grade(docs, ordinal_quality.fit(docs, ratings))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_anchors.digest(pii_anchors.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_source_mix, op3_lm_scoring, op4_simhash_near_dedup, op5_quality_rules,
                                   op6_html_extraction, op7_toxicity, op8_line_dedup, op9_bpe_automaton, op10_quality_classifier,
                                   op11_token_alignment, op12_pii_anchors, op13_ranked_search)}

__all__ = ["ORACLES", "QUERIES"]
