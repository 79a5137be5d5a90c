"""A corpus pipeline: quality rules, line dedup, near-dedup, source mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before has kept;
between stages the documents are written to the shared folder and read again.  Columns of
`documents` stay as they are, but for `n_chars`, which follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from stayledger.llm import bpe_automaton, line_frequency, line_runs, simhash, source_mix
from stayledger.llm.common import table
from stayledger.plans.shared import cut


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the lines that are common on their host."""
    return _measured(line_frequency.clean(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; emptied documents go with them."""
    cleaned = line_runs.without_repeats(docs)
    return _measured(cleaned.where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_of_each(docs).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time up to the budget's last word."""
    return _measured(source_mix.mixed(docs), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("source_mixing", source_mixing), ("tokens", tokens)]

#: Suffix arrays, fingerprints and merges are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
