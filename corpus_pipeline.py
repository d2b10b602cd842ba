"""A corpus from raw documents to tokens: five stages, each read from what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lynceus.llm import bpe, decontam, quality, simhash, substring
from lynceus.llm.blocks import written
from lynceus.llm.queries import VOCABULARY, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor the learned decision list reject."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; rows of one id are one document.

    The bits of op5_simhash bind that query alone: here sets of five-word shingles are alike at 0.8.
    """
    groups = simhash.similar_texts(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that start in an earlier one too; n_chars tells the new length."""
    kept = substring.dedup(docs, carry=tuple(c for c in docs.columns if c not in ("doc_id", "text")), tidy=False)
    made = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.withColumns(made).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, reordered or not."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    coded = bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, carry=("lang", "source"))
    return coded.drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: A learned decision list, string tiling and BPE are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
