"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytree.llm import bag_minhash, decision_lists, pareto_mix, slack_packing, suffix_dedup
from tallytree.session import pin

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A repeat of this many bytes goes. Passages of 50 words and more that repeat in the given corpora have 306 bytes or more in
#: 95 of 100 cases, so the 400 bytes that suffix dedup takes by itself would miss half of them.
PASSAGE_BYTES, PASSAGE_ANCHOR = 256, 64


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a learned rule go."""
    return decision_lists.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the smallest id."""
    return bag_minhash.first_of_each_class(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of about 50 words and more that repeat go, in all their places; a document may end up empty."""
    own = docs.columns
    names = {c: f"own_{i}" for i, c in enumerate(own)}
    out = suffix_dedup.remove_repeats(
        docs.withColumnsRenamed(names), names["text"], names["doc_id"], length=PASSAGE_BYTES, anchor=PASSAGE_ANCHOR)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(new.get(c, F.col(names[c])).alias(c) for c in own))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; empty ones are not taken."""
    return pareto_mix.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return slack_packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: The stages learn rules, sort suffixes and tokenise: SQL cannot express them. Tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
