"""The registered queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytree.llm import (
    bag_minhash, byte_cnn, decision_lists, embedding_forest, html_blocks, interval_labels, level_doubling,
    pairwise_quality, parallel_viterbi, pareto_mix, slack_packing, sql, suffix_dedup, warc_index,
)

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
#: SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_bag_minhash": sql.BAG_MINHASH,
    "op2_embedding_forest": sql.EMBEDDING_FOREST,
    "op4_pareto_mix": sql.PARETO_MIX,
    "op10_warc_index": sql.WARC_INDEX,
    "op11_level_doubling": sql.LEVEL_DOUBLING,
    "op12_parallel_viterbi": sql.PARALLEL_VITERBI,
    "op13_interval_labels": sql.INTERVAL_LABELS,
}


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_embedding_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of every vector."""
    return embedding_forest.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_decision_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the verdict of the learned rules for every document."""
    return decision_lists.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")


@query
def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = pareto_mix.copies(docs, "source", F.col("doc_id"), pareto_mix.word_count("text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


@query
def op5_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document stands."""
    return slack_packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_blocks.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated passages take from every document, and the text that it keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs).withColumn("text", F.coalesce("kept_text", F.lit(""))).drop("kept_text")


@query
def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return pairwise_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return byte_cnn.identified(table(spark, sf_dir, "documents"))


@query
def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, from the merged index of their archives."""
    out = warc_index.capture_history(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op11_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated runs of 35 words take from every document, and the words that it keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return level_doubling.remove_repeats(docs).withColumn("text", F.coalesce("kept_text", F.lit(""))).drop("kept_text")


@query
def op12_parallel_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return parallel_viterbi.repaired(talks, parallel_viterbi.damaged(talks))


@query
def op13_interval_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in the manifest, with a check of its proof."""
    return interval_labels.manifest(table(spark, sf_dir, "documents"))
