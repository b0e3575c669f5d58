"""Registered queries against SQL, and the pipeline stage by stage against brute force."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tallytree.llm.queries import ORACLE_SQL, QUERIES
from test_llm_near_dedup import brute
from test_llm_passages import brute as brute_passages

from conftest import assert_equal, open_tables, rows

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    numbers = [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES]
    assert sorted(numbers) == list(range(1, 14)) and set(ORACLE_SQL) < set(QUERIES)
    assert {*QUERIES, "pipeline"} <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = open_tables(SF_DIR)
    assert_equal(contract.queries()[name](spark, SF_DIR), con, contract.oracle_sql()[name])
    con.close()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF_DIR).cache()
        if name != "pack":
            assert after.columns == columns and [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]
        kept.append((name, before, after))
        before = after
    (_, raw, good), (_, _, single), (_, _, bare), (_, _, mixed), (_, _, packed) = kept
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    lost = raw.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("quality = 1").filter(F.size(F.split("text", "\\s+")) >= 60).count() <= 2
    texts = {r.doc_id: r.text for r in good.collect()}
    names = brute(texts)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, c in names.items() if i == c)
    one = single.orderBy("doc_id").collect()
    left = {r.doc_id: r for r in bare.collect()}
    for r, (n_bytes, n_removed, _, _) in zip(one, brute_passages([r.text for r in one], corpus_pipeline.PASSAGE_BYTES)):
        assert len(left[r.doc_id].text.encode()) <= n_bytes - n_removed and left[r.doc_id].n_chars == len(left[r.doc_id].text)
        assert (left[r.doc_id].text == r.text) == (n_removed == 0)
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2 and set(times) <= set(left)
    assert Counter(r.doc_id for r in packed.filter("piece = 0").collect()) == times


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and filled.filter("n > 1024").isEmpty()
    again = corpus_pipeline.run(spark, SF_DIR)
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(out, *keys) == rows(again, *keys)


def test_planted_passages_go_and_clean_documents_stay(spark):
    """Passages of 51 to 70 words in many documents, some three times; prose that occurs once keeps every character."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(max(1, int(r.gauss(5, 2)))))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(n) for n in range(51, 71)]
    texts, holds = [prose(r.randint(5, 400)) for _ in range(150)], {}
    for i in range(150, 270):
        p = planted[i % 20]
        texts.append(f"{prose(r.randint(0, 200))} {p} {prose(r.randint(0, 200))}")
        holds[i] = p
    schema = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, spans INT, kept_text STRING, n_bytes INT"
    docs = spark.createDataFrame([(i, t, "en", None, len(t), 1, "x", 2) for i, t in enumerate(texts)], schema).repartition(5)
    out = corpus_pipeline.passage_dedup(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert all(got[i] == texts[i] for i in range(150))
    for i, p in holds.items():
        assert p not in got[i] and len(got[i]) >= len(texts[i]) - len(p) - 20
