"""The mix against its own arithmetic, packing by round trip and exact subset sums."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallytree.llm import pareto_mix, slack_packing
from tallytree.llm.queries import QUERIES

from conftest import rows

SF_DIR = "/root/testdata/sf0.01"


def mix(docs):
    return pareto_mix.copies(docs, "source", F.col("doc_id"), pareto_mix.word_count("text"))


def test_sources_come_near_their_targets(spark):
    r = random.Random(1)
    data = [(i, " ".join("w" * 3 for _ in range(r.choice((0, 3, 50, 400)))), r.choice(["a", "b", "é", "z", None, "hot", "hot", "hot"])) for i in range(1500)]
    docs = spark.createDataFrame(data, "doc_id LONG, text STRING, source STRING").selectExpr("*", "'x' AS size", "1 AS rank", "2 AS target")
    safe = docs.select("doc_id", "text", "source")
    out = mix(safe).withColumn("words", F.col("n_copies") * F.col("size"))
    found = out.groupBy("source").agg(F.sum("words").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.sum("size").alias("check"))
    total = 0.0
    for row in found.collect():
        assert row.check == row.size and row.target <= 2 * row.size + 1e-6
        assert abs(row.taken - row.target) <= 400
        total += row.target
    assert abs(total - 1.5 * sum(len(t.split()) for _, t, _ in data)) < 1e-3
    assert out.filter("n_copies < 0 OR n_copies > 2").isEmpty()
    assert rows(out.select("doc_id", "n_copies")) == rows(mix(safe.repartition(7)).select("doc_id", "n_copies"))
    # The mix keeps the columns of the documents, clashing names included.
    mixed = pareto_mix.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == out.agg(F.sum("n_copies")).first()[0]


def test_weights_follow_code_points_and_fill_up(spark):
    text = lambda n: " ".join("w" for _ in range(n))
    docs = spark.createDataFrame(
        [(1, text(10), None), (2, text(10), "b"), (3, text(10), "B"), (4, text(200), "c")], "doc_id LONG, text STRING, source STRING")
    # B 5, b 2, c 1, null 5 share 345: B, b and null fill at 20 each, c takes the rest.
    found = {r.source: r.target for r in mix(docs).collect()}
    assert found == {"B": 20.0, "b": 20.0, None: 20.0, "c": 285.0}


def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None), (2, " ", None)], "doc_id LONG, text STRING, source STRING")
    assert rows(mix(docs), "doc_id", "size", "target", "n_copies") == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mix(docs.limit(0)).count() == 0


def test_inclusion_follows_the_expected_copies(spark):
    """Over many seeds a document is taken as often as its expected number of copies says."""
    data = [(i, " ".join("w" for _ in range(20 + 40 * (i % 3))), "a") for i in range(60)] + [(1000 + i, "w " * 30, "b") for i in range(120)]
    docs = spark.createDataFrame(data, "doc_id LONG, text STRING, source STRING").repartition(1).cache()
    taken = defaultdict(list)
    for seed in range(6):
        for row in pareto_mix.copies(docs, "source", F.col("doc_id"), pareto_mix.word_count("text"), str(seed)).collect():
            taken[row.source, row.size].append(row.n_copies)
    mean = {k: np.mean(v) for k, v in taken.items()}
    assert mean["a", 20] <= mean["a", 60] + 0.15 and mean["a", 60] <= mean["a", 100] + 0.15


# Packing

@pytest.mark.parametrize("seed", range(5))
def test_fullest_sum_is_the_best(seed):
    r = random.Random(seed)
    lengths = [r.randint(1, 30) for _ in range(9)]
    counts = np.bincount(lengths, minlength=64)
    for room in (5, 17, 40, 60):
        best = max(s for n in range(10) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= room)
        chosen = slack_packing.fullest(counts, sorted(set(lengths)), room)
        assert sum(chosen) == best and all(chosen.count(x) <= counts[x] for x in chosen)


def test_sequences_hold_every_piece_once():
    lengths = np.random.default_rng(2).integers(1, 1025, 3000)
    sequence, offset = slack_packing.pack_lengths(lengths)
    rows_ = defaultdict(list)
    for n, s, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        rows_[s].append((o, n))
    for parts in rows_.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    # No packing can do with fewer than the tokens fill, or than there are pieces over half a sequence.
    least = max(-(-lengths.sum() // 1024), (lengths > 512).sum())
    assert len(rows_) <= 1.007 * least + 1


def test_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(slack_packing.paths()[0])
    texts = [None, "", "hello world", "a<|endoftext|>b", "x " * 5000, "ünïcode ☃ " * 700, "same", "same"]
    docs = spark.createDataFrame([(i if i < 7 else 6, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING").selectExpr("*", "1 AS piece", "'x' AS ids")
    out = slack_packing.pack_documents(docs, keep_ids=True).collect()
    whole = defaultdict(list)
    for r in out:
        assert len(r.ids) == r.length <= 1024 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        whole[r.doc_id].append((r.start, r.piece, r.ids, r.length))
    for i, t in enumerate(texts[:6]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        parts = sorted(whole[i])
        assert [x for p in parts for x in p[2]] == ids and [p[1] for p in parts] == list(range(len(parts)))
        assert all(p[3] == 1024 for p in parts[1:]) and [p[0] for p in parts] == [0, *np.cumsum([p[3] for p in parts])[:-1]]
    assert len(whole[6]) == 2
    assert slack_packing.pack_documents(docs.limit(0)).count() == 0


def test_query_fills_its_sequences(spark):
    out = QUERIES["op5_slack_packing"](spark, SF_DIR)
    found = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count_distinct("offset").alias("places"), F.count("*").alias("parts"))
    assert found.filter("n <> end OR n > 1024 OR places <> parts").isEmpty()
    total, sequences = out.agg(F.sum("length")).first()[0], found.count()
    assert sequences <= 1.01 * total / 1024 + 1
    assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_encoder_without_ranks_is_the_library():
    vocabulary, ranks = slack_packing.paths()
    texts = ["plain text", "<|endoftext|>", "é你 123"]
    assert slack_packing.Encoder(vocabulary).encode(texts) == slack_packing.Encoder(vocabulary, ranks).encode(texts)
