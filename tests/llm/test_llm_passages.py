"""Suffix sorting and removal of repeated passages against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tallytree import session
from tallytree.llm import hotkeys, suffix_dedup as sd
from tallytree.llm.rawtext import CHUNK_BYTES, batches, sliding_min

from conftest import rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=30), st.sampled_from([0, 1, 2, 12]))
def test_deep_shallow_order_is_sorted_order(strings, shallow):
    order = sd.deep_shallow_order(strings, 0, shallow)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40).map(lambda b: bytes(x % 2 for x in b)), min_size=1, max_size=30))
def test_blind_trie_alone(strings):
    assert [strings[i] for i in sd.blind_order(strings, list(range(len(strings))), 0)] == sorted(strings)


def test_common_prefix():
    assert sd.common_prefix(b"a" * 200 + b"x", b"a" * 200 + b"y") == 200
    assert sd.common_prefix(b"abc", b"abc") == 3 and sd.common_prefix(b"", b"a") == 0


def test_sliding_minimum():
    values = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for width in (1, 2, 7, 100, 500):
        assert (sliding_min(values, width) == [values[i:i + width].min() for i in range(500 - width + 1)]).all()


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for b in data:
        covered = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                covered[i:i + length] = True
        kept = bytes(x for x, c in zip(b, covered) if not c)
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], covered.astype(np.int8)))) == 1))
        out.append((len(b), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, second = prose(40), prose(25)
    texts = [None, "", "short", passage, prose(100), passage[5:] + prose(30)]
    for k in range(25):
        cut = r.randint(0, 60)
        texts.append(prose(r.randint(0, 60)) + passage[cut:] + prose(20) + (second if k % 3 else second[10:-8]))
    base = prose(150)
    for _ in range(12):
        words = base.split()
        words[r.randrange(150)] = word()
        texts.append(" ".join(words))
    texts += [base, base, "ab" * 400, "ba" * 100 + prose(10), second + "|" + second, prose(30) + second]
    return texts


def test_removal_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id LONG, text STRING, n_bytes INT").repartition(4)
    want = [(i, *w) for i, w in enumerate(brute(texts, 100))]
    for crowd in (2048, 1, 4):
        out = sd.remove_repeats(docs, length=100, anchor=32, crowd=crowd)
        assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(
            want, key=lambda t: tuple((False, str(v)) for v in t)), crowd
    kept = {r.doc_id: r.kept_text for r in out.collect()}
    assert kept[0] is None and kept[1] == "" and kept[2] == "short" and len(kept[4]) == len(texts[4])


def test_hot_anchors_are_spread(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "HOT_SHARE", 1e-6)
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    got = rows(sd.remove_repeats(docs, length=100, anchor=32, crowd=4), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted([(i, *w) for i, w in enumerate(brute(texts, 100))], key=lambda t: tuple((False, str(v)) for v in t))


def test_default_length_on_longer_texts(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared = prose(90)
    texts = [prose(50) + shared[:399] + "X", prose(50) + shared[:399] + "Y", prose(200) + shared + prose(3), shared[20:] + prose(9), shared[40:500], prose(60_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    got = rows(sd.remove_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == [(i, *w) for i, w in enumerate(brute(texts, 400))]


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(str(i) for i in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text[:200])], "doc_id LONG, text STRING")
    out = rows(sd.remove_repeats(docs), "doc_id", "n_removed", "n_spans", "kept_text")
    assert out == [(1, len(text), 1, ""), (1, len(text), 1, ""), (2, 0, 0, text[:200]), (None, len(text), 1, "")]
    assert sd.remove_repeats(docs.limit(0)).count() == 0


def test_partial_characters_leave_the_text(spark):
    """The repeat starts inside the first character of the shared part: its other byte stays, the character goes."""
    shared = "".join(chr(97 + i % 26) + str(i) for i in range(30))
    texts = ["first é" + shared + "1", "second ©" + shared + "2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    out = sd.remove_repeats(docs, length=40, anchor=8).collect()
    assert {r.kept_text for r in out} == {"first 1", "second 2"} and all(r.n_removed == 1 + len(shared) for r in out)
    assert {r.kept_sha256 for r in out} == {hashlib.sha256(b).hexdigest() for b in (b"first \xc31", b"second \xc22")}


def test_only_tables_that_are_read_again_are_written(spark):
    """Every written file costs an executor memory and a process; the ranges are read once."""
    written, hook = [], lambda frame, name: written.append(name)
    session.PIN_HOOKS.append(hook)
    try:
        docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id LONG, text STRING")
        sd.repeated_spans(docs.withColumnRenamed("doc_id", "row_id"), 100, 32)
    finally:
        session.PIN_HOOKS.remove(hook)
    assert written == [f"suffix-{x}" for x in ("anchors", "keys", "hits", "around", "surroundings", "windows")]


def test_a_step_of_the_scan_holds_little():
    texts = [bytes(t) for t in np.random.default_rng(5).integers(97, 123, (128, 8192), dtype=np.uint8)]
    most = 0
    for _, part in batches(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]), "text", getattr(sd, "SCAN_BYTES", CHUNK_BYTES)):
        sd.anchors_of(part[:1], sd.LENGTH, sd.ANCHOR)  # tables that the worker keeps
        tracemalloc.start()
        sd.anchors_of(part, sd.LENGTH, sd.ANCHOR)
        most = max(most, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert most < 32e6
