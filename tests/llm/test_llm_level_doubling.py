"""Level-wise doubling of repeated word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallytree.llm import hotkeys, level_doubling as ld

from conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    split = [WORD.findall(t or "") for t in texts]
    seen = {}
    for w in split:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def corpus(seed=5):
    r = random.Random(seed)
    prose = lambda n, letters="abcdefghé ": " ".join("".join(r.choice(letters) for _ in range(3)) for _ in range(n))
    passage, second = prose(60), prose(36)
    texts = [None, "", "  \t", "short", passage, prose(400), "\n".join(passage.split(" ")[8:]) + " " + prose(30), "x " * 90, "x " * 36 + "y"]
    for k in range(30):
        cut = passage.split(" ")[r.randint(0, 30):r.randint(40, 60)]
        texts.append(" ".join([prose(r.randint(1, 60)), *cut, prose(20), second, prose(k % 4 + 1)]))
    base = prose(200)
    for _ in range(15):
        words = base.split(" ")
        words[r.randrange(200)] = "changed" + str(r.randrange(5))
        texts.append(" ".join(words))
    texts += [base, base, second + " | " + second, prose(300, "ab"), prose(300, "ab")]
    return texts


def test_lengths():
    assert ld.level_lengths(35, 5) == [5, 10, 20, 35] and ld.level_lengths(3, 5) == [3] and ld.level_lengths(40, 5) == [5, 10, 20, 40]


@pytest.mark.parametrize("window, base", [(35, 5), (7, 2), (5, 5), (12, 1)])
def test_removal_equals_brute_force(spark, window, base):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 7, "a") for i, t in enumerate(texts)], "doc_id LONG, text STRING, n_words INT, words STRING").repartition(4)
    out = ld.remove_repeats(docs, window=window, base=base)
    assert set(out.columns) == {"doc_id", "words", "n_words", "n_removed", "kept_sha256", "kept_text"}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text or "") for r in out.collect()}
    assert got == dict(enumerate(brute(texts, window)))


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(hotkeys, "HOT_SHARE", 1e-6)
    texts = corpus(9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in ld.remove_repeats(docs).collect()}
    assert got == {i: b[:3] for i, b in enumerate(brute(texts, 35))}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    text = " ".join(str(i) for i in range(100))
    near = " ".join(str(i) for i in [*range(50), "x", *range(51, 100)])
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, near), (None, None)], "doc_id LONG, text STRING")
    want = brute([text, text, text, near, None], 35)
    out = rows(ld.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    keys = [1, 1, None, 2, None]
    assert out == sorted([(k, *w[:3]) for k, w in zip(keys, want)], key=lambda t: tuple((v is None, str(v)) for v in t))
    assert ld.remove_repeats(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(2, near), (2, near)], "doc_id LONG, text STRING")
    assert rows(ld.remove_repeats(only), "n_removed") == [(100,), (100,)]
    lone = spark.createDataFrame([(5, near)], "doc_id LONG, text STRING")
    assert rows(ld.remove_repeats(lone), "n_removed") == [(0,)]


def test_very_long_text(spark):
    r = np.random.default_rng(1)
    long = " ".join(map(str, r.integers(0, 10**6, 300_000)))
    words = long.split()
    docs = spark.createDataFrame([(0, long), (1, " ".join(words[1000:1200])), (2, " ".join(words[:34]))], "doc_id LONG, text STRING")
    assert rows(ld.remove_repeats(docs), "doc_id", "n_words", "n_removed") == [(0, 300_000, 200), (1, 200, 200), (2, 34, 0)]
