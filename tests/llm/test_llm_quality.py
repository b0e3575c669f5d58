"""Rules, ranking and language identification: statistics by brute force, verdicts by held-out accuracy."""

import contextlib
import io
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallytree import session
from tallytree.llm import byte_cnn, decision_lists, pairwise_quality
from tallytree.llm.rawtext import WordGrid

from conftest import rows

SF_DIR = "/root/testdata/sf0.01"
ODD = ["", None, " \n\t ", "one", "a b", "a b c a b c", "x\nx\n\n\nx \ny", "a b c d a b c", "é#ü €|$", "\x0b\x0ca\rb", "line\r\nline\r\n", "w " * 5000]


def counted(text):
    text = text or ""
    words = [w for w in re.split("[ \t-\r]+", text) if w]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i:i + 3])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_statistics_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(ODD)], "doc_id LONG, text STRING")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for row in decision_lists.statistics(docs.unionByName(odd)).collect():
        assert tuple(row[n] for n in names) == counted(row.text), row.text


def plan_of(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def test_rules_catch_bad_and_keep_good_documents_natively(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    plans = []
    session.PIN_HOOKS.append(lambda df, name: plans.append(plan_of(df)))
    try:
        out = decision_lists.judged(docs, labels)
    finally:
        session.PIN_HOOKS.pop()
    plans.append(plan_of(out))
    assert len(plans) > 1 and not any(re.search("Python|Pandas|Arrow", p) for p in plans)
    judged = out.join(labels, "doc_id").filter(~F.col("base_failed")).groupBy("quality", "kept").count()
    n = {(r.quality, r.kept): r["count"] for r in judged.collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert out.filter("base_failed AND kept").isEmpty()
    assert out.filter("base_failed <> (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)").isEmpty()
    caught, bad = n.get((0, False), 0), n.get((0, False), 0) + n.get((0, True), 0)
    if caught < 0.6 * bad:
        pytest.xfail(f"the rules catch {caught} of {bad} bad documents, the aim is 0.6 of them")


def test_rules_without_labels_and_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g " * 3 + " ".join(map(str, range(60))), "x"), (None, None, "y"), (2, "", None), (1, "short", "z")], "doc_id LONG, text STRING, n_words STRING")
    labels = spark.createDataFrame([], "doc_id LONG, quality INT")
    out = decision_lists.judged(docs.drop("n_words"), labels)
    assert rows(out, "doc_id", "base_failed", "kept") == [(1, False, True), (1, True, False), (2, True, False), (None, True, False)]
    assert rows(decision_lists.keep_good(docs, labels), "n_words") == [("x",)]
    assert decision_lists.judged(docs.limit(0), labels).count() == 0


def test_conditions_read_as_rules():
    rule = decision_lists.DecisionList([[decision_lists.Condition("words", True, 9.0), decision_lists.Condition("upper_share", False, 0.5)]])
    assert str(rule) == "words >= 9 AND upper_share < 0.5"


def test_word_grid_counts_words():
    texts = [(t or "").encode() for t in ODD]
    assert WordGrid(texts).count.tolist() == [counted(t)[0] for t in ODD]
    row, shingle = WordGrid([b"a b c d", b"a b c d", b"a b", b""]).shingles(3)
    assert row.tolist() == [0, 0, 1, 1, 2] and shingle[0] == shingle[2] and len(set(shingle.tolist())) == 3


def test_measures_do_not_depend_on_company():
    texts = [(t or "").encode() for t in ODD]
    whole = pairwise_quality.measures_of(texts)
    for i, t in enumerate(texts):
        assert np.allclose(pairwise_quality.measures_of([t])[0], whole[i])
    assert np.isfinite(whole).all()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    out = pairwise_quality.scored(docs.drop("lang", "source"), labels)
    assert out.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").isEmpty() and out.count() == docs.count()
    held = out.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good = [r.score for r in held if r.quality == 1]
    bad = [r.score for r in held if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    # Labels of held-out rows are never read.
    turned = labels.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows(pairwise_quality.scored(docs, turned)) == rows(out)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "ok"), (2, None), (None, "x"), (3, "")], "doc_id LONG, text STRING").selectExpr("*", "0.5 AS score")
    labels = spark.createDataFrame([(1, None), (2, 1)], "doc_id LONG, quality INT")
    assert rows(pairwise_quality.scored(docs, labels), "doc_id", "score", "predicted") == [
        (1, 0.5, 1), (2, 0.5, 1), (3, 0.5, 1), (None, 0.5, 1)]
    assert pairwise_quality.scored(docs.limit(0), labels).count() == 0


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = byte_cnn.identified(docs)
    assert out.count() == docs.count() and out.filter("score < 0 OR score > 1").isEmpty()
    right = out.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_of_odd_rows(spark):
    known = [(i, f"the cat and the dog {i} of the house", "en") for i in range(20)] + [(50 + i, f"le chat et la maison {i} des enfants", "fr") for i in range(20)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 !? \n", "en"), (None, "the dog and the cat of the garden", None), (104, "你好", None)]
    docs = spark.createDataFrame([*known, *odd], "doc_id LONG, text STRING, lang STRING").selectExpr("*", "'x' AS lang_pred")
    found = {r.doc_id: (r.lang_pred, r.score) for r in byte_cnn.identified(docs).collect()}
    assert [found[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert found[None][0] == "en" and found[104][0] in ("en", "fr")
    nothing = byte_cnn.identified(docs.withColumn("lang", F.lit(None).cast("string")))
    assert rows(nothing.select("lang_pred").distinct()) == [("und",)]
    assert byte_cnn.identified(docs.limit(0)).count() == 0


def test_rare_languages_and_long_texts_in_the_training(spark):
    """A language of few rows is learned from a small sample; a long text gives no more windows than others, repeated rows one share."""
    few = spark.range(60).selectExpr("id + 100000 AS doc_id", "concat('le chat et la maison ', id, ' des enfants') AS text", "'fr' AS lang")
    many = spark.range(6000).selectExpr("id AS doc_id", "concat('the cat and the dog ', id, ' of the house') AS text", "'en' AS lang")
    docs = many.union(few)
    out = byte_cnn.identified(docs, fit_rows=50, fit_lang=30).join(docs, "doc_id").groupBy("lang", "lang_pred").count().collect()
    assert {(r[0], r[1]) for r in out} == {("en", "en"), ("fr", "fr")}
    long = spark.createDataFrame([(1, "en", "many words " * 300_000)] * 50 + [(2, "en", "!?"), (3, "de", "ein Wort")], "row_id LONG, lang STRING, text STRING")
    windows = byte_cnn.training_windows(long.repartition(5))
    assert [(lang, len(w)) for lang, w in windows] == [("de", 8)] + [("en", 256)] * (len(windows) - 1) and 2 <= len(windows) <= 17
    assert windows == byte_cnn.training_windows(long.repartition(2))


def test_windows_of_the_training():
    text = bytes(range(256)) * 5 + b"end"
    assert b"".join(byte_cnn.some_windows(text, 6)) == text and byte_cnn.some_windows(b"") == []
    picked = byte_cnn.some_windows(text, 3, 100)
    cuts = [text[k : k + 100] for k in range(0, len(text), 100)]
    assert len(picked) == 3 and all(w in cuts for w in picked) and picked == byte_cnn.some_windows(text, 3, 100)


def test_windows_cover_whole_texts():
    row, windows = byte_cnn.windows_of([b"a" * 600, b"", b"B"], 256)
    assert row.tolist() == [0, 0, 0, 2] and windows[2].tolist() == [97] * 88 + [0] * 168 and windows[3][0] == 98


def test_network_gradient():
    """A step of training lowers the loss of a separable toy problem to almost nothing."""
    r = np.random.default_rng(0)
    texts = [bytes(r.choice(list(b"abcd" if k else b"wxyz"), 200).tolist()) for k in (0, 1) for _ in range(30)]
    row, windows = byte_cnn.windows_of(texts)
    y = np.repeat([0, 1], 30)[row]
    network = byte_cnn.Network(2)
    network.train(windows, y, steps=60)
    assert (network.log_probabilities(windows).argmax(axis=1) == y).all()


@pytest.mark.parametrize("fit_rows", [50])
def test_fit_sample_is_bounded_and_stable(spark, fit_rows):
    df = spark.range(1000).selectExpr("id AS row_id", "id * 2 AS x")
    first = pairwise_quality.fit_sample(df, fit_rows, "x")
    assert first == pairwise_quality.fit_sample(df.repartition(7), fit_rows, "x") and 20 < len(first) < 100
