"""BagMinHash and the embedding forest against brute force."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest

from tallytree import session
from tallytree.llm import bag_minhash, embedding_forest
from tallytree.llm.graphs import components

from conftest import rows


def bag(text, size=5):
    words = [w for w in __import__("re").split("[ \t-\r]+", text or "") if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def similarity(a, b):
    most = sum((a | b).values())
    return sum((a & b).values()) / most if most else 0.0


def classes(ids, linked):
    """Smallest id reachable from each id."""
    name = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return name


def brute(texts):
    bags = {i: bag(t) for i, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and similarity(bags[a], bags[b]) >= 0.8 - 1e-12]
    return classes(texts, pairs)


def varied(random_, words, changes):
    out = list(words)
    for i in random_.sample(range(len(out)), changes):
        out[i] = f"z{random_.random()}"
    return " ".join(out)


def corpus():
    r = random.Random(5)
    texts, n = {}, 0
    for group in range(6):
        base = [f"w{r.randrange(4000)}" for _ in range(300)]
        texts[n] = " ".join(base)
        n += 1
        for changes in (1, 3, 6, 9, 12, 20):
            texts[n] = varied(r, base, changes)
            n += 1
    # Copies that are near their original and not near each other.
    base = [f"v{i}" for i in range(400)]
    for k in range(30):
        texts[n] = varied(r, base, 7)
        n += 1
    texts[n] = " ".join(base)
    repeated = "again and again and again " * 60
    texts |= {n + 1: repeated, n + 2: repeated + "and more", n + 3: "again and again and again " * 20, n + 4: "too short",
              n + 5: "too short", n + 6: "too  short\n", n + 7: "", n + 8: " \t", n + 9: texts[0]}
    return texts


def test_signature_is_unbiased():
    r = np.random.default_rng(1)
    element = r.integers(1, 2**63, 60).astype(np.uint64)
    errors = []
    for trial in range(8):
        names = np.sort(element ^ np.uint64(trial * 7919))
        a, b = r.integers(0, 12, 60), r.integers(0, 12, 60)
        row = np.repeat([0, 1], 60)
        weight = np.concatenate((a, b))
        keep = weight > 0
        best = bag_minhash.signatures(row[keep], np.tile(names, 2)[keep], weight[keep], 2, 2048)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((best[0] == best[1]).mean() - true)
    assert abs(np.mean(errors)) < 3 * 0.5 / math.sqrt(2048 * 8)


def test_signature_does_not_depend_on_the_batch():
    r = random.Random(8)
    words = [f"w{r.randrange(50)}" if k % 3 else "again" for k in range(200)]
    text = (" ".join(words) + " once more and" * 40).encode()
    others = [" ".join(f"{k}x{i}" for i in range(140)).encode() for k in range(2000)]
    signed = []
    for batch in ([text], [text, *others[:300]], [text, *others]):
        row, element, weight = bag_minhash.weighted_shingles(batch, 5)
        assert len(batch) < 2000 or row.size > bag_minhash.DRAWS
        signed.append(bag_minhash.signatures(row, element, weight, len(batch), bag_minhash.COMPONENTS)[:1])
    for other in signed[1:]:
        assert (other == signed[0]).all()
        assert (bag_minhash._bands(other, 36, 6) == bag_minhash._bands(signed[0], 36, 6)).all()


def test_signature_does_not_depend_on_company():
    texts = [b"a b c d e f g h", b"", b"x y", b"a b c d e f g h i"]
    whole = bag_minhash.signatures(*bag_minhash.weighted_shingles(texts, 5), 4, 64)
    for i, t in enumerate(texts):
        alone = bag_minhash.signatures(*bag_minhash.weighted_shingles([t], 5), 1, 64)
        assert (alone[0] == whole[i]).all()


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(
        [(i, t, "extra", i) for i, t in texts.items()], "doc_id LONG, text STRING, component_id STRING, weight INT").repartition(5)
    found = {r.doc_id: (r.component_id, r.kept) for r in bag_minhash.near_duplicates(docs).collect()}
    want = brute(texts)
    assert {i: c for i, (c, _) in found.items()} == want
    assert all(kept == (i == want[i]) for i, (_, kept) in found.items())


def test_null_empty_and_repeated_rows(spark):
    same = "one two three four five six"
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (3, same), (3, same), (None, same), (4, same), (None, None), (5, "  ")], "doc_id LONG, text STRING")
    assert rows(bag_minhash.near_duplicates(docs)) == sorted(
        [(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, True), (None, 3, False), (4, 3, False), (None, None, True), (5, 5, True)],
        key=lambda t: tuple((v is None, str(v)) for v in t))
    assert rows(bag_minhash.first_of_each_class(docs), "doc_id") == [(1,), (2,), (3,), (5,), (None,)]
    assert bag_minhash.near_duplicates(docs.limit(0)).count() == 0


def test_very_long_text(spark):
    r = random.Random(2)
    words = [f"w{r.randrange(9999)}" for _ in range(300_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, varied(r, words, 4000)), (3, varied(r, words, 40_000))], "doc_id LONG, text STRING")
    assert rows(bag_minhash.near_duplicates(docs), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    found = rows(components(spark.createDataFrame(edges, "a INT, b INT")))
    assert found == sorted([(i, 0) for i in range(41)] + [(100, 100), (101, 100)], key=lambda t: tuple((False, str(v)) for v in t))


# Embeddings

def vectors():
    r = np.random.default_rng(4)
    out, n = [], 0
    for label in (0, 1, 2):
        for _ in range(40):
            centre = r.normal(size=32)
            for spread in (0.0, 0.01, 0.02, 0.03):
                out.append((n, (centre + spread * r.normal(size=32)).tolist(), label))
                n += 1
    # One dense group, larger than a leaf and than a block.
    centre = r.normal(size=32)
    for _ in range(300):
        out.append((n, (centre + 0.012 * r.normal(size=32)).tolist(), 1))
        n += 1
    out += [(n + k, out[0][1], label) for k, label in enumerate((0, 0, 1))]
    return out


def brute_vectors(data, threshold=0.98):
    matrix = np.array([v for _, v, _ in data])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    labels = np.array([x for _, _, x in data])
    near = (matrix @ matrix.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    ids = [i for i, _, _ in data]
    name = classes(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    return {i: (int(n), name[i]) for i, n in zip(ids, near.sum(axis=1))}


def test_links_equal_brute_force(spark):
    data = vectors()
    df = spark.createDataFrame(data, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT").repartition(6)
    out = embedding_forest.near_duplicate_vectors(df, leaf=64, block=50)
    found = {r.vec_id: (r.n_links, r.component_id) for r in out.collect()}
    want = brute_vectors(data)
    total = sum(n for n, _ in want.values())
    assert set(found) == set(want)
    assert all(found[i][0] <= want[i][0] for i in want), "no link below the threshold, none counted twice"
    assert sum(n for n, _ in found.values()) >= 0.99 * total
    assert sum(found[i] == want[i] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("kind", ["FLOAT", "DOUBLE"])
def test_unusable_vectors_link_with_nothing(spark, kind):
    nan, inf = float("nan"), float("inf")
    data = [(1, None, 0), (2, [0.0, 0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [1.0, None], 0), (6, [], 0),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], None), (9, [1.0, 0.0], 0), (10, [2.0, -0.0], 0), (11, [1.0, 0.0], 1),
            (12, [1.0, 0.0, 0.0], 0), (13, [1e-30, 0.0], 0), (13, [1e-30, 0.0], 0), (None, [3.0, 0.0], 0)]
    df = spark.createDataFrame(data, f"vec_id LONG, embedding ARRAY<{kind}>, label INT").selectExpr("*", "'x' AS links", "1 AS n")
    out = rows(embedding_forest.near_duplicate_vectors(df))
    assert [r for r in out if r[0] in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12)] == sorted(
        [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 11, 12)], key=lambda t: str(t[0]))
    assert sorted(r for r in out if r[0] in (9, 10, 13)) == [(9, 4, 9, True), (10, 4, 9, False), (13, 4, 9, False), (13, 4, 9, False)]
    assert [r for r in out if r[0] is None] == [(None, 4, 9, False)]
    assert embedding_forest.near_duplicate_vectors(df.limit(0)).count() == 0


def test_what_texts_have_of_a_leader(spark):
    """Common bits are the overlap of two texts within the leader, occurrences counted."""
    r = random.Random(2)
    leader = " ".join(r.choice("abcd") for _ in range(300))
    others = []
    for _ in range(12):
        words = leader.split()
        for _ in range(r.randint(0, 40)):
            words[r.randrange(300)] = r.choice("abcdx")
        others.append(" ".join(words[r.randint(0, 50):]))
    pairs = spark.createDataFrame([(b"L", bytes([65 + i]), leader, t) for i, t in enumerate(others)], "a BINARY, b BINARY, left STRING, right STRING")
    got = {bytes(x.b): x for x in bag_minhash.star_overlaps(pairs, 0.8, 5).collect()}

    def bag(text):
        w = text.split()
        return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))

    top, bits = bag(leader), {}
    for i, text in enumerate(others):
        row = got[bytes([65 + i])]
        bits[i] = [x & (2**64 - 1) for x in row.units]
        assert sum(x.bit_count() for x in bits[i]) == sum((top & bag(text)).values())
        both, either = sum((top & bag(text)).values()), sum((top | bag(text)).values())
        assert row.linked == (both >= 0.8 * either)
    for i in bits:
        for j in bits:
            assert sum((x & y).bit_count() for x, y in zip(bits[i], bits[j])) == sum((top & bag(others[i]) & bag(others[j])).values())


def test_small_tables_take_few_files(spark):
    """However many partitions a shuffle has, a written table of few rows is two files for every core at most."""
    settings = {"spark.sql.shuffle.partitions": "67", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    root = session.scratch_root(spark).removeprefix("file://")
    old = {folder for folder, _, _ in os.walk(root)}
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {r.doc_id: r.component_id for r in bag_minhash.near_duplicates(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = brute({i: t for i, t in texts.items() if t.strip()})
    assert got == {i: want.get(i, i) for i in texts}
    files = {
        os.path.basename(folder): sum(f.endswith(".parquet") for f in names)
        for folder, _, names in os.walk(root) if folder not in old and os.path.basename(folder).startswith(("bag-", "large-", "small-"))}
    assert len(files) > 10 and max(files.values()) <= 2 * spark.sparkContext.defaultParallelism, files


def test_rounds_end_with_stars(spark):
    """Stars need no further round to show that nothing changes; other graphs go on until they are stars."""
    written, hook = [], lambda frame, name: written.append(name)
    session.PIN_HOOKS.append(hook)
    try:
        found = rows(components(spark.createDataFrame([(1, 2), (3, 1), (1, 9), (4, 5), (5, 4)], "a INT, b INT")))
    finally:
        session.PIN_HOOKS.remove(hook)
    assert found == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 1)]
    assert written == ["links", "large-star", "small-star"]
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 130)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    linked = [(a, b) for a, b in edges if a != b]
    want = classes({x for e in linked for x in e}, linked)
    assert dict(rows(components(spark.createDataFrame(edges, "a INT, b INT")))) == want
