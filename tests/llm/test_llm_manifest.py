"""The interval-labelled manifest against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallytree.llm import interval_labels as il

from conftest import rows

SCHEMA = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan=2):
    """The root, and for every leaf its (before, after) per level."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for p, i in zip(paths, place):
            run = i // fan * fan
            p.append(("".join(nodes[run:i]), "".join(nodes[i + 1:run + fan])))
        nodes = [h(*nodes[i:i + fan]) for i in range(0, len(nodes), fan)]
        place = [i // fan for i in place]
    return nodes[0], paths


def brute(docs, fan=2):
    groups = {}
    for row in docs:
        groups.setdefault(row[2], []).append(row)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for lang in langs:
        order = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in groups[lang]), key=lambda x: x[:3])
        done[lang] = order, *tree([x[2] for x in order], fan)
    root, top = tree([done[lang][1] for lang in langs], fan)
    out = []
    for lang, above in zip(langs, top):
        order, subroot, paths = done[lang]
        for (_, _, name, row), path in zip(order, paths):
            node = name
            if row[0] is not None and row[3] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0:
                node = leaf((*row[:3], row[3] + 1, row[4]))
            for before, after in path + above:
                node = h(before, node, after)
            out.append((row[0], name, subroot, root, h(*(b + a for b, a in path + above)), node, node == root))
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def corpus(n, langs, seed=2):
    r = random.Random(seed)
    return [(i * 3, r.choice(["web", "é", None]), r.choice(langs), r.choice([None, len(str(i)), 7]), r.choice([None, "", "text " * (i % 9), "ü:1"])) for i in range(n)]


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("n, langs, fan, depth", [
    (150, ["en", None, "é", "z", "de"], 2, 6), (150, ["en", None, "Z", "zz"], 2, 2), (77, ["en", "fr"], 3, 2),
    (1, ["en"], 2, 6), (2, [None], 2, 1), (130, ["en"], 2, 3), (9, list("abcdefghi"), 2, 1)])
def test_manifest_equals_brute_force(spark, n, langs, fan, depth):
    data = corpus(n, langs)
    out = rows(il.manifest(spark.createDataFrame(data, SCHEMA).repartition(3), fan, depth), *COLUMNS)
    assert out == brute(data, fan)
    assert all(r[6] == (r[5] == r[3]) for r in out)


def test_null_ids_repeated_rows_and_other_columns(spark):
    data = corpus(20, ["en", "fr"]) + [(None, "web", "en", 4, "text")] * 2 + [(9, "web", "en", 4, "text")] * 3
    docs = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit(1) for c in ("tree", "n", "digest", "path", "members", "payload", "lo", "place")})
    assert rows(il.manifest(docs), *COLUMNS) == brute(data)
    assert il.manifest(docs.limit(0)).count() == 0


def test_a_changed_row_is_told(spark):
    data = corpus(60, ["en", "fr"])
    got = il.manifest(spark.createDataFrame(data, SCHEMA)).collect()
    struck = {r[0] for r in data if r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0}
    assert struck and {r.doc_id for r in got if not r.verified} == struck
    long = [(1, "web", "en", 9, "x" * 3_000_000), (2, "web", "en", 9, "y")]
    assert rows(il.manifest(spark.createDataFrame(long, SCHEMA)), *COLUMNS) == brute(long)
