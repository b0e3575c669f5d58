"""Merkle manifest of a data set by nested-interval labels.

Leaves are ranked inside their tree and a node is labelled with the interval of leaf ranks that it covers, so an
ancestor is a node whose interval contains another. Levels are dealt into bands of ``depth`` levels; a block
is what one node at the top of a band covers there, at most ``fan ** depth`` members. Going up, every band is one grouping by block. Going
down, blocks are joined with the proof of the node that covers them, and inside a block the ancestors of a member are
found by containment; what is left of a parent's interval without the own one are the siblings. Each leaf meets one joined row per
band instead of one per level, and no tree is ever in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallytree.operators.ordering import numbered
from tallytree.session import pin

FAN, DEPTH = 2, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "struct<lo:long,hi:long,digest:string>"


def framed(column: Column) -> Column:
    """A value with its UTF-8 byte count before it, so that values cannot run into each other; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda x: x["digest"]), "")


def _levels(members: Column, steps: Column, fan: int, depth: int) -> Column:
    """The nodes of a block, level by level: the members, then ``steps`` times the parents of what is there."""
    def parents(level: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(level) - 1) / fan).cast("int")), lambda j: F.slice(level, j * fan + 1, F.lit(fan)))
        return F.transform(runs, lambda run: F.struct(
            run[0]["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), digest(_joined(run)).alias("digest")))

    base = F.transform(members, lambda m: F.struct(m["lo"].alias("lo"), m["hi"].alias("hi"), m["digest"].alias("digest")))
    return F.aggregate(
        _steps(steps, depth), F.array(base).cast(f"array<array<{_NODE}>>"),
        lambda levels, k: F.concat(levels, F.array(parents(F.element_at(levels, -1)).cast(f"array<{_NODE}>"))))


def _steps(steps: Column, depth: int) -> Column:
    return F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), steps)


def _path(lo: Column, hi: Column, levels: Column, steps: Column, depth: int) -> Column:
    """Digests before and after the node itself in its parent's interval, for the ancestors of a member."""
    def siblings(k: Column) -> Column:
        parents = F.filter(F.element_at(levels, k + 1), lambda p: (p["lo"] <= lo) & (hi <= p["hi"]))
        return F.transform(parents, lambda parent: F.struct(
            _joined(F.filter(F.element_at(levels, k), lambda x: (parent["lo"] <= x["lo"]) & (x["hi"] <= lo))).alias("before"),
            _joined(F.filter(F.element_at(levels, k), lambda x: (hi <= x["lo"]) & (x["hi"] <= parent["hi"]))).alias("after")))

    return F.flatten(F.transform(_steps(steps, depth), siblings))


def bands(leaves: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """The blocks of all bands, lowest first, from ``leaves`` (tree, rank from 0, n leaves of the tree, digest, payload)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    width, wide, out = 1, fan**depth, []
    rows = leaves.select("tree", F.col("rank").alias("lo"), "n", "digest", "payload")
    while not out or width < most:
        member = F.struct("lo", F.least(F.col("lo") + width, "n").alias("hi"), "digest", "payload")
        blocks = rows.groupBy("tree", F.floor(F.col("lo") / (width * wide)).alias("block")).agg(
            F.sort_array(F.collect_list(member)).alias("members"), F.first("n").alias("n"))
        # A tree that fits one block ends as soon as one node remains; other blocks go up the whole band.
        reach = F.lit(depth)
        for s in reversed(range(depth)):
            reach = F.when(F.col("n") <= width * fan**s, s).otherwise(reach)
        blocks = blocks.withColumns({"steps": reach, "last": F.col("n") <= width * wide})
        blocks = blocks.withColumn("node", F.element_at(_levels(F.col("members"), F.col("steps"), fan, depth), -1)[0])
        out.append(pin(blocks, "manifest-band"))
        rows = out[-1].filter("NOT last").select("tree", "node.lo", "n", "node.digest", F.lit(None).alias("payload"))
        width *= wide
    return out


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): what remains of every tree."""
    tops = [b.filter("last").select("tree", "node.digest") for b in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


def proofs(levels: list[DataFrame], above: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """One row per leaf: (tree, digest, payload, path and what ``above`` (tree, path, ...) says of its tree).

    ``path`` has an entry per level, the siblings before and after, up to the root of the tree and on along the path of ``above``.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    known = None
    for blocks in reversed(levels):
        met = blocks.filter("last").join(above, "tree")
        if known is not None:
            inner = known.select("tree", F.col("lo").alias("_lo"), "path", *extra)
            rest = blocks.filter("NOT last").withColumn("_lo", F.col("node.lo"))
            met = met.unionByName(rest.join(inner, ["tree", "_lo"]).drop("_lo"))
        opened = met.withColumn("levels", _levels(F.col("members"), F.col("steps"), fan, depth)).select(
            "tree", "levels", "steps", F.col("path").alias("_upper"), *extra, F.explode("members").alias("m"))
        own = _path(F.col("m.lo"), F.col("m.hi"), F.col("levels"), F.col("steps"), depth)
        known = opened.select("tree", "m.lo", "m.digest", "m.payload", F.concat(own, "_upper").alias("path"), *extra)
    return known


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row of ``docs``.

    A leaf is the digest of the framed FIELDS, a null one is ``-``. The trees are the langs, a null lang is one of its own; their roots, null first and
    then by bytes, are the leaves of one more tree. Leaves ascend by doc_id, null first, equal ones by digest, so repeated rows
    are leaves of their own with equal digests. Rows whose crc32 of the decimal doc_id is divisible by 7 are tampered with: n_chars grows
    by one, if it is not null. ``folded_root`` comes from the tampered leaf and the original siblings; an altered row is told by it. Long
    texts are only hashed. Other columns are not looked at; an empty table gives an empty one.
    """
    fields = {c: F.col(f"`{c}`") for c in FIELDS}
    leaf = digest(*(framed(c) for c in fields.values()))
    altered = digest(*(framed(c + 1 if n == "n_chars" else c) for n, c in fields.items()))
    struck = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    hashed = docs.select(
        "doc_id", "lang", leaf.alias("digest"),
        F.when(struck & F.col("n_chars").isNotNull(), altered).alias("altered"))
    hashed = pin(hashed, "manifest-leaves")

    langs = numbered(hashed.select("lang").distinct(), [], [F.asc_nulls_first("lang")], "place")
    langs = pin(langs.select(F.col("lang").alias("_lang"), (F.col("place") - 1).alias("tree")), "manifest-trees")
    sizes = hashed.groupBy(F.col("lang").alias("_of")).agg(F.count(F.lit(1)).alias("n"))
    sizes = langs.join(sizes, F.col("_lang").eqNullSafe(F.col("_of"))).drop("_of")
    placed = hashed.join(sizes, F.col("lang").eqNullSafe(F.col("_lang"))).select("tree", "n", "doc_id", "digest", "altered")
    ranked = numbered(placed, ["tree"], [F.asc_nulls_first("doc_id"), F.asc("digest")], "place")
    leaves = ranked.select(
        "tree", (F.col("place") - 1).alias("rank"), "n", "digest", F.struct("doc_id", "altered").alias("payload"))

    trees = bands(leaves, fan, depth)
    subroots = roots(trees)
    top = bands(subroots.crossJoin(subroots.agg(F.count(F.lit(1)).alias("n"))).select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), "n", "digest", F.col("tree").alias("payload")), fan, depth)
    start = roots(top).select(
        "tree", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("root"))
    above = proofs(top, start, fan, depth).select(F.col("payload").alias("tree"), "path", F.col("digest").alias("subroot"), "root")

    out = proofs(trees, pin(above, "manifest-top"), fan, depth)
    path = F.col("path")
    out = out.select(
        "payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root",
        digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")).alias("proof_sha256"),
        folded(F.coalesce("payload.altered", "digest"), path).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
