"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

A tree splits a node at the median of the projections on one random direction; vectors closer
to the median than the spill width go to both sides. Two vectors of cosine 0.98 differ by at most
0.2 in length, and by about 0.2 / sqrt(dimensions) in projection, so few splits part them and
hardly any pair is parted in every tree. Splits are fitted level by level on a sample of bounded size
per node; every vector is then routed, and all pairs inside a leaf are compared exactly, block
against block. A pair that meets in several leaves is counted in the first of them only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytree.llm.graphs import components
from tallytree.session import pin

TREES = 4
#: A node with more vectors is split; nodes that spilling cannot make smaller stay as they are.
LEAF = 512
#: Levels grown per round, and vectors per node that fit the medians of a round.
LEVELS, FIT_ROWS = 4, 4096
#: Half width of the overlap, in multiples of the distance of a pair at the threshold / sqrt(dimensions).
SPILL = 1.0
#: Rows of a leaf in one block of the comparison.
BLOCK = 1024


def _vectors(source: DataFrame) -> DataFrame:
    """(vec_id, label, vec_key, unit); the key is null unless the label is set and the vector finite and not zero."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            keys, units = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.asarray([np.nan] if v is None else [np.nan if c is None else c for c in v], dtype=np.float64)
                ok = x.size > 0 and np.isfinite(x).all()
                # Scaled first, so that very small and very large parts neither vanish nor overflow.
                top = np.abs(x).max() if ok else 0.0
                if label is None or not (ok and top > 0):
                    keys.append(None)
                    units.append(None)
                    continue
                # Equal vectors under two labels are two points.
                keys.append(hashlib.md5(repr(label).encode() + b":" + (x + 0.0).tobytes(), usedforsecurity=False).digest())
                y = x / top
                units.append(y / np.sqrt(y @ y))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))],
                ["vec_id", "label", "vec_key", "unit"])

    fields = {f.name: f.dataType.simpleString() for f in source.schema}
    return source.mapInArrow(
        work, f"vec_id {fields['vec_id']}, label {fields['label']}, vec_key binary, unit array<double>")


def _direction(seed: int, tree: int, node: int, dims: int) -> np.ndarray:
    out = np.random.Generator(np.random.Philox(key=[(seed << 32) + int(tree), int(node)])).standard_normal(int(dims))
    return out / np.sqrt(out @ out)


def _split(at: np.ndarray, middle: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    return at <= middle + width, at >= middle - width


def _grow(units: np.ndarray, tree: int, node: int, share: float, seed: int, width: float, leaf: int) -> dict[int, float]:
    """Medians by node number of at most LEVELS levels below ``node``; ``share`` is the sampled share of its vectors."""
    out, open_ = {}, [(node, np.arange(len(units)), 0)]
    while open_:
        here, rows, depth = open_.pop()
        if depth == LEVELS or len(rows) <= leaf * share or len(rows) < 8:
            continue
        at = units[rows] @ _direction(seed, tree, here, units.shape[1])
        middle = float(np.median(at))
        sides = _split(at, middle, width)
        if max(s.sum() for s in sides) > 0.9 * len(rows):  # nearly all are copies of each other
            continue
        out[here] = middle
        open_ += [(2 * here + k, rows[s], depth + 1) for k, s in enumerate(sides)]
    return out


def grown_leaves(
    vectors: DataFrame, threshold: float, trees: int = TREES, leaf: int = LEAF, seed: int = 11, max_rounds: int = 16
) -> DataFrame:
    """(vec_key, label, dims, tree, node) of the leaves of every vector (vec_key, label, dims, unit)."""
    here = pin(vectors.select(
        "vec_key", "label", "dims", "unit",
        F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(1).cast("long").alias("node"),
    ), "forest-level")
    group, done = ["label", "dims", "tree", "node"], []
    width = lambda dims: SPILL * float(np.sqrt(max(2 - 2 * threshold, 0) / dims))

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        label, dims, tree, node = key[0], int(key[1]), int(key[2]), int(key[3])
        cuts = _grow(np.stack(frame["unit"].to_numpy()), tree, node, min(1.0, len(frame) / frame["n"].iloc[0]), seed, width(dims), leaf)
        return pd.DataFrame({
            "label": [label], "dims": [dims], "tree": [tree], "node": [node],
            "nodes": [list(cuts)], "medians": [list(cuts.values())]})

    def route(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in stream:
            out = []
            for (dims, tree, node), part in frame.groupby(["dims", "tree", "node"], sort=False):
                for _, same in part.groupby("label", sort=False):
                    cuts = dict(zip(same["nodes"].iloc[0], same["medians"].iloc[0]))
                    units, open_ = np.stack(same["unit"].to_numpy()), [(int(node), np.arange(len(same)))]
                    while open_:
                        at_node, rows = open_.pop()
                        if at_node not in cuts:
                            moved = same.iloc[rows].drop(columns=["nodes", "medians"])
                            out.append(moved.assign(node=at_node, final=at_node.bit_length() < int(node).bit_length() + LEVELS))
                            continue
                        sides = _split(units[rows] @ _direction(seed, int(tree), at_node, int(dims)), cuts[at_node], width(dims))
                        open_ += [(2 * at_node + k, rows[s]) for k, s in enumerate(sides)]
            if out:
                yield pd.concat(out)

    typed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in here.schema)
    kinds = {f.name: f.dataType.simpleString() for f in here.schema}
    for _ in range(max_rounds):
        sizes = here.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
        large = pin(sizes.filter(F.col("n") > leaf), "forest-large")
        done.append(here.join(large, group, "left_anti").select("vec_key", *group))
        if large.isEmpty():
            break
        # The sample of a node: rows whose hash falls below its share, twice FIT_ROWS at the very most in practice.
        chance = F.pmod(F.xxhash64("vec_key", "tree", "node"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = here.join(large, group).filter(chance * F.col("n") < FIT_ROWS)
        cuts = sample.groupBy(*group).applyInPandas(
            fit, f"label {kinds['label']}, dims int, tree int, node long, nodes array<long>, medians array<double>")
        cuts = pin(cuts, "forest-cuts")
        routed = pin(here.join(cuts, group).mapInPandas(route, typed + ", final boolean"), "forest-routed")
        done.append(routed.filter("final").select("vec_key", *group))
        here = routed.filter("NOT final").drop("final")
    else:
        done.append(here.select("vec_key", *group))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _compare(threshold: float):
    """Counts and a spanning forest of the links between two blocks of a leaf, or inside one."""

    def work(key, frame: pd.DataFrame) -> pd.DataFrame:
        leaf, first, second = int(key[2]), key[3], key[4]
        same = first == second
        left, right = frame[frame["side"] == 0], frame[frame["side"] == (0 if same else 1)]
        if left.empty or right.empty:
            return pd.DataFrame({"vec_key": [], "links": [], "other": []})
        near = np.stack(left["unit"].to_numpy()) @ np.stack(right["unit"].to_numpy()).T >= threshold
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        rows, columns = np.unique(i), np.unique(j)
        if rows.size:
            # A pair belongs to the first leaf that holds both: earlier shared leaves strike it out.
            sets = [left["leaves"].iloc[k] for k in rows], [right["leaves"].iloc[k] for k in columns]
            known = {x: n for n, x in enumerate(sorted({int(x) for s in sets for r in s for x in r if x < leaf}))}
            marks = [np.zeros((len(s), max(len(known), 1)), dtype=np.float32) for s in sets]
            for s, mark in zip(sets, marks):
                for n, r in enumerate(s):
                    mark[n, [known[int(x)] for x in r if x < leaf]] = 1
            near[np.ix_(rows, columns)] &= (marks[0] @ marks[1].T) < 0.5
        i, j = np.nonzero(near)
        names = left["vec_key"].to_numpy() if same else np.concatenate((left["vec_key"], right["vec_key"]))
        copies = np.concatenate((left["copies"], right["copies"])) if not same else left["copies"].to_numpy()
        j = j if same else j + len(left)
        links = np.bincount(i, copies[j], len(names)) + np.bincount(j, copies[i], len(names))
        # One link per vector joins what hangs together here: the smallest row reached, spread until it rests.
        low, before = np.arange(len(names)), -1
        while i.size and low.sum() != before:
            before = low.sum()
            np.minimum.at(low, j, low[i])
            np.minimum.at(low, i, low[j])
        linked = np.flatnonzero(links > 0)
        return pd.DataFrame({"vec_key": names[linked], "links": links[linked].astype(np.int64), "other": names[low[linked]]})

    return work


def near_duplicate_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    threshold: float = 0.98, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared when their labels are equal and not null and their lengths agree; the
    cosine is taken in double precision. Vectors that are null, empty or zero, or hold null or
    non-finite parts, link with nothing: no links, a class of their own. ``n_links`` counts the
    other rows linked directly, copies of the same vector included. ``component_id`` is the
    smallest id reachable by links. Equal vectors are one point with a number of copies, so a
    vector that fills a third of the table costs nothing extra. A leaf that cannot be split (a
    dense group of different vectors) is compared in blocks, each pair of blocks a task of its
    own, and emits counts and one link per vector, never pairs. Other columns are not touched.
    """
    source = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).alias("vector"))
    rows = pin(_vectors(source), "forest-vectors")
    points = rows.filter("vec_key IS NOT NULL").groupBy("label", "vec_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low"), F.any_value("unit").alias("unit"))
    points = pin(points.withColumn("dims", F.size("unit")), "forest-points")

    # A leaf number sorts by tree, then by node.
    leaves = pin(grown_leaves(points, threshold, trees, leaf).withColumn(
        "leaf", F.shiftleft(F.col("tree").cast("long"), 56) + F.col("node")), "forest-leaves")
    lists = leaves.groupBy("vec_key").agg(F.collect_set("leaf").alias("leaves"))
    sizes = leaves.groupBy("label", "dims", "leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = (
        leaves.select("label", "dims", "leaf", "vec_key").join(sizes, ["label", "dims", "leaf"])
        .join(lists, "vec_key").join(points.select("vec_key", "unit", "copies"), "vec_key")
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("vec_key", F.lit(5)), F.col("blocks")).cast("int"))
    )
    # Every unordered pair of blocks of a leaf is a group: a block goes to one group per other block.
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "label", "dims", "leaf", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "vec_key", "unit", "copies", "leaves")
    found = pin(dealt.groupBy("label", "dims", "leaf", "first", "second").applyInPandas(
        _compare(threshold), "vec_key binary, links long, other binary"), "forest-links")

    counts = found.groupBy("vec_key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("vec_key").alias("a"), F.col("other").alias("b")))
    named = points.select("vec_key", "low", "copies").join(roots.withColumnRenamed("node", "vec_key"), "vec_key", "left")
    named = pin(named.withColumn("root", F.coalesce("root", "vec_key")), "forest-named")
    least = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "root").join(counts, "vec_key", "left").select(
        "vec_key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("vec_id", "vec_key").join(classes, "vec_key", "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        F.col("vec_id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
