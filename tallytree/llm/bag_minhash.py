"""Near duplicates by BagMinHash: unbiased weighted-Jaccard signatures, bands, verified overlap.

A document is the multiset of its runs of five words. Every element of weight w owns, for each
signature component, a Poisson process on the weight axis; the signature keeps the earliest
point below w. Weights are whole numbers, cut into the root intervals [0,1), [1,2), [2,4),
[4,8) ...; the process of an interval is generated once, in order of time, for all components
together, and a point finds its level by halving the interval again and again (the leading
bits of one hash). An interval that lies below w keeps all its points, a cut one only those
whose level lies below w. An element stops when its time passes the latest component of its
document, so a signature costs little more than one step for each element.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallytree.llm.graphs import components
from tallytree.llm.rawtext import WordGrid, batches, mixed
from tallytree.operators.firsts import first_per
from tallytree.session import parts_for, pin

#: 36 bands of 6: a pair at similarity 0.8 shares no band with probability 2e-5, and at 0.85 1e-7.
BANDS, ROWS = 36, 6
#: Components of a signature: the bands take the first, the sketch keeps two bits of each.
COMPONENTS = 432
#: Points drawn in one step over all open processes, about.
DRAWS = 1 << 18
#: Texts of a file before there are more files than two for every core.
TEXTS_PER_FILE = 4000
_U = np.uint64


def weighted_shingles(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, weight), sorted by row and element."""
    row, element = WordGrid(texts).shingles(size)
    order = np.lexsort((element, row))
    row, element = row[order], element[order]
    if not row.size:
        return row, element, np.zeros(0, np.int64)
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (element[1:] != element[:-1])))
    first = np.flatnonzero(new)
    return row[first], element[first], np.diff(np.concatenate((first, [row.size])))


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((bits >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, m: int) -> np.ndarray:
    """The (texts, m) matrix of first arrival times; equal times mean the same point of the same element."""
    best = np.full((texts, m), np.inf)
    levels = np.zeros(row.size, dtype=np.int64)
    levels[weight > 1] = np.floor(np.log2(weight[weight > 1] - 1)).astype(np.int64) + 1
    owner = np.repeat(np.arange(row.size), levels + 1)
    level = np.arange(owner.size) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.where(level == 0, 1, low)
    doc, top = row[owner], weight[owner]
    seed = mixed(element[owner] ^ mixed(level.astype(_U) + _U(1)))
    total, step, many = np.zeros(owner.size), np.zeros(owner.size, dtype=_U), 1
    while doc.size:
        # ``many`` further points of every process that is still open.
        drawn = mixed(seed[:, None] + (step[:, None] + np.arange(many, dtype=_U)) * _U(0xD1B54A32D192ED03))
        # Gaps are added one after the other, from the first point on: how many are drawn at a time does not change a bit.
        gaps = -np.log(_uniform(drawn))
        gaps[:, 0] += total
        sums = np.cumsum(gaps, axis=1)
        at = sums / (m * length)[:, None]
        place = mixed(drawn ^ _U(0xA0761D6478BD642F))
        spot = low[:, None] + np.floor(_uniform(mixed(place ^ _U(0xE7037ED1A0B428DB))) * length[:, None]).astype(np.int64)
        alive = (spot < top[:, None]) & (at <= best.max(axis=1)[doc][:, None])
        cell = doc[:, None] * m + (place % _U(m)).astype(np.int64)
        np.minimum.at(best.reshape(-1), cell[alive], at[alive])
        total, step = sums[:, -1], step + _U(many)
        open_ = at[:, -1] <= best.max(axis=1)[doc]
        doc, top, seed, low, length, total, step = (x[open_] for x in (doc, top, seed, low, length, total, step))
        many = min(16, 2 * many, max(1, DRAWS // max(1, doc.size)))
    return best


def _sketch(best: np.ndarray) -> np.ndarray:
    """Two bits of every component, packed into 64-bit words."""
    bits = mixed(best.view(_U)) & _U(3)
    pad = -best.shape[1] % 32
    bits = np.pad(bits, ((0, 0), (0, pad))).reshape(len(best), -1, 32)
    return (bits << (np.arange(32, dtype=_U) * _U(2))).sum(axis=2, dtype=_U).view(np.int64)


def _bands(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = best[:, : bands * rows].view(_U).reshape(len(best), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U), (len(best), bands)).copy()
    for k in range(rows):
        out = mixed(out * _U(0x9E3779B97F4A7C15) + values[:, :, k])
    return out.view(np.int64)


_SIGNED = "row_id {id}, text_key binary, weight long, bands array<long>, sketch array<long>"


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = 5) -> DataFrame:
    """(row_id, text_key, weight, bands, sketch) of documents (row_id, text); weight 0 where a text has no word."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text"):
            row, element, weight = weighted_shingles(texts, words)
            total = np.bincount(row, weights=weight, minlength=len(texts)).astype(np.int64)
            best = signatures(row, element, weight, len(texts), max(COMPONENTS, bands * rows))
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary()),
                pa.array(total),
                pa.array(list(_bands(best, bands, rows)), pa.list_(pa.int64())),
                pa.array(list(_sketch(best)), pa.list_(pa.int64())),
            ], ["row_id", "text_key", "weight", "bands", "sketch"])

    return docs.mapInArrow(work, _SIGNED.format(id=docs.schema["row_id"].dataType.simpleString()))


def _compared(left: list[str], right: list[str], threshold: float, words: int):
    """For texts side by side: their shingles by pair and element, which rows are met by the next, and which pairs overlap enough."""
    both = [t.encode() for pair in zip(left, right) for t in pair]
    row, element, weight = weighted_shingles(both, words)
    pair, side = row >> 1, row & 1
    order = np.lexsort((side, element, pair))
    pair, side, element, weight = pair[order], side[order], element[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (element[1:] == element[:-1]))
    least = np.bincount(pair[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=len(left))
    most = np.bincount(pair, weights=weight, minlength=len(left)) - least
    return pair, side, weight, same, (most > 0) & (least >= threshold * most - 1e-9)


def overlaps(pairs: DataFrame, threshold: float, words: int) -> DataFrame:
    """The rows (a, b) of ``pairs`` (a, b, left, right) whose texts overlap: sum of minima / sum of maxima >= threshold."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for start in range(0, batch.num_rows, 128):
                a, b, left, right = (c[start : start + 128] for c in columns)
                ok = np.flatnonzero(_compared(left, right, threshold, words)[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[i] for i in ok], pa.binary()) for x in (a, b)], ["a", "b"])

    return pairs.select("a", "b", "left", "right").mapInArrow(work, "a binary, b binary")


def star_overlaps(pairs: DataFrame, threshold: float, words: int) -> DataFrame:
    """(a, b, linked, units) of ``pairs`` (a, b, left, right): whether they overlap, and what b has of a.

    ``units`` has a bit for each word run of a, as often as it occurs there, in the same order for every b. What two texts
    have in common of a is the number of bits that both have.
    """

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for start in range(0, batch.num_rows, 128):
                a, b, left, right = (c[start : start + 128] for c in columns)
                pair, side, weight, same, linked = _compared(left, right, threshold, words)
                own = np.where(side == 0, weight, 0)
                total = np.bincount(pair, weights=own, minlength=len(a)).astype(np.int64)
                longs = -(-total // 64)
                first = 64 * (np.cumsum(longs) - longs)
                at = first[pair] + np.cumsum(own) - own - (np.cumsum(total) - total)[pair]
                # Runs of bits, from where an element of a starts, as many as b has of it.
                edges = np.zeros(64 * int(longs.sum()) + 1, dtype=np.int32)
                np.add.at(edges, at[same], 1)
                np.add.at(edges, at[same] + np.minimum(weight[same], weight[same + 1]), -1)
                bits = np.packbits(np.cumsum(edges[:-1]) > 0, bitorder="little").view(np.int64)
                ends = np.concatenate(([0], np.cumsum(longs))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(linked),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(bits, pa.int64())),
                ], ["a", "b", "linked", "units"])

    return pairs.select("a", "b", "left", "right").mapInArrow(work, "a binary, b binary, linked boolean, units array<long>")


def _elements(texts: DataFrame, words: int) -> DataFrame:
    """(owner, element, weight) of texts (owner, text)."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in batches(stream, "text"):
            row, element, weight = weighted_shingles(values, words)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), pa.array(element.view(np.int64)), pa.array(weight)],
                ["owner", "element", "weight"])

    return texts.mapInArrow(work, "owner long, element long, weight long")


def shareable(texts: DataFrame, words: int) -> DataFrame:
    """(text_key, can_share) of texts (text_key, weight, text): the weight of the elements that another of them has too.

    No overlap with any of the others is larger.
    """
    owner = F.xxhash64("text_key")
    counted = _elements(texts.select(owner.alias("owner"), "text"), words).groupBy("element").agg(
        F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"), F.min("weight").alias("weight"))
    lone = counted.filter("n = 1").groupBy("owner").agg(F.sum("weight").alias("alone"))
    return texts.select("text_key", "weight", owner.alias("owner")).join(lone, "owner", "left").select(
        "text_key", (F.col("weight") - F.coalesce("alone", F.lit(0))).alias("can_share"))


def _alike(a: str, b: str, threshold: float, components: int):
    """A join condition that a pair at the threshold fails with a probability of 3e-5: sizes and sketches agree."""
    odd = F.lit(0x5555555555555555).cast("long")

    def differ(k: int):
        bits = F.col(f"{a}_sketch")[k].bitwiseXOR(F.col(f"{b}_sketch")[k])
        return F.bit_count(bits.bitwiseOR(F.shiftrightunsigned(bits, 1)).bitwiseAND(odd))

    # Two-bit values of different points differ in three cases of four; four deviations are added.
    p = (1 - threshold) * 0.75
    limit = int(components * p + 4 * (components * p * (1 - p)) ** 0.5)
    apart = sum((differ(k) for k in range(-(-components // 32))), F.lit(0))
    small, large = F.least(f"{a}_weight", f"{b}_weight"), F.greatest(f"{a}_weight", f"{b}_weight")
    return (small >= large * F.lit(threshold) - F.lit(1e-9)) & (apart <= limit)


def _ones(longs: Column) -> Column:
    """The bits that are set in an array of longs."""
    return F.aggregate(longs, F.lit(0), lambda n, x: n + F.bit_count(x))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    threshold: float = 0.8, words: int = 5, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(id, component_id, kept): the near-duplicate class of every row.

    Two texts are linked when the weighted Jaccard similarity of their multisets of ``words``
    word runs is ``threshold`` or more; a text with fewer words is one run. Classes are the
    connected components of the links, named after the smallest id in them; ``kept`` marks that
    document. Texts without a word (null, empty, blank) link with nothing and stay. Equal texts
    are one text from the start, so copies cost no pairs. A repeated id is the same document;
    a null id takes part and only names a class of null ids. Other columns are not touched.

    Candidates share one of ``bands`` bands of ``rows`` components (a pair at the threshold is
    missed with probability ``(1 - threshold ** rows) ** bands``). Each bucket first tests all
    members against a leader. Members that are then still in different components are tested pair
    by pair, unless sketches, the words that a text shares with no other or what both have of the leader rule the link out, so no
    link between candidates is lost and a group of copies costs its size rather than its square.
    """
    source = docs.select(F.col(id_column).alias("row_id"), F.col(text_column).alias("text"))
    return _judged(source, threshold, words, bands, rows).drop("text_key").withColumnRenamed("row_id", id_column)


def first_of_each_class(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.8, words: int = 5,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns. Of rows that agree in id and text one stays."""
    source = docs.select(F.col(id_column).alias("row_id"), F.col(text_column).alias("text"))
    kept = _judged(source, threshold, words, BANDS, ROWS).filter("kept").select(
        F.col("row_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    keyed = docs.withColumn("_text_key", F.unhex(F.md5(F.coalesce(F.col(text_column), F.lit("")))))
    same = keyed[id_column].eqNullSafe(kept["_id"]) & (keyed["_text_key"] == kept["_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates([id_column, "_text_key"]).select(*docs.columns)


def _judged(source: DataFrame, threshold: float, words: int, bands: int, rows: int) -> DataFrame:
    """(row_id, text_key, component_id, kept) of documents (row_id, text)."""
    signed = pin(sign(source, bands, rows, words), "bag-signatures")
    parts = parts_for(source.sparkSession, signed.count(), TEXTS_PER_FILE)
    texts = pin(first_per(signed.filter("weight > 0"), ["text_key"], [F.asc_nulls_last("row_id")]), "bag-texts", parts=parts)

    members = texts.select("text_key", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        members.groupBy("bucket").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high"))
        .filter("low <> high")
    )
    members = pin(members.join(buckets, "bucket"), "bag-buckets", parts=parts)
    # The leader is the smallest key in half of the buckets and the largest in the others.
    led = F.when(F.pmod("bucket", F.lit(2)) == 0, F.col("low")).otherwise(F.col("high"))
    members = members.withColumn("leader", led)
    stars = members.select(F.col("leader").alias("a"), F.col("text_key").alias("b")).filter("a <> b").distinct()

    side = lambda x: texts.select(
        F.col("text_key").alias(x), F.col("weight").alias(f"{x}_weight"), F.col("sketch").alias(f"{x}_sketch"))
    alike = _alike("a", "b", threshold, max(COMPONENTS, bands * rows))
    stars = pin(stars.join(side("a"), "a").join(side("b"), "b").filter(alike).select("a", "b"), "bag-stars", parts=parts)

    crowd = members.select("text_key").distinct().join(texts.select("text_key", "row_id"), "text_key")
    keyed = source.withColumn("text_key", F.unhex(F.md5("text")))
    wanted = pin(
        keyed.join(crowd, keyed["row_id"].eqNullSafe(crowd["row_id"]) & (keyed["text_key"] == crowd["text_key"]), "left_semi")
        .select("row_id", "text_key", "text").dropDuplicates(["row_id", "text_key"]).select("text_key", "text"),
        "bag-crowd", parts=parts,
    )

    def with_texts(pairs: DataFrame) -> DataFrame:
        left = wanted.select(F.col("text_key").alias("a"), F.col("text").alias("left"))
        right = wanted.select(F.col("text_key").alias("b"), F.col("text").alias("right"))
        return pairs.join(left, "a").join(right, "b")

    met = pin(star_overlaps(with_texts(stars), threshold, words), "bag-links", parts=parts)
    links = met.filter("linked").select("a", "b")
    roots = pin(components(links), "bag-roots", parts=parts)

    # What the leaders left apart: all pairs of a bucket across components.
    placed = members.select("bucket", "band", "leader", "text_key").join(
        roots.withColumnRenamed("node", "text_key"), "text_key", "left"
    ).withColumn("root", F.coalesce("root", "text_key"))
    split = placed.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1")
    open_ = pin(placed.join(split.select("bucket"), "bucket"), "bag-open", parts=parts)
    # Edits of their own keep most texts of a crowd from overlapping enough with anything: an exact bound.
    single = open_.select("text_key").distinct().join(texts.select("text_key", "weight", "sketch", "bands"), "text_key")
    bound = shareable(single.join(wanted, "text_key").select("text_key", "weight", "text"), words)
    single = pin(
        single.join(bound, "text_key").filter(F.col("can_share") >= F.lit(threshold) * F.col("weight") - F.lit(1e-9)), "bag-able", parts=parts)
    # Leaders have met all others of their bucket. What the others have of the leader bounds what they share.
    units = met.select(F.col("a").alias("leader"), F.col("b").alias("text_key"), "units", _ones(F.col("units")).alias("of_leader"))
    open_ = open_.filter("text_key <> leader").join(single, "text_key").join(units, ["leader", "text_key"], "left")
    half = lambda x: open_.select(
        "bucket", "band", F.col("text_key").alias(x), F.col("units").alias(f"{x}_units"),
        (F.col("can_share") - F.col("of_leader")).alias(f"{x}_beside"), F.col("root").alias(f"{x}_root"), F.col("bands").alias(f"{x}_bands"),
        F.col("weight").alias(f"{x}_weight"), F.col("sketch").alias(f"{x}_sketch"), F.col("can_share").alias(f"{x}_share"))
    enough = lambda most: most >= F.lit(threshold) * (F.col("a_weight") + F.col("b_weight") - most) - F.lit(1e-9)
    of_leader = _ones(F.zip_with("a_units", "b_units", lambda x, y: x.bitwiseAND(y)))
    bounded = F.coalesce(enough(of_leader + F.least("a_beside", "b_beside")), F.lit(True))
    # A pair counts in the first band that it shares; bands salt their buckets, so equal ones are of one band.
    before = [F.slice(f"{x}_bands", F.lit(1), F.col("band")) for x in ("a", "b")]
    rest = half("a").join(half("b").drop("band"), "bucket").filter(
        (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & enough(F.least("a_share", "b_share")) & alike
        & ~F.arrays_overlap(*before) & bounded
    ).select("a", "b").distinct()
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = rest.join(tested, ["a", "b"], "left_anti")
    more = pin(overlaps(with_texts(rest), threshold, words), "bag-more-links", parts=parts)
    if not more.isEmpty():
        # Whole components meet: their roots are linked.
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        joined = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(
            F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        again = pin(components(joined).select(F.col("node").alias("root"), F.col("root").alias("top")), "bag-tops", parts=parts)
        grown = roots.join(again, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        lone = again.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots, "node", "left_anti")
        roots = pin(grown.unionByName(lone), "bag-all-roots", parts=parts)

    named = texts.select("text_key", "row_id").join(roots.withColumnRenamed("node", "text_key"), "text_key", "left")
    named = pin(named.withColumn("root", F.coalesce("root", "text_key")), "bag-named", parts=parts)
    least = named.groupBy("root").agg(F.min("row_id").alias("component_id"))
    classes = named.join(least, "root").select("text_key", "component_id", F.lit(True).alias("_known"))
    out = signed.select("row_id", "text_key").join(classes, "text_key", "left")
    component = F.when(F.col("_known"), F.col("component_id")).otherwise(F.col("row_id"))
    return out.select("row_id", "text_key", component.alias("component_id"), F.col("row_id").eqNullSafe(component).alias("kept"))
