"""Repeated passages of words by level-wise doubling.

A window of 35 words can only repeat if every shorter run of words in it does. Level one looks at runs of
5 words: each window names one of them, the one with the smallest hash, so equal windows name equal runs at equal
places and about one place in sixteen is looked at. Windows whose run occurs once are out. The others are extended to runs of
twice the length, again one named by each window, and so on up to the window itself, until no candidates
survive. From the second level on a candidate is not a document but the words around a named run; equal
surroundings are one candidate with a number of copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytree.llm.hotkeys import hot_values, join_spread
from tallytree.llm.rawtext import RollingHash, WordGrid, batches, mixed, places_of_minima
from tallytree.session import pin

WINDOW, BASE = 35, 5
_U = np.uint64


def level_lengths(window: int, base: int) -> list[int]:
    """``base``, twice that and so on, at last ``window``."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _starts_of_runs(*columns: np.ndarray) -> np.ndarray:
    """Where at least one of the columns differs from the row before."""
    new = np.zeros(columns[0].size, dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def named_runs(words: np.ndarray, row: np.ndarray, last: np.ndarray, window: int, length: int):
    """The runs of ``length`` words that the windows inside each row name.

    ``words`` are hashes, ``row`` is the row of each and ``last`` the end of that row. Gives for every run its row, place,
    hash, and the least and most distance of the starts of its windows before it.
    """
    if words.size < window:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0, _U)] + [np.zeros(0, np.int64)] * 2
    hashes = RollingHash(words).windows(length)
    place = places_of_minima(hashes, window - length + 1)
    start = np.flatnonzero(np.arange(place.size) + window <= last[: place.size])
    place, of = place[start], row[start]
    first = _starts_of_runs(place, of)
    end = np.concatenate((first[1:], [start.size]))[: first.size] - 1
    p = place[first]
    return of[first], p, hashes[p], p - start[end], p - start[first]


def _anchors(docs: DataFrame, window: int, length: int) -> DataFrame:
    """The runs of the first level: where they are and a hash of the words that their windows cover."""
    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text"):
            grid = WordGrid(texts)
            words = grid.hashes()
            row, place, key, least, most = named_runs(words, grid.row, (grid.first + grid.count)[grid.row], window, length)
            around = np.zeros(0, _U)
            if place.size:
                around = RollingHash(words).of(place - most, place - least + window)
                around = mixed(around ^ mixed(most.astype(_U)))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(at), part.column(1).take(at), pa.array((place - grid.first[row]).astype(np.int32)),
                pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16)),
                pa.array(key.view(np.int64)), pa.array(around.view(np.int64)),
            ], ["row_id", "text_key", "place", "least", "most", "key", "around"])

    kind = docs.schema["row_id"].dataType.simpleString()
    return docs.mapInArrow(
        work, f"row_id {kind}, text_key long, place int, least short, most short, key long, around long")


def _cut(found: DataFrame, window: int) -> DataFrame:
    """Hashes of the words around each wanted run."""
    names = ["key", "around", "least", "most", "copies", "words"]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text"):
            grid = WordGrid(texts)
            words = grid.hashes()
            rows = []
            for first, wanted in zip(grid.first, part.column(part.schema.get_field_index("wanted")).to_pylist()):
                for w in wanted:
                    a = first + w["place"] - w["most"]
                    rows.append((*(w[n] for n in names[:-1]), words[a : first + w["place"] - w["least"] + window].tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

    return found.select("text", "wanted").mapInArrow(
        work, "key long, around long, least short, most short, copies long, words binary")


def _extended(candidates: DataFrame, window: int, length: int) -> DataFrame:
    """The runs of ``length`` words that the living windows of each candidate name.

    ``mark`` is the hash of a run and its place before the run of the first level; near and far are
    the distances of the first starts of its windows before that.
    """
    names = ["key", "around", "copies", "near", "far", "mark"]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 4096):
                part = whole.slice(at, 4096)
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                blobs = column["words"].to_pylist()
                sizes = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
                ends = np.cumsum(sizes)
                begin, most = ends - sizes, column["most"].to_numpy().astype(np.int64)
                words = np.frombuffer(b"".join(blobs), dtype=_U)
                alive = np.zeros(words.size, dtype=bool)
                for b, m, ranges in zip(begin, most, column["alive"].to_pylist()):
                    for r in ranges:
                        alive[b + m - r["far"] : b + m - r["near"] + 1] = True
                row = np.repeat(np.arange(sizes.size), sizes)
                of, place, found, least, far = named_runs(words, row, ends[row], window, length)
                # Back to single windows, of which only the living count, and together again.
                each = far - least + 1
                start = np.repeat(place - far, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                run = np.repeat(np.arange(of.size), each)[alive[start]]
                start = start[alive[start]]
                broken = np.cumsum(np.concatenate(([0], np.diff(start) != 1))) if start.size else start
                first = _starts_of_runs(run, broken)
                last = np.concatenate((first[1:], [start.size]))[: first.size] - 1
                run = run[first]
                of = of[run]
                anchor = begin[of] + most[of]
                mark = mixed(found[run] ^ mixed((place[run] - anchor).astype(_U)))
                pick = pa.array(of)
                yield pa.RecordBatch.from_arrays([
                    column["key"].take(pick), column["around"].take(pick), column["copies"].take(pick),
                    pa.array((anchor - start[last]).astype(np.int16)), pa.array((anchor - start[first]).astype(np.int16)),
                    pa.array(mark.view(np.int64))], names)

    return candidates.select("key", "around", "most", "copies", "words", "alive").mapInArrow(
        work, "key long, around long, copies long, near short, far short, mark long")


def repeated_windows(docs: DataFrame, window: int = WINDOW, base: int = BASE) -> DataFrame:
    """(row_id, text_key, spans): for rows of ``docs`` (row_id, text_key, text) with repeats, the word ranges covered by them.

    Ranges may overlap and are in no order.
    """
    lengths = level_lengths(window, base)
    anchors = pin(_anchors(docs, window, lengths[0]), "doubling-anchors")
    keys = anchors.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("a0"), F.max("around").alias("a1")).filter("n > 1")
    keys = pin(keys.select("key", "n", (F.col("a0") != F.col("a1")).alias("differs")), "doubling-keys")
    hot = hot_values(keys, "key", anchors.count())
    hits = pin(join_spread(anchors, keys.drop("n"), ["key"], "key", hot, F.struct("row_id", "place")), "doubling-hits")

    # Equal surroundings are one candidate; any of the documents that hold it can lend the words.
    around = hits.filter("differs").groupBy("key", "around").agg(
        F.first("least").alias("least"), F.first("most").alias("most"), F.count(F.lit(1)).alias("copies"),
        F.first("row_id").alias("row_id"), F.first("text_key").alias("text_key"), F.first("place").alias("place"))
    wanted = around.groupBy(F.col("row_id").alias("_row"), F.col("text_key").alias("_key")).agg(
        F.collect_list(F.struct("key", "around", "least", "most", "copies", "place")).alias("wanted"))
    same = docs["row_id"].eqNullSafe(F.col("_row")) & (docs["text_key"] == F.col("_key"))
    candidates = _cut(docs.join(wanted, same), window)
    whole_rows = hits.filter("differs").groupBy("row_id", "text_key", "place").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not whole_rows.isEmpty():  # rows that repeat with their id lend their words more than once
        candidates = candidates.dropDuplicates(["key", "around"])
    candidates = pin(candidates, "doubling-words")

    ranges = None
    living = candidates.withColumn("alive", F.array(F.struct(F.col("least").alias("near"), F.col("most").alias("far"))))
    for length in lengths[1:] or lengths:
        named = pin(_extended(living, window, length), f"doubling-{length}")
        counted = named.groupBy("key", "mark").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
        counted = pin(counted.filter("copies > 1").select("key", "mark", "n"), f"doubling-twice-{length}")
        hot = hot_values(counted, "mark", named.count())
        alive = join_spread(named.drop("copies"), counted.drop("n"), ["key", "mark"], "mark", hot, F.col("around"))
        ranges = pin(alive.groupBy("key", "around").agg(F.collect_list(F.struct("near", "far")).alias("alive")), f"doubling-alive-{length}")
        if length == window or ranges.isEmpty():
            break
        living = candidates.join(ranges, ["key", "around"])

    place = lambda near, far: F.struct((F.col("place") - far).alias("from"), (F.col("place") - near + window).alias("to"))
    whole = hits.filter("NOT differs").select("row_id", "text_key", place(F.col("least"), F.col("most")).alias("span"))
    sizes = hits.filter("differs").groupBy("around").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_values(sizes, "around", hits.count())
    partly = join_spread(hits.filter("differs"), ranges, ["key", "around"], "around", hot, F.struct("row_id", "place"))
    partly = partly.select("row_id", "text_key", "place", F.explode("alive").alias("r")).select(
        "row_id", "text_key", place(F.col("r.near"), F.col("r.far")).alias("span"))
    return whole.unionByName(partly).groupBy("row_id", "text_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(
    docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", window: int = WINDOW, base: int = BASE
) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_sha256 and kept_text instead of the text.

    Words are longest runs of anything but space and the characters 9 to 13; a null text has none. Each word
    covered by a ``window`` of words that also starts elsewhere, in the same or another row, goes; windows are judged on
    the input. Repeated rows, also those with null ids, are each other's repeats. ``kept_text`` is the kept words joined by one
    space, null where the text is; ``kept_sha256`` is of its UTF-8, of the empty string for null. Texts shorter than a window lose nothing. An
    empty table gives an empty one. Result columns replace columns of ``docs`` with their names.
    """
    added = ("n_words", "n_removed", "kept_sha256", "kept_text")
    own = [c for c in docs.columns if c not in added and c != text_column]
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)), F.col(id_column).alias("row_id"),
        F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    found = repeated_windows(keyed.select("row_id", "text_key", "text"), window, base)
    spans = pin(found.withColumnsRenamed({"row_id": "_row", "text_key": "_key"}), "doubling-spans")
    joined = keyed.join(spans, keyed["row_id"].eqNullSafe(F.col("_row")) & (keyed["text_key"] == F.col("_key")), "left")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text"):
            rows, at = [], part.schema.get_field_index("text")
            missing = part.column(at).is_null().to_pylist()
            for text, none, ranges in zip(texts, missing, part.column(at + 1).to_pylist()):
                words = text.split()  # bytes split at space and the characters 9 to 13
                kept, upto = [], 0
                for r in sorted((r["from"], r["to"]) for r in ranges or ()):
                    kept += words[upto : max(upto, r[0])]
                    upto = max(upto, r[1])
                kept += words[upto:]
                out = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), None if none else out.decode()))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in range(at)), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds))],
                [*own, *added])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    return joined.select(*(f"own_{i}" for i in range(len(own))), "text", "spans").mapInArrow(
        work, schema + "n_words long, n_removed long, kept_sha256 string, kept_text string")
