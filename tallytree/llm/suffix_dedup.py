"""Repeated passages by suffix sorting, deep-shallow.

A start whose 400-byte string also starts elsewhere is a suffix with a neighbour in suffix order that
shares 400 bytes with it. Only suffixes that can have such a neighbour are sorted. Every 400-byte
window has an anchor, the smallest hash among its 128-byte strings; equal windows have equal
anchors at equal places. Anchors that occur once cannot matter. Those whose whole surroundings
agree are settled by that. For the others the surroundings meet in one group per anchor, and their suffixes
to the right of the anchor and reversed prefixes to the left are sorted: multikey quicksort to a
shallow depth, then blind tries for groups with a long common prefix. The common lengths of
neighbours in both orders tell which windows are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytree.llm.hotkeys import hot_values, join_spread
from tallytree.llm.rawtext import RollingHash, batches, mixed, places_of_minima
from tallytree.session import pin

LENGTH, ANCHOR = 400, 128
#: Characters that multikey quicksort looks at before a group goes to a blind trie.
SHALLOW = 12
#: Bytes of text whose anchors are looked for at a time; every byte takes several 64-bit numbers meanwhile.
SCAN_BYTES = 1 << 18
#: Different surroundings of one anchor that one task sorts; beyond that windows are compared by hash, spread over tasks.
CROWD = 2048
_U = np.uint64


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n, i = min(len(a), len(b)), start
    while i < n and a[i : i + 64] == b[i : i + 64]:
        i += 64
    i = min(i, n)
    while i < n and a[i] == b[i]:
        i += 1
    return i


def blind_order(strings: list[bytes], rows: list[int], depth: int) -> list[int]:
    """``rows`` in order of their strings, which agree up to ``depth``, by a blind trie.

    A node knows how many bytes its strings share and branches on the next; the bytes between are
    not stored. A string first follows its branches blindly, is compared once with the leaf it
    reaches, and is then hung in where the two part. End of string is branch -1.
    """
    at = lambda row, k: strings[row][k] if k < len(strings[row]) else -1
    root: list = [None, None, [rows[0]]]  # [shared, branches, rows of a leaf]
    for row in rows[1:]:
        node, path = root, []
        while node[1] is not None:
            path.append(node)
            node = node[1].get(at(row, node[0])) or next(iter(node[1].values()))
        other = node[2][0]
        shared = common_prefix(strings[row], strings[other], depth)
        if shared == len(strings[row]) == len(strings[other]):
            node[2].append(row)
            continue
        place = next((n for n in path if n[0] >= shared), node)
        if place[1] is not None and place[0] == shared:
            place[1][at(row, shared)] = [None, None, [row]]
        else:
            place[:] = [shared, {at(other, shared): list(place), at(row, shared): [None, None, [row]]}, None]
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[1] is None:
            out += node[2]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Row numbers in order of the strings, which agree in their first ``depth`` bytes."""
    out: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        rows, k = stack.pop()
        if len(rows) < 2:
            out += rows
        elif k - depth >= shallow:
            out += blind_order(strings, rows, k)
        else:
            at = [strings[r][k] if k < len(strings[r]) else -1 for r in rows]
            pivot = sorted((at[0], at[len(at) // 2], at[-1]))[1]
            low, same, high = ([r for r, c in zip(rows, at) if test(c)] for test in (pivot.__gt__, pivot.__eq__, pivot.__lt__))
            stack.append((high, k))
            if pivot < 0:
                stack += [([r], k) for r in reversed(same)]  # equal strings, which have ended
            else:
                stack.append((same, k + 1))
            stack.append((low, k))
    return out


def anchors_of(texts: list[bytes], length: int, anchor: int):
    """(text, place, least and most distance of the windows' starts before it, anchor hash, surroundings hash)."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if data.size < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)] * 2
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    rolling = RollingHash(data)
    whole = rolling.windows(anchor)
    place = places_of_minima(whole, length - anchor + 1)
    start = np.arange(place.size)
    row = np.repeat(np.arange(len(texts)), sizes)[: place.size]
    ok = start + length <= ends[row]
    start, place, row = start[ok], place[ok], row[ok]
    if not start.size:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, _U)] * 2
    new = np.concatenate(([True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [start.size])) - 1
    p, row = place[first], row[first]
    most, least = p - start[first], p - start[last]
    around = rolling.of(p - most, p - least + length)
    around = mixed(around ^ mixed(most.astype(_U)))
    return row, p - (ends[row] - sizes[row]), least, most, whole[p], around


def _scan(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(stream, "text", SCAN_BYTES):
            row, place, least, most, key, around = anchors_of(texts, length, anchor)
            digests = [hashlib.md5(t, usedforsecurity=False).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(row)), pa.array(digests, pa.binary()).take(pa.array(row)),
                pa.array(place.astype(np.int32)), pa.array(least.astype(np.int16)), pa.array(most.astype(np.int16)),
                pa.array(key.view(np.int64)), pa.array(around.view(np.int64)),
            ], ["row_id", "text_key", "place", "least", "most", "key", "around"])

    kind = docs.schema["row_id"].dataType.simpleString()
    return docs.mapInArrow(
        work, f"row_id {kind}, text_key binary, place int, least short, most short, key long, around long")


def repeats_in_group(strings: list[bytes], least: np.ndarray, most: np.ndarray, copies: np.ndarray, length: int, anchor: int) -> np.ndarray:
    """For surroundings of one anchor: which windows, by distance of the start before the anchor, occur twice.

    Row i of the result is string i, column d the window that starts d bytes before the anchor.
    """
    n, top = len(strings), int(most.max()) + 1
    distance = np.arange(top)
    valid = (distance >= least[:, None]) & (distance <= most[:, None])

    def classes(parts: list[bytes], depth: int, needed: np.ndarray) -> np.ndarray:
        """Equal numbers for strings that agree in the first ``needed[d]`` bytes, for every d."""
        order = deep_shallow_order(parts, depth)
        shared = np.array([0] + [common_prefix(parts[a], parts[b], depth) for a, b in zip(order, order[1:])])
        numbers = np.cumsum(shared[:, None] < needed[None, :], axis=0)
        out = np.empty_like(numbers)
        out[order] = numbers
        return out

    right = classes([s[m:] for s, m in zip(strings, most)], anchor, length - distance)
    left = classes([s[:m][::-1] for s, m in zip(strings, most)], 0, distance)
    both = np.where(valid, left * (n + 1) + right, -1 - np.arange(n)[:, None])
    order = np.argsort(both, axis=0, kind="stable")
    ranked = np.take_along_axis(both, order, axis=0)
    twin = np.zeros_like(valid)
    equal = ranked[1:] == ranked[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    out = np.zeros_like(valid)
    np.put_along_axis(out, order, twin, axis=0)
    return (out | (copies > 1)[:, None]) & valid


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[0::2].tolist(), (edges[1::2] - 1).tolist()))


def _pair(strings: list[bytes], least: list[int], most: list[int], copies: list[int], length: int, anchor: int) -> list[list[tuple[int, int]]]:
    """The same for two strings, which need no sorting: the distances at which both sides agree far enough."""
    (a, b), (ma, mb) = strings, most
    right = common_prefix(a[ma:], b[mb:], anchor)
    left = common_prefix(a[:ma][::-1], b[:mb][::-1])
    low, high = max(*least, length - right), min(*most, left)
    shared = [(low, high)] if low <= high else []
    return [[(x, y)] if n > 1 else shared for x, y, n in zip(least, most, copies)]


def _sorted_groups(length: int, anchor: int):
    """(key, around, near, far) of the repeated windows, from rows that are sorted by key and surroundings."""

    def ranges(key: int, group: list[tuple]) -> Iterator[tuple]:
        around, least, most, copies, strings = (list(c) for c in zip(*group))
        if len(group) == 2:
            found = _pair(strings, least, most, copies, length, anchor)
        else:
            flags = repeats_in_group(strings, np.array(least), np.array(most), np.array(copies), length, anchor)
            found = [_runs(f) for f in flags]
        return ((key, a, x, y) for a, runs in zip(around, found) for x, y in runs)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int16(), pa.int16())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "around", "near", "far"])

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for part in stream:
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if row[0] != key:
                    if len(group) > 1:
                        out += ranges(key, group)
                    key, group = row[0], []
                if not group or group[-1][0] != row[1]:  # a repeated row brings nothing new
                    group.append(row[1:])
            if len(out) > 10000:
                yield batch(out)
                out = []
        if len(group) > 1:
            out += ranges(key, group)
        if out:
            yield batch(out)

    return work


def _window_hashes(length: int):
    """Every window of the surroundings of crowded anchors."""
    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                column = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                least, most = (column[n].to_numpy().astype(np.int64) for n in ("least", "most"))
                blobs = column["bytes"].to_pylist()
                begin = np.concatenate(([0], np.cumsum([len(b) for b in blobs])[:-1]))
                each = most - least + 1
                row = np.repeat(np.arange(each.size), each)
                step = np.arange(row.size) - np.repeat(np.cumsum(each) - each, each)
                hashes = RollingHash(np.frombuffer(b"".join(blobs), dtype=np.uint8)).of(begin[row] + step, begin[row] + step + length)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [*(column[n].take(pick) for n in ("key", "around", "copies")), pa.array((most[row] - step).astype(np.int16)), pa.array(hashes.view(np.int64))],
                    ["key", "around", "copies", "near", "window"])

    return work


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD) -> DataFrame:
    """(text_key, spans): for texts of ``docs`` (row_id, text) with repeats, the byte ranges (from, to) covered by them.

    ``text_key`` is the md5 of the text. Ranges may overlap and are in no order.
    """
    anchors = pin(_scan(docs, length, anchor), "suffix-anchors")
    keys = anchors.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("around").alias("a0"), F.max("around").alias("a1")).filter("n > 1")
    keys = pin(keys.select("key", "n", (F.col("a0") != F.col("a1")).alias("differs")), "suffix-keys")
    # The anchors of very frequent passages spread over tasks.
    hot = hot_values(keys, "key", anchors.count())
    spread = F.struct("row_id", "text_key", "place")
    hits = pin(join_spread(anchors, keys.drop("n"), ["key"], "key", hot, spread), "suffix-hits")

    around = hits.filter("differs").groupBy("key", "around", "least", "most").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("text_key", "row_id", "place")).alias("one"))
    around = pin(around.select("key", "around", "least", "most", "copies", "one.*"), "suffix-around")
    sizes = around.groupBy("key").agg((F.count(F.lit(1)) > crowd).alias("crowded"))
    wanted = around.join(sizes, "key").groupBy("row_id", "text_key").agg(
        F.collect_list(F.struct("key", "around", "least", "most", "copies", "place", "crowded")).alias("wanted"))
    keyed = docs.withColumn("text_key", F.unhex(F.md5("text")))
    found = keyed.join(wanted.withColumnsRenamed({"row_id": "_row", "text_key": "_key"}),
                       keyed["row_id"].eqNullSafe(F.col("_row")) & (keyed["text_key"] == F.col("_key")))
    # Cut the surroundings out of the text, as bytes.
    cut = found.select(F.explode("wanted").alias("w"), F.col("text").cast("binary").alias("text")).select(
        "w.key", "w.around", "w.least", "w.most", "w.copies", "w.crowded",
        F.substring("text", F.col("w.place") - F.col("w.most") + 1, F.lit(length) + F.col("w.most") - F.col("w.least")).alias("bytes"))
    cut = pin(cut, "suffix-surroundings")
    met = cut.filter("NOT crowded").select("key", "around", "least", "most", "copies", "bytes")
    compared = met.repartition("key").sortWithinPartitions("key", "around").mapInArrow(
        _sorted_groups(length, anchor), "key long, around long, near short, far short")
    crowds = cut.filter("crowded").select("key", "around", "least", "most", "copies", "bytes")
    windows = crowds.mapInArrow(
        _window_hashes(length), "key long, around long, copies long, near short, window long")
    windows = pin(windows, "suffix-windows")
    twice = windows.groupBy("key", "near", "window").agg(
        F.sum("copies").alias("n")).filter("n > 1")
    crowded = windows.join(twice.select("key", "near", "window"), ["key", "near", "window"]).select(
        "key", "around", "near", F.col("near").alias("far"))
    ranges = compared.unionByName(crowded.distinct())

    whole = hits.filter("NOT differs").select("text_key", "place", F.col("least").alias("near"), F.col("most").alias("far"))
    hot = hot_values(around, "around", hits.count(), "copies")
    partly = join_spread(hits.filter("differs"), ranges, ["key", "around"], "around", hot, spread).select("text_key", "place", "near", "far")
    spans = whole.unionByName(partly).select(
        "text_key", (F.col("place") - F.col("far")).alias("from"), (F.col("place") - F.col("near") + length).alias("to"))
    return spans.distinct().groupBy("text_key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of the ranges."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", length: int = LENGTH, anchor: int = ANCHOR, crowd: int = CROWD
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and kept_text instead of the text.

    Texts are UTF-8 bytes, a null one is empty. Each byte covered by a ``length``-byte string that also starts
    elsewhere, in the same or another row, goes; strings are judged on the input. Repeated rows
    are each other's repeats. ``kept_sha256`` is of the remaining bytes; ``kept_text`` leaves out a
    character of which only some bytes remain, and is null where the text is. Shorter texts stay whole. Result columns
    replace columns of ``docs`` with their names.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    own = [c for c in docs.columns if c not in added and c != text_column]
    source = docs.select(F.col(id_column).alias("row_id"), F.col(text_column).alias("text"))
    spans = pin(repeated_spans(source, length, anchor, crowd), "suffix-spans")
    keyed = docs.select(
        *(F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(own)), F.col(text_column).alias("text"), F.unhex(F.md5(text_column)).alias("_text_key"))
    joined = keyed.join(spans.withColumnRenamed("text_key", "_key"), F.col("_text_key") == F.col("_key"), "left")

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = []
                for text, ranges in zip(part.column(len(own)).to_pylist(), part.column(len(own) + 1).to_pylist()):
                    data, runs = (text or "").encode(), _merged(ranges)
                    kept = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)]))
                    rows.append((
                        len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                        text if text is None or not runs else kept.decode("utf-8", "ignore")))
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(own))), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*own, *added])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in own)
    return joined.select(*(f"own_{i}" for i in range(len(own))), "text", "spans").mapInArrow(
        work, schema + "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
