"""Best-fit packing of tokenised documents by minimum bin slack.

A sequence starts from the longest piece left. Over the lengths that are still available, a bitset
holds every sum they can reach; the fullest feasible sum fills the sequence and its pieces leave.
Pieces are dealt into groups of bounded size by hash, and each group packs its own sequences.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallytree.session import pin

SEQUENCE, END_ID = 1024, 2
#: Pieces of one group, on average. A group loses about half a sequence at its end.
GROUP_PIECES = 16384
#: Texts of about this many characters are encoded at a time.
ENCODE_CHARS = 1 << 19


class Encoder:
    """Token ids of a vocabulary of the ``tokenizers`` library, without special tokens added.

    ``ranks`` names the same vocabulary as byte ranks. With it ordinary text goes through the faster
    tiktoken, whose ids are the same; the first text of every batch is encoded by both and must agree, and a text
    that spells out an added token is left to ``tokenizers``.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self._exact = Tokenizer.from_file(vocabulary)
        self._added = [t.content for t in self._exact.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def _by_library(self, text: str) -> list[int]:
        return self._exact.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._fast is None:
            return [self._by_library(t) for t in texts]
        out = [
            self._by_library(t) if any(a in t for a in self._added) else self._fast.encode_ordinary(t)
            for t in texts
        ]
        if texts and out[0] != self._by_library(texts[0]):
            raise ValueError("the rank table and the vocabulary give different ids")
        return out


def paths() -> tuple[str, str]:
    """The public byte-level vocabulary and its ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(
    docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, size: int = SEQUENCE,
    end_id: int = END_ID, keep_ids: bool = False,
) -> DataFrame:
    """(row_id, row_no, piece, start, length, ids_crc32[, ids]) of documents (row_id, text).

    A document is its ids and ``end_id``; a null text has the end only. Documents longer than
    ``size`` are cut into pieces of ``size``, the first of which may be shorter.
    """
    if vocabulary is None:
        vocabulary, ranks = paths()
    names = ["row_id", "row_no", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [None, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks)
        for batch in stream:
            texts = ["" if t is None else t for t in batch.column(2).to_pylist()]
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end]) <= ENCODE_CHARS):
                    chars += len(texts[end])
                    end += 1
                rows: list[list] = [[] for _ in names]
                taken = []
                for i, ids in enumerate(encoder.encode(texts[start:end]), start):
                    tokens = np.array(ids + [end_id], dtype="<u4")
                    first = (len(tokens) - 1) % size + 1
                    edges = [0, *range(first, len(tokens) + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = tokens[a:b]
                        taken.append(i)
                        for column, value in zip(rows[2:], (k, a, b - a, zlib.crc32(part.tobytes()), part)):
                            column.append(value)
                arrays = [batch.column(c).take(pa.array(taken, pa.int64())) for c in (0, 1)]
                arrays += [pa.array(v, k) for v, k in zip(rows[2:], kinds[2:])]
                yield pa.RecordBatch.from_arrays(arrays, names)
                start = end

    source = docs.select("row_id", F.monotonically_increasing_id().alias("row_no"), "text")
    kind = docs.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, row_no long, piece int, start long, length long, ids_crc32 long"
    return source.mapInArrow(work, schema + (", ids array<int>" if keep_ids else ""))


def fullest(counts: np.ndarray, lengths: list[int], room: int) -> list[int]:
    """Lengths whose sum comes nearest to ``room`` from below; ``lengths``: those with a count, ascending."""
    bits, goal, steps = 1, 1 << room, []
    mask = (goal << 1) - 1
    for k in range(len(lengths) - 1, -1, -1):
        length = lengths[k]
        if length > room:
            continue
        for _ in range(min(int(counts[length]), room // length)):
            more = (bits | bits << length) & mask
            if more == bits:
                break
            steps.append((length, bits))
            bits = more
            if bits & goal:
                break
        if bits & goal:
            break
    left, out = bits.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            out.append(length)
            left -= length
    return out


def pack_lengths(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of every length, by minimum bin slack."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1)
    upto = np.cumsum(counts)
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    present = np.flatnonzero(counts).tolist()
    number = 0
    while present:
        longest = present[-1]
        chosen = [longest]
        counts[longest] -= 1
        if not counts[longest]:
            present.pop()
        if longest < size:
            for length in fullest(counts, present, size - longest):
                chosen.append(length)
                counts[length] -= 1
                if not counts[length]:
                    present.remove(length)
        at = 0
        for length in chosen:
            upto[length] -= 1
            i = order[upto[length]]
            sequence[i], offset[i] = number, at
            at += length
        number += 1
    return sequence, offset


def packed(parts: DataFrame, size: int = SEQUENCE, group: int = GROUP_PIECES) -> DataFrame:
    """``parts`` with sequence_id and offset. A group is bounded; sequences are numbered inside it."""
    names = parts.columns
    groups = max(1, -(-parts.count() // group))
    dealt = parts.withColumn("_group", F.pmod(F.xxhash64("row_no", "piece"), F.lit(groups)))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset = pack_lengths(frame["length"].to_numpy(), size)
        return frame.assign(sequence_id=frame["_group"].to_numpy() * (1 << 32) + sequence, offset=offset)[
            [*names, "sequence_id", "offset"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return dealt.groupBy("_group").applyInPandas(work, schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False, **options
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece of every row.

    Null and empty texts are one piece of the end id. Rows with a repeated or null id are documents of
    their own. With ``keep_ids`` the token ids come along, and a sequence is its pieces in order of offset.
    """
    source = docs.select(F.col(id_column).alias("row_id"), F.col(text_column).alias("text"))
    parts = pin(pieces(source, keep_ids=keep_ids, **options), "pack-pieces")
    return packed(parts).drop("row_no").withColumnRenamed("row_id", id_column)
