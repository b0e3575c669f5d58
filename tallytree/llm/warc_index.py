"""Web archives of page captures and their index, merged from sorted runs.

Captures are written as WARC records by Spark's text writer, whose line separator is the blank
line that ends a record, and read back file by file. Every archive file gives a run of index
entries sorted by URL key and time. The runs are merged into one order: the key space is
cut into ranges, and in each range a loser tree merges the pieces of all runs.
"""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallytree.session import pin, scratch_path

#: Records of one archive file at most; a reader holds one file.
FILE_RECORDS = 2000
_END = "\r\n\r\n"


def digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """The URL in sort order of its site: host names reversed, lower case, without scheme, ``www.`` and fragment."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}{'?' + query.lower() if query else ''}"


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self._runs = runs
        self._heads = [next(r, None) for r in runs]
        self._losers = [-1] * len(runs)
        for i in range(len(runs)):
            self._play(i, first=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, run: int, first: bool = False) -> None:
        node = (run + len(self._runs)) // 2
        while node > 0:
            other = self._losers[node]
            if other < 0 and first:
                self._losers[node] = run
                return
            if self._beats(other, run):
                self._losers[node], run = run, other
            node //= 2
        self._losers[0] = run

    def __iter__(self) -> Iterator[tuple]:
        while self._runs and self._heads[self._losers[0]] is not None:
            run = self._losers[0]
            yield self._heads[run]
            self._heads[run] = next(self._runs[run], None)
            self._play(run)


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_digest, payload_bytes, record_type and refers_to.

    Of the records with one payload of at least ``least`` bytes the one with the largest id is the response and the
    others revisit it. Only digests and ids are grouped.
    """
    out = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "_sha": F.sha1(F.col("html").cast("binary"))})
    last = out.groupBy("_sha").agg(F.max("page_id").alias("_last"))
    same = out.join(last, "_sha")
    revisit = (F.col("payload_bytes") >= least) & F.coalesce(F.col("page_id") != F.col("_last"), F.col("_last").isNotNull())
    return same.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("_last")), "payload_digest": _base32(F.col("_sha"))}).drop("_sha", "_last")


def _base32(hexadecimal: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: 40 digits are eight groups of 20 bits, each four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda k: F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
    return F.concat(*[
        F.substring(F.lit(letters), F.shiftright(group(k), shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
        for k in range(8) for shift in (15, 10, 5, 0)])


def records(captures: DataFrame) -> DataFrame:
    """One text per capture: a WARC response or revisit record without the blank line at its end."""
    clean = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[\\r\\n]+", " ")
    iso = F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ident = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    revisit = F.col("record_type") == "revisit"
    block = F.concat(
        F.lit(http + "Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_END),
        F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return captures.select(F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.col("record_type")), head("WARC-Record-ID", ident("page_id")),
        head("WARC-Target-URI", clean("url")), head("WARC-Date", iso),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(
            head("WARC-Refers-To", ident("refers_to")),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), F.lit("Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(_END), block,
    ).alias("value"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Archive files of pages (page_id, url, html, captured) in a new folder, gzip-compressed, of bounded record numbers."""
    records(typed(pages)).write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS).text(path)


_HEADER = re.compile(rb"([A-Za-z-]+): ?(.*?)\r\n")


def parsed(data: bytes) -> Iterator[tuple[int, dict[bytes, bytes], bytes]]:
    """(offset, headers, block) of every record, by its declared length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        head = data[at:end]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, v in _HEADER.findall(head)}
        size = int(headers[b"content-length"])
        yield at, headers, data[end : end + size]
        at = end + size + 4


_ENTRY = "page_id long, url string, url_key string, captured string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, file string, start long, run long, place int"


def read_archives(spark, path: str) -> DataFrame:
    """Index entries of every record of every archive file; each file is a run, sorted by URL key, time and id.

    A response is measured anew: ``intact`` says that its payload has the digest of its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def number(value: bytes | None) -> int | None:
        found = (value or b"").removeprefix(b"<urn:capture:").removesuffix(b">")
        return int(found) if found else None

    def work(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for frame in stream:
            for file, content in zip(frame["path"], frame["content"]):
                rows = []
                for start, head, block in parsed(zlib.decompress(content, 31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    declared = head[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    size = int(dict((k.lower(), v) for k, v in _HEADER.findall(http + b"\r\n"))[b"content-length"])
                    kind, url = head[b"warc-type"].decode(), head[b"warc-target-uri"].decode()
                    intact = kind == "revisit" or (len(payload) == size and digest(payload) == declared)
                    rows.append((
                        number(head[b"warc-record-id"]), url, url_key(url), head[b"warc-date"].decode(), size,
                        declared if kind == "revisit" else digest(payload), kind, number(head.get(b"warc-refers-to")), intact, file, start))
                rows.sort(key=lambda r: (r[2], r[3], r[0] is None, r[0]))
                run = int.from_bytes(hashlib.md5(file.encode(), usedforsecurity=False).digest()[:7], "big")
                out = pd.DataFrame([(*r, run, k) for k, r in enumerate(rows)], columns=[
                    f.split()[0] for f in _ENTRY.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    return files.mapInPandas(work, _ENTRY)


def merged_index(entries: DataFrame) -> DataFrame:
    """``entries`` in one order by URL key, time and id, with ``slice`` and ``slot``: sorted by these the index is whole.

    Key ranges hold pieces of all runs. A task reads its rows run by run and merges the runs by a loser tree.
    """
    names = entries.columns
    ranged = entries.repartitionByRange("url_key", "captured", F.asc_nulls_last("page_id")).sortWithinPartitions("run", "place")
    ranged = ranged.withColumn("slice", F.spark_partition_id())

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in stream if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        keys = list(zip(*(table.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "run"))))
        runs: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            runs.setdefault(key[3], []).append(i)
        tree = LoserTree([iter([((keys[i][0], keys[i][1], keys[i][2] is None, keys[i][2] or 0), i) for i in rows]) for rows in runs.values()])
        order = [i for _, i in tree]
        out = table.take(pa.array(order, pa.int64()))
        out = out.append_column("slot", pa.array(range(len(order)), pa.int64()))
        for start in range(0, out.num_rows, 10000):
            yield from out.slice(start, 10000).to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    merged = ranged.mapInArrow(work, schema + ", slot long")
    return merged.select(*[c for c in names if c not in ("run", "place")], "slice", "slot")


def capture_history(pages: DataFrame, path: str | None = None, captured: Column | None = None) -> DataFrame:
    """Archive pages (page_id, url, html), read the archives back and return their merged index, one row per page.

    A null html is an empty payload, a null URL an empty one. Without capture times a page was
    captured page_id seconds after 2020 began. Repeated rows are records of their own; with one id
    all of them are responses. A record whose payload does not match its digest raises.
    """
    spark = pages.sparkSession
    if captured is None:
        captured = F.timestamp_seconds(F.lit(int(dt.datetime(2020, 1, 1, tzinfo=dt.timezone.utc).timestamp())) + F.coalesce("page_id", F.lit(0)))
    path = path or scratch_path(spark, "archives")
    write_archives(pages.select("page_id", "url", "html", captured.alias("captured")), path)
    entries = pin(read_archives(spark, path), "capture-runs")
    broken = entries.filter("NOT intact").limit(1).collect()
    if broken:
        raise ValueError(f"payload of {broken[0]['file']} at {broken[0]['start']} does not match its digest")
    return merged_index(entries)
