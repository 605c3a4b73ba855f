"""WARC archives and their index by external merge.

Records are written by Spark's text writer: a record is a string, and the blank lines that end it are the line separator.  The archives are compressed,
so each is one stream: it is read back piece by piece between blank lines, and no archive is held whole.  Each archive gives a run of
captures.  The runs are dealt out by ranges of (URL key, timestamp) and sorted there by Spark, once; a loser tree merges the sorted runs of each range, so that
the ranges in order hold every URL's history in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, shared_dir

#: Equal payloads of at least this many bytes are stored once.
MIN_REVISIT_BYTES = 1000
#: Captures that a task merges at once; it holds them as Arrow columns.
CAPTURES_PER_RANGE = 200_000
_END = "\r\n\r\n"
_CDX = "url_key string, at bigint, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint"
_NAMES = [c.split()[0] for c in _CDX.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in _CDX.split(", ")]
_SCHEMA = pa.schema(list(zip(_NAMES, _TYPES, strict=True)))


def url_key(url: str = "url"):
    """Sort key: host labels from the right, then the rest in lower case."""
    rest = F.lower(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))


def write_warc(pages: DataFrame, path: str, fetched: str | None = None) -> None:
    """One record per row of ``pages`` (page_id, url, html); ``fetched`` names a column with the times of fetching.

    Null html is an empty payload, a null URL an empty target.  Of equal payloads of at least MIN_REVISIT_BYTES the one with the largest
    page_id is a response, the others revisit it; a payload whose page_ids are all null is a response.  Rows that share
    the largest page_id are responses alike.  Other columns are not read.  Digests and ids alone decide who revisits; what they decide joins the pages by
    (page_id, digest), so that a payload of any number of pages stays spread.  Each task writes one archive, so their size follows the input splits.
    """
    html = F.coalesce("html", F.lit(""))
    # Without times of its own a capture gets one from its id, within 17 years, whatever the id is.
    time = F.coalesce(F.col(fetched), F.timestamp_seconds(F.lit(1_700_000_000))) if fetched else F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 29)))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"), time.alias("time"))
    keyed = pages.select("page_id", F.sha1(html.cast("binary")).alias("digest")).where(F.octet_length(html) >= MIN_REVISIT_BYTES)
    first = keyed.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("refers_to")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    again = keyed.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = materialize(again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    revisit = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\r\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), clean,
        F.lit("\r\nWARC-Date: "), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nX-Payload-Bytes: "), F.col("bytes").cast("string"), F.lit("\r\nX-URL-Key: "), F.regexp_replace(url_key(), r"[\r\n]", ""),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("bytes").cast("string")), F.lit(_END),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.col("html")))
    rows.select(record.alias("value")).write.option("lineSep", _END).option("compression", "gzip").text(path)


class WarcStream:
    """Puts one archive together again from its pieces between blank lines; holds no more than the record that is being read."""

    def __init__(self, name: str) -> None:
        self.name, self.buffer, self.at, self.head, self.need, self.begun = name, bytearray(), 0, None, 0, False

    def feed(self, piece: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """(offset, headers in lower case, payload) of each record that the piece completes."""
        if self.begun:
            self.buffer += _END.encode()
        self.begun = True
        self.buffer += piece
        yield from self._records()

    def _records(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        while self.buffer:
            if self.head is None:
                if (end := self.buffer.find(b"\r\n\r\n")) < 0:
                    return
                lines = self.buffer[:end].decode().split("\r\n")
                if lines[0] != "WARC/1.1":
                    raise ValueError(f"{self.name}: no record at byte {self.at}")
                self.head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
                self.begin, self.need = end + 4, end + 4 + int(self.head["content-length"])
            if len(self.buffer) < self.need + 4:
                return
            if self.buffer[self.need : self.need + 4] != b"\r\n\r\n":
                raise ValueError(f"{self.name}: the record at byte {self.at} does not end where its length says")
            yield self.at, self.head, bytes(self.buffer[self.begin : self.need])
            self.at, self.head = self.at + self.need + 4, None
            del self.buffer[: self.need + 4]

    def close(self) -> Iterator[tuple[int, dict[str, str], bytes]]:
        """The last record: the reader takes the blank lines at the archive's end away, unless a line break before them goes with them."""
        if self.buffer:
            self.buffer += _END.encode()
            yield from self._records()
        if self.buffer:
            raise ValueError(f"{self.name}: the record at byte {self.at} is not whole")


class LoserTree:
    """Merges k sorted iterators: each inner node keeps the loser of its match, so a new item plays one match a level."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.head[i], self.head[j]
        return b is None if a is None or b is None else (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.loser[node]
            if other == -1:
                self.loser[node] = i
                return
            if not self._beats(i, other):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator:
        while self.k and self.head[w := self.loser[0]] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)


def read_captures(spark, path: str) -> DataFrame:
    """One row per record of the archives, each archive a run; digest and size are taken from the payload where the record holds it."""

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = lambda v: int(v[len("<urn:page:") : -1]) if v and v != "<urn:page:>" else None
        stream, out = WarcStream(""), []

        def take(records: Iterator[tuple[int, dict[str, str], bytes]]) -> None:
            for at, h, payload in records:
                stored = h["warc-type"] == "response"
                digest = hashlib.sha1(payload).hexdigest()
                if stored and f"sha1:{digest}" != h["warc-payload-digest"]:
                    raise ValueError(f"{stream.name}: wrong digest at byte {at}")
                time = int(datetime.fromisoformat(h["warc-date"]).timestamp())
                out.append((h["x-url-key"], time, page(h["warc-record-id"]), h["warc-target-uri"], len(payload) if stored else int(h["x-payload-bytes"]), digest if stored else h["warc-payload-digest"][5:], h["warc-type"], page(h.get("warc-refers-to")), stream.name, at))

        for b in batches:
            for file, piece in zip(b.column("file").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if file != stream.name:
                    take(stream.close())
                    stream = WarcStream(file)
                take(stream.feed(piece))
                if len(out) >= 2000:
                    yield _batch(out)
                    out.clear()
        take(stream.close())
        if out:
            yield _batch(out)

    pieces = spark.read.option("lineSep", _END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(captures, _CDX)


def merge_index(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """``captures`` with range_no and range_pos, in which (range_no, range_pos) is the global order by url_key, time, page_id, file, offset.

    There are enough ranges for about ``per_range`` captures each.  A range receives its slice of every run, sorted by Spark, and a loser tree
    merges the slices.  The range key goes down to the record, so that one URL or host may spread over many ranges.
    """
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches, _SCHEMA)
        if not len(whole):
            return
        files = whole.column("file").to_numpy()
        edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1), len(whole)]

        def run(i: int, j: int) -> Iterator[tuple]:
            cut = whole.slice(i, j - i)
            for k in range(0, j - i, 1000):
                part = cut.slice(k, 1000)
                rows = zip(*(part.column(c).to_pylist() for c in ("url_key", "at", "page_id", "offset")), strict=True)
                yield from ((key.encode(), at, page is not None, page or 0, files[i], offset, i + k + n) for n, (key, at, page, offset) in enumerate(rows))

        order = np.fromiter((x[-1] for x in LoserTree([run(int(i), int(j)) for i, j in zip(edges, edges[1:], strict=False)])), np.int64, len(whole))
        part = TaskContext.get().partitionId()
        for k in range(0, len(order), 5000):
            some = whole.take(pa.array(order[k : k + 5000])).combine_chunks()
            place = [pa.array(np.full(len(some), part, np.int32)), pa.array(np.arange(k, k + len(some), dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in some.columns), *place], [*_NAMES, "range_no", "range_pos"])

    key = ["url_key", "at", "page_id", "file", "offset"]
    sorted_runs = captures.repartitionByRange(ranges, *key).sortWithinPartitions("file", "url_key", "at", "page_id", "offset")
    return sorted_runs.mapInArrow(merge, f"{_CDX}, range_no int, range_pos bigint")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back and merge their index: one row per page.

    Repeated rows each have their record, a null page_id stays null, and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_warc(pages, path)
    index = merge_index(materialize(read_captures(spark, path)))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "at", "range_no", "range_pos")
