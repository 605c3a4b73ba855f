"""Token ids in files of directly addressable codes.

An id is split into chunks of eight bits, lowest first.  Level k holds the k-th chunk of every id that has one, a bitmap tells which chunks go on in the
level above, and a directory holds the number of set bits before every 512th.  The place of an id's next chunk is the rank of its bit, so any token is found by
a read of a chunk, a directory entry and at most 64 bytes of bitmap for each level: nothing else is decoded.

A file is: magic, segments, index.  A segment is a header (levels, then the chunks of each level) and for each level its chunks, and but for the last its bitmap and
directory.  The index has the documents' ids, the tokens up to the end of each, and the segments' places.  All numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .packing import encode16
from .store import shared_dir

MAGIC = b"MRDAC\x00\x00\x01"
END_ID = 2
#: Tokens of a segment, the most that a writer holds besides one document; the last of a file has fewer.
SEGMENT_TOKENS = 1 << 20
#: Bits of a bitmap for each directory entry.
RANK_BITS = 512
_TAIL = struct.Struct("<QQQ")  # documents, segments, where the index begins


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of ``ids`` (unsigned, up to 32 bits)."""
    rest, sizes, parts = ids.astype(np.uint32), [], []
    while True:
        sizes.append(len(rest))
        parts.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest > 0xFF
        if not more.any():
            break
        bitmap = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(np.bitwise_count(bitmap), np.arange(0, len(bitmap), RANK_BITS // 8), dtype=np.uint32)
        parts += [bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        rest = rest[more] >> 8
    return struct.pack(f"<I{len(sizes)}I", len(sizes), *sizes) + b"".join(parts)


class Segment:
    """A segment behind ``read(at, size)``; only what an access needs is read."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        self.read = read
        (levels,) = struct.unpack("<I", read(0, 4))
        self.sizes = struct.unpack(f"<{levels}I", read(4, 4 * levels))
        self.chunks, self.bitmaps, self.ranks, at = [], [], [], 4 + 4 * levels
        for k, n in enumerate(self.sizes):
            self.chunks.append(at)
            at += n
            if k + 1 < levels:
                self.bitmaps.append(at)
                self.ranks.append(at := at + -(-n // 8))
                at += 4 * -(-n // RANK_BITS)

    def rank(self, level: int, i: int) -> int:
        """Set bits of a level's bitmap before bit ``i``."""
        if i >= self.sizes[level]:
            return self.sizes[level + 1]
        block = i // RANK_BITS
        (before,) = struct.unpack("<I", self.read(self.ranks[level] + 4 * block, 4))
        bits = int.from_bytes(self.read(self.bitmaps[level] + block * (RANK_BITS // 8), (i - block * RANK_BITS) // 8 + 1), "little")
        return before + (bits & ((1 << (i - block * RANK_BITS)) - 1)).bit_count()

    def token(self, i: int) -> int:
        value = 0
        for level in range(len(self.sizes)):
            value |= self.read(self.chunks[level] + i, 1)[0] << (8 * level)
            if level + 1 == len(self.sizes) or not self.read(self.bitmaps[level] + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self.rank(level, i)
        return value

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Ids ``begin`` to ``end``: one rank for each level, then neighbours lie side by side."""
        out, where = np.zeros(end - begin, np.uint32), np.arange(end - begin)
        for level in range(len(self.sizes)):
            out[where] |= np.frombuffer(self.read(self.chunks[level] + begin, end - begin), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.sizes) or begin == end:
                break
            raw = np.frombuffer(self.read(self.bitmaps[level] + begin // 8, -(-end // 8) - begin // 8), np.uint8)
            more = np.unpackbits(raw, bitorder="little")[begin % 8 : begin % 8 + end - begin].astype(bool)
            first = self.rank(level, begin)
            where, begin, end = where[more], first, first + int(more.sum())
        return out


class TokenWriter:
    """Writes documents to a binary sink, segment by segment."""

    def __init__(self, sink) -> None:
        self.sink, self.held, self.n_held, self.bytes = sink, [], 0, len(MAGIC)
        self.docs: list[int | None] = []
        self.ends: list[int] = []
        self.places: list[int] = []
        sink.write(MAGIC)

    @property
    def tokens(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ends.append(self.tokens + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SEGMENT_TOKENS:
            self._flush(SEGMENT_TOKENS)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        cut = 0
        while len(ids) - cut >= max(1, least):
            raw = encode_segment(ids[cut : cut + SEGMENT_TOKENS])
            self.places.append(self.bytes)
            self.sink.write(raw)
            self.bytes += len(raw)
            cut += SEGMENT_TOKENS
        self.held, self.n_held = [ids[cut:].copy()], max(0, len(ids) - cut)

    def close(self) -> None:
        self._flush(1)
        null = np.packbits(np.array([d is None for d in self.docs], bool), bitorder="little").tobytes()
        index = np.array([d or 0 for d in self.docs], "<i8").tobytes() + null + np.array(self.ends, "<u8").tobytes() + np.array([*self.places, self.bytes], "<u8").tobytes()
        self.sink.write(index + _TAIL.pack(len(self.docs), len(self.places), self.bytes) + MAGIC)
        self.bytes += len(index) + _TAIL.size + len(MAGIC)


class TokenFile:
    """Random access to one file through a seekable ``source`` of ``size`` bytes."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        tail = self._read(size - _TAIL.size - len(MAGIC), _TAIL.size + len(MAGIC))
        if tail[_TAIL.size :] != MAGIC or self._read(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a whole token file")
        docs, segments, at = _TAIL.unpack(tail[: _TAIL.size])
        index, nulls = self._read(at, size - at), -(-docs // 8)
        self.doc_ids = np.frombuffer(index, "<i8", docs)
        self.nulls = np.unpackbits(np.frombuffer(index, np.uint8, nulls, 8 * docs), bitorder="little")[:docs].astype(bool)
        self.ends = np.frombuffer(index, "<u8", docs, 8 * docs + nulls).astype(np.int64)
        self.places = np.frombuffer(index, "<u8", segments + 1, 16 * docs + nulls).astype(np.int64)
        self.tokens = int(self.ends[-1]) if docs else 0
        self._whole: tuple[int, Segment] | None = None

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def token(self, i: int) -> int:
        """The i-th token; only its chunks and their ranks are read."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        base = int(self.places[i // SEGMENT_TOKENS])
        return Segment(lambda at, n: self._read(base + at, n)).token(i % SEGMENT_TOKENS)

    def slice(self, begin: int, end: int) -> np.ndarray:
        """Tokens ``begin`` to ``end``.  The segment last used is kept, so that a pass over a file reads each once."""
        parts = []
        while begin < end:
            k, stop = begin // SEGMENT_TOKENS, min(end, (begin // SEGMENT_TOKENS + 1) * SEGMENT_TOKENS)
            if not self._whole or self._whole[0] != k:
                raw = self._read(int(self.places[k]), int(self.places[k + 1] - self.places[k]))
                self._whole = (k, Segment(lambda at, n, raw=raw: raw[at : at + n]))
            parts.append(self._whole[1].slice(begin - k * SEGMENT_TOKENS, stop - k * SEGMENT_TOKENS))
            begin = stop
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _name(part: int) -> str:
    return f"part-{part:06d}.dac"


_MANIFEST = "part int, docs bigint, tokens bigint, bytes bigint"


def write_tokens(docs: DataFrame, path: str) -> None:
    """Encode every row's whole text (null: empty), append END_ID, and write the ids below ``path`` in ascending order of doc_id.

    Nulls come first, rows that share a doc_id follow the scan.  Texts are dealt out by ranges of (doc_id, row of the scan), so one doc_id may spread over many files, and are
    encoded by the task that writes the file; the ids themselves are never shuffled.  A task writes under a name of its own and moves the file
    when it is whole: a task that runs again leaves the same bytes.  ``path``/manifest has a row for each file; a range without rows, and so an empty table, has no file.
    Other columns are not read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        for b in batches:
            for k in range(0, len(b), 256):
                some = b.slice(k, 256)
                for doc_id, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    if writer is None:
                        (store, top), mine = _open(path), f"attempt-{context.taskAttemptId()}"
                        store.create_dir(top, recursive=True)
                        writer = TokenWriter(store.open_output_stream(f"{top}/{mine}"))
                    ids = np.frombuffer(encode16(text), "<u2").astype(np.uint32)
                    ids[-1] = END_ID
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            writer.sink.close()
            store.move(f"{top}/{mine}", f"{top}/{_name(context.partitionId())}")
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "docs": [len(writer.docs)], "tokens": [writer.tokens], "bytes": [writer.bytes]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ranged.select("doc_id", "text").mapInArrow(write, _MANIFEST).write.parquet(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, docs, tokens, bytes of each file, and start, the tokens of all files before it.  One row for each file, ordered as one."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files below ``path``, a task for each file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, size, start in zip(*(b.column(c).to_pylist() for c in ("part", "bytes", "start")), strict=True):
                store, top = _open(path)
                with store.open_input_file(f"{top}/{_name(part)}") as source:
                    file = TokenFile(source, size)
                    begins = np.concatenate([np.zeros(1, np.int64), file.ends[:-1]])
                    for k in range(0, len(file.ends), 4096):
                        at, to = begins[k : k + 4096], file.ends[k : k + 4096]
                        crc = [zlib.crc32(file.slice(i, j).astype("<u4").tobytes()) for i, j in zip(at.tolist(), to.tolist(), strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(file.doc_ids[k : k + 4096], mask=file.nulls[k : k + 4096]), pa.array(start + at), pa.array(to - at), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = read_manifest(spark, path)
    last = files.agg(F.max("part")).first()[0]
    # Each number of a part is a partition of its own; the manifest has one row for each.
    parts = spark.range(0, 0 if last is None else last + 1, 1, 1 if last is None else last + 1)
    return parts.join(F.broadcast(files), F.col("id") == F.col("part")).select("part", "bytes", "start").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_spans(spark: SparkSession, path: str, spans: DataFrame) -> DataFrame:
    """``start``, ``length`` and ``ids`` of each distinct span of the whole corpus, as a training loader asks for them.

    Spans are cut at the ends of files and dealt out by file; a task opens its files and goes straight to the tokens.  What lies outside the corpus has no ids:
    such a span has fewer than ``length``, a null or empty one none.
    """
    files = read_manifest(spark, path).orderBy("part").collect()  # one row for each file
    starts, sizes, parts = np.array([f["start"] for f in files], np.int64), {f["part"]: f["bytes"] for f in files}, [f["part"] for f in files]
    ends = np.append(starts[1:], files[-1]["start"] + files[-1]["tokens"]) if files else starts

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for start, length in zip(b.column("start").to_pylist(), b.column("length").to_pylist(), strict=True):
                at, to = max(0, start or 0), min((start or 0) + (length or 0), int(ends[-1]) if files else 0) if start is not None else 0
                for k in range(max(0, int(np.searchsorted(starts, at, "right")) - 1), int(np.searchsorted(starts, to, "left"))) if at < to else ():
                    i, j = max(at, int(starts[k])), min(to, int(ends[k]))
                    if i < j:
                        out.append((start, length, i, parts[k], i - int(starts[k]), j - int(starts[k])))
                if at >= to:
                    out.append((start, length, at, -1, 0, 0))
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _open(path)
        part, file = -1, None
        for b in batches:
            ids = []
            for p, i, j in zip(*(b.column(c).to_pylist() for c in ("part", "begin", "end")), strict=True):
                if p >= 0 and p != part:
                    part, file = p, TokenFile(store.open_input_file(f"{top}/{_name(p)}"), sizes[p])
                ids.append(file.slice(i, j).tolist() if p >= 0 else [])
            yield pa.RecordBatch.from_arrays([b.column("start"), b.column("length"), b.column("at"), pa.array(ids, pa.list_(pa.int64()))], ["start", "length", "at", "ids"])

    names = ["start", "length", "at", "part", "begin", "end"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    wanted = spans.select(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length")).distinct()
    pieces = wanted.mapInArrow(cut, ", ".join(f"{n} bigint" for n in names)).repartition("part", F.expr("begin div 1048576")).sortWithinPartitions("part", "begin")
    got = pieces.mapInArrow(fetch, "start bigint, length bigint, at bigint, ids array<bigint>")
    return got.groupBy("start", "length").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))


def token_digest(docs: DataFrame) -> DataFrame:
    """Write the ids of ``docs`` to the shared folder and read the files back: doc_id, start, n_tokens, ids_crc32 of every row."""
    path = shared_dir(docs.sparkSession)
    write_tokens(docs, path)
    return read_documents(docs.sparkSession, path)
