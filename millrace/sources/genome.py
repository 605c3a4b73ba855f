"""FASTA genomes of any size: files are read by byte ranges, and no contig is ever one row."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import materialize

#: Letters of a fragment that a row carries.
PIECE = 1 << 16
_PIECES = "file string, block bigint, fragment bigint, name string, at bigint, letters string"


def write_fasta(df: DataFrame, path: str, width: int = 60) -> None:
    """(contig, sequence) as FASTA with lines of ``width`` letters."""
    lines = F.rtrim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    df.select(F.concat(F.lit(">"), F.col("contig").cast("string"), F.lit("\n"), lines)).write.text(path)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters of each byte range, cut where a header begins another fragment; a fragment without a name goes on from the range before."""
    here, fragment, name, at, held, size, rows = None, 0, None, 0, [], 0, []

    def piece() -> None:
        nonlocal at, size
        rows.append((*here, fragment, name, at, "".join(held)))
        at, size = at + size, 0
        held.clear()

    for b in batches:
        for file, block, line in zip(*(b.column(c).to_pylist() for c in ("file", "block", "value")), strict=True):
            if (file, block) != here:
                if here:
                    piece()
                here, fragment, name, at = (file, block), 0, None, 0
            if line.startswith(">"):
                piece()
                fragment, name, at = fragment + 1, (line[1:].split() or [""])[0], 0
            else:
                line = line.strip().upper()
                for k in range(0, len(line), PIECE):
                    held.append(line[k : k + PIECE])
                    size += len(held[-1])
                    if size >= PIECE:
                        piece()
            if len(rows) >= 64:
                yield _rows(rows)
                rows.clear()
    if here:
        piece()
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])


def read_genome(spark: SparkSession, path: str | list[str], size: int, overlap: int) -> DataFrame:
    """(contig, chunk_no, start, seq): chunks of ``size`` letters and ``overlap`` more of every contig of FASTA files, in upper case.

    A contig's name is the first word of its header.  Spark splits plain files into byte ranges; each gives the letters of its fragments, and running sums over the fragments (a row
    for each range and each header) tell where a fragment lies in its contig.  A gzipped file is one range.  Lines before the first header belong to no contig; a contig
    without letters has no chunk.  A contig that is not wrapped is one line, which passes whole.  No contig at all, or a name that comes twice, is an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = materialize(lines.mapInArrow(_pieces, _PIECES))
    along = Window.partitionBy("file").orderBy("block", "fragment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file", "nth").orderBy("block", "fragment").rowsBetween(Window.unboundedPreceding, -1)
    fragments = pieces.groupBy("file", "block", "fragment").agg(F.max("name").alias("name"), F.sum(F.length("letters")).alias("n"))
    placed = fragments.select("file", "block", "fragment", "n", "name", F.last("name", ignorenulls=True).over(along).alias("contig"), F.count("name").over(along).alias("nth"))
    placed = materialize(placed.withColumn("origin", F.coalesce(F.sum("n").over(before), F.lit(0))))
    names = placed.where("name IS NOT NULL")
    if names.isEmpty():
        raise ValueError(f"no sequences in {path}")
    if twice := names.groupBy("name").count().where("count > 1").first():
        raise ValueError(f"contig {twice['name']} comes twice in {path}")
    x = pieces.where("letters <> ''").drop("name").join(placed.where("contig IS NOT NULL").select("file", "block", "fragment", "contig", "origin"), ["file", "block", "fragment"])
    x = x.select("contig", "letters", (F.col("origin") + F.col("at")).alias("pos"), F.length("letters").alias("n"))
    first, last = F.greatest(F.lit(0), F.floor((F.col("pos") - size - overlap) / size) + 1), F.floor((F.col("pos") + F.col("n") - 1) / size)
    x = x.withColumn("chunk_no", F.explode(F.sequence(first, last))).withColumn("skip", F.greatest(F.lit(0), F.col("chunk_no") * size - F.col("pos")))
    take = F.least(F.col("n") - F.col("skip"), (F.col("chunk_no") + 1) * size + overlap - F.col("pos") - F.col("skip"))
    # Letters are ASCII, so they are cut by byte.
    part = F.substring(F.col("letters").cast("binary"), (F.col("skip") + 1).cast("int"), take.cast("int")).cast("string")
    parts = x.select("contig", "chunk_no", F.struct((F.col("pos") + F.col("skip")).alias("pos"), part.alias("part")).alias("p")).groupBy("contig", "chunk_no").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return parts.select("contig", "chunk_no", (F.col("chunk_no") * size).alias("start"), F.array_join(F.transform("p", lambda p: p["part"]), "").alias("seq"))
