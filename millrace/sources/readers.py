"""Readers that map foreign files to the sample schema, and the writers beside them.  Paths are anything that Spark reads."""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import norm_split, parse_label, stable_id, vocab_id
from .files import in_file_order
from .samples import UNKNOWN
from .store import materialize

ALIASES = {"sequence": ("sequence", "sequences", "seq"), "label": ("label", "labels"), "species": ("species", "genome"), "group_id": ("group_id", "orthogroup")}
# Endings of a file's stem that tell its split and not its species.
STEM_ENDS = "_validation|_validate|_valid|_train|_test|_dev"


def _pick(df: DataFrame, name: str) -> Column:
    have = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ALIASES[name] if c in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def _name_of(file: Column) -> Column:
    return F.element_at(F.split(file, "/"), -1)


def _file_split(file: Column) -> Column:
    """Split from the file's name: validation before test before train."""
    name = F.lower(_name_of(file))
    return F.when(name.rlike("val|dev"), "validation").when(name.contains("test"), "test").otherwise("train")


def _sample_id(task: str, source: Column) -> Column:
    """The hash of task, file, row of the file and source name: equal rows are two samples."""
    return stable_id(F.lit(task), F.col("_file"), F.col("_index"), F.coalesce(source, F.lit("")))


def read_table_samples(spark: SparkSession, paths: str | list[str], task: str, sep: str = ",", species: str = UNKNOWN) -> DataFrame:
    """CSV or TSV with column aliases; ``split`` from the column if there is one, else from the file's name; ``species`` where a row has none.

    (task_id, sample_id, split, sequence, label, label_vec, species, group_id, source_name, status); status is ``no_label`` where the label is none, ``no_sequence`` where there is no sequence.
    """
    raw = in_file_order(spark.read.option("header", True).option("sep", sep).csv(paths))
    split = norm_split(F.col("split")) if "split" in raw.columns else _file_split(F.col("_file"))
    x = raw.select("_file", "_index", split.alias("split"), F.upper(_pick(raw, "sequence")).alias("sequence"), parse_label(_pick(raw, "label")).alias("y"), _pick(raw, "species").alias("species"), _pick(raw, "group_id").alias("group_id"))
    return _samples(x.withColumn("source_name", F.lit(None).cast("string")).withColumn("species", F.coalesce("species", F.lit(species))), task)


def _samples(x: DataFrame, task: str) -> DataFrame:
    status = F.when(F.coalesce(F.length("sequence"), F.lit(0)) == 0, "no_sequence").when(F.col("y.label").isNull() & F.col("y.label_vec").isNull(), "no_label")
    return x.select(F.lit(task).alias("task_id"), _sample_id(task, F.col("source_name")).alias("sample_id"), "split", "sequence", "y.label", "y.label_vec", "species", "group_id", "source_name", status.alias("status"))


def read_labelled_fasta(spark: SparkSession, paths: str | list[str], task: str, species: str | None = None) -> DataFrame:
    """Records ``>name|label[|label...]`` in the columns of ``read_table_samples``: one label is a scalar, several are a vector; the species is the file's stem without its split.

    A record without a label, or with one that is no number, has the status ``no_label``, so that a store refuses it; it is not dropped.
    """
    rec = spark.read.option("lineSep", ">").text(paths)
    rec = in_file_order(rec.select("value", "_metadata").where(F.length(F.trim(F.regexp_replace("value", r"[\r\n]", ""))) > 0))
    head = F.split(F.regexp_extract("value", r"^([^\r\n]*)", 1), r"\|")
    seq = F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s", ""))
    x = rec.select("_file", "_index", head.alias("head"), seq.alias("sequence"), _file_split(F.col("_file")).alias("split"))
    labels = F.transform(F.slice("head", 2, F.greatest(F.lit(0), F.size("head") - 1)), parse_label)
    flat = F.transform(labels, lambda y: y["label"])
    many = F.struct(F.lit(None).cast("double").alias("label"), F.when(F.forall(flat, lambda v: v.isNotNull()), flat).alias("label_vec"))
    y = F.when(F.size("head") == 2, F.get(labels, F.lit(0))).when(F.size("head") > 2, many)
    stem = F.regexp_replace(F.regexp_replace(_name_of(F.col("_file")), r"\.[^.]*$", ""), f"({STEM_ENDS})$", "")
    return _samples(x.select("_file", "_index", "split", "sequence", y.alias("y"), F.get("head", F.lit(0)).alias("source_name"), (F.lit(species) if species else stem).alias("species"), F.lit(None).cast("string").alias("group_id")), task)


def read_gff3(spark: SparkSession, path: str) -> DataFrame:
    """Repeat and transposon features of nine-field lines, with the superfamily of the classification."""
    names = ["contig", "source", "feature", "start", "end", "score", "strand", "phase", "attributes"]
    f = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") == 9)
    x = f.select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)]).where(F.lower("feature").rlike("repeat|transpos"))
    attrs = F.str_to_map(F.rtrim("attributes", F.lit(";")), F.lit(";"), F.lit("="))
    cls = F.element_at(F.split(F.element_at(attrs, F.lit("Classification")), "/"), -1)
    return x.select("contig", "feature", F.col("start").try_cast("long").alias("start"), F.col("end").try_cast("long").alias("end"), F.get(F.split(cls, "_"), F.lit(0)).alias("superfamily"))


ENTRY = "array<struct<split:string,step:bigint,metrics:map<string,double>>>"


def log_entries(raw: DataFrame) -> DataFrame:
    """(log, line, split, step, metrics) of JSON lines (value, _metadata), as a reader of text gives them.

    A line with a step gives a ``train`` entry if it has a loss, and a ``val`` entry if it has ``val_`` keys, whose prefix is taken off.  A line with ``resume`` and ``start_step`` gives an
    entry ``resume``.  Lines that are no JSON, and values that are no finite numbers, are skipped.
    """
    x = in_file_order(raw).where(F.trim("value").startswith("{")).select(F.col("_file").alias("log"), F.col("_index").alias("line"), F.from_json(F.trim("value"), "map<string,string>").alias("m")).where("m IS NOT NULL")
    numbers = F.map_filter(F.transform_values("m", lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    at = lambda k: F.try_element_at("m", F.lit(k)).try_cast("double").cast("long")
    x = x.select("log", "line", "m", numbers.alias("n"), at("step").alias("step"), at("start_step").alias("start"))
    has = lambda k: F.map_contains_key("m", k)
    val = F.map_filter("n", lambda k, _: k.startswith("val_"))
    train = F.map_filter("n", lambda k, _: ~k.startswith("val_") & (k != "step"))
    entry = lambda when, split, step, metrics: F.when(when, F.struct(F.lit(split).alias("split"), step.alias("step"), metrics.alias("metrics")))
    none = F.lit(None).cast("map<string,double>")
    found = F.array(
        entry(has("resume") & F.col("start").isNotNull(), "resume", F.col("start"), none), entry(F.col("step").isNotNull() & has("loss"), "train", F.col("step"), train),
        entry(F.col("step").isNotNull() & F.exists(F.map_keys("m"), lambda k: k.startswith("val_")), "val", F.col("step"), F.transform_keys(val, lambda k, _: F.substring(k, 5, 1 << 30))),
    ).cast(ENTRY)
    return x.select("log", "line", F.inline(F.filter(found, lambda e: e.isNotNull())))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """The entries (log, line, split, step, metrics) of the log files of ``path``."""
    return log_entries(spark.read.text(path).select("value", "_metadata"))


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


#: Files beyond this are hashed piece by piece and never are a cell of a table.
CELL_BYTES = 1 << 28


def scan_artifacts(spark: SparkSession, root: str, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(path, size_bytes, sha256) of every file below ``root``, by its path there; caches (``.cache``), hidden files and receipts are left out.

    Folders are listed by tasks, level by level, so that no list of files passes the driver; one folder is one task's list.  Files are then dealt out
    by their paths, some FILES_PER_TASK to a task.  A file is one task's work, as its hash runs from its first byte; those over ``cell_bytes`` are read piece by piece.
    The store must be one that Arrow's file systems know.
    """

    def listed(batches):
        fs, top = _opened(root)
        for b in batches:
            for folder in b.column("folder").to_pylist():
                found = [x for x in fs.get_file_info(FileSelector(f"{top}/{folder}" if folder else top)) if not _HIDDEN.search(x.base_name)]
                for i in range(0, len(found), 1 << 16):
                    part = [x for x in found[i : i + (1 << 16)] if x.type == FileType.Directory or (x.type == FileType.File and not x.base_name.endswith("receipt.json"))]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x.base_name}" if folder else x.base_name for x in part], pa.string()), pa.array([x.size for x in part], pa.int64()), pa.array([x.type == FileType.Directory for x in part], pa.bool_())], ["path", "size_bytes", "is_folder"])

    def digests(batches):
        fs, top = _opened(root)
        for b in batches:
            out = []
            for path, size in zip(b.column("path").to_pylist(), b.column("size_bytes").to_pylist(), strict=True):
                h = hashlib.sha256()
                with fs.open_input_stream(f"{top}/{path}") as f:
                    while piece := f.read(size + 1 if size <= cell_bytes else 1 << 23):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size_bytes"), pa.array(out, pa.string())], ["path", "size_bytes", "sha256"])

    folders, levels, many = spark.createDataFrame([("",)], "folder string"), [], int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        level = materialize(folders.mapInArrow(listed, "path string, size_bytes bigint, is_folder boolean"))
        levels.append(level.where("NOT is_folder").select("path", "size_bytes"))
        folders = level.where("is_folder").select(F.col("path").alias("folder"))
        if folders.isEmpty():
            break
        folders = folders.repartition(many, "folder")
    files = reduce(DataFrame.unionByName, levels)
    # Paths are few bytes and much work, so the number of tasks is a fixed one.
    return files.repartition(max(many, files.count() // FILES_PER_TASK), "path").mapInArrow(digests, "path string, size_bytes bigint, sha256 string")


#: Names that Spark's readers take for hidden.
_HIDDEN = re.compile(r"^\.|^_(?!(common_)?metadata$)[^=]*$|\._COPYING_$")
FILES_PER_TASK = 1 << 14


def _opened(path: str) -> tuple[FileSystem, str]:
    """Arrow's file system of a path as Spark names it, and the path there."""
    fs, at = FileSystem.from_uri(quote(path, safe=":/?&=") if ":" in path.partition("/")[0] else path)
    return fs, at.rstrip("/")


def write_texts(df: DataFrame, root: str) -> None:
    """Each row (path, text) as a file of its own below ``root``, written by the row's task under another name and moved into place."""

    def write(batches):
        fs, top = _opened(root)
        mark = f".attempt-{TaskContext.get().taskAttemptId()}"
        made, n = set(), 0
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist(), strict=True):
                at = f"{top}/{path}"
                if (folder := at.rpartition("/")[0]) not in made:
                    made.add(folder)
                    fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(at + mark) as f:
                    f.write(text.encode())
                fs.move(at + mark, at)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    df.select("path", "text").mapInArrow(write, "n bigint").agg(F.sum("n")).collect()


def snapshot_digest(artifacts: DataFrame) -> str:
    """One hash of a scan: of the folders in order, each with the hash of its files' names, sizes and hashes in order."""
    cut = F.regexp_extract("path", "^(.*/)?", 0)
    row = F.struct(F.substr("path", F.length(cut) + 1).alias("name"), "size_bytes", "sha256")
    text = lambda rows, *names: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: F.concat_ws("\t", *(x[n].cast("string") for n in names))), "\n"), 256)
    folders = artifacts.groupBy(cut.alias("folder")).agg(text(row, "name", "size_bytes", "sha256").alias("digest"))
    return folders.agg(text(F.struct("folder", "digest"), "folder", "digest")).first()[0]


def write_window_index(windows: DataFrame, root: str) -> None:
    """Windows (shard, split, offset, length, region_bucket, ...) as a gzipped TSV of each shard, and the manifest (shard, path, tokens, windows_count, splits) beside them."""
    own = ("shard", "split", "offset", "length", "region_bucket")
    windows = windows.select(*own, *(c for c in windows.columns if c not in own))
    windows.repartition("shard").write.partitionBy("shard").option("sep", "\t").option("header", True).option("compression", "gzip").csv(f"{root}/shards")
    splits = F.array_join(F.array_sort(F.collect_set("split")), ",")
    shards = windows.groupBy("shard").agg(F.sum("length").alias("tokens"), F.count("*").alias("windows_count"), splits.alias("splits"))
    shards.select("shard", F.concat(F.lit("shards/shard="), "shard").alias("path"), "tokens", "windows_count", "splits").write.option("sep", "\t").option("header", True).csv(f"{root}/manifest")


def read_window_index(spark: SparkSession, root: str, split: str, regions: dict[str, int], columns: str = "", shards: list[int] | None = None) -> DataFrame:
    """(shard, offset, length, region, ...) of one split, with the region's number, -100 where ``regions`` has no such name; names are trimmed and in lower case.

    The manifest, a row for each shard, says which shards hold the split: files of other shards, and of those not in ``shards``, are never opened.  ``columns`` names further columns of the
    index with their types.  No shard at all is an error; a split that none holds has no rows.
    """
    manifest = spark.read.option("sep", "\t").schema("shard bigint, path string, tokens bigint, windows_count bigint, splits string").option("header", True).csv(f"{root}/manifest").collect()
    if not manifest:
        raise ValueError(f"no shards in {root}")
    wanted = [f"{root}/{r['path']}" for r in manifest if split in (r["splits"] or "").split(",") and (shards is None or r["shard"] in shards)]
    schema = "split string, offset bigint, length int, region_bucket string, shard bigint" + (f", {columns}" if columns else "")
    rows = spark.createDataFrame([], schema)
    if wanted:
        kinds = {f.name: f.dataType for f in rows.schema}
        raw = spark.read.option("sep", "\t").option("header", True).option("basePath", f"{root}/shards").csv(wanted)
        rows = raw.select(*(F.col(n).cast(t).alias(n) for n, t in kinds.items()))
    region = F.lower(F.trim(F.coalesce("region_bucket", F.lit(""))))
    number = F.coalesce(*[F.when(region == k, v) for k, v in regions.items()], F.lit(-100)) if regions else F.lit(-100)
    return rows.where(F.col("split") == split).withColumn("region", number.cast("long")).drop("split", "region_bucket")


def read_parquet_samples(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Only the source columns that ``columns`` (name: source) asks for are read."""
    return spark.read.parquet(path).select(*[F.col(source).alias(name) for name, source in columns.items()])


# The two headers of hit tables, for chrom, pos, ref, alt.
HIT_COLUMNS = (("snp.chr", "snp.position", "snp.ref", "snp.alt"), ("SNPChr", "SNPPos", "SNPRef", "SNPAlt"))


def read_gwas_hits(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alt, label) from CSV files, gzipped or not, each with either header: one row a variant, label 1 if any of its rows says true.

    Each file's header line tells its columns; a file with neither header gives no rows.
    """
    cells = lambda c: F.transform(F.split(c, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda v: F.trim(v, F.lit('" ')))
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), cells("value").alias("f"))
    is_head = F.array_contains("f", "overPermutation")
    heads = lines.where(is_head).groupBy("file").agg(F.first("f").alias("names"))
    x = lines.where(~is_head).join(heads, "file")
    at = lambda n: F.get("f", (F.array_position("names", n) - 1).cast("int"))
    pick = [F.coalesce(*[F.when(F.array_contains("names", h[i]), at(h[i])) for h in HIT_COLUMNS]).alias(n) for i, n in enumerate(("chrom", "pos", "ref", "alt"))]
    rows = x.select(*pick, (F.lower(at("overPermutation")) == "true").cast("int").alias("label")).withColumn("pos", F.col("pos").try_cast("long"))
    return rows.where("chrom IS NOT NULL AND pos IS NOT NULL").groupBy("chrom", "pos", "ref", "alt").agg(F.max("label").alias("label"))


RECEIPT = "artifacts array<struct<path:string,sha256:string>>, plan_sha256 string, receipt_sha256 string, run_key string, status string"


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """The receipts of ``path``, a JSON object a line, with ``own_sha256`` over the record without its hash, keys in order; lines that are no JSON are absent."""
    x = spark.read.text(path).select(F.from_json("value", RECEIPT).alias("r")).select("r.*").where("run_key IS NOT NULL")
    return x.withColumn("own_sha256", F.sha2(receipt_text("artifacts", "plan_sha256", "run_key", "status"), 256))


def receipt_text(*columns: str) -> Column:
    return F.to_json(F.struct(*sorted(columns)))


def append_embeddings(df: DataFrame, path: str) -> None:
    """One more batch of (key columns, embedding): the writer's memory is a row group of each task."""
    df.write.mode("append").parquet(path)


def read_embeddings(spark: SparkSession, path: str, width: int, rows: int) -> DataFrame:
    """The appended batches; an error if the row count is not the declared one or a vector has another width or a value that is not finite."""
    e = spark.read.parquet(path)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    seen = e.agg(F.count("*").alias("n"), F.count_if(~F.coalesce((F.size("embedding") == width) & finite, F.lit(False))).alias("bad")).first()
    if seen["n"] != rows or seen["bad"]:
        raise ValueError(f"{seen['n']} rows for {rows} declared, {seen['bad']} bad vectors")
    return e


# The region classes, numbered from 0.
REGIONS = ("intergenic", "CDS", "intron", "three_prime_UTR", "five_prime_UTR", "ncRNA_gene", "Repeat")


def read_region_windows(spark: SparkSession, path: str, genome: DataFrame, size: int, overlap: int) -> DataFrame:
    """(sample_id, split, sequence, label, class_name, group_id) of the centre windows of a Parquet table (chrom, center_start, center_end, Region).

    ``genome`` holds chunks (contig, chunk_no, start, seq) of ``size`` letters and ``overlap`` more, as ``features.chunks`` makes them,
    named without ``Chr``.  A window meets only the chunk it starts in.  Windows over the ends of their contig, or of a contig
    that is not there, are left out; one longer than ``overlap`` is an error, as is a region that is none of the classes.
    """
    w = spark.read.parquet(path).select(F.regexp_replace(F.regexp_replace("chrom", "^Chr", ""), "^chr", "").alias("contig"), F.col("center_start").cast("long").alias("a"), F.col("center_end").cast("long").alias("b"), F.col("Region").alias("class_name"))
    label = vocab_id(F.col("class_name"), REGIONS, -1)
    bad = F.when(F.col("b") - F.col("a") > overlap, "a window is longer than the overlap of the chunks").when(label < 0, "a region is none of the classes")
    w = w.where("a >= 0").withColumn("label", F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(label)).withColumn("chunk_no", F.floor(F.col("a") / size))
    n = F.col("b") - F.col("a")
    x = w.join(genome, ["contig", "chunk_no"]).withColumn("sequence", F.substr("seq", (F.col("a") - F.col("start") + 1).cast("int"), n.cast("int"))).where(F.length("sequence") == n)
    return x.select(stable_id(F.lit("D01"), F.col("contig"), F.col("a").cast("string"), F.col("b").cast("string")).alias("sample_id"), F.lit("test").alias("split"), "sequence", "label", "class_name", F.col("contig").alias("group_id"))


def read_token_cache(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, split, pos, embedding, label) of a table (sample_id, split, hidden, labels), one row a token; an error where the two arrays differ in length."""
    x = spark.read.parquet(path)
    same = F.when(F.size("hidden") == F.size("labels"), F.arrays_zip("hidden", "labels")).otherwise(F.raise_error(F.concat(F.lit("hidden and labels differ in length: "), F.col("sample_id").cast("string"))))
    return x.select("sample_id", "split", F.posexplode(same).alias("pos", "t")).select("sample_id", "split", "pos", F.col("t.hidden").alias("embedding"), F.col("t.labels").alias("label"))
