"""Queries over files as they come in: samples, stores, indexes, logs and streams, written from the test tables to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from ..sources import files, readers, samples
from ..sources.store import shared_dir
from ..streaming import logs
from . import fixtures as X
from .registry import query

_SPLITS = ("train", "validation", "test")


def _named(df, path, split_of, stem, ending):
    """One file set for each split, its name telling the split."""
    for split in _SPLITS:
        files.write_named(df.where(F.col(split_of) == split).select("value"), path, stem.format(split), ending)


@query("""SELECT sample_id AS source_name, split, sequence, CASE WHEN row_no % 3 <> 1 THEN label END AS label, CASE WHEN row_no % 3 = 1 AND label IS NOT NULL THEN concat_ws(',', label::INT, row_no % 2, 1) END AS label_vec, 'p' AS species, CASE WHEN label IS NULL THEN 'no_label' END AS status FROM v_samples""")
def s01_labelled_fasta(spark, d):
    s, path = X.samples(spark, d), shared_dir(spark)
    label = F.col("label").cast("int").cast("string")
    head = F.when(F.col("label").isNull(), F.col("sample_id")).when(F.col("row_no") % 3 == 1, F.concat_ws("|", "sample_id", label, (F.col("row_no") % 2).cast("string"), F.lit("1"))).otherwise(F.concat_ws("|", "sample_id", label))
    lines = F.rtrim(F.regexp_replace("sequence", "(.{70})", "$1\n"), F.lit("\n"))
    _named(s.select("split", F.concat(F.lit(">"), head, F.lit("\n"), lines).alias("value")), path, "split", "p*_{}", ".fa")
    x = readers.read_labelled_fasta(spark, path, "t")
    return x.select("source_name", "split", "sequence", "label", F.array_join(F.transform("label_vec", lambda v: v.cast("int").cast("string")), ",").alias("label_vec"), F.regexp_replace("species", "[0-9]", "").alias("species"), "status")


_TABLE = "SELECT sequence, split, label, species, group_id, CASE WHEN label IS NULL THEN 'no_label' END AS status FROM v_samples"


@query(_TABLE)
def s02_csv_samples(spark, d):
    s, path = X.samples(spark, d), shared_dir(spark)
    for split in _SPLITS:
        s.where(F.col("split") == split).select(F.lower("sequence").alias("seq"), F.col("label").alias("labels"), F.lit("").alias("species"), F.col("species").alias("genome"), F.col("group_id").alias("orthogroup")).write.option("header", True).csv(f"{path}/csv/{split}")
    parts = [readers.read_table_samples(spark, f"{path}/csv/{split}", "t").withColumn("split", F.lit(split)) for split in _SPLITS]
    x = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return x.select("sequence", "split", "label", "species", "group_id", "status")


@query(_TABLE)
def s03_tsv_samples(spark, d):
    path = shared_dir(spark)
    X.samples(spark, d).select("sequence", "split", "label", "species", "group_id").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_table_samples(spark, path, "t", "\t").select("sequence", "split", "label", "species", "group_id", "status")


_RAW = """(SELECT *, upper(regexp_replace(text, '[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv]', '', 'g')) AS raw, CASE WHEN b < 2 THEN 'test' WHEN b < 4 THEN 'validation' ELSE 'train' END AS split FROM
  (SELECT *, ('0x' || substr(sha256('42|' || doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS b FROM documents LEFT JOIN labels USING (doc_id)))"""


def _store(spark, d):
    """Documents as raw DNA with U and ambiguity letters, written to a store; sequences and groups cross splits here."""
    s, path = X.samples(spark, d).select("sample_id", "row_no", "split"), shared_dir(spark)
    docs = X.table(spark, d, "documents").join(X.table(spark, d, "labels"), "doc_id", "left")
    raw = docs.select(F.col("doc_id").alias("row_no"), F.regexp_replace("text", "[^ACGTUNRYSWKMBDHVacgtunryswkmbdhv]", "").alias("sequence"), F.coalesce("toxic", F.lit(0)).cast("double").alias("label"), F.col("source").alias("group_id"), F.col("lang").alias("species"), F.col("n_chars"))
    return path, samples.write_samples(s.join(raw, "row_no").drop("row_no"), path, "t", "binary", allow_copies=True, allow_groups=True)


@query(f"""SELECT count(*) AS rows, sum(length(raw))::BIGINT AS total_bases, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test,
  count(*) FILTER (regexp_matches(raw, '[RYSWKMBDHV]')) AS rows_with_iupac, sum(length(regexp_replace(raw, '[^RYSWKMBDHV]', '', 'g')))::BIGINT AS iupac_bases_to_n, sum(length(regexp_replace(raw, '[^S]', '', 'g')))::BIGINT AS s_to_n, sum(length(regexp_replace(raw, '[^U]', '', 'g')))::BIGINT AS u_bases_to_t,
  (SELECT count(*) FROM (SELECT source FROM {_RAW} WHERE regexp_matches(upper(text), '[ACGTN]') GROUP BY source HAVING count(DISTINCT split) > 1)) AS cross_split_groups FROM {_RAW} WHERE regexp_matches(upper(text), '[ACGTN]')""")
def s11_write_samples(spark, d):
    m = _store(spark, d)[1]
    row = {k: m[k] for k in ("rows", "total_bases", "rows_with_iupac", "iupac_bases_to_n", "u_bases_to_t", "cross_split_groups")} | {s: m["split_counts"].get(s, 0) for s in _SPLITS} | {"s_to_n": m["iupac_symbols_to_n"].get("S", 0)}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))


@query(f"""SELECT doc_id::VARCHAR AS sample_id, translate(raw, 'URYSWKMBDHV', 'TNNNNNNNNNN') AS sequence, coalesce(toxic, 0)::DOUBLE AS label, lang AS species, source AS group_id, sha256(translate(raw, 'URYSWKMBDHV', 'TNNNNNNNNNN')) AS sequence_sha256, n_chars::VARCHAR AS n_chars
  FROM {_RAW} WHERE split <> 'train' AND regexp_matches(upper(text), '[ACGTN]')""")
def s12_read_samples(spark, d):
    path = _store(spark, d)[0]
    held = samples.read_samples(spark, path, "validation").unionByName(samples.read_samples(spark, path, "test"))
    return held.select("sample_id", "sequence", "label", "species", "group_id", "sequence_sha256", F.col("metadata")["n_chars"].alias("n_chars"))


@query("""SELECT shard, window_id, length, CASE region WHEN 0 THEN 0 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE -100 END::BIGINT AS region FROM v_windows WHERE shard % 4 <> 0""")
def s13_window_index(spark, d):
    """Shards of one split, and of every fourth supplier's shard the other; region names with spaces and capitals, and one that is none."""
    w, path = X.windows(spark, d), shared_dir(spark)
    names = F.when(F.col("region") == 0, " CDS").when(F.col("region") == 2, "Intron ").when(F.col("region") == 5, "utr").when(F.col("region") == 6, None).otherwise("other")
    split = F.when(F.col("shard") % 4 == 0, "validation").otherwise("train")
    # Forty gzipped shards, so that a supplier's shard keeps its split.
    readers.write_window_index(w.select((F.col("shard") % 40).alias("shard"), F.col("shard").alias("source_shard"), split.alias("split"), F.lit(0).cast("long").alias("offset"), F.col("length").cast("int").alias("length"), names.alias("region_bucket"), "window_id"), path)
    x = readers.read_window_index(spark, path, "train", {"cds": 0, "intron": 1, "utr": 2}, "window_id string, source_shard bigint")
    return x.select(F.col("source_shard").alias("shard"), "window_id", F.col("length").cast("long").alias("length"), "region")


_LINES = "SELECT event_id % 5 AS log, event_id AS line, event_id // 7 + (event_id % 5) * 40 AS step, round(value, 4) AS value, event_type FROM events"
_ENTRIES = f"""(SELECT log, line, 'train' AS split, step, value AS loss, value + 1 AS acc FROM ({_LINES}) WHERE event_type <> 'view' UNION ALL SELECT log, line, 'val', step, value, NULL FROM ({_LINES}) WHERE event_type IN ('view', 'click'))"""


def _write_logs(spark, d, path, log):
    """A log as JSON lines in its order, with text between; from the third on it first tells where it resumes."""
    e = X.table(spark, d, "events").selectExpr("event_id", "event_id % 5 AS log", "event_id div 7 + (event_id % 5) * 40 AS step", "round(value, 4) AS value", "event_type").where(F.col("log") == log)
    one = F.to_json(F.struct("step", F.when(F.col("event_type") != "view", F.col("value")).alias("loss"), F.when(F.col("event_type") != "view", F.col("value") + 1).alias("acc"), F.when(F.col("event_type").isin("view", "click"), F.col("value")).alias("val_loss")))
    lines = e.select(F.col("event_id").alias("at"), F.when(F.col("event_type") == "purchase", F.concat(F.lit("saved\n"), one)).otherwise(one).alias("value"))
    if log >= 2:
        resume = e.agg(F.lit(-1).cast("long").alias("at"), F.to_json(F.struct(F.lit("checkpoint").alias("resume"), (F.min("step") - 1).alias("start_step"))).alias("value"))
        lines = resume.unionByName(lines)
    files.write_named(lines.orderBy("at").coalesce(1).select("value"), path, f"run-{log}-*", ".jsonl")


@query(f"SELECT log, split, step, count(*) AS n, round(sum(loss), 4) AS loss, round(sum(acc), 4) AS acc FROM {_ENTRIES} GROUP BY ALL UNION ALL SELECT log, 'resume', min(step) - 1, 1, NULL, NULL FROM ({_LINES}) WHERE log >= 2 GROUP BY log")
def s14_training_log(spark, d):
    path = shared_dir(spark)
    for log in range(5):
        _write_logs(spark, d, path, log)
    x = readers.read_training_log(spark, path).withColumn("log", F.regexp_extract("log", r"run-(\d)", 1).cast("long"))
    value = lambda k: F.round(F.sum(F.try_element_at("metrics", F.lit(k))), 4).alias(k)
    return x.groupBy("log", "split", "step").agg(F.count("*").alias("n"), value("loss"), value("acc"))


@query(f"""SELECT split, step, arg_max(loss, log * 1000000000 + line) AS loss FROM {_ENTRIES} e WHERE NOT EXISTS (SELECT 1 FROM (SELECT log AS later, min(step) - 1 AS resume FROM ({_LINES}) WHERE log >= 2 GROUP BY log) WHERE later > e.log AND e.step > resume) GROUP BY split, step""")
def st01_log_tail(spark, d):
    """Five logs that come in out of order, in three runs of the query."""
    path = shared_dir(spark)
    for arrive in ((3, 0), (4,), (1, 2)):
        for log in arrive:
            _write_logs(spark, d, f"{path}/logs", log)
        logs.follow_logs(spark, f"{path}/logs", f"{path}/table", f"{path}/state", files_at_once=1).awaitTermination()
    return logs.read_followed(spark, f"{path}/table").select("split", "step", F.try_element_at("metrics", F.lit("loss")).alias("loss"))


_BEATS = """SELECT user_id AS run_key, epoch_us(ts) // 1000 AS t, arg_max(CASE event_type WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'terminal_failed' ELSE 'running' END, event_id) AS status FROM events WHERE user_id % 7 <> 0 GROUP BY ALL"""
_CHANGES = f"""(WITH b AS MATERIALIZED ({_BEATS}), x AS (SELECT *, lag(t) OVER w AS last, lag(status) OVER w AS before, lead(t) OVER w AS next FROM b WINDOW w AS (PARTITION BY run_key ORDER BY t))
  SELECT run_key, last + 21600000 AS "at", 'stalled' AS state FROM x WHERE before = 'running' AND t - last > 21600000
  UNION ALL SELECT run_key, t, status FROM x WHERE before IS NULL OR status <> before OR (before = 'running' AND t - last > 21600000)
  UNION ALL SELECT run_key, t + 21600000, 'stalled' FROM x WHERE next IS NULL AND status = 'running' AND t + 21600000 < (SELECT max(epoch_us(ts) // 1000) FROM events))"""


def _changes(spark, d):
    """Events as beats, every seventh user's of another plan, in two runs of the query."""
    e = X.table(spark, d, "events").withColumn("ts", F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp"))))
    status = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "terminal_failed").otherwise("running")
    beats = e.groupBy(F.col("user_id").alias("run_key"), "ts").agg(F.max_by(status, "event_id").alias("status")).withColumn("plan_sha256", F.when(F.col("run_key") % 7 == 0, "other").otherwise("plan"))
    path, middle = shared_dir(spark), e.agg(F.avg(F.unix_millis("ts"))).first()[0] or 0
    for half in (F.unix_millis("ts") <= middle, F.unix_millis("ts") > middle):
        beats.where(half).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with logs.state_in_rocksdb(spark):
            out = logs.watch_runs(spark.readStream.schema(beats.schema).parquet(f"{path}/in"), "plan", poll=7200)
            out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema("run_key bigint, at timestamp, state string").parquet(f"{path}/out")


@query(f'SELECT run_key, "at", state FROM {_CHANGES}')
def st03_watch_runs(spark, d):
    return _changes(spark, d).select("run_key", F.unix_millis("at").alias("at"), "state")


@query(f"""SELECT c AS complete, t AS terminal, a AS active, n - c - t - a AS waiting, CASE WHEN c = n THEN 'ok' WHEN c + t = n THEN 'failed' WHEN a > 0 THEN 'running' ELSE 'not_running' END AS status FROM
  (SELECT count(*) AS n, count(*) FILTER (state = 'complete') AS c, count(*) FILTER (state = 'terminal_failed') AS t, count(*) FILTER (state = 'running') AS a FROM (SELECT DISTINCT user_id AS run_key FROM events) LEFT JOIN (SELECT run_key, arg_max(state, "at") AS state FROM {_CHANGES} GROUP BY run_key) USING (run_key))""")
def st05_roll_up(spark, d):
    return logs.roll_up(X.table(spark, d, "events").select(F.col("user_id").alias("run_key")), _changes(spark, d))


@query("SELECT path, finding FROM (SELECT 'd=' || (doc_id % 3) || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 5 = 0 THEN 'unlisted' WHEN doc_id % 7 = 0 THEN 'size' WHEN doc_id % 11 = 0 THEN 'sha256' WHEN doc_id % 13 = 0 THEN 'missing' END AS finding FROM documents) WHERE finding IS NOT NULL")
def q05_scanned_files(spark, d):
    """Each document as a file of its own, scanned; the manifest lacks some, tells others wrongly, and lists some that are not there."""
    docs, path = X.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), shared_dir(spark)
    name = F.concat(F.lit("d="), (F.col("doc_id") % 3).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    there = ~((F.col("doc_id") % 13 == 0) & (F.col("doc_id") % 5 != 0) & (F.col("doc_id") % 7 != 0) & (F.col("doc_id") % 11 != 0))
    readers.write_texts(docs.where(there).select(name.alias("path"), "text"), path)
    size = F.octet_length("text").cast("long") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    manifest = docs.where("doc_id % 5 <> 0").select(name.alias("path"), size.alias("size_bytes"), F.sha2(F.when(F.col("doc_id") % 11 == 0, F.concat(F.col("text"), F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return quality.verify_artifacts(manifest, readers.scan_artifacts(spark, path))


_REPORT = "SELECT model_id, task_id, count(*) AS seeds, round(avg(value), 6) AS mean FROM v_results GROUP BY ALL"


@query(_REPORT)
def s16_report(spark, d):
    path = shared_dir(spark)
    table = X.results(spark, d).groupBy("model_id", "task_id").agg(F.count("*").alias("seeds"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("left_out"))
    readers.write_report(table, path, ["model_id", "task_id", "seeds", "mean"])
    return spark.read.option("sep", "\t").option("header", True).schema("model_id string, task_id string, seeds bigint, mean double").csv(path)
