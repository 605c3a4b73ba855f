"""States over restarts, region windows, token caches and heads against brute force; audits of nothing."""

import numpy as np
import pytest

from millrace.operators import corpus, features, heads, quality
from millrace.sources import readers
from millrace.streaming import logs


def test_best_so_far_goes_on_after_a_restart(spark, tmp_path):
    rows = [("a", s, v) for s, v in enumerate([5.0, 4.95, 4.0, None, 4.5, 3.0, 2.95, 1.0])] + [("b", 3, None), ("b", 5, 2.0)]
    for part in (rows[:4] + rows[8:9], rows[4:8] + rows[9:]):
        spark.createDataFrame(part, "run_key string, step long, value double").write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("run_key string, step long, value double").parquet(f"{tmp_path}/in")
        query = logs.best_so_far(stream, 0.1).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    got = {(r["run_key"], r["step"]): (r["new"], r["best"], r["stale"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got["a", s] for s in range(8)] == [(True, 5.0, 0), (False, 5.0, 1), (True, 4.0, 0), (False, 4.0, 1), (False, 4.0, 2), (True, 3.0, 0), (False, 3.0, 1), (True, 1.0, 0)]
    assert got["b", 3] == (True, None, 0) and got["b", 5] == (True, 2.0, 0)


def test_appended_vectors_are_complete(spark, tmp_path):
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(9)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("vec_id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    logs.append_vectors(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert sorted(r["vec_id"] for r in readers.read_embeddings(spark, f"{tmp_path}/out", 2, 9).collect()) == list(range(9))
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, f"{tmp_path}/out", 2, 10)


def test_region_windows_leave_out_what_has_no_sequence(spark, tmp_path):
    genome = features.chunks(spark.createDataFrame([("1", "ACGTACGTACGTACG")], "contig string, sequence string"), 4, 6)
    rows = [("Chr1", 0, 5, "CDS"), ("chr1", 10, 15, "Repeat"), ("Chr1", 11, 16, "CDS"), ("Chr1", -1, 4, "CDS"), ("Chr2", 0, 5, "CDS"), ("1", 3, 9, "intron")]
    schema = "chrom string, center_start long, center_end long, Region string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/w")
    got = sorted((r["sequence"], r["label"], r["group_id"]) for r in readers.read_region_windows(spark, f"{tmp_path}/w", genome, 4, 6).collect())
    assert got == [("ACGTA", 1, "1"), ("GTACG", 6, "1"), ("TACGTA", 2, "1")]
    for i, wrong in enumerate([("1", 0, 7, "CDS"), ("1", 0, 5, "tail")]):
        spark.createDataFrame([wrong], schema).write.parquet(f"{tmp_path}/bad{i}")
        with pytest.raises(Exception, match="longer than|none of the classes"):
            readers.read_region_windows(spark, f"{tmp_path}/bad{i}", genome, 4, 6).collect()


def test_token_cache_and_head(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        x = rng.normal(size=(8, 3))
        y = np.where(x[:, 2] > 1.5, 255, x.argmax(axis=1) % 2 + 0)
        rows.append((f"s{i}", ("train", "train", "train", "validation", "test")[i % 5], [[float(v) for v in h] for h in x], [int(v) for v in y]))
    schema = "sample_id string, split string, hidden array<array<float>>, labels array<int>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/cache")
    out = heads.token_head(readers.read_token_cache(spark, f"{tmp_path}/cache"), (2, 30)).collect()
    assert len(out) == 12 * 8
    valid = [r for r in out if r["label"] != 255]
    assert len(valid) < len(out) and sum(r["pred"] == r["label"] for r in valid) / len(valid) > 0.75
    spark.createDataFrame([("s", "train", [[1.0]], [1, 2])], schema).write.parquet(f"{tmp_path}/bad")
    with pytest.raises(Exception, match="differ in length"):
        readers.read_token_cache(spark, f"{tmp_path}/bad").collect()


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(6)
    x, w = rng.normal(size=(80, 4)) * [1, 3, 0.5, 2], np.array([1.0, -2.0, 0.5, 3.0])
    y = 10 * (x @ w) + rng.normal(size=80) + 4
    frame = lambda a, b: spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(a, b)], "vec_id long, embedding array<double>, label double")
    got = {r["vec_id"]: r["pred"] for r in heads.fit_ridge(frame(0, 60), frame(60, 80), 7.0).collect()}
    mean, sd = x[:60].mean(axis=0), x[:60].std(axis=0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z[:60].T @ z[:60] + 7.0 * np.eye(4), z[:60].T @ (y[:60] - y[:60].mean()))
    assert np.allclose([got[i] for i in range(60, 80)], z[60:] @ beta + y[:60].mean(), rtol=1e-6)


def test_logistic_head_is_the_optimum(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(90, 3)) * [1, 4, 0.3]
    y = (x @ [1.0, 0.4, -2.0] + rng.normal(size=90) > 0.8).astype(float)
    frame = lambda a, b: spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(a, b)], "vec_id long, embedding array<double>, label double")
    got = {r["vec_id"]: r["score"] for r in heads.fit_logistic(frame(0, 70), frame(70, 90), 0.5, 200).collect()}
    z = np.c_[(x - x[:70].mean(axis=0)) / x[:70].std(axis=0), np.ones(90)]
    w = np.where(y[:70] == 1, 35 / y[:70].sum(), 35 / (70 - y[:70].sum()))
    beta, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z[:70] @ beta))
        step = 0.5 * z[:70].T @ (w * (p - y[:70])) + ridge @ beta
        beta -= np.linalg.solve(0.5 * (z[:70].T * (w * p * (1 - p))) @ z[:70] + ridge, step)
    assert np.allclose([got[i] for i in range(70, 90)], 1 / (1 + np.exp(-z[70:] @ beta)), atol=1e-4)


def test_audits_of_nothing(spark):
    none = spark.createDataFrame([], "sample_id string, split string, sequence string, label double, group_id string")
    assert sorted(tuple(r) for r in quality.validate_samples(none).collect()) == [("no_test", 1), ("no_train", 1), ("no_validation", 1)]
    assert set(quality.audit_dataset(none).first()) == {0}
    assert all(r["ok"] and r["rows"] == 0 for r in corpus.ready_report(none).collect())


def test_audits_name_each_fault(spark):
    rows = [("1", "train", "ACGT", 1.0, "g"), ("1", "test", "ACGT", None, "g"), (None, "dev", "ACX", float("inf"), None), (None, None, None, 0.0, None)]
    bad = spark.createDataFrame(rows, "sample_id string, split string, sequence string, label double, group_id string")
    got = {r["rule"]: r["rows"] for r in quality.validate_samples(bad).collect()}
    assert got == {"missing_id": 2, "bad_split": 2, "bad_symbol": 2, "bad_label": 1, "missing_label": 1, "no_validation": 1, "duplicate_id": 2, "cross_split_signature": 1, "cross_split_group_id": 1}


def test_silence_makes_a_run_stalled(spark, tmp_path):
    start = 1_700_000_000
    beats = [("a", 0), ("b", 10), ("a", 100), ("b", 100), ("b", 190), ("b", 370), ("b", 550), ("a", 600), ("b", 700), ("c", 710), ("b", 880), ("b", 1060), ("b", 1240)]
    rows = [(k, start + t, "running", "p") for k, t in beats] + [("a", start + 700, "complete", "p"), ("c", start + 800, "running", "other"), ("d", start + 5, "running", "other")]
    rows.sort(key=lambda r: r[1])
    kind = "run_key string, ts timestamp, status string, plan_sha256 string"
    for k in range(0, len(rows), 3):  # every file is a micro-batch, and the query stops after each
        spark.createDataFrame([(a, t, b, c) for a, t, b, c in rows[k : k + 3]], "run_key string, t long, status string, plan_sha256 string").selectExpr("run_key", "timestamp_seconds(t) AS ts", "status", "plan_sha256").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with logs.state_in_rocksdb(spark):
            states = logs.watch_runs(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), "p")
            states.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    out = spark.read.schema("run_key string, at timestamp, state string").parquet(f"{tmp_path}/out")
    got = sorted((r["run_key"], r["t"] - start, r["state"]) for r in out.selectExpr("run_key", "unix_timestamp(at) AS t", "state").collect())
    assert got == [("a", 0, "running"), ("a", 280, "stalled"), ("a", 600, "running"), ("a", 700, "complete"), ("b", 10, "running"), ("c", 710, "running"), ("c", 890, "stalled")]
    plan = lambda *k: spark.createDataFrame([(x,) for x in k], "run_key string")
    assert tuple(logs.roll_up(plan("a", "b", "c", "d", "d"), out).first()) == (1, 0, 1, 2, "running")
    assert logs.roll_up(plan("a"), out).first()["status"] == "ok" and logs.roll_up(plan("a", "c"), out).first()["status"] == "not_running"


def test_best_so_far_of_a_run_in_many_frames(spark, tmp_path):
    rows = [(7, s, float((s * 37) % 11)) for s in range(20)]
    schema, key = "run_key long, step long, value double", "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.createDataFrame(rows[::-1], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get(key)
    spark.conf.set(key, 3)
    try:
        logs.best_so_far(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = sorted((r["step"], r["best"], r["run_key"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(s, min(v for _, at, v in rows if at <= s), 7) for _, s, _ in rows]
