"""Readers, writers and streams on small files."""

import hashlib
import json

import pytest

from millrace.operators import matrix
from millrace.sources import files, readers, samples
from millrace.streaming import logs


def test_csv_aliases(spark, tmp_path):
    (tmp_path / "x_dev.csv").write_text("seq,labels,genome,orthogroup\nacgt,1,rice,g1\nACGG,011,,\nAC,\"[1, 2.5]\",maize,g2\n")
    rows = readers.read_table_samples(spark, str(tmp_path), "t").orderBy("sequence").collect()
    assert [(r["sequence"], r["label"], r["label_vec"], r["species"], r["split"]) for r in rows] == [
        ("AC", None, [1.0, 2.5], "maize", "validation"), ("ACGG", None, [0.0, 1.0, 1.0], "unknown_plant", "validation"), ("ACGT", 1.0, None, "rice", "validation")]
    assert len({r["sample_id"] for r in rows}) == 3


def test_fasta(spark, tmp_path):
    (tmp_path / "rice_test.fa").write_text(">a|1\nACG\nTT\n>b|0|1\nGG\n>nolabel\nAA\n>bad|x\nAC\n>a|1\nACG\nTT\n")
    rows = readers.read_labelled_fasta(spark, str(tmp_path), "t").collect()
    by = {r["source_name"]: r for r in rows}
    assert (by["a"]["sequence"], by["a"]["label"], by["a"]["split"], by["a"]["species"], by["a"]["status"]) == ("ACGTT", 1.0, "test", "rice", None)
    assert by["b"]["label_vec"] == [0.0, 1.0] and by["nolabel"]["status"] == by["bad"]["status"] == "no_label" and len({r["sample_id"] for r in rows}) == len(rows) == 5
    assert {r["species"] for r in readers.read_labelled_fasta(spark, str(tmp_path), "t", "wheat").collect()} == {"wheat"}


def test_rows_are_numbered_over_byte_ranges(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("sequence,label\n" + "".join(f"{'ACGT' * (i % 30)},{i}\n" for i in range(500)))
    ids = []
    for most in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            rows = files.in_file_order(spark.read.option("header", True).csv(str(tmp_path))).collect()
            ids.append({(r["sample_id"], r["label"]) for r in readers.read_table_samples(spark, str(tmp_path), "t").collect()})
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert len(rows) == 1000 and all(r["_index"] == int(r["label"]) for r in rows)
    assert ids[0] == ids[1] and len({i for i, _ in ids[0]}) == 1000


def test_gff3(spark, tmp_path):
    (tmp_path / "a.gff3").write_text("##gff\nchr1\tx\trepeat_region\t5\t9\t.\t+\t.\tID=1;Classification=LTR/Gypsy_2;\nchr1\tx\tgene\t1\t2\t.\t+\t.\tID=2\nshort\tline\n")
    assert [tuple(r) for r in readers.read_gff3(spark, str(tmp_path)).collect()] == [("chr1", "repeat_region", 5, 9, "Gypsy")]


LOGS = {
    "run-a.jsonl": ["starting", {"step": 1, "loss": 0.5, "lr": 1e-3, "note": "x"}, {"step": 2, "val_loss": 0.7, "loss": 0.4}, {"step": 3, "loss": 0.3}, {"step": 3, "loss": 0.31}, {"step": 5, "val_acc": 1}, "{broken", {"loss": 9}],
    "run-b.jsonl": [{"resume": "a", "start_step": 2}, {"step": 3, "loss": 0.25}, {"resume": "a", "start_step": 4}, {"step": 4, "loss": "NaN", "lr": 2}],
    "run-c.jsonl": [{"step": 3, "loss": 0.2}, {"step": 9, "other": 1}],
    "run-d.jsonl": [{"resume": "c", "start_step": 3}, {"step": 4, "val_loss": 0.1}],
}


def merged_plainly():
    rows = []
    for _, lines in sorted(LOGS.items()):
        new, resume = [], None
        for m in (x for x in lines if isinstance(x, dict)):
            resume = m["start_step"] if "resume" in m else resume
            number = {k: float(v) for k, v in m.items() if k != "step" and not isinstance(v, str)}
            if "step" in m and "loss" in m:
                new.append(("train", m["step"], {k: v for k, v in number.items() if not k.startswith("val_")}))
            if "step" in m and any(k.startswith("val_") for k in m):
                new.append(("val", m["step"], {k[4:]: v for k, v in number.items() if k.startswith("val_")}))
        rows = [r for r in rows if resume is None or r[1] <= resume] + new
    return {(s, t): m for s, t, m in rows}


@pytest.mark.parametrize("order", [["run-a", "run-b", "run-c", "run-d"], ["run-d", "run-b", "run-a", "run-c"]])
def test_logs_followed_in_any_cut_equal_a_plain_merge(spark, tmp_path, order):
    write = lambda name: (tmp_path / "logs" / f"{name}.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in LOGS[f"{name}.jsonl"]))
    (tmp_path / "logs").mkdir()
    for names in order[:1], order[1:3], order[3:]:  # the query stops and goes on between
        for name in names:
            write(name)
        logs.follow_logs(spark, str(tmp_path / "logs"), str(tmp_path / "t"), str(tmp_path / "cp"), files_at_once=1).awaitTermination()
    want = merged_plainly()
    assert {(r["split"], r["step"]): r["metrics"] for r in logs.read_followed(spark, str(tmp_path / "t")).collect()} == want
    assert {(r["split"], r["step"]): r["metrics"] for r in matrix.merge_entries(readers.read_training_log(spark, str(tmp_path / "logs"))).collect()} == want


def rows_of(n=60):
    return [{"sample_id": f"s{i}", "split": ("train", "val", "TEST ")[i % 3], "sequence": "ACGTRYU"[: 3 + i % 5] + format(i, "b").translate({48: "A", 49: "C"}), "label": float(i % 2), "species": "rice" if i % 2 else "", "group_id": f"g{i}", "extra": i if i % 4 else None} for i in range(n)]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, split string, sequence string, label double, species string, group_id string, extra long")


def test_store_is_written_whole_or_not_at_all(spark, tmp_path):
    path, rows = str(tmp_path / "top" / "store"), rows_of()
    manifest = samples.write_samples(frame_of(spark, rows), path, "t1", "binary")
    flat = [r["sequence"] for r in rows]
    assert (manifest["rows"], manifest["total_bases"], manifest["split_counts"]) == (60, sum(map(len, flat)), {"train": 20, "validation": 20, "test": 20})
    assert manifest["iupac_symbols_to_n"] == {c: sum(s.count(c) for s in flat) for c in "RY"} and manifest["u_bases_to_t"] == sum(s.count("U") for s in flat)
    assert manifest["rows_with_iupac"] == sum(any(c in s for c in "RY") for s in flat) and manifest["cross_split_groups"] == 0 and not manifest["paired_sequences"]
    assert samples.read_manifest(spark, path) == manifest
    back = {r["sample_id"]: r for r in samples.read_samples(spark, path).collect()}
    for r in rows:
        b = back[r["sample_id"]]
        assert (b["sequence"], b["label"], b["species"]) == (r["sequence"].translate(str.maketrans("RYU", "NNT")), r["label"], r["species"] or "unknown_plant")
        assert b["metadata"] == ({} if r["extra"] is None else {"extra": str(r["extra"])})
    one = samples.read_samples(spark, path, "validation")
    assert {r["split"] for r in one.collect()} == {"validation"} and "PartitionFilters: [isnotnull(split" in one._jdf.queryExecution().toString()
    with pytest.raises(FileExistsError):
        samples.write_samples(frame_of(spark, rows), path, "t1", "binary")
    assert sorted(x.name for x in (tmp_path / "top").iterdir() if not x.name.endswith(".crc")) == ["store"]


@pytest.mark.parametrize(("change", "rule"), [
    ({"sample_id": "s2"}, "duplicate_id"), ({"sample_id": " "}, "missing_id"), ({"split": "other"}, "bad_split"), ({"sequence": "AC-T"}, "bad_symbol"), ({"sequence": None}, "bad_symbol"), ({"label": None}, "missing_label"),
    ({"label": float("inf")}, "bad_label"), ({"sequence": "ACGTRA"}, "cross_split_signature"), ({"group_id": "g1"}, "cross_split_group_id"),
])
def test_broken_rules_leave_nothing(spark, tmp_path, change, rule):
    rows = rows_of()
    rows[3] |= change
    if rule == "cross_split_signature":
        rows[4] |= change
    with pytest.raises(samples.InvalidSamples) as x:
        samples.write_samples(frame_of(spark, rows), str(tmp_path / "store"), "t", "binary")
    assert rule in x.value.found and not list(tmp_path.iterdir())
    if rule.startswith("cross_split"):
        m = samples.write_samples(frame_of(spark, rows), str(tmp_path / "store"), "t", "binary", allow_copies=True, allow_groups=True)
        assert m["rows"] == 60 and m["cross_split_groups"] == (rule == "cross_split_group_id")


def test_pairs_vectors_and_empty_tables(spark, tmp_path):
    kind = "sample_id string, split string, sequence string, sequence_b string, label_vec array<double>"
    write = lambda rows, **k: samples.write_samples(spark.createDataFrame(rows, kind), str(tmp_path / "store"), "t", "multilabel", **k)
    whole = [("a", "train", "ACG", "UU", [1.0, 0.0]), ("b", "test", "ACT", "AR", [0.0, 0.0]), ("c", "dev", "GG", "T", [1.0, 1.0])]
    for rows, rule in ([], "no_rows"), (whole[:2], "no_validation"), ([*whole, ("d", "train", "AAA", "", [1.0, 0.0])], "mixed_pairing"), ([*whole, ("d", "train", "AAA", "A", [1.0])], "label_widths"), ([*whole, ("d", "train", "AAA", "A", [1.0, float("nan")])], "bad_label_vector"):
        with pytest.raises(samples.InvalidSamples) as x:
            write(rows)
        assert rule in x.value.found
    m = write(whole)
    assert (m["vector_label_width"], m["paired_sequences"], m["u_bases_to_t"], m["iupac_symbols_to_n"]) == (2, True, 2, {"R": 1})
    assert {r["sample_id"]: r["sequence_b"] for r in samples.read_samples(spark, str(tmp_path / "store")).collect()} == {"a": "TT", "b": "AN", "c": "T"}


def test_reports_and_scans(spark, tmp_path):
    df = spark.createDataFrame([("t", "train", "AC")], "task_id string, split string, sequence string")
    readers.write_report(df, str(tmp_path / "r"), ["split", "sequence"])
    assert {r["size_bytes"] > 0 for r in readers.scan_artifacts(spark, str(tmp_path / "r")).collect()} == {True}
    with pytest.raises(Exception, match="exists"):
        readers.write_report(df, str(tmp_path / "r"), ["split"])


def test_scan_of_small_and_large_files(spark, tmp_path):
    held = {"a.txt": b"one", "sub/b.bin": bytes(range(256)) * 40, "sub/deep/c": b"", "x receipt.txt": b"r"}
    for name, raw in {**held, ".cache/d": b"no", "sub/.cache/e": b"no", "sub/receipt.json": b"no", "my_receipt.json": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    want = {(n, len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in held.items()}
    digests = set()
    for cell in (1 << 20, 100, -1):
        got = readers.scan_artifacts(spark, str(tmp_path), cell)
        assert {tuple(r) for r in got.collect()} == want
        digests.add(readers.snapshot_digest(got))
    (tmp_path / "sub" / "deep" / "c").write_bytes(b"!")
    assert len(digests) == 1 and readers.snapshot_digest(readers.scan_artifacts(spark, str(tmp_path))) not in digests


def test_window_index_opens_only_its_shards(spark, tmp_path):
    rows = [(s, "train" if s < 3 else "validation", 10 * i, 4096 + i, (" CDS ", "intron", None)[i % 3]) for s in range(5) for i in range(4)]
    readers.write_window_index(spark.createDataFrame(rows, "shard long, split string, offset long, length int, region_bucket string"), str(tmp_path))
    regions = {"cds": 1, "intron": 2}
    got = readers.read_window_index(spark, str(tmp_path), "train", regions)
    assert sorted(tuple(r[c] for c in ("shard", "offset", "length", "region")) for r in got.collect()) == [(s, o, n, {" CDS ": 1, "intron": 2}.get(x, -100)) for s, p, o, n, x in rows if p == "train"]
    opened = lambda x: {f.rsplit("/", 2)[-2] for f in x.inputFiles()}
    assert opened(got) == {"shard=0", "shard=1", "shard=2"} and opened(readers.read_window_index(spark, str(tmp_path), "train", regions, shards=[1, 4])) == {"shard=1"}
    assert readers.read_window_index(spark, str(tmp_path), "test", regions).isEmpty()


def test_hits_under_both_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,"snp.chr",snp.position,snp.ref,snp.alt,overPermutation\n"p, q",1,5,A,C,True\n,1,5,A,C,false\n')
    (tmp_path / "b.csv").write_text("overPermutation,SNPAlt,SNPRef,SNPPos,SNPChr\nFalse,C,A,5,1\nFalse,T,G,6,2\n,T,G,bad,2\n")
    (tmp_path / "c.csv").write_text("other,header\n1,2\n")
    assert sorted(tuple(r) for r in readers.read_gwas_hits(spark, str(tmp_path)).collect()) == [("1", 5, "A", "C", 1), ("2", 6, "G", "T", 0)]


def test_embeddings_must_be_whole(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.5, 0.0])], "row int, embedding array<double>")
    readers.append_embeddings(df.where("row = 1"), str(tmp_path / "e"))
    readers.append_embeddings(df.where("row = 2"), str(tmp_path / "e"))
    assert readers.read_embeddings(spark, str(tmp_path / "e"), 2, 2).count() == 2
    for width, rows in ((2, 3), (3, 2)):
        with pytest.raises(ValueError):
            readers.read_embeddings(spark, str(tmp_path / "e"), width, rows)
    readers.append_embeddings(spark.createDataFrame([(3, [float("nan"), None])], df.schema), str(tmp_path / "e"))
    with pytest.raises(ValueError):
        readers.read_embeddings(spark, str(tmp_path / "e"), 2, 3)


def test_scan_lists_folders_in_tasks(spark, tmp_path):
    """Names with spaces and percent signs, hidden ones left out, and no list of files on the driver."""
    top = tmp_path / "a b%20c"
    held = {"x y%.txt": b"1", "d=0/_e=1": b"2", "d=0/deep/f #g?": b"3" * 50}
    for name, raw in {**held, "_hidden": b"no", ".h/x": b"no", "_tmp/x": b"no"}.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(raw)
    want = {(n, len(raw), hashlib.sha256(raw).hexdigest()) for n, raw in held.items()}
    for root in (str(top), f"file:{top}", f"file://{top}/"):
        got = readers.scan_artifacts(spark, root, 10)
        assert {tuple(r) for r in got.collect()} == want
        assert "binaryFile" not in got._jdf.queryExecution().toString()
