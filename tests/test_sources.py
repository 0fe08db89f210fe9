"""Readers, writers and file facts on small folders."""

import hashlib

import pytest

from reviewloom.functions.scoring import epoch_seconds, new_row_id
from reviewloom.sinks.tables import write_split_csv
from reviewloom.sources.corpus import discover_splits, scan_csv_split, scan_csv_splits, scan_labelled_directory
from reviewloom.sources.manifest import artifact_sizes, checksums, file_manifest
from reviewloom.sources.reports import read_report, write_report


@pytest.fixture
def tree(tmp_path):
    files = {
        "train/pos/1_9.txt": b"good", "train/neg/2_1.txt": b"bad \xff\xfe end", "test/pos/0_8.txt": "été\r\nx\ry".encode(),
        "train/unsup/3_0.txt": b"ignored", "train/pos/readme.md": b"not a review",
    }
    for name, content in files.items():
        path = tmp_path / "corpus" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return tmp_path / "corpus", files


def test_directory_scan(spark, tree):
    root, files = tree
    rows = {r["id"]: r for r in scan_labelled_directory(spark, str(root), "c").collect()}
    assert set(rows) == {"c_train_pos_1_9", "c_train_neg_2_1", "c_test_pos_0_8"}
    bad = rows["c_train_neg_2_1"]
    assert (bad["label"], bad["split"]) == (0, "train")
    assert bad["text_raw"] == files["train/neg/2_1.txt"].decode("utf-8", errors="replace")
    assert rows["c_test_pos_0_8"]["text_raw"] == "été\nx\ny"


def test_manifest_and_sizes(spark, tree):
    root, files = tree
    expected = {("train", "pos"): 1, ("train", "neg"): 2, ("train", "unsup"): 5, ("test", "pos"): 1, ("test", "neg"): 1}
    rows = {(r["split"], r["class"]): r for r in file_manifest(spark, str(root), expected).collect()}
    assert {k: (r["n_files"], r["matches"]) for k, r in rows.items()} == {
        ("train", "pos"): (1, True), ("train", "neg"): (1, False), ("train", "unsup"): (1, None),
        ("test", "pos"): (1, True), ("test", "neg"): (0, False),
    }
    sums = {r["path"].split("corpus/")[1]: r["sha1"] for r in checksums(spark, str(root)).collect()}
    assert sums == {k: hashlib.sha1(v).hexdigest() for k, v in files.items()}
    big = root / "model.bin"
    big.write_bytes(b"x" * 1_572_864)
    sizes = artifact_sizes(spark, {"one": [str(big)], "both": [str(big), str(root / "train")]}).collect()
    assert {r["artifact"]: r["size_mb"] for r in sizes} == {"one": 1.5, "both": 1.5}


def test_csv(spark, tmp_path):
    (tmp_path / "train.csv").write_text('label,sentence\n1,"a ""quoted"", line\nbreak"\n-1,null\n')
    (tmp_path / "validation.csv").write_text("review\nplain\n")
    assert discover_splits(spark, str(tmp_path)) == ["train", "validation"]
    train = scan_csv_split(spark, str(tmp_path), "train").collect()
    assert [(r["text_raw"], r["label"]) for r in train] == [('a "quoted", line\nbreak', 1), ("null", -1)]
    every = scan_csv_splits(spark, str(tmp_path))
    assert {(r["split"], r["text_raw"]) for r in every.collect()} >= {("validation", "plain")}
    texts = [' outer "space" ', "a\r\nb", "", "x,y"]
    write_split_csv(spark.createDataFrame([(t,) for t in texts], "sentence string"), str(tmp_path / "back.csv"))
    assert sorted(r["text_raw"] or "" for r in scan_csv_split(spark, str(tmp_path), "back").collect()) == sorted(texts)


def test_reports(spark, tmp_path):
    path = str(tmp_path / "report.json")
    assert read_report(spark, path, required=False) is None
    with pytest.raises(FileNotFoundError):
        read_report(spark, path)
    df = spark.sql("SELECT 'm' model_name, named_struct('f1', 0.5D) test_metrics, 2.5D model_size_mb")
    write_report(df, path)
    row = read_report(spark, path).first()
    assert row["test_metrics"]["f1"] == 0.5 and row["model_size_mb"] == 2.5 and row["test_latency_ms"] is None


def test_row_ids(spark):
    rows = spark.range(50).select(new_row_id().alias("i"), epoch_seconds().alias("t")).collect()
    assert len({r["i"] for r in rows}) == 50 and len({r["t"] for r in rows}) == 1


def test_checksums_in_chunks(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 90_000  # several chunks
    (tmp_path / "large file.bin").write_bytes(data)
    (tmp_path / "small.bin").write_bytes(b"x")
    from reviewloom.sources.manifest import checksums

    got = {r["n_bytes"]: r["sha1"] for r in checksums(spark, str(tmp_path), large=10).collect()}
    assert got == {len(data): hashlib.sha1(data).hexdigest(), 1: hashlib.sha1(b"x").hexdigest()}


def test_text_files_of_rows(spark, tmp_path):
    from reviewloom.sinks.files import write_text_files

    rows = [("train/pos", "a\r\nb"), ("train/pos", "a\r\nb"), ("test/neg", None), ("train/neg", "é"), ("other", "left out"), (None, "no folder")]
    df = spark.createDataFrame(rows, "folder string, text string").repartition(3)
    for root in (str(tmp_path / "plain"), f"file:{tmp_path}/uri"):
        write_text_files(df, root, ["train/pos", "train/neg", "test/pos", "test/neg"])
        found = scan_labelled_directory(spark, root, "c").select("split", "label", "text_raw").collect()
        assert sorted(tuple(r) for r in found) == [("test", 0, "\n"), ("train", 0, "é\n"), ("train", 1, "a\nb\n"), ("train", 1, "a\nb\n")]
    assert (tmp_path / "plain" / "test" / "pos").is_dir() and not (tmp_path / "plain" / "other").exists()


def test_page_files_are_written_by_all_cores_in_one_pass(spark, tmp_path):
    from urllib.parse import urlsplit

    from reviewloom.catalog.sources import _page_files, page_checksums

    html = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "CASE WHEN id % 7 > 0 THEN concat('<p>', id) END AS html")
    html.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    root = urlsplit(_page_files(spark, str(tmp_path))).path
    import pathlib

    writers = {p.name.split("-")[0 if p.name[0].isdigit() else 1] for p in pathlib.Path(root).glob("*/*/*.txt")}
    assert len(writers) > 1
    want = sorted(hashlib.sha1((f"<p>{i}" if i % 7 else "").encode() + b"\n").hexdigest() for i in range(400))
    assert sorted(r["sha1"] for r in page_checksums(spark, str(tmp_path)).collect()) == want
