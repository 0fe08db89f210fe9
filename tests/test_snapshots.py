"""Tables that change as a whole, and logs that count once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from reviewloom.operators.requests import log_rows
from reviewloom.sinks import snapshots
from reviewloom.sinks.tables import append_log, write_splits
from reviewloom.sources.corpus import scan_processed

SCHEMA = "id string, text_clean_classical string, label int, dataset string, split string"


def rows_of(df):
    return sorted((r.dataset, r.split, r.id, r.text_clean_classical) for r in df.collect())


def splits(spark, word, dataset="first", names=("train", "validation", "test")):
    return spark.createDataFrame([(f"{s}{i}", f"{word} {i}", i % 2, dataset, s) for s in names for i in range(4)], SCHEMA)


def test_writes_replace_their_partitions_together(spark, tmp_path):
    path = str(tmp_path / "splits")
    write_splits(splits(spark, "old"), path)
    write_splits(splits(spark, "other", "second é/=", ("train",)), path)
    assert {(r.dataset, r.split) for r in scan_processed(spark, path).collect()} == {
        ("first", "train"), ("first", "validation"), ("first", "test"), ("second é/=", "train"),
    }
    before = scan_processed(spark, path, "first")
    write_splits(splits(spark, "new", names=("train", "test")), path)
    got = rows_of(scan_processed(spark, path, "first"))
    assert {(s, t.split()[0]) for _, s, _, t in got} == {("train", "new"), ("test", "new"), ("validation", "old")}
    # A reader that has begun still reads what it resolved.
    assert {t.split()[0] for *_, t in rows_of(before)} == {"old"}
    assert rows_of(scan_processed(spark, path, "second é/=", "train"))[0][3] == "other 0"
    assert scan_processed(spark, path, "first", "absent").count() == 0
    assert "version" not in scan_processed(spark, path).columns
    old = snapshots.remove_old_versions(spark, path)
    assert len(old) == 0  # validation is still listed from the first version
    write_splits(splits(spark, "last"), path)
    assert len(snapshots.remove_old_versions(spark, path)) == 2
    assert {t.split()[0] for *_, t in rows_of(scan_processed(spark, path, "first"))} == {"last"}


def test_a_write_that_dies_between_partitions_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "splits")
    write_splits(splits(spark, "old"), path)
    want = rows_of(scan_processed(spark, path))
    dies = splits(spark, "new").repartition(1).sortWithinPartitions("split").withColumn(
        "text_clean_classical", F.when(F.col("split") == "validation", F.raise_error(F.lit("killed"))).otherwise(F.col("text_clean_classical"))
    )
    with pytest.raises(Exception, match="killed"):
        write_splits(dies, path)
    assert rows_of(scan_processed(spark, path)) == want

    def killed(*_):
        raise KeyboardInterrupt

    # All files are written, the pointer is not.
    commit, snapshots._commit = snapshots._commit, killed
    try:
        with pytest.raises(KeyboardInterrupt):
            write_splits(splits(spark, "new"), path)
    finally:
        snapshots._commit = commit
    assert rows_of(scan_processed(spark, path)) == want
    assert len(snapshots.remove_old_versions(spark, path)) >= 1
    assert rows_of(scan_processed(spark, path)) == want


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "splits")
    write_splits(splits(spark, "old"), path)
    commit, turns = snapshots._commit, []

    def slow(spark_, folder, number, partitions):
        if not turns:
            turns.append(1)
            write_splits(splits(spark, "fast", "second", ("train",)), path)  # takes the number meanwhile
        return commit(spark_, folder, number, partitions)

    snapshots._commit = slow
    try:
        write_splits(splits(spark, "slow", names=("train",)), path)
    finally:
        snapshots._commit = commit
    assert {(r.dataset, r.text_clean_classical.split()[0]) for r in scan_processed(spark, path, split="train").collect()} == {("first", "slow"), ("second", "fast")}
    names = sorted(n for n in os.listdir(f"{path}/{snapshots.SNAPSHOTS}") if n.endswith(".json") and not n.startswith("."))
    assert len(names) == 3 and json.loads(open(f"{path}/{snapshots.SNAPSHOTS}/{names[-1]}").read()).keys() >= {"dataset=second/split=train"}


def test_a_folder_without_snapshots_is_read_as_it_is(spark, tmp_path):
    path = str(tmp_path / "plain")
    splits(spark, "plain").write.partitionBy("dataset", "split").parquet(path)
    assert scan_processed(spark, path, "first", "test").count() == 4


def responses(spark):
    rows = [(f"r{i}", 200 if i % 4 else 422, "positive", 0.5, "m", 3) for i in range(12)]
    return spark.createDataFrame([*rows, rows[1]], "request_id string, status int, sentiment string, confidence double, model string, input_length int")


def test_a_batch_scored_twice_is_logged_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = responses(spark)
    assert append_log(log_rows(rows.where("request_id < 'r5'"), batch="b1"), path)  # failed half way
    assert append_log(log_rows(rows, batch="b1"), path)
    assert append_log(log_rows(rows, batch="b1"), path)
    log = spark.read.parquet(path)
    ids = [r.prediction_id for r in log.collect()]
    assert len(ids) == len(set(ids)) == 9
    assert append_log(log_rows(rows, batch="b2"), path) and spark.read.parquet(path).count() == 18
    assert all(len(i) == 36 and i[14] == "5" and i[19] in "89ab" for i in ids)
    assert sorted(ids) == sorted(r.prediction_id for r in log_rows(rows.repartition(5), batch="b1").collect())
