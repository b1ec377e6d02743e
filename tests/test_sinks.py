"""Stored aggregates: what planning and reading touch, what readers are shown, and what vacuum removes."""

import os
import re
import uuid
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from stateroll.sources import sinks


@contextmanager
def jobs(spark):
    """The jobs that run meanwhile."""
    group, out = uuid.uuid4().hex, []
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        yield out
    finally:
        out += spark.sparkContext.statusTracker().getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def part(spark, chunks, run, at, value=1, spec="h"):
    rows = [(c, p, f"k{k}", value) for c in chunks for p in ("2024-01", "2024-02") for k in range(3)]
    df = spark.createDataFrame(rows, "chunk_id string, period string, key string, n int").coalesce(1)
    return sinks.stamped(df, run, None, spec, at)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_aggregate(part(spark, ["01", "02", "03"], "r1", "2024-03-01 00:00:00"), path)
    sinks.write_aggregate(part(spark, ["02"], "r2", "2024-03-02 00:00:00", 5).withColumn("later", F.lit(1.5)), path)
    sinks.write_aggregate(part(spark, ["03"], "r3", "2024-03-03 00:00:00", 7, "other"), path)
    return path


def shown(df):
    return sorted((r.chunk_id, r.pipeline_run_id, r.n) for r in df.select("chunk_id", "pipeline_run_id", "n").distinct().collect())


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_newest_of_each_chunk_and_configuration(spark, stored):
    assert shown(sinks.scan_aggregate(spark, stored, "h")) == [("01", "r1", 1), ("02", "r2", 5), ("03", "r1", 1)]
    assert shown(sinks.scan_aggregate(spark, stored)) == [("01", "r1", 1), ("02", "r2", 5), ("03", "r3", 7)]
    assert len(shown(sinks.scan_aggregate(spark, stored, every_attempt=True))) == 5
    later = sinks.scan_aggregate(spark, stored, "h").groupBy("chunk_id").agg(F.max("later").alias("later")).orderBy("chunk_id").collect()
    assert [r.later for r in later] == [None, 1.5, None]


def test_planning_reads_no_part_and_reading_prunes_them(spark, stored):
    with jobs(spark) as ran:
        df = sinks.scan_aggregate(spark, stored, "h").where("period = '2024-02'")
    assert ran == []
    text = plan(df)
    scans = re.findall(r"FileScan parquet \[[^\]]*\bn#", text)
    assert len(scans) == 1 and "mergeSchema" not in text
    filters = re.search(r"FileScan parquet \[[^\]]*\bn#.*?PartitionFilters: \[(.*?)\], PushedFilters", text, re.S).group(1)
    assert "dynamicpruningexpression(concat(chunk_id" in filters and "period" in filters
    assert df.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().count() == 3  # of five folders of that period


def test_view_of_visible_attempts_is_one_scan(spark, stored, tmp_path):
    rows = spark.createDataFrame(
        [("s", "01", "r1", "ok", "ok", 1), ("s", "02", "r1", "ok", "ok", 1), ("s", "02", "r2", "failed", "failed", 2), ("s", "03", "r1", "ok", "ok", 1), ("z", "03", "r3", "ok", "ok", 2)],
        "source string, chunk_id string, pipeline_run_id string, status string, run_status string, attempt_at int",
    )
    rows.write.parquet(str(tmp_path / "attempts"))
    attempts = spark.read.parquet(str(tmp_path / "attempts"))
    df = sinks.visible_rows(spark, stored, attempts, "h")
    assert shown(df) == shown(sinks.current_view(sinks.scan_aggregate(spark, stored, "h", every_attempt=True), attempts, "h")) == [("01", "r1", 1), ("02", "r1", 1), ("03", "r1", 1)]
    text = plan(df)
    assert len(re.findall(r"FileScan parquet \[[^\]]*\bn#", text)) == 1 and "dynamicpruningexpression(concat(chunk_id" in text


def test_a_write_does_not_read_what_was_there(spark, stored):
    before = []
    for k in range(3):
        with jobs(spark) as ran:
            got = sinks.write_aggregate(part(spark, [f"1{k}"], f"n{k}", "2024-03-05 00:00:00"), stored).collect()
        assert {(r.chunk_id, r.pipeline_run_id, r.n_rows, r.files) for r in got} == {(f"1{k}", f"n{k}", 3, 1)}
        before.append(len(ran))
    assert len(set(before)) == 1 and before[0] <= 8
    assert len(os.listdir(f"{stored}/_schema")) == 2 * 2  # two sets of columns, each with its checksum


def test_columns_of_other_types_are_told(spark, stored):
    with pytest.raises(ValueError, match="column n"):
        sinks.write_aggregate(part(spark, ["09"], "r9", "2024-03-05 00:00:00").withColumn("n", F.lit("x")), stored)
    assert len(shown(sinks.scan_aggregate(spark, stored))) == 3


def test_what_is_not_in_the_log_is_not_shown(spark, stored):
    part(spark, ["01"], "broken", "2024-03-09 00:00:00", 99).write.partitionBy(*sinks.PARTS).mode("append").parquet(stored)
    assert shown(sinks.scan_aggregate(spark, stored, "h"))[0] == ("01", "r1", 1)
    assert len(shown(sinks.scan_aggregate(spark, stored, every_attempt=True))) == 5
    gone = sinks.vacuum(spark, stored, -1)
    assert {(x.kind, x.path.split("pipeline_run_id=")[1]) for x in gone} == {("unfinished", "broken"), ("superseded", "r1")}


def test_vacuum_keeps_to_its_time(spark, stored):
    reader = sinks.scan_aggregate(spark, stored, every_attempt=True)
    assert sinks.vacuum(spark, stored, 600) == [] and len(shown(reader)) == 5
    would = sinks.vacuum(spark, stored, -1, dry_run=True)
    assert len(shown(sinks.scan_aggregate(spark, stored, every_attempt=True))) == 5
    gone = sinks.vacuum(spark, stored, -1)
    assert gone == would and all(x.bytes > 0 and not os.path.exists(x.path.removeprefix("file:")) for x in gone)
    assert {tuple(re.findall(r"chunk_id=(\w+)/pipeline_run_id=(\w+)", x.path)[0]) for x in gone} == {("02", "r1")}
    assert shown(sinks.scan_aggregate(spark, stored, "h")) == [("01", "r1", 1), ("02", "r2", 5), ("03", "r1", 1)]
    # another configuration's attempts go with spec_hash only
    gone = sinks.vacuum(spark, stored, -1, spec_hash="h")
    assert {tuple(re.findall(r"chunk_id=(\w+)/pipeline_run_id=(\w+)", x.path)[0]) for x in gone} == {("03", "r3")}
    assert shown(sinks.scan_aggregate(spark, stored, "h")) == [("01", "r1", 1), ("02", "r2", 5), ("03", "r1", 1)]


def test_an_attempt_written_again_after_a_newer_one(spark, tmp_path):
    """A repeat of the older attempt is superseded from then on, not from when the newer one came."""
    path = str(tmp_path / "t")
    sinks.write_aggregate(part(spark, ["01"], "r1", "2024-03-01 00:00:00"), path)
    sinks.write_aggregate(part(spark, ["01"], "r2", "2024-03-02 00:00:00"), path)
    sinks.write_aggregate(part(spark, ["01"], "r1", "2024-03-01 00:00:00", 3), path)
    assert shown(sinks.scan_aggregate(spark, path)) == [("01", "r2", 1)]
    assert sinks.vacuum(spark, path, 600) == [] and len(sinks.vacuum(spark, path, -1)) == 2


def test_versions(spark, tmp_path):
    target = str(tmp_path / "v")
    for k in range(3):
        sinks.publish(part(spark, ["01"], f"r{k}", "2024-03-01 00:00:00", k), target)
    now = sinks.current(spark, target)
    part(spark, ["01"], "x", "2024-03-01 00:00:00").write.parquet(f"{target}/versions/half")
    assert sinks.vacuum_versions(spark, target, 600) == []
    assert sorted(x.kind for x in sinks.vacuum_versions(spark, target, -1)) == ["superseded", "superseded", "unfinished"]
    assert shown(now) == shown(sinks.current(spark, target)) == [("01", "r2", 2)]
    assert sinks.vacuum_versions(spark, target, -1) == []


def test_chunks_with_odd_names(spark, tmp_path):
    path = str(tmp_path / "o")
    odd = ["a=b/c", "100%", "x y:z"]
    sinks.write_aggregate(part(spark, odd, "r 1", "2024-03-01 00:00:00"), path)
    sinks.write_aggregate(part(spark, odd[:1], "r 2", "2024-03-02 00:00:00", 2), path)
    want = [("100%", "r 1", 1), ("a=b/c", "r 2", 2), ("x y:z", "r 1", 1)]
    assert shown(sinks.scan_aggregate(spark, path)) == want
    assert len(sinks.vacuum(spark, path, -1)) == 2 and shown(sinks.scan_aggregate(spark, path, every_attempt=True)) == want
