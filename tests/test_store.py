"""Published batches, the stream with bounded state, the bucketed hazards, the shared folder."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from aidlens.operators import evidence
from aidlens.session import shared_folder
from aidlens.sources import evidence_store
from aidlens.sources.committed import CommittedTable
from aidlens.streaming import ingest
from samples import EVIDENCE_COLUMNS, record
from test_streaming import land, records_of

ROOT = Path(__file__).resolve().parent.parent


def built(rows, *items):
    return evidence.build_records(rows(list(items), EVIDENCE_COLUMNS), "2026-01-01T00:00:00+00:00")


def test_a_batch_that_fails_before_it_is_published_does_not_exist(spark, rows, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    batch = built(rows, *[record(k, title=f"T{k}") for k in range(30)])
    publish = CommittedTable._publish

    def fails(self, commit):
        raise OSError("lost")

    monkeypatch.setattr(CommittedTable, "_publish", fails)
    with pytest.raises(OSError):
        evidence_store.append_new(batch, store, name="b1")
    assert list((tmp_path / "store").rglob("*.parquet"))  # written, but nothing names it
    assert evidence_store.read_store(spark, store).count() == 0
    monkeypatch.setattr(CommittedTable, "_publish", publish)
    assert evidence_store.append_new(batch, store, name="b1") == 30
    assert evidence_store.append_new(batch, store, name="b1") == 30  # sent again: known by its name
    assert evidence_store.append_new(batch, store, name="b2") == 0
    assert evidence_store.read_store(spark, store).count() == 30
    assert [c["rows"] for c in sorted(evidence_store.table(spark, store).commits(), key=lambda c: c["name"])] == [30, 0]


def test_compaction_keeps_the_rows(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    for k in range(3):
        evidence_store.append_new(built(rows, record(k, title=f"T{k}")), store, name=f"b{k}")
    table = evidence_store.table(spark, store)
    before = sorted(map(str, table.read().collect()))
    assert table.compact(lambda all_rows: all_rows.coalesce(1)) == 3
    assert sorted(map(str, table.read().collect())) == before
    assert len(table.commits()) == 1 and table.compact() == 0
    assert evidence_store.append_new(built(rows, record(1, title="T1")), store, name="b1") == 1  # replaced, still known
    assert table.read().count() == 3


def test_days_are_pruned(spark, rows, tmp_path):
    store = str(tmp_path / "store")
    days = [record(k, title=f"T{k}", observed_at=f"2026-01-{k + 1:02d}T00:00:00Z") for k in range(9)]
    evidence_store.append_new(built(rows, *days), store)
    batch = built(rows, days[3]).withColumn(evidence_store.DAY, evidence_store.observed_day())
    read = evidence_store.of_days(evidence_store.table(spark, store).read(), batch).select(F.input_file_name()).distinct().collect()
    assert [r[0].split(f"{evidence_store.DAY}=")[1].split("/")[0] for r in read] == ["2026-01-04"]


def bounded(spark, tmp_path, checkpoint="cp", delay="5 days"):
    lines = ingest.evidence_lines(spark, str(tmp_path / "landing"), files_per_batch=1)
    ingest.ingest_bounded(lines, str(tmp_path / "store"), str(tmp_path / checkpoint), delay).awaitTermination()
    return sorted((r.title, r.observed_at, r.deaths) for r in evidence_store.read_store(spark, str(tmp_path / "store")).collect())


def at(k, day, deaths=1):
    return record(k, title=f"T{k}", observed_at=day, deaths=deaths)


def again(records, deaths):
    return [{**r, "deaths": deaths} for r in records]


def test_no_record_is_dropped_or_stored_twice(spark, rows, tmp_path):
    one = records_of(rows, at(1, "2026-01-10T00:00:00Z"), at(2, "2026-01-11T00:00:00Z"), at(3, ""), at(4, "someday"))
    two = records_of(rows, at(5, "2026-01-20T00:00:00Z"), at(6, "2026-01-12T00:00:00Z"))
    late = records_of(rows, at(7, "2020-05-05T00:00:00Z"), at(8, "2026-01-15T00:00:00Z"), at(9, ""))
    land(tmp_path / "landing", "a.jsonl", one + again(one, 7))
    land(tmp_path / "landing", "b.jsonl", two + again(one, 8))
    want = bounded(spark, tmp_path)
    assert want == sorted((f"T{k}", d, 1) for k, d in [
        (1, "2026-01-10T00:00:00Z"), (2, "2026-01-11T00:00:00Z"), (3, ""), (4, "someday"), (5, "2026-01-20T00:00:00Z"), (6, "2026-01-12T00:00:00Z")])
    # after a restart, beyond the watermark of 15 January, on it, undated, and repeated
    land(tmp_path / "landing", "c.jsonl", late + again(one + two + late, 9))
    land(tmp_path / "landing", "d.jsonl", again(late + two, 10) + records_of(rows, at(10, "2026-01-21T00:00:00Z")))
    want = sorted([*want, ("T7", "2020-05-05T00:00:00Z", 1), ("T8", "2026-01-15T00:00:00Z", 1), ("T9", "", 1), ("T10", "2026-01-21T00:00:00Z", 1)])
    assert bounded(spark, tmp_path) == want
    # a far date lifts the watermark above all that follows
    land(tmp_path / "landing", "e.jsonl", records_of(rows, at(11, "2999-01-01T00:00:00Z")))
    land(tmp_path / "landing", "f.jsonl", again(one, 11) + records_of(rows, at(12, "2026-02-01T00:00:00Z")) + again(two, 12))
    want = sorted([*want, ("T11", "2999-01-01T00:00:00Z", 1), ("T12", "2026-02-01T00:00:00Z", 1)])
    assert bounded(spark, tmp_path) == want
    # a new checkpoint knows nothing of what the table holds
    assert bounded(spark, tmp_path, "other") == want


def test_a_batch_that_runs_again_adds_nothing(spark, rows, tmp_path):
    land(tmp_path / "landing", "a.jsonl", records_of(rows, at(1, "2026-01-10T00:00:00Z"), at(2, "2026-01-11T00:00:00Z")))
    want = bounded(spark, tmp_path)
    kept = {p.suffix for p in (tmp_path / "cp" / "state" / "0").rglob("*") if p.is_file()}
    assert kept & {".zip", ".changelog"} and ".delta" not in kept  # RocksDB's files, not those of the default provider
    for name in os.listdir(tmp_path / "cp" / "commits"):  # as if the stream had failed after its batch
        (tmp_path / "cp" / "commits" / name).unlink()
    assert bounded(spark, tmp_path) == want


def test_hazards_read_only_their_buckets(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    feature = lambda i: {"id": f"e{i}", "properties": {"mag": 5.0, "time": 1700000000000 + i}, "geometry": {"coordinates": [1, 2, 3]}}
    (folder / "a.json").write_text(json.dumps({"features": [*map(feature, range(200)), {"properties": {"mag": 1.0}}]}))
    start = lambda: ingest.ingest_hazards(
        ingest.hazard_files(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=64
    ).awaitTermination()
    start()
    (folder / "b.json").write_text(json.dumps({"features": [*map(feature, range(150, 260)), {"properties": {"mag": 1.0}}]}))
    start()
    stored = ingest.read_hazards(spark, str(tmp_path / "out"))
    assert sorted(str(r.event_id) for r in stored.collect()) == sorted([*[f"e{i}" for i in range(260)], "None"])
    batch = stored.filter("event_id IN ('e1', 'e2')").withColumn(ingest.BUCKET, ingest.feeds.id_bucket(64))
    touched = {r[0] for r in batch.select(ingest.BUCKET).collect()}
    known = ingest.hazards_like(batch, str(tmp_path / "out"))
    plan = known.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert f"PartitionFilters: [{ingest.BUCKET}" in plan.replace("isnotnull(", "").replace("(id", "id")
    read = known.select(F.input_file_name()).distinct().collect()
    assert {int(r[0].split(f"{ingest.BUCKET}=")[1].split("/")[0]) for r in read} == touched


def test_shared_folder_without_a_setting(tmp_path):
    code = (
        "from aidlens.session import local_session, shared_folder\n"
        "spark = local_session('1')\n"
        "assert spark.conf.get('spark.checkpoint.dir', None) is None\n"
        "folder = shared_folder(spark)\n"
        "assert folder == shared_folder(spark)\n"
        "spark.range(3).write.parquet(folder + '/t')\n"
        "print(spark.read.parquet(folder + '/t').count())\n"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("3"), done.stderr[-2000:]


def test_shared_folder_of_the_session(spark):
    assert shared_folder(spark) == shared_folder(spark)
