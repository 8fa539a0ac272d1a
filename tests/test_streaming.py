import json
import time

from aidlens.operators import evidence
from aidlens.plans import queries
from aidlens.sources import evidence_store
from aidlens.streaming import ingest
from conftest import SMALL
from samples import EVIDENCE_COLUMNS, record


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    time.sleep(0.05)  # Spark takes files by their time; those of one tick of the clock have no order
    (folder / name).write_text("\n".join(json.dumps(r) for r in records) + "\nnot json\n")


def records_of(rows, *items):
    df = evidence.build_records(rows(list(items), EVIDENCE_COLUMNS), "2026-01-01T00:00:00+00:00").drop("seq", "raw")
    return [json.loads(x) for x in df.toJSON().collect()]


def run(spark, tmp_path):
    lines = ingest.evidence_lines(spark, str(tmp_path / "landing"), files_per_batch=1)
    ingest.ingest_evidence(lines, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    return evidence_store.read_store(spark, str(tmp_path / "store"))


def test_ingest_inserts_once(spark, rows, tmp_path):
    first = records_of(rows, record(1), record(2, title="Other"))
    land(tmp_path / "landing", "a.jsonl", first)
    land(tmp_path / "landing", "b.jsonl", first + records_of(rows, record(3, title="Third")))
    assert run(spark, tmp_path).count() == 3
    land(tmp_path / "landing", "c.jsonl", first)
    assert run(spark, tmp_path).count() == 3


def test_the_first_line_of_an_id_stays(spark, rows, tmp_path):
    one = records_of(rows, *[record(k, title=f"T{k}", deaths=k) for k in range(40)])
    again = [{**r, "deaths": r["deaths"] + 100} for r in one]
    land(tmp_path / "landing", "a.jsonl", [x for pair in zip(one, again) for x in pair])
    got = run(spark, tmp_path)
    assert sorted(r.deaths for r in got.collect()) == list(range(40))


def test_late_and_undated_records_are_stored_once(spark, rows, tmp_path):
    late = records_of(rows, record(1, observed_at="2020-01-01T00:00:00Z"), record(2, observed_at=""), record(3, observed_at="no date"))
    land(tmp_path / "landing", "a.jsonl", records_of(rows, record(9)))
    for name in ("b.jsonl", "c.jsonl"):
        land(tmp_path / "landing", name, late)
        got = run(spark, tmp_path)
    assert sorted(r.observed_at for r in got.collect()) == sorted(["2020-01-01T00:00:00Z", "", "no date", records_of(rows, record(9))[0]["observed_at"]])


def test_nothing_new_writes_no_file(spark, rows, tmp_path):
    batch = evidence.build_records(rows([record(1)], EVIDENCE_COLUMNS), "2026-01-01T00:00:00+00:00")
    for by_day in (False, True):
        store = str(tmp_path / f"store{by_day}")
        assert evidence_store.append_new(batch, store, ids_by_day=by_day) == 1
        files = sorted(str(p) for p in (tmp_path / f"store{by_day}").rglob("*.parquet"))
        assert evidence_store.append_new(batch, store, ids_by_day=by_day) == 0
        assert sorted(str(p) for p in (tmp_path / f"store{by_day}").rglob("*.parquet")) == files


def test_hazards_drop_repeats(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    feature = lambda i: {"id": f"e{i}", "properties": {"mag": 5.0, "time": 1700000000000 + i}, "geometry": {"coordinates": [1, 2, 3]}}
    (folder / "a.json").write_text(json.dumps({"features": [feature(1), feature(2)]}))
    (folder / "b.json").write_text(json.dumps({"features": [feature(2), feature(3)]}))
    old = {**feature(4), "properties": {"mag": 5.0, "time": 1}}  # decades late
    (folder / "c.json").write_text(json.dumps({"features": [old, feature(1)]}))
    hazards = ingest.hazard_files(spark, str(folder), files_per_batch=1)
    ingest.ingest_hazards(hazards, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["e1", "e2", "e3", "e4"]


def test_a_landing_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_folder", lambda _: str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small parts are not put together
    try:
        stored = queries.QUERIES["stream_evidence_ingest"](spark, SMALL)
        assert stored.count() == stored.select("record_id").distinct().count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for k in range(3):
        assert len(list(tmp_path.glob(f"evidence-stream-*/landing/{k}/part-*"))) > 1


def test_the_state_gets_ids_and_times_alone_and_records_move_once(spark, rows, tmp_path, monkeypatch):
    land(tmp_path / "landing", "a.jsonl", records_of(rows, *[record(k, title=f"T{k}") for k in range(5)]))
    plans = []
    append = ingest.CommittedTable.append
    monkeypatch.setattr(ingest.CommittedTable, "append", lambda self, rows, *a: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or append(self, rows, *a))
    query = ingest.ingest_bounded(ingest.evidence_lines(spark, str(tmp_path / "landing")), str(tmp_path / "store"), str(tmp_path / "cp"))
    query.awaitTermination()
    state = query._jsq.explainInternal(True)
    state = state[state.index("== Optimized Logical Plan ==") : state.index("== Physical Plan ==")]
    below = state[state.index("Deduplicate") :]
    assert "summary" not in below.split("\n\n")[0]
    assert plans[0].count("Window ") == 1  # the last batch has no rows
