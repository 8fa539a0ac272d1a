import json
from pathlib import Path

from aidlens import schemas
from aidlens.operators import events, evidence
from aidlens.session import written
from aidlens.sources import evidence_store
from samples import EVIDENCE_COLUMNS, record

NOW = "2026-08-21T00:00:00+00:00"


def built(rows, *records):
    return evidence.build_records(rows(list(records), EVIDENCE_COLUMNS), NOW)


def test_identity_goldens(rows):
    r = built(rows, record(1)).first()
    assert r.event_key == "05fc1089beb47dafb555"
    assert r.record_id == "13aa689a3a973826d573961f"
    assert (r.freshness, r.severity, r.confidence, r.raw, r.deaths) == ("unknown", "unknown", "unverified", "{}", None)
    assert r.fetched_at == NOW


def test_slug_is_cut_after_trimming(rows):
    from pyspark.sql import functions as F

    from aidlens.functions import text

    df = rows([("--" + "a" * 79 + " b",), ("É",)], "t string").select(text.slug(F.col("t")).alias("s"))
    assert {r.s for r in df.collect()} == {"a" * 79 + "-", ""}


def test_insert_is_idempotent_and_first_wins(rows):
    batch = built(rows, record(1, deaths=1), record(2, deaths=2), record(3, title="Other"))
    store = built(rows, record(0)).filter("false")
    new = evidence.insert_new(batch, store, "seq")
    assert sorted(r.seq for r in new.collect()) == [1, 3]
    after = evidence.merged(batch, store, "seq")
    assert after.count() == 2
    assert evidence.insert_new(batch, after, "seq").count() == 0


def test_hot_record_id(spark, rows):
    """Most rows are copies of one record."""
    copies = spark.range(5000).selectExpr("id AS seq")
    one = rows([record(0)], EVIDENCE_COLUMNS).drop("seq")
    batch = evidence.build_records(copies.crossJoin(one), NOW)
    assert [r.seq for r in evidence.first_per_record(batch, "seq").collect()] == [0]


def test_casualties_stay_unknown_or_apart(rows):
    df = built(
        rows,
        record(1, deaths=None),
        record(2, source_name="B", deaths=5, source_tier="secondary-news"),
        record(3, source_name="C", deaths=9),
        record(4, title="Quiet"),
    )
    ranges = {r.records: r for r in events.casualty_ranges(df).collect()}
    assert (ranges[3].deaths_min, ranges[3].deaths_max, ranges[3].figures, ranges[3].conflicting) == (5, 9, 2, True)
    assert (ranges[1].deaths_min, ranges[1].deaths_max, ranges[1].conflicting) == (None, None, False)
    figures = {(r.source_name, r.deaths) for r in events.casualty_figures(df).collect()}
    assert figures == {("B", 5), ("C", 9)}
    primary = {r.primary_records: r for r in events.casualty_primary_only(df).collect()}
    assert (primary[2].deaths_min, primary[2].deaths_max, primary[2].corroborating_records) == (9, 9, 1)


def test_rollup_and_latest(rows):
    df = built(
        rows,
        record(1, observed_at="2026-01-01"), record(2, observed_at="2026-01-03", source_name="B"),
        record(3, observed_at="2026-01-02"),
    )
    r = events.event_rollup(df).first()
    assert (r.records, r.sources, r.first_observed, r.last_observed) == (3, 2, "2026-01-01", "2026-01-03")
    assert events.event_latest(df).first().seq == 2
    assert {(x.source_name, x.records) for x in events.event_sources(df).collect()} == {("NDMA SACHET", 2), ("B", 1)}


def test_provenance_never_shows_zero_for_unknown(rows):
    r = evidence.provenance(built(rows, record(1, deaths=0))).first()
    assert r.deaths == "0" and r.affected_people == r.injuries == r.missing == "Not reported by the connected source"
    assert r.verification_state == "official"


def test_context_is_ranked_json_with_nulls(rows):
    records = built(rows, record(1), record(2, title="Second", deaths=4))
    hits = rows([(7, 2, 1), (7, 1, 2)], "qid int, seq bigint, rank int")
    got = evidence.context(hits, records, ["qid"])
    listed = json.loads(got.first().context)
    assert [x["event"] for x in listed] == ["Second", "SACHET Flood alert"]
    assert list(listed[0]) == [
        "event", "domain", "location", "summary", "source", "source_url", "observed_at", "affected_people", "deaths", "confidence",
    ]
    assert listed[0]["deaths"] == 4 and listed[1]["deaths"] is None
    asked = rows([(7,), (8,)], "qid int")
    answered = {r.qid: r for r in evidence.question_evidence(asked, got, ["qid"]).collect()}
    assert answered[7].matches == 2
    assert (answered[8].matches, answered[8].context) == (0, "No matching stored evidence records.")


def test_every_bucket_of_contexts_is_a_task(rows, monkeypatch):
    """Texts are long, so the buckets must not meet in a few tasks."""
    monkeypatch.setattr(evidence, "BUCKET_HITS", 10)
    records = built(rows, record(1, title="\u00c9t\u00e9 \u201cflood\u201d"))
    got = evidence.context(rows([(k, 1, 1) for k in range(400)], "qid int, seq bigint, rank int"), records, ["qid"])
    assert got.rdd.getNumPartitions() == 40
    assert {json.loads(r.context)[0]["event"] for r in got.collect()} == {"\u00c9t\u00e9 \u201cflood\u201d"}


def test_a_record_that_many_questions_found_moves_once_a_bucket(rows, monkeypatch):
    records = built(rows, record(1), record(2, title="Second"), record(2, title="Also second"))
    hits = rows([(k, 1, 1) for k in range(200)] + [(k, 2, 2) for k in range(0, 200, 2)] + [(None, 1, 1), (500, 9, 1)], "qid int, seq bigint, rank int")
    plan = evidence.context(hits, records, ["qid"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "context#" not in plan[plan.index("MapInArrow") :].split("\n", 1)[1]  # texts are joined after the last shuffle
    monkeypatch.setattr(evidence, "BUCKET_HITS", 50)
    got = {r.qid: r for r in evidence.context(hits, records, ["qid"]).collect()}
    assert set(got) == {*range(200), None}
    assert {r.matches for q, r in got.items() if q is not None and q % 2} == {1} and {r.matches for q, r in got.items() if q is not None and q % 2 == 0} == {3}
    assert [x["event"] for x in json.loads(got[4].context)] == ["SACHET Flood alert", "Also second", "Second"]
    asked = rows([(4, "a"), (4, "a"), (None, "b"), (777, "c"), (500, "d")], "qid int, x string")
    rest = evidence.with_context(asked, hits, records, ["qid"]).collect()
    assert sorted((r.x, r.matches or 0) for r in rest) == [("a", 3), ("a", 3), ("b", 0), ("c", 0), ("d", 0)]


def test_texts_of_found_records_are_read_and_not_moved_to_the_rows(spark, rows, monkeypatch):
    """Small pieces and batches of one row; a shuffle has the rows alone, and a record is kept once for all buckets."""
    for name, value in (("BUCKET_HITS", 7), ("PIECE_BYTES", 50), ("GIVEN_BYTES", 1)):
        monkeypatch.setattr(evidence, name, value)
    records = built(rows, *[record(i, title=f"t{i}", summary=f"\u00e9 {i} " * 50) for i in range(30)], record(3, title="s3"), record(99))
    hits = rows([(q, (q * k) % 31, k) for q in range(40) for k in (1, 2, 3)], "qid int, seq bigint, rank int")
    asked = rows([(q, f"x{q}") for q in range(45)] * 2, "qid int, x string")
    found = evidence.with_context(asked, hits, records, ["qid"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" in plan
    titles = {i: [f"t{i}"] for i in range(30)} | {3: ["s3", "t3"], 30: []}
    wanted = {q: [t for k in (1, 2, 3) for t in titles[q * k % 31]] for q in range(40)}
    got = found.collect()
    assert len(got) == 90 and all(r.x == f"x{r.qid}" for r in got)
    assert all([e["event"] for e in json.loads(r.context or "[]")] == wanted.get(r.qid, []) and (r.matches or 0) == len(wanted.get(r.qid, [])) for r in got)
    pieces = spark.read.parquet(max(Path(evidence.shared_folder(spark)).glob("contexts-*/texts"), key=lambda p: p.stat().st_mtime).as_posix())
    assert sorted(int(r.seq) for r in pieces.filter("piece = 0").collect()) == list(range(30)) and pieces.count() > 60


def test_rows_without_any_hit_stay(rows):
    none = rows([], "qid int, seq bigint, rank int")
    got = evidence.with_context(rows([(1,), (None,)], "qid int"), none, built(rows, record(1)), ["qid"])
    assert sorted((r.qid or 0, r.context, r.matches) for r in got.collect()) == [(0, None, None), (1, None, None)]
    assert evidence.context(none, built(rows, record(1)), ["qid"]).count() == 0


def test_a_tidy_write_leaves_the_settings_as_they_were(spark, rows, tmp_path):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    table = written(rows([(1,), (2,), (2,)], "k int").distinct(), str(tmp_path / "t"), tidy=True)
    assert sorted(r.k for r in table.collect()) == [1, 2] and spark.conf.get(key) == before


def full(**changes):
    base = {name: name[0] for name in schemas.EVIDENCE_REQUIRED}
    return base | changes


def test_tolerant_lines(rows):
    no_title = full()
    del no_title["title"]
    lines = [
        json.dumps(full(record_id="ok", deaths=3, raw={"a": 1})),
        json.dumps(full(record_id="null", title=None, freshness=None)),
        "", "   ", "{bad", "[1]", "3",
        json.dumps(full(record_id="extra", other=1)),
        json.dumps(no_title),
        json.dumps(full(record_id="typed", deaths="many")),
        json.dumps(full(record_id="tail")) + " tail",
        json.dumps(full(record_id="cut"))[:-1],
    ]
    got = {r.record_id: r for r in evidence_store.parse_lines(rows([(x,) for x in lines], "value string")).collect()}
    assert set(got) == {"ok", "null", "typed"}
    assert (got["ok"].deaths, json.loads(got["ok"].raw), got["ok"].freshness) == (3, {"a": 1}, "unknown")
    assert got["null"].title is None and got["null"].freshness is None
    assert got["typed"].deaths is None


def test_missing_path_is_empty(spark, tmp_path):
    assert evidence_store.read_lines(spark, str(tmp_path / "none")).count() == 0
    assert evidence_store.read_store(spark, str(tmp_path / "none")).columns == schemas.EVIDENCE.names


def test_append_new_counts_and_repeats(rows, tmp_path):
    store = str(tmp_path / "store")
    batch = built(rows, record(1), record(2), record(3, title="Other"))
    assert evidence_store.append_new(batch, store, "seq") == 2
    assert evidence_store.append_new(batch, store, "seq") == 0
    more = built(rows, record(1), record(4, title="Third"))
    assert evidence_store.append_new(more, store) == 1
    assert evidence_store.read_store(batch.sparkSession, store).count() == 3


def test_lines_round_trip(rows, tmp_path):
    df = built(rows, record(1, deaths=4), record(2, title="Línea\n\"dos\"")).drop("seq")
    evidence_store.append_lines(df, str(tmp_path / "lines"))
    for r in df.sparkSession.read.text(str(tmp_path / "lines")).collect():
        assert json.loads(r.value)["raw"] == {}
    back = evidence_store.read_lines(df.sparkSession, str(tmp_path / "lines"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
