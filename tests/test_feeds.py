import html
import html.entities
import json
import time

import pytest
from pyspark.sql import functions as F

from aidlens.functions import text
from aidlens.operators import evidence, feeds
from aidlens.sources import landed, tables
from samples import REQUEST_COLUMNS, REQUESTS

HAZARDS = {"features": [
    {"id": "a", "properties": {"title": "T", "mag": 5.25, "place": "P", "time": 1700000000123, "url": "u"},
     "geometry": {"coordinates": [1.5, 2.5, 3.5]}},
    {"id": "b", "properties": {"mag": None, "time": 1700000100000}, "geometry": {"coordinates": [1.0]}},
    {"id": "c"},
]}


def write(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_hazards(spark, tmp_path):
    got = {r.event_id: r for r in landed.read_hazards(spark, write(tmp_path / "h.json", HAZARDS)).collect()}
    assert (got["a"].severity, got["a"].longitude, got["a"].latitude, got["a"].depth_km) == (5.25, 1.5, 2.5, 3.5)
    assert str(got["a"].time) == "2023-11-14 22:13:20.123000"
    assert (got["b"].title, got["b"].place, got["b"].severity, got["b"].latitude) == ("Earthquake", "Unknown location", 0.0, None)
    assert got["c"].title == "Earthquake" and got["c"].time is None


def test_recent_hazards_window_and_limit(rows):
    data = [(i, f"p{i}", 4.0 + i / 10, f"2024-01-{10 + i:02d} 00:00:00") for i in range(10)]
    df = rows(data, "event_id int, place string, severity double, t string").withColumn("time", F.col("t").cast("timestamp_ntz"))
    recent = feeds.recent_hazards(df, "2024-01-18 00:00:00", days=3, minimum=4.5)
    assert [r.event_id for r in recent.collect()] == [8, 7, 6, 5]
    assert feeds.recent_hazards(df, "2024-01-18 00:00:00", days=3, rows=2).count() == 2
    peak = feeds.hazard_peak(recent).first()
    assert (peak.events, peak.peak_place) == (4, "p8")
    assert tuple(feeds.hazard_peak(df.filter("false")).first()) == (0, None, None)


def test_hazard_peak_of_text_ids_counts_all(rows):
    data = [(f"us{k:05d}", f"p{k}", 5.0 + (k in (3, 620)), "2024-01-17 00:00:00") for k in range(700)] + [("us9", "none", None, "2024-01-17 00:00:00")]
    df = rows(data, "event_id string, place string, severity double, t string").withColumn("time", F.col("t").cast("timestamp_ntz"))
    peak = feeds.hazard_peak(feeds.strong_hazards(df, "2024-01-18 00:00:00", days=3)).first()
    assert (peak.events, peak.peak_severity, peak.peak_place) == (700, 6.0, "p3")


def test_raw_json_names_its_source(rows):
    df = feeds.raw_json_status(rows([("{}",), ("<",)], "payload string"), source="S", label="L", reference="R")
    assert sorted((r.status, r.source, r.label, r.reference) for r in df.filter("status = 'ok'").collect()) == [("ok", "S", "L", "R")]
    assert [(r.source, r.label, r.reference) for r in df.filter("status <> 'ok'").collect()] == [("S", "L", None)]


def test_reports(spark, tmp_path):
    doc = {"data": [
        {"fields": {"title": "T", "url": "u1", "date": {"created": "2026-01-02"}, "primary_country": [{"name": "X"}, {"name": "Y"}], "source": [{"name": "S"}]}},
        {"fields": {"url": "u2", "date": {"created": "2026-01-03"}, "primary_country": [], "source": []}},
        {"fields": {"url": "u3"}},
    ]}
    df = landed.read_reports(spark, write(tmp_path / "r.json", doc))
    got = {r.url: tuple(r) for r in df.collect()}
    assert got["u1"] == ("T", "X", "S", "2026-01-02", "u1")
    assert got["u2"][:3] == got["u3"][:3] == ("Humanitarian update", "Global", "ReliefWeb")
    assert [r.url for r in feeds.latest_reports(df, 2).collect()] == ["u2", "u1"]
    assert landed.read_reports(spark, None).columns == ["title", "country", "source", "created", "url"]


def test_weather(spark, tmp_path):
    doc = {"current": {"temperature_2m": 21.5}, "daily": {"time": ["d0", "d1"], "precipitation_sum": [1, 2],
                                                           "wind_gusts_10m_max": [3, 4], "temperature_2m_max": [5, None]}}
    feed = landed.read_weather(spark, write(tmp_path / "w.json", doc))
    now = feeds.weather_current(feed, "station").first()
    assert (now.temperature_shown, now.wind_shown) == ("21.5", "—")
    days = feeds.weather_daily(feed, "station").orderBy("day").collect()
    assert [(d.day, d.time, d.temperature_2m_max) for d in days] == [(0, "d0", 5.0), (1, "d1", None)]


def test_geocode(rows):
    schema = "query string, features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<label:string,geocoding:string>>>"
    df = rows([
        ("here", [(([2.0, 1.0],), ("Here, Land", None)), (([9.0, 9.0],), ("Second", None))]),
        ("nolabel", [(([2.0, 1.0],), (None, "{}"))]), ("none", []), (" ", [(([2.0, 1.0],), ("L", None))]),
    ], schema)
    got = {r["query"]: (r.display_name, r.latitude, r.longitude) for r in feeds.normalize_geocode(df).collect()}
    assert got == {"here": ("Here, Land", 1.0, 2.0), "nolabel": ("nolabel", 1.0, 2.0), "none": (None, None, None), " ": (None, None, None)}


def test_gazetteer(rows):
    places = rows([(2, "Pune", 2.0, 2.0), (1, "PUNE", 1.0, 1.0), (3, " ", 0.0, 0.0)], "place_id int, label string, latitude double, longitude double")
    asked = rows([("pune ",), ("pune ",), ("Nowhere",), (" ",)], "query string")
    got = {r["query"]: r.display_name for r in feeds.gazetteer_lookup(asked, places).collect()}
    assert got == {"pune ": "PUNE", "Nowhere": None, " ": None}


PAGE = (
    "<!DOCTYPE html><html><head><title>Alerts</title><script>var x = 'Flood in script</p>';</script><style>p{}</style></head>"
    "<body><!-- Fire in comment --><p>|</p><p>Flood  warning&nbsp;for  A -</p><p>|</p><b>HEAT WAVE</b> near B &amp; C<p>|</p>"
    "<p>flood warning for A</p><p>|</p><p>Rain x</p></body></html>"
)


def test_page_text(rows):
    df = rows([(PAGE,)], "html string").select(text.visible_text(F.col("html")).alias("t"))
    assert df.first().t == "Alerts | Flood  warning for  A - | HEAT WAVE near B & C | flood warning for A | Rain x"


def test_page_text_of_odd_markup(rows):
    """Quoted >, comments and raw elements that stay open, references of every kind."""
    cases = {
        '<a title="x > y" b=\'>\' c>one</a ><br/>two': "one two",
        "a<!-->b<!-- c > d --!>e<!-- open <p>f": "a b e",
        "g<script src='>'>h</p></scripts></SCRIPT\n>i<style>j": "g i",
        "1 < 2 <3 <!doctype x><?php y?></ z>k<b l": "1 < 2 <3 k",
        "don't <p it's>m</p>": "don't m",
        "&lt;p&gt; &amp;lt; &eacute;&AMP;&amp &notit; &notin; &unknown; & &; AT&T": "<p> &lt; é&& ¬it; ∉ &unknown; & &; AT&T",
        "&#65;&#x1F600;&#0;&#xD800;&#150;&#99999999999;&#x000041 &#;&#x;": "A😀\ufffd\ufffd–\ufffdA &#;&#x;",
        "&nbsp;<p>\t&nbsp;</p>\x01": "\x01",
        "": "",
    }
    df = rows(list(cases.items()), "html string, want string").select(text.visible_text(F.col("html")).alias("t"), "want")
    assert all(r.t == r.want for r in df.collect()), [(r.t, r.want) for r in df.collect() if r.t != r.want]
    assert rows([(None,)], "html string").select(text.visible_text(F.col("html")).alias("t")).first().t is None


def test_references_are_those_of_the_standard(rows):
    names = [f"&{n}" for n in html.entities.html5]
    df = rows([(n, f"x{n} y") for n in names], "name string, t string").select("name", text.dereferenced(F.col("t")).alias("t"))
    assert {r.name: r.t for r in df.collect()} == {n: html.unescape(f"x{n} y") for n in names}


def test_hostile_markup_takes_linear_time(rows):
    odd = ["<a " * 200_000, "<a b=" * 100_000, "<!--" * 200_000, "<script>" * 100_000, "</" * 200_000, "=" * 100_000 + '<a "' * 100_000]
    start = time.perf_counter()
    rows([(o,) for o in odd], "html string").select(text.visible_text(F.col("html")).alias("t")).collect()
    assert time.perf_counter() - start < 20


def test_alerts_drop_repeats_of_a_detail(rows):
    got = feeds.extract_alerts(rows([(1, PAGE)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.pos, r.label, r.detail) for r in got] == [(0, "Flood", "warning for A"), (1, "HEAT WAVE", "near B & C")]


def test_alert_limit_counts_before_repeats_are_removed(rows):
    html = "|".join(["Flood same detail"] * 29 + ["Fire number one", "Fire number two"])
    got = feeds.extract_alerts(rows([(1, html)], "page_id int, html string")).orderBy("pos").collect()
    assert [(r.pos, r.detail) for r in got] == [(0, "same detail"), (29, "number one")]


def test_alert_records_keep_event_key_over_fetches(rows):
    alerts = feeds.extract_alerts(rows([(1, "Flood in ward 7")], "page_id int, html string"))
    build = lambda at: evidence.build_records(feeds.alert_rows(alerts, at), at).first()
    one, two = build("2026-01-01"), build("2026-01-02")
    assert one.event_key == two.event_key and one.record_id != two.record_id
    assert (one.domain, one.title, one.freshness, one.country) == ("flood", "SACHET Flood alert", "live-page", "India")


def test_raw_json_and_status(spark, rows, tmp_path):
    write(tmp_path / "ok.json", '{"a": [1, 2]}')
    write(tmp_path / "bad.json", "<html>")
    got = {r.url.split("/")[-1]: (r.status, r.payload) for r in landed.read_raw_json(spark, str(tmp_path)).collect()}
    assert got == {"ok.json": ("ok", '{"a": [1, 2]}'), "bad.json": ("unavailable", None)}
    registry = rows([("A", "u"), ("B", "u")], "source string, url string")
    seen = rows([("A", "u"), ("A", "u")], "source string, url string")
    status = {r.source: (r.status, r.records) for r in feeds.ingest_status(registry, seen).collect()}
    assert status == {"A": ("ok", 2), "B": ("unavailable", 0)}


def test_pages_are_read_whole(spark, tmp_path):
    write(tmp_path / "p.html", "<p>Flood\nin ward 7</p>")
    got = feeds.extract_alerts(landed.read_pages(spark, str(tmp_path))).first()
    assert got.detail == "in ward 7"


def test_csv_in_and_out(spark, rows, tmp_path):
    header = "request_id,location,zone,need_type,people_affected,requested_units,priority,status,reported_at,latitude,longitude"
    lines = [header] + [",".join(str(x) for x in r) for r in REQUESTS]
    write(tmp_path / "emergency_requests.csv", "\n".join(lines))
    df = tables.read_csv(spark, str(tmp_path / "emergency_requests.csv"), tables.OPERATIONAL["emergency_requests"])
    assert df.count() == 15 and str(df.first().reported_at) == "2026-08-19 07:20:00"
    from aidlens.operators import triage

    tables.export_triage(triage.score_requests(df), str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == 15 and "priority_score" in back.columns
    write(tmp_path / "bad.csv", header.replace("location", "place") + "\n" + lines[1])
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), tables.OPERATIONAL["emergency_requests"]).collect()


def test_display(rows):
    df = rows([(1234567, 4.25, 72.878149)], "n bigint, m double, c double")
    shown = df.select(text.thousands(F.col("n")), text.magnitude(F.col("m")), text.coordinate(F.col("c"))).first()
    assert tuple(shown) == ("1,234,567", "M4.2", "72.87815")


def test_display_value(rows):
    df = rows([(None,), ("",), (" nan ",), ("None",), ("NaN",), (" x ",)], "v string")
    got = sorted(r.x for r in df.select(text.display_value(F.col("v"), "?").alias("x")).collect())
    assert got == [" x "] + ["?"] * 5


def test_fields_and_shape_of_raw_documents(rows):
    docs = rows([(1, '{"a": {"b": 5}, "c": "x"}'), (2, '{"a": {"b": "five"}}'), (3, '{"a":'), (4, None), (5, "[1]")], "id int, payload string")
    got = feeds.raw_fields(docs, {"b": ("$.a.b", "int"), "c": ("$.c", "string")}, "payload", "id")
    assert {tuple(r) for r in got.collect()} == {(1, 5, "x"), (2, None, None), (3, None, None), (4, None, None), (5, None, None)}
    assert feeds.raw_shape(docs.filter("id < 4")).first().unparsable == 1
    assert feeds.raw_shape(docs.filter("id = 1")).first().shape == "OBJECT<a: OBJECT<b: BIGINT>, c: STRING>"


def test_damaged_documents_are_kept_beside_the_good(spark, tmp_path):
    from aidlens import schemas
    from aidlens.sources import landed

    files = {
        "source=a/1.json": '{"data": [{"fields": {"title": "T"}}]}', "source=a/2.json": '{"data": [', "source=a/3.json": '{"other": 1}',
        "source=b/1.json": "", "source=c/1.json": "[1]", "source=c/2.json": '{"data":\n []}',
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content)
    docs = landed.read_documents(spark, str(tmp_path), schemas.REPORT_FEED, "data")
    got = {"/".join(r.file.split("/")[-2:]): (r.reason, r.raw, r.bytes) for r in docs.collect()}
    assert got == {
        name: (reason, None if reason is None else files[name], len(files[name]))
        for name, reason in zip(files, [None, "unparsable", "foreign", "empty", "foreign", None])
    }
    assert [r.title for r in feeds.normalize_reports(docs.filter("reason IS NULL")).collect()] == ["T"]
    registry = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    status = {r.source: (r.status, r.documents, r.empty, r.damaged, r.bytes) for r in landed.landed_status(registry, docs).collect()}
    size = lambda s: sum(len(t) for n, t in files.items() if n.startswith(f"source={s}"))
    assert status == {"a": ("ok", 1, 0, 2, size("a")), "b": ("unavailable", 0, 1, 0, 0), "c": ("ok", 1, 0, 1, size("c")), "d": ("unavailable", 0, 0, 0, 0)}
