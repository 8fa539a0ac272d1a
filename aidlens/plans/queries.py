"""Every operator as a query over the given tables: name -> callable(spark, sf_dir)."""

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aidlens import fixed, schemas
from aidlens.functions import text
from aidlens.operators import events, evidence, feeds, graph, questions, reports, search, triage
from aidlens.plans.workload import table, view
from aidlens.session import shared_folder
from aidlens.sources import evidence_store, landed, tables
from aidlens.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FETCHED_AT = "2026-02-01T00:00:00+00:00"
AS_OF = "2024-01-30 12:00:00"
SEARCH_LIMIT = 6
QUESTION = ["conv_id", "turn"]
CHOSEN = [["Unverified", "Verified", "Assigned"], ["Water", "Food", "Medical", "Rescue"], ["AFRICA", "ASIA", "EUROPE"]]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triage.score_requests(view(spark, sf_dir, "requests", rebalance=True))


def _units(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    return lambda top: triage.with_units(top, lines, "order_key", "l_orderkey", "l_quantity")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "questions", rebalance=True)


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.build_records(view(spark, sf_dir, "evidence_in", rebalance=True), FETCHED_AT)


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store already holds: everything the primary sources sent."""
    return _incoming(spark, sf_dir).filter(F.col("source_tier") == fixed.PRIMARY_TIER)


def _at(field: str, one_in: int, value: Column) -> Column:
    """``value``, absent on one of ``one_in`` rows."""
    return F.when(F.col(field) % one_in != 0, value)


# --- triage ---------------------------------------------------------------


@query
def priority_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("request_id", "priority_score")


@query
def filtered_requests(spark, sf_dir):
    chosen = triage.filter_requests(_scored(spark, sf_dir), *CHOSEN)
    return triage.by_urgency(chosen).select(
        "request_id", "zone", "need_type", "status", "people_affected", "priority_score"
    )


@query
def open_requests(spark, sf_dir):
    return triage.open_requests(view(spark, sf_dir, "requests")).select(
        "request_id", "location", "need_type", "priority", "status", "people_affected", "requested_units"
    )


@query
def kpi_snapshot(spark, sf_dir):
    return triage.kpi_snapshot(view(spark, sf_dir, "requests"), view(spark, sf_dir, "shelters"))


@query
def kpi_display(spark, sf_dir):
    kpis = triage.kpi_snapshot(view(spark, sf_dir, "requests"), view(spark, sf_dir, "shelters"))
    return kpis.select(*[text.thousands(F.col(c)).alias(c) for c in kpis.columns])


@query
def need_totals(spark, sf_dir):
    return triage.need_totals(view(spark, sf_dir, "requests"))


@query
def filter_values(spark, sf_dir):
    return triage.filter_values(view(spark, sf_dir, "requests"))


@query
def triage_queue(spark, sf_dir):
    return triage.triage_queue(_scored(spark, sf_dir))


@query
def top_request_per_need(spark, sf_dir):
    heads = triage.score_requests(view(spark, sf_dir, "request_heads"))
    return _units(spark, sf_dir)(triage.top_request_per_need(heads)).select(
        "need_type", "request_id", "location", "priority", "people_affected", "requested_units", "priority_score"
    )


@query
def top_supply_per_type(spark, sf_dir):
    return triage.top_supply_per_type(view(spark, sf_dir, "resources")).select(
        "supply_type", "resource_id", "resource_type", "warehouse", "available_units"
    )


@query
def dispatch_recommendations(spark, sf_dir):
    """Units come from the big line table: they are summed for the chosen requests alone."""
    heads = triage.score_requests(view(spark, sf_dir, "request_heads"))
    return triage.dispatch_recommendations(heads, view(spark, sf_dir, "resources"), _units(spark, sf_dir))


@query
def dispatch_filtered(spark, sf_dir):
    """Dispatch over a filtered view of the requests."""
    chosen = triage.filter_requests(triage.score_requests(view(spark, sf_dir, "request_heads")), *CHOSEN)
    return triage.dispatch_recommendations(chosen, view(spark, sf_dir, "resources"), _units(spark, sf_dir))


@query
def kpis_filtered(spark, sf_dir):
    """Figures of a filtered view of the requests."""
    return triage.request_kpis(triage.filter_requests(view(spark, sf_dir, "request_heads"), *CHOSEN))


@query
def need_totals_filtered(spark, sf_dir):
    return triage.need_totals(triage.filter_requests(view(spark, sf_dir, "request_heads"), *CHOSEN))


@query
def request_map_points(spark, sf_dir):
    return triage.request_map_points(view(spark, sf_dir, "requests"))


@query
def radar_rank(spark, sf_dir):
    return triage.radar_rank(view(spark, sf_dir, "problems")).select("problem", "impact", "urgency", "radar_score")


@query
def radar_lookup(spark, sf_dir):
    return triage.radar_lookup(view(spark, sf_dir, "problems"), "red widget 1").select("problem", "impact", "urgency")


@query
def signal_graph_edges(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS label")
    return graph.signal_graph_edges(view(spark, sf_dir, "graph_edges"), nodes)


# --- evidence -------------------------------------------------------------


@query
def event_key(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence_in")
    key = text.event_key(F.col("domain"), F.col("title"), F.col("location"))
    return rows.select("seq", text.slug(F.col("title")).alias("slug"), key.alias("event_key"))


@query
def record_id(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence_in")
    key = text.event_key(F.col("domain"), F.col("title"), F.col("location"))
    return rows.select("seq", text.record_id(key, F.col("source_name"), F.col("observed_at")).alias("record_id"))


@query
def evidence_build(spark, sf_dir):
    return _incoming(spark, sf_dir).drop("raw")


@query
def evidence_insert_new(spark, sf_dir):
    new = evidence.insert_new(_incoming(spark, sf_dir), _store(spark, sf_dir), "seq")
    return new.select("seq", "record_id", "event_key", "source_name", "observed_at")


@query
def evidence_merged(spark, sf_dir):
    after = evidence.merged(_incoming(spark, sf_dir), _store(spark, sf_dir), "seq")
    return after.select("seq", "record_id", "event_key", "source_tier")


@query
def evidence_load_tolerant(spark, sf_dir):
    """Records as JSON lines, damaged in a way that depends on their domain, read back."""
    rows = _incoming(spark, sf_dir)
    partial = F.struct(*[c for c in schemas.EVIDENCE.names if c != "title"])
    jsons = rows.select(
        "domain",
        F.to_json(F.struct(*schemas.EVIDENCE.names), {"ignoreNullFields": "false"}).alias("whole"),
        F.to_json(partial).alias("partial"),
    )
    damaged = (
        F.when(F.col("domain") == "flood", "  ")
        .when(F.col("domain") == "earthquake", F.substring("whole", F.lit(1), F.length("whole") - 1))
        .when(F.col("domain") == "cyclone", "[1]")
        .when(F.col("domain") == "fire", F.concat(F.lit('{"extra":1,'), F.substring("whole", F.lit(2), F.length("whole"))))
        .when(F.col("domain") == "landslide", F.col("partial"))
        .otherwise(F.col("whole"))
    )
    folder = f"{shared_folder(spark)}/evidence-lines-{uuid.uuid4()}"
    jsons.select(damaged.alias("value")).write.text(folder)
    return evidence_store.read_lines(spark, folder).select(
        "record_id", "event_key", "domain", "title", "summary", "freshness", "deaths", "affected_people"
    )


@query
def evidence_provenance(spark, sf_dir):
    return evidence.provenance(_incoming(spark, sf_dir))


@query
def evidence_topk(spark, sf_dir):
    return search.search(
        _questions(spark, sf_dir), view(spark, sf_dir, "evidence_in", rebalance=True), QUESTION, SEARCH_LIMIT
    )


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The hits of all questions, and the records they were found in; only found ones are costly, so those are not dealt anew."""
    rows = view(spark, sf_dir, "evidence_in", rebalance=True)
    records = evidence.build_records(view(spark, sf_dir, "evidence_in"), FETCHED_AT)
    return search.search(_questions(spark, sf_dir), rows, QUESTION, SEARCH_LIMIT), records


@query
def evidence_context(spark, sf_dir):
    """The JSON contexts as texts, all fields included."""
    return evidence.context(*_hits(spark, sf_dir), QUESTION)


@query
def question_evidence(spark, sf_dir):
    """Every question with its context, or the note that there is none."""
    asked = _questions(spark, sf_dir).select(*QUESTION)
    return evidence.noted(evidence.with_context(asked, *_hits(spark, sf_dir), QUESTION), QUESTION)


@query
def answer_with_evidence(spark, sf_dir):
    """The whole answers of the resource route, each with its evidence section."""
    kpis = triage.request_kpis(view(spark, sf_dir, "requests"))
    answers = reports.resource_answer(_routed(spark, sf_dir), kpis).select(*QUESTION, "answer")
    found = evidence.with_context(answers, *_hits(spark, sf_dir), QUESTION)
    return reports.evidence_sections(found).select(*QUESTION, "answer")


# --- events ---------------------------------------------------------------


@query
def event_rollup(spark, sf_dir):
    return events.event_rollup(_incoming(spark, sf_dir))


@query
def event_sources(spark, sf_dir):
    return events.event_sources(_incoming(spark, sf_dir))


@query
def event_latest(spark, sf_dir):
    return events.event_latest(_incoming(spark, sf_dir)).select(
        "event_key", "seq", "record_id", "observed_at", "source_name", "deaths"
    )


@query
def casualty_ranges(spark, sf_dir):
    return events.casualty_ranges(_incoming(spark, sf_dir))


@query
def casualty_figures(spark, sf_dir):
    return events.casualty_figures(_incoming(spark, sf_dir))


@query
def casualty_primary_only(spark, sf_dir):
    return events.casualty_primary_only(_incoming(spark, sf_dir))


# --- questions ------------------------------------------------------------


@query
def classify_question(spark, sf_dir):
    rows = questions.classify(_questions(spark, sf_dir))
    return rows.select(*QUESTION, "domain", "label", F.array_join("matched_terms", "|").alias("matched_terms"))


@query
def refresh_trigger(spark, sf_dir):
    return _questions(spark, sf_dir).select(*QUESTION, questions.refresh_trigger("text").alias("refresh"))


@query
def death_question_flag(spark, sf_dir):
    return _questions(spark, sf_dir).select(
        *QUESTION, questions.death_question("text").alias("death_requested")
    )


@query
def query_terms(spark, sf_dir):
    found = text.terms(F.col("text"))
    return _questions(spark, sf_dir).select(
        *QUESTION, F.size(found).alias("n_terms"), F.array_join(F.array_sort(found), " ").alias("terms")
    )


@query
def conversation_context(spark, sf_dir):
    return questions.conversation_context(_questions(spark, sf_dir)).select(*QUESTION, "history")


@query
def routing_text(spark, sf_dir):
    return questions.routing_text(_questions(spark, sf_dir)).select(*QUESTION, "routing_text")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.answer_routes(questions.routing_text(_questions(spark, sf_dir)), "routing_text")


@query
def answer_route(spark, sf_dir):
    return _routed(spark, sf_dir).select(*QUESTION, "domain", "route", "sub_domain", "death_requested")


@query
def answer_route_current(spark, sf_dir):
    """Routes by the current message alone."""
    rows = questions.answer_routes(_questions(spark, sf_dir))
    return rows.select(*QUESTION, "domain", "route", "sub_domain", "death_requested")


REPORT_CELLS = [
    "problem_type", "status", "location", "event_time", "affected_people", "deaths", "injuries",
    "missing_people", "affected_areas", "needs", "responders", "sources", "evidence_status", "confidence",
]


@query
def situation_report(spark, sf_dir):
    """Reports for the questions that end on a report route, the conversation so far included."""
    inputs = reports.report_inputs(_routed(spark, sf_dir))
    return reports.situation_report(inputs, *QUESTION).select(*QUESTION, "question", *REPORT_CELLS, "limitations", "report")


@query
def situation_report_current(spark, sf_dir):
    """The same by the current message alone."""
    inputs = reports.report_inputs(questions.answer_routes(_questions(spark, sf_dir)))
    return reports.situation_report(inputs, *QUESTION).select(*QUESTION, "question", *REPORT_CELLS, "limitations", "report")


@query
def evidence_situation_report(spark, sf_dir):
    """Reports from the records themselves, the Markdown included."""
    inputs = reports.evidence_report_inputs(_incoming(spark, sf_dir).drop("record_id").withColumnRenamed("seq", "record_id"))
    return reports.situation_report(inputs, "record_id").select("record_id", "question", *REPORT_CELLS, "report")


@query
def resource_answer(spark, sf_dir):
    kpis = triage.request_kpis(view(spark, sf_dir, "requests"))
    return reports.resource_answer(_routed(spark, sf_dir), kpis).select(*QUESTION, "answer")


@query
def hazard_answer(spark, sf_dir):
    hazards = feeds.normalize_hazards(_hazard_feed(spark, sf_dir))
    peak = feeds.hazard_peak(feeds.strong_hazards(hazards, AS_OF))
    return reports.hazard_answer(_routed(spark, sf_dir), peak).select(*QUESTION, "answer")


@query
def conversation_counts(spark, sf_dir):
    return questions.conversation_counts(view(spark, sf_dir, "questions"))


@query
def conversation_title(spark, sf_dir):
    return questions.conversation_titles(view(spark, sf_dir, "questions"))


@query
def conversation_transcript(spark, sf_dir):
    return questions.conversation_transcript(_questions(spark, sf_dir))


@query
def transcript_export(spark, sf_dir):
    """Exports of all known conversations; every seventh has lost its messages and gets the note."""
    messages = view(spark, sf_dir, "questions")
    known = messages.select("conv_id").distinct()
    return questions.exported_transcripts(known, messages.filter("conv_id % 7 <> 0"))


@query
def operational_csv(spark, sf_dir):
    """Stock written as CSV with a header and read back, blank and unknown figures included."""
    folder = f"{shared_folder(spark)}/operational-{uuid.uuid4()}"
    stock = view(spark, sf_dir, "resources").select(*schemas.RESOURCES.names)
    rows = stock.withColumn("available_units", F.when(F.col("available_units") % 9 != 0, F.col("available_units")))
    rows.write.option("header", True).csv(f"{folder}/resources.csv")
    return tables.read_csv(spark, f"{folder}/resources.csv", schemas.RESOURCES)


@query
def triage_export(spark, sf_dir):
    """The triage list written as CSV, most urgent first, and read back."""
    folder = f"{shared_folder(spark)}/triage-{uuid.uuid4()}"
    columns = ["request_id", "location", "zone", "need_type", "people_affected", "requested_units", "priority", "status", "priority_score"]
    scored = _scored(spark, sf_dir).select(*columns)
    tables.export_triage(scored, folder)
    types = {f.name: f.dataType for f in scored.schema} | {"priority_score": T.IntegerType()}
    return tables.read_csv(spark, folder, T.StructType([T.StructField(c, types[c]) for c in columns]))


@query
def document_excerpt(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mime = F.element_at(F.array(*[F.lit(m) for m in ("text/plain", "application/json", "application/pdf")]),
                        (F.col("doc_id") % 3 + 1).cast("int"))
    label = questions.attachment_label(_at("doc_id", 4, F.col("source")), _at("doc_id", 8, F.col("lang")))
    return docs.select("doc_id", questions.document_excerpt(mime, F.col("text")).alias("excerpt"), label.alias("label"))


@query
def display_value(spark, sf_dir):
    rows = view(spark, sf_dir, "evidence_in")
    odd = (
        F.when(F.col("domain") == "flood", "\t\r\n ").when(F.col("domain") == "fire", "nan")
        .when(F.col("domain") == "drought", " None ").when(F.col("domain") == "heat", " kept ")
        .otherwise(F.col("title"))
    )
    return rows.select(
        "seq", text.display_value(F.col("deaths")).alias("deaths"), text.display_value(odd).alias("shown")
    )


# --- feeds ----------------------------------------------------------------


def _hazard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature collection per event, with parts missing here and there."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    rows = view(spark, sf_dir, "hazards")
    feature = F.struct(
        F.concat(F.lit("us"), F.col("event_id").cast("string")).alias("id"),
        F.struct(
            _at("event_id", 6, F.col("title")).alias("title"),
            _at("event_id", 5, F.col("severity")).alias("mag"),
            _at("event_id", 7, F.col("place")).alias("place"),
            F.timestamp_diff("MILLISECOND", epoch, F.col("time")).alias("time"),
            F.concat(F.lit("https://example.org/e/"), F.col("event_id").cast("string")).alias("url"),
        ).alias("properties"),
        F.struct(
            F.when(F.col("event_id") % 9 == 0, F.array(F.col("depth_km")))
            .otherwise(F.array(F.col("depth_km"), F.col("severity"), F.col("depth_km") / 2))
            .alias("coordinates")
        ).alias("geometry"),
    )
    return rows.select(F.array(feature).alias("features"))


@query
def hazard_normalize(spark, sf_dir):
    return feeds.normalize_hazards(_hazard_feed(spark, sf_dir))


@query
def hazard_recent(spark, sf_dir):
    return feeds.recent_hazards(view(spark, sf_dir, "hazards"), AS_OF)


@query
def hazard_peak(spark, sf_dir):
    return feeds.hazard_peak(feeds.normalize_hazards(_hazard_feed(spark, sf_dir)))


@query
def hazard_display(spark, sf_dir):
    """Shown forms: coordinates with five decimals, magnitudes with one."""
    rows = feeds.normalize_hazards(_hazard_feed(spark, sf_dir))
    return rows.select(
        "event_id", text.coordinate(F.col("longitude")).alias("longitude"), text.magnitude(F.col("severity")).alias("magnitude")
    )


def _report_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    def named(c: str) -> Column:
        one = F.array(F.struct(F.col(c).alias("name")))
        return F.when(F.col(c).isNull(), F.array().cast("array<struct<name:string>>")).otherwise(one)

    fields = F.struct(
        "title", "url", F.struct("created").alias("date"),
        named("country").alias("primary_country"), named("source").alias("source"),
    )
    return view(spark, sf_dir, "reports_flat").select("page_id", F.array(F.struct(fields.alias("fields"))).alias("data"))


@query
def reports_normalize(spark, sf_dir):
    return feeds.normalize_reports(_report_feed(spark, sf_dir), "page_id")


def _landed_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report documents written as lines below a folder for each source, some of them damaged, and read back."""
    whole = F.to_json(F.struct("page_id", "data"))
    damaged = (
        F.when(F.col("page_id") % 10 == 0, F.left(whole, F.lit(20)))
        .when(F.col("page_id") % 10 == 1, "[1]")
        .when((F.col("page_id") % 10 == 2) | (F.col("page_id") % 20 == 13), " ")
        .otherwise(whole)
    )
    feed = _report_feed(spark, sf_dir).select((F.col("page_id") % 20).alias("source"), damaged.alias("value"))
    folder = f"{shared_folder(spark)}/landed-reports-{uuid.uuid4()}"
    feed.write.partitionBy("source").text(folder)
    schema = T.StructType([T.StructField("page_id", T.LongType()), *schemas.REPORT_FEED])
    return landed.read_documents(spark, folder, schema, "data", per_line=True)


@query
def reports_landed(spark, sf_dir):
    return feeds.normalize_reports(_landed_reports(spark, sf_dir).filter("reason IS NULL"), "page_id")


@query
def reports_rescued(spark, sf_dir):
    """What did not read as a report, by source, reason and text."""
    bad = _landed_reports(spark, sf_dir).filter("reason IS NOT NULL")
    return bad.groupBy("source", "reason", "raw").agg(F.count("*").alias("documents"))


@query
def landed_status(spark, sf_dir):
    """Sources 0 to 20, of which some landed only damaged or empty documents and the last none."""
    registry = spark.range(21).select(F.col("id").cast("int").alias("source"))
    return landed.landed_status(registry, _landed_reports(spark, sf_dir)).select("source", "status", "documents", "empty", "damaged")


@query
def reports_latest(spark, sf_dir):
    return feeds.latest_reports(feeds.normalize_reports(_report_feed(spark, sf_dir)))


@query
def gazetteer_lookup(spark, sf_dir):
    """Places asked for in mixed case, with an unknown and a blank one among them."""
    asked = view(spark, sf_dir, "requests").select(
        F.when(F.col("need_type") == "Water", F.lower("location"))
        .when(F.col("need_type") == "Food", F.concat(F.lit(" "), F.col("location"), F.lit(" ")))
        .when(F.col("need_type") == "Rescue", F.concat(F.lit("Lost "), F.col("location")))
        .when(F.col("need_type") == "Transport", F.lit(" "))
        .otherwise(F.col("location")).alias("query")
    )
    places = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS place_id", "n_name AS label",
        "cast(n_nationkey AS double) AS latitude", "cast(-n_nationkey AS double) AS longitude",
    )
    return feeds.gazetteer_lookup(asked, places)


def _weather_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather documents as landed JSON text, parsed with the feed's schema."""
    flat = view(spark, sf_dir, "weather_flat")
    document = F.to_json(F.struct(
        F.struct("temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "weather_code").alias("current"),
        F.struct(
            F.array("day0", "day1", "day2").alias("time"),
            F.array("v0", "v1", "v2").alias("precipitation_sum"),
            F.array("v2", "v1", "v0").alias("wind_gusts_10m_max"),
            F.array("v1", "v1", "v1").alias("temperature_2m_max"),
        ).alias("daily"),
    ))
    return flat.select("station_id", F.from_json(document, schemas.WEATHER_FEED).alias("w")).select("station_id", "w.*")


@query
def weather_current(spark, sf_dir):
    rows = feeds.weather_current(_weather_feed(spark, sf_dir), "station_id")
    missing = F.lit(fixed.NO_READING)
    return rows.withColumns({
        "temperature_shown": F.col("temperature_shown") != missing,
        "wind_shown": F.col("wind_shown") != missing,
    })


@query
def weather_daily(spark, sf_dir):
    return feeds.weather_daily(_weather_feed(spark, sf_dir), "station_id")


@query
def page_text(spark, sf_dir):
    pages = view(spark, sf_dir, "alert_pages", rebalance=True)
    return pages.select("page_id", text.visible_text(F.col("html")).alias("page_text"))


@query
def alert_extract(spark, sf_dir):
    return feeds.extract_alerts(view(spark, sf_dir, "alert_pages", rebalance=True))


@query
def alert_records(spark, sf_dir):
    alerts = feeds.extract_alerts(view(spark, sf_dir, "alert_pages", rebalance=True))
    records = evidence.build_records(feeds.alert_rows(alerts, FETCHED_AT), FETCHED_AT)
    return records.select(
        "page_id", "pos", "record_id", "event_key", "domain", "title", "summary", "freshness", "confidence"
    )


@query
def raw_json_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(3))).otherwise(F.col("props")).alias("payload"),
    )
    return feeds.raw_json_status(rows, source="Events", label="props", reference="https://example.org/reference")


@query
def raw_json_fields(spark, sf_dir):
    """Two paths read from the raw documents, of which every tenth is damaged."""
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, F.left("props", F.lit(3))).otherwise(F.col("props")).alias("payload"),
    )
    return feeds.raw_fields(rows, {"k": ("$.k", "int"), "k_text": ("$.k", "string"), "absent": ("$.other.deep", "double")}, "payload", "event_id")


@query
def ingest_status(spark, sf_dir):
    """A registry of 21 sources, of which the last has landed nothing."""
    registry = spark.range(21).select(
        F.concat(F.lit("src"), F.col("id").cast("string")).alias("source"),
        F.concat(F.lit("https://example.org/src"), F.col("id").cast("string")).alias("url"),
    )
    rows = view(spark, sf_dir, "evidence_in").select(
        F.col("source_name").alias("source"), F.col("source_url").alias("url")
    )
    return feeds.ingest_status(registry, rows)


# --- streams --------------------------------------------------------------


@query
def stream_evidence_ingest(spark, sf_dir):
    """Records landed as JSON lines three times, each id stored once, as it first came.

    A landing is written and read by many tasks. The later ones hold other figures for ids of the first, and undated records; all
    micro-batches together give what one pass over the landings in order would.
    """
    folder = f"{shared_folder(spark)}/evidence-stream-{uuid.uuid4()}"
    undated = F.when(F.col("seq") % 11 != 0, F.col("observed_at")).otherwise("")
    rows = evidence.build_records(view(spark, sf_dir, "evidence_in", rebalance=True).withColumn("observed_at", undated), FETCHED_AT)
    rows = evidence.first_per_record(rows, "seq")
    parts = [rows.filter("seq % 3 < 2"), rows.filter("seq % 2 = 0"), rows]
    for k, part in enumerate(parts):
        later = part.withColumn("deaths", F.col("deaths") + k).withColumn("summary", F.concat(F.lit(f"{k} "), F.col("summary")))
        later.select(evidence_store.line().alias("value")).write.mode("append").text(f"{folder}/landing/{k}")
        lines = ingest.evidence_lines(spark, f"{folder}/landing/{k}", files_per_batch=100_000)
        ingest.ingest_evidence(lines, f"{folder}/store", f"{folder}/checkpoint{k}", ids_by_day=True).awaitTermination()
    return evidence_store.read_store(spark, f"{folder}/store").select(
        "record_id", "event_key", "source_name", "observed_at", "summary", "deaths", "affected_people"
    )


@query
def stream_bounded_ingest(spark, sf_dir):
    """Four batches, each after a restart: ever later days, repeats with other figures, late and undated records.

    The state answers for the last five days, the table for the rest. Each id is stored once, as
    it first came.
    """
    folder = f"{shared_folder(spark)}/bounded-stream-{uuid.uuid4()}"
    undated = F.when(F.col("seq") % 11 != 0, F.col("observed_at")).otherwise("")
    rows = evidence.build_records(view(spark, sf_dir, "evidence_in", rebalance=True).withColumn("observed_at", undated), FETCHED_AT)
    day = F.substring("observed_at", 9, 2)
    parts = [
        rows.filter((day <= "10") & (F.col("seq") % 3 < 2)),
        rows.filter((day <= "20") & (F.col("seq") % 5 > 0)),
        rows.filter((day <= "04") | (day > "18")),
        rows,
    ]
    for k, part in enumerate(parts):
        later = part.withColumn("summary", F.concat(F.lit(f"{k} "), F.col("summary")))
        later = evidence.first_per_record(later, "seq")
        later.select(evidence_store.line().alias("value")).write.mode("append").text(f"{folder}/landing")
        lines = ingest.evidence_lines(spark, f"{folder}/landing", files_per_batch=100_000)
        ingest.ingest_bounded(lines, f"{folder}/store", f"{folder}/checkpoint", "5 days").awaitTermination()
    return evidence_store.read_store(spark, f"{folder}/store").select(
        "record_id", "event_key", "source_name", "observed_at", "summary", "deaths", "affected_people"
    )


@query
def stream_hazard_unique(spark, sf_dir):
    """Hazards landed twice, in files of any order, kept once."""
    folder = f"{shared_folder(spark)}/hazard-stream-{uuid.uuid4()}"
    feed = _hazard_feed(spark, sf_dir)
    for _ in range(2):
        feed.write.mode("append").json(f"{folder}/landing")
    hazards = ingest.hazard_files(spark, f"{folder}/landing", files_per_batch=1, document_per_file=False)
    ingest.ingest_hazards(hazards, f"{folder}/hazards", f"{folder}/checkpoint").awaitTermination()
    return ingest.read_hazards(spark, f"{folder}/hazards")
