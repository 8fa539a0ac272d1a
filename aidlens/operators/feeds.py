"""Landed feeds to tables: hazards, reports, weather, places, alerts, raw JSON, status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens import fixed
from aidlens.functions import text

# --- hazards --------------------------------------------------------------


def utc_from_millis(millis: Column) -> Column:
    """Epoch milliseconds as a UTC timestamp without zone, whatever the session's zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", millis, epoch)


def normalize_hazards(feed: DataFrame, *keep: str) -> DataFrame:
    """Feature collections to one row per hazard; absent parts take their defaults."""
    one = feed.select(*keep, F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return one.select(
        *keep,
        F.col("f.id").alias("event_id"),
        F.lit(fixed.HAZARD_NAME).alias("hazard"),
        F.coalesce("f.properties.title", F.lit(fixed.HAZARD_NAME)).alias("title"),
        F.coalesce("f.properties.place", F.lit(fixed.HAZARD_NO_PLACE)).alias("place"),
        F.coalesce("f.properties.mag", F.lit(0.0)).alias("severity"),
        utc_from_millis(F.col("f.properties.time")).alias("time"),
        F.get(at, F.lit(1)).alias("latitude"),
        F.get(at, F.lit(0)).alias("longitude"),
        F.get(at, F.lit(2)).alias("depth_km"),
        F.col("f.properties.url").alias("url"),
        F.lit(fixed.HAZARD_SOURCE).alias("source"),
    )


def strong_hazards(hazards: DataFrame, as_of: str, days: int = 7, minimum: float = 4.5) -> DataFrame:
    """All hazards of at least ``minimum`` in the last ``days`` before ``as_of``."""
    end = F.lit(as_of).cast("timestamp_ntz")
    start = end - F.make_interval(days=F.lit(days))
    return hazards.filter((F.col("time") >= start) & (F.col("time") <= end) & (F.col("severity") >= minimum))


def recent_hazards(
    hazards: DataFrame, as_of: str, days: int = 7, minimum: float = 4.5, rows: int = 500
) -> DataFrame:
    """The newest ``rows`` of the strong hazards, for a list; answers count all of them."""
    return strong_hazards(hazards, as_of, days, minimum).orderBy(F.desc("time"), "event_id").limit(rows)


def hazard_peak(hazards: DataFrame) -> DataFrame:
    """Count, highest severity and its place, of equal ones that of the least id, text or number.

    No hazards: 0 and NULL, shown as not available. An unknown severity is below all others.
    """
    return hazards.agg(
        F.count("*").alias("events"),
        F.max("severity").alias("peak_severity"),
        F.min_by("place", F.struct(F.col("severity").isNull(), -F.col("severity"), F.col("event_id"))).alias("peak_place"),
    )


def id_bucket(buckets: int) -> Column:
    """The bucket of the stored hazards that an id belongs to; a null id is one id."""
    return F.pmod(F.xxhash64(F.col("event_id").cast("string")), F.lit(buckets)).cast("int")


def insert_new_hazards(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The hazards of a batch that the store does not hold, one per event id; null ids are one id."""
    first = W.partitionBy("event_id").orderBy(F.xxhash64(*batch.columns))
    new = batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").alias("b")
    known = store.select("event_id").distinct().alias("s")
    return new.join(known, F.col("b.event_id").eqNullSafe(F.col("s.event_id")), "left_anti")


# --- humanitarian reports -------------------------------------------------


def normalize_reports(feed: DataFrame, *keep: str) -> DataFrame:
    one = feed.select(*keep, F.explode("data.fields").alias("f"))

    def first_name(names: str, default: str) -> Column:
        # an empty list means the default, an unnamed first entry stays NULL
        array = F.col(names)
        return F.when(F.coalesce(F.size(array), F.lit(0)) > 0, F.get(array, F.lit(0))["name"]).otherwise(default)

    return one.select(
        *keep,
        F.coalesce("f.title", F.lit(fixed.REPORT_TITLE)).alias("title"),
        first_name("f.primary_country", fixed.REPORT_COUNTRY).alias("country"),
        first_name("f.source", fixed.REPORT_SOURCE).alias("source"),
        F.col("f.date.created").alias("created"),
        F.col("f.url").alias("url"),
    )


def latest_reports(reports: DataFrame, rows: int = 20) -> DataFrame:
    """Newest first; the address settles ties."""
    return reports.orderBy(F.desc("created"), "url").limit(rows)


# --- places ---------------------------------------------------------------


def place_name(name: Column) -> Column:
    return F.lower(text.stripped(name))


def gazetteer_lookup(lookups: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each distinct lookup with its first match or none; blank lookups never match.

    The lookups are reduced to distinct ones first, so a place asked for by a third of all rows
    costs one row. The gazetteer is reduced to its first entry per name.
    """
    first = W.partitionBy("place_key").orderBy("place_id")
    places = (
        gazetteer.withColumn("place_key", place_name(F.col("label")))
        .filter("place_key <> ''")
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("place_key", F.col("label").alias("display_name"), "latitude", "longitude")
    )
    return (
        lookups.select("query").distinct()
        .withColumn("place_key", place_name(F.col("query")))
        .join(places, "place_key", "left")
        .select(
            "query", "display_name", "latitude", "longitude",
            F.when(F.col("display_name").isNotNull(), F.lit(fixed.GAZETTEER_SOURCE)).alias("source"),
        )
    )


def normalize_geocode(feed: DataFrame, query: str = "query") -> DataFrame:
    """Geocoder payloads to one row per query: the first feature, or NULLs without one."""
    best = F.get("features", F.lit(0))
    asked = F.trim(query) != ""
    at = best["geometry"]["coordinates"]
    return feed.select(
        F.col(query).alias("query"),
        F.when(asked & best.isNotNull(), F.coalesce(best["properties"]["label"], F.col(query))).alias("display_name"),
        F.when(asked, F.get(at, F.lit(1))).alias("latitude"),
        F.when(asked, F.get(at, F.lit(0))).alias("longitude"),
        F.when(asked & best.isNotNull(), F.coalesce(best["properties"]["geocoding"], F.lit("{}"))).alias("geocoding"),
        F.when(asked & best.isNotNull(), F.lit(fixed.GAZETTEER_SOURCE)).alias("source"),
    )


# --- weather --------------------------------------------------------------


def shown_reading(reading: Column) -> Column:
    return F.coalesce(reading.cast("string"), F.lit(fixed.NO_READING))


def weather_current(feed: DataFrame, *keep: str) -> DataFrame:
    """Current readings, with a dash as the shown value where one is absent."""
    return feed.select(
        *keep, "current.*",
        shown_reading(F.col("current.temperature_2m")).alias("temperature_shown"),
        shown_reading(F.col("current.wind_speed_10m")).alias("wind_shown"),
    )


def weather_daily(feed: DataFrame, *keep: str) -> DataFrame:
    """The parallel daily arrays as one row per day."""
    fields = ["time", "precipitation_sum", "wind_gusts_10m_max", "temperature_2m_max"]
    days = F.arrays_zip(*[F.col(f"daily.{f}") for f in fields])
    return feed.select(*keep, F.posexplode(days).alias("day", "d")).select(
        *keep, "day", *[F.col(f"d.{f}") for f in fields]
    )


# --- alerts ---------------------------------------------------------------


def extract_alerts(pages: DataFrame, limit: int = fixed.ALERT_LIMIT) -> DataFrame:
    """Labelled alerts of each page: the first ``limit`` matches, repeats of a detail removed.

    Everything happens inside the row, so no page ever meets another and nothing is shuffled.
    """
    page_text = text.visible_text(F.col("html"))
    pattern = F.lit(fixed.ALERT_PATTERN)
    clean = lambda d: F.btrim(F.regexp_replace(d, r"\s+", " "), F.lit(" -:"))
    labels = F.regexp_extract_all("_text", pattern, F.lit(1))
    details = F.transform(F.regexp_extract_all("_text", pattern, F.lit(2)), clean)
    first = F.filter(
        F.arrays_zip(F.slice("_labels", 1, limit).alias("label"), F.slice("_details", 1, limit).alias("detail"),
                     F.sequence(F.lit(0), F.lit(limit - 1)).alias("pos")),
        lambda a: a["detail"].isNotNull() & (F.array_position("_details", a["detail"]) == a["pos"] + 1),
    )
    return (
        pages.withColumn("_text", page_text)
        .withColumns({"_labels": labels, "_details": details})
        .select("page_id", F.inline(first))
        .select("page_id", "pos", "label", "detail")
    )


def alert_rows(alerts: DataFrame, observed_at: str) -> DataFrame:
    """Alerts in the shape ``evidence.build_records`` completes. The fetch time is the
    observation time, as the page carries none."""
    return alerts.select(
        "page_id", "pos",
        F.col("label").alias("domain"),
        F.concat(F.lit("SACHET "), F.col("label"), F.lit(" alert")).alias("title"),
        F.col("detail").alias("summary"),
        F.col("detail").alias("location"),
        F.lit(fixed.ALERT_COUNTRY).alias("country"),
        F.lit(fixed.ALERT_SOURCE).alias("source_name"),
        F.lit(fixed.ALERT_URL).alias("source_url"),
        F.lit(fixed.ALERT_TIER).alias("source_tier"),
        F.lit(observed_at).alias("observed_at"),
        F.lit(fixed.ALERT_FRESHNESS).alias("freshness"),
        F.lit(fixed.ALERT_CONFIDENCE).alias("confidence"),
    )


# --- raw JSON and status --------------------------------------------------


def raw_json_status(
    payloads: DataFrame, payload: str = "payload", source: str | None = None, label: str | None = None, reference: str | None = None
) -> DataFrame:
    """Keeps the raw text where it parses and tells whether it did.

    ``source`` and ``label`` name the feed on every row, ``reference`` its documentation on rows
    that parse; each is a column only where it is given.
    """
    parses = text.is_json(F.col(payload))
    named = {"source": source, "label": label}
    told = {k: F.lit(v) for k, v in named.items() if v is not None}
    if reference is not None:
        told["reference"] = F.when(parses, F.lit(reference))
    return payloads.withColumns({
        "status": F.when(parses, "ok").otherwise("unavailable"),
        payload: F.when(parses, F.col(payload)),
        **told,
    })


def raw_fields(payloads: DataFrame, paths: dict[str, tuple[str, str]], payload: str = "payload", *keep: str) -> DataFrame:
    """Typed columns out of documents of any shape: name -> (path, type).

    A document is parsed once, as a variant. NULL stands for text that does not parse, for a path
    that is not there and for a value of another type.
    """
    parsed = payloads.select(*keep, F.try_parse_json(payload).alias("_v"))
    return parsed.select(*keep, *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in paths.items()])


def raw_shape(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row: the schema that all documents together have, and how many do not parse."""
    parsed = payloads.select(F.try_parse_json(payload).alias("_v"))
    return parsed.agg(F.schema_of_variant_agg("_v").alias("shape"), F.count_if(F.col("_v").isNull()).alias("unparsable"))


def ingest_status(registry: DataFrame, landed: DataFrame) -> DataFrame:
    """Every registered source with its record count; a source without any is unavailable."""
    counts = landed.groupBy("source", "url").agg(F.count("*").alias("records"))
    return registry.join(counts, ["source", "url"], "left").select(
        "source", "url",
        F.when(F.col("records").isNull(), "unavailable").otherwise("ok").alias("status"),
        F.coalesce("records", F.lit(0).cast("bigint")).alias("records"),
    )
