"""Landed feed files: one JSON document or one page per file."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aidlens import schemas
from aidlens.functions import text
from aidlens.operators import feeds
from aidlens.sources.committed import Files


def read_documents(spark: SparkSession, path: str, schema: StructType, root: str, per_line: bool = False) -> DataFrame:
    """All landed documents, good and damaged: file, bytes, landed, raw, reason, and the fields of ``schema``.

    A document is a file, or with ``per_line`` a line. ``reason`` is NULL where it is good, else
    ``empty``, ``unparsable``, or ``foreign`` for one without the field ``root``; its fields are
    then NULL and ``raw`` holds its text. ``path`` is a folder; folders below it named ``source=…`` give a column ``source``.
    """
    text_of = spark.read.text(path, wholetext=not per_line)
    kept = [c for c in text_of.columns if c != "value"]
    lands = {"file": "file_path", "bytes": "file_size", "landed": "file_modification_time"}
    rows = text_of.select("*", *[F.col(f"_metadata.{field}").alias(name) for name, field in lands.items()])
    # a file without a byte is an empty document, which the scan does not show
    none = spark.createDataFrame(Files(spark, path).empty(path), "file string, millis long")
    folders = [F.regexp_extract("file", rf"/{c}=([^/]+)/", 1).cast(text_of.schema[c].dataType).alias(c) for c in kept]
    rows = rows.unionByName(none.select(
        F.lit("").alias("value"), *folders, "file", F.lit(0).cast("long").alias("bytes"), F.timestamp_millis("millis").alias("landed")
    ))
    keys = F.json_object_keys("value")
    reason = (
        F.when(text.stripped(F.col("value")) == "", "empty")
        .when(~text.is_json(F.col("value")), "unparsable")
        .when(~F.coalesce(F.array_contains(keys, root), F.lit(False)), "foreign")
    )
    rows = rows.withColumn("reason", reason)
    parsed = rows.withColumn("_d", F.when(F.col("reason").isNull(), F.from_json("value", schema)))
    return parsed.select(*kept, *lands, F.when(F.col("reason").isNotNull(), F.col("value")).alias("raw"), "reason", "_d.*")


def landed_status(registry: DataFrame, documents: DataFrame) -> DataFrame:
    """Every registered source with what landed of it: documents, empty and damaged ones, bytes, last time.

    A source of which no good document landed is unavailable. Each file's size counts once.
    """
    files = documents.groupBy("source", "file").agg(
        F.max("bytes").alias("bytes"), F.max("landed").alias("landed"), F.count_if(F.col("reason").isNull()).alias("documents"),
        F.count_if(F.col("reason") == "empty").alias("empty"), F.count_if(F.col("reason").isin("unparsable", "foreign")).alias("damaged"),
    )
    sums = files.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("documents", "empty", "damaged", "bytes")], F.max("landed").alias("landed"))
    counts = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("documents", "empty", "damaged", "bytes")}
    return registry.join(sums, "source", "left").withColumns(counts).withColumn(
        "status", F.when(F.col("documents") > 0, "ok").otherwise("unavailable")
    )


def read_hazards(spark: SparkSession, path: str) -> DataFrame:
    feed = spark.read.schema(schemas.HAZARD_FEED).option("multiLine", True).json(path)
    return feeds.normalize_hazards(feed)


def read_reports(spark: SparkSession, path: str | None) -> DataFrame:
    """Reports of landed files; a fetch that landed nothing gives an empty, typed table."""
    if path is None:
        return spark.createDataFrame([], schemas.REPORTS)
    feed = spark.read.schema(schemas.REPORT_FEED).option("multiLine", True).json(path)
    return feeds.normalize_reports(feed)


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather documents with the file they came from."""
    feed = spark.read.schema(schemas.WEATHER_FEED).option("multiLine", True).json(path)
    return feed.withColumn("station", F.input_file_name())


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed HTML pages, whole, named by their file."""
    page = spark.read.text(path, wholetext=True)
    return page.select(F.input_file_name().alias("page_id"), F.col("value").alias("html"))


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents of any shape, kept raw, with their status."""
    raw = spark.read.text(path, wholetext=True)
    return feeds.raw_json_status(
        raw.select(F.input_file_name().alias("url"), F.col("value").alias("payload"))
    )
