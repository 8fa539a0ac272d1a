"""Evidence in and out: tolerant JSON lines, and the insert-only record table."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from aidlens import schemas
from aidlens.functions import text
from aidlens.operators import evidence
from aidlens.sources.committed import CommittedTable

DAY = "observed_day"
KNOWN = schemas.EVIDENCE_REQUIRED + list(schemas.EVIDENCE_DEFAULTS)


def _names(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def parse_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines (``value``) to records; a line that is no complete record is skipped.

    Skipped are blank and unparsable lines, values that are no object, objects with an unknown
    key and those without a required one. An explicit null is kept. A value of the wrong type
    becomes NULL.
    """
    keys = F.json_object_keys("value")
    whole = text.is_json(F.col("value")) & keys.isNotNull()
    fits = (F.size(F.array_except(_names(schemas.EVIDENCE_REQUIRED), F.col("_keys"))) == 0) & (
        F.size(F.array_except(F.col("_keys"), _names(KNOWN))) == 0
    )
    types = {f.name: f.dataType for f in schemas.EVIDENCE}

    def field(name: str) -> Column:
        value = F.col(f"_r.{name}")
        default = schemas.EVIDENCE_DEFAULTS.get(name)
        if default is None:
            return value.alias(name)
        absent = ~F.array_contains("_keys", name)
        return F.when(absent, F.lit(default).cast(types[name])).otherwise(value).alias(name)

    return (
        lines.filter(text.stripped(F.col("value")) != "")
        .filter(whole)
        .withColumn("_keys", keys)
        .filter(fits)
        .withColumn("_r", F.from_json("value", schemas.EVIDENCE))
        .select(*keep, *[field(n) for n in schemas.EVIDENCE.names])
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON lines path; a path that does not exist holds none."""
    try:
        return parse_lines(spark.read.text(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.EVIDENCE)


def table(spark: SparkSession, path: str) -> CommittedTable:
    """The record table: published batches, partitioned by the day of observation."""
    return CommittedTable(spark, path, StructType([*schemas.EVIDENCE, StructField(DAY, StringType())]), DAY)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The record table; empty and typed before the first append."""
    return table(spark, path).read().select(*schemas.EVIDENCE.names)


def observed_day() -> Column:
    """The day a record was observed, by which the table is partitioned; ``undated`` without one."""
    day = F.regexp_extract("observed_at", r"^\d{4}-\d{2}-\d{2}", 0)
    return F.when(day != "", day).otherwise(F.lit("undated"))


def append_new(batch: DataFrame, path: str, *arrival: str, ids_by_day: bool = False, name: str | None = None) -> int:
    """Append the records the table does not hold yet; returns how many.

    Of several records with one id the first by ``arrival`` (by default the fetch time) counts,
    however late or undated it is. A repeated call adds nothing, also after a run that failed
    half-way; a batch that has a ``name`` is not even read again. One writer at a time.

    Ids made by ``text.record_id`` hash the time of observation, so equal ones share a day:
    with ``ids_by_day`` only the batch's days of the table are read.
    """
    held = table(batch.sparkSession, path)
    known = held.commit(name) if name else None
    if known:
        return known["rows"]
    batch = batch.withColumn(DAY, observed_day())
    store = of_days(held.read(), batch) if ids_by_day else held.read()
    return held.append(evidence.insert_new(batch, store, *(arrival or ("fetched_at",))), name)


def of_days(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The part of the table that holds the days of a batch."""
    days = [r[DAY] for r in batch.select(DAY).distinct().toLocalIterator()]  # days of one batch
    return store.filter(F.col(DAY).isin(days))


def line() -> Column:
    """A record as a JSON line: missing figures as null, ``raw`` as the object it holds."""
    others = F.to_json(F.struct(*[n for n in schemas.EVIDENCE.names if n != "raw"]), {"ignoreNullFields": "false"})
    raw = F.when(text.is_json(F.col("raw")), F.regexp_replace("raw", r"[\r\n]+", " ")).otherwise(F.lit("{}"))
    return F.concat(F.substring(others, F.lit(1), F.length(others) - 1), F.lit(',"raw":'), raw, F.lit("}"))


def append_lines(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, for readers of that format."""
    records.select(line().alias("value")).write.mode("append").text(path)
