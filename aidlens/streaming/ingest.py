"""Structured Streaming jobs over landed files.

All jobs take the folder of their checkpoint from the caller, or from ``spark.checkpoint.dir``.
"""

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aidlens import schemas
from aidlens.operators import evidence, feeds
from aidlens.session import shared_folder, written
from aidlens.sources import evidence_store
from aidlens.sources.committed import CommittedTable

BUCKET = "id_bucket"
# Where a line came from: the order in which equal ids arrived.
ARRIVAL = {"_file_time": "file_modification_time", "_file": "file_path", "_block": "file_block_start"}


def _start(writer, name: str, spark: SparkSession, checkpoint: str | None, every: str | None) -> StreamingQuery:
    folder = checkpoint or f"{shared_folder(spark)}/stream-{name}"
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.option("checkpointLocation", folder).trigger(**trigger).start()


def evidence_lines(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """Records from JSON lines files as they land, each with the file's time, path and block."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing)
    place = [F.col(f"_metadata.{field}").alias(name) for name, field in ARRIVAL.items()]
    return evidence_store.parse_lines(lines.select("value", *place), *ARRIVAL)


def ingest_evidence(
    records: DataFrame, store: str, checkpoint: str | None = None, every: str | None = None, ids_by_day: bool = False
) -> StreamingQuery:
    """Insert-if-absent into the record table, over its whole history.

    Of several records with one id the first line of the first file stays. Late and undated
    records count like others, as each append is an anti-join against what the table holds; for
    the same reason a batch that is replayed after a failure adds nothing twice. There is no
    state beside the table: with ``ids_by_day`` a batch reads only the days it has records of.
    One writer per table.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("_line", F.monotonically_increasing_id())
        arrival = [c for c in ARRIVAL if c in batch.columns]
        evidence_store.append_new(numbered, store, *arrival, "_line", ids_by_day=ids_by_day)

    return _start(records.writeStream.foreachBatch(append), "evidence", records.sparkSession, checkpoint, every)


def ingest_bounded(
    records: DataFrame, store: str, checkpoint: str, delay: str = "7 days", every: str | None = None
) -> StreamingQuery:
    """Insert-if-absent that reads the table only for records the stream's state cannot answer for.

    Ids whose time of observation is above the watermark (the latest time seen less ``delay``)
    are kept as state, in RocksDB: equal ids have equal times, so of such a record the state
    knows whether it came before, and it is appended without a look at the table. Records beyond
    the watermark, undated ones, and those not later than what the table held when the
    checkpoint began are compared with the table's days they belong to. So no record is dropped,
    and the state is bounded by ``delay``. A date far in the future lifts the watermark above
    all others; then all are compared with the table.

    Of several records with one id the first line of the first file stays. Batches are published
    under their number, so one that is run again after a failure adds nothing. One writer per
    table and checkpoint.
    """
    spark = records.sparkSession
    writer = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    timed = records.withColumn("_at", F.try_to_timestamp("observed_at"))
    # the state needs ids and times alone, so nothing else of a record is moved to it
    ids = timed.filter("_at IS NOT NULL").select("record_id", "_at")
    kept = ids.withWatermark("_at", delay).dropDuplicates(["record_id", "_at"])
    # the state's answer goes beside all rows: it drops what is beyond the watermark, they do not
    both = timed.withColumn("_new", F.lit(False)).unionByName(
        kept.select("record_id", F.lit(True).alias("_new")), allowMissingColumns=True
    )

    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        table = evidence_store.table(session, store)
        name = f"{writer}-{batch_id}"
        # one evaluation of the state, written for all that follows; a batch that runs again needs it too
        staged = f"{store.rstrip('/')}/staged/{name}.{uuid.uuid4().hex}"
        rows = written(batch.withColumn("_line", F.monotonically_increasing_id()), staged)
        if table.commit(name):
            table.files.remove(staged)
            return
        before = table.commit(f"{writer}-{batch_id - 1}") if batch_id else None
        notes = json.loads(before["notes"]) if before else {"floor": _last_day(table), "latest": None}
        arrival = [*[c for c in ARRIVAL if c in rows.columns], "_line"]
        new = rows.filter("_new").select("record_id").distinct().withColumn("_fresh", F.lit(True))
        rows = rows.filter("NOT _new").withColumn(evidence_store.DAY, evidence_store.observed_day())
        below = F.lit(notes["latest"]).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        unsure = F.col("_at").isNull() | F.coalesce(F.col("_at") <= below, F.lit(False)) | (
            F.coalesce(F.to_date("_at") <= F.lit(notes["floor"]).cast("date"), F.lit(False))
        )
        held = evidence_store.of_days(table.read(), rows.filter(unsure)).select("record_id").distinct().withColumn("_held", F.lit(True))
        # whole records are dealt by their id once; what the state and the table answer comes to them
        first = evidence.first_per_record(rows, *arrival).join(new, "record_id", "left").join(held, "record_id", "left")
        absent = first.filter(F.when(unsure, F.col("_held").isNull()).otherwise(F.col("_fresh").isNotNull()))
        latest = rows.select(F.greatest(F.max("_at"), F.lit(notes["latest"]).cast("timestamp")).cast("string")).first()[0]
        table.append(absent, name, json.dumps({**notes, "latest": latest}))
        table.files.remove(staged)

    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query keeps the provider it was first started with
        return _start(both.writeStream.foreachBatch(append), "bounded", spark, checkpoint, every)
    finally:
        spark.conf.set(provider, old)


def _last_day(table: CommittedTable) -> str | None:
    """The greatest dated day that a table holds; read from the names of its folders."""
    return table.read().filter(f"{evidence_store.DAY} <> 'undated'").agg(F.max(evidence_store.DAY)).first()[0]


def hazard_files(
    spark: SparkSession, landing: str, files_per_batch: int = 1000, document_per_file: bool = True
) -> DataFrame:
    """Hazards from feature collections as they land, one per file or one per line."""
    feed = (
        spark.readStream.schema(schemas.HAZARD_FEED)
        .option("multiLine", document_per_file)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )
    return feeds.normalize_hazards(feed)


def ingest_hazards(
    hazards: DataFrame, store: str, checkpoint: str | None = None, every: str | None = None, buckets: int = 256
) -> StreamingQuery:
    """Insert-if-absent of hazards by event id, over all that is stored.

    However late a hazard comes, it is stored once, and the result does not depend on the order
    of the files. Equal ids within a batch keep the row of least content. Ids tell no day, so the
    table is partitioned by ``buckets`` of their hash, and a batch reads the ids of the buckets
    it has hazards of, and no other column. One writer per table, always with the same number.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn(BUCKET, feeds.id_bucket(buckets))
        new = feeds.insert_new_hazards(batch, hazards_like(batch, store))
        # one file a bucket and batch
        new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(store)

    return _start(hazards.writeStream.foreachBatch(append), "hazards", hazards.sparkSession, checkpoint, every)


def hazards_like(batch: DataFrame, store: str) -> DataFrame:
    """The stored hazards of the buckets that a batch touches, at most as many as there are."""
    touched = [r[BUCKET] for r in batch.select(BUCKET).distinct().toLocalIterator()]
    try:
        stored = batch.sparkSession.read.schema(batch.schema).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return batch.limit(0)
    return stored.filter(F.col(BUCKET).isin(touched))


def read_hazards(spark: SparkSession, store: str) -> DataFrame:
    """The stored hazards without their bucket."""
    return spark.read.parquet(store).drop(BUCKET)
