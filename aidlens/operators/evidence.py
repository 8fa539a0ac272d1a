"""Evidence records: identity, insert-if-absent, provenance and context."""

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from aidlens import fixed, schemas
from aidlens.functions import text
from aidlens.session import prepare, shared_folder, written

# Most hits whose records a task holds at a time, and fewest that make a task of their own.
BUCKET_HITS, TASK_HITS = 65_536, 4_096
# Tasks a core where there are hits enough.
TASKS = 4
# Compressed bytes of a piece of a record's texts, as many pieces are sent together, and bytes of contexts that are given out together.
PIECE_BYTES, GIVEN_BYTES = 2048, 8 << 20


def build_records(rows: DataFrame, fetched_at: str) -> DataFrame:
    """Complete rows to records: both keys, lower-case domain, fetch time, defaults.

    ``fetched_at`` is the run's own parameter, so a repeated run gives the same rows. Columns
    beyond the record schema (an arrival number, say) stay in front.
    """
    keyed = rows.withColumn("event_key", text.event_key(F.col("domain"), F.col("title"), F.col("location")))
    keyed = keyed.withColumns({
        "record_id": text.record_id(F.col("event_key"), F.col("source_name"), F.col("observed_at")),
        "fetched_at": F.lit(fetched_at),
        "domain": F.lower("domain"),
    })
    types = {f.name: f.dataType for f in schemas.EVIDENCE}
    present = set(keyed.columns)
    defaults = {
        name: F.lit(value).cast(types[name])
        for name, value in schemas.EVIDENCE_DEFAULTS.items()
        if name not in present
    }
    extra = [c for c in rows.columns if c not in types]
    return keyed.withColumns(defaults).select(*extra, *schemas.EVIDENCE.names)


def first_per_record(batch: DataFrame, *arrival: str) -> DataFrame:
    """The first record of each id, by arrival; equal arrivals are settled by content.

    The rank filter is applied inside every input partition before the shuffle, so an id with a
    huge number of copies sends one row per partition.
    """
    first = W.partitionBy("record_id").orderBy(*arrival, F.xxhash64(*batch.columns))
    return batch.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def insert_new(batch: DataFrame, store: DataFrame, *arrival: str) -> DataFrame:
    """The records of a batch the store does not hold yet, one per id."""
    known = store.select("record_id").distinct()
    return first_per_record(batch, *arrival).join(known, "record_id", "left_anti").select(*batch.columns)


def merged(batch: DataFrame, store: DataFrame, *arrival: str) -> DataFrame:
    """The store after the insert."""
    return store.unionByName(insert_new(batch, store, *arrival))


def provenance(evidence: DataFrame) -> DataFrame:
    """What must accompany every incident shown; unknown figures say so and are never zero."""
    figures = {c: text.display_value(F.col(c)) for c in schemas.EVIDENCE_FIGURES}
    return evidence.select(
        "record_id", "event_key", "title", "location", "source_name", "source_url", "source_tier",
        "observed_at", "fetched_at", "freshness", "confidence",
        F.when(F.col("source_tier") == fixed.PRIMARY_TIER, F.lit("official"))
        .otherwise(F.lit("corroborating")).alias("verification_state"),
        *[v.alias(k) for k, v in figures.items()],
    )


CONTEXT_FIELDS = {
    "event": "title",
    "domain": "domain",
    "location": "location",
    "summary": "summary",
    "source": "source_name",
    "source_url": "source_url",
    "observed_at": "observed_at",
    "affected_people": "affected_people",
    "deaths": "deaths",
    "confidence": "confidence",
}


def _listed(hits: DataFrame, keys: list[str]) -> DataFrame:
    """A row a question: its hits in rank order; at most its search limit."""
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "seq"))).alias("_found"))


def _pieces(records: DataFrame) -> DataFrame:
    """The texts of (seq, texts) rows, compressed, in pieces of a bounded size."""
    most = PIECE_BYTES
    schema = "seq string, piece int, records int, size long, text binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some, out = batch.slice(at, 100), []
                for seq, texts in zip(some.column("seq").to_pylist(), some.column("texts").cast(pa.list_(pa.binary())).to_pylist()):
                    joined = b",".join(texts)
                    packed = codec.compress(joined, asbytes=True)
                    out += [(seq, k // most, len(texts), len(joined), packed[k : k + most]) for k in range(0, len(packed), most)]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names=["seq", "piece", "records", "size", "text"])

    return records.mapInArrow(run, schema)


def _contexts(rows: DataFrame, hits: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the records that ``_found`` names as a JSON array, and their number; null for none.

    Few records are found by many questions, so their texts are not moved to the rows: those that
    were found are written once, compressed, rows are dealt into buckets of a bounded number of
    hits, and every bucket reads those texts and keeps what its hits name.
    """
    spark = rows.sparkSession
    prepare(spark)
    folder = f"{shared_folder(spark)}/contexts-{uuid.uuid4().hex}"
    asked = written(rows, f"{folder}/asked", tidy=True)
    found = written(asked.select(F.explode("_found.seq").alias("seq")).distinct(), f"{folder}/found", tidy=True)
    fields = [F.col(source).alias(name) for name, source in CONTEXT_FIELDS.items()]
    told = records.join(found, "seq", "left_semi").groupBy("seq").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("records")
    )
    texts = F.transform("records", lambda r: F.to_json(r, {"ignoreNullFields": "false"})).alias("texts")
    pieces = written(_pieces(told.select(F.col("seq").cast("string").alias("seq"), texts)), f"{folder}/texts", tidy=True)
    # the row that a bucket's own rows come with, also where no record was found
    own = spark.range(0, 1, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pieces.schema])

    n = asked.agg(F.sum(F.greatest(F.size("_found"), F.lit(1)))).first()[0] or 0
    buckets = max(1, -(-n // BUCKET_HITS), min(-(-n // TASK_HITS), TASKS * spark.sparkContext.defaultParallelism))
    kept = [c for c in rows.columns if c != "_found"]
    seqs = F.coalesce(F.transform("_found", lambda r: r["seq"].cast("string")), F.array().cast("array<string>"))
    dealt = asked.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int").alias("_bucket"),
        F.struct(seqs.alias("seqs"), F.struct(*kept).alias("row")).alias("one"),
    )
    packed = dealt.repartitionById(buckets, "_bucket").groupBy("_bucket").agg(F.collect_list("one").alias("_asked"))
    out = StructType([*[rows.schema[c] for c in kept], StructField("context", StringType()), StructField("matches", IntegerType())])
    most = GIVEN_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, early = {}, []  # by bucket: its rows, the records of each, and what is known of those; a task has one bucket
        for batch in batches:
            numbers = batch.column("_bucket").to_numpy()
            for i in np.flatnonzero(batch.column("seq").is_null().to_numpy(zero_copy_only=False)).tolist():
                ones = batch.column("_asked").slice(i, 1).flatten()
                seqs, row = ones.take(pa.array(np.arange(len(ones)))).flatten()
                seqs = seqs.to_pylist()
                held[int(numbers[i])] = row, seqs, {s: [] for some in seqs for s in some}
            early.append(batch)
            while early and held.keys() >= set(early[-1].column("_bucket").to_numpy().tolist()):
                kept(early.pop(), held)
        for row, seqs, known in held.values():
            yield from given(row, seqs, known)

    def kept(batch: pa.RecordBatch, held: dict[int, tuple]) -> None:
        numbers, seqs = batch.column("_bucket").to_pylist(), batch.column("seq").to_pylist()
        own = [k for k, s in enumerate(seqs) if s in held[numbers[k]][2]]
        for k, *piece in zip(own, *(batch.column(c).take(pa.array(own, pa.int64())).to_pylist() for c in ("piece", "records", "size", "text"))):
            held[numbers[k]][2][seqs[k]].append(piece)

    def given(row: pa.StructArray, seqs: list[list[str]], known: dict[str, list[list]]) -> Iterator[pa.RecordBatch]:
        codec, texts, numbers, size, columns = pa.Codec("zstd"), [], [], 0, row.flatten()
        for at, some in enumerate(seqs, 1):
            here = [sorted(known[s]) for s in some if known[s]]
            each = [codec.decompress(b"".join(p[-1] for p in pieces), pieces[0][2], asbytes=True) for pieces in here]
            texts.append(b"[%b]" % b",".join(each) if here else None)
            numbers.append(sum(pieces[0][1] for pieces in here) or None)
            size += sum(map(len, each))
            if size >= most or at == len(seqs) or len(texts) == 10_000:
                first = at - len(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(texts)) for c in columns), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int32())], names=out.names
                )
                texts, numbers, size = [], [], 0

    # each bucket is a task that reads all pieces one after the other; its rows meet their own row alone, as a pair is a copy of both
    light = F.explode(F.array("_asked", F.lit(None))).alias("_asked")
    pairs = own.unionByName(pieces).coalesce(1).hint("shuffle_replicate_nl").crossJoin(packed.select("_bucket", light))
    met = pairs.filter(F.col("seq").isNull() != F.col("_asked").isNull())
    return met.select(*pieces.columns, "_bucket", "_asked").mapInArrow(run, out)


def context(hits: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The hits of each question as one JSON array in rank order, missing figures as null.

    A question has at most its search limit of hits, so the array is small.
    """
    return _contexts(_listed(hits, keys), hits, records, keys).filter("matches IS NOT NULL")


def with_context(rows: DataFrame, hits: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the ``context`` and ``matches`` of its question, null where there is no hit.

    The hits come to the rows before their texts do, so that no context is moved.
    """
    return _contexts(rows.join(_listed(hits, keys), keys, "left"), hits, records, keys)


def question_evidence(questions: DataFrame, contexts: DataFrame, keys: list[str]) -> DataFrame:
    """Every question with its evidence context, or the note that there is none."""
    return noted(questions.select(*keys).join(contexts, keys, "left"), keys)


def noted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``with_context`` with the note in place of a context that is missing."""
    return rows.select(
        *keys,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("context", F.lit(fixed.NO_MATCH)).alias("context"),
    )
