"""Token counts (1): rollups by source, language and tokenizer version, kept by signed deltas.

A batch of changes becomes signed rows, +1 document for what comes and -1 for what goes, which
are summed into totals. The store has three parts: ``ledger`` holds the signed rows of each
document, from which a deletion or revision takes what it must take back; ``rollup`` holds each
batch's sums; ``commits`` names the batches that count. A batch is written to paths of its own
and named last, so a batch that failed half-way is not seen and is written over by its repeat,
and a batch that is named already is skipped.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aidlens.llm import common, tokens

VERSIONS = ("word_bpe_49k", "byte_bpe_50k")
KEYS = ["source", "lang", "tokenizer"]
SUMS = ["documents", "chars", "tokens"]
_FILES = {"word_bpe_49k": tokens.WORD_BPE, "byte_bpe_50k": tokens.BYTE_BPE}
_LEDGER = "doc_id long, source string, lang string, tokenizer string, documents long, chars long, tokens long"
_ROLLUP = "source string, lang string, tokenizer string, documents long, chars long, tokens long"


def count(docs: DataFrame, versions: tuple[str, ...] = VERSIONS, folder: str | None = None) -> DataFrame:
    """One row for each document and tokenizer version, with its characters and tokens.

    A null text is an empty one: a document with no characters and no tokens. Null ids, sources
    and languages are kept as they are. Repeated rows count each time.
    """
    folder = folder or tokens.folder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(v, tokens.load(f"{folder}/{_FILES[v]}")) for v in versions]
        for batch in batches:
            texts = common.texts(batch)
            chars = pa.array([len(t) for t in texts], pa.int64())
            ones = pa.array([1] * len(texts), pa.int64())
            for version, kind in kinds:
                n = pa.array([kind.count(t) for t in texts], pa.int64())
                name = pa.array([version] * len(texts), pa.string())
                columns = [batch.column(c) for c in ("doc_id", "source", "lang")]
                yield pa.RecordBatch.from_arrays([*columns, name, ones, chars, n], schema=schema)

    schema = pa.schema(
        [("doc_id", pa.int64()), *[(c, pa.string()) for c in ("source", "lang", "tokenizer")], *[(c, pa.int64()) for c in SUMS]]
    )
    common.prepare(docs.sparkSession)
    one = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
    )
    return one.mapInArrow(run, _LEDGER)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _committed(spark: SparkSession, store: str, part: str, schema: str) -> DataFrame:
    rows = _read(spark, f"{store}/{part}", schema + ", batch string")
    return rows.join(_read(spark, f"{store}/commits", "batch string").distinct(), "batch", "left_semi")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def current(spark: SparkSession, store: str) -> DataFrame:
    """What each document adds to the totals now."""
    held = _sums(_committed(spark, store, "ledger", _LEDGER), "doc_id", *KEYS)
    return held.filter(" or ".join(f"{c} <> 0" for c in SUMS))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """Documents, characters and tokens by source, language and tokenizer version."""
    held = _sums(_committed(spark, store, "rollup", _ROLLUP), *KEYS)
    return held.filter(" or ".join(f"{c} <> 0" for c in SUMS)).select(*KEYS, *SUMS)


def commit(
    changes: DataFrame, store: str, batch: str, versions: tuple[str, ...] = VERSIONS, folder: str | None = None
) -> bool:
    """Apply a batch of changes once; False if it was applied before.

    ``changes`` has doc_id, source, lang, text and op: ``insert`` adds the row, ``delete`` takes
    back all that the document added in earlier batches, ``revise`` does both. Deletes and
    revisions of unknown or null ids take nothing back; repeated ones take back once. Rows of any
    other op are refused. ``batch`` must be fit for a folder's name. One writer at a time.
    """
    spark = changes.sparkSession
    if not _read(spark, f"{store}/commits", "batch string").filter(F.col("batch") == batch).isEmpty():
        return False
    op = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(
        F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null"))))
    )
    changes = changes.withColumn("op", op)
    come = count(changes.filter("op <> 'delete'"), versions, folder)
    gone = changes.filter("op <> 'insert'").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    minus = current(spark, store).join(gone, "doc_id", "left_semi")
    minus = minus.select("doc_id", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS])
    write = lambda df, part: df.write.mode("overwrite").parquet(f"{store}/{part}/batch={batch}")
    write(come.unionByName(minus), "ledger")
    ledger = spark.read.schema(_LEDGER).parquet(f"{store}/ledger/batch={batch}")
    write(_sums(ledger, *KEYS), "rollup")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{store}/commits")
    return True
