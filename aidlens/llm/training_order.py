"""Training-order materialisation (2): every sequence gets a slot, shards hold slots in order.

Sequences are pieces of ``stride`` token ids of one document each. They are numbered in the order
of document ids; a keyed Feistel permutation of those numbers, walked until it falls inside the
range, gives the slot. Shards are equal ranges of slots, and each row is a fixed number of bytes,
so slot ``s`` lies in shard ``s // shard_rows`` at place ``s % shard_rows``, and a reader that
stopped at a slot goes on from there.
"""

import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens.llm import common, tokens

_TOKENS = "doc_id long, tie long, n_sequences long, ids binary"
_NUMBERED = "row long, part int, first long, n_sequences long"
_ROWS = "slot long, shard long, doc_id long, piece int, number long, length int, payload binary"
#: The task that wrote a row, from the row's number.
_WRITER = "CAST(shiftright(row, 33) AS int) AS writer"
SHOWN = ["doc_id", "piece", "number", "slot", "shard", "place", "length", "ids_crc32"]


def permuted(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 to n - 1: a balanced Feistel network with cycle-walking."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = common.mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & common.MASK64))

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for k in keys:
            left, right = right, left ^ (common.mixed(right ^ k) & low)
        return (left << half) | right

    out = network(numbers.astype(np.uint64))
    while len(outside := np.flatnonzero(out >= n)):
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def _tokenised(docs: DataFrame, path: str, stride: int, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(path)
        for batch in batches:
            ids = [np.frombuffer(bpe.encode(t), "<u4").astype("<u2").tobytes() + end.to_bytes(2, "little") for t in common.texts(batch)]
            tie = [common.xxhash.xxh3_64_intdigest(b) - (1 << 63) for b in ids]
            n = [-(-len(b) // (2 * stride)) for b in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tie, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "tie", "n_sequences", "ids"]
            )

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, _TOKENS).withColumn("row", F.monotonically_increasing_id())


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done = 0
    for batch in batches:
        n = batch.column("n_sequences").to_numpy()
        first = done + np.cumsum(n) - n
        done += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("part"), pa.array(first, pa.int64()), batch.column("n_sequences")], names=["row", "part", "first", "n_sequences"]
        )


def materialise(
    docs: DataFrame, store: str, key: int, stride: int = 512, shard_rows: int = 16_384, folder: str | None = None, end: int = 0
) -> DataFrame:
    """Write all sequences of ``docs`` to ``store`` in training order; returns the written rows.

    A document's ids are followed by ``end``; a null or empty text is that id alone. Documents
    are numbered by id, nulls first, and equal ids by their tokens, so the order depends on the
    content and the key and not on files or partitions; rows that are wholly equal are alike.
    Ids take two bytes, and the last piece is filled up with zeros to the stride. An empty table
    gives no shards.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "order")
    path = f"{folder or tokens.folder()}/{tokens.WORD_BPE}"
    name = f"order_{uuid.uuid4().hex}"
    _bucketed(_tokenised(docs, path, stride, end), f"{scratch.folder}/tokens", name)
    try:
        held = spark.table(name)
        # numbers: small rows are ranged by id and summed inside ranges; ranges are summed over
        ranged = held.select("doc_id", "tie", "row", "n_sequences").repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        numbered = ranged.select("row", F.spark_partition_id().alias("part"), "n_sequences").mapInArrow(_running, _NUMBERED)
        numbered = scratch.table(numbered, "numbers")
        parts = numbered.groupBy("part").agg(F.sum("n_sequences").alias("n"))  # one row a partition
        before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
        parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
        total = numbered.agg(F.sum("n_sequences")).first()[0] or 0
        firsts = numbered.join(parts, "part").selectExpr(_WRITER, "row", "before + first AS first")
        with _buckets_stay(spark):
            joined = held.select("writer", "row", "doc_id", "ids").join(firsts.hint("shuffle_hash"), ["writer", "row"])
            _write_shards(joined.mapInArrow(_cutter(total, key, stride, shard_rows), _ROWS), store, total, shard_rows)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return read(spark, store, shard_rows=shard_rows)


def _bucketed(held: DataFrame, path: str, name: str) -> None:
    """Write token rows where they were made, as a table bucketed by the task that wrote them.

    Each task's rows are one bucket, so nothing is moved, and the numbers, which are small, come
    to the ids by task and row. The table lies at ``path``; only its name is in the catalog.
    """
    buckets = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held.selectExpr("*", _WRITER).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "writer").saveAsTable(name)


@contextmanager
def _buckets_stay(spark: SparkSession) -> Iterator[None]:
    """Let a join on more columns than a table is bucketed by keep the table's buckets."""
    setting = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def _write_shards(rows: DataFrame, store: str, total: int, shard_rows: int) -> None:
    shards = max(1, -(-total // shard_rows))
    (
        rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
        .write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(store)
    )


def _cutter(total: int, key: int, stride: int, shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                yield from cut(batch.slice(at, 1000))

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, width = batch.column("ids").to_pylist(), 2 * stride
        n = np.array([-(-len(b) // width) for b in ids], np.int64)
        if not len(n):
            return
        of = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        number = np.repeat(batch.column("first").to_numpy(), n) + piece
        slot = permuted(number, total, key)
        payload = [ids[d][p * width : (p + 1) * width] for d, p in zip(of.tolist(), piece.tolist())]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(slot), pa.array(slot // shard_rows), batch.column("doc_id").take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(number),
                pa.array([len(b) // 2 for b in payload], pa.int32()), pa.array([b.ljust(width, b"\0") for b in payload], pa.binary()),
            ],
            names=["slot", "shard", "doc_id", "piece", "number", "length", "payload"],
        )

    return run


def read(spark: SparkSession, store: str, start: int = 0, stop: int | None = None, shard_rows: int = 16_384) -> DataFrame:
    """The sequences of slots from ``start`` up to ``stop``; only their shards are read."""
    rows = spark.read.schema(_ROWS).parquet(store).withColumn("place", F.col("slot") % shard_rows)
    if start:
        rows = rows.filter((F.col("shard") >= start // shard_rows) & (F.col("slot") >= start))
    if stop is not None:
        rows = rows.filter((F.col("shard") <= (stop - 1) // shard_rows) & (F.col("slot") < stop))
    return rows


def described(rows: DataFrame) -> DataFrame:
    """Sequences without their ids, but with the ids' CRC-32."""
    ids = F.substring("payload", F.lit(1), F.col("length") * 2)
    return rows.withColumn("ids_crc32", F.crc32(ids)).select(*SHOWN)


def decoded(payload: bytes, length: int) -> np.ndarray:
    """The ids of a written row."""
    return np.frombuffer(payload, "<u2", length)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u2").tobytes())
