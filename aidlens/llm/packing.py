"""Best-fit packing (6): best-fit inside partitions, then in a tree of merges.

Each partition packs its pieces best-fit, largest first, and emits the bins that are nearly
full. The others go on as items of their fill to the next round, in which a task holds at most
``group_items`` of them, until one task held all or a round brought no gain. Only their places
travel, never tokens.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common, tokens

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long, closed boolean"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; largest first, tightest bin first."""
    bin_of, offset, fill = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room for r
    order = np.argsort(-sizes, kind="stable")
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fitting = open_rooms >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += s
        r -= s
        if r:
            if not room[r]:
                open_rooms |= 1 << r
            room[r].append(b)
    return bin_of, offset, np.array(fill, np.int64)


def pieces(docs: DataFrame, capacity: int = 2048, folder: str | None = None, end: int = 0) -> DataFrame:
    """Each document's token ids and ``end``, cut into pieces of at most ``capacity``.

    A null or empty text is one piece, the end alone. Null ids and repeated rows stay.
    """
    path = f"{folder or tokens.folder()}/{tokens.WORD_BPE}"
    last = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                ids = bpe.encode(text) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(zip(*rows))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    common.prepare(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, _PIECES)


def _placed(rows: pd.DataFrame, capacity: int, nearly: int, base: int) -> pd.DataFrame:
    """Pack rows that have a bin and an offset each; bins go as they are."""
    old, inverse = np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)
    fill = np.zeros(len(old), np.int64)
    np.add.at(fill, inverse, rows["length"].to_numpy())
    bin_of, offset, filled = best_fit(fill, capacity)
    return rows.assign(
        sequence_id=base + bin_of[inverse],
        offset=rows["offset"].to_numpy() + offset[inverse],
        closed=(capacity - filled[bin_of[inverse]]) <= nearly,
    )


def pack(docs: DataFrame, capacity: int = 2048, nearly: int = 16, group_items: int = 200_000, gain: float = 0.02, folder: str | None = None) -> DataFrame:
    """Places of all pieces of all documents in sequences of at most ``capacity`` tokens.

    A bin with at most ``nearly`` tokens of room is emitted at once. Rounds end when one task
    held all remaining bins, or when a round lessened their number by less than ``gain``. An
    empty table gives no rows.
    """
    scratch = common.Scratch(docs.sparkSession, "pack")
    bound = 1 << 28  # bins of a task; a task's number goes above them, the round above both

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, used = [], TaskContext.get().partitionId(), 0
        for batch in batches:
            held.append(batch.to_pandas())
            if sum(map(len, held)) >= group_items:
                done, used = local(held, part, used)
                yield done
                held = []
        if held:
            yield local(held, part, used)[0]

    def local(held: list[pd.DataFrame], part: int, used: int) -> tuple[pa.RecordBatch, int]:
        rows = pd.concat(held, ignore_index=True)
        rows = rows.assign(sequence_id=np.arange(len(rows)), offset=np.int64(0))
        out = _placed(rows, capacity, nearly, part * bound + used)
        names = [*COLUMNS, "closed"]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]
        columns = [pa.array(out[c], t, from_pandas=True) for c, t in zip(names, types)]
        return pa.RecordBatch.from_arrays(columns, names=names), used + int(out["sequence_id"].nunique())

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _placed(rows.drop(columns="task"), capacity, nearly, (key[0] >> 32 << 56) + (key[0] & 0xFFFFFFFF) * bound)

    placed = scratch.table(pieces(docs, capacity, folder), "pieces").mapInArrow(first, _PLACED)
    placed = scratch.table(placed, "round0")
    done, level = placed.filter("closed"), 0
    bins = lambda df: df.filter("not closed").agg(F.count_if(F.col("offset") == 0)).first()[0]
    left = bins(placed)
    while left:
        level += 1
        tasks = -(-left // group_items)
        task = F.pmod(F.xxhash64("sequence_id"), F.lit(tasks)) + F.lit(level << 32)
        opened = placed.filter("not closed").withColumn("task", task)
        placed = scratch.table(opened.groupBy("task").applyInPandas(merge, _PLACED), f"round{level}")
        now = bins(placed)
        last = tasks == 1 or now > left * (1 - gain)
        done = done.unionByName(placed if last else placed.filter("closed"))
        left = 0 if last else now
    return done.select(*COLUMNS)
