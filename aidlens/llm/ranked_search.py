"""Ranked lexical search (12): hashed max-sketches bound a document's score, exact scores follow.

A document's sketch folds the impacts of all its terms into the greatest one at each coordinate
of a hash. An impact rises with the number of times that its term occurs, so the sketch keeps
the greatest of these numbers, and the same sketch gives the greatest impacts whatever the
lengths and numbers of all documents are: an index can be appended to. A batch of documents is
looked up at the coordinates of all asked terms at once, which gives an upper bound of each
document's score for each item. Documents are scored exactly in descending order of their
bounds until the bound is below an item's last place.

Every task keeps the best of its own documents; the best of all are taken by rank. Terms are
known by 64 bits of their hash.
"""

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens.llm import common

#: Coordinates of a sketch; those that no term falls on are not written.
WIDTH = 1 << 16
#: A number of times that is not exceeded by any; it bounds every impact.
MOST = (1 << 16) - 1
TOP = 1_000_000
INDEX = "doc_id long, n long, terms array<long>, times array<int>, places array<int>, most array<int>"
FOUND = "item int, doc_id long, score long"
#: Rows of a batch of looked-up documents.
_ROWS = 1024

#: ASCII letters and digits and all other bytes above 0x7F are parts of terms; A-Z in small letters.
_SIGNS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_SIGNS).split()


def impacts(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term that occurs so many times adds for each unit of its weight."""
    return (1_000_000_000 * times) // (1000 * times + 12 * m)


def build(docs: DataFrame) -> DataFrame:
    """The index rows of documents: number of terms, different terms with counts, and the sketch.

    A text that is null or has no term makes no row. Rows with equal or null ids stay rows of
    their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes(100_000)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                yield from indexed(batch.slice(at, _ROWS), hashes)

    def indexed(batch: pa.RecordBatch, hashes: common.WordHashes) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
            counts = Counter(terms(text))
            if not counts:
                continue
            keys = hashes.of(list(counts))
            times = np.fromiter(counts.values(), np.int64, len(counts))
            spots = (keys >> np.uint64(48)).astype(np.int64)
            order = np.argsort(spots, kind="stable")
            places, starts = np.unique(spots[order], return_index=True)
            most = np.minimum(np.maximum.reduceat(times[order], starts), MOST)
            rows.append((doc, int(times.sum()), common.signed(keys), times, places, most))
        if rows:
            yield _index_rows(rows)

    common.prepare(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, INDEX)


def _index_rows(rows: list[tuple]) -> pa.RecordBatch:
    doc, n, *lists = zip(*rows)
    arrays = [pa.array(doc, pa.int64()), pa.array(n, pa.int64())]
    for values, kind in zip(lists, (pa.int64(), pa.int32(), pa.int32(), pa.int32())):
        ends = np.cumsum([0, *map(len, values)])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind)))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "terms", "times", "places", "most"])


class Block:
    """Items that are searched together: their terms, and how often each item has each."""

    def __init__(self, items: list[list[bytes]]):
        counts = [Counter(xxhash.xxh3_64_intdigest(t) for t in item) for item in items]
        self.terms = np.unique(np.array(sorted(set().union(*counts)), np.uint64).view(np.int64))
        self.items = []
        for count in counts:
            keys = np.array(list(count), np.uint64).view(np.int64)
            self.items.append((np.searchsorted(self.terms, keys), np.array(list(count.values()), np.int64)))
        self.places = (self.terms.view(np.uint64) >> np.uint64(48)).astype(np.int64)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``keys`` are asked terms, and their numbers."""
        at = np.minimum(np.searchsorted(self.terms, keys), len(self.terms) - 1)
        held = np.flatnonzero(self.terms[at] == keys)
        return held, at[held]

    def weights(self, df: np.ndarray, docs: int) -> np.ndarray:
        """An asked term's weight in each item, a row a term, for document counts ``df``."""
        w = [math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df]
        out = np.zeros((len(self.terms), len(self.items)), np.float64)
        for k, (which, times) in enumerate(self.items):
            out[which, k] = np.array(w, np.int64)[which] * times
        if len(out) and float(out.sum(axis=0).max()) * TOP >= 2.0**53:
            raise ValueError("an item has too many terms for exact sums")
        return out


def item_blocks(items: DataFrame, most_terms: int, most_items: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Items (their ids, their terms) in blocks of bounded size; one longer item is a block."""
    ids, block, held = [], [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        asked = terms(row.text)
        if not asked:
            continue
        if block and (held + len(asked) > most_terms or len(block) == most_items):
            yield ids, block
            ids, block, held = [], [], 0
        ids.append(row.item_id)
        block.append(asked)
        held += len(asked)
    if block:
        yield ids, block


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy()


def _rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """The row of each value of a list column."""
    return np.repeat(np.arange(batch.num_rows), batch.column(column).value_lengths().to_numpy())


def document_counts(index: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each asked term occurs."""
    held = index.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        total = np.zeros(len(asked.terms), np.int64)
        for batch in batches:
            total += np.bincount(asked.found(_flat(batch, "terms"))[1], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(len(block.terms), np.int64)
    # as many rows as the block has asked terms
    for row in index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row.term] = row.df
    return df


class Searcher:
    """Scores batches of index rows against a block of items, and keeps each item's best."""

    def __init__(self, block: Block, weights: np.ndarray, docs: int, all_terms: int, limit: int):
        self.block, self.docs, self.all_terms, self.limit = block, docs, all_terms, limit
        self.weights = weights
        self.spots, spot = np.unique(block.places, return_inverse=True)
        self.at = np.full(WIDTH, -1, np.int32)
        self.at[self.spots] = np.arange(len(self.spots), dtype=np.int32)
        self.folded = np.zeros((len(self.spots), weights.shape[1]))
        np.add.at(self.folded, spot, weights)
        self.best: list[list[tuple[int, int, int | None]]] = [[] for _ in block.items]  # (-score, id or MOST, id)
        self.rescored = 0

    def bounds(self, batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
        """An upper bound of each row's score for each item."""
        places, most = _flat(batch, "places"), _flat(batch, "most").astype(np.int64)
        spot = self.at[places]
        held = np.flatnonzero(spot >= 0)
        rows = _rows_of(batch, "places")[held]
        high = np.where(most[held] >= MOST, TOP, impacts(most[held], m[rows]))
        looked_up = np.zeros((batch.num_rows, len(self.spots)))
        looked_up[rows, spot[held]] = high
        return looked_up @ self.folded

    def add(self, batch: pa.RecordBatch) -> None:
        m = 75 + (25 * batch.column("n").to_numpy() * self.docs) // self.all_terms
        bounds = self.bounds(batch, m)
        floor = np.array([-b[-1][0] if len(b) == self.limit else 1 for b in self.best], np.float64)
        wanted = bounds >= floor
        if not wanted.any():
            return
        ids = batch.column("doc_id").to_pylist()
        some = np.flatnonzero(wanted.any(axis=1))
        exact = self._impacts(batch, m, some)
        row_of = np.full(batch.num_rows, -1)
        row_of[some] = np.arange(len(some))
        for item in np.flatnonzero(wanted.any(axis=0)).tolist():
            rows = np.flatnonzero(wanted[:, item])
            rows = rows[np.argsort(-bounds[rows, item], kind="stable")]
            which = self.block.items[item][0]
            weights, best = self.weights[which, item], self.best[item]
            for low in range(0, len(rows), 32):
                part = rows[low : low + 32]
                if len(best) == self.limit and bounds[part[0], item] < -best[-1][0]:
                    break
                scores = exact[np.ix_(row_of[part], which)] @ weights
                self.rescored += len(part)
                new = [(-int(s), (ids[r] is None, ids[r] or 0), ids[r]) for r, s in zip(part.tolist(), scores.tolist()) if s > 0]
                best[:] = sorted([*best, *new], key=lambda b: b[:2])[: self.limit]

    def _impacts(self, batch: pa.RecordBatch, m: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The impacts of the asked terms in some rows."""
        part = batch.take(pa.array(rows))
        held, term = self.block.found(_flat(part, "terms"))
        row = _rows_of(part, "terms")[held]
        out = np.zeros((len(rows), len(self.block.terms)))
        out[row, term] = impacts(_flat(part, "times")[held].astype(np.int64), m[rows][row])
        return out


def _searched(index: DataFrame, block: Block, docs: int, all_terms: int, limit: int) -> DataFrame:
    """(item, doc_id, score): the best rows of each task for each item of a block."""
    held = index.sparkSession.sparkContext.broadcast((block, block.weights(document_counts(index, block), docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*held.value, docs, all_terms, limit)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                searcher.add(batch.slice(at, _ROWS))
        rows = [(item, doc, -score) for item, best in enumerate(searcher.best) for score, _, doc in best]
        if rows:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "doc_id", "score"])

    return index.mapInArrow(run, FOUND)


def search(index: DataFrame, items: DataFrame, limit: int = 20, most_terms: int = 60_000, most_items: int = 500) -> DataFrame:
    """The best ``limit`` documents of each row of ``items``: item_id, rank, doc_id, score.

    ``index`` is a written table of ``build``. Only scores above 0 count; equal scores go by
    ascending doc_id, null last. An item without a term finds nothing; each row of a repeated
    item_id is an item of its own. Items are searched in blocks of at most ``most_terms`` terms
    and ``most_items`` rows, which bounds what a task is sent; each block reads the index twice.
    """
    spark = index.sparkSession
    common.prepare(spark)
    docs, all_terms = index.agg(F.count("*"), F.sum("n")).first()
    first = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = []
    for ids, asked in item_blocks(items, most_terms, most_items) if docs else ():
        found = _searched(index, Block(asked), docs, all_terms, limit)
        named = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
        ranked = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
        out.append(ranked.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
