"""Benchmark decontamination (7): test items found in documents within an edit budget.

An item of m characters may differ by ``share * m`` edits. Split into one piece more than that,
some piece must occur unchanged (pigeonhole), so exact piece hits name every candidate place,
and Myers' bit-parallel distance settles each. Items are compared in small letters, with each
run of white space as one blank.
"""

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

COLUMNS = "doc_id long, item_id long, distance int, start long, end long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 pieces of nearly equal length, with their places."""
    n, parts = len(item), min(budget + 1, len(item))
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: str) -> dict[str, int]:
    """Per character, the bits of its places in the item."""
    out: dict[str, int] = defaultdict(int)
    for k, c in enumerate(item):
        out[c] |= 1 << k
    return dict(out)


def nearest(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of an item of ``m`` characters to any part of ``text``, and the first end of such a part."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | down
        d = ((((eq & up) + up) ^ up) | eq) & full
        h_up, h_down = down | (full & ~(d | up)), up & d
        if h_up & high:
            score += 1
        elif h_down & high:
            score -= 1
        h_up, h_down = (h_up << 1) & full, (h_down << 1) & full
        up, down = h_down | (full & ~(x | h_up)), h_up & x
        if score < best:
            best, end = score, at + 1
    return best, end


class Matcher:
    """Finds the items of a block of the benchmark in a text."""

    def __init__(self, items: list[tuple[int, str]], share: float):
        import ahocorasick

        self.items = []
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, item in items:
            budget = int(share * len(item))
            for at, piece in pieces(item, budget):
                owners[piece].append((len(self.items), at))
            self.items.append((item_id, item, budget, masks(item), masks(item[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best, then first, match of each item in the normal text."""
        found: dict[int, tuple[int, int, int]] = {}
        settled: set[tuple[int, int]] = set()  # items and cells of starts, whatever order hits come in
        for last, (length, who) in self.automaton.iter(text):
            for k, at in who:
                item_id, item, budget, peq, back = self.items[k]
                start, wide = last + 1 - length - at, budget // 2 + 1
                if found.get(k, (1,))[0] == 0 or (k, start // wide) in settled:
                    continue
                if text.startswith(item, max(start, 0)):
                    found[k] = (0, max(start, 0), max(start, 0) + len(item))
                    continue
                settled.add((k, start // wide))
                first = start // wide * wide
                low = max(0, first - budget)
                window = text[low : first + wide + len(item) + budget]
                distance, end = nearest(peq, len(item), window)
                if distance <= found.get(k, (budget,))[0]:
                    _, length_back = nearest(back, len(item), window[:end][::-1])
                    place = (distance, low + end - length_back, low + end)
                    found[k] = min(found.get(k, place), place)
        return [(self.items[k][0], *f) for k, f in found.items()]


def item_blocks(benchmark: DataFrame, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``most_chars`` characters (one longer item is a block)."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    block, held = [], 0
    for row in rows.filter("text is not null").distinct().orderBy("item_id", "text").toLocalIterator():
        item = normal(row.text)
        if not item:
            continue
        if block and held + len(item) > most_chars:
            yield block
            block, held = [], 0
        block.append((row.item_id, item))
        held += len(item)
    if block:
        yield block


def find(docs: DataFrame, benchmark: DataFrame, share: float = 0.06, most_chars: int = 4_000_000) -> DataFrame:
    """One row for each document and item that it holds: least distance, first such place.

    ``start`` and ``end`` count characters of the normal text. Items go to the tasks in blocks
    of at most ``most_chars`` characters, one pass over the documents each, so what a task holds
    is bounded however long the benchmark is. Null and empty texts and items match nothing.
    Repeated rows match each time; an item id with two texts reports each.
    """
    common.prepare(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def against(items: list[tuple[int, str]]) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, share)
            for batch in batches:
                rows = [(d, *m) for d, t in zip(batch.column("doc_id").to_pylist(), common.texts(batch)) for m in matcher.matches(normal(t))]
                if rows:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "item_id", "distance", "start", "end"])

        return one.mapInArrow(run, COLUMNS)

    found = [against(items) for items in item_blocks(benchmark, most_chars)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], COLUMNS)


def clean(docs: DataFrame, benchmark: DataFrame, share: float = 0.06, most_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns stay, null texts stay.

    Each block of items is one filter in the row, so no text is shuffled.
    """
    import pandas as pd

    common.prepare(docs.sparkSession)
    out = docs
    for items in item_blocks(benchmark, most_chars):
        held = docs.sparkSession.sparkContext.broadcast(items)

        @F.pandas_udf("boolean")
        def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(held.value, share)
            for text in batches:
                yield text.map(lambda t: bool(t) and bool(matcher.matches(normal(t)))).astype(bool)

        out = out.filter(~holds(F.col("text").cast("string")))
    return out
