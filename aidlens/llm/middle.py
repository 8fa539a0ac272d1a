"""Fill-in-middle transformation (11): cuts found by a Fenwick tree over blocks of the text.

A text is laid out in blocks of fixed size. A Fenwick tree holds, for each block, how many units
and how many code points begin in it. The block of a cut is found by a descent that halves its
step each time (binary lifting), and the cut itself inside that block alone. A unit is a code
point, or what a pattern matches.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


class Fenwick:
    """Prefix sums of several counts a block, as a binary indexed tree."""

    def __init__(self, counts: np.ndarray):
        """``counts`` has a row for each count and a column for each block."""
        self.size = counts.shape[1]
        self.top = 1 << self.size.bit_length() >> 1
        sums = np.concatenate([np.zeros((len(counts), 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        at = np.arange(self.size + 1)
        self.nodes = (sums - sums[:, at - (at & -at)]).tolist()  # each node sums the blocks of its lowest bit

    def descend(self, wanted: int) -> tuple[int, list[int]]:
        """The block that holds unit number ``wanted`` (from 0), and all counts of the blocks before it."""
        block, before, step = 0, [0] * len(self.nodes), self.top
        while step:
            to = block + step
            if to <= self.size and before[0] + self.nodes[0][to] <= wanted:
                before = [b + node[to] for b, node in zip(before, self.nodes)]
                block = to
            step >>= 1
        return block, before


class Cutter:
    """Units of one text, in UTF-8, and the places between them."""

    def __init__(self, text: str, unit: re.Pattern | None = None, block: int = 4096):
        """``unit`` matches units from left to right; a code point that it leaves out is a unit too."""
        self.text, self.data, self.unit, self.block = text, text.encode("utf-8", "surrogatepass"), unit, block
        raw = np.frombuffer(self.data, np.uint8)
        self.begins = (raw & 0xC0) != 0x80
        edges = np.arange(0, max(len(raw), 1), block)
        points = np.add.reduceat(self.begins, edges, dtype=np.int64) if len(raw) else np.zeros(1, np.int64)
        units = points
        if unit is not None:
            starts = np.fromiter(self._starts(), np.int64)
            places = np.flatnonzero(self.begins)[starts]
            units = np.bincount(places // block, minlength=len(edges))
            self.first = np.append(starts, len(text))[np.searchsorted(places, edges)]
        self.n, self.points = int(units.sum()), int(points.sum())
        self.tree = Fenwick(np.stack([units, points]))

    def _starts(self, at: int = 0) -> Iterator[int]:
        """The first code points of the units from place ``at`` on, where one begins."""
        while at < len(self.text):
            m = self.unit.search(self.text, at)
            found = m is not None and m.end() > m.start()
            stop = m.start() if found else len(self.text)
            yield from range(at, stop)
            if found:
                yield stop
            at = m.end() if found else stop

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points before unit number ``units``; the whole text for its number of units."""
        if units >= self.n:
            return len(self.data), self.points
        block, (before, points) = self.tree.descend(units)
        low = block * self.block
        place = points + units - before  # where units are code points
        if self.unit is not None:
            place = next(islice(self._starts(int(self.first[block])), units - before, None))
        return low + int(np.flatnonzero(self.begins[low : low + self.block])[place - points]), place


def choices(doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from a document's id; a null id counts as no digits."""
    digest = hashlib.sha256(b"1:%s" % (b"" if doc_id is None else str(doc_id).encode())).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transformed(text: str, doc_id: int | None, plain: int = 90, spm: int = 20, unit: re.Pattern | None = None) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    cutter = Cutter(text, unit)
    h1, h2, h3, h4 = choices(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain:
        return cutter.n, "plain", None, None, text
    ends = sorted((h1 % (cutter.n + 1), h2 % (cutter.n + 1)))
    (a, chars_a), (b, chars_b) = map(cutter.cut, ends)
    prefix, middle, suffix = (part.decode("utf-8", "surrogatepass") for part in (cutter.data[:a], cutter.data[a:b], cutter.data[b:]))
    if h4 % 100 < spm:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return cutter.n, form, chars_a, chars_b - chars_a, output


def restored(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, plain: int = 90, spm: int = 20, unit: str | None = None) -> DataFrame:
    """``docs``'s doc_id with the transformed text, and the text rebuilt from it alone.

    ``n`` counts units. Of 100 ids ``plain`` are transformed (else the form is plain), of 100 of
    those ``spm`` with the suffix first. A text is plain if it is empty (a null is) or holds a
    sentinel. Rows with equal ids are cut at the same shares of their texts; the draws of a null
    id are those of no digits.
    """
    pattern = re.compile(unit) if unit else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), common.texts(batch)):
                row = transformed(text, doc, plain, spm, pattern)
                rows.append((doc, *row, restored(row[4], row[1])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    common.prepare(docs.sparkSession)
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, f"doc_id long, {COLUMNS}")
