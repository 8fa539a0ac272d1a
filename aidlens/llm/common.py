"""What the operators share: written intermediate tables, words, hashes, sorted runs."""

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from aidlens.session import prepare, shared_folder

#: Words are runs of anything but the space and the ASCII white space 0x09 to 0x0D.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MASK64 = (1 << 64) - 1


class Scratch:
    """Intermediate tables of one run, in a folder of its own under the shared folder.

    They are written once and read back, which cuts the lineage: what an executor held can be
    lost and nothing before the table is computed again. The folder may be removed when the
    results that were derived from it have been written.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def small_words(text: str) -> list[bytes]:
    """The words of a text with A-Z in small letters, in UTF-8.

    ``bytes`` lowers and splits by ASCII alone, which is what the definition of a word says.
    """
    return text.encode("utf-8", "surrogatepass").lower().split()


class WordHashes(dict):
    """64-bit hashes of words; the first ``keep`` different words are remembered."""

    def __init__(self, keep: int = 300_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.keep:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each window of ``width`` values, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n] + np.uint64(1))
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; a null text counts as an empty one."""
    return [t or "" for t in batch.column(column).to_pylist()]


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches cut into tables that hold whole groups of equal ``keys``.

    A group may span batches; whatever follows the last key change waits for the next batch.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        starts = group_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut).combine_chunks()
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where each group of equal non-null integer ``keys`` begins; the first is 0."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)
