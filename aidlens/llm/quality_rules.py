"""Quality rules (4): rule statistics of each text, judged by an isolation forest.

The forest isolates a row by random splits of its statistics; rows that take few splits are
unusual. Each tree grows on random rows of all labelled ones, the threshold comes from the scores
of all of them, and every document is scored.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens.llm import common

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What the forest sees: by word, those that begin with no letter, symbols, those in capitals and
#: in small letters; repeated lines by line with a word; repeated words by word; characters by
#: word; the logarithm of the words. Symbols and characters by word are cut at 3 and 60, so that
#: one odd text does not stretch the range that splits are drawn from.
FEATURES = ["bare", "symbols", "upper", "lower", "dup_lines", "repeat_words", "word_length", "log_words"]


def rule_stats(text: str) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the features of FEATURES of a whole text."""
    words = common.WORD.findall(text)
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if common.WORD.search(line)]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    per = max(n, 1)
    features = [
        sum(not w[0].isalpha() for w in words) / per, min(n_symbols / per, 3.0),
        sum(map(str.isupper, words)) / per, sum(map(str.islower, words)) / per,
        n_dup / max(len(lines), 1), n_repeat / per, min(word_chars / per, 60.0), float(np.log1p(n)),
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    seen = list(zip(*[words[k:] for k in range(width)]))
    if len(set(seen)) == len(seen):
        return 0
    times: dict[tuple, int] = {}
    for w in seen:
        times[w] = times.get(w, 0) + 1
    total = until = 0
    for at, w in enumerate(seen):
        if times[w] > 1:
            total += at + width - max(at, until)
            until = at + width
    return total


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Forest:
    """Isolation trees as arrays: feature (or -1 in a leaf), split, children, path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    unit: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length), near 1 for what is isolated soon."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= split[node]
                node = np.where(inner, left[node] + right, node)
            total += path[node]
        return np.exp2(-total / len(self.feature) / self.unit)


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary search tree of ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def drawn(n: int, trees: int, rows: int, seed: int) -> np.ndarray:
    """The numbers of the random rows of each tree, of ``n``."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(n, min(rows, n), replace=False) for _ in range(trees)])


def grow(x: np.ndarray, trees: int, rows: int, seed: int, draws: np.ndarray | None = None) -> Forest:
    """A forest of ``trees`` trees, each over ``rows`` random rows of ``x``, or those that ``draws`` names."""
    draws = drawn(len(x), trees, rows, seed) if draws is None else draws
    rng, rows = np.random.default_rng([seed, 1]), draws.shape[1]
    limit, size = int(np.ceil(np.log2(max(rows, 2)))), 2 * rows + 1
    feature, left = np.full((trees, size), -1), np.zeros((trees, size), np.int64)
    split, path = np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        todo, used = [(0, x[draws[t]], 0)], 1
        while todo:
            node, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            wide = np.flatnonzero(high > low)
            if depth >= limit or len(part) < 2 or not len(wide):
                path[t, node] = depth + expected_path(len(part))
                continue
            f = rng.choice(wide)
            at = rng.uniform(low[f], high[f])
            right = part[:, f] >= at
            if not right.any() or right.all():
                at = high[f]
                right = part[:, f] >= at
            feature[t, node], split[t, node], left[t, node] = f, at, used
            todo += [(used, part[~right], depth + 1), (used + 1, part[right], depth + 1)]
            used += 2
    return Forest(feature, split, left, path, max(expected_path(rows), 1e-9))


def calibrated(scores: np.ndarray, good: np.ndarray, spare: float) -> float:
    """The score above which a row goes: most bad rows, at most the share ``spare`` of good ones."""
    if not good.any() or good.all():
        return float(np.inf)
    cuts = np.unique(scores)
    g, b = np.sort(scores[good]), np.sort(scores[~good])
    lost = 1 - np.searchsorted(g, cuts, "right") / len(g)
    caught = 1 - np.searchsorted(b, cuts, "right") / len(b)
    fit = np.where(lost <= spare, caught - lost, -1)
    best = int(fit.argmax())
    after = cuts[best + 1] if best + 1 < len(cuts) else cuts[best] + 1
    return float((cuts[best] + after) / 2) if fit[best] > 0 else float(np.inf)


#: Scores are parted by this many bounds to be counted.
_BINS = 65_536


def threshold(scored: DataFrame, spare: float) -> float:
    """``calibrated`` over the rows (score, good) of a table of any size.

    Rows are counted by score; sums up to a score are those of its bin, and of the bins before,
    of which the driver has one row each.
    """
    counts = scored.groupBy("score").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    counts = counts.withColumn("bin", F.floor(F.col("score") * _BINS).cast("long"))
    bins = counts.groupBy("bin").agg(F.sum("g").alias("g"), F.sum("b").alias("b")).toPandas().sort_values("bin")
    goods, bads = int(bins["g"].sum()), int(bins["b"].sum())
    if not goods or not bads:
        return float(np.inf)
    before = pd.DataFrame({"bin": bins["bin"], "g0": bins["g"].cumsum() - bins["g"], "b0": bins["b"].cumsum() - bins["b"]})
    upto = W.partitionBy("bin").orderBy("score")
    sums = counts.join(scored.sparkSession.createDataFrame(before, "bin long, g0 long, b0 long"), "bin").select(
        "score", (F.col("g0") + F.sum("g").over(upto)).alias("g"), (F.col("b0") + F.sum("b").over(upto)).alias("b")
    )
    lost, caught = F.lit(1.0) - F.col("g") / F.lit(goods), F.lit(1.0) - F.col("b") / F.lit(bads)
    cuts = sums.select("score", F.when(lost <= spare, caught - lost).otherwise(F.lit(-1.0)).alias("fit"))
    best = cuts.agg(F.max(F.struct("fit", -F.col("score")))).first()[0]
    if best[0] <= 0:
        return float(np.inf)
    cut = -best[1]
    after = counts.filter(F.col("score") > cut).agg(F.min("score")).first()[0]
    return float((cut + (cut + 1 if after is None else after)) / 2)


def fit(
    docs: DataFrame, labels: DataFrame, sample: int | None = None, trees: int = 200, rows: int = 256, spare: float = 0.005, seed: int = 4
) -> Forest | None:
    """Forest and threshold from all labelled documents; None without any.

    One row of each id counts, so that copies neither add rows nor weight. A tree's rows are drawn
    by their numbers in the order of ids, so they do not depend on partitions; ``trees`` times
    ``rows`` rows come to the driver at most. Rows that the base rules reject take no part in the
    threshold. Without good or without bad rows nothing but the base rules rejects. A caller may
    ask for the labelled ids of the ``sample`` smallest hashes alone.
    """
    scratch = common.Scratch(docs.sparkSession, "quality")
    chosen = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    if sample is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # of the rows of one id that of the least text hash
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    rows_of = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id", "quality").agg(one)
    known = scratch.table(measured(rows_of.select("doc_id", "quality", "one.text"), None, "quality").select("doc_id", "_features", "quality", "base_failed"), "measured")
    # numbers in the order of ids: those within a part of the sorted rows, after the rows of the parts before
    known = scratch.table(known.orderBy("doc_id").withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    sizes = known.groupBy(part.alias("part")).count().toPandas().sort_values("part")
    n = int(sizes["count"].sum())
    if not n:
        return None
    draws = drawn(n, trees, rows, seed)
    number = np.unique(draws)
    of = np.searchsorted(np.cumsum(sizes["count"].to_numpy()), number, "right")
    at = (sizes["part"].to_numpy(np.int64)[of] << 33) + number - (np.cumsum(sizes["count"].to_numpy()) - sizes["count"].to_numpy())[of]
    wanted = docs.sparkSession.createDataFrame(pd.DataFrame({"_at": at}), "_at long")
    got = known.join(wanted, "_at").select("_at", "_features").toPandas().sort_values("_at")
    forest = grow(np.array(got["_features"].tolist()), trees, rows, seed, np.searchsorted(number, draws))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("_features").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(forest.score(x)), batch.column("good")], names=["score", "good"])

    passed = known.filter("not base_failed").select("_features", (F.col("quality") > 0).alias("good"))
    forest.threshold = threshold(scratch.table(passed.mapInArrow(scores, "score double, good boolean"), "scores"), spare)
    return forest


def measured(docs: DataFrame, forest: Forest | None, *keep: str) -> DataFrame:
    """Statistics, base rule, score and verdict of each row; ``keep`` columns go along.

    A null or empty text has no words and fails the base rule. Null ids and repeated rows stay.
    """
    fields = [docs.select(k).schema[0] for k in ("doc_id", *keep)]
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out += "".join(f", {c} long" for c in COUNTS) + ", base_failed boolean, _features array<double>, anomaly double, kept boolean"
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = [rule_stats(t) for t in common.texts(batch)]
            counts, x = np.array([s[0] for s in stats], np.int64), np.array([s[1] for s in stats])
            failed = np.array([base_failed(c[0], c[4]) for c in counts.tolist()])
            score = forest.score(x) if forest else np.zeros(len(x))
            kept = ~failed & ((score <= forest.threshold) if forest else True)
            columns = [batch.column(f.name) for f in fields]
            columns += [pa.array(c) for c in counts.T]
            columns += [pa.array(failed), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(score), pa.array(kept)]
            names = [*[f.name for f in fields], *COUNTS, "base_failed", "_features", "anomaly", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(*[f.name for f in fields], "text").mapInArrow(run, out)


def kept_rows(docs: DataFrame, forest: Forest | None) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; decided in the row, without a shuffle."""
    common.prepare(docs.sparkSession)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        stats = [rule_stats(t or "") for t in text]
        failed = np.array([base_failed(c[0], c[4]) for c, _ in stats], bool)
        unusual = forest.score(np.array([x for _, x in stats])) > forest.threshold if forest and len(stats) else np.zeros(len(stats), bool)
        return pd.Series(~failed & ~unusual)

    return docs.filter(passes(F.col("text").cast("string")))
