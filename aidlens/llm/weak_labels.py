"""Quality classifier (10): labels from overlapping heuristics, and a hashed linear scorer.

Labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts
of vote patterns estimates how often each labeller is right about either class; the posterior
of its pattern labels a document. A linear scorer of hashed words and word shapes is trained on
those labels, and scores every document, whether any labeller spoke or not.
"""

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common
from aidlens.llm.quality_rules import SYMBOLS

LABELLERS = ["symbols", "bare", "capitals", "shouts", "stutter", "prose", "sentences"]
GOOD, NONE, BAD = 1, 0, -1


def votes(text: str, words: list[str]) -> list[int]:
    """One vote of each of LABELLERS, by shares per word.

    Five know one defect each and say nothing where it is absent; two know running prose, by its
    plain words and by its stops, and say bad where hardly any is seen. None votes on no words.
    """
    n = len(words)
    if not n:
        return [NONE] * len(LABELLERS)
    symbols = sum(map(text.count, SYMBOLS)) / n
    bare = sum(not w[0].isalpha() for w in words) / n
    capitals = sum(map(str.isupper, words)) / n
    stutter = sum(map(str.__eq__, words, words[1:])) / n
    stops = (text.count(",") + text.count(".")) / n
    plain = 1 - bare - capitals
    varied = stutter < 0.25 and symbols < 0.25
    defect = lambda share, most: BAD if share >= most else NONE
    return [
        defect(symbols, 0.25),
        defect(bare, 0.35),
        defect(capitals, 0.5),
        defect(text.count("!") / n, 0.25),
        defect(stutter, 0.25),
        GOOD if plain >= 0.7 and varied else BAD if plain < 0.5 else NONE,
        GOOD if stops <= 1 and symbols < 0.05 and varied else BAD if symbols > 1 else NONE,
    ]


@dataclass
class LabelModel:
    """Prior of a good document, and of each labeller and class the chance of each vote."""

    prior: float
    chance: np.ndarray  # labeller, class (0 bad, 1 good), vote + 1

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Chance of good for rows of votes."""
        log = np.log([1 - self.prior, self.prior])[None, :].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            log = log + np.log(self.chance[k][:, patterns[:, k] + 1]).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, the chance that a vote is right, given one."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.chance[:, 0, 0] + share[1] * self.chance[:, 1, 2]
        spoken = (share[None, :] * (1 - self.chance[:, :, 1])).sum(1)
        return right / np.maximum(spoken, 1e-12)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 50, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts.

    It starts from the share of bad among the votes of a pattern, any bad vote weighing for bad,
    which ties the first class to bad votes.
    """
    m = patterns.shape[1]
    good = np.where((patterns == BAD).any(1), 0.1, np.where((patterns == GOOD).any(1), 0.9, 0.5))
    model = LabelModel(0.5, np.full((m, 2, 3), 1 / 3))
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = float(np.clip((weight[1].sum() + smooth) / (counts.sum() + 2 * smooth), 1e-3, 1 - 1e-3))
        chance = np.empty((m, 2, 3))
        for k, c in itertools.product(range(m), range(2)):
            held = np.bincount(patterns[:, k] + 1, weight[c], 3) + smooth
            chance[k, c] = held / held.sum()
        model = LabelModel(prior, chance)
        now = model.posterior(patterns)
        if np.abs(now - good).max() < 1e-6:
            break
        good = now
    return model


# --- scorer -----------------------------------------------------------------


def _shape(word: str) -> str:
    """The word's kinds of character, runs as one: Aa, a, A, 9, and signs as they are."""
    if word.isalpha() or (word[-1] in ".," and word[:-1].isalpha()):
        sign = "" if word.isalpha() else word[-1]
        if word.islower():
            return "a" + sign
        if len(word) > 1 + len(sign) and word[0].isupper() and word[1:].islower():
            return "Aa" + sign
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in word[:40]]
    return "".join(k for k, _ in itertools.groupby(kinds))


class Hashed(dict):
    """Buckets of a word: its small letters and its shape."""

    def __init__(self, buckets: int, keep: int = 200_000):
        super().__init__()
        self.buckets, self.keep = buckets, keep

    def __missing__(self, word: str) -> tuple[int, int]:
        code = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % (self.buckets - 2) + 2
        value = code("w:" + word.lower()), code("s:" + _shape(word))
        if len(self) < self.keep:
            self[word] = value
        return value


@dataclass
class Scorer:
    """Weights by bucket: 0 is the constant, 1 the share of words equal to the one before."""

    weights: np.ndarray
    hashed: Hashed = field(init=False, repr=False)
    worth: "Worth" = field(init=False, repr=False)

    def __post_init__(self):
        self.hashed = Hashed(len(self.weights))
        self.worth = Worth(self)

    def __reduce__(self):
        return Scorer, (self.weights,)

    def vector(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets and values: the mean over words, of length 1 or less each part."""
        n = max(len(words), 1)
        codes = np.fromiter(itertools.chain.from_iterable(map(self.hashed.__getitem__, words)), np.int64, 2 * len(words))
        at, times = np.unique(codes, return_counts=True)
        same = sum(map(str.__eq__, words, words[1:])) / n
        return np.concatenate([[0, 1], at]), np.concatenate([[1.0, same], times / n])

    def score(self, words: list[str]) -> float:
        """The weights' sum over the document's vector, word by word."""
        n = max(len(words), 1)
        same = sum(map(str.__eq__, words, words[1:])) / n
        return float(self.weights[0] + self.weights[1] * same + sum(map(self.worth.__getitem__, words)) / n)


class Worth(dict):
    """What a word adds to the score; the first words met are remembered."""

    def __init__(self, scorer: Scorer):
        super().__init__()
        self.weights, self.hashed = scorer.weights, Hashed(len(scorer.weights), 0)

    def __missing__(self, word: str) -> float:
        a, b = self.hashed[word]
        value = float(self.weights[a] + self.weights[b])
        if len(self) < 300_000:
            self[word] = value
        return value


def train(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, buckets: int, epochs: int = 12, step: float = 0.5, l2: float = 1e-6, seed: int = 10) -> Scorer:
    """Logistic regression on soft targets by Adagrad steps, both classes weighing the same."""
    rng = np.random.default_rng(seed)
    w, g2 = np.zeros(buckets), np.full(buckets, 1e-8)
    good = max(target.sum(), 1.0)
    bad = max((1 - target).sum(), 1.0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, value = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ value, -30, 30)))
            weight = len(rows) / 2 * (target[i] / good + (1 - target[i]) / bad)
            grad = weight * (p - target[i]) * value + l2 * w[at]
            g2[at] += grad * grad
            w[at] -= step * grad / np.sqrt(g2[at])
    return Scorer(w)


def vote_patterns(docs: DataFrame) -> DataFrame:
    """doc_id and the votes on each row, as one small integer in base 3."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 3 ** np.arange(len(LABELLERS))
        for batch in batches:
            if batch.num_rows:
                all_votes = np.array([votes(t, common.WORD.findall(t)) for t in common.texts(batch)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((all_votes + 1) @ place)], names=["doc_id", "pattern"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, "doc_id long, pattern long")


def unpacked(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1


def fit(docs: DataFrame, sample: int = 4000, buckets: int = 1 << 18) -> tuple[LabelModel, Scorer] | None:
    """Label model from the votes on all rows, scorer from at most ``sample`` documents; None of an empty table.

    The counts of at most 3 ** 7 patterns come to the driver. The sample takes the documents of
    the smallest hashes of their text, so copies count once; it leaves out posteriors near 1/2.
    """
    counts = vote_patterns(docs).groupBy("pattern").count().toPandas().sort_values("pattern")
    if not len(counts):
        return None
    patterns = unpacked(counts["pattern"].to_numpy())
    model = estimate(patterns, counts["count"].to_numpy().astype(float))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(sample)
    part = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(chosen), "h").dropDuplicates(["h"])
    scorer = Scorer(np.zeros(buckets))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for h, t in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                words = common.WORD.findall(t)
                at, value = scorer.vector(words)
                rows.append((h, votes(t, words), at.astype("<i4").tobytes(), value.astype("<f4").tobytes()))
            if rows:
                h, v, at, value = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(v, pa.list_(pa.int32())), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["h", "v", "buckets", "shares"])

    got = part.mapInArrow(vectors, "h long, v array<int>, buckets binary, shares binary").toPandas().sort_values("h")
    target = model.posterior(np.array(got["v"].tolist()))
    sure = np.flatnonzero(np.abs(target - 0.5) > 0.3)
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(float)) for a, v in zip(got["buckets"].iloc[sure], got["shares"].iloc[sure])]
    return model, train(rows, target[sure], buckets)


def classify(docs: DataFrame, fitted: tuple[LabelModel, Scorer] | None) -> DataFrame:
    """doc_id, the votes for good and bad, the label model's posterior, the scorer's score and verdict.

    Kept is what scores above 0. A null or empty text has no words, no votes and the constant's
    score. Null ids and repeated rows stay.
    """
    common.prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = "doc_id long, n_good long, n_bad long, posterior double, score double, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            words = [common.WORD.findall(t) for t in common.texts(batch)]
            v = np.array([votes(t, w) for t, w in zip(common.texts(batch), words)])
            score = np.array([scorer.score(w) for w in words])
            columns = [pa.array((v == GOOD).sum(1)), pa.array((v == BAD).sum(1)), pa.array(model.posterior(v)), pa.array(score), pa.array(score > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_good", "n_bad", "posterior", "score", "kept"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, schema) if fitted else docs.sparkSession.createDataFrame([], schema)
