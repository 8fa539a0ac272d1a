"""LM scoring (9): a probabilistic suffix tree over words.

Contexts are the last words before a position. One is kept if its next-word counts diverge from
those of its suffix by more than its own parameters cost, or if a longer kept context ends in it.
A text is scored word by word from its longest kept context, whose distribution is smoothed
towards that of the next shorter one, down to the words' own shares.

The tree grows with the corpus: a context needs ``least`` occurrences, at every size, and is never
collected or sent to all tasks. All contexts that end in one word meet in one bucket with all
positions behind them, so a bucket counts, tests and scores its branch of the tree by itself, and
buckets are added with the positions. A context too frequent for one bucket is dealt to several
by its next older word; its counts, summed beforehand, are sent to those, so that each can test it
by all its occurrences. Whether a longer kept context ends in it only all of them know together:
where it fails the test, a bucket says what its positions would gain if it were kept, and that
is added if any bucket has kept a longer one. No score depends on where positions went.

Next words are told apart by symbols: frequent words by themselves, the others by ``classes`` hash
classes and, within a class, by their counts, which are joined. Only the counts of words of at
least the share ``known`` and of the classes are sent to the tasks, so their number is bounded.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

END = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
FOLDS, HELD_OUT = 5, 1
_ROW = "row long, doc_id long, held_out int, n_tokens long, n_known long, log_known double, log_class double, log_first double, rare binary"
_SENT = f"bucket int, hot long, blob binary, {_ROW}"
_SUMS = f"chunk long, hot long, sums binary, {_ROW}"
_UNIT = 1e6  # sums of log10 chances are whole numbers of millionths, so their order does not matter
_CHUNK = 1_000_000  # tokens handled at a time within a task
_WHOLE, _TOGETHER = 2, 2  # buckets' positions up to which a context stays whole, and buckets of a task


@dataclass
class Limits:
    """``known``: share from which a word's count is sent to the tasks. ``classes``: most classes of
    the other words. ``least``: training occurrences a context needs. ``depth``: its most words.
    ``bucket``: positions a bucket is to hold. ``sample``: documents from which contexts too
    frequent for a bucket are told; it decides where positions go. ``stay``: keep those without the
    test, so that scores depend on the buckets; without it they do not."""

    known: float = 2e-7
    classes: int = 65_536
    least: int = 2
    depth: int = 3
    bucket: int = 1_000_000
    sample: int = 1000
    stay: bool = True


@dataclass
class Words:
    """Hashes and counts of the frequent training words, the most frequent first, and the sums of the
    classes of others; ``sorted`` and ``ranks`` find a hash."""

    total: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray
    class_counts: np.ndarray
    class_kinds: np.ndarray

    def __post_init__(self):
        self.ranks = np.argsort(self.hashes)
        self.sorted = self.hashes[self.ranks]

    @property
    def base(self) -> float:
        return float(np.log10(self.total + 0.5 * (self.distinct + 1)))

    @property
    def within(self) -> np.ndarray:
        """What the words of each class share, one word that is not known included."""
        return self.class_counts + 0.5 * (self.class_kinds + 1)

    def start(self) -> np.ndarray:
        """The chance of each symbol without a context."""
        mass = np.concatenate([self.counts + 0.5, self.within])
        return mass / mass.sum()

    def places(self, words: np.ndarray) -> np.ndarray:
        return look_up(self.sorted, self.ranks, words, -1)

    def classes_of(self, words: np.ndarray) -> np.ndarray:
        return np.mod(words, len(self.class_counts))

    def symbols(self, words: np.ndarray) -> np.ndarray:
        place = self.places(words)
        return np.where(place >= 0, place, len(self.hashes) + self.classes_of(words))


@dataclass
class Routing:
    """The number of buckets, and by length the contexts that are dealt to several, sorted, with
    the number of their shares; ``goals`` are the buckets that need the counts of such a context.
    ``whole`` are less frequent ones that fill much of a bucket, sorted, with the bucket they get."""

    buckets: int = 1
    keys: list[np.ndarray] = field(default_factory=list)
    shares: list[np.ndarray] = field(default_factory=list)
    goals: list[tuple[int, int]] = field(default_factory=list)
    whole: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    total: int = 1  # buckets, with those of their own


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


# --- tokens and contexts --------------------------------------------------


def token_hashes(texts: list[str], hashes: common.WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of all texts, an end after each text, and the texts' lengths."""
    parts, lengths = [], []
    for t in texts:
        words = common.small_words(t)
        parts += [hashes.of(words), np.array([END])]
        lengths.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.empty(0, np.uint64), np.array(lengths, np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The rows without their texts, their tokens and lengths, in chunks of about ``_CHUNK`` tokens."""
    hashes = common.WordHashes()
    rows, tokens, lengths, held = [], [], [], 0
    for batch in batches:
        others = [c for c in batch.schema.names if c != "text"]
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found, n = token_hashes(common.texts(part), hashes)
            rows.append(part.select(others))
            tokens.append(found)
            lengths.append(n)
            held += len(found)
            if held >= _CHUNK:
                yield pa.Table.from_batches(rows).combine_chunks(), np.concatenate(tokens), np.concatenate(lengths)
                rows, tokens, lengths, held = [], [], [], 0
    if rows:
        yield pa.Table.from_batches(rows).combine_chunks(), np.concatenate(tokens), np.concatenate(lengths)


def _places(n: np.ndarray) -> np.ndarray:
    """The place of each token in its row."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def shortened(words: np.ndarray) -> np.ndarray:
    """What tells words apart in contexts: 48 bits of their hash, never 0."""
    return (words.view(np.uint64) >> np.uint64(16)) | np.uint64(1 << 48)


def context_hashes(older: list[np.ndarray]) -> list[np.ndarray]:
    """One hash for the last word, the last two, and so on; ``older`` holds words by distance, as ``shortened``."""
    out = [older[0]]
    for w in older[1:]:
        out.append(longer_hashes(out[-1], w))
    return out


def longer_hashes(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of contexts with a word before them."""
    with np.errstate(over="ignore"):
        return common.mixed(contexts * _STEP + words + np.uint64(1))


def _contexts_of(tokens: np.ndarray, place: np.ndarray, at: np.ndarray, depth: int) -> list[np.ndarray]:
    """Context hashes of the positions ``at``; 0 where the row begins later."""
    older = [np.where(place[at] >= d, shortened(tokens[np.maximum(at - d, 0)]), np.uint64(0)) for d in range(1, depth + 1)]
    return [np.where(place[at] >= d, c, np.uint64(0)) for d, c in enumerate(context_hashes(older), 1)]


# --- where positions go ---------------------------------------------------


def _share(context: np.ndarray, share: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return common.mixed(context + (share.astype(np.uint64) + np.uint64(1)) * _STEP) % np.uint64(buckets)


def dealt_out(
    routing: Routing, tokens: np.ndarray, place: np.ndarray, at: np.ndarray,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length, of the positions ``at`` whose shorter contexts are all dealt out: which these are,
    and their contexts, shares (0: not dealt out) and next longer contexts (0 where the row begins, or
    beyond the greatest length)."""
    some, context = np.arange(len(at)), shortened(tokens[at - 1])
    for d, keys in enumerate(routing.keys, 1):
        shares = look_up(keys, routing.shares[d - 1], common.signed(context), 0)
        longer = np.zeros(len(some), np.uint64)
        if d < len(routing.keys):
            there = np.flatnonzero((shares > 0) & (place[at[some]] > d))
            longer[there] = longer_hashes(context[there], shortened(tokens[at[some[there]] - d - 1]))
        yield d, some, context, shares, longer
        more = shares > 0
        some, context = some[more], longer[more]
        if not len(some):
            return


def route(routing: Routing, tokens: np.ndarray, place: np.ndarray, at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bucket of each position: that of its shortest context that is not dealt out."""
    out = np.zeros(len(at), np.int32)
    if routing.total == 1:
        return out
    out[:] = shortened(tokens[at - 1]) % np.uint64(routing.buckets)
    for d, some, context, shares, longer in dealt_out(routing, tokens, place, at):
        own = look_up(*routing.whole[d - 1], common.signed(context), -1)
        out[some[own >= 0]] = own[own >= 0]
        more = shares > 0
        some, next_older = some[more], longer[more] if d < len(routing.keys) else rows[some[more]].astype(np.uint64)
        out[some] = _share(context[more], common.mixed(next_older) % shares[more].astype(np.uint64), routing.buckets)
    return out


def learn_routing(docs: DataFrame, limits: Limits) -> Routing:
    """Buckets for all positions, and what is too frequent for one, from a sample by hash.

    At most 2 * ``depth`` * buckets contexts are told. Those of more than ``_WHOLE`` buckets'
    positions are dealt out; others that fill half a bucket get buckets of their own, several to
    one as long as it is not overfull, so that no bucket has much more than that.
    """
    depth = limits.depth
    step = max(1, docs.count() // limits.sample)
    picked = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).select("text")
    names = [f"c{d}" for d in range(1, depth + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, n in _chunks(batches):
            place = _places(n)
            at = np.flatnonzero(place)
            contexts = [common.signed(c) for c in _contexts_of(tokens, place, at, depth)]
            yield pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([0])] * depth, pa.array([len(at)])], names=["d", *names, "n"])
            for d in range(1, depth + 1):
                _, first, times = np.unique(contexts[d - 1][place[at] >= d], return_index=True, return_counts=True)
                first = np.flatnonzero(place[at] >= d)[first]
                columns = [pa.array(contexts[k][first] if k < d else np.zeros(len(first), np.int64)) for k in range(depth)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), d)), *columns, pa.array(times)], names=["d", *names, "n"])

    counts = picked.mapInArrow(run, f"d long, {', '.join(f'{c} long' for c in names)}, n long").groupBy("d", *names).agg(F.sum("n").alias("n"))
    total = counts.filter("d = 0").agg(F.sum("n")).first()[0] or 0
    if not total:
        return Routing()
    buckets = max(1, -(-total * step // limits.bucket))
    often = counts.filter((F.col("d") > 0) & (F.col("n") > max(16, total / buckets / 2))).collect() if buckets > 1 else []
    out = Routing(int(buckets), total=int(buckets))
    goals, dealt, fill, room = set(), {0: {0}}, total / buckets, 0
    for d in range(1, depth + 1):
        # what has a suffix that is whole is with it
        told = sorted((r[f"c{d}"], int(r.n), r) for r in often if r.d == d and (r[f"c{d - 1}"] if d > 1 else 0) in dealt[d - 1])
        here = [(c, int(n // fill) + 1, r) for c, n, r in told if n > max(16, _WHOLE * fill)]
        dealt[d] = {c for c, *_ in here}
        out.keys.append(np.array([c for c, *_ in here], np.int64))
        out.shares.append(np.array([s for _, s, _ in here], np.int64))
        own = {}
        for c, n, _ in sorted(told, key=lambda x: -x[1]):
            if c not in dealt[d]:
                if n > room:
                    out.total, room = out.total + 1, max(n, _WHOLE * fill)
                own[c], room = out.total - 1, room - n
        out.whole.append((np.array(sorted(own), np.int64), np.array([own[c] for c in sorted(own)], np.int64)))
        for c, s, r in here:
            for b in _share(np.full(s, np.uint64(c & common.MASK64)), np.arange(s), out.buckets).tolist():
                goals |= {(r[f"c{k}"], int(b)) for k in range(1, d + 1)}
        # a longer context that is whole needs the counts of its suffixes in its bucket
        goals |= {(r[f"c{k}"], own[c]) for c, _, r in told if c in own for k in range(1, d)}
    out.goals = sorted(goals)
    return out


# --- counts ---------------------------------------------------------------


class Sums:
    """Sums of equal integers over chunks, given out when ``most`` different ones are held."""

    def __init__(self, most: int = 2_000_000):
        self.most, self.keys, self.counts = most, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, chunk: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, n = np.unique(chunk, return_counts=True)
        both, at = np.unique(np.concatenate([self.keys, k]), return_inverse=True)
        self.keys, self.counts = both, np.bincount(at, np.concatenate([self.counts, n]), len(both)).astype(np.int64)
        if len(self.keys) > self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if len(self.keys):
            yield _counted(np.zeros(len(self.keys), np.int64), self.keys, self.counts)
        self.keys, self.counts = self.keys[:0], self.counts[:0]


def _counted(hot: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hot), pa.array(keys), pa.array(counts)], names=["hot", "key", "n"])


def prepared(docs: DataFrame) -> DataFrame:
    """row, doc_id, text and the fold's verdict; a null id belongs to the training rows."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held_out"),
        F.monotonically_increasing_id().alias("row"),
    )


def word_counts(docs: DataFrame, routing: Routing) -> DataFrame:
    """(hot, key, n) over the training rows, summed in each task before the shuffle: of all tokens,
    with hot 0, and of the words after each context that is dealt out, with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for _, tokens, n in _chunks(batches):
            yield from sums.add(common.signed(tokens))
            place = _places(n)
            at = np.flatnonzero(place)
            for _, some, context, shares, _ in dealt_out(routing, tokens, place, at):
                hot = shares > 0
                context, word = context[hot], tokens[at[some[hot]]]
                with np.errstate(over="ignore"):
                    _, first, times = np.unique(common.mixed(context * _STEP + word), return_index=True, return_counts=True)
                if len(first):
                    yield _counted(common.signed(context[first]), common.signed(word[first]), times)
        yield from sums.rest()

    found = docs.filter("not held_out").select("text").mapInArrow(run, "hot long, key long, n long")
    return found.groupBy("hot", "key").agg(F.sum("n").alias("n"))


def learn_words(counts: DataFrame, limits: Limits) -> Words:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    least = max(1, limits.known * total)
    # at most 1 / known rows, as each has at least that share of all words
    rows = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "key"], ascending=False)
    classes = min(limits.classes, max(1, distinct // 16))
    other = counts.filter(F.col("n") < least).groupBy(F.pmod("key", F.lit(classes)).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).toPandas()
    sums = lambda c: np.bincount(other["c"].to_numpy(np.int64), other[c].to_numpy(float), classes)
    return Words(total, distinct, rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), sums("n"), sums("k"))


def hot_counts(entries: DataFrame, words: Words, routing: Routing) -> DataFrame:
    """(bucket, hot, blob): symbols and counts of each context that is dealt out, for each of its buckets."""
    spark = entries.sparkSession
    held = spark.sparkContext.broadcast(words)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = held.value.symbols(b.column("key").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("hot"), pa.array(found), b.column("n")], names=["hot", "symbol", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in common.runs(batches, ["hot"]):
            starts = np.append(common.group_starts(t, ["hot"]), t.num_rows)
            hot, symbol, n = (t.column(c).to_numpy() for c in ("hot", "symbol", "n"))
            blobs = [_pack([_planes(np.diff(symbol[a:b], prepend=0).astype("<i8")), _planes(n[a:b].astype("<i8"))]) for a, b in zip(starts, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(hot[starts[:-1]]), pa.array(blobs, pa.binary())], names=["hot", "blob"])

    by = entries.mapInArrow(symbols, "hot long, symbol long, n long").groupBy("hot", "symbol").agg(F.sum("n").alias("n"))
    # a context has at most as many rows as there are symbols, which are bounded
    blobs = by.repartition("hot").sortWithinPartitions("hot", "symbol").mapInArrow(packed, "hot long, blob binary")
    return blobs.join(spark.createDataFrame(routing.goals, "hot long, bucket int"), "hot")


# --- rows and positions ---------------------------------------------------


def _planes(values: np.ndarray) -> np.ndarray:
    """The values' first bytes, then their second bytes and so on, which pack better."""
    return np.ascontiguousarray(values.reshape(-1, 1).view(np.uint8).T)


def _unplaned(raw: np.ndarray, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind)


def _pack(arrays: list[np.ndarray]) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _opened(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[int, list[np.ndarray]]:
    """The chunk; rows, their numbers of positions and verdicts, ranks of known words, 48 bits of
    older words that are not, classes of next words that are not, codes."""
    raw = _opened(blob)
    chunk, n_rows, n_known, n_older, n_next, n, width, depth = np.frombuffer(raw, "<i8", 8).tolist()
    at, out = 64, []
    for kind, size in (("<i8", n_rows), ("<i4", n_rows), ("u1", n_rows), ("<i4", n_known), ("u1", n_older * 6), ("<i4", n_next), ("u1", n * (depth + 1) * width)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    out[0], out[3] = np.cumsum(out[0]), np.cumsum(out[3])
    words = np.zeros((n_older, 8), np.uint8)
    words[:, :6] = out[4].reshape(6, n_older).T
    out[4] = words.view("<u8").ravel()
    out[6] = _unplaned(out[6], f"<u{width}", n * (depth + 1)).reshape(depth + 1, n)
    return chunk, out


def coded(docs: DataFrame, words: Words, routing: Routing, depth: int) -> DataFrame:
    """The rows with what the sent counts give, and for each bucket its positions in a chunk.

    A position is its word and the words before it, as codes of the words that occur there.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((words, words.start(), np.log10(words.within)))
    schema = pa.schema([
        ("bucket", pa.int32()), ("hot", pa.int64()), ("blob", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.int32()),
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_known", pa.float64()), ("log_class", pa.float64()), ("log_first", pa.float64()), ("rare", pa.binary()),
    ])

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, within = held.value
        counts = np.append(words.counts, 0)
        for table, tokens, n in _chunks(batches):
            tokens = common.signed(tokens)
            different, code = np.unique(tokens, return_inverse=True)
            code = code.astype(np.int32)
            known = (place := words.places(different)) >= 0
            log = np.where(known, np.log10(counts[place] + 0.5), 0.0)
            classes = np.where(known, 0.0, within[words.classes_of(different)])
            first = np.cumsum(n) - n
            of = np.repeat(np.arange(len(n), dtype=np.int32), n)
            sums = lambda of_word: np.bincount(of, of_word[code], len(n))
            is_known = known[code]
            n_known = np.bincount(of, is_known, len(n)).astype(np.int64)
            rare = [r.tobytes() for r in np.split(tokens[~is_known], np.cumsum(n - n_known)[:-1])]
            row, verdict = table.column("row").to_numpy(), table.column("held_out").to_numpy(zero_copy_only=False).astype(np.int32)
            class_of = words.classes_of(different)
            symbol = np.where(known, place, len(words.hashes) + class_of)
            yield batch(
                len(n), bucket=(row % routing.total).astype(np.int32), row=row, doc_id=table.column("doc_id").combine_chunks(), held_out=verdict, n_tokens=n,
                n_known=n_known, log_known=sums(log), log_class=sums(classes), log_first=np.log10(start[symbol[code[first]]]), rare=rare,
            )
            numbers, blobs = [], []
            for number, blob in _positions(tokens, different, code, place, class_of, of, n, row, verdict):
                numbers.append(number)
                blobs.append(blob)
            if blobs:
                yield batch(len(blobs), bucket=numbers, blob=blobs)

    def _positions(tokens, different, code, place, class_of, of, n, row, verdict) -> Iterator[tuple[int, bytes]]:
        in_row = _places(n).astype(np.int32)
        at = np.flatnonzero(in_row)
        bucket = route(routing, tokens.view(np.uint64), in_row, at, row[of[at]])
        bucket = bucket.astype(np.uint16) if routing.total < 1 << 16 else bucket
        at = at.astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        known, parts = place >= 0, np.split(at[order], starts[1:])
        del bucket, order, at
        older_code, next_code = np.zeros(len(different) + 1, np.int64), np.zeros(len(different), np.int64)

        def used(codes: np.ndarray) -> np.ndarray:
            seen = np.zeros(len(different) + 1, bool)
            seen[codes] = True
            return seen[1:]

        for number, some in zip(numbers.tolist(), parts):
            following = code[some]
            older = np.stack([np.where(in_row[some] >= d, code[np.maximum(some - d, 0)] + 1, 0) for d in range(1, depth + 1)])
            is_next, is_older = used(following + 1), used(older)
            both, rare_next, rare_older = (np.flatnonzero(x) for x in ((is_next | is_older) & known, is_next & ~known, is_older & ~known))
            both = both[np.argsort(place[both])]  # the most frequent get the least codes
            older_code[both + 1] = next_code[both] = np.arange(1, len(both) + 1)
            older_code[rare_older + 1] = len(both) + np.arange(1, len(rare_older) + 1)
            next_code[rare_next] = len(both) + len(rare_older) + np.arange(1, len(rare_next) + 1)
            width = 2 if len(both) + len(rare_older) + len(rare_next) < (1 << 16) - 1 else 4
            rows = of[some]
            begins = np.flatnonzero(np.diff(rows, prepend=-1))
            times = np.diff(np.append(begins, len(rows)))
            rows = rows[begins]
            yield number, _pack([
                np.array([row[0], len(rows), len(both), len(rare_older), len(rare_next), len(some), width, depth], "<i8"),
                np.diff(row[rows], prepend=0).astype("<i8"), times.astype("<i4"), verdict[rows].astype("u1"), np.diff(place[both], prepend=0).astype("<i4"),
                _planes(shortened(different[rare_older]))[:6], class_of[rare_next].astype("<i4"),
                _planes(np.concatenate([next_code[following], older_code[older].ravel()]).astype(f"<u{width}")),
            ])

    return docs.mapInArrow(run, _SENT)


# --- the tree, bucket by bucket -------------------------------------------


@dataclass
class Undecided:
    """What other buckets decide: ``kept`` are contexts dealt out that fail the test but have a longer
    kept one here. ``open`` are those that have none: context, its positions, their chances after
    it and after the next shorter one."""

    kept: set[int] = field(default_factory=set)
    open: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)


def _grouped(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of keys from 0 to below ``bound``, equal ones in theirs; where each key begins in it, and the different keys."""
    bits = max(1, (len(keys) - 1).bit_length())
    if bound <= 1 << (63 - bits):  # key and place in one number, which sorts faster than keys by their places
        keys = keys << bits
        keys |= np.arange(len(keys))
        keys.sort()
        order = (keys & ((1 << bits) - 1)).astype(np.int32)
        keys >>= bits
    else:
        order = np.argsort(keys, kind="stable").astype(np.int32)
        keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    begins = np.flatnonzero(new)
    return order, begins, keys[begins]


def _diverges(chain: list[int], hot: dict[int, tuple[np.ndarray, np.ndarray]], start: np.ndarray) -> bool:
    """The test of a context by all its counts; ``chain`` are its suffixes from the shortest and itself."""
    symbols, n = hot[chain[-1]]
    shorter = start[symbols]
    for c in chain[:-1]:
        times = look_up(*hot[c], symbols, 0)
        shorter = (times + len(hot[c][0]) * shorter) / (hot[c][1].sum() + len(hot[c][0]))
    gain = np.bincount(np.zeros(len(n), np.int64), n * np.log(n / n.sum() / shorter))[0]
    return bool(gain > 0.5 * len(n) * np.log(max(n.sum(), 2)))


def chances(
    symbols: np.ndarray, contexts: list[np.ndarray], reach: np.ndarray, train: np.ndarray, start: np.ndarray, least: int,
    hot: dict[int, tuple[np.ndarray, np.ndarray]], undecided: Undecided | None = None, stay: bool = False,
    named: Callable[[int, np.ndarray], np.ndarray] | None = None,
) -> np.ndarray:
    """The chance of each position's symbol after its longest kept context.

    ``contexts`` tell by length, as numbers from 0, contexts apart that share the next shorter one;
    ``reach`` is the number of words before a position, ``train`` 1 where it counts. ``hot`` has
    the symbols and counts of contexts that other buckets share, by what ``named`` gives for a
    length and positions; ``undecided`` takes what those have to say about them, and with ``stay``
    they are kept.
    """
    width = len(start)
    chain = start[symbols]  # by all contexts so far, kept or not
    out = chain.copy()
    levels, alive, node, n_nodes = [], np.arange(len(symbols), dtype=np.int32), np.zeros(len(symbols), np.int32), 1
    named = named or (lambda d, at: contexts[d - 1][at])
    shared = np.array(sorted(hot), np.int64)
    for d, words in enumerate(contexts, 1):
        reaches = reach[alive] >= d
        alive, node = alive[reaches], node[reaches]
        if not len(alive):
            break
        bound = int(words.max()) + 1
        order, begins, _ = _grouped(node.astype(np.int64) * bound + words[alive], n_nodes * bound)
        alive, suffix = alive[order], node[order[begins]]
        sizes = np.diff(np.append(begins, len(alive)))
        total = np.add.reduceat(train[alive], begins, dtype=np.int64)
        names = named(d, alive[begins]) if len(shared) else np.zeros(len(begins), np.int64)
        dealt = np.isin(names, shared)
        total[dealt] = [hot[c][1].sum() for c in names[dealt].tolist()]
        enough = total >= least
        alive = alive[np.repeat(enough, sizes)]
        if not len(alive):
            break
        names, total, dealt, suffix, sizes = names[enough], total[enough], dealt[enough], suffix[enough], sizes[enough]
        n_nodes, ends = len(total), np.cumsum(sizes)
        node = np.repeat(np.arange(n_nodes, dtype=np.int32), sizes)
        order, begins, keys = _grouped(node.astype(np.int64) * width + symbols[alive], n_nodes * width)
        alive = alive[order]
        del order
        times = np.add.reduceat(train[alive], begins, dtype=np.int64)
        of = node[begins]
        for k in np.flatnonzero(dealt).tolist():
            mine = slice(*np.searchsorted(keys, [k * width, (k + 1) * width]))
            times[mine] = look_up(*hot[int(names[k])], keys[mine] - k * width, 0)
        del keys
        kinds = np.bincount(of, times > 0, n_nodes)
        kinds[dealt] = [len(hot[c][0]) for c in names[dealt].tolist()]
        shorter = chain[alive[begins]]
        seen = times > 0
        # divergence of what the context was followed by from its suffix, in nats over all its occurrences
        gain = np.bincount(of[seen], times[seen] * np.log(times[seen] / total[of[seen]] / shorter[seen]), n_nodes)
        keep = gain > 0.5 * kinds * np.log(np.maximum(total, 2))
        p = (times + kinds[of] * shorter) / (total + kinds)[of]
        del times, seen, shorter
        times = np.diff(np.append(begins, len(alive))).astype(np.int32)
        open_ = []
        for k in np.flatnonzero(dealt).tolist():  # here are not all of its symbols
            there = alive[ends[k] - sizes[k] : ends[k]]
            keep[k] = stay or _diverges([int(named(j, there[:1])[0]) for j in range(1, d + 1)], hot, start)
            if not keep[k]:
                by_place = np.argsort(there)
                after = np.repeat(p, times)[ends[k] - sizes[k] : ends[k]]
                open_.append((k, int(names[k]), there[by_place], after[by_place], chain[there[by_place]]))
        levels.append((alive, times, keep, suffix, of, p, open_))
        chain[alive] = np.repeat(p, times)
    for (_, _, keep, *_), (_, _, longer, suffix, *_) in zip(levels[-2::-1], levels[:0:-1]):
        keep[suffix[longer]] = True
    for alive, times, keep, _, of, p, open_ in levels:
        kept = keep[of]
        out[alive[np.repeat(kept, times)]] = np.repeat(p[kept], times[kept])
        if undecided is not None:
            undecided.kept |= {context for k, context, *_ in open_ if keep[k]}
            undecided.open += [of_context for k, *of_context in open_ if not keep[k]]
    return out


def _scored(rows: DataFrame, words: Words, limits: Limits, buckets: int) -> DataFrame:
    """The rows as they came, and for each task and chunk the log10 chances of its rows' positions there."""
    held = rows.sparkSession.sparkContext.broadcast((words, words.start()))
    names = [c.split()[0] for c in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start = held.value
        blobs: dict[int, list[bytes]] = {}
        hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            own = batch.filter(batch.column("row").is_valid())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([*[pa.nulls(own.num_rows, t) for t in (pa.int64(), pa.int64(), pa.binary())], *own.select(names).columns], names=["chunk", "hot", "sums", *names])
            rest = batch.filter(batch.column("row").is_null())
            for number, context, blob in zip(*(rest.column(c).to_pylist() for c in ("bucket", "hot", "blob"))):
                if context is None:
                    blobs.setdefault(number, []).append(blob)
                else:
                    raw = np.frombuffer(_opened(blob), np.uint8).reshape(2, -1)
                    symbol, n = (_unplaned(x, "<i8", len(x) // 8) for x in raw)
                    hot[context] = np.cumsum(symbol), n
            del batch, own, rest
        of_chunks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        found = []
        for number in sorted(blobs):
            for chunk, context, row, sums in score_bucket(blobs.pop(number), words, start, limits, hot):
                if context is None:
                    of_chunks.setdefault(chunk, []).append((row, sums))
                else:
                    found.append((chunk, context, None if chunk is None else _packed_sums(row, sums)))
        while of_chunks:
            chunk, parts = of_chunks.popitem()
            row, at = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
            total = np.zeros(len(row), np.int64)
            np.add.at(total, at, np.concatenate([x for _, x in parts]))
            found.append((chunk, None, _packed_sums(row, total)))
        for a in range(0, len(found), 200):
            own = [pa.array(list(c), t) for c, t in zip(zip(*found[a : a + 200]), (pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(own[0]), t) for t in kinds]], names=["chunk", "hot", "sums", *names])

    kinds = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}[c.split()[1]] for c in _ROW.split(", ")]
    tasks = -(-buckets // _TOGETHER)
    return rows.repartitionById(tasks, F.pmod("bucket", F.lit(tasks))).mapInArrow(run, _SUMS)


def score_bucket(
    blobs: list[bytes], words: Words, start: np.ndarray, limits: Limits, hot: dict,
) -> list[tuple[int | None, int | None, np.ndarray | None, np.ndarray | None]]:
    """(chunk, context, rows, sums): the sums of the rows' log10 chances, from all positions of a bucket.

    Sums beside a context count if it is kept; a context without a chunk is kept.
    """
    # a word of a context is 0 for none, a rank and 1, or from there on a place in ``rare``
    n_known = len(words.hashes)
    chunks, rows, times, train, symbols, older, others = [], [], [], [], [], [], []
    while blobs:
        chunk, (row, n, verdict, known, rare, classes, codes) = _unpack(blobs.pop())
        chunks.append(chunk)
        rows.append(row)
        times.append(n)
        train.append(np.repeat(1 - verdict, n))
        numbers = np.concatenate([np.zeros(1, np.int64), known + 1, -1 - sum(map(len, others)) - np.arange(len(rare))]).astype(np.int32)
        symbol = np.concatenate([np.zeros(1, np.int64), known, np.zeros(len(rare), np.int64), n_known + classes]).astype(np.int32)
        symbols.append(symbol[codes[0]])
        older.append(numbers[codes[1:]])
        others.append(rare)
    rare, of_rare = np.unique(np.concatenate(others), return_inverse=True)
    of_rare = (of_rare + n_known + 1).astype(np.int32)
    older = np.concatenate(older, axis=1)
    is_rare = older < 0
    older[is_rare] = of_rare[-1 - older[is_rare]]
    del is_rare
    reach = np.count_nonzero(older, axis=0).astype(np.int8)

    def named(d: int, at: np.ndarray) -> np.ndarray:
        parts = []
        for w in older[:d, at]:
            part = np.empty(len(w), np.uint64)
            part[w <= n_known] = shortened(words.hashes[w[w <= n_known] - 1])
            part[w > n_known] = rare[w[w > n_known] - n_known - 1] | np.uint64(1 << 48)
            parts.append(part)
        return common.signed(context_hashes(parts)[-1])

    undecided, symbols, train = Undecided(), np.concatenate(symbols), np.concatenate(train)
    log = np.log10(chances(symbols, list(older), reach, train, start, limits.least, hot, undecided, limits.stay, named))
    ends = np.cumsum([int(n.sum()) for n in times])
    out = []
    for chunk, row, n, last in zip(chunks, rows, times, ends.tolist()):
        first = last - int(n.sum())
        out.append((chunk, None, row, _units(np.add.reduceat(log[first:last], np.cumsum(n) - n))))
    for context, at, after, before in undecided.open:
        more = np.log10(after / before)
        cuts = np.searchsorted(at, ends)  # positions are in order
        for k, (a, b) in enumerate(zip([0, *cuts.tolist()], cuts.tolist())):
            if a < b:
                of = np.searchsorted(np.cumsum(times[k]), at[a:b] - (ends[k] - times[k].sum()), "right")
                there, at_row = np.unique(of, return_inverse=True)
                out.append((chunks[k], context, rows[k][there], _units(np.bincount(at_row, more[a:b]))))
    return out + [(None, context, None, None) for context in sorted(undecided.kept)]


def _units(sums: np.ndarray) -> np.ndarray:
    return np.rint(sums * _UNIT).astype(np.int64)


def _packed_sums(rows: np.ndarray, sums: np.ndarray) -> bytes:
    return _pack([_planes(np.diff(rows, prepend=0).astype("<i8")), _planes(sums.astype("<i8"))])


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in common.runs(batches, ["chunk"]):
        starts = np.append(common.group_starts(table, ["chunk"]), table.num_rows)
        blobs = table.column("sums")
        for a, b in zip(starts, starts[1:]):
            rows, sums = [], []
            for blob in blobs.slice(a, b - a).to_pylist():
                raw = np.frombuffer(_opened(blob), np.uint8).reshape(2, -1)
                rows.append(np.cumsum(_unplaned(raw[0], "<i8", raw.shape[1] // 8)))
                sums.append(_unplaned(raw[1], "<i8", raw.shape[1] // 8))
            row, at = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros(len(row), np.int64)
            np.add.at(total, at, np.concatenate(sums))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(total / _UNIT)], names=["row", "log_tree"])


def _rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.column("rare").slice(at, 1000).to_pylist()
            n = [len(p) // 8 for p in part]
            row = np.repeat(batch.column("row").slice(at, 1000).to_numpy(), n)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.frombuffer(b"".join(part), "<i8"))], names=["row", "key"])


def score(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Score every row by the base and by the tree, learning from the rows that are not held out.

    A null or empty text is its end alone. Null ids train; repeated rows train and score each
    time. With no training rows every chance is that of an unseen word.
    """
    limits = limits or Limits()
    scratch = common.Scratch(docs.sparkSession, "lm")
    docs = prepared(docs)
    routing = learn_routing(docs, limits)
    both = scratch.table(word_counts(docs, routing), "words")
    counts = both.filter("hot = 0").select("key", "n")
    words = learn_words(counts, limits)
    rows = coded(docs, words, routing, limits.depth)
    if routing.goals:
        rows = rows.unionByName(hot_counts(both.filter("hot <> 0"), words, routing), allowMissingColumns=True)
    rows = scratch.table(_scored(rows, words, limits, routing.total), "scored")
    sent = max(1, limits.known * words.total)
    rare = rows.filter("length(rare) > 0").select("row", "rare").mapInArrow(_rare_words, "row long, key long")
    found = rare.join(counts.filter(F.col("n") < sent), "key", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("log_rare"), F.count("n").alias("n_rare")
    )
    # at most the contexts that are dealt out, which the routing holds
    kept = rows.filter("chunk is null and hot is not null").groupBy("hot").agg(F.lit(True).alias("kept"))
    sums = rows.filter("chunk is not null").select("chunk", "hot", "sums")
    if routing.goals:
        sums = sums.join(F.broadcast(kept), "hot", "left").filter("hot is null or kept")
    sums = sums.select("chunk", "sums").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_row_sums, "row long, log_tree double")
    own = rows.filter("row is not null").drop("chunk", "hot", "sums", "rare")
    both = own.join(sums, "row", "left").join(found, "row", "left").na.fill({"log_tree": 0.0, "log_rare": 0.0, "n_rare": 0})
    base = F.col("log_known") + F.col("log_rare") - F.col("n_tokens") * words.base
    return both.select(
        "doc_id", (F.col("held_out") > 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("n_rare")).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("log_first") + F.col("log_tree") + F.col("log_rare") - F.col("log_class")).alias("score"),
    )
