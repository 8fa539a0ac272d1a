"""N-gram Jaccard join (5): an LSH forest of MinHash signatures, then exact verification.

Texts with equal sets of five-word shingles are one class. Each of the forest's trees is a
sorted trie of the classes' signatures. Matches start at the longest prefix, where classes that
look nearly equal to a leader are attached to it; the prefix is then shortened to the first
length at which a pair at the threshold meets in some tree with the target probability, and the
leaders are compared there. What is attached or compared closely enough is one candidate group.
Within a candidate group every pair is verified from the whole texts, by products of incidence
matrices in blocks, and only counts and spanning links leave the task.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aidlens.llm import common

WIDTH = 5
NO_ID = -(1 << 63)  # stands for a null id inside the operator
SEED = 5
_KEY = ["id", "h1", "h2"]  # an id and its text; rows that share both are copies
_ROWS = "id long, h1 long, h2 long, k1 long, k2 long, n_shingles long, prefixes array<long>, rests array<int>, sketch binary"
_EDGE = "a long, b long"


def shingles(words: list[bytes], hashes: common.WordHashes, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the different windows of ``width`` words; of all words where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(common.windows(hashes.of(words), min(width, len(words))))


def recall(similarity: float, depth: int, trees: int) -> float:
    """Chance that two sets of this similarity share a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float, trees: int, longest: int, target: float) -> int:
    """The longest prefix that reaches the target recall at the threshold, or 1."""
    return next((d for d in range(longest, 0, -1) if recall(threshold, d, trees) >= target), 1)


class Signer:
    """Signatures of sets: ``trees`` rows of ``longest`` minima each."""

    def __init__(self, trees: int, longest: int, depth: int):
        self.trees, self.longest, self.depth = trees, longest, depth
        rng = np.random.default_rng(SEED)
        self.factors = rng.integers(0, 1 << 63, trees * longest, np.uint64) * np.uint64(2) + np.uint64(1)

    def minima(self, values: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), common.MASK64, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(values), 2048):
                product = self.factors[:, None] * values[None, at : at + 2048]
                np.minimum(out, product.min(1), out=out)
        return out

    def sign(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Keys of the shortened prefixes by tree, hashes of what the prefixes leave out, one byte a minimum."""
        minima = common.mixed(self.minima(values))
        by_tree = minima.reshape(self.trees, self.longest)
        key = np.zeros(self.trees, np.uint64)
        rest = np.zeros(self.trees, np.uint64)
        with np.errstate(over="ignore"):
            for d in range(self.longest):
                part = key if d < self.depth else rest
                part[:] = common.mixed(part * np.uint64(31) + by_tree[:, d] + np.uint64(d + 1))
        prefixes = (np.arange(self.trees, dtype=np.int64) << 40) | (key >> np.uint64(24)).astype(np.int64)
        return prefixes, (rest >> np.uint64(33)).astype(np.int32), (minima >> np.uint64(56)).astype(np.uint8).tobytes()


def signed_rows(docs: DataFrame, signer: Signer) -> DataFrame:
    """One row a document: id, hashes of its text, the key of its set, and its signature (null without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for batch in batches:
            rows = []
            for *key, text in zip(*[batch.column(c).to_pylist() for c in _KEY], common.texts(batch)):
                values = shingles(common.small_words(text), hashes)
                if not len(values):
                    rows.append((*key, 0, 0, 0, None, None, None))
                    continue
                digest = common.xxhash.xxh3_128_digest(values.tobytes())
                k1, k2 = (int(k) for k in np.frombuffer(digest, "<i8"))
                prefixes, rests, sketch = signer.sign(values)
                rows.append((*key, k1, k2, len(values), prefixes.tolist(), rests.tolist(), sketch))
            if rows:
                types = [*[pa.int64()] * 6, pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
                names = [*_KEY, "k1", "k2", "n_shingles", "prefixes", "rests", "sketch"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.mapInArrow(run, _ROWS)


# --- candidate groups -------------------------------------------------------


def attach(sketches: np.ndarray, near: float, same: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Leaders among rows, and (row, leader) where rows that look near a leader were not yet connected with it.

    A row that looks the ``same`` as a leader is done: whatever is similar to it is near the
    leader too. Others stay and may lead. There are fewer edges than rows.
    """
    alive, edges, leaders, root = np.arange(len(sketches)), [], [], np.arange(len(sketches))
    while len(alive):
        lead, alive = int(alive[0]), alive[1:]
        leaders.append(lead)
        if len(alive):
            agree = (sketches[alive] == sketches[lead]).mean(1)
            found = np.unique(root[alive[agree >= near]])
            found = found[found != root[lead]]
            if len(found):
                edges += [(int(k), lead) for k in found]
                root[np.isin(root, found)] = root[lead]
            alive = alive[agree < same]
    return edges, leaders


def _matcher(near: float, same: float, leaders_only: bool):
    """Rows of tries, sorted by node and rest, to (class, least connected class); or to the leaders of each node."""

    def connect(rest: np.ndarray, sketches: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        edges, here = [], np.arange(len(rest))
        if len(rest) > 8:  # longest prefixes first
            cuts = [0, *(np.flatnonzero(np.diff(rest)) + 1).tolist(), len(rest)]
            leaders = []
            for x, y in zip(cuts, cuts[1:]):
                inner, lead = attach(sketches[x:y], near, same)
                edges += [(x + i, x + j) for i, j in inner]
                leaders += [x + k for k in lead]
            here = np.array(leaders)
        outer, lead = attach(sketches[here], near, same)
        return edges + [(int(here[i]), int(here[j])) for i, j in outer], here[lead]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in common.runs(batches, ["key", "salt"]):
            node, rest = table.column("node").to_numpy(), table.column("rest").to_numpy()
            raw = table.column("sketch").to_pylist()
            sketches = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
            starts = np.append(common.group_starts(table, ["key", "salt"]), len(node))
            out, to, led = [], [], []
            for low, high in zip(starts.tolist(), starts[1:].tolist()):
                edges, leaders = connect(rest[low:high], sketches[low:high])
                led += (low + leaders).tolist()
                if edges:
                    a, b = np.array(edges).T
                    own, root = node[low:high], _roots(high - low, a, b)
                    least = own.copy()
                    np.minimum.at(least, root, own)
                    moved = np.flatnonzero(least[root] != own)
                    out += own[moved].tolist()
                    to += least[root[moved]].tolist()
            if leaders_only:
                kept = table.take(pa.array(led))
                yield from kept.set_column(kept.schema.get_field_index("salt"), "salt", pa.array(np.zeros(len(led), np.int32))).to_batches()
            elif out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(to, pa.int64())], names=["a", "b"])

    return run


def candidates(classes: DataFrame, scratch: common.Scratch, near: float, same: float, block: int) -> DataFrame:
    """Edges (a, b) that connect every pair of classes that the forest finds."""
    exploded = classes.select("node", F.explode(F.arrays_zip("prefixes", "rests")).alias("t")).select("node", F.col("t.prefixes").alias("key"), F.col("t.rests").alias("rest"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # a trie node of many classes is dealt out in blocks, whose leaders then meet in one task
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)).cast("int")
    met = exploded.join(shared, "key").withColumn("salt", salt).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    met = scratch.table(met.join(classes.select("node", "sketch"), "node").select("key", "salt", "blocks", "rest", "node", "sketch"), "met")
    ranked = lambda df: df.repartition("key", "salt").sortWithinPartitions("key", "salt", "rest", "node")
    edges = ranked(met).mapInArrow(_matcher(near, same, False), _EDGE)
    wide = met.filter("blocks > 1")
    leaders = ranked(wide).mapInArrow(_matcher(near, same, True), wide.schema)
    edges = edges.unionByName(ranked(leaders).mapInArrow(_matcher(near, same, False), _EDGE))
    return edges.distinct()


def components(edges: DataFrame, scratch: common.Scratch, name: str) -> DataFrame:
    """(node, root) of all nodes with an edge: the least node that each is connected with.

    Large-star and small-star steps in turn, each over written edges, until nothing changes.
    """
    ordered = lambda df: df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = scratch.table(ordered(edges), f"{name}0")
    before, step = mark(now), 0
    while before[0]:
        step += 1
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = scratch.table(ordered(small), f"{name}{step}")
        after = mark(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


# --- verification -----------------------------------------------------------


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], cells: int = 8_000_000) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``.

    Only values that both sides hold count; they are taken in chunks of a bounded matrix.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(s) for s in left])
    row_b = np.repeat(np.arange(len(right)), [len(s) for s in right])
    values = np.intersect1d(a, b)
    step = max(1, cells // max(len(left), len(right)))
    for at in range(0, len(values), step):
        part = values[at : at + step]

        def matrix(v, rows, n):
            place = np.minimum(np.searchsorted(part, v), len(part) - 1)
            here = part[place] == v
            m = np.zeros((n, len(part)), np.float32)
            m[rows[here], place[here]] = 1
            return m

        out += matrix(a, row_a, len(left)) @ matrix(b, row_b, len(right)).T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Which pairs have a similarity of at least the fraction ``threshold``, exactly."""
    num, den = threshold
    both = shared_counts(left, right).astype(np.int64)
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return (both > 0) & (both * (den + num) >= num * sizes)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least connected row of each of ``n`` rows."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verifier(threshold: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for table in common.runs(batches, ["root", "i", "j"]):
            starts = np.append(common.group_starts(table, ["root", "i", "j"]), table.num_rows)
            node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
            one, two = table.column("i").to_numpy(), table.column("j").to_numpy()
            out_node, out_root, out_links = [], [], []
            for low, high in zip(starts, starts[1:]):
                sets = [shingles(common.small_words(t), hashes) for t in table.column("text").slice(low, high - low).to_pylist()]
                at = np.arange(high - low)
                left = at[block[low:high] == one[low]]
                right = at[block[low:high] == two[low]]
                if not len(left) or not len(right):
                    continue
                link = linked([sets[k] for k in left], [sets[k] for k in right], threshold)
                if one[low] == two[low]:
                    np.fill_diagonal(link, False)
                x, y = np.nonzero(link)
                x, y = left[x], right[y]
                n = np.bincount(x, minlength=len(at))
                if one[low] != two[low]:
                    n = n + np.bincount(y, minlength=len(at))
                root = _roots(len(at), x, y)
                kept = np.flatnonzero(n)
                out_node += node[low + kept].tolist()
                out_root += node[low + root[kept]].tolist()
                out_links += n[kept].tolist()
            if out_node:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_node, out_root, out_links)], names=["node", "other", "links"])

    return run


def verified(members: DataFrame, threshold: tuple[int, int], block: int, block_chars: int) -> DataFrame:
    """(node, other, links): of each block pair of a group, a node's count of links and a node it is connected with.

    ``members`` has root, node and text. A group of many members or much text is cut in blocks,
    and each pair of blocks is one piece of work of bounded size.
    """
    size = members.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("chars") / block_chars))
    dealt = members.join(size.select("root", blocks.cast("int").alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "block", "text")
    met = met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return met.mapInArrow(_verifier(threshold), "node long, other long, links long")


def _text_key() -> list[Column]:
    """The columns of ``_KEY``: the id, and 128 bits of the whole text."""
    id_, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.col("text").cast("string")
    return [id_, F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _classes(
    docs: DataFrame, threshold: tuple[int, int] = (4, 5), trees: int = 20, longest: int = 6, target: float = 0.9999,
    near: float = 0.5, same: float = 0.85, block: int = 2000, block_chars: int = 8_000_000,
) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and the classes with their size, links, and leads.

    The lead of a class is its least (id, text hashes), the lead of a group (null without a
    link) that of its least class. No two classes share a lead, whatever ids they share.
    """
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "near")
    depth = matched_depth(threshold[0] / threshold[1], trees, longest, target)
    one = docs.select(*[c.alias(k) for k, c in zip(_KEY, _text_key())], F.col("text").cast("string").alias("text"))
    rows = scratch.table(signed_rows(one, Signer(trees, longest, depth)), "rows")
    keyed = rows.filter("n_shingles > 0")
    first = ["prefixes", "rests", "sketch"]
    classes = keyed.groupBy("k1", "k2").agg(F.min(F.struct(*_KEY)).alias("lead"), F.count("*").alias("class_size"), *[F.any_value(c).alias(c) for c in first])
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    groups = scratch.table(components(candidates(classes, scratch, near, same, block), scratch, "candidate"), "groups")
    wanted = groups.join(classes.select("node", "lead.*"), "node")
    members = one.join(wanted, _KEY).select("root", "node", "text").dropDuplicates(["node"])
    links = scratch.table(verified(scratch.table(members, "members"), threshold, block, block_chars), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = scratch.table(components(links.select(F.col("node").alias("a"), F.col("other").alias("b")), scratch, "link"), "roots")
    least = roots.join(classes.select("node", "lead"), "node").groupBy("root").agg(F.min("lead").alias("group_lead"))
    grouped = roots.join(least, "root").select("node", "group_lead")
    return rows, classes.select("k1", "k2", "node", "lead", "class_size").join(counts, "node", "left").join(grouped, "node", "left")


def join(docs: DataFrame, **settings) -> DataFrame:
    """One row for each row of ``docs``: its class, the class's links, its group.

    ``class_id`` is the least doc_id with the same set of shingles and ``class_size`` the rows of
    that class; ``n_links`` counts the other classes at the threshold or above; ``group_id`` is
    the least doc_id that it is connected with by links. Words are compared with A-Z in small
    letters. A text of one to four words is one shingle; a null, empty or blank text is alone.
    A null doc_id comes before all others and stays null. Repeated rows are copies.

    Where an id is null or stands for several texts, unrelated classes can show the same
    ``class_id`` or ``group_id``. ``class_key`` and ``group_key``, the least row's id and text
    hashes, are equal only within a class or group; they are null without a word.
    """
    rows, classes = _classes(docs, **settings)
    known = classes.select("k1", "k2", "class_size", "n_links", "lead", F.coalesce("group_lead", "lead").alias("group_lead"))
    out = rows.select("id", F.when(F.col("n_shingles") > 0, F.col("k1")).alias("k1"), "k2").join(known, ["k1", "k2"], "left")
    real = lambda c: F.when(c != NO_ID, c)
    key = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws(":", real(F.col(f"{c}.id")), F.hex(f"{c}.h1"), F.hex(f"{c}.h2")))
    return out.select(
        real(F.col("id")).alias("doc_id"), real(F.coalesce("lead.id", "id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), real(F.coalesce("group_lead.id", "id")).alias("group_id"),
        key("lead").alias("class_key"), key("group_lead").alias("group_key"),
    )


def first_of_groups(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one row of each group: its lead, the one of the least id; all columns stay.

    A null id is the least; of several texts of that id the least hash leads. Of rows that share
    id and text one stays, any of them where other columns differ. Rows without a word are all kept.
    """
    names = [f"_near_{k}" for k in _KEY]
    _, classes = _classes(docs, **settings)
    leads = classes.select(F.coalesce("group_lead", "lead").alias("lead")).select(*[F.col(f"lead.{k}").alias(n) for k, n in zip(_KEY, names)]).distinct()
    blank = ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    words = docs.filter(~blank).select("*", *[c.alias(n) for c, n in zip(_text_key(), names)])
    words = words.join(leads, names, "left_semi").dropDuplicates(names).drop(*names)
    return words.unionByName(docs.filter(blank))
