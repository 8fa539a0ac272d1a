"""Operators 5 and 9 and the pipeline: near duplicates, suffix tree, stages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from aidlens.llm import common, near_duplicates, suffix_tree
from conftest import SMALL

from .conftest import ODD, prose


def sets_of(text):
    words = (text or "").encode().lower().split()
    width = min(5, len(words))
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1)) if words else None


def brute(rows):
    """(id, class id, class size, links, group) of each row, by comparing all pairs."""
    key = lambda k: (rows[k][0] is not None, rows[k][0] or 0)
    classes = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        s = sets_of(t)
        classes[s if s else k].append(k)
    lead = {s: min(v, key=key) for s, v in classes.items()}
    real = [s for s in classes if isinstance(s, frozenset)]
    links, root = Counter(), {lead[s]: lead[s] for s in real}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for x, s in enumerate(real):
        for t in real[:x]:
            if len(s & t) * 9 >= 4 * (len(s) + len(t)):
                links[lead[s]] += 1
                links[lead[t]] += 1
                a, b = sorted((find(lead[s]), find(lead[t])), key=key)
                root[b] = a
    out = []
    for s, v in classes.items():
        for k in v:
            c = lead[s]
            g = find(c) if c in root else c
            out.append((rows[k][0], rows[c][0], len(v), links[c], rows[g][0]))
    return sorted(out, key=str)


def joined(df, **settings):
    return sorted([(r.doc_id, r.class_id, r.class_size, r.n_links, r.group_id) for r in near_duplicates.join(df, **settings).collect()], key=str)


def variants(seed, n, changes, words=160):
    rng, base = random.Random(seed), prose(words, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_equals_brute_force(docs_of):
    texts = [*variants(1, 40, 2), *variants(2, 15, 4), *variants(3, 6, 9), *[prose(60, k) for k in range(30)], "a b", "a  b", "A B", "a b c d e f"]
    texts += [f"{prose(60, 77)} {prose(40, 100 + k)}" for k in range(25)]  # one passage in many texts
    rows = list(enumerate(texts)) + [(900 + k, texts[0]) for k in range(20)]
    df = docs_of(rows, extra=True)
    want = brute(rows)
    assert joined(df) == want
    # the same in many small blocks of trie nodes and of groups
    assert joined(df, block=7, block_chars=4000) == want


def test_join_of_odd_rows(odd, docs_of):
    assert joined(odd) == brute(ODD)
    assert joined(docs_of([])) == []
    assert joined(docs_of([(1, None), (2, "")])) == brute([(1, None), (2, "")])


def test_first_of_groups(odd, docs_of):
    kept = near_duplicates.first_of_groups(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "7", "8", "None", "None"]
    rows = list(enumerate(variants(5, 12, 2) + [prose(80, k) for k in range(5)]))
    assert sorted(r.doc_id for r in near_duplicates.first_of_groups(docs_of(rows)).collect()) == [0, 12, 13, 14, 15, 16]


@pytest.mark.parametrize("shared", [None, 7])
def test_unrelated_texts_of_one_id_stay_apart(docs_of, shared):
    near = variants(8, 3, 1)
    alone = [prose(80, k) for k in range(300, 306)]
    # one id of many texts, of which one is near another id's text, and of which one is repeated
    rows = [(shared, t) for t in [*alone, alone[0], near[0]]] + [(9, near[1]), (10, near[2]), (11, prose(80, 311))]
    df = docs_of(rows, extra=True)
    assert joined(df) == brute(rows)
    found = near_duplicates.join(df).collect()
    assert len({r.class_key for r in found}) == 10
    assert len({r.group_key for r in found}) == 8
    kept = near_duplicates.first_of_groups(df).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([(str(shared), t) for t in [*alone, near[0]]] + [("11", rows[-1][1])])


def test_depth_shortens_to_the_target():
    assert near_duplicates.matched_depth(0.8, 20, 6, 0.9999) == 4
    assert near_duplicates.matched_depth(0.8, 20, 6, 0.5) == 6
    assert near_duplicates.matched_depth(0.8, 1, 6, 0.9999) == 1


def test_minima_agree_as_often_as_sets():
    rng = np.random.default_rng(6)
    signer = near_duplicates.Signer(100, 6, 4)
    for share in (0.2, 0.5, 0.8):
        both = rng.integers(0, 1 << 63, 1000, np.uint64)
        a, b = np.concatenate([both, rng.integers(0, 1 << 63, int(500 * (1 / share - 1)), np.uint64)]), np.concatenate([both, rng.integers(0, 1 << 63, int(500 * (1 / share - 1)), np.uint64)])
        agree = (signer.minima(a) == signer.minima(b)).mean()
        assert abs(agree - 1000 / (len(a) + len(b) - 1000)) < 0.07


def test_shared_counts_in_chunks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    for cells in (10, 10_000):
        assert near_duplicates.shared_counts(sets[:5], sets[5:], cells).tolist() == want


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(7, 7)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in near_duplicates.components(df, common.Scratch(spark, "t"), "c").collect()}
    assert got == {k: find(k) for k in root}


# --- suffix tree ------------------------------------------------------------


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")) + [None]


def held_out(id_):
    return id_ is not None and zlib.crc32(str(id_).encode()) % 5 == 1


def base_scores(rows):
    train = Counter(t for i, x in rows if not held_out(i) for t in tokens_of(x))
    total, kinds = sum(train.values()), len(train)
    out = []
    for i, x in rows:
        t = tokens_of(x)
        score = sum(math.log10((train[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in t)
        out.append((i, held_out(i), len(t), sum(train[w] > 0 for w in t), total, round(score, 6)))
    return sorted(out, key=str)


def hash_of(word):
    return int(suffix_tree.END) if word is None else xxhash.xxh3_64_intdigest(word.encode())


def tree_scores(rows, limits, dealt):
    """Scores of a tree that is grown and pruned in plain Python; contexts of ``dealt`` hashes stay."""
    train = [tokens_of(x) for i, x in rows if not held_out(i)]
    counts = Counter(w for t in train for w in t)
    total, classes = sum(counts.values()), min(limits.classes, max(1, len(counts) // 16))
    known = {w for w, n in counts.items() if n >= max(1, limits.known * total)}
    signed = lambda w: hash_of(w) - (1 << 64) * (hash_of(w) >> 63)
    of = lambda w: w if w in known else signed(w) % classes
    mass = {c: 0.5 for c in range(classes)} | {w: counts[w] + 0.5 for w in known}
    for w in set(counts) - known:
        mass[of(w)] += counts[w] + 0.5
    norm = sum(mass.values())
    follow = defaultdict(Counter)
    for t in train:
        for k in range(1, len(t)):
            for d in range(1, min(k, limits.depth) + 1):
                follow[tuple(t[k - d : k])][of(t[k])] += 1
    follow = {c: n for c, n in follow.items() if sum(n.values()) >= limits.least}

    def chance(context, symbol, nodes):
        p = mass[symbol] / norm
        for d in range(1, len(context) + 1):
            c = tuple(context[-d:])
            if c not in nodes:
                break
            n, kinds = sum(follow[c].values()), len(follow[c])
            p = (follow[c][symbol] + kinds * p) / (n + kinds)
        return p

    def context_hash(c):
        return int(common.signed(suffix_tree.context_hashes([suffix_tree.shortened(np.array([hash_of(w)], np.uint64)) for w in c[::-1]])[-1])[0])

    keep = set()
    for c, n in follow.items():
        size = sum(n.values())
        gain = sum(k * math.log(k / size / chance(c[1:], w, follow)) for w, k in n.items())
        if gain > 0.5 * len(n) * math.log(max(size, 2)) or context_hash(c) in dealt:
            keep |= {c[k:] for k in range(len(c))}
    out = []
    for i, x in rows:
        t, score = tokens_of(x), 0.0
        for k, w in enumerate(t):
            score += math.log10(chance(t[max(0, k - limits.depth) : k], of(w), keep))
            if w not in known:
                score += math.log10((counts[w] + 0.5) / mass[of(w)])
        out.append((i, round(score, 6)))
    return sorted(out, key=str)


def scored(df, limits=None):
    rows = suffix_tree.score(df, limits).collect()
    base = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows], key=str)
    return base, sorted([(r.doc_id, round(r.score, 6)) for r in rows], key=str)


def language(n, seed):
    rng, out = random.Random(seed), ["the"]
    for _ in range(n):
        out.append({"the": ["cat", "dog"], "cat": ["sat", "ran"], "dog": ["ran"], "sat": ["on"], "ran": ["to"], "on": ["the"], "to": ["the", "a"]}.get(out[-1], ["the"])[rng.randrange(10) % 2 if out[-1] in ("the", "cat", "to") else 0])
        if rng.random() < 0.1:
            out.append(f"rare{rng.randrange(60)}")
    return " ".join(out)


@pytest.mark.parametrize("limits", [
    suffix_tree.Limits(), suffix_tree.Limits(known=0.01, classes=3), suffix_tree.Limits(known=0.5, least=4, depth=2),
    suffix_tree.Limits(known=0.01, classes=3, bucket=300), suffix_tree.Limits(bucket=20, depth=2),
])
def test_scores_equal_a_plain_tree(docs_of, limits):
    rows = [(k, language(60, k)) for k in range(60)]
    df = docs_of(rows, extra=True).repartition(3, "doc_id")
    routing = suffix_tree.learn_routing(suffix_tree.prepared(df), limits)
    dealt = {int(k) for keys in routing.keys for k in keys}
    assert bool(dealt) == (routing.buckets > 1) == (limits.bucket < 1000)
    base, tree = scored(df, limits)
    assert base == base_scores(rows)
    plain = tree_scores(rows, limits, dealt)
    assert [k for k, _ in tree] == [k for k, _ in plain]
    assert [s for _, s in tree] == pytest.approx([s for _, s in plain], abs=1e-5)


def test_one_text_of_one_word_in_most_rows(docs_of):
    """Every context of it is too frequent for a bucket, at every length."""
    limits = suffix_tree.Limits(bucket=100)
    rows = [(k, "again " * 30) for k in range(40)] + [(k, language(20, k)) for k in range(40, 60)]
    df = docs_of(rows)
    routing = suffix_tree.learn_routing(suffix_tree.prepared(df), limits)
    assert all(len(k) for k in routing.keys)
    base, tree = scored(df, limits)
    assert base == base_scores(rows)
    plain = tree_scores(rows, limits, {int(k) for keys in routing.keys for k in keys})
    assert [s for _, s in tree] == pytest.approx([s for _, s in plain], abs=1e-5)


def after_two(n, seed):
    """The word after next is the same after one word; a single word tells nothing of the next."""
    rng, out = random.Random(seed), []
    for k in range(n):
        out.append("w0" if k > 1 and out[-2] == "w0" and rng.random() < 0.9 else f"w{rng.randrange(8)}")
    return " ".join(out)


@pytest.mark.parametrize("bucket", [1_000_000, 300, 100, 20])
def test_scores_do_not_depend_on_the_buckets(docs_of, bucket):
    """Contexts that are dealt out are tested as others are, with the longer ones of all buckets."""
    rows = [(k, after_two(50, k)) for k in range(60)] + [(k, "again " * 30) for k in range(60, 70)]
    limits = suffix_tree.Limits(bucket=bucket, stay=False)
    df = docs_of(rows).repartition(3, "doc_id")
    routing = suffix_tree.learn_routing(suffix_tree.prepared(df), limits)
    dealt = {int(k) for keys in routing.keys for k in keys}
    assert bool(dealt) == (bucket < 1000)
    _, tree = scored(df, limits)
    plain = [s for _, s in tree_scores(rows, limits, set())]
    assert [s for _, s in tree] == pytest.approx(plain, abs=1e-4)
    if bucket <= 100:
        assert [s for _, s in tree_scores(rows, limits, dealt)] != pytest.approx(plain, abs=1e-4)


def test_contexts_stay_whole_up_to_two_buckets(docs_of):
    """Fewer are dealt out and counted beforehand; no bucket holds much more than the largest of them."""
    rows = [(k, after_two(50, k)) for k in range(60)] + [(k, "again " * 30) for k in range(60, 70)]
    routing = suffix_tree.learn_routing(suffix_tree.prepared(docs_of(rows)), suffix_tree.Limits(bucket=200))
    tokens, lengths = suffix_tree.token_hashes([x for _, x in rows], common.WordHashes())
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = np.flatnonzero(place)
    pairs = Counter(common.signed(suffix_tree.shortened(tokens[at - 1])).tolist())
    assert 0 < len(routing.keys[0]) and len(routing.whole[0][0])
    for hash_, n in pairs.items():
        assert (hash_ in routing.keys[0]) == (n > 2 * len(at) / routing.buckets)
    bucket = suffix_tree.route(routing, tokens, place, at, at)
    assert np.bincount(bucket, minlength=routing.total).max() <= 3 * 200


def test_scores_of_odd_rows(odd, docs_of):
    base, _ = scored(odd)
    assert base == base_scores(ODD)
    assert scored(docs_of([])) == ([], [])
    only = [(next(k for k in range(99) if held_out(k)), "never seen")]
    assert scored(docs_of(only))[0] == base_scores(only)


def test_the_tree_predicts_held_out_rows_better(spark):
    rows = suffix_tree.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").collect()
    assert sum(r.score for r in rows) > 1.01 * sum(r.base_score for r in rows)


def test_the_tree_grows_with_the_corpus(docs_of):
    """More text of the same kind gives more contexts of two words or more, none left out by a share."""
    def bigrams(n):
        rng = random.Random(7)
        words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(n)]
        pairs = Counter(zip(words, words[1:]))
        return sum(k > 1 for k in pairs.values()), [(1 + k, " ".join(words[k * 500 : (k + 1) * 500])) for k in range(n // 500)]

    few, many = bigrams(2_000), bigrams(20_000)
    assert many[0] > 4 * few[0]
    for _, rows in (few, many):
        _, tree = scored(docs_of(rows))
        plain = tree_scores(rows, suffix_tree.Limits(), set())
        assert [s for _, s in tree] == pytest.approx([s for _, s in plain], abs=1e-4)


def test_chances_sum_to_one():
    start = np.array([0.2, 0.3, 0.5])
    symbols = np.array([1] * 20 + [2] * 4 + [0, 1, 2])
    train = np.array([1] * 24 + [0] * 3)
    contexts = [np.full(27, 5), np.repeat([6, 7, 6], [18, 6, 3])]
    p = suffix_tree.chances(symbols, contexts, np.full(27, 2), train, start, 2, {})
    assert p[-3:].sum() == pytest.approx(1) and p[-2] > 0.8
    dealt = {5: (np.array([0, 1]), np.array([2, 40]))}
    p = suffix_tree.chances(symbols, contexts[:1], np.full(27, 2), train, start, 2, dealt)
    assert p[-3:].sum() == pytest.approx(1) and p[-3] == pytest.approx((2 + 2 * 0.2) / 44)


# --- pipeline ---------------------------------------------------------------


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    left = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = common.Scratch(spark, "stages").table(stage(spark, docs, SMALL), "docs")
        assert out.columns == docs.columns
        left.append(out.count())
        docs = out
    assert left[0] > left[1] >= left[2] > left[3] == left[4] > 0
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert placed.select("doc_id").distinct().count() == left[-1]


def test_stages_over_odd_rows(spark, odd, docs_of):
    for docs in (odd, docs_of([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SMALL).columns == docs.columns
            stage(spark, docs, SMALL).count()
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.count() > 0
