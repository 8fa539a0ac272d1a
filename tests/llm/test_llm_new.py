"""Operators 11 to 13: fill-in-middle, ranked search, BPE by a pair index."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from aidlens.llm import common, middle, oracles, pair_index, queries, ranked_search, tokens
from compare import differences, duck
from conftest import SMALL

from .conftest import ODD, prose

# --- fill-in-middle ---------------------------------------------------------

MIXED = ["", "a", "é", "ab" * 5000, "é😀x" * 3000, "one two  three\n\nfour", prose(3000, 4), "😀" * 1025, " " * 40]


@pytest.mark.parametrize("unit", [None, r"\S+\s*", r"[a-z]+", r"\n\n|[^\n]+"])
def test_every_cut_equals_a_count_from_the_start(unit):
    pattern = re.compile(unit) if unit else None
    for text in MIXED:
        starts, at = [], 0
        while at < len(text):  # units counted one by one
            m = pattern.match(text, at) if pattern else None
            starts.append(at)
            at = m.end() if m else at + 1
        cutter = middle.Cutter(text, pattern, block=64)
        assert (cutter.n, cutter.points) == (len(starts), len(text))
        for k in {0, 1, 2, 63, 64, 65, len(starts) // 2, len(starts) - 1, len(starts), *random.Random(1).sample(range(len(starts) + 1), min(30, len(starts)))}:
            if 0 <= k <= len(starts):
                place = [*starts, len(text)][k]
                assert cutter.cut(k) == (len(text[:place].encode()), place)


def test_the_tree_sums_and_finds_blocks():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, (2, size))
        tree = middle.Fenwick(counts)
        held = np.repeat(np.arange(size), counts[0])
        for k, block in enumerate(held.tolist()):
            assert tree.descend(k) == (block, counts[:, :block].sum(axis=1).tolist())


def test_forms_and_way_back():
    seen = Counter()
    for doc in range(400):
        text = random.Random(doc).choice([*MIXED, "<P", "<S", "M>", "a<P><S>", "x<M>", "<<<S"])
        n, form, a, b, output = middle.transformed(text, doc)
        seen[form] += 1
        assert n == len(text) and middle.restored(output, form) == text
        if form != "plain":
            assert 0 <= a <= a + b <= n and len(output) == n + 9
            parts = text[:a], text[a : a + b], text[a + b :]
            assert output == ("<P>{0}<S>{2}<M>{1}" if form == "psm" else "<S>{2}<P>{0}<M>{1}").format(*parts)
    assert set(seen) == {"plain", "spm", "psm"}
    assert all(middle.transformed(t, 7)[1] == "plain" for t in ("", "<P>", "a<S>b", "<M>"))


def test_middle_of_odd_rows(odd, docs_of):
    rows = middle.transform(odd).collect()
    assert len(rows) == len(ODD) and sorted(r.restored for r in rows) == sorted(t or "" for _, t in ODD)
    assert middle.transform(docs_of([])).collect() == []


# --- ranked search ----------------------------------------------------------


def ranked(docs, items, limit=20):
    """All pairs, scored as the definition says."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(cut(t))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    count, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in cut(text) if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, k, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:limit], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **how):
    index = common.Scratch(spark, "test").table(ranked_search.build(docs), "index")
    frame = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, ranked_search.search(index, frame, **how).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("how", [{}, {"limit": 3}, {"most_terms": 30, "limit": 5}, {"most_items": 2}])
def test_search_equals_scores_of_all_pairs(spark, docs_of, how):
    docs = [(k, prose(20 + 40 * (k % 7), k % 40, 60 + k % 5)) for k in range(300)] + [(k, prose(30, 1, 60)) for k in range(300, 340)]
    docs += [(500, "Äpfel ÄPFEL 1 apfel's"), (501, "x" * 50_000), (502, prose(8_000, 3, 5_000))]
    items = [(k, prose(15, k, 60)) for k in range(12)] + [(12, "Äpfel apfel s 1"), (13, "zzzz yyyy"), (14, prose(3, 2, 60) * 4)]
    assert searched(spark, docs_of(docs), items, **how) == ranked(docs, items, how.get("limit", 20))


def test_search_bears_odd_rows(spark, odd, docs_of):
    items = [(1, ODD[5][1]), (2, None), (3, ""), (4, "!?"), (5, "word ñandú"), (5, "word ñandú"), (None, "a text")]
    assert searched(spark, odd, items) == ranked(ODD, items)
    assert searched(spark, docs_of([]), items) == []
    assert searched(spark, docs_of([(1, None), (2, " ")]), items) == []
    assert searched(spark, odd, []) == []


def test_bounds_hold_and_few_rows_are_scored(spark, docs_of):
    docs = [(k, prose(60 + k % 300, k, 400)) for k in range(3000)]
    block = ranked_search.Block([ranked_search.terms(prose(20, k, 400)) for k in range(5)])
    index = common.Scratch(spark, "test").table(ranked_search.build(docs_of(docs)), "index")
    df = ranked_search.document_counts(index, block)
    total = sum(len(ranked_search.terms(t)) for _, t in docs)
    searcher = ranked_search.Searcher(block, block.weights(df, 3000), 3000, total, 20)
    for batch in index.toArrow().to_batches():
        m = 75 + (25 * batch.column("n").to_numpy() * 3000) // total
        exact = searcher._impacts(batch, m, np.arange(batch.num_rows)) @ searcher.weights
        assert (searcher.bounds(batch, m) >= exact).all()
        searcher.add(batch)
    assert searcher.rescored < 3000 * 5 / 4


def test_counts_beyond_a_sketch_still_bound(spark, docs_of):
    docs = [(1, "ab " * 70_000), (2, "ab cd"), (3, "cd " * 9)]
    assert searched(spark, docs_of(docs), [(1, "ab cd")]) == ranked(docs, [(1, "ab cd")])


# --- BPE --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(f"{tokens.folder()}/{tokens.WORD_BPE}")


SIGNS = "abcdeABC 'stremldv0129.,!<|>éÀßÿ×÷\n\t\r\x0b\x1c\x85\xa0ªµ́ΣςİǅẞﬁⅣ½你😀‍　﻿"


def test_encoding_equals_the_library(library):
    rng = random.Random(11)
    encoder = pair_index.Encoder(f"{tokens.folder()}/{tokens.WORD_BPE}", keep=200)
    for _ in range(60):
        texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) + rng.choice(["", "<|endoftext|>", "<|startoftext|>x", "'ll've's"]) for _ in range(40)]
        got = [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert len(encoder.known) <= 200


@pytest.mark.parametrize("texts", [["你好"], ["<|endoftext|>"], ["\x85"], [""], [" \n"], ["你好", ""], ["a"], ["a", "你"], ["<|endoftext|>a<|startoftext|>"]])
def test_blocks_with_chunks_of_one_kind(library, texts):
    encoder = pair_index.Encoder(f"{tokens.folder()}/{tokens.WORD_BPE}")
    for _ in range(2):  # new chunks, then remembered ones
        assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_and_repeats(library):
    encoder = pair_index.Encoder(f"{tokens.folder()}/{tokens.WORD_BPE}")
    texts = ["a" * 9_999, "ab" * 200_000, "!" * 5_000, "lalala" * 4000, "1" * 3000, "é" * 4_001]
    assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_encode_and_decode_rows(spark, odd, docs_of, library):
    rows = pair_index.decode(pair_index.encode(odd)).collect()
    assert len(rows) == len(ODD) and {"node", "lang"} <= set(rows[0].asDict())
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)
    empty = pair_index.decode(pair_index.encode(docs_of([])))
    assert empty.collect() == [] and empty.schema["ids"].dataType.simpleString() == "array<int>"
    nulls = spark.createDataFrame([(1, None), (2, [320])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pair_index.decode(nulls).collect())) == [(1, None, ""), (2, [320], "a</w>")]


def test_bpe_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = queries.op13_pair_index(spark, SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(" ".join(map(str, ids))))
        assert r.decoded_sha256 == digest(library.decode(ids, skip_special_tokens=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_its_sql(spark, name):
    rows, complaints = differences(spark, duck(SMALL), queries.QUERIES[name], oracles.ORACLES[name], SMALL)
    assert rows and not complaints
