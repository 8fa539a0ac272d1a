"""Operators 1, 2 and 6: token counts, training order, packing."""

import uuid
import zlib
from collections import defaultdict

import numpy as np
import pytest
from aidlens.llm import common, packing, queries, token_counts, tokens, training_order
from aidlens.session import shared_folder
from conftest import SMALL
from tokenizers import Tokenizer

from .conftest import ODD, prose

PLAIN = Tokenizer.from_file(tokens.folder() + tokens.WORD_BPE)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    *[t for _, t in ODD if t and len(t) < 2000], "<|endoftext|> a<|startoftext|>b", "I'll don't 's 've", "ÀÉ ÿß ÷× é İ Σας ΣΑΣ", "a\x1cb\x0bc\x0cd\x85e f",
    "x" * 3000, "1234 a1b2 !!!??? a.b,c...", "\t\ta  b\n\nc ",
])
def test_ids_equal_the_tokenizers(text):
    assert np.frombuffer(tokens.load(tokens.folder() + tokens.WORD_BPE).encode(text), "<u4").tolist() == ids_of(text)


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def totals(spark, store):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.chars, r.tokens) for r in token_counts.totals(spark, store).collect()}


def test_rollup_follows_signed_changes(spark):
    store, schema = folder(spark, "counts"), "doc_id long, source string, lang string, text string, op string"
    commit = lambda name, *rows: token_counts.commit(spark.createDataFrame(list(rows), schema), store, name, ("word_bpe_49k",))
    assert totals(spark, store) == {}
    assert commit("a", (1, "s", "en", "one two", "insert"), (2, "s", "en", None, "insert"), (None, None, "en", "x", "insert"))
    two = len(ids_of("one two"))
    first = {("s", "en", "word_bpe_49k"): (2, 7, two), (None, "en", "word_bpe_49k"): (1, 1, 1)}
    assert totals(spark, store) == first
    assert not commit("a", (9, "s", "en", "again", "insert"))
    assert totals(spark, store) == first
    assert commit("b", (1, "t", "de", "three", "revise"), (2, None, None, None, "delete"), (2, None, None, None, "delete"), (77, None, None, None, "delete"))
    assert totals(spark, store) == {("t", "de", "word_bpe_49k"): (1, 5, len(ids_of("three"))), (None, "en", "word_bpe_49k"): (1, 1, 1)}
    assert commit("c", (1, None, None, None, "delete"), (None, None, None, None, "delete"))
    assert totals(spark, store) == {(None, "en", "word_bpe_49k"): (1, 1, 1)}


def test_a_batch_that_failed_is_written_over(spark):
    store, schema = folder(spark, "counts"), "doc_id long, source string, lang string, text string, op string"
    half = spark.createDataFrame([("s", "en", "word_bpe_49k", 5, 5, 5)], "source string, lang string, tokenizer string, documents long, chars long, tokens long")
    half.write.parquet(f"{store}/rollup/batch=a")
    assert totals(spark, store) == {}
    token_counts.commit(spark.createDataFrame([(1, "s", "en", "x", "insert")], schema), store, "a", ("word_bpe_49k",))
    assert totals(spark, store) == {("s", "en", "word_bpe_49k"): (1, 1, 1)}


def test_unknown_changes_are_refused(spark):
    schema = "doc_id long, source string, lang string, text string, op string"
    with pytest.raises(Exception, match="unknown op"):
        token_counts.commit(spark.createDataFrame([(1, "s", "en", "x", "upsert")], schema), folder(spark, "counts"), "a")


def test_counts_by_both_versions(spark):
    import tiktoken  # noqa: F401

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    other = tokens.load(tokens.folder() + tokens.BYTE_BPE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count(docs).collect():
        want = len(ids_of(texts[r.doc_id])) if r.tokenizer == "word_bpe_49k" else other.count(texts[r.doc_id])
        assert (r.tokens, r.chars, r.documents) == (want, len(texts[r.doc_id]), 1)


# --- training order ---------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_and_keyed(n):
    a, b = (training_order.permuted(np.arange(n), n, key) for key in (1, 2))
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n))
    assert n < 16 or (a != b).any()
    assert n < 16 or (a != np.arange(n)).any()


def check_order(spark, docs, rows):
    store = folder(spark, "shards")
    out = training_order.materialise(docs, store, 7, stride=64, shard_rows=50).collect()
    pieces = []
    for id_, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*ids_of(t), 0]
        pieces += [(id_, k // 64, ids[k : k + 64]) for k in range(0, len(ids), 64)]
    assert sorted(r.slot for r in out) == sorted(r.number for r in out) == list(range(len(pieces)))
    slots = training_order.permuted(np.arange(len(pieces)), len(pieces), 7)
    by_number = {r.number: r for r in out}
    assert [by_number[k].slot for k in range(len(pieces))] == slots.tolist()
    got = [(r.doc_id, r.piece, training_order.decoded(r.payload, r.length).tolist()) for _, r in sorted(by_number.items())]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])
    assert sorted(got, key=order) == sorted(pieces, key=order)
    assert [g[0] for g in got] == [p[0] for p in pieces]
    for r in out:
        assert (r.shard, r.place, len(r.payload)) == (r.slot // 50, r.slot % 50, 128)
    return store, out


def test_order_equals_brute_force(spark, odd):
    store, out = check_order(spark, odd, ODD)
    part = training_order.read(spark, store, 60, 130, shard_rows=50).collect()
    assert sorted(r.slot for r in part) == list(range(60, min(130, len(out))))
    shown = training_order.described(training_order.read(spark, store, shard_rows=50)).collect()
    payload = {r.slot: training_order.decoded(r.payload, r.length) for r in out}
    assert all(r.ids_crc32 == training_order.crc32(payload[r.slot]) for r in shown)


def test_order_does_not_depend_on_partitions(spark, docs_of):
    rows = [(k, prose(30 + k, k)) for k in range(40)]
    a, b = (
        {(r.doc_id, r.piece): r.slot for r in training_order.materialise(d, folder(spark, "shards"), 3, stride=32).collect()}
        for d in (docs_of(rows).coalesce(1), docs_of(rows[::-1]).repartition(5))
    )
    assert a == b


def test_order_of_no_documents(spark, docs_of):
    assert training_order.materialise(docs_of([]), folder(spark, "shards"), 3).count() == 0


# --- packing ----------------------------------------------------------------


def check_packing(rows, out, capacity):
    want = []
    for id_, t in rows:
        ids = np.array([*ids_of(t), 0], "<u4")
        want += [(id_, k // capacity, k, len(p := ids[k : k + capacity]), zlib.crc32(p.tobytes())) for k in range(0, len(ids), capacity)]
    order = lambda x: (x[0] is None, x)
    key = lambda x: (x[0] is None, *[v or 0 for v in x])
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=key) == sorted(want, key=key)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


@pytest.mark.parametrize("capacity,group", [(64, 7), (256, 1000), (2048, 200_000)])
def test_packing_is_whole_and_tight(odd, capacity, group):
    out = packing.pack(odd, capacity, nearly=2, group_items=group).collect()
    check_packing(ODD, out, capacity)


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bins, total = check_packing(rows, packing.pack(docs.repartition(4)).collect(), 2048)
    assert bins <= -(-total // 2048) * 1.02 + 1


def test_items_that_never_pair_end(docs_of):
    rows = [(k, " ".join(["a"] * 40)) for k in range(60)]
    out = packing.pack(docs_of(rows), 64, nearly=2, group_items=5).collect()
    assert check_packing(rows, out, 64)[0] == 60


def test_packing_of_no_documents(docs_of):
    assert packing.pack(docs_of([])).collect() == []


def test_best_fit_takes_the_tightest_bin():
    bin_of, offset, fill = packing.best_fit(np.array([6, 5, 4, 5]), 10)
    assert fill.tolist() == [10, 10] and sorted(zip(bin_of.tolist(), offset.tolist())) == [(0, 0), (0, 6), (1, 0), (1, 5)]


def test_sorted_runs_span_batches():
    import pyarrow as pa

    batches = [pa.record_batch({"k": pa.array(k, pa.int64())}) for k in ([1, 1], [1, 2], [], [2, 2], [3])]
    got = [t.column("k").to_pylist() for t in common.runs(batches, ["k"])]
    assert sum(got, []) == [1, 1, 1, 2, 2, 2, 3]
    assert all(not set(a) & set(b) for a, b in zip(got, got[1:]))


def test_query_of_counts_restores_the_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = token_counts._sums(token_counts.count(docs), *token_counts.KEYS)
    assert sorted(map(tuple, queries.op1_token_counts(spark, SMALL).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
