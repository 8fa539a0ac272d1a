"""One query for each operator, over its whole table, with production parameters."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aidlens.llm import (
    common, decontamination, html_text, middle, near_duplicates, oracles, packing, pair_index, pii, quality_rules, ranked_search, suffix_tree,
    token_counts, training_order, weak_labels,
)

ORDER_KEY = 20_260_817


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer of the whole table, after four batches.

    All rows are inserted, that batch is sent again, a tenth of the ids is revised to other texts
    while another tenth is deleted, and both are brought back, so the totals are the table's.
    """
    store = common.Scratch(spark, "counts").folder
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    part = F.pmod("doc_id", F.lit(10))
    load = docs.withColumn("op", F.lit("insert"))
    token_counts.commit(load, store, "load")
    token_counts.commit(load, store, "load")  # the repeat of a batch adds nothing
    changed = docs.withColumns({"source": F.lit("revised"), "text": F.upper("text"), "op": F.when(part == 0, "revise").otherwise("delete")})
    token_counts.commit(changed.filter(part < 2), store, "change")
    token_counts.commit(docs.withColumn("op", F.when(part == 0, "revise").otherwise("insert")).filter(part < 2), store, "restore")
    return token_counts.totals(spark, store)


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and place of every sequence, read back from the shards."""
    store = common.Scratch(spark, "shards").folder
    return training_order.described(training_order.materialise(_table(spark, sf_dir, "documents"), store, ORDER_KEY))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    forest = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.measured(docs, forest).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept", "anomaly")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"), suffix_tree.Limits(stay=False))


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return weak_labels.classify(docs, weak_labels.fit(docs))


def op11_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = common.Scratch(spark, "ranked").table(ranked_search.build(_table(spark, sf_dir, "documents")), "index")
    return ranked_search.search(index, _table(spark, sf_dir, "benchmark"))


def op13_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = pair_index.decode(pair_index.encode(docs).drop("text"))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_training_order, op3_pii, op4_quality_rules, op5_near_duplicates, op6_packing, op7_decontamination, op8_html_text,
        op9_suffix_tree, op10_weak_labels, op11_middle, op12_ranked_search, op13_pair_index,
    )
}
#: Those that SQL can say; each other one has a brute-force test instead.
ORACLES: dict[str, str] = oracles.ORACLES
