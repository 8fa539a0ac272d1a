"""Question classification, routing and conversation handling."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens import fixed
from aidlens.functions import text

# --- classification -------------------------------------------------------

# Longest term first, then domain and term, both descending: the first hit decides.
RANKED_TERMS = sorted(
    ((len(t), domain, t) for domain, ts in fixed.DOMAIN_TERMS.items() for t in ts), reverse=True
)


def _once(rows: DataFrame, **values: Column) -> DataFrame:
    """Adds columns that later filters and expressions reuse instead of computing them again.

    A filter on an ordinary computed column is pushed below it together with a copy of its whole
    expression; the output of a one-row generator stays where it is.
    """
    return rows.select(*rows.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def classify(questions: DataFrame, question: str = "text") -> DataFrame:
    """Adds ``domain``, ``label`` and ``matched_terms``, found by substring match."""
    each = ", ".join(
        f"CASE WHEN contains(_folded, '{term}') THEN named_struct('domain', '{domain}', 'term', '{term}') END"
        for _, domain, term in RANKED_TERMS
    )
    found = F.expr(f"array_compact(array({each}))")
    hits = _once(_once(questions, _folded=text.fold_case(F.col(question))), _hits=found)
    best = F.get("_hits", F.lit(0))["domain"]
    own = F.filter("_hits", lambda h: h["domain"] == F.get("_hits", F.lit(0))["domain"])
    return _once(
        hits,
        domain=F.coalesce(best, F.lit(fixed.NO_DOMAIN)),
        label=F.coalesce(F.replace(best, F.lit("_"), F.lit(" ")), F.lit(fixed.NO_DOMAIN_LABEL)),
        matched_terms=F.transform(own, lambda h: h["term"]),
    ).drop("_folded", "_hits")


# --- routing --------------------------------------------------------------


def route(q: str, domain: str) -> Column:
    """The answer route from the names of a lower-case text and a domain column: an ordered
    cascade, the first rule that holds wins."""
    has = lambda words: text.contains_any(q, words)
    field = F.col(domain)
    return (
        F.when(field == "earthquake", "earthquake")
        .when(has(fixed.RESOURCE_WORDS), "resource")
        .when(has(fixed.UNCONNECTED_WORDS), "domain_unconnected")
        .when(has(fixed.SCAN_WORDS), "global_scan")
        .when(F.col(q).contains("assam") & has(fixed.ASSAM_FLOOD_WORDS), "assam_flood")
        .when(field == "flood", "flood")
        .when(has(fixed.WEATHER_WORDS), "weather")
        .when(has(fixed.CAPABILITY_WORDS), "capability")
        .when(field != fixed.NO_DOMAIN, "domain_report")
        .otherwise("default")
    )


def unconnected_domain(q: str) -> Column:
    """The field named by the answer of the ``domain_unconnected`` route."""
    return (
        F.when(text.contains_any(q, fixed.HEALTH_WORDS), fixed.HEALTH_LABEL)
        .when(text.contains_any(q, fixed.CONFLICT_WORDS), fixed.CONFLICT_LABEL)
        .otherwise(fixed.ECONOMY_LABEL)
    )


def death_question(question: str) -> Column:
    return text.contains_any(f"lower({question})", fixed.CASUALTY_STEMS)


def refresh_trigger(question: str) -> Column:
    """Does the question call for a refresh of the official evidence?"""
    return text.contains_any(f"lower({question})", fixed.REFRESH_TERMS)


def answer_routes(questions: DataFrame, question: str = "text") -> DataFrame:
    """Adds the intent, ``route``, ``sub_domain`` and ``death_requested``."""
    lowered = _once(classify(questions, question), _q=F.lower(question))
    routed = _once(lowered, route=route("_q", "domain"))
    return _once(
        routed,
        sub_domain=F.when(F.col("route") == "domain_unconnected", unconnected_domain("_q")),
        death_requested=text.contains_any("_q", fixed.CASUALTY_STEMS),
    ).drop("_q")


# --- conversations --------------------------------------------------------

BLOCK = 1000


def number_messages(messages: DataFrame) -> DataFrame:
    """Adds ``pos``, the dense 0-based position of a message in its conversation.

    Conversations are cut into blocks of turn numbers, so that even one that holds a large share
    of all rows is numbered by many tasks: row numbers inside the block, plus the running total
    of the blocks before it. ``(conv_id, turn)`` must be unique.
    """
    blocked = messages.withColumn("_block", F.floor(F.col("turn") / BLOCK))
    earlier = W.partitionBy("conv_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("conv_id", "_block")
        .agg(F.count("*").alias("_rows"))
        .select("conv_id", "_block", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy("conv_id", "_block").orderBy("turn")
    return (
        blocked.withColumn("_row", F.row_number().over(inside) - 1)
        .join(starts, ["conv_id", "_block"])
        .withColumn("pos", F.col("_start") + F.col("_row"))
        .select(*messages.columns, "pos")
    )


def conversation_context(messages: DataFrame, depth: int = fixed.HISTORY_MESSAGES) -> DataFrame:
    """Adds ``history``: the ``depth`` previous messages as ``ROLE: text`` lines.

    Runs in blocks of positions. The last ``depth`` messages of a block are also sent to the next
    one, so the window never needs a whole conversation in one task.
    """
    if not 0 < depth <= BLOCK:
        raise ValueError(f"depth must lie in 1..{BLOCK}")
    block = F.floor(F.col("pos") / BLOCK)
    targets = F.when(
        F.col("pos") % BLOCK >= BLOCK - depth, F.array(F.lit(0), F.lit(1))
    ).otherwise(F.array(F.lit(0)))
    sent = (
        number_messages(messages)
        .withColumn("_ahead", F.explode(targets))
        .withColumn("_block", block + F.col("_ahead"))
    )
    before = W.partitionBy("conv_id", "_block").orderBy("pos").rowsBetween(-depth, -1)
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return (
        sent.withColumn("history", F.array_join(F.collect_list(line).over(before), "\n"))
        .filter("_ahead = 0")
        .select(*messages.columns, "history")
    )


def routing_text(messages: DataFrame, use_history: bool = True) -> DataFrame:
    """Adds ``routing_text``: the history block, if there is one, and the current message."""
    if not use_history:
        return messages.withColumn("routing_text", F.col("text"))
    block = F.concat(
        F.lit(fixed.HISTORY_HEADING + "\n"), F.col("history"),
        F.lit("\n\n" + fixed.CURRENT_MESSAGE), F.col("text"),
    )
    return (
        conversation_context(messages)
        .withColumn("routing_text", F.when(F.col("history") != "", block).otherwise(F.col("text")))
        .drop("history")
    )


def conversation_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("messages"))


def conversation_transcript(messages: DataFrame, part_messages: int = 500) -> DataFrame:
    """The transcript of every conversation in numbered parts of ``part_messages`` messages.

    Parts in order, joined by a blank line, are the whole transcript. Cutting it keeps a very
    long conversation out of one task and out of one string.
    """
    line = F.concat(text.title_case(F.col("role")), F.lit(": "), F.col("text"))
    parts = number_messages(messages).withColumn("part", F.floor(F.col("pos") / part_messages).cast("int"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return parts.groupBy("conv_id", "part").agg(
        F.array_join(F.transform(ordered, lambda m: m["line"]), "\n\n").alias("transcript")
    )


def exported_transcripts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """One export per known conversation, with a note where it has no messages."""
    return (
        conversations.select("conv_id").distinct()
        .join(conversation_transcript(messages), "conv_id", "left")
        .select(
            "conv_id",
            F.coalesce("part", F.lit(0)).alias("part"),
            F.coalesce(F.nullif("transcript", F.lit("")), F.lit(fixed.EMPTY_TRANSCRIPT)).alias("transcript"),
        )
    )


def conversation_titles(messages: DataFrame) -> DataFrame:
    """The first message of each conversation, shortened, names it."""
    first = W.partitionBy("conv_id").orderBy("turn")
    return (
        messages.withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .select("conv_id", text.shortened(F.col("text")).alias("title"))
    )


# --- attachments ----------------------------------------------------------


def document_excerpt(mime: Column, content: Column) -> Column:
    """The leading text of a text attachment; other types get a note."""
    return F.when(
        mime.isin(fixed.TEXT_MIME_TYPES), F.left(content, F.lit(fixed.EXCERPT_CHARS))
    ).otherwise(F.lit(fixed.BINARY_ATTACHMENT))


def attachment_label(document: Column, camera: Column) -> Column:
    return F.coalesce(document, camera, F.lit(fixed.NO_ATTACHMENT))
