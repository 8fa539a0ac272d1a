"""Answers built from data: situation reports, resource and hazard answers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aidlens import fixed
from aidlens.functions import text

# Input columns of ``situation_report``; any that is missing counts as not reported.
FACTS = {
    "location": "string",
    "status": "string",
    "event_time": "string",
    "affected_people": "string",
    "deaths": "string",
    "injuries": "string",
    "missing_people": "string",
    "affected_areas": "array<string>",
    "resources": "array<string>",
    "responders": "array<string>",
    "source_links": "array<struct<name:string,url:string>>",
    "evidence_status": "string",
    "confidence": "string",
    "limitations": "string",
}


def situation_report(rows: DataFrame, *keep: str) -> DataFrame:
    """Fact cells and a Markdown report per row of (question, label, any of ``FACTS``).

    An unknown figure reads as not reported. It is never shown as zero.
    """
    missing = {c: F.lit(None).cast(t) for c, t in FACTS.items() if c not in rows.columns}
    shown = {c: text.display_value(F.col(c)) for c in (
        "location", "event_time", "affected_people", "deaths", "injuries", "missing_people"
    )}
    cells = rows.withColumns(missing).select(
        *keep,
        F.col("question"),
        F.lower("label").alias("label"),
        text.title_case(F.col("label")).alias("problem_type"),
        text.display_value(F.col("status"), fixed.REPORT_NO_STATUS).alias("status"),
        *[v.alias(k) for k, v in shown.items()],
        text.names_list(F.col("affected_areas"), fixed.NOT_REPORTED).alias("affected_areas"),
        text.names_list(F.col("resources"), fixed.REPORT_NO_NEEDS).alias("needs"),
        text.names_list(F.col("responders"), fixed.NOT_REPORTED).alias("responders"),
        text.links_list(F.col("source_links"), fixed.REPORT_NO_LINKS).alias("sources"),
        F.coalesce("evidence_status", F.lit(fixed.REPORT_EVIDENCE_STATUS)).alias("evidence_status"),
        F.coalesce("confidence", F.lit(fixed.REPORT_CONFIDENCE)).alias("confidence"),
        F.coalesce("limitations", F.lit(fixed.REPORT_LIMITATIONS)).alias("limitations"),
    )
    return cells.withColumn("report", _markdown()).drop("label")


CELLS = [
    "problem_type", "location", "event_time", "affected_people", "deaths", "injuries",
    "missing_people", "affected_areas", "evidence_status", "confidence",
]


def _paragraph(heading: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"**{heading}:** "), *parts)


def _markdown() -> Column:
    table = [F.lit("| Field | Report |\n|---|---|")] + [
        F.concat(F.lit(f"| {name} | "), F.col(cell), F.lit(" |"))
        for name, cell in zip(fixed.REPORT_FIELDS, CELLS)
    ]
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("### "), F.col("problem_type"), F.lit(" situation report")),
        _paragraph("Question received", F.col("question")),
        _paragraph("Direct status", F.col("status")),
        F.concat_ws("\n", *table),
        _paragraph("What may be happening", F.lit(fixed.REPORT_HAPPENING[0]), F.col("label"), F.lit(fixed.REPORT_HAPPENING[1])),
        _paragraph("Who may need help", F.col("needs"), F.lit(".")),
        _paragraph("Who may be responding", F.col("responders"), F.lit(".")),
        _paragraph("Casualty rule", F.lit(fixed.REPORT_CASUALTY_RULE)),
        _paragraph("Recommended response workflow", F.lit(fixed.REPORT_WORKFLOW)),
        _paragraph("Sources", F.col("sources")),
        _paragraph("Limitations", F.col("limitations")),
    )


def report_inputs(routed: DataFrame, question: str = "text") -> DataFrame:
    """Report inputs for routed questions on the two report routes."""

    def by_route(field: str) -> Column:
        def value(report: dict) -> Column:
            if field == "links":
                links = [F.struct(F.lit(n).alias("name"), F.lit(u).alias("url")) for n, u in report["links"]]
                return F.array(*links)
            if field == "needs":
                return F.array(*[F.lit(n) for n in report["needs"]]).cast("array<string>")
            return F.lit(report[field])

        return F.when(F.col("route") == "flood", value(fixed.FLOOD_REPORT)).otherwise(value(fixed.DOMAIN_REPORT))

    return routed.filter(F.col("route").isin("flood", "domain_report")).withColumns({
        "question": F.col(question),
        "status": by_route("status"),
        "resources": by_route("needs"),
        "source_links": by_route("links"),
        **{c: by_route(c) for c in ("evidence_status", "confidence", "limitations")},
    })


def evidence_report_inputs(evidence: DataFrame) -> DataFrame:
    """Report inputs from stored evidence: one report per record, figures as recorded."""
    link = F.struct(F.col("source_name").alias("name"), F.col("source_url").alias("url"))
    return evidence.select(
        "record_id",
        F.col("title").alias("question"),
        F.col("domain").alias("label"),
        "location",
        F.col("observed_at").alias("event_time"),
        "affected_people", "deaths", "injuries",
        F.col("missing").alias("missing_people"),
        F.array("location").alias("affected_areas"),
        F.array(link).alias("source_links"),
        F.col("confidence"),
    )


def resource_answer(routed: DataFrame, kpis: DataFrame) -> DataFrame:
    """The answer to every question on the resource route, with the figures of all requests."""
    figures = kpis.select(F.struct("critical_requests", "open_requests", "people_affected")).scalar()
    k = F.col("_kpis")
    answer = text.filled(
        fixed.RESOURCE_ANSWER,
        k["critical_requests"].cast("string"), k["open_requests"].cast("string"), text.thousands(k["people_affected"]),
        F.when(F.col("death_requested"), F.lit(fixed.RESOURCE_DEATHS)).otherwise(F.lit("")),
    )
    asked = routed.filter("route = 'resource'").withColumn("_kpis", figures)
    return asked.withColumn("answer", answer).drop("_kpis")


def hazard_answer(routed: DataFrame, peak: DataFrame) -> DataFrame:
    """The answer to every question on the earthquake route, with event count, peak and place."""
    figures = peak.select(F.struct("events", "peak_severity", "peak_place")).scalar()
    p = F.col("_peak")
    unknown = F.lit("not available")
    answer = text.filled(
        fixed.HAZARD_ANSWER,
        p["events"].cast("string"), F.coalesce(text.magnitude(p["peak_severity"]), unknown), F.coalesce(p["peak_place"], unknown),
        F.when(F.col("death_requested"), F.lit(fixed.HAZARD_DEATHS_ASKED)).otherwise(F.lit(fixed.HAZARD_DEATHS)),
    )
    asked = routed.filter("route = 'earthquake'").withColumn("_peak", figures)
    return asked.withColumn("answer", answer).drop("_peak")


def with_evidence(answers: DataFrame, contexts: DataFrame, keys: list[str], attached: tuple[str, str] | None = None) -> DataFrame:
    """Each answer with the evidence that was found for its question, or the note that there is none.

    ``attached`` names two columns of the answers, a document's name and its excerpt, which follow
    the evidence; a question without a name has no document.
    """
    return evidence_sections(answers.join(contexts.select(*keys, "context"), keys, "left"), attached).drop("context")


def evidence_sections(answers: DataFrame, attached: tuple[str, str] | None = None) -> DataFrame:
    """Answers that stand beside their ``context``, or null, with it as their last section."""
    evidence = F.col("context")
    if attached:
        name, excerpt = map(F.col, attached)
        evidence = F.concat("context", F.when(name.isNotNull(), text.filled(fixed.ATTACHED, name, F.coalesce(excerpt, F.lit("")))).otherwise(F.lit("")))
    section = F.when(F.col("context").isNull(), F.lit(fixed.NO_EVIDENCE_SECTION)).otherwise(text.filled(fixed.EVIDENCE_SECTION, evidence))
    return answers.withColumn("answer", F.concat("answer", section))
