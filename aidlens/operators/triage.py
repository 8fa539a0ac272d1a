"""Request triage: scoring, filters, totals, the queue and dispatch recommendations."""

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens.functions import scoring


def score_requests(requests: DataFrame) -> DataFrame:
    score = scoring.priority_score(
        F.col("people_affected"), F.col("priority"), F.col("need_type"), F.col("status")
    )
    return requests.withColumn("priority_score", score)


def filter_requests(
    scored: DataFrame, statuses: Iterable[str], needs: Iterable[str], zones: Iterable[str]
) -> DataFrame:
    """Rows whose status, need and zone are all chosen. An empty choice keeps nothing.

    Filters only; the order belongs to whoever shows or writes the rows (``by_urgency``).
    """
    chosen = (
        F.col("status").isin(list(statuses))
        & F.col("need_type").isin(list(needs))
        & F.col("zone").isin(list(zones))
    )
    return scored.filter(chosen)


def by_urgency(scored: DataFrame) -> DataFrame:
    """Highest score first. The id as last key also splits rows of equal score over ranges."""
    return scored.orderBy(F.desc("priority_score"), "request_id")


def open_requests(requests: DataFrame) -> DataFrame:
    """Everything not completed; a request without a status counts as open."""
    return requests.filter(~F.col("status").eqNullSafe("Completed"))


def request_kpis(requests: DataFrame) -> DataFrame:
    return requests.agg(
        F.count_if(F.col("priority") == "Critical").alias("critical_requests"),
        F.count_if(~F.col("status").eqNullSafe("Completed")).alias("open_requests"),
        F.coalesce(F.sum(F.col("people_affected").cast("bigint")), F.lit(0).cast("bigint")).alias(
            "people_affected"
        ),
    )


def kpi_snapshot(requests: DataFrame, shelters: DataFrame) -> DataFrame:
    """One row of headline figures, one pass over each table."""
    open_shelters = shelters.agg(F.count_if(F.col("status") == "Open"))
    return request_kpis(requests).withColumn("open_shelters", open_shelters.scalar())


def need_totals(requests: DataFrame) -> DataFrame:
    return (
        requests.groupBy("need_type")
        .agg(F.coalesce(F.sum(F.col("people_affected").cast("bigint")), F.lit(0).cast("bigint")).alias("people_affected"))
        .orderBy("people_affected", "need_type")
    )


def filter_values(requests: DataFrame) -> DataFrame:
    """The distinct statuses, needs and zones as (field, value), from a single scan."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
        for c in ("status", "need_type", "zone")
    ])
    return requests.select(F.inline(pairs)).distinct().orderBy("field", "value")


QUEUE_COLUMNS = [
    "request_id", "location", "zone", "need_type", "people_affected", "priority",
    "priority_score", "status", "reported_at",
]


def triage_queue(scored: DataFrame, rows: int | None = 12) -> DataFrame:
    """The most urgent requests, scores rounded half to even; ``rows=None`` keeps all."""
    ranked = scored.orderBy(F.desc("priority_score"), F.desc("people_affected"), "request_id")
    if rows is not None:
        ranked = ranked.limit(rows)
    return ranked.withColumn("priority_score", F.bround("priority_score", 0).cast("int")).select(
        *QUEUE_COLUMNS
    )


def top_request_per_need(scored: DataFrame) -> DataFrame:
    """The highest-scored request of each need, spelled exactly as given."""
    first = W.partitionBy("need_type").orderBy(F.desc("priority_score"), "request_id")
    return scored.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def top_supply_per_type(resources: DataFrame) -> DataFrame:
    """The largest positive stock of each resource type, whatever its letter case."""
    first = W.partitionBy("supply_type").orderBy(F.desc("available_units"), "resource_id")
    return (
        resources.filter("available_units > 0")
        .withColumn("supply_type", F.lower("resource_type"))
        .withColumn("_n", F.row_number().over(first))
        .filter("_n = 1")
        .drop("_n")
    )


def with_units(requests: DataFrame, lines: DataFrame, key: str, line_key: str, quantity: str) -> DataFrame:
    """Adds ``requested_units``, the sum of a request's lines; only lines of ``requests`` are summed."""
    wanted = requests.select(F.col(key).alias(line_key)).distinct()
    units = lines.join(wanted, line_key, "left_semi").groupBy(line_key).agg(F.sum(quantity).alias("_units"))
    joined = requests.join(units.withColumnRenamed(line_key, key), key, "left")
    return joined.withColumn("requested_units", F.coalesce("_units", F.lit(0)).cast("int")).drop("_units")


def dispatch_recommendations(
    scored: DataFrame, resources: DataFrame, units: Callable[[DataFrame], DataFrame] = lambda top: top
) -> DataFrame:
    """For each open need: where to send how many units, and from which warehouse.

    Both sides are reduced to one row per need before they meet, so the join is tiny. ``units``
    adds ``requested_units`` to the chosen requests where that costs a look-up of its own.
    """
    need = units(top_request_per_need(open_requests(scored))).alias("r")
    supply = top_supply_per_type(resources).alias("s")
    reason = F.format_string("%s priority; %d people affected", "r.priority", "r.people_affected")
    return (
        need.join(supply, F.lower("r.need_type") == F.col("s.supply_type"))
        .select(
            F.col("r.need_type").alias("need"),
            F.col("r.location").alias("priority_location"),
            F.least("r.requested_units", "s.available_units").alias("recommended_units"),
            F.col("s.warehouse").alias("dispatch_from"),
            reason.alias("reason"),
        )
        .orderBy("need")
    )


def request_map_points(requests: DataFrame) -> DataFrame:
    renamed = requests.withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    return renamed.select(
        "request_id", "location", "lat", "lon", "priority", "people_affected", "need_type", "status"
    )


def radar_rank(problems: DataFrame) -> DataFrame:
    """Problems with their radar score, highest first."""
    score = scoring.radar_score(F.col("impact"), F.col("urgency"))
    return problems.withColumn("radar_score", score).orderBy(F.desc("radar_score"), "problem")


def radar_lookup(problems: DataFrame, problem: str) -> DataFrame:
    """The first row that carries the given name."""
    return problems.filter(F.col("problem") == problem).orderBy("position").limit(1)
