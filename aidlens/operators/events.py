"""Reports of one event brought together, with conflicting figures kept apart.

An event may hold a large share of all records, so nothing here collects a group into one
row: roll-ups are plain aggregates that combine before the shuffle, and lists come as rows.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aidlens import fixed


def event_sources(evidence: DataFrame) -> DataFrame:
    """Every source and address that reported an event, with its first and last time."""
    return evidence.groupBy("event_key", "source_name", "source_url").agg(
        F.count("*").alias("records"),
        F.min("observed_at").alias("first_observed"),
        F.max("observed_at").alias("last_observed"),
    )


def event_rollup(evidence: DataFrame) -> DataFrame:
    """One row per event. The per-source step keeps the distinct count cheap and skew-free."""
    return (
        event_sources(evidence)
        .groupBy("event_key")
        .agg(
            F.sum("records").alias("records"),
            F.count("*").alias("sources"),
            F.min("first_observed").alias("first_observed"),
            F.max("last_observed").alias("last_observed"),
        )
    )


def event_latest(evidence: DataFrame) -> DataFrame:
    """The newest record of each event; ties go to the smaller record id, then arrival."""
    newest = W.partitionBy("event_key").orderBy(F.desc("observed_at"), "record_id", "seq")
    return evidence.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def casualty_ranges(evidence: DataFrame) -> DataFrame:
    """Smallest and largest reported deaths per event; NULL where nobody reported any."""
    return evidence.groupBy("event_key").agg(
        F.min("deaths").alias("deaths_min"),
        F.max("deaths").alias("deaths_max"),
        F.count("deaths").alias("figures"),
        F.count("*").alias("records"),
        F.coalesce(F.min("deaths") < F.max("deaths"), F.lit(False)).alias("conflicting"),
    )


def casualty_figures(evidence: DataFrame) -> DataFrame:
    """The separate dated figures behind a range, each with its source."""
    return (
        evidence.filter("deaths IS NOT NULL")
        .groupBy("event_key", "observed_at", "source_name", "deaths")
        .agg(F.count("*").alias("records"))
    )


def casualty_primary_only(evidence: DataFrame) -> DataFrame:
    """Ranges from primary sources alone; other tiers corroborate but never supply figures."""
    primary = F.col("source_tier") == fixed.PRIMARY_TIER
    deaths = F.when(primary, F.col("deaths"))
    return evidence.groupBy("event_key").agg(
        F.min(deaths).alias("deaths_min"),
        F.max(deaths).alias("deaths_max"),
        F.count(deaths).alias("figures"),
        F.count_if(primary).alias("primary_records"),
        F.count_if(~primary).alias("corroborating_records"),
    )
