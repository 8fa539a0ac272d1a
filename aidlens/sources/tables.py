"""Operational tables: CSV in, CSV out, transcripts out."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aidlens import schemas

OPERATIONAL = {
    "emergency_requests": schemas.REQUESTS,
    "shelters": schemas.SHELTERS,
    "hospitals": schemas.HOSPITALS,
    "resources": schemas.RESOURCES,
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header. Names that do not fit the schema are an error, not a silent shift."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm")
        .csv(path)
    )


def load_operational(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four operational tables of a folder, by name."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", st) for name, st in OPERATIONAL.items()}


def export_triage(scored: DataFrame, path: str) -> None:
    """All rows, most urgent first, scores rounded half to even. Part files are in order."""
    (
        scored.orderBy(F.desc("priority_score"), F.desc("people_affected"), "request_id")
        .withColumn("priority_score", F.bround("priority_score", 0).cast("int"))
        .write.option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def export_transcripts(transcripts: DataFrame, path: str) -> None:
    """Transcript parts as JSON lines, in the order of conversations and parts."""
    transcripts.orderBy("conv_id", "part").write.json(path)
