"""Session settings and the shared folder."""

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster, where that folder may not exist, install the package or pass --py-files.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))


def local_session(cores: str = "*", name: str = "aidlens") -> SparkSession:
    """A session for tests and the benchmark. On a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("AIDLENS_SHUFFLE_PARTITIONS", "8"))
        # small local shuffles keep enough tasks for all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
        .config("spark.driver.memory", os.environ.get("AIDLENS_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The folders made for local applications that name none.
_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one made for the application in local mode, where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="aidlens-")
    return _LOCAL_FOLDERS[application]


#: Spark's setting that removes the shuffle files of a query as it ends.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, tidy: bool = False) -> DataFrame:
    """``df`` as a Parquet table that later steps read by column; cuts the lineage.

    ``tidy`` removes the shuffle files of the write as it ends; else they stay until the driver's
    garbage is collected.
    """
    spark = df.sparkSession
    before = spark.conf.get(_TIDY, None)
    if tidy:
        spark.conf.set(_TIDY, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is None:
            spark.conf.unset(_TIDY)
        elif tidy:
            spark.conf.set(_TIDY, before)
    return spark.read.schema(df.schema).parquet(path)
