"""A Parquet table of batches that are published one by one.

A batch is written to a folder of its own and exists for readers only when a small file names
that folder. What a failed attempt left is in a folder that nothing names, so a batch is there
in whole or not at all, and one that is sent again under its name adds nothing. One writer at a
time; readers may come at any time.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COMMIT = "name string, data string, rows long, replaces array<string>, notes string"


class Files:
    """The few file operations that Spark's readers lack, in any store that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def empty(self, folder: str) -> list[tuple[str, int]]:
        """Files below a folder that have no byte, with their times; one call a file, in the driver.

        Spark's readers pass over them. Names that begin with a dot or an underscore are no data.
        """
        out, found = [], self._fs.listFiles(self._path(folder), True)
        top = len(self._fs.getFileStatus(self._path(folder)).getPath().toString())
        while found.hasNext():
            status = found.next()
            name = status.getPath().toString()
            if not status.getLen() and not any(part[:1] in ("_", ".") for part in name[top:].strip("/").split("/")):
                out.append((name, status.getModificationTime()))
        return out

    def publish(self, path: str, text: str) -> None:
        """A file that appears with all of its text, or not."""
        hidden = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(hidden))
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(self._path(hidden), self._path(path)):
            raise FileExistsError(path)


class CommittedTable:
    """Batches under ``path``: folders of Parquet files, partitioned by columns, and their commits."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, *partition: str):
        self.spark, self.path, self.schema, self.partition = spark, path.rstrip("/"), schema, partition
        self.files = Files(spark, path)

    def _commit(self, name: str) -> str:
        return f"{self.path}/commits/{name}.json"

    def commits(self) -> list[dict]:
        """All commits but those that a later one replaces; as many as there are batches."""
        if not self.files.exists(f"{self.path}/commits"):
            return []
        rows = [r.asDict() for r in self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").collect()]
        gone = {name for r in rows for name in r["replaces"] or ()}
        return [r for r in rows if r["name"] not in gone]

    def commit(self, name: str) -> dict | None:
        """The commit of that name, replaced ones too."""
        if not self.files.exists(self._commit(name)):
            return None
        return self.spark.read.schema(_COMMIT).json(self._commit(name)).first().asDict()

    def read(self) -> DataFrame:
        """The rows of all published batches; none, but typed, before the first."""
        folders = [f"{self.path}/{r['data']}" for r in self.commits() if r["rows"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # the batch is a folder's name, so partition columns below it are found and pruned
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return read.parquet(*folders).select(*self.schema.names)

    def append(self, rows: DataFrame, name: str | None = None, notes: str = "", replaces: tuple[str, ...] = ()) -> int:
        """Write and publish a batch; returns how many rows it has.

        A name that is published already adds nothing and returns its rows. They are counted
        while they are written. A batch without rows leaves no data.
        """
        name = name or uuid.uuid4().hex
        known = self.commit(name)
        if known:
            return known["rows"]
        data, counted = f"data/batch={name}.{uuid.uuid4().hex}", Observation()
        counting = rows.select(*self.schema.names).observe(counted, F.count(F.lit(1)).alias("rows"))
        counting.write.option("compression", "zstd").partitionBy(*self.partition).parquet(f"{self.path}/{data}")
        written = counted.get["rows"]
        if not written:
            self.files.remove(f"{self.path}/{data}")
        self._publish({"name": name, "data": data, "rows": written, "replaces": list(replaces), "notes": notes})
        return written

    def _publish(self, commit: dict) -> None:
        self.files.publish(self._commit(commit["name"]), json.dumps(commit))

    def compact(self, arranged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
        """All batches as one. Readers that began before keep the old folders, which stay."""
        names = tuple(r["name"] for r in self.commits())
        return self.append(arranged(self.read()), replaces=names) if len(names) > 1 else 0
