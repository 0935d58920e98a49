"""Written intermediate tables in the folder that the whole cluster shares.

A staged table cuts the lineage: a lost executor costs the tasks of one stage,
never a recomputation from the input.  The folder is the session's
``spark.checkpoint.dir``; only where that is unset and the master runs in this
process (tests on one machine) does a temporary folder stand in for it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files go when the query that wrote them ends; what later steps read is staged.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` where it is set."""
    if found := spark.conf.get("spark.checkpoint.dir", ""):
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_dir()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the queries run inside, as they were afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_LOCAL: list[str] = []


def _local_dir() -> str:
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="cuewise-"))
    return _LOCAL[0]


class Staging:
    """Staged tables of one run of an operator; each lives until dropped or until the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._path().getFileSystem(self._conf()).deleteOnExit(self._path())

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, table: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}" if table else self.root)

    def write(self, df: DataFrame, table: str, *, codec: str = "zstd", **conf: str) -> DataFrame:
        """Write ``df`` and read it back; ``conf``: settings for this query."""
        with settings(self.spark, FREE_SHUFFLES | conf):
            df.write.option("compression", codec).parquet(f"{self.root}/{table}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{table}")

    def bucketed(self, df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
        """Write ``df`` bucketed by ``key``: joins on it do not move its rows."""
        name = f"staged_{uuid.uuid4().hex}"
        with settings(self.spark, FREE_SHUFFLES):
            df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{table}").bucketBy(buckets, key).saveAsTable(name)
        written = self.spark.table(name)
        # The files stay where they are; only the name goes, and what reads it has found the files by now.
        self.spark.sql(f"DROP TABLE {name}")
        return written

    def drop(self, *tables: str) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            self._path(table).getFileSystem(self._conf()).delete(self._path(table), True)


def parts(spark: SparkSession, at_least: int = 1) -> int:
    """The session's number of shuffle partitions, or more."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))
