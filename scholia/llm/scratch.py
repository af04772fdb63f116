"""Tables that cut lineage, in the folder that all executors share, and the size of Python workers' batches.

The folder comes from ``spark.checkpoint.dir``.  Only a local session (``local[...]``) may leave it
unset; then a folder below the system's temporary one is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


#: Bytes of the batches that Python workers get; a worker holds one and what it makes of it.
BATCH, BATCH_SETTING, SPARKS_OWN = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Lower the size of Arrow batches in a session that has Spark's default (64 MB)."""
    if spark.conf.get(BATCH_SETTING) == SPARKS_OWN:
        spark.conf.set(BATCH_SETTING, BATCH)


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises ValueError on a cluster whose session names none."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


class Scratch:
    """Named tables of one run. ``keep`` writes one and reads it back, ``drop`` deletes it."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/scholia-{what}-{uuid.uuid4().hex}"
        self.count = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the schema it had."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete what ``keep`` wrote, once nothing reads it any more."""
        for df in tables:
            self._delete(df._scratch_path)

    def end(self) -> None:
        """Delete all tables of the run; only for runs whose result reads none of them."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
