"""Tables of a run in the folder that all executors share, which cut lineage.

The folder comes from ``spark.checkpoint.dir``.  Only a local session may leave it unset; then a folder below
the system's temporary one is made and set.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Bytes of the batches that Python workers get; Spark's own are 64 MB, which an executor holds several times.
BATCH, BATCH_SETTING, SPARKS_OWN = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; raises ValueError on a cluster whose session names none."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="scholia-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def delete(spark: SparkSession, name: str) -> None:
    """Delete a file or folder of any file system, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


class Scratch:
    """Named tables of one run.  A session that has Spark's size of Arrow batches gets smaller ones."""

    def __init__(self, spark: SparkSession, what: str):
        if spark.conf.get(BATCH_SETTING) == SPARKS_OWN:
            spark.conf.set(BATCH_SETTING, BATCH)
        self.spark, self.count = spark, 0
        self.root = f"{shared_dir(spark)}/scholia-{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the schema it had."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self) -> None:
        """Delete all tables; only for runs whose result reads none of them."""
        delete(self.spark, self.root)
