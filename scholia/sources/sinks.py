"""Sinks: analyses, history, reports and exported texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HISTORY = T.StructType().add("id", "string").add("timestamp", "long").add("summary", "string").add("data", "string")


def append_history(rows: DataFrame, path: str) -> None:
    """Analyses (id, timestamp, summary, data: JSON strings) added to a table, one folder a day."""
    day = F.to_date(F.timestamp_seconds("timestamp"))
    rows.select("id", "timestamp", "summary", "data", day.alias("day")).write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "timestamp", "summary", "data")


def import_history(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Older records, a JSON file each ({id, timestamp, ...}); broken files and known ids are left out."""
    texts = spark.read.text(path, wholetext=True)
    parsed = texts.select(F.from_json("value", "id string, timestamp long").alias("r"), F.col("value").alias("data"))
    rows = parsed.where("r.id is not null").select("r.id", F.coalesce("r.timestamp", F.try_to_number(F.split("r.id", "_")[0], F.lit("9999999999")).cast("long")).alias("timestamp"), F.lit(None).cast("string").alias("summary"), "data")
    return rows.join(existing.select("id"), "id", "left_anti") if existing is not None else rows


def delete_records(rows: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """What remains without some records (all if ``ids`` is None); write it to replace the table."""
    return rows.limit(0) if ids is None else rows.where(~F.col("id").isin(*ids))


def write_texts(rows: DataFrame, path: str, text_col: str = "report") -> None:
    """Texts as files, a line separator of form feeds between those of one file."""
    rows.select(text_col).write.mode("overwrite").option("lineSep", "\f").text(path)


def purge(rows: DataFrame, ids: list[str] | None = None) -> tuple[DataFrame, int]:
    """What remains without some records (all if ``ids`` is None), and how many go."""
    gone = rows if ids is None else rows.where(F.col("id").isin(*ids))
    return delete_records(rows, ids), gone.count()
