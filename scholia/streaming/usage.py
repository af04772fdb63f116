"""Usage as a stream: windowed counts with a watermark, and one-by-one admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import DAY, GLOBAL_CAP, IP_CAP, VISITOR_CAP
from . import admission, state

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files in a folder."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Uses per visitor and sliding window; events later than ``late`` are left out of windows already closed."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), "user_id").agg(F.count(F.lit(1)).alias("uses"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "uses")


def admissions(events: DataFrame, cap: int = VISITOR_CAP, window: int = DAY) -> DataFrame:
    """(event_id, key, ts, admitted) for events(event_id, key, ts long), batch or stream: a refused use doesn't count.

    A batch is decided from the numbers of events in seconds (see ``admission.by_key``), a stream as its watermark goes on (see ``state``).
    """
    if events.isStreaming:
        return state.admissions(events, cap, window)
    return admission.by_key(events, cap, window)


def admissions_in_turn(events: DataFrame, caps: tuple[int, int, int] = (GLOBAL_CAP, VISITOR_CAP, IP_CAP), window: int = DAY) -> DataFrame:
    """(event_id, ts, reason) for events(event_id, ts long, visitor, ip): each decided given those admitted before it.

    See ``admission``: the order of time holds where a cap may be reached, and nothing waits elsewhere.
    """
    return admission.in_turn(events, caps, window)
