"""A filter of fixed size that keeps rows without a partner from being shuffled.

Keys of a table are hashed to ``SLOTS`` slots; the taken ones (``SLOTS`` rows at most, whatever the input)
are broadcast.  With far more keys than slots all are taken, and the join behind it does what it would
have done without the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 18


def slot(*key: str | Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(SLOTS)).cast("int")


def parted(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``rows`` whose ``key`` may be in the table ``keys`` (of a column with that name), and those whose key isn't."""
    taken = F.broadcast(keys.select(slot(key).alias("_slot")).distinct())
    tagged = rows.withColumn("_slot", slot(key))
    return tagged.join(taken, "_slot", "left_semi").drop("_slot"), tagged.join(taken, "_slot", "left_anti").drop("_slot")
