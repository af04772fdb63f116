"""Comparison of Spark results with DuckDB's."""

import math


def plain(v):
    """A value that compares equal across engines."""
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def same(spark_df, duck_rel):
    """Asserts equal columns and rows."""
    got, want = spark_df.collect(), duck_rel.fetchall()
    assert sorted(spark_df.columns) == sorted(duck_rel.columns)
    assert rows_of(spark_df.columns, got) == rows_of(duck_rel.columns, want)
    return len(got)
