"""Row-local functions of a text over Arrow batches, for folds that no built-in expression covers, and arrays as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

STEP = 512


def map_rows(df: DataFrame, keep: list[str], use: list[str], fields: T.StructType, fn: Callable[..., Iterable[tuple]], ahead: Callable[[list], list] | None = None) -> DataFrame:
    """For each row, ``fn(*use)`` gives any number of tuples of ``fields``; ``keep`` columns go along.

    With ``ahead``, what it makes of some rows' first column at once is one more argument of ``fn``.

    No shuffle; a few hundred rows are held at a time.
    """
    kept = df.select(*keep).schema
    schema = T.StructType([*kept.fields, *fields.fields])
    arrow = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                rows, source = [], []
                given = [c.to_pylist() for c in batch.columns[len(keep) :]]
                for i, args in enumerate(zip(*given, *([ahead(given[0])] if ahead else []), strict=True)):
                    for row in fn(*args):
                        rows.append(row)
                        source.append(i)
                along = [c.take(pa.array(source, pa.int64())) for c in batch.columns[: len(keep)]]
                new = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*along, *new], names=schema.names)

    return df.select(*keep, *[F.col(c).alias(f"_use_{k}") for k, c in enumerate(use)]).mapInArrow(run, schema)


def unnested(df: DataFrame, keep: list[str], found: Column, *names: str) -> DataFrame:
    """``keep`` and an element of the array ``found`` (with its position, if two names are given) a row; none for empty arrays.

    For arrays that cost much: a plain explode makes Spark infer a filter on the array's size, and push
    it down, so that the array would be made twice.  Elements must not be null.
    """
    each = F.posexplode_outer(found) if len(names) == 2 else F.explode_outer(found)
    return df.select(*keep, each.alias(*names)).where(F.col(names[-1]).isNotNull())


def fields(ddl: str) -> T.StructType:
    """'a:int b:string' as a struct; types: int, long, double, string, boolean."""
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in ddl.split())])
