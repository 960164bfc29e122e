"""Row functions in Python workers, by Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import shipped


def _schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def map_batches(df: DataFrame, make: Callable[[], Callable[..., Iterable[tuple]]], schema: str | T.StructType) -> DataFrame:
    """Apply a function of whole column lists to every Arrow batch of ``df``.

    ``make`` runs once per task and returns ``f(*columns)``, which gets one Python list per
    column of ``df`` and yields output tuples in the order of ``schema``. Batches without rows
    are passed over; the output of an empty input is empty.
    """
    spark_schema = _schema(schema)

    def run(batches):
        f = make()
        target = to_arrow_schema(spark_schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(f(*(c.to_pylist() for c in batch.columns)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), target)], schema=target)

    return shipped(df).mapInArrow(run, spark_schema)
