"""Ranks within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parts a group is ranked in.
PARTS = 256


def spread_rank(df: DataFrame, group: list[str], order: list[Column], spread: Column, name: str = "rank") -> DataFrame:
    """``df`` with the rank, from 0 on, of each row within its group.

    A group is ranked in ``PARTS`` parts, chosen by ``spread``, and the parts are put one after
    the other by running totals, so a group that holds a third of all rows is not sorted in one
    task. The order is that of the parts, then ``order``.
    """
    rows = df.withColumn("_part", F.pmod(spread, F.lit(PARTS)).cast("int"))
    totals = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rows = rows.withColumn(name, F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)) - 1)
    return rows.join(totals, [*group, "_part"]).withColumn(name, F.col(name) + F.col("_offset")).drop("_part", "_offset")
