"""Codes for values: distinct values numbered in order, without gathering them in the driver or in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import staged
from .columns import col
from .sizes import BROADCAST_ROWS, at_most, broadcast_if_small


def numbered(df: DataFrame, by: str, order_by: Sequence[str], name: str, ranges: bool | None = None) -> DataFrame:
    """`df` with the place of each row within its `by` value, from 0 along `order_by`, nulls first; ties fall as they are read.

    A small table is one window. Otherwise all rows are sorted by range, so that a value of `by` may hold most of them,
    and each row's place follows from its place in the partition and one count per partition and value.
    """
    order = [F.col(c).asc_nulls_first() for c in order_by]
    if ranges is None:
        ranges = not at_most(df, BROADCAST_ROWS)
    if not ranges:
        return df.withColumn(name, F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long") - 1)
    own = df.columns
    rows = df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    rows = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = staged(runs.select("_part", by, "_first", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before")), "numbered-runs")
    rows = rows.join(broadcast_if_small(runs), ["_part", by])
    return rows.select(*[col(c) for c in own], (F.col("_before") + F.col("_at") - F.col("_first")).alias(name))


def distinct_values(df: DataFrame, columns: Sequence[str], null: str | None = None) -> DataFrame:
    """`column`, `value` (text) of all different values, in one pass over all columns; nulls are left out or called `null`."""
    value = lambda c: col(c).cast("string") if null is None else F.coalesce(col(c).cast("string"), F.lit(null))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("e")).select("e.column", "e.value").where("value IS NOT NULL").distinct()


def dictionary(df: DataFrame, columns: Sequence[str], null: str | None = None, ranges: bool | None = None) -> DataFrame:
    """`column`, `value`, `code`: the sorted distinct values of each column, from 0."""
    return staged(numbered(staged(distinct_values(df, columns, null), "dictionary-values"), "column", ["value"], "code", ranges), "dictionary")


def coded(df: DataFrame, codes: DataFrame, columns: Sequence[str], null: str | None = None, suffix: str = "_encoded") -> DataFrame:
    """`df` with the code (long) of each column's value; a value that isn't in `codes` gets the number of values.

    A column's codes are broadcast after they were counted; beyond that they are joined, and the value decides where
    both sides go, so what a task gets doesn't grow with the number of values.
    """
    known = {r["column"]: r["n"] for r in codes.where(F.col("column").isin(*columns)).groupBy("column").agg(F.count("*").alias("n")).collect()}
    for c in columns:
        own = codes.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        own = F.broadcast(own) if known.get(c, 0) <= BROADCAST_ROWS else own
        value = col(c).cast("string") if null is None else F.coalesce(col(c).cast("string"), F.lit(null))
        df = df.withColumn("_own", value).join(own, F.col("_own") == F.col("_value"), "left").drop("_own", "_value")
        df = df.withColumn(f"{c}{suffix}", F.coalesce("_code", F.lit(known.get(c, 0)))).drop("_code")
    return df
