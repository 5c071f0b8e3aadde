"""Size checks that decide between a cheap plan for small data and the plan that scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Below this plan estimate one hash aggregate or one window per key is fine.
SMALL_PLAN_BYTES = 8 * 1024 * 1024
# Inputs up to this estimate may be redistributed over the cores before costly work.
SPREAD_BYTES = 64 * 1024 * 1024
# Largest group that one task sorts or hashes.
ROWS_PER_TASK = 2_000_000
# Largest table we hint as a broadcast, in rows of a few narrow columns.
BROADCAST_ROWS = 100_000


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan; no job is run. None where it cannot be read."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:
        return None


def is_small(df: DataFrame) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= SMALL_PLAN_BYTES


def spread(df: DataFrame) -> DataFrame:
    """Give every core a part of an input that has fewer splits than the cluster has cores.

    For work that is costly per row. A large input has more splits than that and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size is None or size > SPREAD_BYTES or cores < 2:
        return df
    return df.repartition(cores)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether `df` holds no more than `rows` rows; reads no more than rows + 1."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; otherwise leave the join to AQE."""
    return F.broadcast(df) if at_most(df, rows) else df


def group_sizes(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """Rows of the biggest group, and of all. Counts are combined map-side, so a hot key costs nothing extra."""
    if not by:
        n = df.count()
        return n, n
    row = df.groupBy(*by).count().agg(F.max("count"), F.sum("count")).first()
    return row[0] or 0, row[1] or 0


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return group_sizes(df, by)[0]
