"""Ordered scans that do not put a whole table, or a hot key, into one task.

Rows are cut into chunks along the order column. Inside a chunk a plain window does the work; what has to cross
a chunk border is one summary row per (key, chunk), and only those summaries are scanned in order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from .columns import col, replace_columns
from .sizes import BROADCAST_ROWS, ROWS_PER_TASK, group_sizes, is_small

# Chunks of a table without a key: at least so many, and so many for each core, since a hash deals them out unevenly.
MIN_GLOBAL_CHUNKS, CORE_CHUNKS = 8, 4


def as_number(df: DataFrame, order_by: str) -> Column:
    """The order column as a double that never reverses an order (it may tie, which chunking tolerates)."""
    kind = df.schema[order_by].dataType
    if isinstance(kind, T.NumericType):
        return col(order_by).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col(order_by)).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(col(order_by).cast("timestamp"), F.current_timezone())).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(order_by)).cast("double")
    raise ValueError(f"order column {order_by} must be a number, a date or a timestamp")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _exact(kind: T.DataType, value: float) -> bool:
    """Whether no two order values share this double."""
    if isinstance(kind, T.DecimalType):
        return kind.precision <= 15
    return isinstance(kind, (T.FloatType, T.DoubleType)) or abs(value) < 2.0**53


def _global_chunks(df: DataFrame) -> int:
    return max(MIN_GLOBAL_CHUNKS, CORE_CHUNKS * df.sparkSession.sparkContext.defaultParallelism)


def with_key(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with `_tie`, a hash that orders rows of one order value alike in every plan, and the key as one column
    `_g` that is never null, so that windows and joins share one partitioning."""
    tie = F.xxhash64(*[col(f.name) for f in df.schema if _hashable(f.dataType)])
    df = df.withColumn("_tie", F.shiftrightunsigned(tie, 1))
    return (df.withColumn("_g", F.struct(*[col(c) for c in by])), ["_g"]) if by else (df, [])


def with_chunks(df: DataFrame, order_by: str, by: Sequence[str], chunks: int | None, least: int = 1, tie: str | None = None) -> tuple[DataFrame, int]:
    """Append the chunk number of each row as `_chunk`; returns the frame and the number of chunks.

    With `chunks=None` a table without a big group keeps one chunk per key, "not needed". With one, there are so many
    that a chunk of all keys together, and so of any key, is one task's work; at least `least`. Rows without an order
    value come first, as in a plain window, and so belong to the first chunk; NaN comes last. With `tie`, a column of
    hashes from 0 to 2^63 - 1 by which rows of one order value are sorted, rows of a value that would fill several
    chunks, or of none, are cut along it.
    """
    name = "_chunk"
    if chunks is None:
        if is_small(df.select(order_by, *by)):
            chunks = 1
        else:
            biggest, rows = group_sizes(df, by)
            chunks = -(-rows // ROWS_PER_TASK) if biggest > ROWS_PER_TASK else 1
        chunks = max(chunks, least)
    if chunks <= 1:
        return df.withColumn(name, F.lit(0)), 1
    at, kind = as_number(df, order_by), df.schema[order_by].dataType
    probs = [i / chunks for i in range(1, chunks)]
    found, rows, known = df.select(at.alias("_at")).agg(F.percentile_approx("_at", probs, max(10_000, 4 * chunks)), F.count(F.lit(1)), F.count("_at")).first()
    times = Counter("nan" if c != c else c for c in found or [])
    cuts = sorted(c for c in times if c != "nan" and abs(c) != float("inf"))
    # The buckets: below the first cut, from each cut on, NaN. A bucket's first `parts` chunks hold its lowest value.
    parts = [0, *[times[c] if tie and times[c] > 1 and _exact(kind, c) else 0 for c in cuts], times["nan"] if tie else 0]
    absent = 1 + chunks * (rows - known) // rows if tie and known < rows else 0
    starts = [absent]
    for p in parts:
        starts.append(starts[-1] + p + 1)
    if starts[-1] <= 2:  # one bucket and an empty one
        return df.withColumn(name, F.lit(0)), 1
    cut = df.withColumn("_at", at)
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_cut", handleInvalid="keep").transform(cut).withColumn("_cut", F.col("_cut").cast("int"))
    else:
        cut = cut.withColumn("_cut", F.when(F.isnan("_at"), 1).otherwise(0))
    bucket = F.when(F.col("_at").isNull(), 0).otherwise(F.col("_cut"))
    number = F.array(*map(F.lit, starts))[bucket]
    if tie:
        share = F.col(tie) / F.lit(2.0**63)
        lowest, many = F.array(*map(F.lit, [float("-inf"), *cuts, float("nan")]))[bucket], F.array(*map(F.lit, parts))[bucket]
        number = number + F.when(many == 0, 0).when(F.col("_at") == lowest, F.floor(share * many)).otherwise(many).cast("int")
        number = F.when(F.col("_at").isNull(), F.floor(share * max(absent, 1)).cast("int")).otherwise(number)
    return cut.withColumn(name, number).drop("_at", "_cut"), starts[-1]


def running_total(df: DataFrame, by: Sequence[str], order_by: str, amount: str, out: str,
                  chunks: int | None = None) -> DataFrame:
    """Sum of `amount` over the rows of the key up to and including this one, in `order_by` order.

    `order_by` must be unique within a key (value counts are), so that the total is well defined.
    """
    return running_totals(df, by, order_by, {amount: out}, chunks)


def running_totals(df: DataFrame, by: Sequence[str], order_by: str, amounts: Mapping[str, str], chunks: int | None = None) -> DataFrame:
    """`running_total` of several amounts, given with the names of their totals: rows are cut and sorted once."""
    cut, n = with_chunks(df, order_by, by, chunks)
    inside = W.partitionBy(*by, "_chunk").orderBy(order_by).rowsBetween(W.unboundedPreceding, 0)
    detail = cut.withColumns({out: F.sum(amount).over(inside) for amount, out in amounts.items()})
    if n == 1:
        return detail.drop("_chunk")
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(*by, "_chunk").agg(*[F.sum(amount).alias(f"_sum_{out}") for amount, out in amounts.items()])
    offsets = sums.select(*by, "_chunk", *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_before_{out}") for out in amounts.values()])
    joined = _join_chunks(detail, offsets, by, n).withColumns({out: F.col(out) + F.col(f"_before_{out}") for out in amounts.values()})
    return joined.drop("_chunk", *[f"_before_{out}" for out in amounts.values()])


def _join_chunks(detail: DataFrame, offsets: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Without a key there is one offset row for each chunk, few enough to broadcast unless the table is huge."""
    keys = [*by, "_chunk"]
    if not by and n > BROADCAST_ROWS:
        return detail.join(offsets, keys, "left")
    if not by:
        return detail.join(F.broadcast(offsets), keys, "left")
    # keys may be null: match them null-safely
    off = offsets.select(*[col(k).alias(f"_o_{k}") for k in keys], *[col(c) for c in offsets.columns if c not in keys])
    on = [col(k).eqNullSafe(col(f"_o_{k}")) for k in by] + [F.col("_chunk") == F.col("_o__chunk")]
    return detail.join(off, on, "left").drop(*[f"_o_{k}" for k in keys])


def _meet(detail: DataFrame, offsets: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """Rows and the row of their chunk, on the partitioning that the windows of `detail` have."""
    if not key and n <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return detail.join(offsets, [*key, "_chunk"], "left")


def carry_forward(df: DataFrame, values: Sequence[str], order_by: str, by: Sequence[str] = (), *,
                  include_current: bool = True, backfill: bool = False, chunks: int | None = None) -> DataFrame:
    """Replace each of `values` by its last non-null value so far within the key.

    `include_current=False` looks strictly before the row. `backfill=True` gives the rows ahead of the first
    non-null value that first value, which is forward fill followed by backward fill.
    """
    keyed, by = with_key(df, by)
    cut, n = with_chunks(keyed, order_by, by, chunks, 1 if by else _global_chunks(df), "_tie")
    inside = W.partitionBy(*by, "_chunk").orderBy(col(order_by), "_tie").rowsBetween(
        W.unboundedPreceding, 0 if include_current else -1
    )
    seen = {v: F.last(col(v), ignorenulls=True).over(inside) for v in values}
    if n == 1:
        if backfill:
            whole = W.partitionBy(*by, "_chunk")
            seen = {v: F.coalesce(e, _first(v, order_by).over(whole)) for v, e in seen.items()}
        return replace_columns(cut, seen).select(*[col(c) for c in df.columns])
    edges = cut.groupBy(*by, "_chunk").agg(
        *[_last(v, order_by).alias(f"_last_{i}") for i, v in enumerate(values)],
        *[_first(v, order_by).alias(f"_first_{i}") for i, v in enumerate(values)],
    )
    before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    offsets = edges.select(
        *by, "_chunk",
        *[F.last(f"_last_{i}", ignorenulls=True).over(before).alias(f"_in_{i}") for i in range(len(values))],
        *[F.min_by(f"_first_{i}", F.when(F.col(f"_first_{i}").isNotNull(), F.col("_chunk"))).over(whole).alias(f"_head_{i}")
          for i in range(len(values))],
    )
    joined = _meet(replace_columns(cut, seen), offsets, by, n)
    filled = {
        v: F.coalesce(col(v), F.col(f"_in_{i}"), *([F.col(f"_head_{i}")] if backfill else []))
        for i, v in enumerate(values)
    }
    return replace_columns(joined, filled).select(*[col(c) for c in df.columns])


def _last(v: str, order_by: str) -> Column:
    # A struct, so that a null order value is the smallest one and not ignored.
    return F.max_by(col(v), F.when(col(v).isNotNull(), F.struct(col(order_by), F.col("_tie"))))


def _first(v: str, order_by: str) -> Column:
    return F.min_by(col(v), F.when(col(v).isNotNull(), F.struct(col(order_by), F.col("_tie"))))


def interpolate(df: DataFrame, values: Sequence[str], order_by: str, by: Sequence[str] = (), *,
                chunks: int | None = None) -> DataFrame:
    """Linear interpolation on row positions. Leading nulls stay, trailing ones take the last value."""
    keyed, by = with_key(df, by)
    cut, n = with_chunks(keyed, order_by, by, chunks, 1 if by else _global_chunks(df), "_tie")
    key = [*by, "_chunk"]
    asc = W.partitionBy(*key).orderBy(col(order_by), "_tie")
    # Both ways by position, so that rows of one order value keep one order. A descending running frame: an
    # unbounded-following frame would be evaluated anew for every row.
    up = W.partitionBy(*key).orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*key).orderBy(F.desc("_pos")).rowsBetween(W.unboundedPreceding, 0)
    placed = cut.withColumn("_pos", F.row_number().over(asc).cast("long"))
    if n > 1:
        before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        sizes = (
            cut.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
            .select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        )
        placed = _meet(placed, sizes, by, n).withColumn("_pos", F.col("_pos") + F.col("_before")).drop("_before")
    for i, v in enumerate(values):
        placed = placed.withColumn(f"_k_{i}", F.when(col(v).isNotNull(), F.struct(F.col("_pos").alias("p"), col(v).cast("double").alias("x"))))
    known = range(len(values))
    near = placed.select(
        "*",
        *[F.last(f"_k_{i}", ignorenulls=True).over(up).alias(f"_prev_{i}") for i in known],
        *[F.last(f"_k_{i}", ignorenulls=True).over(down).alias(f"_next_{i}") for i in known],
    )
    if n > 1:
        edges = placed.groupBy(*key).agg(
            *[F.max_by(f"_k_{i}", f"_k_{i}.p").alias(f"_last_{i}") for i in known],
            *[F.min_by(f"_k_{i}", f"_k_{i}.p").alias(f"_first_{i}") for i in known],
        )
        before = W.partitionBy(*by).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
        after = W.partitionBy(*by).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
        offsets = edges.select(
            *key,
            *[F.last(f"_last_{i}", ignorenulls=True).over(before).alias(f"_in_{i}") for i in known],
            *[F.last(f"_first_{i}", ignorenulls=True).over(after).alias(f"_out_{i}") for i in known],
        )
        near = _meet(near, offsets, by, n)
        near = replace_columns(near, {
            **{f"_prev_{i}": F.coalesce(F.col(f"_prev_{i}"), F.col(f"_in_{i}")) for i in known},
            **{f"_next_{i}": F.coalesce(F.col(f"_next_{i}"), F.col(f"_out_{i}")) for i in known},
        })
    out = {}
    for i, v in enumerate(values):
        p, q = F.col(f"_prev_{i}"), F.col(f"_next_{i}")
        slope = (q["x"] - p["x"]) / (q["p"] - p["p"])
        between = p["x"] + slope * (F.col("_pos") - p["p"])
        out[v] = F.coalesce(col(v).cast("double"), F.when(p.isNotNull() & q.isNotNull() & (q["p"] > p["p"]), between), p["x"])
    return replace_columns(near, out).select(*[col(c) for c in df.columns])
