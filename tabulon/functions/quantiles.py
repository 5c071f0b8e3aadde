"""Exact quantiles and order statistics whose state stays bounded.

Spark's `percentile` keeps every distinct value of a group in one hash map, outside compiled code. Here values are
counted first, which combines copies before the shuffle; while a group is small, slices of a fixed rule are totalled
and the values of the few slices that hold a wanted rank are sorted. Beyond that a sketch proposes cut points around each wanted rank, exact counts per slice decide
which slice holds the rank, and only the values of those slices are sorted. The sketch steers the work but never
the answer: a slice that turns out wide costs time, not exactness.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .columns import col, column_groups, long_form, q, s as text, union_all
from ..session import staged
from .sizes import ROWS_PER_TASK, broadcast_if_small, is_small, largest_group, spread

# Half width, in rank fractions, of the slice cut around each wanted rank. The sketch's own error is 1 / 10000.
_MARGIN = 3e-4
_SUB_SLICES = 256


def use_sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> bool:
    used = df.select(*[col(c) for c in dict.fromkeys([*by, *cols])])
    return not is_small(used) and largest_group(used, list(by)) > ROWS_PER_TASK


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), *,
              sliced: bool | None = None) -> DataFrame:
    """(by…, column, n, q) with `q` the linearly interpolated quantiles at `probs`; columns without values have no row."""
    cols, by, probs = list(cols), list(by), list(probs)
    if sliced is None:
        sliced = use_sketch(df, cols, by)
    if not sliced:
        return _counted(df, cols, probs, by)
    ranks = []
    for p in probs:
        ranks += [lambda n, p=p: F.floor(F.lit(p) * (n - 1)), lambda n, p=p: F.ceil(F.lit(p) * (n - 1))]
    found = order_statistics(df, cols, ranks, probs, by)
    between = []
    for j, p in enumerate(probs):
        lo, hi = F.col("v")[2 * j], F.col("v")[2 * j + 1]
        at = F.lit(p) * (F.col("n") - 1)
        between.append(lo + (hi - lo) * (at - F.floor(at)))
    return found.select(*by, "column", "n", F.array(*between).alias("q"))


# Eight slices per power of two: rises with the value and needs no knowledge of the data.
_LOG_SLICE = """CASE WHEN value >= 1e300D THEN 100000 WHEN value <= -1e300D THEN -100000 WHEN value > 0 THEN 20000 + int(floor(8 * log2(value)))
  WHEN value < 0 THEN -20000 - int(floor(8 * log2(-value))) ELSE 0 END"""


def _counted(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts per distinct value; slice totals tell which slices hold a wanted rank, and only their values are sorted."""
    cells = ", ".join(f"named_struct('_i', {i}, 'value', CAST({q(c)} AS DOUBLE))" for i, c in enumerate(cols))
    key = [*by, "_i"]
    counts = (
        spread(df.select(*[col(c) for c in dict.fromkeys([*by, *cols])]))
        .selectExpr(*[q(b) for b in by], f"inline(array({cells}))").filter("value IS NOT NULL")
        .groupBy(*key, "value").agg(F.expr("count(1) AS _m")).withColumn("_s", F.expr(_LOG_SLICE))
    )
    at = [f"{p!r}D * (n - 1)" for p in probs]
    ranks = [f"{f}({a})" for a in at for f in ("floor", "ceil")]
    w = W.partitionBy(*key)  # a few hundred slices
    slices = counts.groupBy(*key, "_s").agg(F.sum("_m").alias("_sm")).withColumns({
        "_start": F.coalesce(F.sum("_sm").over(w.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("_sm").over(w)})
    held = slices.filter(" OR ".join(f"({r} >= _start AND {r} < _start + _sm)" for r in ranks))
    side = held.select(*[col(k).alias(f"_k_{k}") for k in [*key, "_s"]], "_start", "n")
    if not by:
        side = F.broadcast(side)  # at most len(cols) * len(ranks) rows
    joined = counts.join(side, [col(k).eqNullSafe(col(f"_k_{k}")) for k in [*key, "_s"]], "inner")
    inside = W.partitionBy(*key, "_s").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = joined.withColumn("_end", F.col("_start") + F.sum("_m").over(inside))
    hit = lambda r: f"max(CASE WHEN {r} >= _end - _m AND {r} < _end THEN value END)"
    found = ranked.groupBy(*key, "n").agg(*[F.expr(f"{hit(f'{f}({a})')} AS {f}{j}") for j, a in enumerate(at) for f in ("floor", "ceil")])
    between = ", ".join(f"floor{j} + (ceil{j} - floor{j}) * ({a} - floor({a}))" for j, a in enumerate(at))
    names = ", ".join(text(c) for c in cols)
    return found.selectExpr(*[q(b) for b in by], f"array({names})[_i] AS column", "n", f"array({between}) AS q")


def order_statistics(df: DataFrame, cols: Sequence[str], ranks: Sequence[Callable[[Column], Column]],
                     near: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, n, v): `v[j]` is the value of 0-based rank `ranks[j](n)` among the non-null values.

    `near` lists the rank fractions around which the sketch should cut finely.
    """
    cols, by = list(cols), list(by)
    wanted = sorted({min(1.0, max(0.0, p + d)) for p in near for d in (-_MARGIN, _MARGIN)})
    sketch = df.groupBy(*by).agg(
        *[F.percentile_approx(col(c).cast("double"), wanted, 10_000).alias(f"_c{i}") for i, c in enumerate(cols)],
    )
    # Without keys the sketch is one row, whose cut points become literals. With keys its rows are written, then counted before a broadcast.
    names = [[f"_c{i}[{j}]" for j in range(len(wanted))] for i in range(len(cols))]
    if by:
        side = broadcast_if_small(staged(sketch.select(*[col(b).alias(f"_b_{b}") for b in by], *[f"_c{i}" for i in range(len(cols))]), "cuts"))
        cut = df.join(side, [col(b).eqNullSafe(col(f"_b_{b}")) for b in by], "inner")
    else:
        cut, row = df, sketch.first()
        names = [[f"{v!r}D" for v in sorted(set(row[i] or []))] for i in range(len(cols))]
    cells = {c: f"named_struct('column', {text(c)}, 'value', CAST({q(c)} AS DOUBLE), 'slice', {slot_sql(names[i], c)})" for i, c in enumerate(cols)}
    # The comparisons of one projection must compile, so many columns are taken in groups.
    values = union_all([cut.selectExpr(*[q(b) for b in by], f"inline(array({', '.join(cells[c] for c in own)}))")
                        for own in column_groups(cols, 2 * len(wanted))]).filter("value IS NOT NULL")
    # Exact counts per slice: at most 2 * len(near) + 1 slices per group and column.
    key = [*by, "column"]
    before = W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        values.groupBy(*key, "slice").agg(F.count(F.lit(1)).alias("_m"))
        .withColumn("_start", F.coalesce(F.sum("_m").over(before), F.lit(0)))
        .withColumn("n", F.sum("_m").over(W.partitionBy(*key)))
        .withColumn("_ranks", F.array(*[r(F.col("n")).cast("long") for r in ranks]))
        .withColumn("_here", F.filter(F.array_distinct("_ranks"), lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_m"))))
        .filter(F.size("_here") > 0)
    )
    side = slices.select(*[col(k).alias(f"_s_{k}") for k in [*key, "slice"]], "_start", "n", "_ranks", "_here")
    if not by:
        side = F.broadcast(side)  # at most len(cols) * len(ranks) rows
    on = [col(k).eqNullSafe(col(f"_s_{k}")) for k in [*key, "slice"]]
    counted = staged(values.join(side, on, "inner").groupBy(*key, "slice", "value", "_start", "n", "_ranks", "_here").agg(F.count(F.lit(1)).alias("_m")), "slices")
    # Two-level running count, so that no task sorts more than one sub-slice.
    sub_key = [*key, "slice"]
    counted = sub_slices(counted, sub_key)
    sub_before = W.partitionBy(*sub_key).orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)
    subs = (
        counted.groupBy(*sub_key, "_sub").agg(F.sum("_m").alias("_sm"))
        .withColumn("_sb", F.coalesce(F.sum("_sm").over(sub_before), F.lit(0)))
        .select(*[col(k).alias(f"_t_{k}") for k in [*sub_key, "_sub"]], "_sb")
    )
    inside = W.partitionBy(*sub_key, "_sub").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        counted.withColumn("_run", F.sum("_m").over(inside))
        .join(subs, [col(k).eqNullSafe(col(f"_t_{k}")) for k in [*sub_key, "_sub"]], "inner")
        .withColumn("_end", F.col("_start") + F.col("_sb") + F.col("_run"))
        .withColumn("_hit", F.filter("_here", lambda r: (r < F.col("_end")) & (r >= F.col("_end") - F.col("_m"))))
        .filter(F.size("_hit") > 0)
        .select(*key, "n", "_ranks", F.explode("_hit").alias("_r"), "value")
    )
    # collect_list holds at most len(ranks) entries per group.
    return (
        ranked.groupBy(*key, "n", "_ranks").agg(F.map_from_entries(F.collect_list(F.struct("_r", "value"))).alias("_at"))
        .select(*key, "n", F.transform("_ranks", lambda r: F.element_at(F.col("_at"), r)).alias("v"))
    )


def sub_slices(counted: DataFrame, sub_key: Sequence[str]) -> DataFrame:
    """`_sub`: which part of its slice a distinct value is in. A sketch cuts the parts, so that they hold equal numbers of
    rows of `counted` wherever the values lie; parts rise with the value."""
    cuts = counted.groupBy(*sub_key).agg(F.array_distinct(F.percentile_approx("value", [j / _SUB_SLICES for j in range(1, _SUB_SLICES)], 10_000)).alias("_cuts"))
    side = broadcast_if_small(staged(cuts.select(*[col(k).alias(f"_u_{k}") for k in sub_key], "_cuts"), "sub-cuts"))
    joined = counted.join(side, [col(k).eqNullSafe(col(f"_u_{k}")) for k in sub_key], "inner")
    sub = F.size(F.filter("_cuts", lambda c: c < F.col("value")))
    return joined.withColumn("_sub", sub).drop("_cuts", *[f"_u_{k}" for k in sub_key])


def slot_sql(cuts: Sequence[str], column: str) -> str:
    """Number of cut points below the value, which numbers right-closed bins from 0. A sum of comparisons compiles; a
    higher-order function over an array would not."""
    return " + ".join(f"int({c} < CAST({q(column)} AS DOUBLE))" for c in cuts) or "0"


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list[float] | None]:
    """Quantiles of whole columns as Python numbers: one row per column reaches the driver."""
    if not cols:
        return {}
    got = {r["column"]: r["q"] for r in quantiles(df, cols, probs, **kw).collect()}
    return {c: got.get(c) for c in cols}


def value_counts(df: DataFrame, cols: Sequence[str], as_type: str = "string", by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value, n): counts are combined map-side, so a value that fills a third of a column is cheap."""
    return long_form(df, by, cols, as_type).groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, cols: Sequence[str], as_type: str = "string", by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, mode, n_distinct); ties go to the smallest value."""
    return (
        value_counts(df, cols, as_type, by).groupBy(*by, "column")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"), F.count(F.lit(1)).alias("n_distinct"))
    )


def mode_values(df: DataFrame, cols: Sequence[str], as_type: str = "string") -> dict:
    if not cols:
        return {}
    got = {r["column"]: r["mode"] for r in modes(df, cols, as_type).collect()}
    return {c: got.get(c) for c in cols}
