"""Report aggregates: group tables, rates, histograms, box plots, period tables, risk scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.columns import col, nan_to_null, right_closed_bin
from ..functions.quantiles import quantiles
from ..functions.sizes import broadcast_if_small
from ..session import staged


def group_means(df: DataFrame, group: str | Sequence[str], columns: Sequence[str], digits: int = 3) -> DataFrame:
    """AGG-01"""
    keys = [group] if isinstance(group, str) else list(group)
    return df.groupBy(*[col(k) for k in keys]).agg(*[F.round(F.avg(col(c)), digits).alias(c) for c in columns])


def rate_by_bin(df: DataFrame, value: str, target: str, edges: Sequence[float], labels: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG-02: target rate per right-closed bin; empty bins appear with a null rate."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(i, b) for i, b in enumerate(labels)], "bin_order int, bin string")
    rates = df.groupBy(*by, right_closed_bin(col(value), edges, labels).alias("bin")).agg(
        F.avg(col(target)).alias("rate"), F.count(F.lit(1)).alias("rows"))
    if by:
        groups = df.select(*by).distinct()
        frame = groups.select("*", F.explode(F.array(*[F.struct(F.lit(i).alias("bin_order"), F.lit(b).alias("bin")) for i, b in enumerate(labels)])).alias("_b")).select(*by, "_b.*")
    else:
        frame = bins
    return frame.join(rates, [*by, "bin"], "left").select(*by, "bin_order", "bin", "rate", F.coalesce("rows", F.lit(0)).alias("rows"))


def rate_by(df: DataFrame, group: str, target: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-03"""
    return df.groupBy(*by, col(group)).agg(F.avg(col(target)).alias("rate"))


def key_figures(df: DataFrame, target: str, means: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """AGG-04"""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), (F.avg(col(target)) * 100.0).alias("target_rate_pct"),
        *[F.avg(col(c)).alias(f"mean_{c}") for c in means])


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """AGG-05: counts, descending; nulls are left out. Share of the (segment's) counted rows."""
    known = df.filter(col(column).isNotNull())
    counts = known.groupBy(*by, col(column)).agg(F.count(F.lit(1)).alias("rows"))
    if by:
        joined = counts.join(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_total")), list(by))
    else:
        joined = counts.withColumn("_total", known.agg(F.count(F.lit(1))).scalar())
    return joined.select(*by, col(column), "rows", (F.col("rows") / F.col("_total")).alias("share")).orderBy(F.desc("rows"), col(column))


def histogram(df: DataFrame, column: str, bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """AGG-06: equal-width bins between the column's minimum and maximum; empty bins are kept."""
    df = nan_to_null(df).filter(col(column).isNotNull())
    lo, hi = df.agg(F.min(col(column)).cast("double"), F.max(col(column)).cast("double")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, rows long")
    width = (hi - lo) / bins or 1.0 / bins
    slot = F.least(F.floor((col(column).cast("double") - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    counts = df.groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    frame = df.select(*by).distinct().select(*by, every) if by else df.sparkSession.range(1).select(every)
    return frame.join(counts, [*by, "bin"], "left").select(
        *by, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("upper"), F.coalesce("rows", F.lit(0)).alias("rows"))


def box_numbers(df: DataFrame, value: str, group: str | Sequence[str], whisker: float = 1.5, sliced: bool | None = None) -> DataFrame:
    """AGG-07: quartiles and 1.5 IQR whiskers per class."""
    keys = [group] if isinstance(group, str) else list(group)
    df = nan_to_null(df)
    q = quantiles(df, [value], [0.25, 0.5, 0.75], keys, sliced=sliced).filter(F.col("n") > 0).select(
        *[col(k).alias(f"_k_{k}") for k in keys], "n", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"))
    # One row per class, written once: broadcast after a count of what was written, else a join that AQE can split.
    joined = df.join(broadcast_if_small(staged(q, "box")), [col(k).eqNullSafe(col(f"_k_{k}")) for k in keys], "inner")
    reach = (F.col("q75") - F.col("q25")) * whisker
    x = col(value).cast("double")
    inside = x.between(F.col("q25") - reach, F.col("q75") + reach)
    return joined.groupBy(*[col(k) for k in keys]).agg(
        F.first("n").alias("rows"), F.first("q25").alias("q25"), F.first("median").alias("median"), F.first("q75").alias("q75"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def by_period(df: DataFrame, at: str, metrics: Mapping[str, Column], unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """AGG-08: metrics per period with their change against the previous period."""
    table = df.groupBy(*by, F.date_trunc(unit, col(at)).cast("date").alias("period")).agg(*[e.alias(m) for m, e in metrics.items()])
    prior = W.partitionBy(*by).orderBy("period")  # one row per period
    return table.select(*by, "period", *metrics, *[(F.col(m) - F.lag(m).over(prior)).alias(f"{m}_change") for m in metrics])


def risk_score(satisfaction: Column, performance: Column, years: Column, weights: Sequence[float] = (0.2, 0.3, 0.5)) -> Column:
    """RSK-01"""
    a, b, c = weights
    return (satisfaction - 1) * F.lit(a) + (F.lit(6) - performance) * F.lit(b) + F.coalesce((years < 2).cast("int"), F.lit(0)) * F.lit(c)


def risk_summary(df: DataFrame, score: Column, threshold: float = 0.6, by: Sequence[str] = ()) -> DataFrame:
    """RSK-01: rows above the threshold and the score's range."""
    return df.select(*by, score.alias("_s")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_s") > threshold).alias("high_risk"),
        F.min("_s").alias("min_score"), F.max("_s").alias("max_score"))
