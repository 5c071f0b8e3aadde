"""Outlier capping and replacement, with per-column counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, melt_aggregates, nan_to_null, numeric_columns, replace_columns
from ..functions.quantiles import quantile_values

THRESHOLDS = {"iqr": 1.5, "zscore": 3.0}


def iqr_bounds(df: DataFrame, columns: Sequence[str], threshold: float = 1.5, accuracy: int | None = None) -> dict[str, tuple[float, float]]:
    """[Q1 - k IQR, Q3 + k IQR] per column; `accuracy` takes the quartiles from a sketch."""
    if accuracy:
        row = df.agg(*[F.percentile_approx(col(c).cast("double"), [0.25, 0.75], accuracy).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        quart = {c: row[i] for i, c in enumerate(columns)}
    else:
        quart = quantile_values(df, columns, [0.25, 0.75])
    return {c: (q[0] - threshold * (q[1] - q[0]), q[1] + threshold * (q[1] - q[0])) for c, q in quart.items() if q}


def _capped(c: str, bounds: tuple[float, float]) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(bounds[0])), F.lit(bounds[1])))


def _iqr_columns(df, columns, threshold, accuracy):
    return {c: _capped(c, b) for c, b in iqr_bounds(df, columns, threshold, accuracy).items()}


def _zscore_columns(df, columns, threshold, accuracy):
    row = df.agg(*[f(col(c)).cast("double").alias(f"{p}{i}") for i, c in enumerate(columns)
                   for p, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if accuracy:
        mids = df.agg(*[F.percentile_approx(col(c).cast("double"), 0.5, accuracy).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        med = {c: mids[i] for i, c in enumerate(columns)}
    else:
        med = {c: q[0] if q else None for c, q in quantile_values(df, columns, [0.5]).items()}
    out = {}
    for i, c in enumerate(columns):
        mean, std = row[f"m{i}"], row[f"s{i}"]
        if std:
            z = F.abs((col(c).cast("double") - F.lit(mean)) / F.lit(std))
            out[c] = F.when(z > threshold, F.lit(med[c])).otherwise(col(c).cast("double"))
    return out


def _treat(df: DataFrame, method: str, columns: Sequence[str] | None, exclude: Sequence[str], threshold: float | None,
           accuracy: int | None) -> tuple[DataFrame, dict[str, Column]]:
    if method not in THRESHOLDS:
        raise ValueError(f"method must be one of {tuple(THRESHOLDS)}")
    df = nan_to_null(df)
    columns = [c for c in (columns or numeric_columns(df)) if c not in set(exclude)]
    if not columns:
        return df, {}
    rule = _iqr_columns if method == "iqr" else _zscore_columns
    return df, rule(df, columns, THRESHOLDS[method] if threshold is None else threshold, accuracy)


def treat_outliers(df: DataFrame, method: str = "iqr", *, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
                   threshold: float | None = None, accuracy: int | None = None) -> DataFrame:
    """OUT-01 (`iqr`: cap to the fences) and OUT-02 (`zscore`: replace by the median). Name the target in `exclude`."""
    return replace_columns(*_treat(df, method, columns, exclude, threshold, accuracy))


def outlier_report(df: DataFrame, method: str = "iqr", *, columns: Sequence[str] | None = None, exclude: Sequence[str] = (),
                   threshold: float | None = None, accuracy: int | None = None) -> DataFrame:
    """OUT-03: cells the method would change, per column and as percent of rows; nulls are not outliers."""
    df, new = _treat(df, method, columns, exclude, threshold, accuracy)
    names = list(new)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, outliers long, outlier_pct double")
    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[F.count_if(~new[c].eqNullSafe(col(c).cast("double"))).alias(f"o{i}") for i, c in enumerate(names)])
    return melt_aggregates(wide, [], names, {
        "outliers": lambda i: f"o{i}", "outlier_pct": lambda i: f"try_divide(o{i} * 100.0D, _rows)",
    })
