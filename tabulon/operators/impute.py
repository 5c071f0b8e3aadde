"""Missing values. Fill values are aggregates of one row per column; fills that depend on order carry state across chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import ordered
from ..functions.columns import col, nan_to_null, numeric_columns, replace_columns, text_columns
from ..functions.quantiles import mode_values, quantile_values
from .quality import missing_report

STRATEGIES = ("auto", "drop", "mean", "median", "mode", "interpolate")


def _fill(df: DataFrame, values: dict) -> DataFrame:
    """Fill with constants. An integral column that takes a fractional value becomes double, as in pandas."""
    new = {}
    for c, v in values.items():
        if v is None:
            continue
        kind = df.schema[c].dataType
        fits = isinstance(v, str) or kind.simpleString() in ("double", "float") or float(v).is_integer()
        new[c] = F.coalesce(col(c) if fits else col(c).cast("double"), F.lit(v).cast(kind if fits else "double"))
    return replace_columns(df, new)


def drop_missing(df: DataFrame) -> DataFrame:
    """IMP-02"""
    return nan_to_null(df).dropna("any")


def mean_values(df: DataFrame, columns: Sequence[str]) -> dict:
    row = df.agg(*[F.avg(col(c)).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns)}


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """IMP-03"""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    return _fill(df, mean_values(df, columns)) if columns else df


def fill_median(df: DataFrame, columns: Sequence[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """IMP-04: exact interpolated median; `accuracy` asks for the sketch instead."""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    if accuracy:
        row = df.agg(*[F.percentile_approx(col(c).cast("double"), 0.5, accuracy).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return _fill(df, {c: row[i] for i, c in enumerate(columns)})
    return _fill(df, {c: q[0] if q else None for c, q in quantile_values(df, columns, [0.5]).items()})


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None, default: str = "Unknown") -> DataFrame:
    """IMP-05: most frequent text, ties to the smallest, `default` for an all-null column."""
    columns = list(columns or text_columns(df))
    return _fill(df, {c: default if m is None else m for c, m in mode_values(df, columns).items()})


def fill_interpolate(df: DataFrame, order_by: str, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                     chunks: int | None = None) -> DataFrame:
    """IMP-06"""
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df, exclude=[order_by, *by]))
    return ordered.interpolate(df, columns, order_by, by, chunks=chunks)


def fill_forward_backward(df: DataFrame, order_by: str, columns: Sequence[str] | None = None, by: Sequence[str] = (),
                          chunks: int | None = None) -> DataFrame:
    """IMP-07"""
    df = nan_to_null(df)
    columns = list(columns or [c for c in df.columns if c != order_by and c not in by])
    return ordered.carry_forward(df, columns, order_by, by, backfill=True, chunks=chunks)


def fill_for_model(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """IMP-08: features with their mean, a 0/1 target with its mode (0 if there is none)."""
    df = fill_mean(df, features)
    mode = mode_values(df, [target], "double")[target]
    return replace_columns(df, {target: F.coalesce(col(target), F.lit(0 if mode is None else mode).cast(df.schema[target].dataType))})


def fill_constant(df: DataFrame, number: float | None = 0, text: str | None = "Unknown",
                  columns: Sequence[str] | None = None) -> DataFrame:
    """IMP-09"""
    df = nan_to_null(df)
    chosen = set(columns or df.columns)
    values = {c: number for c in numeric_columns(df) if c in chosen and number is not None}
    values |= {c: text for c in text_columns(df) if c in chosen and text is not None}
    return _fill(df, values)


def fill_auto(df: DataFrame, order_by: str, by: Sequence[str] = (), exclude: Sequence[str] = (),
              chunks: int | None = None) -> DataFrame:
    """IMP-01: over 50 % missing drops the column, over 20 % takes median or mode, less is filled in order."""
    df = nan_to_null(df)
    share = {r["column"]: r["missing_pct"] or 0.0 for r in missing_report(df).select("column", "missing_pct").collect()}
    keep_out = {order_by, *by, *exclude}
    gaps = {c: s for c, s in share.items() if s > 0 and c not in keep_out}
    df = df.select(*[col(c) for c in df.columns if gaps.get(c, 0) <= 50])
    middle = [c for c, s in gaps.items() if 20 < s <= 50]
    numeric = set(numeric_columns(df))
    out = fill_median(df, [c for c in middle if c in numeric]) if any(c in numeric for c in middle) else df
    other = [c for c in middle if c not in numeric]
    if other:
        # text keeps its type; any other type takes its own most frequent value
        texts = set(text_columns(df))
        if any(c in texts for c in other):
            out = fill_mode(out, [c for c in other if c in texts])
        rest = {c: m for c, m in mode_values(out, [c for c in other if c not in texts]).items() if m is not None}
        out = replace_columns(out, {c: F.coalesce(col(c), F.lit(m).cast(df.schema[c].dataType)) for c, m in rest.items()})
    few = [c for c, s in gaps.items() if s <= 20]
    return fill_forward_backward(out, order_by, few, by, chunks) if few else out


def impute(df: DataFrame, strategy: str = "auto", order_by: str | None = None, by: Sequence[str] = (), **kw) -> DataFrame:
    """Dispatch by strategy name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    if strategy in ("auto", "interpolate"):
        if order_by is None:
            raise ValueError(f"strategy {strategy!r} needs order_by: Spark rows have no order of their own")
        return (fill_auto if strategy == "auto" else fill_interpolate)(df, order_by=order_by, by=by, **kw)
    return {"drop": drop_missing, "mean": fill_mean, "median": fill_median, "mode": fill_mode}[strategy](df, **kw)
