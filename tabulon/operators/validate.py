"""Schema, range and set rules: reports and filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import presets
from ..functions.columns import col, melt_aggregates, q, require
from .clean import to_category, to_number

_FINDING = "rule string, column string, detail string"


def schema_findings(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS,
                    numeric: Sequence[str] = presets.NUMERIC_COLUMNS) -> DataFrame:
    """VAL-01: missing required columns and listed columns that are not numeric; reads the schema only."""
    rows = [("required", c, "column is missing") for c in required if c not in df.columns]
    rows += [
        ("numeric", c, f"column has type {df.schema[c].dataType.simpleString()}")
        for c in numeric if c in df.columns and not isinstance(df.schema[c].dataType, T.NumericType)
    ]
    return df.sparkSession.createDataFrame(rows, _FINDING)


def set_findings(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """VAL-02: values outside the allowed set with their counts; null is one of them."""
    bad = ~F.coalesce(col(column).isin(list(allowed)), F.lit(False))
    return (
        df.filter(bad).groupBy(col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("allowed").alias("rule"), F.lit(column).alias("column"), "value", "rows")
    )


def range_findings(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """VAL-03: columns whose minimum or maximum lies outside the closed bounds."""
    names = [c for c in ranges if c in df.columns]
    wide = df.agg(*[F.expr(f"CAST({f}({q(c)}) AS DOUBLE) AS {f}{i}") for i, c in enumerate(names) for f in ("min", "max")])
    rows = melt_aggregates(wide, [], names, {
        "lowest": lambda i: f"min{i}", "highest": lambda i: f"max{i}",
        "lower_bound": lambda i: f"{float(ranges[names[i]][0])!r}D", "upper_bound": lambda i: f"{float(ranges[names[i]][1])!r}D",
    })
    return rows.filter((F.col("lowest") < F.col("lower_bound")) | (F.col("highest") > F.col("upper_bound")))


def schema_report(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS, numeric: Sequence[str] = presets.NUMERIC_COLUMNS,
                  allowed: Mapping[str, Sequence] | None = None, ranges: Mapping[str, tuple[float, float]] | None = None) -> DataFrame:
    """VAL-01 … VAL-03 as one report (rule, column, detail); empty if the table is valid."""
    out = schema_findings(df, required, numeric)
    for c, values in (allowed or {}).items():
        if c in df.columns:
            bad = set_findings(df, c, values)
            out = out.unionByName(bad.select("rule", "column", F.format_string("%s in %d rows", F.coalesce("value", F.lit("null")), "rows").alias("detail")))
    if ranges:
        bad = range_findings(df, ranges)
        out = out.unionByName(bad.select(F.lit("range").alias("rule"), "column", F.format_string(
            "%.1f to %.1f, allowed %.1f to %.1f", "lowest", "highest", "lower_bound", "upper_bound").alias("detail")))
    return out


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def filter_ranges(df: DataFrame, ranges: Mapping[str, tuple[float, float]] = presets.RANGES) -> DataFrame:
    """VAL-04: keep rows whose values lie in the closed ranges; a missing value drops the row."""
    return df.filter(_all([col(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns]))


def filter_sets(df: DataFrame, allowed: Mapping[str, Sequence] = presets.ALLOWED) -> DataFrame:
    """VAL-05: keep rows whose values are in the allowed sets."""
    return df.filter(_all([col(c).isin(list(v)) for c, v in allowed.items() if c in df.columns]))


def _retype(df: DataFrame, required: Sequence[str], numeric: Sequence[str], categories: Sequence[str]) -> DataFrame:
    require(df, required)
    return df.transform(to_number, numeric).transform(to_category, categories)


def validate(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS, numeric: Sequence[str] = presets.NUMERIC_COLUMNS,
             categories: Sequence[str] = presets.CATEGORY_COLUMNS, ranges: Mapping = presets.RANGES,
             allowed: Mapping = presets.ALLOWED) -> DataFrame:
    """VAL-06: raise on missing columns, retype, then apply the range and set filters."""
    return _retype(df, required, numeric, categories).transform(filter_ranges, ranges).transform(filter_sets, allowed)


def validation_report(df: DataFrame, required: Sequence[str] = presets.REQUIRED_COLUMNS, numeric: Sequence[str] = presets.NUMERIC_COLUMNS,
                      categories: Sequence[str] = presets.CATEGORY_COLUMNS, ranges: Mapping = presets.RANGES,
                      allowed: Mapping = presets.ALLOWED) -> DataFrame:
    """Rows in, rows failing each rule, rows kept: one pass."""
    typed = _retype(df, required, numeric, categories)
    rules = {f"range:{c}": col(c).between(lo, hi) for c, (lo, hi) in ranges.items() if c in df.columns}
    rules |= {f"allowed:{c}": col(c).isin(list(v)) for c, v in allowed.items() if c in df.columns}
    passed = {k: F.coalesce(e, F.lit(False)) for k, e in rules.items()}
    names = ["rows_in", *rules, "rows_kept"]
    checks = [F.lit(True), *[~p for p in passed.values()], _all(list(passed.values()))]
    wide = typed.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(checks)])
    return melt_aggregates(wide, [], names, {"rows": lambda i: f"r{i}"}, key="rule")
