"""Cleaning: names, empty rows and columns, target and type coercion."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import presets
from ..functions.columns import col, nan_to_null, replace_columns


def drop_internal_columns(df: DataFrame, prefix: str = "_") -> DataFrame:
    """CLN-01: drop columns whose name starts with `prefix`."""
    return df.select(*[col(c) for c in df.columns if not c.startswith(prefix)])


def clean_names(names: Iterable[str]) -> list[str]:
    bases = [re.sub(r"[^a-zA-Z0-9_]", "", name.strip().replace(" ", "_").lower()) or f"column_{k}" for k, name in enumerate(names, 1)]
    given: set[str] = set()
    out = []
    for base in bases:
        name, n = base, 1
        while name in given or n > 1 and name in bases:
            n += 1
            name = f"{base}_{n}"
        given.add(name)
        out.append(name)
    return out


def clean_column_names(df: DataFrame) -> DataFrame:
    """CLN-02: trimmed, lower-case, [a-z0-9_] names; a name met again gets the first free of _2, _3, …

    A name of which nothing is left becomes `column_` and its place.
    """
    return df.toDF(*clean_names(df.columns))


def drop_empty(df: DataFrame) -> DataFrame:
    """CLN-03: drop columns that are wholly null, then rows that are wholly null."""
    df = nan_to_null(df)
    found = df.agg(*[f.alias(f"{k}{i}") for i, c in enumerate(df.columns) for k, f in (("v", F.max(col(c).isNotNull())), ("g", F.max(col(c).isNull())))]).first()
    kept = [c for i, c in enumerate(df.columns) if found[f"v{i}"]]
    if not kept:
        return df.select().limit(0)
    # A column without gaps leaves no row wholly null; a filter would make every later scan read all columns.
    whole = any(not found[f"g{i}"] for i in range(len(df.columns)))
    return df.select(*[col(c) for c in kept]) if whole else df.select(*[col(c) for c in kept]).dropna(how="all")


def binary_label(c: Column, positive: Sequence[str] = presets.POSITIVE_LABELS,
                 negative: Sequence[str] = presets.NEGATIVE_LABELS) -> Column:
    return F.when(c.isin(list(positive)), 1).when(c.isin(list(negative)), 0).cast("int")


def encode_target(df: DataFrame, target: str, **spellings) -> DataFrame:
    """CLN-04: target text to 1/0, anything else to null; a numeric 0/1 target passes through."""
    kind = df.schema[target].dataType
    if isinstance(kind, T.BooleanType):
        return replace_columns(df, {target: col(target).cast("int")})
    if isinstance(kind, T.NumericType):
        return replace_columns(df, {target: F.when(col(target).isin(0, 1), col(target).cast("int"))})
    return replace_columns(df, {target: binary_label(col(target), **spellings)})


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CLN-05: listed columns to double; what does not parse becomes null."""
    present = [c for c in columns if c in df.columns]
    return nan_to_null(replace_columns(df, {c: col(c).try_cast("double") for c in present}))


def to_category(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CLN-06: listed columns to text; nulls stay."""
    return replace_columns(df, {c: col(c).cast("string") for c in columns if c in df.columns})


def clean(df: DataFrame, target: str | None = "attrition", numeric: Sequence[str] = presets.NUMERIC_COLUMNS,
          categories: Sequence[str] = presets.CATEGORY_COLUMNS, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """CLN-07: the whole chain. `hold` is what the renamed table goes through before it is read, `staged` for example."""
    out = clean_column_names(drop_internal_columns(df))
    out = drop_empty(hold(out) if hold else out)
    if target and target in out.columns:
        out = encode_target(out, target)
    return out.transform(to_number, numeric).transform(to_category, categories)


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shape before and after, as one row."""
    n_b, n_a = len(before.columns), len(after.columns)
    kept = after.agg(F.count(F.lit(1))).scalar()
    return before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn("rows_after", kept).select(
        "rows_before", "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        F.lit(n_b).cast("long").alias("columns_before"), F.lit(n_a).cast("long").alias("columns_after"),
        F.lit(n_b - n_a).cast("long").alias("columns_removed"),
    )
