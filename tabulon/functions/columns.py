"""Column selection and small expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


# Fields of an aggregate's buffers and keys up to which Spark compiles it as one stage (spark.sql.codegen.maxFields is 100); beyond
# them a row costs tens of times as much.
COMPILED_FIELDS = 90


def col(name: str) -> Column:
    """Column by its literal name, so that dots and blanks in names are safe."""
    return F.col(q(name))


def q(name: str) -> str:
    """A column name as it is written in SQL. One SQL text per expression spares a driver call per node."""
    return "`" + name.replace("`", "``") + "`"


def s(text: str) -> str:
    """A text literal as it is written in SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def require(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas has one missing value, Spark has two: fold NaN into NULL once, at ingest."""
    floats = set(float_columns(df))
    if not floats:
        return df
    return df.selectExpr(*[f"CASE WHEN NOT isnan({q(c)}) THEN {q(c)} END AS {q(c)}" if c in floats else q(c) for c in df.columns])


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    """One projection that swaps or appends all of `new`; keeps the plan flat."""
    return df.withColumns(dict(new)) if new else df


def melt_aggregates(row: DataFrame, by: Sequence[str], names: Sequence[str], fields: Mapping[str, Callable[[int], str]],
                    key: str = "column") -> DataFrame:
    """Turn one wide aggregate row per group into one row per (group, column).

    `fields[name](i)` is the SQL, over the wide row, of field `name` for the i-th column.
    """
    structs = [
        "named_struct(" + ", ".join([f"{s(key)}, {s(n)}"] + [f"{s(f)}, {make(i)}" for f, make in fields.items()]) + ")"
        for i, n in enumerate(names)
    ]
    return row.selectExpr(*[q(b) for b in by], f"inline(array({', '.join(structs)}))")


def long_form(df: DataFrame, by: Sequence[str], names: Sequence[str], as_type: str, key: str = "column") -> DataFrame:
    """(by…, column, value) with one row per non-null cell."""
    cells = ", ".join(f"named_struct({s(key)}, {s(n)}, 'value', CAST({q(n)} AS {as_type}))" for n in names)
    return df.selectExpr(*[q(b) for b in by], f"inline(array({cells}))").filter("value IS NOT NULL")


def column_groups(names: Sequence[str], fields: int) -> list[list[str]]:
    """The columns in groups whose aggregates, of `fields` buffer fields a column, still compile. A group reads its own columns only."""
    size = max(1, COMPILED_FIELDS // fields)
    return [list(names[i:i + size]) for i in range(0, len(names), size)] or [[]]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def right_closed_bin(c: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edges[i], edges[i+1]] holding `c`; null outside all of them."""
    if len(labels) != len(edges) - 1 or list(edges) != sorted(set(edges)):
        raise ValueError("edges must rise strictly and exceed the labels by one")
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((c > F.lit(lo)) & (c <= F.lit(hi)), F.lit(label)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0; an unknown condition counts as 0."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))
