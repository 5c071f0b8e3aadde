"""Data-quality reports and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col, melt_aggregates, nan_to_null, numeric_columns, q, s, text_columns
from ..functions.quantiles import modes, quantiles


def missing_report(df: DataFrame) -> DataFrame:
    """QLT-01: missing cells per column, with the table's totals on every row."""
    df = nan_to_null(df)
    names = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.expr(f"count_if({q(c)} IS NULL) AS m{i}") for i, c in enumerate(names)])
    total = " + ".join(f"m{i}" for i in range(len(names)))
    return melt_aggregates(wide, [], names, {
        "missing": lambda i: f"m{i}",
        "rows": lambda i: "_rows",
        "missing_pct": lambda i: f"try_divide(m{i} * 100.0D, _rows)",
        "total_missing": lambda i: total,
        "total_missing_pct": lambda i: f"try_divide(({total}) * 100.0D, _rows * {len(names)})",
        "has_missing": lambda i: f"m{i} > 0",
    })


def duplicate_count(df: DataFrame) -> DataFrame:
    """QLT-02: rows that repeat an earlier row. Copies are combined map-side before the shuffle."""
    return df.groupBy(*[col(c) for c in df.columns]).count().agg(
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicate_rows")
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def quality_inputs(df: DataFrame) -> DataFrame:
    """One row: records, features, missing %, duplicates. One shuffle serves all four."""
    df = nan_to_null(df)
    n = len(df.columns)
    nulls = sum((col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    grouped = df.groupBy(*[col(c) for c in df.columns]).count().select("count", nulls.alias("_nulls"))
    return grouped.agg(
        F.sum("count").alias("total_records"),
        F.lit(n).cast("long").alias("total_features"),
        F.try_divide(F.sum(F.col("_nulls") * F.col("count")) * 100.0, F.sum("count") * n).alias("missing_pct"),
        F.sum(F.col("count") - 1).alias("duplicate_records"),
    )


def _capped_score(missing: Column, dup: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - F.least(missing * 0.5, F.lit(30.0)) - F.least(dup * 0.3, F.lit(20.0)) - 10.0)


def _open_score(missing: Column, dup: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - missing * 0.5 - dup * 0.3 - 5.0)


def quality_report(df: DataFrame, capped: bool = True) -> DataFrame:
    """QLT-03 (`capped`) and QLT-04 (open deductions)."""
    score = _capped_score if capped else _open_score
    dup = F.try_divide(F.col("duplicate_records") * 100.0, F.col("total_records"))
    types = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    return quality_inputs(df).select(
        "*", types.alias("data_types"), score(F.col("missing_pct"), dup).alias("quality_score")
    )


# Report sentences.
TOO_MANY_MISSING = "High percentage of missing values detected. Consider imputation strategies."
HAS_DUPLICATES = "Duplicate records found. Consider deduplication."
LOW_SCORE = "Overall data quality is below recommended threshold. Review data sources and preprocessing."
ALL_GOOD = "Data quality is good. No immediate actions required."


def quality_recommendations(report: DataFrame) -> DataFrame:
    """QLT-05: one row per recommendation of a report row."""
    lines = F.filter(
        F.array(
            F.when(F.col("missing_pct") > 10, F.lit(TOO_MANY_MISSING)),
            F.when(F.col("duplicate_records") > 0, F.lit(HAS_DUPLICATES)),
            F.when(F.col("quality_score") < 70, F.lit(LOW_SCORE)),
        ),
        lambda s: s.isNotNull(),
    )
    return report.select(F.explode(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit(ALL_GOOD)))).alias("recommendation"))


def profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """QLT-06: one row per column; columns that start with "_" are skipped.

    `approximate` counts distinct text values with a sketch instead of exactly.
    """
    df = nan_to_null(df.select(*[col(c) for c in df.columns if not c.startswith("_")]))
    nums, texts = numeric_columns(df), text_columns(df)
    names = df.columns
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    aggs: list[Column] = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(names):
        x = q(c)
        aggs.append(F.expr(f"count_if({x} IS NULL) AS m{i}"))
        if c in nums:
            aggs += [F.expr(f"CAST({f}({x}) AS DOUBLE) AS {f}{i}") for f in ("min", "max", "avg", "stddev_samp")]
        elif approximate and c in texts:
            aggs.append(F.expr(f"approx_count_distinct({x}) AS d{i}"))
    wide = df.agg(*aggs)

    def pick(prefix, among, kind="double"):
        return lambda i: f"CAST({prefix + str(i) if names[i] in among else 'NULL'} AS {kind})"

    out = melt_aggregates(wide, [], names, {
        "type": lambda i: s(kinds[names[i]]),
        "missing": lambda i: f"m{i}",
        "missing_pct": lambda i: f"try_divide(m{i} * 100.0D, _rows)",
        "min": pick("min", nums), "max": pick("max", nums), "mean": pick("avg", nums),
        "median": pick("", []), "std": pick("stddev_samp", nums),
        "n_distinct": pick("d", texts if approximate else [], "bigint"),
    })
    if nums:
        med = quantiles(df, nums, [0.5]).select("column", F.col("q")[0].alias("_med"))
        out = out.join(F.broadcast(med), "column", "left").withColumn("median", F.col("_med")).drop("_med")  # one row per column
    if not texts:
        return out.withColumn("most_common", F.lit(None).cast("string"))
    common = modes(df, texts).select("column", F.col("mode").alias("most_common"), F.col("n_distinct").alias("_nd"))
    out = out.join(F.broadcast(common), "column", "left")  # one row per text column
    return out.withColumn("n_distinct", F.coalesce("n_distinct", "_nd")).drop("_nd")


def evaluation_row(reports: DataFrame, at: str = "reported_at") -> DataFrame:
    """QLT-08: display figures of the latest stored report."""
    fields = ["total_records", "missing_pct", "duplicate_records", "quality_score"]
    last = reports.agg(F.max_by(F.struct(*fields), F.col(at)).alias("r"))
    return last.select(
        F.col("r.total_records").alias("total_records"), F.col("r.missing_pct").alias("missing_pct"),
        F.col("r.duplicate_records").alias("duplicate_records"),
        (100.0 - F.col("r.missing_pct")).alias("completeness"), (F.col("r.quality_score") / 100.0).alias("consistency"),
    )


def data_summary(raw: DataFrame | None, processed: DataFrame | None, source: str = "_source_file") -> DataFrame:
    """QLT-07: availability, shape, columns and sources of the raw and the processed table."""
    spark = (raw if raw is not None else processed).sparkSession
    schema = "stage string, available boolean, rows long, columns long, column_names array<string>, sources long"
    out = spark.createDataFrame([], schema)
    for stage, df in (("raw", raw), ("processed", processed)):
        if df is None:
            row = spark.createDataFrame([(stage, False, 0, 0, [], 0)], schema)
        else:
            # the number of distinct sources is small; its exact count is pre-aggregated
            n_src = F.count_distinct(col(source)) if source in df.columns else F.lit(0).cast("long")
            row = df.agg(F.count(F.lit(1)).alias("rows"), n_src.alias("sources")).select(
                F.lit(stage).alias("stage"), F.lit(True).alias("available"), "rows",
                F.lit(len(df.columns)).cast("long").alias("columns"),
                F.array(*[F.lit(c) for c in df.columns]).alias("column_names"), "sources",
            )
        out = out.unionByName(row)
    return out
