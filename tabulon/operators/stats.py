"""Descriptive and inferential statistics. One aggregate over the table, then arithmetic on result rows.

`by` names segment columns: one grouped aggregate serves every segment at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions import ordered
from ..functions.columns import col, column_groups, melt_aggregates, nan_to_null, numeric_columns, q, replace_columns, require, s, union_all
from ..functions.distributions import f_p_value, t_p_value
from ..functions.quantiles import mode_values, quantile_values, quantiles, slot_sql, value_counts
from ..functions.sizes import BROADCAST_ROWS, ROWS_PER_TASK, spread
from ..session import staged
from .impute import fill_mean

# Above this number of pairs one aggregate over all of them no longer compiles well.
WIDE_PAIRS = 20
TARGET_HINTS = ("attrition", "left", "churn")
LEVELS = {
    "basic": ("descriptive", "correlation"),
    "comprehensive": ("descriptive", "correlation", "hypothesis_testing", "feature_importance"),
    "advanced": ("descriptive", "correlation", "hypothesis_testing", "feature_importance", "pca"),
}


def find_target(df: DataFrame, target: str | None = None) -> str:
    """ST-12: the named column, else the first whose name suggests a target."""
    if target:
        require(df, [target])
        return target
    for c in df.columns:
        if any(h in c.lower() for h in TARGET_HINTS):
            return c
    raise ValueError("no target column found; pass target=")


def describe(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), *, shape: bool = True,
             sliced: bool | None = None) -> DataFrame:
    """ST-01: count, mean, std, min, max, median, quartiles, and (`shape`) population skewness and excess kurtosis.

    Columns without any value are left out.
    """
    df = nan_to_null(df)
    by = list(by)
    names = list(columns or numeric_columns(df, exclude=by))
    functions = {"count": "count", "avg": "mean", "stddev_samp": "std", "min": "min", "max": "max"}
    if shape:
        functions |= {"skewness": "skewness", "kurtosis": "kurtosis"}

    def aggregates(columns: Sequence[str]) -> list[Column]:
        return [F.expr(f"{f}(CAST({q(c)} AS DOUBLE)) AS {f}{i}") for i, c in enumerate(columns) for f in functions]

    # zero variance gives NaN where pandas gives none
    fields = {n: (lambda i, f=f: f"nullif({f}{i}, double('NaN'))" if f in ("skewness", "kurtosis") else f"{f}{i}") for f, n in functions.items()}
    # buffer fields of a column: 8, and 4 and 5 for its shape
    out = union_all([melt_aggregates(df.groupBy(*by).agg(*aggregates(own)), by, own, fields, key="variable")
                     for own in column_groups(names, 17 if shape else 8)]).filter(F.col("count") > 0)
    cuts = quantiles(df, names, [0.25, 0.5, 0.75], by, sliced=sliced).select(
        *[col(b).alias(f"_b_{b}") for b in by], F.col("column").alias("_v"), F.col("q").alias("_q"))
    cuts = cuts if by else F.broadcast(cuts)  # without segments: one row per column
    on = [col(b).eqNullSafe(col(f"_b_{b}")) for b in by] + [F.col("variable") == F.col("_v")]
    out = out.join(cuts, on, "left")
    keep = ["count", "mean", "std", "min", "max", *(["skewness", "kurtosis"] if shape else [])]
    return out.select(*by, "variable", *keep, F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q75"))


def describe_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """ST-02: the eight rows of a describe table, one column per variable."""
    d = describe(df, columns, shape=False)
    stats = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    labels = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    cells = d.select("variable", F.posexplode(F.array(*[F.col(s).cast("double") for s in stats])).alias("pos", "value"))
    names = list(columns or numeric_columns(df))
    return (
        cells.groupBy("pos").pivot("variable", names).agg(F.first("value"))
        .select(F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("pos") + 1).alias("statistic"), *[col(n) for n in names])
    )


# --- correlation --------------------------------------------------------------------------------------------------

def _square(pairs: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Both triangles and the diagonal, from the rows with i < j."""
    flipped = pairs.select(*by, F.explode(F.array(
        F.struct(F.col("variable1").alias("a"), F.col("variable2").alias("b")),
        F.struct(F.col("variable2").alias("a"), F.col("variable1").alias("b")),
    )).alias("_p"), "correlation").select(*by, F.col("_p.a").alias("variable1"), F.col("_p.b").alias("variable2"), "correlation")
    groups = pairs.select(*by).distinct() if by else pairs.limit(1).select()
    unit = groups.select(*by, F.explode(F.array(*[F.lit(n) for n in names])).alias("variable1"))
    return flipped.unionByName(unit.select(*by, "variable1", F.col("variable1").alias("variable2"), F.lit(1.0).alias("correlation")))


def corr_sql(a: str, b: str, whole: bool = False) -> str:
    """Pearson r over complete pairs; null for a column that is constant there, whatever rounding makes of its spread.

    Where both columns are known to be `whole`, the smallest and largest value of each serve all its pairs.
    """
    x, y = (f"CAST({q(c)} AS DOUBLE)" for c in (a, b))
    known = "" if whole else f"FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
    varies = " AND ".join(f"min({v}) {known} < max({v}) {known}" for v in (x, y))
    return f"CASE WHEN {varies} THEN try_divide(regr_sxy({x}, {y}), sqrt(regr_sxx({x}, {y}) * regr_syy({x}, {y}))) END"


def with_nulls(df: DataFrame, names: Sequence[str]) -> set[str]:
    """The columns that have a null."""
    row = df.agg(*[F.max(col(c).isNull()).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return {c for i, c in enumerate(names) if row[i]}


def pearson(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), *, full: bool = False) -> DataFrame:
    """ST-03: pairwise-complete Pearson r, all pairs in one pass; (variable1, variable2, correlation) with i < j.

    Few pairs are one aggregate. Many pairs would make that aggregate too wide to compile: each task then adds up
    co-moment matrices of its Arrow batches, and only those matrices are shuffled.
    """
    df = nan_to_null(df)
    by = list(by)
    names = list(columns or numeric_columns(df, exclude=by))
    pairs = list(combinations(names, 2))
    if len(pairs) > WIDE_PAIRS and not by:
        out = _pearson_matrices(df, names)
    else:
        holes = with_nulls(df, names)
        wide = df.groupBy(*by).agg(*[F.expr(f"{corr_sql(a, b, not holes & {a, b})} AS r{i}") for i, (a, b) in enumerate(pairs)])
        rows = ", ".join(f"named_struct('variable1', {s(a)}, 'variable2', {s(b)}, 'correlation', r{i})" for i, (a, b) in enumerate(pairs))
        out = wide.selectExpr(*[q(b) for b in by], f"inline(array({rows}))")
    return _square(out, names, by) if full else out


def _pearson_matrices(df: DataFrame, names: Sequence[str]) -> DataFrame:
    k = len(names)
    upper = np.triu_indices(k, 1)

    def moments(batches):
        """Per task and pair: rows, means and centred co-moments over the rows where both values are known."""
        total = products = ends = None
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(np.float64)
            known = ~np.isnan(x)
            if total is None:
                with np.errstate(all="ignore"):
                    shift = np.where(known.any(0), np.nansum(x, 0) / np.maximum(known.sum(0), 1), 0.0)
                total = np.zeros((5, k, k))
            # Smallest and largest value of each pair's complete rows: a constant is told by them, not by its spread.
            # Of a column without gaps the other's own extremes serve.
            gaps = np.flatnonzero(~known.all(0))
            low, high = (np.repeat(np.where(known, y, -np.inf).max(0)[:, None], k, 1) for y in (-x, x))
            for j in gaps:
                low[:, j], high[:, j] = (np.where(known & known[:, j:j + 1], y, -np.inf).max(0) for y in (-x, x))
            new = np.stack([low, low.T, high, high.T])
            ends = new if ends is None else np.maximum(ends, new)
            x = np.where(known, x - shift, 0.0)
            m = known.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x)])
            cross = x.T @ x
            products = cross if products is None else products + cross
        if total is None:
            return
        n, sx, sy, sxx, syy = (t[upper] for t in total)
        sxy = products[upper]
        ok = n > 0
        d = np.maximum(n, 1)
        out = [n, shift[upper[0]] + sx / d, shift[upper[1]] + sy / d, sxx - sx * sx / d, syy - sy * sy / d, sxy - sx * sy / d, *(e[upper] for e in ends)]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(ok), pa.int32()), *[pa.array(v[ok]) for v in out]], names=["pair", "n", "mx", "my", "xx", "yy", "xy", "lx", "ly", "hx", "hy"])

    parts = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(
        moments, "pair int, n double, mx double, my double, xx double, yy double, xy double, lx double, ly double, hx double, hy double")
    # sums within tasks plus the spread of the task means around the common mean; one row per task and pair
    pooled = parts.selectExpr(
        "*", "mx - sum(n * mx) OVER (PARTITION BY pair) / sum(n) OVER (PARTITION BY pair) AS dx",
        "my - sum(n * my) OVER (PARTITION BY pair) / sum(n) OVER (PARTITION BY pair) AS dy",
    ).groupBy("pair").agg(F.expr("sum(xx + n * dx * dx) AS a"), F.expr("sum(yy + n * dy * dy) AS b"), F.expr("sum(xy + n * dx * dy) AS c"), F.expr("max(hx) > -max(lx) AND max(hy) > -max(ly) AS varies"))
    label = ", ".join(f"named_struct('variable1', {s(names[i])}, 'variable2', {s(names[j])})" for i, j in zip(*upper))
    r = pooled.selectExpr(f"array({label})[pair] AS l", "a", "b", "c", "varies")
    return r.selectExpr("l.variable1", "l.variable2", "CASE WHEN varies AND a > 0 AND b > 0 THEN greatest(-1D, least(1D, c / sqrt(a * b))) END AS correlation")


def rank_table(counts: DataFrame, chunks: int | None = None) -> DataFrame:
    """(column, value, rank): average ranks of tied values, from value counts."""
    total = ordered.running_total(counts, ["column"], "value", "n", "_upto", chunks)
    return total.select("column", "value", (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))


def spearman(df: DataFrame, columns: Sequence[str] | None = None, *, full: bool = False, chunks: int | None = None) -> DataFrame:
    """ST-04: pairwise-complete Spearman rho with average ranks.

    A pair of columns without nulls shares ranks that are computed once per column. A pair with a null in either
    column is ranked over its complete rows, as the definition asks: values are counted by the pattern of nulls of their
    rows, and the counts of all patterns in which the other column is known give the ranks of that pair.
    """
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    holes = with_nulls(df, names)
    whole = [c for c in names if c not in holes]
    parts = []
    if len(whole) > 1:
        ranked = spread(df.select(*[col(c).cast("double").alias(c) for c in whole]))
        # Values of all columns are counted in one pass and written; sizes and ranks come from that table.
        counts = staged(value_counts(ranked, whole, "double"), "ranks")
        sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
        cut = chunks or (1 if max(sizes.values(), default=0) <= ROWS_PER_TASK else None)  # the ranking sorts distinct values
        ranks = staged(rank_table(counts, cut), "ranks")
        for i, c in enumerate(whole):
            side = ranks.filter(F.col("column") == c).select(F.col("value").alias(f"_v{i}"), F.col("rank").alias(f"_r{i}"))
            # one row per distinct value: broadcast if the count allows, else a join whose hot values AQE splits
            side = F.broadcast(side) if sizes.get(c, 0) <= BROADCAST_ROWS else side
            ranked = ranked.join(side, col(c) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
        parts.append(pearson(ranked.select(*[F.col(f"_r{i}").alias(c) for i, c in enumerate(whole)]), whole))
    pairs = [(a, b) for a, b in combinations(names, 2) if a in holes or b in holes]
    if pairs:
        parts += _spearman_patterns(df, names, pairs, chunks)
    if not parts:
        raise ValueError("rank correlation needs two numeric columns")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _square(out, names, []) if full else out


def _spearman_patterns(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]], chunks: int | None) -> list[DataFrame]:
    """Pairs whose rows differ. A row adds one count for each column, whatever the number of pairs."""
    place = {c: i for i, c in enumerate(names)}
    partners = {c: sorted({place[b if a == c else a] for a, b in pairs if c in (a, b)}) for c in names}
    held = spread(df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]))
    pattern = F.concat(*[F.when(F.col(f"c{i}").isNull(), "0").otherwise("1") for i in range(len(names))])
    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"c{i}").alias("value")) for i in range(len(names))])
    long = held.select(pattern.alias("known"), F.explode(cells).alias("e")).select("e.column", "e.value", "known").where("value IS NOT NULL")
    counts = long.groupBy("column", "value", "known").agg(F.count("*").alias("n")).groupBy("column", "value").agg(
        *[F.sum(F.when(F.substring("known", j + 1, 1) == "1", F.col("n")).otherwise(0)).alias(f"n{j}") for j in range(len(names))])
    counts = staged(counts, "rank-patterns")
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
    cut = chunks or (1 if max(sizes.values(), default=0) <= ROWS_PER_TASK else None)
    ranks = ordered.running_totals(counts, ["column"], "value", {f"n{j}": f"u{j}" for j in range(len(names))}, cut)
    rank = F.array(*[F.col(f"u{j}") - (F.col(f"n{j}") - 1) / F.lit(2.0) for j in range(len(names))])
    ranks = staged(ranks.select("column", "value", rank.alias("rank")), "rank-patterns")
    for i, c in enumerate(names):
        if partners[c]:
            side = ranks.where(F.col("column") == i).select(F.col("value").alias(f"v{i}"), F.col("rank").alias(f"r{i}"))
            side = F.broadcast(side) if sizes.get(i, 0) * len(names) <= BROADCAST_ROWS * 4 else side
            held = held.join(side, F.col(f"c{i}") == F.col(f"v{i}"), "left").drop(f"v{i}")
    both = lambda a, b: F.when(F.col(f"c{a}").isNotNull() & F.col(f"c{b}").isNotNull(), F.element_at(f"r{a}", b + 1))
    out = []
    for at in range(0, len(pairs), WIDE_PAIRS):
        own = [(place[a], place[b]) for a, b in pairs[at:at + WIDE_PAIRS]]
        ranked = held.select(*[x for k, (a, b) in enumerate(own) for x in (both(a, b).alias(f"x{k}"), both(b, a).alias(f"y{k}"))])
        wide = ranked.agg(*[F.expr(f"{corr_sql(f'x{k}', f'y{k}')} AS r{k}") for k in range(len(own))])
        rows = ", ".join(f"named_struct('variable1', {s(names[a])}, 'variable2', {s(names[b])}, 'correlation', r{k})" for k, (a, b) in enumerate(own))
        out.append(wide.selectExpr(f"inline(array({rows}))"))
    return out


def high_correlations(matrix: DataFrame, threshold: float = 0.7) -> DataFrame:
    """ST-05: pairs with |r| at or above the threshold, labelled by strength."""
    r = F.abs("correlation")
    return matrix.filter(r >= threshold).withColumn("strength", F.when(r >= 0.8, F.lit("strong")).otherwise(F.lit("moderate")))


def correlation_label(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """ST-06: r of two columns with its strength in words."""
    r = F.abs("correlation")
    return pearson(df, [a, b], by).withColumn(
        "strength", F.when(r > 0.7, F.lit("strong")).when(r > 0.3, F.lit("moderate")).otherwise(F.lit("weak")))


# --- tests against a target -----------------------------------------------------------------------------------------

def t_tests(df: DataFrame, target: str, columns: Sequence[str] | None = None, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """ST-07: pooled two-sided t-test of each numeric column between target 1 and target 0."""
    df = nan_to_null(df)
    by = list(by)
    names = list(columns or numeric_columns(df, exclude=[target, *by]))
    parts = []
    for own in column_groups(names, 12):
        aggs = []
        for i, c in enumerate(own):
            for g in (1, 0):
                x = f"CASE WHEN {q(target)} = {g} THEN CAST({q(c)} AS DOUBLE) END"
                aggs += [F.expr(f"{f}({x}) AS {k}{g}_{i}") for k, f in (("n", "count"), ("m", "avg"), ("v", "var_samp"))]
        parts.append(melt_aggregates(df.groupBy(*by).agg(*aggs), by, own, {
            f"{k}{g}": (lambda i, k=k, g=g: f"{k}{g}_{i}") for k in "nmv" for g in (1, 0)}, key="variable"))
    rows = union_all(parts)
    n1, n0 = F.col("n1"), F.col("n0")
    dof = n1 + n0 - 2
    ss = lambda n, v: (n - 1) * F.coalesce(v, F.lit(0.0))  # noqa: E731  one value has no variance
    pooled = F.try_divide(ss(n1, F.col("v1")) + ss(n0, F.col("v0")), dof)
    t = F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(pooled * (F.lit(1.0) / n1 + F.lit(1.0) / n0)))
    rows = rows.filter((n1 > 0) & (n0 > 0)).withColumn("t_statistic", t).withColumn("dof", dof)
    size = F.abs("t_statistic")
    return rows.withColumn("p_value", t_p_value(F.col("t_statistic"), F.col("dof"))).select(
        *by, "variable", "t_statistic", "p_value",
        F.coalesce(F.col("p_value") < alpha, F.lit(False)).alias("significant"),
        F.when(size > 2.0, F.lit("large")).when(size > 1.0, F.lit("medium")).otherwise(F.lit("small")).alias("effect_size"))


def _known_target(df: DataFrame, target: str) -> DataFrame:
    """Null targets take the most frequent class."""
    if df.filter(col(target).isNull()).isEmpty():
        return df
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    mode = mode_values(df, [target], "double" if numeric else "string")[target]
    return replace_columns(df, {target: F.coalesce(col(target), F.lit(0 if mode is None else mode).cast(df.schema[target].dataType))})


def anova(df: DataFrame, target: str, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """ST-08: one-way F and p of each numeric column over the classes of the target; missing values count as the mean.

    Aggregates per (segment, class); mean filling is done algebraically on those rows, so no column is scanned twice.
    """
    df = nan_to_null(df)
    by = list(by)
    names = list(columns or numeric_columns(df, exclude=[target, *by]))
    df = _known_target(df, target)
    parts = []
    for own in column_groups(names, 6):
        aggs = [F.count(F.lit(1)).alias("_all")]
        for i, c in enumerate(own):
            x = f"CAST({q(c)} AS DOUBLE)"
            aggs += [F.expr(f"{f}({x}) AS {k}{i}") for k, f in (("n", "count"), ("m", "avg"), ("v", "var_pop"))]
        per_class = df.groupBy(*by, col(target).alias("_y")).agg(*aggs)
        parts.append(melt_aggregates(per_class, [*by, "_y"], own, {
            "all": lambda i: "_all", "n": lambda i: f"n{i}", "m": lambda i: f"coalesce(m{i}, 0D)", "v": lambda i: f"coalesce(v{i}, 0D)"}, key="variable"))
    rows = union_all(parts)
    seg = W.partitionBy(*by, "variable")  # one row per class
    rows = rows.withColumn("_mean", F.try_divide(F.sum(F.col("n") * F.col("m")).over(seg), F.sum("n").over(seg)))
    rows = rows.withColumn("_cm", (F.col("n") * F.col("m") + (F.col("all") - F.col("n")) * F.col("_mean")) / F.col("all"))
    within = (F.col("n") * F.col("v") + F.col("n") * (F.col("m") - F.col("_cm")) ** 2
              + (F.col("all") - F.col("n")) * (F.col("_mean") - F.col("_cm")) ** 2)
    sums = rows.groupBy(*by, "variable").agg(
        F.sum(F.col("all") * (F.col("_cm") - F.col("_mean")) ** 2).alias("_ssb"), F.sum(within).alias("_ssw"),
        F.count(F.lit(1)).alias("_k"), F.sum("all").alias("_n"))
    d1, d2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = F.try_divide(F.try_divide(F.col("_ssb"), d1), F.try_divide(F.col("_ssw"), d2))
    return sums.withColumn("f_statistic", f).withColumn("p_value", f_p_value(F.col("f_statistic"), d1, d2)).select(
        *by, "variable", "f_statistic", "p_value")


def mutual_information(df: DataFrame, target: str, columns: Sequence[str] | None = None, bins: int = 10) -> DataFrame:
    """ST-09: plug-in mutual information (nats) between quantile bins of each column and the target.

    A nearest-neighbour estimate cannot be distributed; ranking, not value, is what the two estimates share.
    """
    df = _known_target(nan_to_null(df), target)
    names = list(columns or numeric_columns(df, exclude=[target]))
    df = fill_mean(df, names)
    cuts = {c: sorted(set(q)) if q else [] for c, q in quantile_values(df, names, [i / bins for i in range(1, bins)]).items()}
    parts = []
    for own in column_groups(names, 2 * bins):  # the comparisons with the cuts must compile, too
        cells = F.array(*[F.expr(f"named_struct('i', {i}, 'bin', {slot_sql([f'{v!r}D' for v in cuts[c]], c)})") for i, c in enumerate(own)])
        counts = df.select(col(target).alias("_y"), F.explode(cells).alias("_e")).groupBy("_e.i", "_e.bin", "_y").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.select(F.expr(f"array({', '.join(map(s, own))})[i]").alias("variable"), "bin", "_y", "n"))
    joint = union_all(parts)
    # at most bins x classes rows per variable from here on
    total = F.sum("n").over(W.partitionBy("variable"))
    pb = F.sum("n").over(W.partitionBy("variable", "bin"))
    py = F.sum("n").over(W.partitionBy("variable", "_y"))
    p = joint.select("variable", (F.col("n") / total * F.ln(F.col("n") * total / (pb * py).cast("double"))).alias("_t"))
    return p.groupBy("variable").agg(F.greatest(F.sum("_t"), F.lit(0.0)).alias("mutual_information"))


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(variable, correlation) of each numeric column with the target, in one aggregate."""
    df = nan_to_null(df)
    by = list(by)
    names = list(columns or numeric_columns(df, exclude=[target, *by]))
    wide = df.groupBy(*by).agg(*[F.expr(f"{corr_sql(c, target)} AS r{i}") for i, c in enumerate(names)])
    return melt_aggregates(wide, by, names, {"correlation": lambda i: f"r{i}"}, key="variable")


def by_score(score: str) -> list[Column]:
    """Best first. Scores that agree to nine digits differ by the order of summation only: they tie and go by name."""
    return [F.desc_nulls_last(F.round(score, 9)), F.col("variable").asc()]


def strongest(df: DataFrame, target: str, columns: Sequence[str] | None = None, top: int = 3) -> DataFrame:
    """ST-13: the columns with the highest |r| with the target."""
    r = target_correlations(df, target, columns).withColumn("importance", F.abs("correlation"))
    return r.orderBy(*by_score("importance")).limit(top)


def feature_importance(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(method, variable, score) of ST-08 and ST-09."""
    f = anova(df, target, columns).select(F.lit("f_score").alias("method"), "variable", F.col("f_statistic").alias("score"))
    m = mutual_information(df, target, columns).select(F.lit("mutual_information").alias("method"), "variable", F.col("mutual_information").alias("score"))
    return f.unionByName(m)


def top_features(importance: DataFrame, k: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """ST-10: union of the k best of every method, with the best rank reached."""
    order = W.partitionBy(*by, "method").orderBy(*by_score("score"))
    return (
        importance.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
        .groupBy(*by, "variable").agg(F.min("_r").alias("best_rank"))
    )


def pca(df: DataFrame, columns: Sequence[str] | None = None, variance: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """ST-11: (components, loadings) on mean-filled, standardised columns."""
    df = nan_to_null(df)
    names = list(columns or numeric_columns(df))
    filled = fill_mean(df, names).select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    vec = VectorAssembler(inputCols=filled.columns, outputCol="_x").transform(filled).select("_x")
    scaled = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(vec).transform(vec)
    model = PCA(k=len(names), inputCol="_z", outputCol="_p").fit(scaled)
    ratio = [float(v) for v in model.explainedVariance.toArray()]
    total = 0.0
    comps, reached = [], None
    for i, r in enumerate(ratio, 1):
        total += r
        if reached is None and total >= variance:
            reached = i
        comps.append((i, r, total))
    pc = model.pc.toArray()
    spark = df.sparkSession
    n = reached or len(names)
    components = spark.createDataFrame([(i, r, t, n) for i, r, t in comps],
                                       "component int, explained_ratio double, cumulative double, components_needed int")
    loadings = spark.createDataFrame(
        [(j + 1, names[i], float(pc[i, j])) for j in range(len(names)) for i in range(len(names))],
        "component int, variable string, loading double")
    return components, loadings


def analyse(df: DataFrame, target: str | None = None, level: str = "comprehensive", columns: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """ST-14: the named set of analyses, as lazy result tables. Persist `df` first if it is costly to compute."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {tuple(LEVELS)}")
    out: dict[str, DataFrame] = {}
    for step in LEVELS[level]:
        if step == "descriptive":
            out[step] = describe(df, columns)
        elif step == "correlation":
            out[step] = pearson(df, columns)
            out["high_correlations"] = high_correlations(out[step])
        elif step == "hypothesis_testing":
            out[step] = t_tests(df, find_target(df, target), columns)
        elif step == "feature_importance":
            out[step] = feature_importance(df, find_target(df, target), columns)
            out["top_features"] = top_features(out[step])
        else:
            out["pca_components"], out["pca_loadings"] = pca(df, columns)
    return out


def analysis_summary(results: dict[str, DataFrame]) -> DataFrame:
    """ST-15: rows per finished analysis."""
    parts = [d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("analysis"), "rows") for k, d in results.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
