"""Statistics, report aggregates and the risk score."""

from itertools import combinations

from pyspark.sql import functions as F

from .. import presets
from ..operators import aggregates as A, stats as S
from .features import anova_sql, mi_sql
from .quality import target01
from .tables import WFT, rounded, table

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


_L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_W = ["age", "monthly_income", "performance_rating", "satisfaction_score", "years_at_company"]


def line(spark, sf):
    """lineitem with the 0/1 target "returned"."""
    return table(spark, sf, "lineitem").select(*_L, "l_linestatus", "l_shipdate", (F.col("l_returnflag") == "R").cast("int").alias("returned"))


LINE = "li AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem)"


def describe_sql(rel, cols, by=""):
    g = f"GROUP BY {by}" if by else ""
    b = f"{by}, " if by else ""
    parts = [f"""SELECT {b}'{c}' AS variable, COUNT({c}) AS count, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max,
      (AVG({c}::DOUBLE ** 3) - 3 * AVG({c}) * AVG({c}::DOUBLE ** 2) + 2 * AVG({c}) ** 3) / (STDDEV_POP({c}) ** 3) AS skewness, KURTOSIS_POP({c}) AS kurtosis,
      quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q75 FROM {rel} {g}""" for c in cols]
    return " UNION ALL ".join(parts)


_ROUND = "round(mean, 5) AS mean, round(std, 5) AS std, round(min, 5) AS min, round(max, 5) AS max, round(skewness, 5) AS skewness, round(kurtosis, 5) AS kurtosis, round(q25, 5) AS q25, round(median, 5) AS median, round(q75, 5) AS q75"


@query("ST-01", f"WITH d AS ({describe_sql('lineitem', _L)}) SELECT variable, count, {_ROUND} FROM d")
def _(spark, sf):
    return rounded(S.describe(table(spark, sf, "lineitem"), _L), 5)


@query("ST-01-segments", f"WITH d AS ({describe_sql('lineitem', _L[:2], 'l_returnflag')}) SELECT l_returnflag, variable, count, {_ROUND} FROM d")
def _(spark, sf):
    return rounded(S.describe(table(spark, sf, "lineitem"), _L[:2], ["l_returnflag"]), 5)


@query("ST-01-sliced", f"WITH d AS ({describe_sql('lineitem', _L[:2], 'l_returnflag')}) SELECT l_returnflag, variable, count, {_ROUND} FROM d")
def _(spark, sf):
    return rounded(S.describe(table(spark, sf, "lineitem"), _L[:2], ["l_returnflag"], sliced=True), 5)


_DESC = [("count", "COUNT({c})::DOUBLE"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"), ("min", "MIN({c})::DOUBLE"), ("25%", "quantile_cont({c}, 0.25)::DOUBLE"),
         ("50%", "quantile_cont({c}, 0.5)::DOUBLE"), ("75%", "quantile_cont({c}, 0.75)::DOUBLE"), ("max", "MAX({c})::DOUBLE")]


@query("ST-02", " UNION ALL ".join(f"SELECT '{n}' AS statistic, " + ", ".join(f"round({e.format(c=c)}, 5) AS {c}" for c in _L) + " FROM lineitem" for n, e in _DESC))
def _(spark, sf):
    return rounded(S.describe_table(table(spark, sf, "lineitem").select(*_L), _L), 5)


def corr_sql(rel, cols, by=""):
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(f"SELECT {b}'{x}' AS variable1, '{y}' AS variable2, round(corr({x}, {y}), 6) AS correlation FROM {rel} {g}" for x, y in combinations(cols, 2))


@query("ST-03", WFT + " " + corr_sql("wf", _W))
def _(spark, sf):
    return rounded(S.pearson(target01(spark, sf), _W))


@query("ST-03-segments", WFT + " " + corr_sql("wf", _W[:3], "department"))
def _(spark, sf):
    return rounded(S.pearson(target01(spark, sf), _W[:3], ["department"]))


def _matrix_sql(cols):
    cell = lambda x, y: "1.0::DOUBLE AS correlation" if x == y else f"round(corr({x}, {y}), 6) AS correlation FROM wf"
    return WFT + " " + " UNION ALL ".join(f"SELECT '{x}' AS variable1, '{y}' AS variable2, {cell(x, y)}" for x in cols for y in cols)


@query("ST-03-matrix", _matrix_sql(_W[:3]))
def _(spark, sf):
    return rounded(S.pearson(target01(spark, sf), _W[:3], full=True))


def spearman_sql(rel, cols):
    parts = []
    for x, y in combinations(cols, 2):
        parts.append(f"""SELECT '{x}' AS variable1, '{y}' AS variable2, round(corr(rx, ry), 6) AS correlation FROM (SELECT
          rank() OVER (ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {y}) + (COUNT(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS ry
          FROM {rel} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("ST-04", WFT + " " + spearman_sql("wf", _W))
def _(spark, sf):
    return rounded(S.spearman(target01(spark, sf), _W))


@query("ST-04-lineitem", spearman_sql("lineitem", _L))
def _(spark, sf):
    return rounded(S.spearman(table(spark, sf, "lineitem"), _L))


# Nulls in four columns, each where another remainder falls, and one column without.
_GAPS = {"l_quantity": 3, "l_extendedprice": 5, "l_discount": 7, "l_tax": 11}
_GAP_ROWS = "SELECT l_orderkey, " + ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % {k} = 1 THEN NULL ELSE {c} END AS {c}" for c, k in _GAPS.items()) + " FROM lineitem"


def _gap_sql():
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS r{1}".format
    names = ["l_orderkey", *_GAPS]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return f"WITH t AS ({_GAP_ROWS}) " + " UNION ALL ".join(
        f"SELECT '{a}' AS variable1, '{b}' AS variable2, round(corr(r1, r2), 6) AS correlation FROM (SELECT {rank(a, 1)}, {rank(b, 2)} FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in pairs)


@query("ST-04-nulls", _gap_sql())
def _(spark, sf):
    n = F.col("l_orderkey") + F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select("l_orderkey", *[F.when(n % k != 1, F.col(c)).alias(c) for c, k in _GAPS.items()])
    return rounded(S.spearman(df))


@query("ST-04-nulls-chunks", _gap_sql())
def _(spark, sf):
    n = F.col("l_orderkey") + F.col("l_linenumber")
    df = table(spark, sf, "lineitem").select("l_orderkey", *[F.when(n % k != 1, F.col(c)).alias(c) for c, k in _GAPS.items()])
    return rounded(S.spearman(df, chunks=5))


_TEN = ["years_at_company", "years_in_current_role", "age", "n_orders"]


@query("ST-05", WFT + f", c AS ({corr_sql('wf', _TEN)}) SELECT *, CASE WHEN abs(correlation) >= 0.8 THEN 'strong' ELSE 'moderate' END AS strength FROM c WHERE abs(correlation) >= 0.7")
def _(spark, sf):
    return rounded(S.high_correlations(S.pearson(target01(spark, sf), _TEN)))


@query("ST-06", f"WITH c AS ({corr_sql('lineitem', _L[:2])}) SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM c")
def _(spark, sf):
    return rounded(S.correlation_label(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


def ttest_sql(rel, target, cols, by=""):
    """Pooled t; p by Simpson's rule on the density of the t distribution."""
    b, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    parts = [f"""SELECT {b}'{c}' AS variable, COUNT({c}) FILTER ({target} = 1) AS n1, COUNT({c}) FILTER ({target} = 0) AS n0, AVG({c}) FILTER ({target} = 1) AS m1, AVG({c}) FILTER ({target} = 0) AS m0,
      VAR_SAMP({c}) FILTER ({target} = 1) AS v1, VAR_SAMP({c}) FILTER ({target} = 0) AS v0 FROM {rel} {g}""" for c in cols]
    return f"""s AS ({' UNION ALL '.join(parts)}),
     tt AS (SELECT *, n1 + n0 - 2 AS v, (m1 - m0) / sqrt(((n1 - 1) * COALESCE(v1, 0) + (n0 - 1) * COALESCE(v0, 0)) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t FROM s),
     pp AS (SELECT *, (SELECT SUM(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(abs(t) * i / 4000, 2) / v, -(v + 1) / 2.0)) FROM range(4001) r(i)) * abs(t) / 4000 / 3
         * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(pi() * v) AS area FROM tt),
     test AS (SELECT {b}variable, t, greatest(1 - 2 * area, 0) AS p FROM pp)"""


_TT = "round(t, 6) AS t_statistic, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN abs(t) > 2 THEN 'large' WHEN abs(t) > 1 THEN 'medium' ELSE 'small' END AS effect_size"


@query("ST-07", WFT + ", " + ttest_sql("wf", "attrition", _W) + f" SELECT variable, {_TT} FROM test")
def _(spark, sf):
    return rounded(S.t_tests(target01(spark, sf), "attrition", _W))


@query("ST-07-lineitem", f"WITH {LINE}, " + ttest_sql("li", "returned", _L) + f" SELECT variable, {_TT} FROM test")
def _(spark, sf):
    return rounded(S.t_tests(line(spark, sf), "returned", _L))


@query("ST-07-segments", WFT + ", " + ttest_sql("wf", "attrition", _W, "department") + f" SELECT department, variable, {_TT} FROM test")
def _(spark, sf):
    return rounded(S.t_tests(target01(spark, sf), "attrition", _W, ["department"]))


_FILL = lambda rel: (lambda c: f"COALESCE({c}, (SELECT AVG({c}) FROM {rel}))")
# p of an F with one numerator degree of freedom, from the t density
_P1 = """(SELECT greatest(1 - 2 * SUM(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(sqrt(f) * i / 4000, 2) / d2, -(d2 + 1) / 2.0)) * sqrt(f) / 4000 / 3
   * exp(lgamma((d2 + 1) / 2.0) - lgamma(d2 / 2.0)) / sqrt(pi() * d2), 0) FROM range(4001) r(i))"""
# p of an F with two numerator degrees of freedom has a closed form
_P2 = "pow(d2 / (d2 + 2 * f), d2 / 2.0)"


@query("ST-08", WFT + ", " + anova_sql("wf", "attrition", _W, _FILL("wf")) + f" SELECT variable, round(f, 6) AS f_statistic, round({_P1}, 6) AS p_value FROM an")
def _(spark, sf):
    return rounded(S.anova(target01(spark, sf), "attrition", _W))


@query("ST-08-classes", "WITH " + anova_sql("lineitem", "l_returnflag", _L, lambda c: c) + f" SELECT variable, round(f, 6) AS f_statistic, round({_P2}, 6) AS p_value FROM an")
def _(spark, sf):
    return rounded(S.anova(table(spark, sf, "lineitem").select("l_returnflag", *_L), "l_returnflag", _L))


@query("ST-09", WFT + ", " + mi_sql("wf", "attrition", _W, _FILL("wf")) + " SELECT variable, round(mutual_information, 6) AS mutual_information FROM mi")
def _(spark, sf):
    return rounded(S.mutual_information(target01(spark, sf), "attrition", _W))


_TOP = WFT + ", " + anova_sql("wf", "attrition", _W, _FILL("wf")) + ", " + mi_sql("wf", "attrition", _W, _FILL("wf")) + """, imp AS (
   SELECT 'f_score' AS method, variable, f AS score FROM an UNION ALL SELECT 'mutual_information', variable, mutual_information FROM mi),
   rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY method ORDER BY round(score, 9) DESC, variable) AS r FROM imp),
   top AS (SELECT variable, CAST(MIN(r) AS INTEGER) AS best_rank FROM rk WHERE r <= 5 GROUP BY variable)"""


@query("ST-10", _TOP + " SELECT * FROM top")
def _(spark, sf):
    return S.top_features(S.feature_importance(target01(spark, sf), "attrition", _W))


@query("ST-11")
def _(spark, sf):
    return rounded(S.pca(table(spark, sf, "lineitem"), _L)[0])


def _trace_sql(cols):
    squares = " + ".join(f"2 * corr({a}, {b}) ** 2" for a, b in combinations(cols, 2))
    return f"SELECT CAST({len(cols)} AS BIGINT) AS components, 1.0::DOUBLE AS total, round({len(cols)} + {squares}, 6) AS squares FROM lineitem"


@query("ST-11-invariants", _trace_sql(_L))
def _(spark, sf):
    # the eigenvalues of a correlation matrix sum to its size, their squares to its squared entries
    comp = S.pca(table(spark, sf, "lineitem"), _L)[0]
    value = F.col("explained_ratio") * len(_L)
    return rounded(comp.agg(F.count(F.lit(1)).alias("components"), F.sum("explained_ratio").alias("total"), F.sum(value * value).alias("squares")))


# Two columns have a closed form: shares (1 ± |r|) / 2, all loadings 1 / √2 in size.
@query("ST-11-two", f"""WITH c AS (SELECT abs(corr({_L[0]}, {_L[1]})) AS r FROM lineitem), k AS (SELECT unnest([1, 2]) AS component), v AS (SELECT unnest(['{_L[0]}', '{_L[1]}']) AS variable)
  SELECT CAST(component AS INTEGER) AS component, round((1 + CASE component WHEN 1 THEN r ELSE -r END) / 2, 6) AS explained_ratio, variable, round(sqrt(0.5), 6) AS loading FROM c, k, v""")
def _(spark, sf):
    components, loadings = S.pca(table(spark, sf, "lineitem"), _L[:2])
    out = components.select("component", "explained_ratio").join(loadings, "component")
    return rounded(out.withColumn("loading", F.abs("loading")))


@query("ST-11-loadings")
def _(spark, sf):
    loadings = S.pca(table(spark, sf, "lineitem"), _L)[1]
    return rounded(loadings.withColumn("loading", F.abs("loading")))


@query("ST-13", WFT + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, corr({c}, attrition) AS r FROM wf" for c in _W) + ") SELECT variable, round(r, 6) AS correlation, round(abs(r), 6) AS importance FROM c ORDER BY round(abs(r), 9) DESC, variable LIMIT 3")
def _(spark, sf):
    return rounded(S.strongest(target01(spark, sf), "attrition", _W, 3))


@query("ST-14", WFT + f""" SELECT 'descriptive' AS analysis, CAST({len(_W)} AS BIGINT) AS rows UNION ALL SELECT 'correlation', {len(_W) * (len(_W) - 1) // 2}
  UNION ALL SELECT 'high_correlations', COUNT(*) FROM ({corr_sql('wf', _W)}) WHERE abs(correlation) >= 0.7 UNION ALL SELECT 'hypothesis_testing', {len(_W)}
  UNION ALL SELECT 'feature_importance', {2 * len(_W)} UNION ALL SELECT 'top_features', {len(_W)}""")
def _(spark, sf):
    return S.analysis_summary(S.analyse(target01(spark, sf), "attrition", "comprehensive", _W))


# --- report aggregates -------------------------------------------------------------------------------------------------

@query("AGG-01", WFT + " SELECT department, round(AVG(attrition), 3) AS attrition, round(AVG(monthly_income), 3) AS monthly_income, round(AVG(satisfaction_score), 3) AS satisfaction_score FROM wf GROUP BY department")
def _(spark, sf):
    return A.group_means(target01(spark, sf), "department", ["attrition", "monthly_income", "satisfaction_score"])


@query("AGG-02", WFT + """, e AS (SELECT * FROM (VALUES (0, '20-30', 20, 30), (1, '31-40', 30, 40), (2, '41-50', 40, 50), (3, '51+', 50, 70), (4, 'gap', 70, 200), (5, 'ancient', 200, 300)) v(bin_order, bin, lo, hi))
  SELECT CAST(bin_order AS INTEGER) AS bin_order, bin, round(AVG(attrition), 6) AS rate, COUNT(employee_id) AS rows FROM e LEFT JOIN wf ON age > lo AND age <= hi GROUP BY bin_order, bin""")
def _(spark, sf):
    edges, labels = [*presets.AGE_EDGES, 200, 300], [*presets.AGE_LABELS, "gap", "ancient"]
    return rounded(A.rate_by_bin(target01(spark, sf), "age", "attrition", edges, labels))


@query("AGG-03", WFT + " SELECT satisfaction_score, round(AVG(attrition), 6) AS rate FROM wf GROUP BY 1")
def _(spark, sf):
    return rounded(A.rate_by(target01(spark, sf), "satisfaction_score", "attrition"))


@query("AGG-04", WFT + " SELECT COUNT(*) AS total, round(AVG(attrition) * 100, 6) AS target_rate_pct, round(AVG(age), 6) AS mean_age, round(AVG(monthly_income), 6) AS mean_monthly_income, round(AVG(performance_rating), 6) AS mean_performance_rating FROM wf")
def _(spark, sf):
    return rounded(A.key_figures(target01(spark, sf), "attrition", ["age", "monthly_income", "performance_rating"]))


@query("AGG-05", "SELECT o_orderpriority, COUNT(*) AS rows, round(COUNT(*) / (SELECT COUNT(*) FROM orders), 6) AS share FROM orders GROUP BY 1")
def _(spark, sf):
    return rounded(A.value_counts(table(spark, sf, "orders"), "o_orderpriority"))


@query("AGG-06", """WITH m AS (SELECT MIN(l_extendedprice) AS lo, (MAX(l_extendedprice) - MIN(l_extendedprice)) / 20 AS w FROM lineitem),
  c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS INTEGER), 19) AS bin, COUNT(*) AS n FROM lineitem, m GROUP BY 1)
  SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 4) AS lower, round(lo + (i + 1) * w, 4) AS upper, COALESCE(n, 0) AS rows FROM range(20) r(i) LEFT JOIN c ON bin = i, m""")
def _(spark, sf):
    return rounded(A.histogram(table(spark, sf, "lineitem"), "l_extendedprice"), 4)


def _box_sql():
    return """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q25, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q75 FROM lineitem GROUP BY 1)
  SELECT l_returnflag, COUNT(*) AS rows, round(MAX(q25), 6) AS q25, round(MAX(median), 6) AS median, round(MAX(q75), 6) AS q75,
   round(MIN(l_extendedprice) FILTER (l_extendedprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_low,
   round(MAX(l_extendedprice) FILTER (l_extendedprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)), 6) AS whisker_high,
   COUNT(*) FILTER (NOT l_extendedprice BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25)) AS outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag"""


@query("AGG-07", _box_sql())
def _(spark, sf):
    return rounded(A.box_numbers(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("RSK-01", WFT + """, s AS (SELECT department, (satisfaction_score - 1) * 0.2 + (6 - performance_rating) * 0.3 + CASE WHEN years_at_company < 2 THEN 0.5 ELSE 0 END AS score FROM wf)
  SELECT department, COUNT(*) AS rows, COUNT(*) FILTER (score > 0.65) AS high_risk, round(MIN(score), 6)::DOUBLE AS min_score, round(MAX(score), 6)::DOUBLE AS max_score FROM s GROUP BY department""")
def _(spark, sf):
    score = A.risk_score(F.col("satisfaction_score"), F.col("performance_rating"), F.col("years_at_company"))
    # scores are multiples of 0.1: the bound sits between two of them, so that it does not depend on rounding
    return rounded(A.risk_summary(target01(spark, sf), score, 0.65, ["department"]))
