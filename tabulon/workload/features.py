"""Feature engineering and selection queries."""

from itertools import combinations_with_replacement

from pyspark.sql import functions as F

from ..operators import features as FE, selection as SEL
from .quality import target01
from .tables import WF, WFT, rounded, table, workforce

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


_TENURE = "CASE WHEN years_at_company > 0 AND years_at_company <= 2 THEN 'New' WHEN years_at_company > 2 AND years_at_company <= 5 THEN 'Early' WHEN years_at_company > 5 AND years_at_company <= 10 THEN 'Mid' WHEN years_at_company > 10 AND years_at_company <= 20 THEN 'Senior' WHEN years_at_company > 20 AND years_at_company <= 100 THEN 'Veteran' END"
_TRAIN = "CASE WHEN training_times_last_year > 0 AND training_times_last_year <= 1 THEN 'None' WHEN training_times_last_year > 1 AND training_times_last_year <= 3 THEN 'Low' WHEN training_times_last_year > 3 AND training_times_last_year <= 6 THEN 'Medium' WHEN training_times_last_year > 6 AND training_times_last_year <= 100 THEN 'High' END"
_RISK = "CASE WHEN years_at_company <= 2 OR years_at_company >= 15 THEN 1 ELSE 0 END"
_ROLE = "CASE WHEN years_in_current_role >= 5 THEN 1 ELSE 0 END"
_PROMO = "CASE WHEN years_since_last_promotion >= 3 THEN 1 ELSE 0 END"
_LEVEL = "CASE education WHEN 'High School' THEN 1 WHEN 'Bachelor' THEN 2 WHEN 'Master' THEN 3 WHEN 'Doctorate' THEN 4 ELSE 2 END"
_MISMATCH = f"CASE WHEN {_LEVEL} >= 3 AND (lower(job_role) LIKE '%associate%' OR lower(job_role) LIKE '%assistant%') THEN 1 ELSE 0 END"
_ALIGN = "CASE WHEN monthly_income > (SELECT MEDIAN(monthly_income) FROM workforce) AND performance_rating >= 4 THEN 1 ELSE 0 END"
_STRESS = "(CASE WHEN overtime = 'Yes' THEN 1 ELSE 0 END + CASE WHEN business_travel = 'Travel_Frequently' THEN 1 ELSE 0 END)"


@query("FE-01", WF + f" SELECT employee_id, {_TENURE} AS tenure_category FROM workforce")
def _(spark, sf):
    return workforce(spark, sf).select("employee_id", FE.tenure_category(F.col("years_at_company")).alias("tenure_category"))


@query("FE-02", WF + f" SELECT employee_id, {_TRAIN} AS training_frequency FROM workforce")
def _(spark, sf):
    return workforce(spark, sf).select("employee_id", FE.training_frequency(F.col("training_times_last_year")).alias("training_frequency"))


@query("FE-03", WF + f" SELECT employee_id, {_RISK} AS tenure_risk, {_ROLE} AS role_stagnation, {_PROMO} AS promotion_stagnation FROM workforce")
def _(spark, sf):
    return FE.temporal_features(workforce(spark, sf)).select("employee_id", "tenure_risk", "role_stagnation", "promotion_stagnation")


@query("FE-04", WF + " SELECT employee_id, round(years_at_company - years_in_current_role, 6) AS role_progression FROM workforce")
def _(spark, sf):
    return rounded(FE.temporal_features(workforce(spark, sf)).select("employee_id", "role_progression"))


@query("FE-05", WF + """ SELECT employee_id, round(age / (years_at_company + 1), 6) AS age_tenure_ratio, age * years_at_company AS age_tenure_product,
  round(monthly_income / performance_rating, 6) AS salary_performance_ratio FROM workforce""")
def _(spark, sf):
    return rounded(FE.interaction_features(workforce(spark, sf)).select("employee_id", "age_tenure_ratio", "age_tenure_product", "salary_performance_ratio"))


@query("FE-06", WF + f" SELECT employee_id, {_ALIGN} AS salary_performance_alignment FROM workforce")
def _(spark, sf):
    return FE.interaction_features(workforce(spark, sf)).select("employee_id", "salary_performance_alignment")


@query("FE-07", WF + f" SELECT employee_id, {_LEVEL} AS education_level FROM workforce")
def _(spark, sf):
    return FE.interaction_features(workforce(spark, sf)).select("employee_id", "education_level")


@query("FE-08", WF + f" SELECT employee_id, {_MISMATCH} AS education_role_mismatch FROM workforce")
def _(spark, sf):
    return FE.interaction_features(workforce(spark, sf)).select("employee_id", "education_role_mismatch")


@query("FE-09", WF + f" SELECT employee_id, {_STRESS} AS work_life_stress FROM workforce")
def _(spark, sf):
    return FE.interaction_features(workforce(spark, sf)).select("employee_id", "work_life_stress")


_POLY = ["age", "years_at_company", "performance_rating"]


def _poly_sql():
    out = ['1.0::DOUBLE AS "poly_1"']
    for d in (2, 3):
        for t in combinations_with_replacement(_POLY, d):
            out.append(" * ".join(f"COALESCE({c}, 0)::DOUBLE" for c in t) + f' AS "{FE._monomial_name(t)}"')
    return ", ".join(out)


@query("FE-10", WF + f" SELECT employee_id, {_poly_sql()} FROM workforce")
def _(spark, sf):
    df = workforce(spark, sf).select("employee_id", *_POLY)
    return FE.polynomial_features(df, _POLY, 3).drop(*_POLY)


@query("FE-11", """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_dayofweek, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter FROM orders""")
def _(spark, sf):
    return FE.date_parts(table(spark, sf, "orders").select("o_orderkey", "o_orderdate")).drop("o_orderdate")


@query("FE-12", """SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-06-01' - ts) / 86400) AS BIGINT) AS days_since_ts, round(floor(epoch(TIMESTAMP '2024-06-01' - ts) / 86400) / 365.25, 6) AS years_since_ts FROM events""")
def _(spark, sf):
    return rounded(FE.service_time(table(spark, sf, "events").select("event_id", "ts"), "ts", "2024-06-01 00:00:00").drop("ts"))




@query("FE-13", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P",
  """ + ", ".join(f"""CASE WHEN o_orderpriority = '{p}' THEN 1 ELSE 0 END AS "o_orderpriority_{p}\"""" for p in ("2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return FE.dummy_columns(df, ["o_orderstatus", "o_orderpriority"]).drop("o_orderstatus", "o_orderpriority")


@query("FE-14", """SELECT l_orderkey, l_linenumber, round(ln(l_quantity), 6) AS l_quantity_log, round(l_quantity * l_quantity, 6) AS l_quantity_squared, round(sqrt(l_quantity), 6) AS l_quantity_sqrt,
  round(l_tax * l_tax, 6) AS l_tax_squared, round(sqrt(l_tax), 6) AS l_tax_sqrt FROM lineitem""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(FE.power_features(df, ["l_quantity", "l_tax"]).drop("l_quantity", "l_tax"))


_L5 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("FE-15", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({a} * {b}, 6) AS {a}_x_{b}" for i, a in enumerate(_L5) for b in _L5[i + 1:]) + " FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_L5)
    return rounded(FE.pairwise_products(df, _L5).drop(*_L5))


@query("FE-16", "SELECT p_partkey, p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand_encoded FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand")
    return FE.label_encode(df, FE.label_encoder(df, ["p_brand"]))


@query("FE-16-ranges", """WITH t AS (SELECT l_orderkey, l_linenumber, md5(CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS code, l_returnflag AS flag FROM lineitem)
  SELECT l_orderkey, l_linenumber, CAST(dense_rank() OVER (ORDER BY code) - 1 AS INTEGER) AS code_encoded, CAST(dense_rank() OVER (ORDER BY flag) - 1 AS INTEGER) AS flag_encoded FROM t""")
def _(spark, sf):
    # a value per row beside a column of three
    key = F.md5((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").cast("binary"))
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("code"), F.col("l_returnflag").alias("flag"))
    return FE.label_encode(df, FE.label_encoder(df, ["code", "flag"], ranges=True)).drop("code", "flag")


@query("FE-13-sparse", """SELECT c_custkey, concat_ws(',', CASE WHEN c_name <> (SELECT MIN(c_name) FROM customer) THEN 'c_name_' || c_name END,
  CASE WHEN c_mktsegment <> (SELECT MIN(c_mktsegment) FROM customer) THEN 'c_mktsegment_' || c_mktsegment END) AS dummies FROM customer""")
def _(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return FE.dummy_columns(df, ["c_name", "c_mktsegment"], wide=100).select("c_custkey", F.array_join("dummies", ",").alias("dummies"))


@query("FE-18-generated", """WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS done, o_orderdate FROM orders)
  SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2030-01-01') AS BIGINT) AS days_since_o_orderdate,
    CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority_encoded, round(o_totalprice * o_totalprice, 2) AS o_totalprice_squared, round(o_custkey * o_totalprice, 2) AS o_custkey_x_o_totalprice,
    round((o_totalprice - AVG(o_totalprice) OVER ()) / STDDEV_POP(o_totalprice) OVER (), 6) AS o_totalprice_scaled FROM o""")
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("done"), F.date_trunc("day", "o_orderdate").alias("o_orderdate"))
    out = FE.generate(df, "done", encode=True, scaled=True, start="o_orderdate", as_of="2030-01-01")
    return out.select("o_orderkey", "o_orderdate_year", "o_orderdate_month", "days_since_o_orderdate", "o_orderpriority_encoded", F.round("o_totalprice_squared", 2).alias("o_totalprice_squared"),
                      F.round("o_custkey_x_o_totalprice", 2).alias("o_custkey_x_o_totalprice"), F.round("o_totalprice_scaled", 6).alias("o_totalprice_scaled"))


@query("FE-17", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT AVG({c}) FROM lineitem)) / (SELECT STDDEV_POP({c}) FROM lineitem), 6) AS {c}_scaled" for c in _L5) + " FROM lineitem")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_L5)
    return rounded(FE.scale(df, _L5).drop(*_L5))


@query("FE-18", WFT + f"""SELECT employee_id, {_TENURE} AS tenure_category, {_RISK} AS tenure_risk, {_ROLE} AS role_stagnation, round(age / (years_at_company + 1), 6) AS age_tenure_ratio,
  {_MISMATCH} AS education_role_mismatch, {_STRESS} AS work_life_stress, COALESCE(age, 0)::DOUBLE * performance_rating AS "poly_age performance_rating" FROM wf""")
def _(spark, sf):
    out = FE.engineer(target01(spark, sf), "attrition", polynomial=True)
    return rounded(out.select("employee_id", "tenure_category", "tenure_risk", "role_stagnation", "age_tenure_ratio", "education_role_mismatch", "work_life_stress", "`poly_age performance_rating`"))


_CAND = ["age", "monthly_income", "performance_rating", "satisfaction_score", "years_at_company", "training_times_last_year"]


@query("SEL-01", WFT + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS variable, abs(corr({c}, attrition)) AS score FROM wf" for c in _CAND) + ") SELECT variable, round(score, 6) AS score FROM c ORDER BY round(c.score, 9) DESC, variable LIMIT 3")
def _(spark, sf):
    return rounded(SEL.feature_scores(target01(spark, sf), "attrition", "correlation", 3, _CAND))


def mi_sql(rel, target, cols, fill):
    """Plug-in mutual information over decile bins, in SQL. `fill(c)` is the filled column."""
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS variable, y, (SELECT CAST(SUM(CASE WHEN e < v THEN 1 ELSE 0 END) AS BIGINT) FROM (SELECT DISTINCT unnest(q) AS e)) AS bin
          FROM (SELECT {target} AS y, {fill(c)} AS v FROM {rel}), (SELECT quantile_cont({fill(c)}, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM {rel})""")
    return f"""cells AS ({' UNION ALL '.join(parts)}), j AS (SELECT variable, bin, y, COUNT(*) AS n FROM cells GROUP BY ALL),
     t AS (SELECT *, SUM(n) OVER (PARTITION BY variable) AS tot, SUM(n) OVER (PARTITION BY variable, bin) AS pb, SUM(n) OVER (PARTITION BY variable, y) AS py FROM j),
     mi AS (SELECT variable, greatest(SUM(n / tot * ln(n * tot / (pb * py))), 0) AS mutual_information FROM t GROUP BY variable)"""


@query("SEL-02", WFT + ", " + mi_sql("wf", "attrition", _CAND, lambda c: f"COALESCE({c}, 0)::DOUBLE") + " SELECT variable, round(mutual_information, 6) AS score FROM mi ORDER BY round(mutual_information, 9) DESC, variable LIMIT 3")
def _(spark, sf):
    return rounded(SEL.feature_scores(target01(spark, sf), "attrition", "mutual_info", 3, _CAND))


def anova_sql(rel, target, cols, fill):
    parts = [f"SELECT '{c}' AS variable, {target} AS y, {fill(c)}::DOUBLE AS v FROM {rel}" for c in cols]
    return f"""long AS ({' UNION ALL '.join(parts)}), gm AS (SELECT variable, AVG(v) AS m, COUNT(*) AS n FROM long GROUP BY variable),
     g AS (SELECT variable, y, AVG(v) AS cm, COUNT(*) AS cn, VAR_POP(v) * COUNT(*) AS ss FROM long GROUP BY variable, y),
     an AS (SELECT g.variable, SUM(cn * (cm - m) ** 2) / (COUNT(*) - 1) / (SUM(ss) / (MAX(n) - COUNT(*))) AS f, COUNT(*) - 1 AS d1, MAX(n) - COUNT(*) AS d2 FROM g JOIN gm USING (variable) GROUP BY g.variable)"""


@query("SEL-03", WFT + ", " + anova_sql("wf", "attrition", _CAND, lambda c: f"COALESCE({c}, 0)") + " SELECT variable, round(f, 6) AS score FROM an ORDER BY round(f, 9) DESC, variable LIMIT 3")
def _(spark, sf):
    return rounded(SEL.feature_scores(target01(spark, sf), "attrition", "f_statistic", 3, _CAND))
