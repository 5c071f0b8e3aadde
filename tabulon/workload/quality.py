"""Cleaning, validation, quality, imputation and outlier queries."""

from pyspark.sql import functions as F

from ..operators import clean as C, impute as I, outliers as O, quality as Q, validate as V
from .tables import WF, WFT, rounded, table, workforce

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


def target01(spark, sf):
    return C.encode_target(workforce(spark, sf), "attrition")


# --- cleaning -------------------------------------------------------------------------------------------------------

@query("CLN-01", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumns({"_source_file": F.lit("customer.csv"), "_collection_timestamp": F.current_timestamp()})
    return C.drop_internal_columns(df).drop("c_acctbal")


@query("CLN-02", "SELECT c_custkey AS cust_key, c_name AS name, c_mktsegment AS name_2 FROM customer")
def _(spark, sf):
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Cust Key "), F.col("c_name").alias("Name($)"), F.col("c_mktsegment").alias("name"))
    return C.clean_column_names(df)


@query("CLN-03", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE o_orderstatus <> 'P'")
def _(spark, sf):
    kept = F.col("o_orderstatus") != "P"
    df = table(spark, sf, "orders").select(
        F.when(kept, F.col("o_orderkey")).alias("k"), F.lit(None).cast("double").alias("hollow"),
        F.when(kept & ~F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("p"))
    return C.drop_empty(df)


@query("CLN-04", WFT + " SELECT employee_id, CAST(attrition AS INTEGER) AS attrition FROM wf")
def _(spark, sf):
    return target01(spark, sf).select("employee_id", "attrition")


@query("CLN-05", "SELECT p_partkey, TRY_CAST(CASE WHEN p_size % 3 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS DOUBLE) AS size FROM part")
def _(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, F.lit("n/a")).otherwise(F.col("p_size").cast("string")).alias("size"))
    return C.to_number(df, ["size"])


@query("CLN-06", WF + " SELECT employee_id, CAST(age AS VARCHAR) AS age, CAST(performance_rating AS VARCHAR) AS performance_rating FROM workforce")
def _(spark, sf):
    return C.to_category(workforce(spark, sf).select("employee_id", "age", "performance_rating"), ["age", "performance_rating"])


def raw_workforce(spark, sf):
    df = workforce(spark, sf).withColumn("_source_file", F.lit("w.csv")).withColumn("Hollow Column", F.lit(None).cast("string"))
    return df.withColumnRenamed("monthly_income", " Monthly Income").withColumnRenamed("job_role", "Job Role!")


@query("CLN-07", WFT + """ SELECT employee_id, CAST(age AS DOUBLE) AS age, round(CAST(monthly_income AS DOUBLE), 6) AS monthly_income, job_role,
  CAST(attrition AS INTEGER) AS attrition, mostly_missing FROM wf""")
def _(spark, sf):
    return rounded(C.clean(raw_workforce(spark, sf)).select("employee_id", "age", "monthly_income", "job_role", "attrition", "mostly_missing"))


@query("CLN-07-report", WF + """ SELECT COUNT(*) AS rows_before, COUNT(*) AS rows_after, CAST(0 AS BIGINT) AS rows_removed, CAST(21 AS BIGINT) AS columns_before,
  CAST(19 AS BIGINT) AS columns_after, CAST(2 AS BIGINT) AS columns_removed FROM workforce""")
def _(spark, sf):
    raw = raw_workforce(spark, sf)
    return C.cleaning_report(raw, C.clean(raw))


# --- validation -----------------------------------------------------------------------------------------------------

@query("VAL-01", WF + """ SELECT 'required' AS rule, 'salary' AS "column", 'column is missing' AS detail
  UNION ALL SELECT 'numeric', 'department', 'column has type string'
  UNION ALL SELECT 'allowed', 'gender', gender || ' in ' || COUNT(*) || ' rows' FROM workforce WHERE gender NOT IN ('Male','Female','M','F') GROUP BY gender
  UNION ALL SELECT 'range', 'age', printf('%.1f to %.1f, allowed 18.0 to 100.0', MIN(age)::DOUBLE, MAX(age)::DOUBLE) FROM workforce HAVING MIN(age) < 18 OR MAX(age) > 100""")
def _(spark, sf):
    return V.schema_report(workforce(spark, sf), ["attrition", "salary"], ["age", "monthly_income", "department"],
                           {"gender": ["Male", "Female", "M", "F"]}, {"age": (18, 100)})


@query("VAL-02", WF + """ SELECT 'allowed' AS rule, 'gender' AS "column", gender AS value, COUNT(*) AS rows FROM workforce
  WHERE gender IS NULL OR gender NOT IN ('Male','Female','M','F') GROUP BY gender""")
def _(spark, sf):
    return V.set_findings(workforce(spark, sf), "gender", ["Male", "Female", "M", "F"])


@query("VAL-03", WF + """, m AS (SELECT 'age' AS "column", CAST(MIN(age) AS DOUBLE) AS lowest, CAST(MAX(age) AS DOUBLE) AS highest, 18.0::DOUBLE AS lower_bound, 100.0::DOUBLE AS upper_bound FROM workforce
  UNION ALL SELECT 'performance_rating', MIN(performance_rating), MAX(performance_rating), 1, 5 FROM workforce)
  SELECT * FROM m WHERE lowest < lower_bound OR highest > upper_bound""")
def _(spark, sf):
    return V.range_findings(workforce(spark, sf), {"age": (18, 100), "performance_rating": (1, 5)})


@query("VAL-04", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity BETWEEN 10 AND 40 AND l_discount BETWEEN 0.02 AND 0.06")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return V.filter_ranges(df, {"l_quantity": (10, 40), "l_discount": (0.02, 0.06)})


@query("VAL-05", WFT + " SELECT employee_id, gender, CAST(attrition AS INTEGER) AS attrition FROM wf WHERE attrition IN (0,1) AND gender IN ('Male','Female','M','F')")
def _(spark, sf):
    return V.filter_sets(target01(spark, sf).select("employee_id", "gender", "attrition"))


_VALID = "age BETWEEN 18 AND 100 AND performance_rating BETWEEN 1 AND 5 AND satisfaction_score BETWEEN 1 AND 5 AND attrition IN (0,1) AND gender IN ('Male','Female','M','F')"


@query("VAL-06", WFT + f" SELECT employee_id, CAST(age AS DOUBLE) AS age, gender, CAST(attrition AS INTEGER) AS attrition FROM wf WHERE {_VALID}")
def _(spark, sf):
    return V.validate(target01(spark, sf)).select("employee_id", "age", "gender", "attrition")


@query("VAL-06-report", WFT + f""" SELECT 'rows_in' AS rule, COUNT(*) AS rows FROM wf
  UNION ALL SELECT 'range:age', COUNT(*) FROM wf WHERE NOT COALESCE(age BETWEEN 18 AND 100, FALSE)
  UNION ALL SELECT 'range:performance_rating', COUNT(*) FROM wf WHERE NOT COALESCE(performance_rating BETWEEN 1 AND 5, FALSE)
  UNION ALL SELECT 'range:satisfaction_score', COUNT(*) FROM wf WHERE NOT COALESCE(satisfaction_score BETWEEN 1 AND 5, FALSE)
  UNION ALL SELECT 'allowed:attrition', COUNT(*) FROM wf WHERE NOT COALESCE(attrition IN (0,1), FALSE)
  UNION ALL SELECT 'allowed:gender', COUNT(*) FROM wf WHERE NOT COALESCE(gender IN ('Male','Female','M','F'), FALSE)
  UNION ALL SELECT 'rows_kept', COUNT(*) FROM wf WHERE {_VALID}""")
def _(spark, sf):
    return V.validation_report(target01(spark, sf))


# --- quality --------------------------------------------------------------------------------------------------------

_WF_COLS = ["employee_id", "age", "gender", "monthly_income", "mostly_missing", "department", "n_orders"]
_MISS = " + ".join(f"SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)" for c in _WF_COLS)


@query("QLT-01", WF + f""", t AS (SELECT COUNT(*) AS rows, {_MISS} AS tm FROM workforce)
  SELECT m."column", CAST(m.missing AS BIGINT) AS missing, t.rows, round(m.missing * 100.0 / t.rows, 6)::DOUBLE AS missing_pct, CAST(t.tm AS BIGINT) AS total_missing,
    round(t.tm * 100.0 / (t.rows * 7), 6)::DOUBLE AS total_missing_pct, m.missing > 0 AS has_missing FROM ("""
       + " UNION ALL ".join(f"""SELECT '{c}' AS "column", SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS missing FROM workforce""" for c in _WF_COLS) + ") m, t")
def _(spark, sf):
    return rounded(Q.missing_report(workforce(spark, sf).select(*_WF_COLS)))


@query("QLT-02", "SELECT CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)")
def _(spark, sf):
    return Q.duplicate_count(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


@query("QLT-02-drop", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount, l_tax FROM lineitem")
def _(spark, sf):
    return Q.drop_duplicates(table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


_Q_COLS = ["age", "gender", "education", "monthly_income", "mostly_missing"]
_QUALITY = WF + f""", g AS (SELECT COUNT(*) AS n, COUNT(*) * (({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in _Q_COLS)})) AS nulls
  FROM workforce GROUP BY {', '.join(_Q_COLS)}),
 r AS (SELECT SUM(n) AS total_records, 5 AS total_features, SUM(nulls) * 100.0 / (SUM(n) * 5) AS missing_pct, SUM(n - 1) AS duplicate_records, SUM(n - 1) * 100.0 / SUM(n) AS dup FROM g)"""


def _report(spark, sf, capped):
    return Q.quality_report(workforce(spark, sf).select(*_Q_COLS), capped)


@query("QLT-03", _QUALITY + """ SELECT CAST(total_records AS BIGINT) AS total_records, CAST(total_features AS BIGINT) AS total_features, round(missing_pct, 6)::DOUBLE AS missing_pct,
  CAST(duplicate_records AS BIGINT) AS duplicate_records, round(greatest(0, 100 - least(missing_pct * 0.5, 30) - least(dup * 0.3, 20) - 10), 6)::DOUBLE AS quality_score FROM r""")
def _(spark, sf):
    return rounded(_report(spark, sf, True).drop("data_types"))


@query("QLT-04", _QUALITY + """ SELECT CAST(total_records AS BIGINT) AS total_records, CAST(total_features AS BIGINT) AS total_features, round(missing_pct, 6)::DOUBLE AS missing_pct,
  CAST(duplicate_records AS BIGINT) AS duplicate_records, round(greatest(0, 100 - missing_pct * 0.5 - dup * 0.3 - 5), 6)::DOUBLE AS quality_score FROM r""")
def _(spark, sf):
    return rounded(_report(spark, sf, False).drop("data_types"))


@query("QLT-05", _QUALITY + f""", s AS (SELECT *, greatest(0, 100 - missing_pct * 0.5 - dup * 0.3 - 5) AS q FROM r)
  SELECT '{Q.TOO_MANY_MISSING}' AS recommendation FROM s WHERE missing_pct > 10 UNION ALL SELECT '{Q.HAS_DUPLICATES}' FROM s WHERE duplicate_records > 0
  UNION ALL SELECT '{Q.LOW_SCORE}' FROM s WHERE q < 70 UNION ALL SELECT '{Q.ALL_GOOD}' FROM s WHERE missing_pct <= 10 AND duplicate_records = 0 AND q >= 70""")
def _(spark, sf):
    return Q.quality_recommendations(_report(spark, sf, False))


def _prof_num(c, kind):
    return f"""SELECT '{c}' AS "column", '{kind}' AS type, COUNT(*) - COUNT({c}) AS missing, round((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6)::DOUBLE AS missing_pct,
      MIN({c})::DOUBLE AS min, MAX({c})::DOUBLE AS max, round(AVG({c}), 6) AS mean, round(MEDIAN({c}), 6)::DOUBLE AS median, round(STDDEV_SAMP({c}), 6) AS std, NULL::BIGINT AS n_distinct, NULL AS most_common FROM workforce"""


def _prof_text(c):
    return f"""SELECT '{c}', 'string', COUNT(*) - COUNT({c}), round((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 6)::DOUBLE, NULL, NULL, NULL, NULL, NULL, COUNT(DISTINCT {c}),
      (SELECT {c} FROM workforce WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) FROM workforce"""


@query("QLT-06", WF + " " + " UNION ALL ".join([_prof_num("age", "bigint"), _prof_num("monthly_income", "double"), _prof_num("years_at_company", "bigint"),
                                               _prof_text("gender"), _prof_text("department"), _prof_text("mostly_missing")]))
def _(spark, sf):
    df = workforce(spark, sf).select("age", "monthly_income", "years_at_company", "gender", "department", "mostly_missing", F.lit("x").alias("_source"))
    return rounded(Q.profile(df))


@query("QLT-08", _QUALITY + """, x AS (SELECT COUNT(*) AS n FROM orders), last AS (SELECT * FROM r)
  SELECT CAST(total_records AS BIGINT) AS total_records, round(missing_pct, 6)::DOUBLE AS missing_pct, CAST(duplicate_records AS BIGINT) AS duplicate_records,
    round(100 - missing_pct, 6)::DOUBLE AS completeness, round(greatest(0, 100 - missing_pct * 0.5 - dup * 0.3 - 5) / 100, 6)::DOUBLE AS consistency FROM last""")
def _(spark, sf):
    older = Q.quality_report(table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"), False).drop("data_types").withColumn("reported_at", F.to_date(F.lit("2024-01-01")))
    newer = _report(spark, sf, False).drop("data_types").withColumn("reported_at", F.to_date(F.lit("2024-02-01")))
    return rounded(Q.evaluation_row(older.unionByName(newer)))


# --- imputation -----------------------------------------------------------------------------------------------------

@query("IMP-01", WF + """, m AS (SELECT MEDIAN(monthly_income) AS med FROM workforce),
 f AS (SELECT *, last_value(age IGNORE NULLS) OVER (ORDER BY employee_id ROWS UNBOUNDED PRECEDING) AS ff,
   first_value(age IGNORE NULLS) OVER (ORDER BY employee_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bf FROM workforce)
 SELECT employee_id, COALESCE(age, ff, bf) AS age, gender, round(COALESCE(monthly_income, med), 6)::DOUBLE AS monthly_income, n_orders FROM f, m""")
def _(spark, sf):
    df = workforce(spark, sf).select("employee_id", "age", "gender", "monthly_income", "mostly_missing", "n_orders")
    return rounded(I.fill_auto(df, "employee_id"))


@query("IMP-02", WF + " SELECT employee_id, age, round(monthly_income, 6)::DOUBLE AS monthly_income FROM workforce WHERE age IS NOT NULL AND monthly_income IS NOT NULL")
def _(spark, sf):
    return rounded(I.drop_missing(workforce(spark, sf).select("employee_id", "age", "monthly_income")))


@query("IMP-03", WF + """ SELECT employee_id, round(COALESCE(age, (SELECT AVG(age) FROM workforce)), 6)::DOUBLE AS age,
  round(COALESCE(monthly_income, (SELECT AVG(monthly_income) FROM workforce)), 6)::DOUBLE AS monthly_income FROM workforce""")
def _(spark, sf):
    return rounded(I.fill_mean(workforce(spark, sf).select("employee_id", "age", "monthly_income"), ["age", "monthly_income"]))


_BLANKED = """b AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS q,
  CASE WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN NULL ELSE l_extendedprice END AS p FROM lineitem)"""


def _blanked(spark, sf):
    s = F.col("l_orderkey") + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(s % 7 != 0, F.col("l_quantity")).alias("q"), F.when(s % 5 != 0, F.col("l_extendedprice")).alias("p"))


@query("IMP-04", f"WITH {_BLANKED} SELECT l_orderkey, l_linenumber, COALESCE(q, (SELECT quantile_cont(q, 0.5) FROM b)) AS q, round(COALESCE(p, (SELECT quantile_cont(p, 0.5) FROM b)), 6) AS p FROM b")
def _(spark, sf):
    return rounded(I.fill_median(_blanked(spark, sf), ["q", "p"]))


@query("IMP-05", """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS type, NULL::VARCHAR AS hollow FROM part)
  SELECT p_partkey, COALESCE(brand, (SELECT brand FROM b WHERE brand IS NOT NULL GROUP BY brand ORDER BY COUNT(*) DESC, brand LIMIT 1)) AS brand,
    COALESCE(type, (SELECT type FROM b WHERE type IS NOT NULL GROUP BY type ORDER BY COUNT(*) DESC, type LIMIT 1)) AS type, 'Unknown' AS hollow FROM b""")
def _(spark, sf):
    k = F.col("p_partkey")
    df = table(spark, sf, "part").select(k, F.when(k % 6 != 0, F.col("p_brand")).alias("brand"), F.when(k % 9 != 0, F.col("p_type")).alias("type"), F.lit(None).cast("string").alias("hollow"))
    return I.fill_mode(df)


@query("IMP-08", WFT + """, y AS (SELECT employee_id, age, monthly_income, CASE WHEN employee_id % 13 = 0 THEN NULL ELSE attrition END AS attrition FROM wf)
  SELECT employee_id, round(COALESCE(age, (SELECT AVG(age) FROM y)), 6)::DOUBLE AS age, round(COALESCE(monthly_income, (SELECT AVG(monthly_income) FROM y)), 6)::DOUBLE AS monthly_income,
   CAST(COALESCE(attrition, (SELECT attrition FROM y WHERE attrition IS NOT NULL GROUP BY attrition ORDER BY COUNT(*) DESC, attrition LIMIT 1)) AS INTEGER) AS attrition FROM y""")
def _(spark, sf):
    df = target01(spark, sf).select("employee_id", "age", "monthly_income", F.when(F.col("employee_id") % 13 != 0, F.col("attrition")).alias("attrition"))
    return rounded(I.fill_for_model(df, ["age", "monthly_income"], "attrition"))


@query("IMP-09", WF + " SELECT employee_id, COALESCE(age, 0) AS age, round(COALESCE(monthly_income, 0), 6)::DOUBLE AS monthly_income, COALESCE(mostly_missing, 'Unknown') AS mostly_missing FROM workforce")
def _(spark, sf):
    return rounded(I.fill_constant(workforce(spark, sf).select("employee_id", "age", "monthly_income", "mostly_missing")))


# --- outliers -------------------------------------------------------------------------------------------------------

_L_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("OUT-01", "WITH f AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) - 0.25 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 0.25 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi" for c in _L_NUM)
       + " FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(least(greatest({c}, {c}_lo), {c}_hi), 6) AS {c}" for c in _L_NUM) + " FROM lineitem, f")
def _(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_L_NUM)
    return rounded(O.treat_outliers(df, "iqr", columns=_L_NUM, threshold=0.25))


@query("OUT-01-target", WFT + """, f AS (SELECT quantile_cont(monthly_income, 0.25) AS a, quantile_cont(monthly_income, 0.75) AS b, quantile_cont(age, 0.25) AS c, quantile_cont(age, 0.75) AS d FROM wf)
  SELECT employee_id, CAST(attrition AS INTEGER) AS attrition, round(CASE WHEN age IS NOT NULL THEN least(greatest(age, c - 1.5 * (d - c)), d + 1.5 * (d - c)) END, 6)::DOUBLE AS age,
    round(CASE WHEN monthly_income IS NOT NULL THEN least(greatest(monthly_income, a - 1.5 * (b - a)), b + 1.5 * (b - a)) END, 6)::DOUBLE AS monthly_income FROM wf, f""")
def _(spark, sf):
    df = target01(spark, sf).select("employee_id", "attrition", "age", "monthly_income")
    return rounded(O.treat_outliers(df, "iqr", exclude=["employee_id", "attrition"]))


_Z = ", s AS (SELECT " + ", ".join(f"AVG({c}) AS {c}_m, STDDEV_POP({c}) AS {c}_s, MEDIAN({c}) AS {c}_d" for c in ("age", "monthly_income")) + " FROM workforce)"


@query("OUT-02", WF + _Z + """ SELECT employee_id, round(CASE WHEN abs((age - age_m) / age_s) > 3 THEN age_d ELSE age END, 6)::DOUBLE AS age,
  round(CASE WHEN abs((monthly_income - monthly_income_m) / monthly_income_s) > 3 THEN monthly_income_d ELSE monthly_income END, 6)::DOUBLE AS monthly_income FROM workforce, s""")
def _(spark, sf):
    return rounded(O.treat_outliers(workforce(spark, sf).select("employee_id", "age", "monthly_income"), "zscore", columns=["age", "monthly_income"]))


def _out_iqr(c):
    return f"""SELECT '{c}' AS "column", CAST(SUM(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
     round(SUM(CASE WHEN {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a) THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 6)::DOUBLE AS outlier_pct
     FROM workforce, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM workforce)"""


@query("OUT-03", WF + " " + " UNION ALL ".join(_out_iqr(c) for c in ("age", "monthly_income", "years_at_company", "n_orders")))
def _(spark, sf):
    return rounded(O.outlier_report(workforce(spark, sf), "iqr", columns=["age", "monthly_income", "years_at_company", "n_orders"]))


@query("OUT-03-zscore", WF + _Z + " " + " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(SUM(CASE WHEN abs(({c} - {c}_m) / {c}_s) > 3 AND {c} <> {c}_d THEN 1 ELSE 0 END) AS BIGINT) AS outliers,
  round(SUM(CASE WHEN abs(({c} - {c}_m) / {c}_s) > 3 AND {c} <> {c}_d THEN 1 ELSE 0 END) * 100.0 / COUNT(*), 6)::DOUBLE AS outlier_pct FROM workforce, s""" for c in ("age", "monthly_income")))
def _(spark, sf):
    return rounded(O.outlier_report(workforce(spark, sf), "zscore", columns=["age", "monthly_income"]))
