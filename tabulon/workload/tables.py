"""The given tables, and the workforce table that is derived from two of them by one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

WORKFORCE = """
WITH o AS (
  SELECT o_custkey, COUNT(*) AS n_orders, MIN(o_orderdate) AS hire_date
  FROM orders GROUP BY o_custkey
), b AS (
  SELECT c.c_custkey AS k, c.c_mktsegment AS department, c.c_acctbal AS bal,
         COALESCE(o.n_orders, 0) AS n_orders, o.hire_date,
         18 + (c.c_custkey * 7) % 47 AS age0, (c.c_custkey * 3) % 26 AS tenure,
         1 + (c.c_custkey * 11) % 5 AS perf, 1 + (c.c_custkey * 13 + 2) % 5 AS sat,
         (c.c_custkey * 17) % 10 AS r10, (c.c_custkey * 7919) % 7 AS noise
  FROM customer c LEFT JOIN o ON c.c_custkey = o.o_custkey
)
SELECT k AS employee_id,
  CASE WHEN k % 29 = 0 THEN NULL WHEN k % 211 = 5 THEN 130 ELSE age0 END AS age,
  CASE WHEN k % 37 = 3 THEN 'Other' WHEN k % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
  CASE k % 4 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor' WHEN 2 THEN 'Master' ELSE 'Doctorate' END AS education,
  CASE k % 3 WHEN 0 THEN 'Sales Associate' WHEN 1 THEN 'Research Manager' ELSE 'Lab assistant' END AS job_role,
  department,
  CASE WHEN r10 < 2 THEN 'Travel_Frequently' WHEN r10 < 8 THEN 'Travel_Rarely' ELSE 'Non-Travel' END AS business_travel,
  CASE WHEN k % 4 = 1 THEN NULL WHEN k % 97 = 4 THEN 60000.0 ELSE CAST(bal AS DOUBLE) + 2000.0 END AS monthly_income,
  CASE WHEN r10 IN (1, 4, 7) THEN 'Yes' ELSE 'No' END AS overtime,
  perf AS performance_rating, sat AS satisfaction_score,
  tenure AS years_at_company, CAST(tenure * 3 AS DOUBLE) / 4 AS years_in_current_role,
  tenure % 7 AS years_since_last_promotion, k % 8 AS training_times_last_year,
  CASE WHEN k % 5 < 3 THEN NULL ELSE 'x' END AS mostly_missing,
  hire_date, n_orders,
  CASE WHEN (CASE WHEN tenure <= 2 THEN 3 ELSE 0 END) + (CASE WHEN r10 IN (1, 4, 7) THEN 3 ELSE 0 END)
          + (CASE WHEN sat <= 2 THEN 2 ELSE 0 END) + noise >= 9
       THEN CASE WHEN k % 3 = 0 THEN 'Left' ELSE 'Yes' END
       ELSE CASE WHEN k % 3 = 0 THEN 'Stayed' ELSE 'No' END END AS attrition
FROM b
"""

# For SQL texts: `WITH` clause prefixes.
WF = f"WITH workforce AS ({WORKFORCE})"
# The same with the target as 0/1.
WFT = f"""{WF}, wf AS (SELECT * EXCLUDE (attrition), CASE WHEN attrition IN ('Yes','True','Left') THEN 1
  WHEN attrition IN ('No','False','Stayed') THEN 0 END AS attrition FROM workforce)"""

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def workforce(spark: SparkSession, sf: str) -> DataFrame:
    for name in ("customer", "orders"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return spark.sql(WORKFORCE)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])
