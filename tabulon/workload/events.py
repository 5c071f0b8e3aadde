"""Ordered fills, payloads, files, period tables and job logs."""

from pyspark.sql import functions as F

from ..operators import aggregates as A, impute as I, joblog as J, stats as S
from ..session import scratch
from ..sources import readers as R, writers as Wr
from .tables import rounded, table

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


_GAPS = "g AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)"


def _gaps(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


def _fill_sql(part):
    w = "PARTITION BY user_id " if part else ""
    return f"""WITH {_GAPS} SELECT event_id, COALESCE(value, last_value(value IGNORE NULLS) OVER ({w}ORDER BY ts ROWS UNBOUNDED PRECEDING),
      first_value(value IGNORE NULLS) OVER ({w}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM g"""


def _interp_sql(part):
    w = "PARTITION BY user_id " if part else ""
    p = "PARTITION BY user_id" if part else ""
    return f"""WITH {_GAPS}, n AS (SELECT *, ROW_NUMBER() OVER ({w}ORDER BY ts) AS pos FROM g),
     k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pp,
       last_value(value IGNORE NULLS) OVER ({w}ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pv,
       first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER ({w}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np,
       first_value(value IGNORE NULLS) OVER ({w}ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM n)
     SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pp IS NULL THEN NULL WHEN np IS NULL THEN pv ELSE pv + (nv - pv) / (np - pp) * (pos - pp) END, 6) AS value FROM k"""


@query("IMP-06", _interp_sql(True))
def _(spark, sf):
    return rounded(I.fill_interpolate(_gaps(spark, sf), "ts", ["value"], ["user_id"]).select("event_id", "value"))


@query("IMP-06-global", _interp_sql(False))
def _(spark, sf):
    return rounded(I.fill_interpolate(_gaps(spark, sf), "ts", ["value"]).select("event_id", "value"))


@query("IMP-07", _fill_sql(True))
def _(spark, sf):
    return I.fill_forward_backward(_gaps(spark, sf), "ts", ["value"], ["user_id"]).select("event_id", "value")


@query("IMP-07-global", _fill_sql(False))
def _(spark, sf):
    return I.fill_forward_backward(_gaps(spark, sf), "ts", ["value"]).select("event_id", "value")


@query("IMP-07-chunks", _fill_sql(True))
def _(spark, sf):
    return I.fill_forward_backward(_gaps(spark, sf), "ts", ["value"], ["user_id"], chunks=16).select("event_id", "value")


@query("IMP-07-ties", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day, CASE WHEN extract(day FROM CAST(ts AS DATE)) % 3 != 1 THEN CAST(extract(day FROM CAST(ts AS DATE)) AS DOUBLE) END AS v FROM events),
     f AS (SELECT day, COALESCE(v, last_value(v IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING),
       first_value(v IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM d)
     SELECT event_id, f.value AS value FROM events JOIN f ON f.day = CAST(ts AS DATE)""")
def _(spark, sf):
    """Days as order values, some of them without any known value: every day is cut into several chunks."""
    day = F.to_date("ts")
    df = table(spark, sf, "events").select("event_id", day.alias("day"), F.when(F.dayofmonth(day) % 3 != 1, F.dayofmonth(day).cast("double")).alias("value"))
    return I.fill_forward_backward(df, "day", ["value"], chunks=100).select("event_id", "value")


# --- sources and sinks: tables written to the shared scratch folder and read back --------------------------------------

@query("SRC-01", """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL::INTEGER AS nation, true AS lined FROM supplier
  UNION ALL SELECT c_custkey, c_name, c_acctbal, c_nationkey, true FROM customer""")
def _(spark, sf):
    root = scratch(spark, "csv")
    table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).write.option("header", True).csv(f"{root}/s")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")).write.option("header", True).csv(f"{root}/c")
    df = R.read_csv(spark, [f"{root}/s/*.csv", f"{root}/c/*.csv", f"{root}/none.csv"])
    return df.select(F.col("key").cast("long").alias("key"), "name", F.col("balance").cast("double").alias("balance"), F.col("nation").cast("int").alias("nation"),
                     F.col("_source_file").isNotNull().alias("lined"))


@query("SRC-02", "SELECT event_id AS id, user_id AS \"who.user\", event_type AS \"who.kind\", value FROM events")
def _(spark, sf):
    root = scratch(spark, "json")
    nested = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("who"), "value")
    # one array per file of a few hundred elements: the shape of an exported JSON document
    arrays = nested.withColumn("_f", F.floor(F.col("id") / 500)).groupBy("_f").agg(F.to_json(F.collect_list(F.struct("id", "who", "value"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(root)
    return R.read_json(spark, [f"{root}/*.txt"], lineage=False)


@query("SRC-03", """SELECT event_type AS _source_endpoint, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events""")
def _(spark, sf):
    return R.normalise_payloads(table(spark, sf, "events"), "event_type", "props").drop(R.COLLECTED)


@query("SRC-04", """SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier
  UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.stack([s, c])


@query("SRC-05", """SELECT event_type AS _source_file, COUNT(*) AS records, CAST(4 AS BIGINT) AS columns, CAST(MAX(ts) AS VARCHAR)[:19] AS last_collected FROM events GROUP BY event_type""")
def _(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", F.col("event_type").alias(R.SOURCE), F.col("ts").alias(R.COLLECTED))
    out = R.collection_statistics(df)
    return out.withColumn("last_collected", F.substring(F.col("last_collected").cast("string"), 1, 19))


@query("SNK-01", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    path = Wr.export(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), scratch(spark, "export"), "csv")
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").option("header", True).csv(path)


@query("SNK-01-json", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(spark, sf):
    path = Wr.export(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), scratch(spark, "export"), "json")
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_totalprice double").json(path)


@query("SNK-04", "SELECT vec_id AS id, round(CAST(list_sum(embedding) AS DOUBLE), 4) AS total, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def _(spark, sf):
    path = Wr.export_collection(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), scratch(spark, "collection"))
    back = spark.read.parquet(path)
    return back.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("embedding").alias("width"))


@query("SNK-05", """SELECT '[' || turn || '] ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' ELSE 'System' END || ': ' || replace(text, chr(10), chr(92) || 'n') AS line FROM conversations""")
def _(spark, sf):
    return spark.read.text(Wr.export_transcripts(table(spark, sf, "conversations"), scratch(spark, "chat"))).withColumnRenamed("value", "line")


@query("SNK-05-history", "SELECT COUNT(*) AS queries, round(SUM(value), 4) AS total_seconds, round(AVG(value), 6) AS mean_seconds FROM events")
def _(spark, sf):
    log = table(spark, sf, "events").select("event_id", F.col("value").alias("seconds"))
    path = Wr.export_query_history(log, scratch(spark, "history"))
    totals = spark.read.schema("queries long, total_seconds double, mean_seconds double").json(f"{path}/totals")
    return totals.select("queries", F.round("total_seconds", 4).alias("total_seconds"), F.round("mean_seconds", 6).alias("mean_seconds"))


# --- periods and job logs ------------------------------------------------------------------------------------------------

@query("AGG-08", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, COUNT(*) AS orders, SUM(o_totalprice) AS revenue, AVG(o_totalprice) AS mean_price FROM orders GROUP BY 1)
  SELECT period, orders, round(revenue, 2) AS revenue, round(mean_price, 4) AS mean_price, orders - LAG(orders) OVER (ORDER BY period) AS orders_change,
   round(revenue - LAG(revenue) OVER (ORDER BY period), 2) AS revenue_change, round(mean_price - LAG(mean_price) OVER (ORDER BY period), 4) AS mean_price_change FROM m""")
def _(spark, sf):
    out = _months(spark, sf)
    digits = {"revenue": 2, "mean_price": 4, "revenue_change": 2, "mean_price_change": 4}
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in out.columns])


def _months(spark, sf):
    return A.by_period(table(spark, sf, "orders"), "o_orderdate", {
        "orders": F.count(F.lit(1)), "revenue": F.sum("o_totalprice"), "mean_price": F.avg("o_totalprice")})


@query("AGG-08-corr", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS period, COUNT(*) AS orders, SUM(o_totalprice) AS revenue, AVG(o_totalprice) AS mean_price FROM orders GROUP BY 1)
  SELECT 'orders' AS variable1, 'revenue' AS variable2, round(CORR(orders, revenue), 6) AS correlation FROM m UNION ALL SELECT 'orders', 'mean_price', round(CORR(orders, mean_price), 6) FROM m
  UNION ALL SELECT 'revenue', 'mean_price', round(CORR(revenue, mean_price), 6) FROM m""")
def _(spark, sf):
    return rounded(S.pearson(_months(spark, sf), ["orders", "revenue", "mean_price"]))


_JOBS = """j AS (SELECT user_id, CAST(ts AS DATE) AS day, MIN(ts) AS started_at, CASE WHEN COUNT(*) > 1 THEN MAX(ts) END AS completed_at,
   CASE WHEN SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 1 THEN 'failed' ELSE 'completed' END AS status FROM events GROUP BY 1, 2)"""


def _jobs(spark, sf):
    """A user's day is a job; it failed with more than one error and is unfinished with one event."""
    return table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").alias("started_at"), F.when(F.count(F.lit(1)) > 1, F.max("ts")).alias("completed_at"),
        F.when(F.count_if(F.col("event_type") == "error") > 1, F.lit("failed")).otherwise(F.lit("completed")).alias("status"))


@query("OP-01", f"""WITH {_JOBS} SELECT day, COUNT(*) AS total_jobs, COUNT(completed_at) AS finished_jobs, COUNT(CASE WHEN status = 'completed' THEN completed_at END) AS completed_jobs,
   round(COUNT(CASE WHEN status = 'completed' THEN completed_at END) * 100.0 / greatest(COUNT(completed_at), 1), 6)::DOUBLE AS success_rate,
   round(COALESCE(AVG(epoch(completed_at) - epoch(started_at)), 0), 3) AS average_duration FROM j GROUP BY day""")
def _(spark, sf):
    out = J.job_metrics(_jobs(spark, sf), ["day"])
    return out.withColumn("success_rate", F.round("success_rate", 6)).withColumn("average_duration", F.round("average_duration", 3))


@query("OP-01-progress", """SELECT user_id, COUNT(*) AS steps, SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS completed_steps,
  round(SUM(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / COUNT(*), 6) AS progress FROM events GROUP BY user_id""")
def _(spark, sf):
    return rounded(J.progress(table(spark, sf, "events"), "user_id", F.col("event_type") != "error"))


@query("OP-01-ratio", "SELECT round(AVG(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS success_ratio FROM events")
def _(spark, sf):
    return rounded(J.success_ratio(table(spark, sf, "events"), F.col("event_type") != "error"))


_ENT = """e AS (SELECT user_id, CAST(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
   CASE WHEN MAX(ts) < TIMESTAMP '2024-01-29' THEN 'offline' WHEN arg_max(event_type, ts) = 'error' THEN 'error' ELSE 'online' END AS status FROM events GROUP BY user_id),
 h AS (SELECT *, greatest(0, 100 - least(errors * 10, 50) - CASE status WHEN 'offline' THEN 30 WHEN 'error' THEN 20 ELSE 0 END)::DOUBLE AS health_score FROM e)"""


def _entities(spark, sf):
    last = F.max("ts")
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.when(last < F.to_timestamp_ntz(F.lit("2024-01-29 00:00:00")), F.lit("offline")).when(F.max_by("event_type", "ts") == "error", F.lit("error")).otherwise(F.lit("online")).alias("status"))


@query("OP-02", f"WITH {_ENT} SELECT * FROM h")
def _(spark, sf):
    return J.entity_health(_entities(spark, sf))


@query("OP-02-overall", f"""WITH {_ENT} SELECT COUNT(*) AS entities, round(AVG(health_score), 6) AS health_score,
  CASE WHEN AVG(health_score) > 80 THEN 'healthy' WHEN AVG(health_score) > 50 THEN 'degraded' ELSE 'unhealthy' END AS overall_health FROM h""")
def _(spark, sf):
    return rounded(J.overall_health(J.entity_health(_entities(spark, sf))))
