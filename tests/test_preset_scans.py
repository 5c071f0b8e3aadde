"""The preset chains compute the given table once, and what follows reads and sorts no more than it needs."""

import pandas as pd
from pyspark.sql import functions as F

from tabulon.functions import ordered
from tabulon.operators import clean, ml
from tabulon.plans import chains


def test_the_given_table_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = [(k, "Yes" if k % 3 else "No", None if k % 4 == 1 else float(k % 50), None if k % 30 == 7 else float(k % 9)) for k in range(300)]
    given = spark.createDataFrame(rows, "id long, attrition string, wage double, score double").mapInPandas(count, "id long, attrition string, wage double, score double")
    done = chains.preprocess(given.withColumn("empty", F.lit(None)), "attrition", "id", identifiers=["id"])
    assert done.count() == 300 and "empty" not in done.columns and not done.where("wage IS NULL OR score IS NULL").count()
    assert seen.value == 300


def test_no_row_is_looked_at_for_gaps_where_a_column_has_none(spark):
    whole = spark.createDataFrame([(1, None, None), (2, "a", None)], "id int, t string, none string")
    out = clean.drop_empty(whole)
    assert out.columns == ["id", "t"] and out.count() == 2
    assert "Filter" not in out._jdf.queryExecution().analyzed().toString()
    gaps = spark.createDataFrame([(1, None), (None, "a"), (None, None)], "id int, t string")
    assert clean.drop_empty(gaps).count() == 2 and clean.drop_empty(gaps.where("id > 5")).columns == []


def test_a_split_sorts_labels_and_keys_only(spark):
    rows = [(k, k % 2, None if k < 4 else float(k // 3), "x" * 9) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, label int, key double, wide string")
    out = ml.with_split(df, "label", ["id"], 0.2, key=F.col("key"), sliced=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window ["):].splitlines()[0]
    assert "wide" not in below and out.columns == ["id", "label", "key", "wide", "is_test"]
    frame = pd.DataFrame(rows, columns=["id", "label", "key", "wide"])
    place = frame.assign(key=frame["key"].fillna(-1)).groupby("label")["key"].rank("max")
    assert {r["id"] for r in out.where("is_test").collect()} == set(frame["id"][place <= 6]) != set()
    wide = [p for p in plan.splitlines() if "Sort [" in p and "wide" in p]
    assert not wide


def test_chunks_without_a_key_follow_the_cores(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("v"))
    least = ordered._global_chunks(df)
    assert least == max(8, 4 * spark.sparkContext.defaultParallelism) and ordered.with_chunks(df, "id", [], None, least)[1] >= 8
    got = ordered.carry_forward(df, ["v"], "id", backfill=True).collect()
    assert all(r["v"] == r["id"] // 7 * 7 for r in got) and len(got) == 1000
