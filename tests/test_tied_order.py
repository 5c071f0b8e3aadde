"""Order columns with few values, nulls or NaN: chunks are cut inside ties, and the answer stays the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.functions import ordered

KINDS = {"date": "date", "one": "int", "gaps": "double", "nan": "double", "nulls": "timestamp"}


@pytest.fixture(scope="module")
def tied(spark):
    rng = np.random.default_rng(8)
    n = 3000
    df = spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "u": rng.integers(0, 4, n), "d": rng.choice([0, 1, 2, 9], n, p=[0.6, 0.2, 0.1, 0.1]),
        "x": np.where(rng.random(n) < 0.6, np.nan, rng.random(n))}))
    return df.select(
        "id", F.when(F.col("u") > 0, F.col("u")).alias("u"), F.when(~F.isnan("x"), F.col("x")).alias("x"),
        F.date_add(F.lit("2024-01-01"), F.col("d").cast("int")).alias("date"), F.lit(7).alias("one"),
        F.when(F.col("d") > 0, F.col("d").cast("double")).alias("gaps"), F.when(F.col("d") > 0, F.col("d").cast("double")).otherwise(F.lit(float("nan"))).alias("nan"),
        F.lit(None).cast("timestamp").alias("nulls")).repartition(5)


@pytest.mark.parametrize("order", KINDS)
@pytest.mark.parametrize("by", [[], ["u"]])
def test_same_answer_cut_inside_ties(tied, order, by):
    def answers(chunks):
        filled = ordered.carry_forward(tied, ["x"], order, by, backfill=True, chunks=chunks)
        before = ordered.carry_forward(tied, ["x"], order, by, include_current=False, chunks=chunks)
        between = ordered.interpolate(tied, ["x"], order, by, chunks=chunks)
        return [{r["id"]: r["x"] and round(r["x"], 9) for r in f.collect()} for f in (filled, before, between)]

    whole = answers(1)
    assert len(whole[0]) == 3000
    assert answers(12) == whole


@pytest.mark.parametrize("order", KINDS)
def test_chunks_are_even(tied, order):
    keyed, _ = ordered.with_key(tied, [])
    cut, n = ordered.with_chunks(keyed, order, [], 12, tie="_tie")
    sizes = [r["count"] for r in cut.groupBy("_chunk").count().collect()]
    assert n >= 10 and max(sizes) < 3000 / 12 * 2.5
    spans = cut.groupBy("_chunk").agg(F.min(F.struct(order, "_tie")).alias("lo"), F.max(F.struct(order, "_tie")).alias("hi")).orderBy("_chunk")
    assert spans.selectExpr("lo >= lag(hi) OVER (ORDER BY _chunk) AS fine").where("NOT fine").count() == 0


def test_rows_are_shuffled_once(tied):
    wide = tied.withColumn("payload", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 50)))
    for df in (ordered.carry_forward(wide, ["x"], "date", ["u"], backfill=True, chunks=12), ordered.interpolate(wide, ["x"], "date", ["u"], chunks=12)):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        # each exchange, and whether the payload of the rows is in the next projection that feeds it
        feeds = ["payload" in next(line for line in plan[i + 1:] if "Project" in line or "Aggregate" in line) for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
        assert sum(feeds) == 1 and len(feeds) > 1
