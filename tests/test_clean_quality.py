"""Cleaning, validation, quality, imputation and outliers on small tables with known results."""

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from tabulon.operators import clean as C, impute as I, outliers as O, quality as Q, validate as V


def test_names_and_internal_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], [" Job Role ", "Job_Role", "pay($)", "_source_file"])
    assert C.clean_column_names(df).columns == ["job_role", "job_role_2", "pay", "_source_file"]
    assert C.drop_internal_columns(df).columns == [" Job Role ", "Job_Role", "pay($)"]


def test_empty_columns_then_rows(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (None, None, float("nan")), (2, None, None)], "a int, b string, c double")
    out = C.drop_empty(df)
    assert out.columns == ["a"] and sorted(column(out, "a")) == [1, 2]


@pytest.mark.parametrize("kind,values,expected", [
    ("string", ["Yes", "No", "True", "False", "Left", "Stayed", "maybe", None], [1, 0, 1, 0, 1, 0, None, None]),
    ("int", [1, 0, 2, None], [1, 0, None, None]),
    ("boolean", [True, False, None], [1, 0, None]),
])
def test_target_spellings(spark, kind, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, y {kind}")
    assert column(C.encode_target(df, "y"), "y", "i") == expected


def test_numbers_that_do_not_parse(spark):
    df = spark.createDataFrame([(0, "1.5"), (1, "x"), (2, None), (3, "NaN")], "i int, v string")
    assert column(C.to_number(df, ["v", "absent"]), "v", "i") == [1.5, None, None, None]


def test_schema_report(spark):
    df = spark.createDataFrame([(17, "M"), (40, None), (50, "Q")], "age int, gender string")
    rows = {(r["rule"], r["column"], r["detail"]) for r in V.schema_report(df, ["attrition"], ["gender"], {"gender": ["M", "F"]}, {"age": (18, 100)}).collect()}
    assert rows == {("required", "attrition", "column is missing"), ("numeric", "gender", "column has type string"),
                    ("allowed", "gender", "null in 1 rows"), ("allowed", "gender", "Q in 1 rows"), ("range", "age", "17.0 to 50.0, allowed 18.0 to 100.0")}
    with pytest.raises(ValueError):
        V.validate(df)


def test_range_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_quantity")
    plan = V.filter_ranges(df, {"l_quantity": (10, 40)})._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "LessThanOrEqual(l_quantity,40.0)" in plan
    assert "l_extendedprice" not in plan


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (1, None)], "a int, b string")
    assert Q.duplicate_count(df).first()[0] == 2
    assert Q.drop_duplicates(df).count() == 2


def test_quality_scores_and_sentences(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (3, "b")], "a int, b string")
    capped, free = Q.quality_report(df).first(), Q.quality_report(df, capped=False).first()
    assert (capped["total_records"], capped["duplicate_records"], capped["missing_pct"]) == (4, 1, 25.0)
    assert capped["quality_score"] == pytest.approx(100 - 12.5 - 7.5 - 10)
    assert free["quality_score"] == pytest.approx(100 - 12.5 - 7.5 - 5)
    assert column(Q.quality_recommendations(Q.quality_report(df)), "recommendation") == [Q.TOO_MANY_MISSING, Q.HAS_DUPLICATES]
    good = spark.createDataFrame([(1,), (2,)], "a int")
    assert column(Q.quality_recommendations(Q.quality_report(good)), "recommendation") == [Q.ALL_GOOD]


def test_profile_and_summary(spark):
    df = spark.createDataFrame([(1.0, "b", 0), (3.0, "a", 0), (None, "b", 0), (8.0, "a", 0)], "x double, t string, _hidden int")
    p = {r["column"]: r for r in Q.profile(df).collect()}
    assert set(p) == {"x", "t"}
    assert (p["x"]["median"], p["x"]["missing"], p["t"]["most_common"], p["t"]["n_distinct"]) == (3.0, 1, "a", 2)
    assert {r["column"]: r for r in Q.profile(df, approximate=True).collect()}["t"]["n_distinct"] == 2
    s = {r["stage"]: r for r in Q.data_summary(df, None).collect()}
    assert s["raw"]["rows"] == 4 and not s["processed"]["available"]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", "b", "a", None])], "i int, t string")
    assert column(I.fill_mode(df), "t", "i") == ["b", "a", "b", "a", "a"]


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("chunks", [None, 1, 2, 3, 5])
def test_ordered_fills(spark, by, chunks):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, 3.0, None])], "g int, i int, v double")
    assert column(I.fill_interpolate(df, "i", ["v"], by, chunks), "v", "i") == [None, 1.0, 2.0, 3.0, 3.0]
    assert column(I.fill_forward_backward(df, "i", ["v"], by, chunks), "v", "i") == [1.0, 1.0, 1.0, 3.0, 3.0]


@pytest.mark.parametrize("chunks", [2, 7, 40])
def test_ordered_fills_match_pandas_on_a_skewed_key(spark, chunks):
    import pandas as pd

    rng = np.random.default_rng(3)
    n = 600
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 30, n)), "i": rng.permutation(n), "v": np.where(rng.random(n) < 0.7, np.nan, rng.random(n))})
    df = spark.createDataFrame(pdf)
    ordered = pdf.sort_values("i")
    want = ordered.assign(f=ordered.groupby("k")["v"].transform(lambda s: s.ffill().bfill()), p=ordered.groupby("k")["v"].transform(lambda s: s.interpolate(limit_direction="forward")))
    got_f = [r[0] for r in I.fill_forward_backward(df, "i", ["v"], ["k"], chunks).orderBy("i").select("v").collect()]
    got_p = [r[0] for r in I.fill_interpolate(df, "i", ["v"], ["k"], chunks).orderBy("i").select("v").collect()]
    for got, exp in ((got_f, want["f"]), (got_p, want["p"])):
        np.testing.assert_allclose([np.nan if v is None else v for v in got], exp.to_numpy(), rtol=1e-12)


def test_unpartitioned_fill_has_no_single_task_over_the_rows(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    plan = I.fill_forward_backward(ev, "ts", ["value"])._jdf.queryExecution().executedPlan().toString()
    # the one gathering exchange holds chunk summaries, which sit behind an aggregate
    detail = plan.split("BroadcastExchange")[0]
    assert "SinglePartition" not in detail


def test_auto_imputation_strategies(spark):
    rows = [(i, None if i % 10 < 6 else 1.0, None if i % 4 == 0 else float(i), None if i % 4 == 1 else "ab"[i % 2], None if i == 5 else float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, most double, some double, text string, few double")
    out = I.impute(df, "auto", order_by="i")
    assert "most" not in out.columns
    r = {x["i"]: x for x in out.collect()}
    assert r[0]["some"] == np.median([i for i in range(20) if i % 4])
    assert r[1]["text"] == "a" and r[5]["few"] == 4.0
    assert out.dropna().count() == 20
    with pytest.raises(ValueError):
        I.impute(df, "auto")
    with pytest.raises(ValueError):
        I.impute(df, "guess")


def test_capping_spares_the_excluded_target(spark):
    df = spark.createDataFrame([(i, int(i >= 8), float(i)) for i in range(10)], "i int, y int, x double")
    assert sum(column(O.treat_outliers(df, "iqr", columns=["y", "x"]), "y")) == 0.0
    assert sum(column(O.treat_outliers(df, "iqr", exclude=["y"]), "y")) == 2


def test_capping_is_stable_and_matches_numpy(spark):
    x = np.array([1.0, 2, 3, 4, 5, 6, 100, -80])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double")
    q1, q3 = np.quantile(x, [0.25, 0.75])
    once = O.treat_outliers(df, "iqr", columns=["x"])
    assert column(once, "x", "i") == pytest.approx(np.clip(x, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)).tolist())


def test_zscore_with_null_and_constant(spark):
    vals = [1.0] * 10 + [None, 50.0]
    df = spark.createDataFrame([(i, v, 7.0) for i, v in enumerate(vals)], "i int, x double, c double")
    out = O.treat_outliers(df, "zscore", columns=["x", "c"])
    assert column(out, "x", "i") == [1.0] * 10 + [None, 1.0]
    assert set(column(out, "c")) == {7.0}
    rep = {r["column"]: r["outliers"] for r in O.outlier_report(df, "zscore", columns=["x"]).collect()}
    assert rep == {"x": 1}
