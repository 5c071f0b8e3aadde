"""Features, selection, statistics, aggregates and insights on small tables with known results."""

import numpy as np
import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from tabulon import presets
from tabulon.functions.columns import right_closed_bin
from tabulon.operators import aggregates as A, features as FE, insights as N, selection as SEL, stats as S

D4 = [(1.0, 1), (2.5, 1), (3.0, 1), (7.0, 0), (5.0, 0), (9.0, 0), (2.0, 0)]


@pytest.fixture(scope="module")
def d4(spark):
    return spark.createDataFrame(D4, "x double, y int")


def test_right_closed_bins(spark):
    v = [0, 1, 2, 5, 6, 100, 101, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x int")
    got = column(df.select("i", FE.tenure_category(F.col("x")).alias("b")), "b", "i")
    assert got == [None, "New", "New", "Early", "Mid", "Veteran", None, None]
    cut = pd.cut(pd.Series([x for x in v if x is not None]), presets.TENURE_EDGES, labels=presets.TENURE_LABELS)
    assert got[:-1] == [None if pd.isna(x) else x for x in cut]
    with pytest.raises(ValueError):
        right_closed_bin(F.lit(1), [0, 0, 1], ["a", "b"])


def test_role_flags_and_ratios(spark):
    df = spark.createDataFrame([("Master", "Lab ASSISTANT", 4, 0), ("Master", None, None, 3), (None, "Sales Associate", 10, -1)], "education string, job_role string, age int, years_at_company int")
    r = FE.interaction_features(df).collect()
    assert [x["education_level"] for x in r] == [3, 3, 2] and [x["education_role_mismatch"] for x in r] == [1, 0, 0]
    assert [x["age_tenure_ratio"] for x in r] == [4.0, None, None]
    assert [x["tenure_risk"] for x in FE.temporal_features(df).collect()] == [1, 0, 1]


def test_polynomials(spark):
    df = spark.createDataFrame([(2.0, 3.0, None)], "a double, b double, c double")
    out = FE.polynomial_features(df, ["a", "b", "c"], 3)
    row = out.first()
    assert row["poly_a^2"] == 4 and row["poly_a b"] == 6 and row["poly_a^2 b"] == 12 and row["poly_a c"] == 0 and row["poly_1"] == 1
    assert len(out.columns) == 3 + 1 + 6 + 10
    assert FE.polynomial_features(df, ["a"], 2).columns == df.columns
    with pytest.raises(ValueError):
        FE.polynomial_features(df, ["a", "b"], 6)


def test_dummies_match_pandas_and_are_bounded(spark):
    vals = ["b", "a", None, "c", "b"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    want = pd.get_dummies(pd.Series(vals), prefix="t", drop_first=True).astype(int)
    got = FE.dummy_columns(df, ["t"]).orderBy("i").toPandas()
    assert list(want.columns) == ["t_b", "t_c"] and (got[["t_b", "t_c"]].to_numpy() == want.to_numpy()).all()
    with pytest.raises(ValueError, match="levels"):
        FE.dummy_columns(df, ["t"], max_levels=2)


def test_power_features_need_complete_columns(spark):
    df = spark.createDataFrame([(1.0, 0.0, None), (4.0, 9.0, 2.0)], "p double, z double, h double")
    new = set(FE.power_features(df).columns) - {"p", "z", "h"}
    assert new == {"p_log", "p_squared", "p_sqrt", "z_squared", "z_sqrt", "h_squared"}
    assert "p_squared" not in FE.power_features(df, exclude=["p"]).columns


def test_label_codes_and_scaling(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (1, "a", 2.0), (2, None, 3.0)], "i int, t string, x double")
    model = FE.label_encoder(df, ["t"])
    assert column(FE.label_encode(df, model), "t_encoded", "i") == [2, 1, 0]
    assert {(r["value"], r["code"]) for r in FE.label_mapping(spark, model).collect()} == {("Unknown", 0), ("a", 1), ("b", 2)}
    assert column(FE.scale(df, ["x"]), "x_scaled", "i") == pytest.approx([-1.5 ** 0.5, 0, 1.5 ** 0.5])
    assert set(column(FE.scale(df.withColumn("x", F.lit(5.0)), ["x"]), "x_scaled")) == {0.0}


def test_generated_features_leave_the_target_alone(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, "u"), (2.0, 1.0, 0, "v")], "a double, b double, y int, t string").withColumn("day", F.to_date(F.lit("2024-03-04")))
    out = FE.generate(df, "y")
    assert {"a_squared", "a_x_b", "t_v", "day_dayofweek"} <= set(out.columns) and not [c for c in out.columns if c.startswith("y_") or c.endswith("_x_y")]
    assert out.first()["day_dayofweek"] == 0
    rep = FE.engineering_report(df, FE.engineer(df.withColumnRenamed("a", "age").withColumn("years_at_company", F.lit(3)), "y"))
    assert {r["feature_group"] for r in rep.collect()} >= {"temporal", "interaction"}


def test_describe_small(d4):
    r = S.describe(d4, ["x"]).first()
    assert r["skewness"] == pytest.approx(0.5883095315) and r["kurtosis"] == pytest.approx(-1.0386402396) and r["q25"] == 2.25
    assert r["std"] == pytest.approx(np.std([x for x, _ in D4], ddof=1))
    table = {x["statistic"]: x["x"] for x in S.describe_table(d4, ["x"]).collect()}
    assert table["count"] == 7 and table["50%"] == 3.0 and len(table) == 8


def test_all_null_columns_are_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, float("nan"))], "a double, b double")
    assert column(S.describe(df), "variable") == ["a"]


def test_t_test_and_anova_agree(d4):
    t, f = S.t_tests(d4, "y", ["x"]).first(), S.anova(d4, "y", ["x"]).first()
    assert t["t_statistic"] == pytest.approx(-1.9509210754) and t["p_value"] == pytest.approx(0.1085420751)
    assert f["f_statistic"] == pytest.approx(3.8060930424) and f["p_value"] == pytest.approx(0.1085420751)
    assert not t["significant"] and t["effect_size"] == "medium"


def test_anova_p_matches_spark_ml(spark, sf):
    from pyspark.ml.feature import VectorAssembler

    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(*cols, F.dense_rank().over(__import__("pyspark").sql.Window.orderBy("l_returnflag")).cast("double").alias("y"))
    vec = VectorAssembler(inputCols=cols, outputCol="f").transform(df).select("f", "y")
    row = spark._jvm.org.apache.spark.ml.stat.ANOVATest.test(vec._jdf, "f", "y").first()
    want = list(row.getAs("pValues").toArray())
    got = {r["variable"]: r["p_value"] for r in S.anova(df, "y", cols).collect()}
    assert [got[c] for c in cols] == pytest.approx(want, abs=1e-9)


def test_pca_against_numpy(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select(*cols)
    comp, load = S.pca(df, cols)
    eig = np.sort(np.linalg.eigvalsh(np.corrcoef(df.toPandas().to_numpy().T)))[::-1]
    rows = comp.orderBy("component").collect()
    assert [r["explained_ratio"] for r in rows] == pytest.approx((eig / eig.sum()).tolist(), abs=1e-9)
    assert rows[-1]["cumulative"] == pytest.approx(1.0) and load.count() == 16
    norms = load.groupBy("component").agg(F.sum(F.col("loading") ** 2).alias("n"))
    assert column(norms, "n") == pytest.approx([1.0] * 4)


def test_information_ranks_and_selection(spark):
    rng = np.random.default_rng(1)
    n = 800
    y = rng.integers(0, 2, n)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "good": y + rng.normal(0, 0.3, n), "fair": y + rng.normal(0, 1.5, n), "noise": rng.normal(0, 1, n)}))
    for method in SEL.METHODS:
        got = [r["variable"] for r in SEL.feature_scores(df, "y", method, 2).collect()]
        assert got == ["good", "fair"], method
    assert SEL.select_features(df, "y", 1).columns == ["good", "y"]
    assert column(S.top_features(S.feature_importance(df, "y"), 1), "variable") == ["good"]
    with pytest.raises(ValueError):
        SEL.feature_scores(df, "y", "guess", 1)


def test_target_is_found_by_name(spark):
    df = spark.createDataFrame([(1, 0)], "a int, Churned int")
    assert S.find_target(df) == "Churned"
    with pytest.raises(ValueError):
        S.find_target(df.drop("Churned"))
    with pytest.raises(ValueError):
        S.analyse(df, level="deep")


def test_histogram_keeps_empty_bins(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 0.1, 9.9, 10.0]], "x double")
    h = A.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["rows"] for r in h] == [2, 0, 0, 0, 2] and h[-1]["upper"] == pytest.approx(10.0)


def test_box_numbers_sliced(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", 500.0), ("b", 1.0)], "g string, x double")
    a = A.box_numbers(df, "x", "g", sliced=False).orderBy("g").collect()
    assert a == A.box_numbers(df, "x", "g", sliced=True).orderBy("g").collect()
    assert a[0]["outliers"] == 1 and a[0]["whisker_high"] == 19.0


def test_insight_rules(spark):
    top = spark.createDataFrame([(f"f{i}", i) for i in range(1, 8)], "variable string, best_rank int")
    recs = N.recommendations(top)
    assert recs.count() == 6 and recs.filter("severity = 'high'").count() == 3
    pri = N.prioritise(recs).collect()
    assert [p["insight_id"] for p in pri[:3]] == ["rec_f1", "rec_f2", "general_rec"]
    plan = {r["insight_id"]: r["phase"] for r in N.implementation_plan(N.prioritise(recs)).collect()}
    assert plan["rec_f1"] == "phase_1" and plan["rec_f3"] == "phase_2"
    totals = N.roi_totals(N.cost_benefit(N.prioritise(recs))).first()
    assert totals["total_cost"] == 3 * 50000 + 3 * 15000
    trend = N.skew_trends(spark.createDataFrame([("v", -2.5), ("w", 0.2), ("u", 1.5)], "variable string, skewness double"))
    assert {(r["title"], r["severity"]) for r in trend.collect()} == {("Distribution Skewness: v", "high"), ("Distribution Skewness: u", "medium")}
    assert "Review data collection methods for v" in trend.filter("insight_id = 'trend_v'").first()["recommendations"]
    assert N.insight_summary(recs.limit(0)).first()["summary"] == "No insights generated."
    flagged = spark.createDataFrame([("v", True), ("w", False)], "variable string, significant boolean")
    assert N.risk_overview(N.risk_assessments(N.factor_risks(flagged))).first()["advice"][0] == "Immediate attention required for 1 high-risk areas"
