"""Training, tuning, evaluation, registry and ensembles."""

import numpy as np
import pandas as pd
import pytest
from conftest import column
from pyspark.sql import functions as F

from tabulon.operators import ml as M
from tabulon.streaming import rowwise
from tabulon.session import scratch, staged

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    n = 600
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "label": (a + 0.5 * b + rng.normal(0, 0.3, n) > 0.5).astype(float)})
    pdf.loc[::17, "b"] = np.nan
    return spark.createDataFrame(pdf).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).cache()


@pytest.mark.parametrize("kind,setting", [("random_forest", {"n_estimators": 10, "max_depth": 5}), ("gradient_boosting", {"n_estimators": 5}),
                                          ("logistic_regression", {"C": 1.0, "penalty": "l1"}), ("svm", {"C": 10.0})])
def test_models_beat_the_majority(table, kind, setting):
    train, test = M.stratified_split(table, "label", ["id"])
    assert train.count() + test.count() == 600 and train.join(test, "id").count() == 0
    scored = M.score(M.train(train, kind, FEATURES, **setting), test, ["id", "label"])
    assert ("probability" in scored.columns) == (kind != "svm")
    m = M.evaluate(scored, probability="probability" if kind != "svm" else None).first()
    share = column(test.agg(F.avg("label")), "avg(label)")[0]
    assert m["accuracy"] > max(share, 1 - share) + 0.05
    assert (m["roc_auc"] is None) == (kind == "svm")


def test_tuning_returns_every_setting(table):
    model, best, scores = M.tune(table, "logistic_regression", FEATURES, ["id"], folds=3, grid={"C": [0.1, 10.0], "penalty": ["l2"]})
    assert scores.count() == 2 and best in M.settings({"C": [0.1, 10.0], "penalty": ["l2"]})
    assert M.score(model, table.drop("label"), ["id"]).count() == 600
    with pytest.raises(ValueError):
        M.tune(table, "svm", FEATURES, ["id"], folds=2)


def test_vote_ties_are_zero(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.2), (1, 1, 0, 0.8)], "a int, b int, c int, p double")
    assert [r["ensemble_prediction"] for r in M.ensemble_vote(df, ["a", "b"]).collect()] == [0, 1]
    assert [r["ensemble_prediction"] for r in M.ensemble_vote(df, ["a", "b", "c"], ["p"]).collect()] == [0, 1]
    assert M.ensemble_vote(df, ["a"]).first()["ensemble_probability"] is None


def test_metrics_without_cases_are_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "label int, prediction int")
    m = M.evaluate(df).first()
    assert (m["precision"], m["recall"], m["f1"], m["accuracy"]) == (0.0, 0.0, 0.0, 0.5)


def test_registry_round_trip(spark, table):
    root = scratch(spark, "registry")
    first = M.train_and_register(table, root, "one", target="label", model_type="logistic_regression", unique=["id"], features=FEATURES).first()
    assert first["training_rows"] + first["test_rows"] == 600 and first["accuracy"] > 0.8
    again = M.evaluate_stored(root, "one", table.filter("a > 0"), "label").first()
    assert M.registry(spark, root).first()["accuracy"] == pytest.approx(again["accuracy"])
    M.retrain(table, root, "one", "two", target="label", unique=["id"])
    assert {r["model_id"] for r in M.registry(spark, root).collect()} == {"one", "two"}
    assert M.models_by_type(spark, root).first()["models"] == 2
    sizes = {r["model_id"]: r["bytes"] for r in M.model_sizes(spark, root).collect()}
    assert sizes.keys() == {"one", "two"} and all(v > 0 for v in sizes.values())
    with pytest.raises(ValueError):
        M.load_model(spark, root, "three")


def test_scoring_a_stream(spark, table):
    model = M.train(table, "logistic_regression", FEATURES)
    src, out, check = (scratch(spark, x) for x in ("in", "out", "check"))
    table.drop("label").write.parquet(src)
    stream = spark.readStream.schema(table.drop("label").schema).parquet(src)
    q = rowwise.to_parquet(rowwise.score_rows(model, stream), out, check)
    q.awaitTermination(120)
    want = {r["id"]: r["risk_level"] for r in M.with_risk_label(M.score(model, table)).collect()}
    assert {r["id"]: r["risk_level"] for r in spark.read.parquet(out).collect()} == want


def test_importances_are_sorted(spark, table):
    rows = M.importances(M.train(table, "random_forest", FEATURES, n_estimators=5, max_depth=4), FEATURES, spark).collect()
    assert [r["feature"] for r in rows] == ["a", "b"] and sum(r["importance"] for r in rows) == pytest.approx(1.0)


def test_fit_reads_staged_rows_in_parts_that_follow_their_number(spark, monkeypatch):
    seen, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M, "FIT_ROWS", 50)
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df, *a: seen.append(df) or fit(self, df, *a))
    for rows in (40, 200, 400):
        computed = spark.range(0, rows, 1, 1).selectExpr("id", "cast(id % 10 as double) AS x", "cast(id % 10 > 4 as double) AS label")
        model = M.train(computed, "random_forest", ["x"], n_estimators=3, max_depth=2)
        right = M.score(model, computed, ["label"]).where("label = prediction").count()
        assert right == rows and seen[-1].inputFiles()
    assert [df.rdd.getNumPartitions() for df in seen[1:]] == [4, 8]


def test_a_forest_keeps_the_nodes_of_its_rows_and_scores_alike(table):
    made = M.classifier("random_forest", 600, n_estimators=5, max_depth=6)
    assert made.getCacheNodeIds()
    ready = M.Pipeline(stages=M.preparation(FEATURES)).fit(table).transform(table).select("id", "scaled", "label").cache()
    kept, walked = (sorted((r["id"], r["probability"].toArray().tolist()) for r in m.fit(ready).transform(ready).collect()) for m in (made, made.copy().setCacheNodeIds(False)))
    assert kept == walked


def test_passes_of_other_models_take_fewer_larger_parts(spark, monkeypatch):
    seen, fit = [], M.Pipeline.fit
    monkeypatch.setattr(M, "FIT_ROWS", 10)
    monkeypatch.setattr(M.Pipeline, "fit", lambda self, df, *a: seen.append(df) or fit(self, df, *a))
    rows = spark.range(0, 600, 1, 1).selectExpr("cast(id % 10 as double) AS x", "cast(id % 10 > 4 as double) AS label")
    for kind, setting in (("logistic_regression", {}), ("gradient_boosting", {"n_estimators": 2}), ("random_forest", {"n_estimators": 2, "max_depth": 2})):
        M.train(rows, kind, ["x"], **setting)
    assert [df.rdd.getNumPartitions() for df in seen] == [12, 12, 60]
    assert M._fit_parts(5_400_000, "svm", 12) == 108_000 and M._fit_parts(50, "svm", 8) == 5 and M._fit_parts(200, "svm", 8) == 8


def test_staged_rows_are_cut_into_files(spark):
    held = staged(spark.range(0, 100, 1, 1), "cut", 30)
    assert len(held.inputFiles()) == 4 and held.count() == 100 and len(staged(spark.range(0, 100, 1, 1), "whole").inputFiles()) == 1
