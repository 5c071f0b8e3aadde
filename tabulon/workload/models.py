"""Model queries. Rule-made predictions have SQL; what training yields is checked by its invariants in the tests."""

from pyspark.sql import functions as F

from ..operators import clean as C, ml as M
from ..plans import chains
from ..session import scratch, staged
from .quality import target01
from .tables import WF, WFT, rounded, workforce

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


FEATURES = ["age", "monthly_income", "performance_rating", "satisfaction_score", "years_at_company", "overtime_yes"]


def training(spark, sf):
    """employee_id, numeric features, label."""
    df = workforce(spark, sf).withColumn("overtime_yes", (F.col("overtime") == "Yes").cast("int"))
    df = C.encode_target(df, "attrition")
    return df.select("employee_id", *[F.col(c).cast("double").alias(c) for c in FEATURES], F.col("attrition").cast("double").alias("label"))


@query("ML-01", WFT + """ SELECT employee_id, round(COALESCE(age, (SELECT AVG(age) FROM wf)), 6)::DOUBLE AS age, round(COALESCE(monthly_income, (SELECT AVG(monthly_income) FROM wf)), 6)::DOUBLE AS monthly_income,
  attrition::DOUBLE AS label FROM wf""")
def _(spark, sf):
    return rounded(M.prepare(workforce(spark, sf), "attrition", ["age", "monthly_income"], keep=["employee_id"]))


# An order that SQL can follow: a product with a prime modulus has no ties.
_ORDER = "(employee_id * 48271) % 2147483647"
_SPLIT = WFT + f""" SELECT employee_id, CAST(attrition AS INTEGER) AS attrition,
  ROW_NUMBER() OVER (PARTITION BY attrition ORDER BY {_ORDER}) <= floor(COUNT(*) OVER (PARTITION BY attrition) * 0.2 + 0.5) AS is_test FROM wf"""


def _split(spark, sf, sliced):
    df = target01(spark, sf).select("employee_id", "attrition")
    return M.with_split(df, "attrition", ["employee_id"], key=F.expr(_ORDER), sliced=sliced)


@query("ML-02", _SPLIT)
def _(spark, sf):
    return _split(spark, sf, None)


@query("ML-02-sliced", _SPLIT)
def _(spark, sf):
    return _split(spark, sf, True)


def fit_and_score(spark, sf, kind, **setting):
    train, test = M.stratified_split(training(spark, sf), "label", ["employee_id"])
    model = M.train(train, kind, FEATURES, **setting)
    return rounded(M.score(model, test, ["employee_id", "label"]))


@query("ML-03")
def _(spark, sf):
    return fit_and_score(spark, sf, "random_forest", n_estimators=100, max_depth=10)


@query("ML-04")
def _(spark, sf):
    return fit_and_score(spark, sf, "gradient_boosting", n_estimators=100, max_depth=3)


@query("ML-05")
def _(spark, sf):
    return fit_and_score(spark, sf, "logistic_regression", C=1.0, penalty="l1")


@query("ML-06")
def _(spark, sf):
    return fit_and_score(spark, sf, "svm", C=1.0)


@query("ML-07")
def _(spark, sf):
    return rounded(M.tune(training(spark, sf), "logistic_regression", FEATURES, ["employee_id"])[2])


# Rule-made predictions: a class and a probability per employee.
_RULES = """, pr AS (SELECT employee_id, attrition AS label, CASE WHEN overtime = 'Yes' THEN 1 ELSE 0 END AS a, CASE WHEN years_at_company <= 2 THEN 1 ELSE 0 END AS b, CASE WHEN satisfaction_score <= 2 THEN 1 ELSE 0 END AS c,
   ((CASE WHEN overtime = 'Yes' THEN 4 ELSE 0 END) + (6 - satisfaction_score) + (CASE WHEN years_at_company <= 2 THEN 4 ELSE 0 END)) / 16.0::DOUBLE AS p FROM wf)"""


def rules(spark, sf):
    flag = lambda c: c.cast("int")
    w = target01(spark, sf)
    a, b, c = flag(F.col("overtime") == "Yes"), flag(F.col("years_at_company") <= 2), flag(F.col("satisfaction_score") <= 2)
    p = (a * 4 + (6 - F.col("satisfaction_score")) + b * 4) / F.lit(16.0)
    return w.select("employee_id", F.col("attrition").alias("label"), a.alias("a"), b.alias("b"), c.alias("c"), p.alias("p"))


_EVAL = """, q AS (SELECT COUNT(*) FILTER (label = 1 AND a = 1) AS tp, COUNT(*) FILTER (label = 0 AND a = 1) AS fp, COUNT(*) FILTER (label = 0 AND a = 0) AS tn, COUNT(*) FILTER (label = 1 AND a = 0) AS fn FROM pr),
  n AS (SELECT *, rank() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM pr),
  auc AS (SELECT (SUM(r) FILTER (label = 1) - SUM(label) * (SUM(label) + 1) / 2) / (SUM(label) * (COUNT(*) - SUM(label))) AS roc_auc FROM n)"""


@query("ML-08", WFT + _RULES + _EVAL + """ SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc_auc, 6)::DOUBLE AS roc_auc FROM q, auc""")
def _(spark, sf):
    return rounded(M.evaluate(rules(spark, sf), "label", "a", "p"))


@query("ML-08-confusion", WFT + _RULES + " SELECT CAST(label AS INTEGER) AS label, CAST(a AS INTEGER) AS prediction, COUNT(*) AS rows FROM pr GROUP BY 1, 2")
def _(spark, sf):
    return M.confusion(rules(spark, sf), "label", "a")


@query("ML-08-classes", WFT + _RULES + """, k AS (SELECT unnest([0, 1]) AS class) SELECT CAST(class AS INTEGER) AS class, round(COUNT(*) FILTER (label = class AND a = class) / COUNT(*) FILTER (a = class), 6) AS precision,
  round(COUNT(*) FILTER (label = class AND a = class) / COUNT(*) FILTER (label = class), 6) AS recall,
  round(2 * COUNT(*) FILTER (label = class AND a = class) / (COUNT(*) FILTER (label = class) + COUNT(*) FILTER (a = class)), 6) AS f1, COUNT(*) FILTER (label = class) AS support FROM pr, k GROUP BY class""")
def _(spark, sf):
    return rounded(M.class_report(rules(spark, sf), "label", "a"))


@query("ML-09")
def _(spark, sf):
    df = training(spark, sf)
    return rounded(M.score(M.train(df, "logistic_regression", FEATURES), df, ["employee_id"]))


def registered(spark, sf):
    root = scratch(spark, "models")
    M.train_and_register(training(spark, sf), root, "first", target="label", model_type="logistic_regression", unique=["employee_id"], features=FEATURES)
    return root


@query("ML-10")
def _(spark, sf):
    return rounded(M.evaluate_stored(registered(spark, sf), "first", training(spark, sf), "label"))


@query("ML-11")
def _(spark, sf):
    out = M.registry(spark, registered(spark, sf))
    return rounded(out.select("model_id", "model_type", "setting", F.array_join("features", ",").alias("features"), "training_rows", "test_rows", *M.METRICS))


@query("ML-12")
def _(spark, sf):
    root = registered(spark, sf)
    out = M.retrain(training(spark, sf), root, "first", "second", target="label", unique=["employee_id"])
    return rounded(out.select("model_id", "model_type", "training_rows", "test_rows", *M.METRICS))


@query("ML-13", WFT + _RULES + " SELECT employee_id, CASE WHEN (a + b + c) / 3.0 > 0.5 THEN 1 ELSE 0 END AS ensemble_prediction, round((p + 0.5) / 2, 6) AS ensemble_probability FROM pr")
def _(spark, sf):
    df = rules(spark, sf).withColumn("half", F.lit(0.5))
    return rounded(M.ensemble_vote(df, ["a", "b", "c"], ["p", "half"]).select("employee_id", "ensemble_prediction", "ensemble_probability"))


@query("ML-13-models")
def _(spark, sf):
    df = staged(training(spark, sf), "ensemble", M.FIT_ROWS)  # three fits and the scores read it
    models = [M.train(df, "logistic_regression", FEATURES), M.train(df, "svm", FEATURES), M.train(df, "random_forest", FEATURES, n_estimators=100, max_depth=10)]
    return rounded(M.ensemble_score(models, df, ["employee_id"]))


@query("ML-14")
def _(spark, sf):
    model = M.train(training(spark, sf), "random_forest", FEATURES, n_estimators=100, max_depth=10)
    return rounded(M.importances(model, FEATURES, spark))


@query("ML-16", WFT + _RULES + " SELECT employee_id, round(p, 3) AS p, CASE WHEN p > 0.5 THEN 'High Risk' ELSE 'Low Risk' END AS risk_level FROM pr")
def _(spark, sf):
    return M.with_risk_label(rules(spark, sf), "p").select("employee_id", "p", "risk_level")


@query("SNK-02", WF + " SELECT COUNT(*) AS rows, 0.0::DOUBLE AS largest_difference FROM workforce")
def _(spark, sf):
    # scores of a model and of the same model saved and loaded: the largest difference
    df = training(spark, sf)
    root = scratch(spark, "models")
    model = M.train(df, "logistic_regression", FEATURES)
    M.save_model(model, root, "kept", "logistic_regression", FEATURES)
    loaded, _ = M.load_model(spark, root, "kept")
    both = M.score(loaded, M.score(model, df, None, "_made"), None, "_loaded")
    return rounded(both.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(F.col("probability_made") - F.col("probability_loaded"))).alias("largest_difference")))


@query("PRE-basic")
def _(spark, sf):
    done = chains.run(workforce(spark, sf), "attrition", "employee_id", "basic")
    return done.insights.select("insight_id", "insight_type", "title", "severity", "confidence", "impact_score")


@query("PRE-comprehensive")
def _(spark, sf):
    done = chains.run(workforce(spark, sf), "attrition", "employee_id", "comprehensive")
    return done.insights.select("insight_id", "insight_type", "title", "severity", "confidence", "impact_score")


@query("PRE-predictive")
def _(spark, sf):
    done = chains.run(workforce(spark, sf), "attrition", "employee_id", "predictive")
    return done.insights.select("insight_id", "insight_type", "title", "severity", "confidence", "impact_score")


# A label that one column decides up to a share, so that the smallest model of each kind has a closed form.
_PLANTED = WF + """, pl AS (SELECT employee_id, CASE WHEN overtime = 'Yes' THEN 1 ELSE 0 END AS o,
   CAST(CASE WHEN overtime = 'Yes' THEN employee_id % 3 <> 0 ELSE employee_id % 7 = 0 END AS INTEGER) AS y FROM workforce),
  g AS (SELECT employee_id, o, y, AVG(y) OVER (PARTITION BY o) AS r FROM pl)"""


def planted(spark, sf):
    y = F.when(F.col("overtime_yes") == 1, F.col("employee_id") % 3 != 0).otherwise(F.col("employee_id") % 7 == 0)
    return training(spark, sf).withColumn("label", y.cast("double"))


def stump(df):
    return M.train(df, "random_forest", FEATURES, n_estimators=1, max_depth=1)


# A forest draws its rows with replacement, so its probability is only near the share.
@query("ML-03-stump", _PLANTED + " SELECT employee_id, CAST(r > 0.5 AS INTEGER) AS prediction FROM g")
def _(spark, sf):
    df = planted(spark, sf)
    return M.score(stump(df), df, ["employee_id"]).drop("probability")


@query("ML-04-stump", _PLANTED + " SELECT employee_id, CAST(r > 0.5 AS INTEGER) AS prediction, round(1 / (1 + exp(-2 * (2 * r - 1))), 6) AS probability FROM g")
def _(spark, sf):
    df = planted(spark, sf)
    return rounded(M.score(M.train(df, "gradient_boosting", FEATURES, n_estimators=1, max_depth=1), df, ["employee_id"]))


@query("ML-05-saturated", _PLANTED + " SELECT employee_id, CAST(r > 0.5 AS INTEGER) AS prediction, round(r, 3) AS probability FROM g")
def _(spark, sf):
    df = planted(spark, sf)
    out = M.score(M.train(df, "logistic_regression", ["overtime_yes"], C=1e9), df, ["employee_id"])
    return out.withColumn("probability", F.round("probability", 3))


@query("ML-06-majority", _PLANTED + " SELECT employee_id, CAST(r > 0.5 AS INTEGER) AS prediction FROM g")
def _(spark, sf):
    df = planted(spark, sf)
    return M.score(M.train(df, "svm", ["overtime_yes"]), df, ["employee_id"])


@query("ML-09-labelled", _PLANTED + " SELECT employee_id, CAST(o AS DOUBLE) AS overtime_yes, CAST(y AS DOUBLE) AS label, CAST(r > 0.5 AS INTEGER) AS prediction, round(r, 3) AS probability FROM g")
def _(spark, sf):
    df = planted(spark, sf)
    out = M.score(M.train(df, "logistic_regression", ["overtime_yes"], C=1e9), df, ["employee_id", "overtime_yes", "label"])
    return out.withColumn("probability", F.round("probability", 3))


@query("ML-10-stump", _PLANTED + ", pr AS (SELECT y AS label, CAST(r > 0.5 AS INTEGER) AS a, r AS p FROM g)" + _EVAL + """ SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc_auc, 6)::DOUBLE AS roc_auc FROM q, auc""")
def _(spark, sf):
    df, root = planted(spark, sf), scratch(spark, "models")
    M.save_model(stump(df), root, "stump", "random_forest", FEATURES)
    return rounded(M.evaluate_stored(root, "stump", df, "label"))


_ROWS = WFT + """, t AS (SELECT attrition, floor(COUNT(*) * 0.2 + 0.5) AS test, COUNT(*) AS rows FROM wf GROUP BY 1)
  SELECT '<id>' AS model_id, 'logistic_regression' AS model_type, CAST(SUM(rows - test) AS BIGINT) AS training_rows, CAST(SUM(test) AS BIGINT) AS test_rows FROM t"""


@query("ML-11-rows", _ROWS.replace("<id>", "first"))
def _(spark, sf):
    return M.registry(spark, registered(spark, sf)).select("model_id", "model_type", "training_rows", "test_rows")


@query("ML-12-rows", _ROWS.replace("<id>", "second"))
def _(spark, sf):
    out = M.retrain(training(spark, sf), registered(spark, sf), "first", "second", target="label", unique=["employee_id"])
    return out.select("model_id", "model_type", "training_rows", "test_rows")


# Folds by employee number. Without a penalty the model says each group's share of the other folds; under a crushing one
# their overall share.
@query("ML-07-saturated", _PLANTED + """, fo AS (SELECT unnest(range(5)) AS f),
  sh AS (SELECT f, o, AVG(y) AS r FROM pl, fo WHERE employee_id % 5 <> f GROUP BY f, o), al AS (SELECT f, AVG(y) AS r FROM pl, fo WHERE employee_id % 5 <> f GROUP BY f),
  pr AS (SELECT sh.f, y, CAST(sh.r > 0.5 AS INTEGER) AS free, CAST(al.r > 0.5 AS INTEGER) AS tied FROM pl JOIN sh ON sh.f = employee_id % 5 AND sh.o = pl.o JOIN al ON al.f = sh.f),
  k AS (SELECT unnest([1e-9, 1e9]) AS c, unnest(['1e-09', '1000000000.0']) AS said), pe AS (SELECT unnest(['l1', 'l2']) AS penalty),
  sc AS (SELECT said, penalty, f, SUM(y * CASE WHEN c < 1 THEN tied ELSE free END) AS tp, SUM(CASE WHEN c < 1 THEN tied ELSE free END) AS found, SUM(y) AS pos FROM pr, k, pe GROUP BY ALL)
  SELECT replace('{~C~: ' || said || ', ~penalty~: ~' || penalty || '~}', '~', chr(39)) AS setting, round(AVG(COALESCE(2 * tp / nullif(found + pos, 0), 0)), 6) AS f1 FROM sc GROUP BY 1""")
def _(spark, sf):
    out = M.tune(planted(spark, sf), "logistic_regression", ["overtime_yes"], ["employee_id"], fold=F.col("employee_id") % 5, grid={"C": [1e-9, 1e9], "penalty": ["l1", "l2"]})
    return rounded(out[2])


def _metrics_sql(model_id: str, label: str) -> str:
    return _PLANTED + f""", z AS (SELECT employee_id, o, {label} AS y FROM pl), t AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY employee_id) <= floor(COUNT(*) OVER (PARTITION BY y) * 0.2 + 0.5) AS test FROM z),
  s AS (SELECT o, AVG(y) AS r FROM t WHERE NOT test GROUP BY o), pr AS (SELECT y AS label, CAST(r > 0.5 AS INTEGER) AS a, r AS p FROM t JOIN s USING (o) WHERE test)""" + _EVAL + f"""
  SELECT '{model_id}' AS model_id, (SELECT COUNT(*) FROM t WHERE NOT test) AS training_rows, (SELECT COUNT(*) FROM t WHERE test) AS test_rows, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(roc_auc, 6)::DOUBLE AS roc_auc FROM q, auc"""


def registered_planted(spark, sf):
    root = scratch(spark, "models")
    return root, M.train_and_register(planted(spark, sf), root, "first", target="label", model_type="logistic_regression", unique=["employee_id"],
                                      features=["overtime_yes"], setting={"C": 1e9}, key=F.col("employee_id"))


@query("ML-11-metrics", _metrics_sql("first", "y"))
def _(spark, sf):
    return rounded(registered_planted(spark, sf)[1].select("model_id", "training_rows", "test_rows", *M.METRICS))


@query("ML-12-metrics", _metrics_sql("second", "1 - y"))
def _(spark, sf):
    """On new labels, the opposite of those that the first model was trained on."""
    df = planted(spark, sf).withColumn("label", 1 - F.col("label"))
    out = M.retrain(df, registered_planted(spark, sf)[0], "first", "second", target="label", unique=["employee_id"], setting={"C": 1e9}, key=F.col("employee_id"))
    return rounded(out.select("model_id", "training_rows", "test_rows", *M.METRICS))


@query("ML-14-planted", _PLANTED + """, b AS (SELECT MAX(r) > MIN(r) AS splits FROM g), f AS (SELECT unnest(['age', 'monthly_income', 'performance_rating', 'satisfaction_score', 'years_at_company', 'overtime_yes']) AS feature)
  SELECT feature, CASE WHEN feature = 'overtime_yes' AND splits THEN 1.0 ELSE 0.0 END::DOUBLE AS importance FROM f, b""")
def _(spark, sf):
    return rounded(M.importances(stump(planted(spark, sf)), FEATURES, spark))
