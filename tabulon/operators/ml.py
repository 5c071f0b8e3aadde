"""Classifier training, tuning, evaluation, scoring and a model registry, on Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import ordered
from ..functions.columns import col, nan_to_null, numeric_columns, replace_columns
from ..functions.quantiles import order_statistics, use_sketch
from ..session import staged
from .clean import encode_target
from .impute import fill_for_model
from .stats import find_target

# Rows of one part of what a model is fitted on: of a forest, which keeps a weight per row and tree, and how many times as
# many of the other kinds, whose hundreds of short passes cost a task for each part.
FIT_ROWS, PASS_PARTS = 30_000, 5
MODEL_TYPES = ("random_forest", "gradient_boosting", "logistic_regression", "svm")

# The search grids, without the one axis that Spark's forest doesn't have. `None` depth means as deep as
# Spark allows (30).
GRIDS = {
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [10, 20, None], "min_samples_leaf": [1, 2, 4]},
    "gradient_boosting": {"n_estimators": [100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "logistic_regression": {"C": [0.1, 1.0, 10.0], "penalty": ["l1", "l2"]},
    "svm": {"C": [0.1, 1.0, 10.0]},
}
# A cheaper search to pass as `grid`: few settings of the expensive ensembles, the whole grid of the linear models.
SMALL_GRIDS = {
    "random_forest": {"n_estimators": [100], "max_depth": [10], "min_samples_leaf": [1, 4]},
    "gradient_boosting": {"n_estimators": [100], "learning_rate": [0.1], "max_depth": [3, 5]},
    "logistic_regression": GRIDS["logistic_regression"],
    "svm": GRIDS["svm"],
}


def feature_names(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    return numeric_columns(df, exclude=[target, *exclude])


def prepare(df: DataFrame, target: str | None = None, features: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """ML-01: numeric features with their mean for missing values, and a 0/1 `label`."""
    target = find_target(df, target)
    df = encode_target(nan_to_null(df), target)
    names = list(features or feature_names(df, target, keep))
    filled = fill_for_model(df, names, target)
    return filled.select(*[col(k) for k in keep], *[col(c).cast("double").alias(c) for c in names], col(target).cast("double").alias("label"))


def with_split(df: DataFrame, label: str, unique: Sequence[str], test_size: float = 0.2, seed: int = 42,
               key: Column | None = None, sliced: bool | None = None) -> DataFrame:
    """ML-02: append `is_test`, true for the first `test_size` of every label in the order of a hash of `unique`.

    A label may hold most of the rows, so nothing is sorted per label: the hash value at the border rank is found
    by counting and the split is a comparison with it. `key` replaces the hash by an order of the caller's (exact as a
    double). Rows whose keys tie stay together: they are test rows only if all of them fit.
    """
    if not 0.1 <= test_size <= 0.5:
        raise ValueError("test_size must be 0.1 to 0.5")
    key = F.pmod(F.xxhash64(*[col(u) for u in unique], F.lit(seed)), F.lit(2**52)) if key is None else key
    keyed = df.withColumn("_key", key.cast("double"))
    border = lambda n: F.floor(n * F.lit(test_size) + F.lit(0.5))
    if sliced is None:
        sliced = use_sketch(keyed, ["_key"], [label])
    if not sliced:
        # only labels and keys are sorted; the struct compares a key that is null, too
        w = W.partitionBy("_l")
        place = F.count(F.lit(1)).over(w.orderBy("_key").rangeBetween(W.unboundedPreceding, W.currentRow))
        fits = keyed.select(col(label).alias("_l"), "_key").withColumn("_fits", place <= border(F.count(F.lit(1)).over(w))).where("_fits")
        cut = F.broadcast(fits.groupBy("_l").agg(F.max(F.struct("_key")).alias("_cut")))
        # one row per label
        return (keyed.join(cut, col(label).eqNullSafe(F.col("_l")), "left")
                .withColumn("is_test", F.coalesce(F.struct("_key") <= F.col("_cut"), F.lit(False))).drop("_key", "_l", "_cut"))
    cut = order_statistics(keyed, ["_key"], [border], [test_size], [label]).select(col(label).alias("_l"), F.col("v")[0].alias("_cut"))
    # one row per label
    return keyed.join(cut, col(label).eqNullSafe(F.col("_l")), "left").withColumn("is_test", F.col("_key") < F.col("_cut")).drop("_key", "_l", "_cut")


def stratified_split(df: DataFrame, label: str, unique: Sequence[str], test_size: float = 0.2, seed: int = 42, **kw) -> tuple[DataFrame, DataFrame]:
    marked = staged(with_split(df, label, unique, test_size, seed, **kw), "split")  # both parts, and every pass of a fit, read it
    return marked.filter(~F.col("is_test")).drop("is_test"), marked.filter("is_test").drop("is_test")


def classifier(model_type: str, rows: int, **p):
    """ML-03 … ML-06: the estimator for one setting, in the reference grid's vocabulary."""
    common = {"featuresCol": "scaled", "labelCol": "label"}
    if model_type == "random_forest":
        # a row's node in each tree is kept from level to level, instead of its way from the root being taken again
        return RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth") or 30,
                                      minInstancesPerNode=p.get("min_samples_leaf", 1), seed=42, cacheNodeIds=True, **common)
    if model_type == "gradient_boosting":
        return GBTClassifier(maxIter=p.get("n_estimators", 100), stepSize=p.get("learning_rate", 0.1),
                             maxDepth=p.get("max_depth", 3), seed=42, **common)
    strength = 1.0 / (p.get("C", 1.0) * max(rows, 1))
    if model_type == "logistic_regression":
        return LogisticRegression(elasticNetParam=1.0 if p.get("penalty", "l2") == "l1" else 0.0, regParam=strength, **common)
    if model_type == "svm":
        return LinearSVC(regParam=strength, **common)
    raise ValueError(f"model type must be one of {MODEL_TYPES}")


def preparation(features: Sequence[str]) -> list:
    """Fitted with the model, so that scoring fills and scales with the training values."""
    filled = [f"_f{i}" for i in range(len(features))]
    return [
        Imputer(strategy="mean", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
    ]


def _fit_parts(rows: int, model_type: str, cores: int) -> int:
    """Parts of FIT_ROWS, for other models than forests larger ones, but no fewer than keep the cores busy."""
    parts = -(-rows // FIT_ROWS)
    return parts if model_type == "random_forest" else max(-(-parts // PASS_PARTS), min(parts, cores))


def train(df: DataFrame, model_type: str, features: Sequence[str], rows: int | None = None, **params) -> PipelineModel:
    """Fit preparation and classifier on (features…, label).

    Every pass of a fit reads the staged rows, in parts whose number follows the rows.
    """
    held = staged(df.select(*[col(f) for f in features], "label"), "training")
    n = held.count()
    held = held.repartition(_fit_parts(n, model_type, df.sparkSession.sparkContext.defaultParallelism)).persist() if n > FIT_ROWS else held
    try:
        return Pipeline(stages=[*preparation(features), classifier(model_type, n if rows is None else rows, **params)]).fit(held)
    finally:
        held.unpersist()


def settings(grid: Mapping[str, Sequence]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def tune(df: DataFrame, model_type: str, features: Sequence[str], unique: Sequence[str], *, folds: int = 5, seed: int = 42,
         grid: Mapping[str, Sequence] | None = None, parallelism: int = 4, fold: Column | None = None) -> tuple[PipelineModel, dict, DataFrame]:
    """ML-07: grid search by F1 of class 1 over hash folds; returns (model, best setting, scores per setting).

    `fold` replaces the hash by a number from 0 to `folds` - 1 of the caller's. Preparation is fitted once and its output is what the folds read.
    """
    if not 3 <= folds <= 10:
        raise ValueError("folds must be 3 to 10")
    tried = settings(grid or GRIDS[model_type])
    prep = Pipeline(stages=preparation(features)).fit(df)
    fold = F.pmod(F.xxhash64(*[col(u) for u in unique], F.lit(seed)), F.lit(folds)) if fold is None else fold
    ready = prep.transform(df).select("scaled", "label", fold.cast("int").alias("fold")).persist()
    try:
        n = ready.count()
        first = classifier(model_type, n, **tried[0])
        maps = []
        for s in tried:
            made = classifier(model_type, n, **s)
            maps.append({first.getParam(p.name): v for p, v in made.extractParamMap().items() if made.isSet(p)})
        search = CrossValidator(
            estimator=first, estimatorParamMaps=maps, foldCol="fold", numFolds=folds, parallelism=parallelism, seed=seed,
            evaluator=MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0),
        ).fit(ready)
    finally:
        ready.unpersist()
    best = max(range(len(tried)), key=lambda i: search.avgMetrics[i])
    rows = [(str(s), float(m)) for s, m in zip(tried, search.avgMetrics)]
    scores = df.sparkSession.createDataFrame(rows, "setting string, f1 double")
    return PipelineModel(stages=[*prep.stages, search.bestModel]), tried[best], scores


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] | None = None, name: str = "") -> DataFrame:
    """ML-09: class and, where the model has one, probability of class 1. Row-wise, so it also serves streams."""
    out = model.transform(df)
    kept = list(keep) if keep is not None else df.columns
    cols = [col(c) for c in kept] + [F.col("prediction").cast("int").alias(f"prediction{name}")]
    if "probability" in out.columns:
        cols.append(vector_to_array("probability")[1].alias(f"probability{name}"))
    return out.select(*cols)


def risk_label(probability: Column, threshold: float = 0.5) -> Column:
    """ML-16"""
    return F.when(probability > threshold, F.lit("High Risk")).otherwise(F.lit("Low Risk"))


def with_risk_label(df: DataFrame, probability: str = "probability", threshold: float = 0.5) -> DataFrame:
    return replace_columns(df, {probability: F.round(col(probability), 3), "risk_level": risk_label(col(probability), threshold)})


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, rows)"""
    return df.groupBy(col(label).cast("int").alias("label"), col(prediction).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("rows"))


def roc_auc(df: DataFrame, label: str = "label", probability: str = "probability", chunks: int | None = None) -> DataFrame:
    """Exact area under the curve from counts per distinct score; ties count half."""
    y = col(label).cast("int")
    counts = df.groupBy(col(probability).cast("double").alias("s")).agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    run = ordered.running_total(counts, [], "s", "neg", "upto", chunks)
    won = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / F.lit(2.0)))
    return run.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def evaluate(df: DataFrame, label: str = "label", prediction: str = "prediction", probability: str | None = None) -> DataFrame:
    """ML-08: one row of counts and rates; a rate without cases is 0, the area is null without a probability."""
    y, p = col(label).cast("int"), col(prediction).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.select("tp", "fp", "tn", "fn", rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"),
                   rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))
    if probability is None:
        return out.withColumn("roc_auc", F.lit(None).cast("double"))
    return out.withColumn("roc_auc", roc_auc(df, label, probability).scalar())


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support of every class, from the confusion counts."""
    m = confusion(df, label, prediction)
    cells = m.select(F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("rows").alias("actual"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("rows").alias("predicted")),
    )).alias("e"), F.when(F.col("label") == F.col("prediction"), F.col("rows")).otherwise(F.lit(0)).alias("hit"))
    g = cells.groupBy(F.col("e.class").alias("class")).agg(
        F.sum("e.actual").alias("support"), F.sum("e.predicted").alias("_p"),
        F.sum(F.when(F.col("e.actual") > 0, F.col("hit")).otherwise(F.lit(0))).alias("_hit"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit, sup, pred = F.col("_hit"), F.col("support"), F.col("_p")
    return g.filter((sup > 0) | (pred > 0)).select(
        "class", rate(hit, pred).alias("precision"), rate(hit, sup).alias("recall"), rate(2 * hit, sup + pred).alias("f1"), "support")


def ensemble_vote(df: DataFrame, predictions: Sequence[str], probabilities: Sequence[str] = ()) -> DataFrame:
    """ML-13: class 1 if the mean vote exceeds one half, and the mean of the probabilities there are."""
    vote = sum((col(c).cast("double") for c in predictions), F.lit(0.0)) / len(predictions)
    prob = sum((col(c) for c in probabilities), F.lit(0.0)) / len(probabilities) if probabilities else F.lit(None).cast("double")
    return replace_columns(df, {"ensemble_prediction": (vote > 0.5).cast("int"), "ensemble_probability": prob})


def ensemble_score(models: Sequence[PipelineModel], df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """Every model adds its columns to the same rows; no join."""
    kept = list(keep) if keep is not None else df.columns
    out, preds, probs = df, [], []
    for i, m in enumerate(models):
        out = score(m, out, out.columns, f"_{i}")
        preds.append(f"prediction_{i}")
        if f"probability_{i}" in out.columns:
            probs.append(f"probability_{i}")
    return ensemble_vote(out, preds, probs).select(*[col(k) for k in kept], *preds, *probs, "ensemble_prediction", "ensemble_probability")


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """ML-14: importances of a tree model, highest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# --- registry: one row per event; the latest row of a model counts ---------------------------------------------------

REGISTRY_SCHEMA = ("model_id string, model_type string, setting string, features array<string>, path string, version string, "
                   "training_rows long, test_rows long, accuracy double, precision double, recall double, f1 double, roc_auc double, recorded_at timestamp")
METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc")


def _record(spark, root: str, entry: dict) -> None:
    names = [part.split()[0] for part in REGISTRY_SCHEMA.split(", ")]
    row = spark.createDataFrame([tuple(entry.get(n) for n in names)], REGISTRY_SCHEMA)
    row.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/registry")


def save_model(model: PipelineModel, root: str, model_id: str, model_type: str, features: Sequence[str], setting: Mapping | None = None,
               metrics: Mapping | None = None, training_rows: int | None = None, test_rows: int | None = None, version: str = "1.0.0") -> str:
    """SNK-02"""
    from pyspark.sql import SparkSession

    path = f"{root}/models/{model_id}"
    model.write().overwrite().save(path)
    _record(SparkSession.active(), root, {
        "model_id": model_id, "model_type": model_type, "setting": str(dict(setting or {})), "features": list(features), "path": path,
        "version": version, "training_rows": training_rows, "test_rows": test_rows, **{m: (metrics or {}).get(m) for m in METRICS}})
    return path


def registry(spark, root: str) -> DataFrame:
    """ML-15: the latest row of every model."""
    r = spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/registry")
    fields = [c for c in r.columns if c != "model_id"]
    return r.groupBy("model_id").agg(F.max_by(F.struct(*fields), "recorded_at").alias("_r")).select("model_id", "_r.*")


def models_by_type(spark, root: str) -> DataFrame:
    return registry(spark, root).groupBy("model_type").agg(F.count(F.lit(1)).alias("models"), F.max("f1").alias("best_f1"))


def model_sizes(spark, root: str) -> DataFrame:
    """Bytes on disk per model, from the file listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/models").select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"/models/([^/]+)/", 1).alias("model_id")).agg(F.sum("length").alias("bytes"))


def load_model(spark, root: str, model_id: str) -> tuple[PipelineModel, dict]:
    found = registry(spark, root).filter(F.col("model_id") == model_id).first()
    if found is None:
        raise ValueError(f"model {model_id} not found")
    return PipelineModel.load(found["path"]), found.asDict()


def evaluate_stored(root: str, model_id: str, df: DataFrame, target: str) -> DataFrame:
    """ML-10: metrics of a stored model on new labelled rows; they become its current metrics."""
    spark = df.sparkSession
    model, entry = load_model(spark, root, model_id)
    labelled = encode_target(df, target).select(*[col(f).cast("double").alias(f) for f in entry["features"]], col(target).alias("label")).dropna(subset=["label"])
    scored = score(model, labelled, ["label"])
    result = evaluate(scored, probability="probability" if "probability" in scored.columns else None)
    row = result.first().asDict()
    _record(spark, root, {**entry, **{m: row[m] for m in METRICS}})
    return spark.createDataFrame([tuple(row.values())], result.schema)


def train_and_register(df: DataFrame, root: str, model_id: str, *, target: str | None = None, model_type: str = "random_forest",
                       unique: Sequence[str], features: Sequence[str] | None = None, test_size: float = 0.2, search: bool = False,
                       setting: Mapping | None = None, folds: int = 5, grid: Mapping | None = None, key: Column | None = None) -> DataFrame:
    """ML-11: split, train or tune, evaluate, save; returns the registry row. `key` orders the split, see `with_split`."""
    target = find_target(df, target)
    coded = encode_target(nan_to_null(df), target)
    names = list(features or feature_names(coded, target, unique))
    coded = coded.select(*[col(u) for u in unique], *[col(c).cast("double").alias(c) for c in names], col(target).cast("double").alias("label")).dropna(subset=["label"])
    train_df, test_df = stratified_split(coded, "label", unique, test_size, key=key)
    train_df = train_df.persist()
    try:
        n_train = train_df.count()
        if search:
            model, setting, _ = tune(train_df, model_type, names, unique, folds=folds, grid=grid)
        else:
            setting = dict(setting or {})
            model = train(train_df, model_type, names, n_train, **setting)
        scored = score(model, test_df, ["label"])
        m = evaluate(scored, probability="probability" if "probability" in scored.columns else None).first().asDict()
    finally:
        train_df.unpersist()
    n_test = m["tp"] + m["fp"] + m["tn"] + m["fn"]
    save_model(model, root, model_id, model_type, names, setting, m, n_train, n_test)
    return registry(df.sparkSession, root).filter(F.col("model_id") == model_id)


def retrain(df: DataFrame, root: str, old_id: str, new_id: str, *, target: str, unique: Sequence[str], **kw) -> DataFrame:
    """ML-12: the stored model's type and features, on new data, under a new id."""
    found = registry(df.sparkSession, root).filter(F.col("model_id") == old_id).first()
    if found is None:
        raise ValueError(f"model {old_id} not found")
    return train_and_register(df, root, new_id, target=target, model_type=found["model_type"], unique=unique, features=found["features"], **kw)
