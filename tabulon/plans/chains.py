"""The three preset analyses: basic, predictive, comprehensive. Frames are handed from step to step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, types as T

from .. import presets
from ..functions.columns import col, numeric_columns
from ..operators import clean as C, features as FE, impute as I, insights as N, ml as M, outliers as O, stats as S, validate as V
from ..session import staged

LEVELS = ("basic", "predictive", "comprehensive")
# Rows of a staged file: tasks get equal shares of the files, whatever the partitions that wrote them held.
FILE_ROWS = 100_000


@dataclass
class Analysis:
    table: DataFrame
    results: dict[str, DataFrame] = field(default_factory=dict)
    insights: DataFrame | None = None
    model: PipelineModel | None = None
    predictions: DataFrame | None = None


def preprocess(df: DataFrame, target: str, order_by: str, *, identifiers: Sequence[str] = (), outliers: str = "iqr",
               ranges=presets.RANGES, allowed=presets.ALLOWED) -> DataFrame:
    """Clean, impute, treat outliers, validate. Identifiers and the target are left alone by the numeric steps.

    The given table is staged, because cleaning and imputing scan it several times and it may be costly to compute. The
    imputed table is staged: the outlier step scans it twice, and imputing is the one step that shuffles.
    """
    out = C.clean(df, target, hold=_given)
    keep_out = [target, *identifiers]
    out = staged(I.fill_auto(out, order_by, exclude=keep_out), "imputed", FILE_ROWS)
    out = O.treat_outliers(out, outliers, exclude=keep_out)
    return V.filter_sets(V.filter_ranges(out, ranges), allowed)


def _given(df: DataFrame) -> DataFrame:
    """Columns without a type are wholly null, and no file holds them."""
    return staged(df.drop(*[f.name for f in df.schema if isinstance(f.dataType, T.NullType)]), "given", FILE_ROWS)


def run(df: DataFrame, target: str, order_by: str, level: str = "comprehensive", *, identifiers: Sequence[str] = (), model_type: str = "logistic_regression",
        search: bool = False, **options) -> Analysis:
    """basic: preprocess, statistics, insights. predictive: preprocess, features, model, insights. comprehensive: all.

    The preprocessed table is staged in the shared scratch folder, because every later step reads it.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    ids = list(dict.fromkeys([*identifiers, order_by]))
    table = preprocess(df, target, order_by, identifiers=ids, **options)
    if level != "basic":
        table = FE.interaction_features(FE.temporal_features(table))
    done = Analysis(staged(table, "preprocessed", FILE_ROWS))
    numeric = numeric_columns(done.table, exclude=[target, *ids])
    if level != "predictive":
        done.results = S.analyse(done.table, target, "basic" if level == "basic" else "comprehensive", numeric)
        if level == "basic":
            done.results["hypothesis_testing"] = S.t_tests(done.table, target, numeric)
    if level != "basic":
        ready = done.table.filter(col(target).isNotNull()).select(
            *[col(i) for i in ids], *[col(c).cast("double").alias(c) for c in numeric], col(target).cast("double").alias("label"))
        fit_on, held_out = M.stratified_split(ready, "label", ids)
        if search:
            done.model, _, _ = M.tune(fit_on, model_type, numeric, ids)
        else:
            done.model = M.train(fit_on, model_type, numeric)
        scored = M.score(done.model, held_out, [*ids, "label"])
        done.results["metrics"] = M.evaluate(scored, probability="probability" if "probability" in scored.columns else None)
        done.predictions = M.with_risk_label(scored) if "probability" in scored.columns else scored
    levels = {"basic": "basic", "predictive": "advanced", "comprehensive": "advanced"}
    done.insights = N.insights(done.results, levels[level])
    return done
