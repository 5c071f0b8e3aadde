"""Feature selection: a score table per method and a narrowed frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import col, numeric_columns
from .impute import fill_constant
from .stats import anova, by_score, mutual_information, target_correlations

METHODS = ("correlation", "mutual_info", "f_statistic")


def feature_scores(df: DataFrame, target: str, method: str, k: int, columns: Sequence[str] | None = None) -> DataFrame:
    """SEL-01 … SEL-03: (variable, score) of the k best features; ties go to the smaller name."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    names = list(columns or numeric_columns(df, exclude=[target]))
    if method == "correlation":
        scores = target_correlations(df, target, names).select("variable", F.abs("correlation").alias("score"))
    else:
        filled = fill_constant(df, number=0, text=None, columns=names)
        if method == "mutual_info":
            scores = mutual_information(filled, target, names).select("variable", F.col("mutual_information").alias("score"))
        else:
            scores = anova(filled, target, names).select("variable", F.col("f_statistic").alias("score"))
    return scores.orderBy(*by_score("score")).limit(k)


def select_features(df: DataFrame, target: str, k: int, method: str = "correlation", columns: Sequence[str] | None = None) -> DataFrame:
    """The chosen features and the target. At most k names reach the driver."""
    chosen = [r["variable"] for r in feature_scores(df, target, method, k, columns).collect()]
    return df.select(*[col(c) for c in chosen], col(target))
