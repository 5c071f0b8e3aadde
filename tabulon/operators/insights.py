"""Insight tables: rules over the result tables of the statistics and of the models.

Every table may carry segment columns (`by`); ranks, phases and totals are then per segment. A segment holds at most
a few rows per analysed column, so windows over segments stay small while the number of segments is free to grow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import texts as X

LEVELS = {
    "basic": ("risk",),
    "comprehensive": ("risk", "trend", "recommendation", "impact"),
    "advanced": ("risk", "trend", "recommendation", "impact", "predictive"),
}


def _say(template: str, *subjects: Column) -> Column:
    n = template.replace("%%", "").count("%")
    # one subject may be named several times
    args = subjects * n if len(subjects) == 1 and n > 1 else subjects
    return F.format_string(template, *args[:n]) if n else F.lit(template)


def _lines(templates: Sequence[str], *subjects: Column) -> Column:
    return F.array(*[_say(t, *subjects) for t in templates])


def _insight(df: DataFrame, by: Sequence[str], insight_id: Column, kind: str, title: Column, description: Column, severity: Column | str,
             confidence: float, impact: Column | float, evidence: Column, actions: Column, tags: Sequence[str], metadata: Mapping[str, Column]) -> DataFrame:
    return df.select(
        *by, insight_id.alias("insight_id"), F.lit(kind).alias("insight_type"), title.alias("title"), description.alias("description"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(confidence).alias("confidence"),
        (impact if isinstance(impact, Column) else F.lit(impact)).cast("double").alias("impact_score"),
        evidence.alias("evidence"), actions.alias("recommendations"), F.array(*[F.lit(t) for t in tags]).alias("tags"),
        F.create_map(*[x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]).alias("metadata"))


def factor_risks(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-01: one row per significant factor of ST-07."""
    v = F.col("variable")
    return _insight(tests.filter("significant"), by, F.concat(F.lit("risk_"), v), "risk", _say(X.RISK_TITLE, v), _say(X.RISK_DESCRIPTION, v),
                    "high", 0.85, 8.0, _lines(X.RISK_EVIDENCE, v), _lines(X.RISK_ACTIONS, v), X.RISK_TAGS,
                    {"factor": v, "analysis_type": F.lit("hypothesis_testing")})


def pair_risks(high_pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-02: one row per pair of ST-05 with signed r above 0.8."""
    a, b, r = F.col("variable1"), F.col("variable2"), F.col("correlation")
    return _insight(high_pairs.filter(r > 0.8), by, F.concat_ws("_", F.lit("corr_risk"), a, b), "risk", _say(X.PAIR_TITLE, a, b), _say(X.PAIR_DESCRIPTION, a, b),
                    "medium", 0.75, 6.0, F.array(_say(X.PAIR_EVIDENCE, r)), _lines(X.PAIR_ACTIONS), X.PAIR_TAGS,
                    {"variable1": a, "variable2": b, "correlation": r, "strength": F.col("strength")})


def skew_trends(described: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-03: one row per variable of ST-01 with |skewness| above 1."""
    v, s = F.col("variable"), F.col("skewness")
    return _insight(described.filter(F.abs(s) > 1.0), by, F.concat(F.lit("trend_"), v), "trend", _say(X.SKEW_TITLE, v), F.format_string(X.SKEW_DESCRIPTION, v, s),
                    F.when(F.abs(s) < 2.0, F.lit("medium")).otherwise(F.lit("high")), 0.80, 5.0, F.array(_say(X.SKEW_EVIDENCE, s)),
                    _lines(X.SKEW_ACTIONS, v), X.SKEW_TAGS, {"variable": v, "skewness": s})


def recommendations(top: DataFrame, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """INS-04: one row for each of the first `k` features of ST-10, and one general row per segment."""
    ranked = top.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("best_rank", "variable"))).filter(F.col("_i") <= k)
    v, i = F.col("variable"), F.col("_i")
    focus = _insight(ranked, by, F.concat(F.lit("rec_"), v), "recommendation", _say(X.FOCUS_TITLE, v), _say(X.FOCUS_DESCRIPTION, v),
                     F.when(i <= 2, F.lit("high")).otherwise(F.lit("medium")), 0.90, F.when(i <= 2, F.lit(9.0)).otherwise(F.lit(7.0)),
                     F.array(_say(X.FOCUS_EVIDENCE, i)), _lines(X.FOCUS_ACTIONS, v), X.FOCUS_TAGS, {"feature": v, "ranking": i})
    segments = top.select(*by).distinct() if by else top.sparkSession.range(1)
    general = _insight(segments, by, F.lit("general_rec"), "recommendation", F.lit(X.GENERAL_TITLE), F.lit(X.GENERAL_DESCRIPTION), "high", 0.85, 9.0,
                       _lines(X.GENERAL_EVIDENCE), _lines(X.GENERAL_ACTIONS), X.GENERAL_TAGS, {"recommendation_type": F.lit("general_strategy")})
    return focus.unionByName(general)


def factor_impacts(tests: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-05: one row per significant factor."""
    v = F.col("variable")
    return _insight(tests.filter("significant"), by, F.concat(F.lit("impact_"), v), "impact", _say(X.IMPACT_TITLE, v), _say(X.IMPACT_DESCRIPTION, v),
                    "high", 0.80, 8.5, _lines(X.IMPACT_EVIDENCE, v), _lines(X.IMPACT_ACTIONS, v), X.IMPACT_TAGS,
                    {"factor": v, "impact_type": F.lit("statistical")})


def accuracy_insight(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-06: a row where the accuracy of ML-08 exceeds 0.8."""
    a = F.col("accuracy")
    return _insight(metrics.filter(a > 0.8), by, F.lit("pred_accuracy"), "predictive", F.lit(X.ACCURACY_TITLE), F.format_string(X.ACCURACY_DESCRIPTION, a * 100),
                    "low", 0.90, 7.0, F.array(F.format_string(X.ACCURACY_EVIDENCE, a * 100)), _lines(X.ACCURACY_ACTIONS), X.ACCURACY_TAGS,
                    {"accuracy": a, "model_type": F.lit("attrition_prediction")})


def _lookup(table: Mapping[str, float], key: Column, default: float) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key], F.lit(default))


def risk_assessments(risks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-07: risk score = severity weight x confidence."""
    return risks.select(
        *by, F.replace(F.col("insight_id"), F.lit("risk_"), F.lit("risk_assessment_")).alias("risk_id"), F.col("insight_type").alias("risk_type"), "description",
        F.col("confidence").alias("probability"), F.col("impact_score").alias("impact"),
        (_lookup(X.SEVERITY_WEIGHT, F.col("severity"), 5.0) * F.col("confidence")).alias("risk_score"),
        F.col("recommendations").alias("mitigation_strategies"), F.array(F.concat(F.lit("Monitor "), F.col("title"))).alias("monitoring_metrics"))


def risk_overview(assessments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-07: counts and advice lines per segment."""
    high = F.col("high_risk_count")
    return assessments.groupBy(*by).agg(F.count(F.lit(1)).alias("risks_identified"), F.count_if(F.col("risk_score") > 5).alias("high_risk_count")).withColumn(
        "advice", F.when(high > 0, _lines(X.MITIGATION, high)).otherwise(F.array().cast("array<string>")))


def effort(impact: Column) -> Column:
    return F.when(impact > 8.0, F.lit("High")).when(impact > 6.0, F.lit("Medium")).otherwise(F.lit("Low"))


def prioritise(recs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-08: priority = impact x confidence, highest first; ties by id."""
    return recs.select(*by, "insight_id", "title", (F.col("impact_score") * F.col("confidence")).alias("priority_score"), "severity", "recommendations",
                       effort(F.col("impact_score")).alias("implementation_effort")).orderBy(*by, F.desc("priority_score"), "insight_id")


def implementation_plan(prioritised: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-09: places 1-3, 4-6 and the rest."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("priority_score"), "insight_id"))
    out = prioritised.withColumn("place", place)
    out = out.withColumn("phase", F.when(F.col("place") <= 3, F.lit("phase_1")).when(F.col("place") <= 6, F.lit("phase_2")).otherwise(F.lit("phase_3")))
    names = F.create_map(*[F.lit(x) for kv in X.TIMELINE.items() for x in kv])
    return out.withColumn("timeline", names[F.col("phase")])


def impact_totals(impacts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-10"""
    return impacts.groupBy(*by).agg(
        F.sum("impact_score").alias("total_impact_score"), F.avg("confidence").alias("average_confidence"),
        F.count_if(F.col("impact_score") > 7.0).alias("high_impact_insights"),
        F.format_string("%.1f%%", F.least(F.lit(30.0), F.sum("impact_score") * 2)).alias("estimated_attrition_reduction"))


def cost_benefit(prioritised: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-11: a payback without benefit is infinite."""
    cost = _lookup(X.EFFORT_COST, F.col("implementation_effort"), 15000.0)
    gain = F.col("priority_score") * 1000
    return prioritised.select(
        *by, "insight_id", "title", cost.alias("estimated_cost"), gain.alias("estimated_benefit"), ((gain - cost) / cost).alias("roi"),
        F.when(gain > 0, cost / (gain / 12)).otherwise(F.lit(float("inf"))).alias("payback_period"))


def roi_totals(cba: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-12"""
    c, b = F.sum("estimated_cost"), F.sum("estimated_benefit")
    return cba.groupBy(*by).agg(
        c.alias("total_cost"), b.alias("total_benefit"), F.when(c > 0, (b - c) / c).otherwise(F.lit(0.0)).alias("overall_roi"),
        F.count_if(F.col("roi") > 2.0).alias("high_roi_recommendations"),
        F.when(b > 0, c / (b / 12)).otherwise(F.lit(float("inf"))).alias("break_even_point"))


def by_roi(cba: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-12: rows by return, highest first; ties by id."""
    return cba.orderBy(*by, F.desc("roi"), "insight_id")


def insight_summary(insights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-13: counts by type and the summary sentence."""
    kind = F.col("insight_type")
    severe = F.col("severity").isin("high", "critical")
    c = insights.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_insights"), F.count_if(kind == "risk").alias("risks"), F.count_if(kind == "trend").alias("trends"),
        F.count_if(kind == "recommendation").alias("recommendations"), F.count_if(severe).alias("high_priority_insights"),
        F.count_if((kind == "risk") & severe).alias("_hr"))
    text = F.concat(
        F.format_string(X.SUMMARY_COUNTS, "total_insights", "risks", "trends", "recommendations"),
        F.when(F.col("risks") > 0, F.format_string(X.SUMMARY_RISKS, "_hr")).otherwise(F.lit("")),
        F.when(F.col("recommendations") > 0, F.lit(X.SUMMARY_ADVICE)).otherwise(F.lit("")))
    return c.withColumn("summary", F.when(F.col("total_insights") > 0, text).otherwise(F.lit(X.NO_INSIGHTS))).drop("_hr")


def trend_patterns(trends: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """INS-14: pattern counts and follow-up lines."""
    title, text = F.lower("title"), F.lower("description")
    return trends.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trends_identified"), F.count_if(title.contains("distribution")).alias("distribution_issues"),
        F.count_if(text.contains("quality")).alias("data_quality_concerns"), F.count_if(title.contains("skew")).alias("skewness_patterns"),
    ).withColumn("follow_up", F.when(F.col("trends_identified") > 0, _lines(X.TREND_FOLLOW_UP)).otherwise(F.array().cast("array<string>")))


def impact_follow_up(impacts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return impacts.groupBy(*by).agg(F.count(F.lit(1)).alias("impact_insights")).withColumn(
        "follow_up", F.when(F.col("impact_insights") > 0, _lines(X.IMPACT_FOLLOW_UP)).otherwise(F.array().cast("array<string>")))


def insights(results: Mapping[str, DataFrame], level: str = "comprehensive", by: Sequence[str] = ()) -> DataFrame:
    """INS-15: the insight set of a level, from the tables of `stats.analyse` (and `metrics` of ML-08)."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {tuple(LEVELS)}")
    parts: list[DataFrame] = []
    for step in LEVELS[level]:
        if step == "risk":
            if "hypothesis_testing" in results:
                parts.append(factor_risks(results["hypothesis_testing"], by))
            if "high_correlations" in results:
                parts.append(pair_risks(results["high_correlations"], by))
        elif step == "trend" and "descriptive" in results:
            parts.append(skew_trends(results["descriptive"], by))
        elif step == "recommendation" and "top_features" in results:
            parts.append(recommendations(results["top_features"], by))
        elif step == "impact" and "hypothesis_testing" in results:
            parts.append(factor_impacts(results["hypothesis_testing"], by))
        elif step == "predictive" and "metrics" in results:
            parts.append(accuracy_insight(results["metrics"], by))
    if not parts:
        raise ValueError("no analysis results for this level")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
