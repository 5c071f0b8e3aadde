"""Insight tables over statistics of the workforce table, per department and for the whole table."""

from pyspark.sql import DataFrame, functions as F

from .. import texts as X
from ..operators import insights as N, ml as M, stats as S
from .quality import target01
from .statistics import _TOP, _W, corr_sql, describe_sql, ttest_sql
from .tables import WFT, rounded

QUERIES, ORACLE = {}, {}


def query(key, sql=None):
    def add(fn):
        QUERIES[key] = fn
        if sql:
            ORACLE[key] = sql
        return fn
    return add


def flat(df: DataFrame) -> DataFrame:
    """Lists as text, without the metadata map."""
    lists = {"evidence", "recommendations", "tags", "mitigation_strategies", "monitoring_metrics", "advice", "follow_up"}
    out = df.select(*[F.array_join(c, " | ").alias(c) if c in lists else F.col(c) for c in df.columns if c != "metadata"])
    return rounded(out)


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _fmt(template, *args):
    """printf in SQL; a template may name one subject several times."""
    n = template.replace("%%", "").count("%")
    if not n:
        return _q(template)
    use = list(args) * n if len(args) == 1 else list(args[:n])
    return f"printf({_q(template)}, {', '.join(use)})"


def _join(templates, *args):
    return " || ' | ' || ".join(_fmt(t, *args) for t in templates)


DEP = ["department"]
_T = WFT + ", " + ttest_sql("wf", "attrition", _W, "department") + ", sig AS (SELECT * FROM test WHERE p < 0.05)"
_RISK = f"""rk AS (SELECT department, 'risk_' || variable AS insight_id, 'risk' AS insight_type, {_fmt(X.RISK_TITLE, 'variable')} AS title, {_fmt(X.RISK_DESCRIPTION, 'variable')} AS description,
  'high' AS severity, 0.85::DOUBLE AS confidence, 8.0::DOUBLE AS impact_score, {_join(X.RISK_EVIDENCE, 'variable')} AS evidence, {_join(X.RISK_ACTIONS, 'variable')} AS recommendations, '{' | '.join(X.RISK_TAGS)}' AS tags FROM sig)"""
_IMPACT = f"""im AS (SELECT department, 'impact_' || variable AS insight_id, 'impact' AS insight_type, {_fmt(X.IMPACT_TITLE, 'variable')} AS title, {_fmt(X.IMPACT_DESCRIPTION, 'variable')} AS description,
  'high' AS severity, 0.8::DOUBLE AS confidence, 8.5::DOUBLE AS impact_score, {_join(X.IMPACT_EVIDENCE, 'variable')} AS evidence, {_join(X.IMPACT_ACTIONS, 'variable')} AS recommendations, '{' | '.join(X.IMPACT_TAGS)}' AS tags FROM sig)"""


def tests(spark, sf):
    return S.t_tests(target01(spark, sf), "attrition", _W, DEP)


@query("INS-01", f"{_T}, {_RISK} SELECT * FROM rk")
def _(spark, sf):
    return flat(N.factor_risks(tests(spark, sf), DEP))


_PAIRS = ["years_at_company", "years_in_current_role", "age"]


@query("INS-02", WFT + f""", c AS ({corr_sql('wf', _PAIRS, 'department').replace('round(', '(').replace(', 6)', ')')})
  SELECT department, 'corr_risk_' || variable1 || '_' || variable2 AS insight_id, 'risk' AS insight_type, {_fmt(X.PAIR_TITLE, 'variable1', 'variable2')} AS title, {_fmt(X.PAIR_DESCRIPTION, 'variable1', 'variable2')} AS description,
   'medium' AS severity, 0.75::DOUBLE AS confidence, 6.0::DOUBLE AS impact_score, {_fmt(X.PAIR_EVIDENCE, 'correlation')} AS evidence, {_join(X.PAIR_ACTIONS)} AS recommendations, '{' | '.join(X.PAIR_TAGS)}' AS tags
  FROM c WHERE correlation > 0.8""")
def _(spark, sf):
    return flat(N.pair_risks(S.high_correlations(S.pearson(target01(spark, sf), _PAIRS, DEP)), DEP))


_SKEWED = ["monthly_income", "attrition", "age"]
_TREND = WFT + f""", d AS ({describe_sql('wf', _SKEWED, 'department')}), tr AS (SELECT department, 'trend_' || variable AS insight_id, 'trend' AS insight_type, {_fmt(X.SKEW_TITLE, 'variable')} AS title,
   {_fmt(X.SKEW_DESCRIPTION, 'variable', 'skewness')} AS description, CASE WHEN abs(skewness) < 2 THEN 'medium' ELSE 'high' END AS severity, 0.8::DOUBLE AS confidence, 5.0::DOUBLE AS impact_score,
   {_fmt(X.SKEW_EVIDENCE, 'skewness')} AS evidence, {_join(X.SKEW_ACTIONS, 'variable')} AS recommendations, '{' | '.join(X.SKEW_TAGS)}' AS tags FROM d WHERE abs(skewness) > 1)"""


def trends(spark, sf):
    return N.skew_trends(S.describe(target01(spark, sf), _SKEWED, DEP), DEP)


@query("INS-03", f"{_TREND} SELECT * FROM tr")
def _(spark, sf):
    return flat(trends(spark, sf))


_REC = _TOP + f""", o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY best_rank, variable) AS i FROM top), rec AS (
  SELECT 'rec_' || variable AS insight_id, 'recommendation' AS insight_type, {_fmt(X.FOCUS_TITLE, 'variable')} AS title, {_fmt(X.FOCUS_DESCRIPTION, 'variable')} AS description, CASE WHEN i <= 2 THEN 'high' ELSE 'medium' END AS severity,
   0.9::DOUBLE AS confidence, (CASE WHEN i <= 2 THEN 9 ELSE 7 END)::DOUBLE AS impact_score, {_fmt(X.FOCUS_EVIDENCE, 'i')} AS evidence, {_join(X.FOCUS_ACTIONS, 'variable')} AS recommendations, '{' | '.join(X.FOCUS_TAGS)}' AS tags FROM o WHERE i <= 5
  UNION ALL SELECT 'general_rec', 'recommendation', {_q(X.GENERAL_TITLE)}, {_q(X.GENERAL_DESCRIPTION)}, 'high', 0.85, 9.0, '{' | '.join(X.GENERAL_EVIDENCE)}', '{' | '.join(X.GENERAL_ACTIONS)}', '{' | '.join(X.GENERAL_TAGS)}')"""


def recs(spark, sf):
    return N.recommendations(S.top_features(S.feature_importance(target01(spark, sf), "attrition", _W)))


@query("INS-04", f"{_REC} SELECT * FROM rec")
def _(spark, sf):
    return flat(recs(spark, sf))


@query("INS-05", f"{_T}, {_IMPACT} SELECT * FROM im")
def _(spark, sf):
    return flat(N.factor_impacts(tests(spark, sf), DEP))


@query("INS-06", WFT + f""", a AS (SELECT AVG(CASE WHEN (CASE WHEN overtime = 'Yes' AND years_at_company <= 2 THEN 1 ELSE 0 END) = attrition THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM wf)
  SELECT 'pred_accuracy' AS insight_id, 'predictive' AS insight_type, '{X.ACCURACY_TITLE}' AS title, {_fmt(X.ACCURACY_DESCRIPTION, 'accuracy * 100')} AS description, 'low' AS severity, 0.9::DOUBLE AS confidence, 7.0::DOUBLE AS impact_score,
   {_fmt(X.ACCURACY_EVIDENCE, 'accuracy * 100')} AS evidence, '{' | '.join(X.ACCURACY_ACTIONS)}' AS recommendations, '{' | '.join(X.ACCURACY_TAGS)}' AS tags FROM a WHERE accuracy > 0.8""")
def _(spark, sf):
    rule = ((F.col("overtime") == "Yes") & (F.col("years_at_company") <= 2)).cast("int")
    return flat(N.accuracy_insight(M.evaluate(target01(spark, sf).select(F.col("attrition").alias("label"), rule.alias("prediction")))))


@query("INS-07", f"""{_T}, {_RISK} SELECT department, replace(insight_id, 'risk_', 'risk_assessment_') AS risk_id, insight_type AS risk_type, description, confidence AS probability, impact_score AS impact,
   round(6 * confidence, 6) AS risk_score, recommendations AS mitigation_strategies, 'Monitor ' || title AS monitoring_metrics FROM rk""")
def _(spark, sf):
    return flat(N.risk_assessments(N.factor_risks(tests(spark, sf), DEP), DEP))


@query("INS-07-overview", f"""{_T}, {_RISK}, o AS (SELECT department, COUNT(*) AS n, COUNT(*) FILTER (6 * confidence > 5) AS h FROM rk GROUP BY department)
  SELECT department, n AS risks_identified, h AS high_risk_count, CASE WHEN h > 0 THEN {_join(X.MITIGATION, 'h')} ELSE '' END AS advice FROM o""")
def _(spark, sf):
    return flat(N.risk_overview(N.risk_assessments(N.factor_risks(tests(spark, sf), DEP), DEP), DEP))


_PRI = """pr AS (SELECT insight_id, title, impact_score * confidence AS priority_score, severity, recommendations,
  CASE WHEN impact_score > 8 THEN 'High' WHEN impact_score > 6 THEN 'Medium' ELSE 'Low' END AS implementation_effort FROM rec)"""


@query("INS-08", f"{_REC}, {_PRI} SELECT insight_id, title, round(priority_score, 6) AS priority_score, severity, recommendations, implementation_effort FROM pr")
def _(spark, sf):
    return flat(N.prioritise(recs(spark, sf)))


@query("INS-09", f"""{_REC}, {_PRI}, pl AS (SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY priority_score DESC, insight_id) AS INTEGER) AS place FROM pr)
  SELECT insight_id, place, CASE WHEN place <= 3 THEN 'phase_1' WHEN place <= 6 THEN 'phase_2' ELSE 'phase_3' END AS phase,
   CASE WHEN place <= 3 THEN '{X.TIMELINE['phase_1']}' WHEN place <= 6 THEN '{X.TIMELINE['phase_2']}' ELSE '{X.TIMELINE['phase_3']}' END AS timeline FROM pl""")
def _(spark, sf):
    return N.implementation_plan(N.prioritise(recs(spark, sf))).select("insight_id", "place", "phase", "timeline")


@query("INS-10", f"""{_T}, {_IMPACT} SELECT department, SUM(impact_score) AS total_impact_score, round(AVG(confidence), 6) AS average_confidence, COUNT(*) FILTER (impact_score > 7) AS high_impact_insights,
  printf('%.1f%%', least(30, SUM(impact_score) * 2)::DOUBLE) AS estimated_attrition_reduction FROM im GROUP BY department""")
def _(spark, sf):
    return rounded(N.impact_totals(N.factor_impacts(tests(spark, sf), DEP), DEP))


_CBA = """cb AS (SELECT insight_id, title, CASE implementation_effort WHEN 'Low' THEN 5000 WHEN 'Medium' THEN 15000 ELSE 50000 END::DOUBLE AS c, priority_score * 1000 AS b FROM pr),
  cba AS (SELECT insight_id, title, c AS estimated_cost, b AS estimated_benefit, (b - c) / c AS roi, c / (b / 12) AS payback_period FROM cb)"""


@query("INS-11", f"{_REC}, {_PRI}, {_CBA} SELECT insight_id, title, estimated_cost, round(estimated_benefit, 6) AS estimated_benefit, round(roi, 6) AS roi, round(payback_period, 6) AS payback_period FROM cba")
def _(spark, sf):
    return flat(N.cost_benefit(N.prioritise(recs(spark, sf))))


@query("INS-12", f"""{_REC}, {_PRI}, {_CBA} SELECT SUM(estimated_cost) AS total_cost, round(SUM(estimated_benefit), 6) AS total_benefit, round((SUM(estimated_benefit) - SUM(estimated_cost)) / SUM(estimated_cost), 6) AS overall_roi,
  COUNT(*) FILTER (roi > 2) AS high_roi_recommendations, round(SUM(estimated_cost) / (SUM(estimated_benefit) / 12), 6) AS break_even_point FROM cba""")
def _(spark, sf):
    return flat(N.roi_totals(N.cost_benefit(N.prioritise(recs(spark, sf)))))


def segment_results(spark, sf):
    return {"hypothesis_testing": tests(spark, sf), "descriptive": S.describe(target01(spark, sf), _SKEWED, DEP)}


@query("INS-13", f"""{_T}, {_RISK}, {_IMPACT}, {_TREND[len(WFT) + 2:]},
  al AS (SELECT department, insight_type, severity FROM rk UNION ALL SELECT department, insight_type, severity FROM im UNION ALL SELECT department, insight_type, severity FROM tr),
  c AS (SELECT department, COUNT(*) AS total_insights, COUNT(*) FILTER (insight_type = 'risk') AS risks, COUNT(*) FILTER (insight_type = 'trend') AS trends, COUNT(*) FILTER (insight_type = 'recommendation') AS recommendations,
    COUNT(*) FILTER (severity IN ('high', 'critical')) AS high_priority_insights, COUNT(*) FILTER (insight_type = 'risk' AND severity IN ('high', 'critical')) AS hr FROM al GROUP BY department)
  SELECT department, total_insights, risks, trends, recommendations, high_priority_insights,
   {_fmt(X.SUMMARY_COUNTS, 'total_insights', 'risks', 'trends', 'recommendations')} || CASE WHEN risks > 0 THEN {_fmt(X.SUMMARY_RISKS, 'hr')} ELSE '' END || CASE WHEN recommendations > 0 THEN '{X.SUMMARY_ADVICE}' ELSE '' END AS summary FROM c""")
def _(spark, sf):
    return N.insight_summary(N.insights(segment_results(spark, sf), "comprehensive", DEP), DEP)


@query("INS-14", f"""{_TREND} SELECT department, COUNT(*) AS trends_identified, COUNT(*) FILTER (lower(title) LIKE '%distribution%') AS distribution_issues, COUNT(*) FILTER (lower(description) LIKE '%quality%') AS data_quality_concerns,
   COUNT(*) FILTER (lower(title) LIKE '%skew%') AS skewness_patterns, '{' | '.join(X.TREND_FOLLOW_UP)}' AS follow_up FROM tr GROUP BY department""")
def _(spark, sf):
    return flat(N.trend_patterns(trends(spark, sf), DEP))


@query("INS-14-impact", f"{_T}, {_IMPACT} SELECT department, COUNT(*) AS impact_insights, '{' | '.join(X.IMPACT_FOLLOW_UP)}' AS follow_up FROM im GROUP BY department")
def _(spark, sf):
    return flat(N.impact_follow_up(N.factor_impacts(tests(spark, sf), DEP), DEP))


@query("INS-15", f"""{_T}, {_RISK}, {_IMPACT}, {_TREND[len(WFT) + 2:]} SELECT * FROM rk UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM im""")
def _(spark, sf):
    return flat(N.insights(segment_results(spark, sf), "comprehensive", DEP))
