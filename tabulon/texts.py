"""The sentences of insight rows. `%s` stands for the subject of the row."""

RISK_TITLE = "High Attrition Risk: %s"
RISK_DESCRIPTION = "The factor '%s' shows statistically significant correlation with attrition, indicating a potential risk area."
RISK_EVIDENCE = ["Statistical significance confirmed for %s"]
RISK_ACTIONS = ["Investigate root causes of %s", "Implement monitoring for %s", "Develop intervention strategies for %s"]
RISK_TAGS = ["risk", "attrition", "statistical"]

PAIR_TITLE = "Strong Correlation Risk: %s and %s"
PAIR_DESCRIPTION = "Strong correlation between %s and %s may indicate redundancy or confounding factors."
PAIR_EVIDENCE = "Correlation coefficient: %.3f"
PAIR_ACTIONS = ["Investigate if both variables are necessary", "Consider feature engineering to reduce redundancy", "Monitor for multicollinearity effects"]
PAIR_TAGS = ["risk", "correlation", "multicollinearity"]

SKEW_TITLE = "Distribution Skewness: %s"
SKEW_DESCRIPTION = "The variable '%s' shows a skewed distribution (skewness: %.3f), which may indicate underlying patterns or data quality issues."
SKEW_EVIDENCE = "Skewness coefficient: %.3f"
SKEW_ACTIONS = ["Investigate causes of skewness in %s", "Consider data transformation if appropriate", "Review data collection methods for %s"]
SKEW_TAGS = ["trend", "distribution", "skewness"]

FOCUS_TITLE = "Focus on %s for Attrition Prevention"
FOCUS_DESCRIPTION = "The feature '%s' is among the top predictors of attrition. Focused interventions on this factor could significantly reduce attrition rates."
FOCUS_EVIDENCE = "Feature importance ranking: %d"
FOCUS_ACTIONS = ["Develop targeted interventions for %s", "Monitor %s trends regularly", "Train managers on %s management", "Set KPIs related to %s improvement"]
FOCUS_TAGS = ["recommendation", "feature_importance", "intervention"]

GENERAL_TITLE = "Implement Comprehensive Attrition Prevention Strategy"
GENERAL_DESCRIPTION = "Based on the analysis, implement a multi-faceted approach to reduce attrition rates."
GENERAL_EVIDENCE = ["Statistical analysis completed", "Key factors identified"]
GENERAL_ACTIONS = [
    "Establish regular employee satisfaction surveys", "Implement mentorship programs", "Review compensation and benefits",
    "Enhance career development opportunities", "Improve work-life balance policies", "Strengthen employee recognition programs",
]
GENERAL_TAGS = ["recommendation", "strategy", "comprehensive"]

IMPACT_TITLE = "Business Impact: %s"
IMPACT_DESCRIPTION = "The factor '%s' has significant impact on attrition, affecting business operations and costs."
IMPACT_EVIDENCE = ["Statistically significant impact confirmed for %s"]
IMPACT_ACTIONS = ["Quantify financial impact of %s", "Develop ROI analysis for %s interventions", "Set improvement targets for %s", "Monitor business metrics related to %s"]
IMPACT_TAGS = ["impact", "business", "financial"]

ACCURACY_TITLE = "High Prediction Accuracy Achieved"
ACCURACY_DESCRIPTION = "The attrition prediction model achieved %.1f%% accuracy, enabling proactive intervention strategies."
ACCURACY_EVIDENCE = "Model accuracy: %.1f%%"
ACCURACY_ACTIONS = ["Implement proactive attrition prevention", "Use model for early warning systems", "Develop targeted intervention programs", "Monitor prediction accuracy over time"]
ACCURACY_TAGS = ["predictive", "accuracy", "proactive"]

MITIGATION = ["Immediate attention required for %d high-risk areas", "Implement risk monitoring dashboard", "Develop contingency plans for critical risks"]
TREND_FOLLOW_UP = ["Monitor identified trends regularly", "Investigate root causes of distribution issues", "Implement data quality improvements"]
IMPACT_FOLLOW_UP = ["Prioritize high-impact factors for intervention", "Develop ROI analysis for recommended actions", "Set measurable improvement targets"]

TIMELINE = {"phase_1": "Immediate (0-3 months)", "phase_2": "Short-term (3-6 months)", "phase_3": "Long-term (6+ months)"}
EFFORT_COST = {"Low": 5000.0, "Medium": 15000.0, "High": 50000.0}
SEVERITY_WEIGHT = {"low": 1.0, "medium": 3.0, "high": 6.0, "critical": 10.0}

NO_INSIGHTS = "No insights generated."
SUMMARY_COUNTS = "Generated %d insights: %d risks, %d trends, %d recommendations. "
SUMMARY_RISKS = "High/critical risks identified: %d. "
SUMMARY_ADVICE = "Actionable recommendations provided for implementation."
