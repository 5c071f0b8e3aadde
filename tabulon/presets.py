"""Column names and fixed word lists of the workforce use case. Operators take them as arguments."""

# Target spellings.
POSITIVE_LABELS = ["Yes", "True", "Left"]
NEGATIVE_LABELS = ["No", "False", "Stayed"]

# Columns coerced to numbers and to categories.
NUMERIC_COLUMNS = ["age", "daily_rate", "hourly_rate", "monthly_rate", "monthly_income"]
CATEGORY_COLUMNS = ["gender", "education", "marital_status", "job_role", "department", "business_travel", "overtime"]

# Validation rules.
REQUIRED_COLUMNS = ["attrition"]
TARGET_VALUES = ["Yes", "No", "True", "False", "Left", "Stayed"]
AGE_BOUNDS = (18, 100)
RANGES = {"age": (18, 100), "performance_rating": (1, 5), "satisfaction_score": (1, 5), "relationship_satisfaction": (1, 5)}
ALLOWED = {"attrition": [0, 1], "gender": ["Male", "Female", "M", "F"]}

# Right-closed bins.
TENURE_EDGES = [0, 2, 5, 10, 20, 100]
TENURE_LABELS = ["New", "Early", "Mid", "Senior", "Veteran"]
TRAINING_EDGES = [0, 1, 3, 6, 100]
TRAINING_LABELS = ["None", "Low", "Medium", "High"]
AGE_EDGES = [20, 30, 40, 50, 70]
AGE_LABELS = ["20-30", "31-40", "41-50", "51+"]
EDUCATION_LEVELS = {"High School": 1, "Bachelor": 2, "Master": 3, "Doctorate": 4}
POLYNOMIAL_COLUMNS = ["age", "years_at_company", "monthly_income", "performance_rating"]

# Message intents, in matching order.
INTENTS = {
    "follow_up_question": ["what about", "how about", "and", "also", "what else", "tell me more"],
    "clarification_request": ["what do you mean", "can you explain", "i don't understand", "clarify"],
    "attrition_analysis": ["attrition", "turnover", "leave", "quit", "resign", "churn"],
    "policy_inquiry": ["policy", "rule", "guideline", "procedure", "handbook", "benefit"],
    "performance_metrics": ["performance", "metric", "kpi", "score", "rating", "productivity"],
    "employee_data": ["employee", "staff", "worker", "personnel", "team", "demographic"],
    "comparison_request": ["compare", "versus", "vs", "difference", "better", "worse", "higher", "lower"],
    "trend_analysis": ["trend", "over time", "history", "change", "improve", "decline", "growth"],
    "recommendation_request": ["recommend", "suggest", "advice", "what should", "how to", "strategy"],
}
DEFAULT_INTENT = "general_inquiry"

# Entity words.
DEPARTMENTS = {
    "sales": ["sales", "selling", "revenue"],
    "engineering": ["engineering", "tech", "development", "dev"],
    "marketing": ["marketing", "brand", "advertising"],
    "hr": ["hr", "human resources", "people", "talent"],
    "finance": ["finance", "accounting", "financial"],
    "it": ["it", "information technology", "systems"],
    "operations": ["operations", "ops", "operational"],
}
METRICS = {
    "attrition": ["attrition", "turnover", "churn", "retention"],
    "salary": ["salary", "compensation", "pay", "wage"],
    "satisfaction": ["satisfaction", "happiness", "morale", "engagement"],
    "performance": ["performance", "productivity", "efficiency", "output"],
    "tenure": ["tenure", "experience", "years", "longevity"],
    "age": ["age", "demographic", "generation"],
    "productivity": ["productivity", "efficiency", "output", "workload"],
}
TIME_TERMS = ["last year", "this year", "quarter", "month", "week", "recent", "trend", "annual", "monthly", "quarterly"]
COMPARISON_TERMS = ["higher", "lower", "better", "worse", "increase", "decrease", "improve", "decline", "above", "below"]
ACTION_TERMS = ["analyze", "compare", "show", "display", "calculate", "measure", "evaluate", "assess"]
QUALIFIER_TERMS = ["high", "low", "good", "bad", "excellent", "poor", "average", "above average", "below average"]
TOPICS = {"attrition": "attrition_analysis", "policy": "policy_inquiry", "performance": "performance_metrics"}
