"""The dataset contract: column names, roles, domains and thresholds.

Everything in this module is data, not logic. The values below are fixed: they define the raw
customer-snapshot layout and must stay exactly as written for results to match.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (raw layout, clean names, domains, thresholds) -- keep verbatim.
# ---------------------------------------------------------------------------------------------

RAW_TO_CLEAN: dict[str, str] = {
    "customerID": "customer_id",
    "gender": "gender",
    "SeniorCitizen": "senior_citizen",
    "Partner": "partner",
    "Dependents": "dependents",
    "tenure": "tenure_months",
    "PhoneService": "phone_service",
    "MultipleLines": "multiple_lines",
    "InternetService": "internet_service",
    "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "TechSupport": "tech_support",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
    "Contract": "contract",
    "PaperlessBilling": "paperless_billing",
    "PaymentMethod": "payment_method",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "Churn": "churn",
}
RAW_ID = "customerID"
RAW_TARGET = "Churn"
POSITIVE_LABEL = "Yes"
NEGATIVE_LABEL = "No"

YES_NO = ("No", "Yes")
INTERNET_ADDONS_RAW = (
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
)
CATEGORICAL_DOMAINS: dict[str, tuple[str, ...]] = {
    "gender": ("Female", "Male"),
    "Partner": YES_NO,
    "Dependents": YES_NO,
    "PhoneService": YES_NO,
    "MultipleLines": ("No", "No phone service", "Yes"),
    "InternetService": ("DSL", "Fiber optic", "No"),
    "OnlineSecurity": ("No", "No internet service", "Yes"),
    "OnlineBackup": ("No", "No internet service", "Yes"),
    "DeviceProtection": ("No", "No internet service", "Yes"),
    "TechSupport": ("No", "No internet service", "Yes"),
    "StreamingTV": ("No", "No internet service", "Yes"),
    "StreamingMovies": ("No", "No internet service", "Yes"),
    "Contract": ("Month-to-month", "One year", "Two year"),
    "PaperlessBilling": YES_NO,
    "PaymentMethod": ("Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"),
}
CONTRACT_TERM_MONTHS = {"Month-to-month": 1, "One year": 12, "Two year": 24}

ID_PATTERN = r"^\d{4}-[A-Z]{5}$"
TENURE_MAX_PLAUSIBLE_MONTHS = 120
TOTAL_CHARGES_REL_DEV_WARN = 1.0
TOTAL_CHARGES_REL_DEV_TIGHT = 0.02

RISK_BAND_CUTOFFS = {"MEDIUM": 0.25, "HIGH": 0.50}
BAND_ORDER = ("LOW", "MEDIUM", "HIGH")
ASSUMED_VALUE_MONTHS = 12
SEED = 42
SCORE_DECIMALS = 6

PROTECTED_ATTRIBUTES = ("gender", "senior_citizen")
SENSITIVE_ADJACENT = ("partner", "dependents")
AUDIT_ATTRIBUTES = ("gender", "senior_citizen", "partner", "dependents")
MIN_GROUP_SIZE = 30
MIN_CLASS_COUNT = 5

EVIDENCE_TYPE = "MODEL_SIGNAL"
CAVEAT = "Model signal (a pattern in this dataset), not a proven cause."
PROVENANCE_LABEL = "PUBLIC"

# ---------------------------------------------------------------------------------------------
# Derived (computed from the fixed values above)
# ---------------------------------------------------------------------------------------------

RAW_COLUMNS = tuple(RAW_TO_CLEAN)
CLEAN_ID = RAW_TO_CLEAN[RAW_ID]
TARGET = RAW_TO_CLEAN[RAW_TARGET]
ADDON_COLUMNS = tuple(RAW_TO_CLEAN[c] for c in INTERNET_ADDONS_RAW)
YES_NO_BINARY = ("partner", "dependents", "phone_service", "paperless_billing", "multiple_lines", *ADDON_COLUMNS)
AUDIT_COLUMNS = ("total_charges_was_blank", "duplicate_group_id", "duplicate_group_size", "contract_term_exceeds_tenure")
CLEAN_COLUMNS = (*RAW_TO_CLEAN.values(), *AUDIT_COLUMNS)
