"""Schema and fixed values of the household fact and its dimensions."""

from pyspark.sql import types as T

# --- Fixed values: columns, types and order of the household fact -------------------------
HOUSEHOLD_SCHEMA = T.StructType([
    T.StructField("household_id", T.StringType()),
    T.StructField("snapshot_date", T.DateType()),
    T.StructField("state", T.StringType()),
    T.StructField("age_of_primary", T.IntegerType()),
    T.StructField("home_ownership", T.StringType()),
    T.StructField("household_size", T.IntegerType()),
    T.StructField("income_band", T.StringType()),
    T.StructField("agency_channel", T.StringType()),
    T.StructField("anchor_product", T.StringType()),
    T.StructField("policy_tier", T.StringType()),
    T.StructField("tenure_months", T.IntegerType()),
    T.StructField("outreach_contacts_12m", T.IntegerType()),
    T.StructField("claims_24m", T.IntegerType()),
    T.StructField("digital_engagement_score", T.IntegerType()),
    T.StructField("property_quote_started", T.IntegerType()),
    T.StructField("annual_premium_anchor", T.DoubleType()),
    T.StructField("projected_mphh_cltv", T.DoubleType()),
    T.StructField("propensity_score", T.DoubleType()),
    T.StructField("propensity_tier", T.StringType()),
    T.StructField("converted_mphh", T.IntegerType()),
])
BENCHMARK_SCHEMA = T.StructType(HOUSEHOLD_SCHEMA.fields + [
    T.StructField("agent_id", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("robinson_target_pct", T.DoubleType()),
])
HOUSEHOLD_COLUMNS = HOUSEHOLD_SCHEMA.names
BENCHMARK_COLUMNS = BENCHMARK_SCHEMA.names

TARGET = "converted_mphh"
LEAKAGE_COLUMNS = ["propensity_score", "propensity_tier"]
FINANCIAL_COLUMNS = ["annual_premium_anchor", "projected_mphh_cltv"]
# Columns that must never feed the model: the two above that encode the outcome, the
# forward-looking value, the identifier and the raw date.
NOT_FEATURES = ["propensity_score", "propensity_tier", "projected_mphh_cltv", "household_id", "snapshot_date"]

# --- Fixed values: domains ---------------------------------------------------------------
CHANNELS = ["Call Center", "Captive Agent", "Direct Online", "Independent Agent"]
TIERS = ["Basic", "Standard", "Plus", "Elite"]
PROPENSITY_TIERS = ["High Propensity", "Medium Propensity", "Low Propensity"]
YEARS = ["2023", "2024", "2025"]

STATE_REGION = {
    "OH": "Midwest", "MI": "Midwest", "IL": "Midwest",
    "TX": "South", "FL": "South", "GA": "South", "NC": "South",
    "CA": "West", "AZ": "West",
    "PA": "Northeast",
}

# Quarter -> target conversion rate in percent; its keys are the ordered quarter spine.
QUARTER_TARGETS = {
    "2023Q1": 25.0, "2023Q2": 25.5, "2023Q3": 26.0, "2023Q4": 26.5,
    "2024Q1": 27.0, "2024Q2": 27.5, "2024Q3": 28.0, "2024Q4": 28.5,
    "2025Q1": 29.0, "2025Q2": 29.5, "2025Q3": 30.0, "2025Q4": 30.5,
}
QUARTERS = list(QUARTER_TARGETS)

COHORT_GROUPS = {
    "2023Q1": "2023 (Early)", "2023Q2": "2023 (Early)",
    "2024Q1": "2024 (Mid)", "2024Q2": "2024 (Mid)",
    "2025Q3": "2025 (Recent)", "2025Q4": "2025 (Recent)",
}

# Half-open tenure buckets in months, and the four label styles in use.
TENURE_EDGES = [0, 6, 12, 24, 36, 60, 121]
TENURE_PLAIN = ["0-5", "6-11", "12-23", "24-35", "36-59", "60+"]
TENURE_MO = ["0-5mo", "6-11mo", "12-23mo", "24-35mo", "36-59mo", "60+mo"]
TENURE_MO_SPACED = ["0-5 mo", "6-11 mo", "12-23 mo", "24-35 mo", "36-59 mo", "60+ mo"]
TENURE_SORTABLE = ["1: 0-5 months", "2: 6-11 months", "3: 12-23 months",
                   "4: 24-35 months", "5: 36-59 months", "6: 60+ months"]

# --- Fixed values: agent pools (prefix, number of agents) per channel ----------------------
AGENT_POOLS = {
    "Independent Agent": ("IA", 200),
    "Captive Agent": ("CA", 80),
    "Call Center": ("CC", 120),
    "Direct Online": ("DO", 50),
}

# --- Fixed values: model features, ordinal codes and display labels ------------------------
NUMERIC_FEATURES = [
    "age_of_primary", "household_size", "tenure_months", "outreach_contacts_12m",
    "claims_24m", "digital_engagement_score", "property_quote_started", "annual_premium_anchor",
]
ORDINAL_CODES = {
    "agency_channel": {"Independent Agent": 3, "Direct Online": 1, "Call Center": 2, "Captive Agent": 2},
    "anchor_product": {"Auto": 4, "Motorcycle": 2, "Boat": 1, "Commercial Auto": 3},
    "policy_tier": {"Basic": 1, "Standard": 2, "Plus": 3, "Elite": 4},
    "home_ownership": {"Homeowner": 3, "Condo": 2, "Renter": 1},
    "income_band": {"<$50k": 1, "$50k-$75k": 2, "$75k-$100k": 3, "$100k-$150k": 4, "$150k+": 5},
}
FEATURES = NUMERIC_FEATURES + [f"{c}_enc" for c in ORDINAL_CODES]
FEATURE_LABELS = {
    "outreach_contacts_12m": "Outreach Contacts (12 mo)",
    "property_quote_started": "Property Quote Started",
    "digital_engagement_score": "Digital Engagement Score",
    "tenure_months": "Tenure (months)",
    "annual_premium_anchor": "Annual Anchor Premium",
    "age_of_primary": "Age of Primary",
    "claims_24m": "Claims Filed (24 mo)",
    "household_size": "Household Size",
    "agency_channel_enc": "Agency Channel",
    "policy_tier_enc": "Policy Tier",
    "anchor_product_enc": "Anchor Product",
    "home_ownership_enc": "Home Ownership",
    "income_band_enc": "Income Band",
}
