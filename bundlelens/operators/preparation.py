"""Derived columns, profile and quality checks of the household fact."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import lookup


# ---- derived columns --------------------------------------------------------------------

def add_quarter_year(df: DataFrame, date_col: str = "snapshot_date") -> DataFrame:
    """Add ``quarter`` (2023Q1) and ``year`` (2023) as text."""
    d = F.col(date_col).cast("date")
    year = F.year(d).cast("string")
    return df.withColumns({"quarter": F.concat(year, F.lit("Q"), F.quarter(d).cast("string")), "year": year})


def add_region(df: DataFrame, regions: Mapping[str, str] = S.STATE_REGION) -> DataFrame:
    """Add ``region`` of the state; an unmapped or missing state is in region Other."""
    return df.withColumn("region", lookup("state", regions, "Other"))


def unmapped_states(df: DataFrame, regions: Mapping[str, str] = S.STATE_REGION) -> DataFrame:
    return df.filter(lookup("state", regions).isNull()).select("state").distinct()


def add_target(df: DataFrame, targets: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Add the quarter's target rate in percent; null for a quarter without one."""
    return df.withColumn("robinson_target_pct", lookup("quarter", targets))


def unmapped_quarters(df: DataFrame, targets: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    return df.filter(lookup("quarter", targets).isNull()).select("quarter").distinct()


def mapping_report(df: DataFrame, key: str, mapped: str, mapping: Mapping) -> DataFrame:
    """Rows per (key, mapped value) and whether the map has the key."""
    found = lookup(key, mapping).isNotNull()
    return (df.groupBy(key, mapped).agg(num.rows().alias("households"))
            .select(key, mapped, found.alias("is_mapped"), "households"))


def assign_agents(df: DataFrame, pools: Mapping[str, tuple[str, int]] = S.AGENT_POOLS,
                  key: str = "household_id") -> DataFrame:
    """Give every household one agent of its channel's pool, by a hash of its key, so reruns agree."""
    prefix = lookup("agency_channel", {c: p for c, (p, _) in pools.items()})
    size = lookup("agency_channel", {c: n for c, (_, n) in pools.items()})
    number = F.pmod(num.key_hash(key), size) + 1
    return df.withColumn("agent_id", F.concat(prefix, F.lit("-"), num.padded(number, 4)))


# Lower bounds of the propensity tiers.
HIGH_SCORE, MEDIUM_SCORE = 65, 40


def add_propensity_tier(df: DataFrame, score: str = "propensity_score") -> DataFrame:
    s = F.col(score)
    return df.withColumn("propensity_tier", F.when(s >= HIGH_SCORE, "High Propensity")
                         .when(s >= MEDIUM_SCORE, "Medium Propensity").otherwise("Low Propensity"))


# Yearly property premium range in dollars, months added to tenure, cap in years, margin.
PROPERTY_RANGE = {"Homeowner": (900, 1800), "other": (400, 900)}
EXTRA_MONTHS = (12, 60)
YEARS_CLIP = (1.0, 8.0)
MARGIN = 0.18


def add_projected_cltv(df: DataFrame, property_premium: Column | None = None, extra_months: Column | None = None) -> DataFrame:
    """Projected value: (premium + property premium) x projected years x margin.

    The yearly property premium and the months beyond today's tenure are given as columns; without them the middle of their
    range is taken.
    """
    middle = {k: sum(v) // 2 for k, v in PROPERTY_RANGE.items()}
    usual = F.when(F.col("home_ownership") == "Homeowner", middle["Homeowner"]).otherwise(middle["other"])
    prop = usual if property_premium is None else property_premium
    months = F.col("tenure_months") + (F.lit(sum(EXTRA_MONTHS) // 2) if extra_months is None else extra_months)
    years = F.least(F.greatest(months.cast("double") / 12.0, F.lit(YEARS_CLIP[0])), F.lit(YEARS_CLIP[1]))
    value = (F.col("annual_premium_anchor") + prop.cast("double")) * years * MARGIN
    return df.withColumn("projected_mphh_cltv", num.rnd(value, 2))


# Intercept and weights of the scorecard.
SCORECARD_INTERCEPT = -2.80
SCORECARD = [
    (0.65, "outreach_contacts_12m >= 1"),
    (0.45, "outreach_contacts_12m >= 2"),
    (0.90, "property_quote_started = 1"),
    (0.40, "digital_engagement_score >= 7"),
    (0.35, "home_ownership = 'Homeowner'"),
    (0.20, "tenure_months >= 24"),
    (0.30, "income_band IN ('$100k-$150k', '$150k+')"),
    (0.25, "policy_tier IN ('Plus', 'Elite')"),
    (0.30, "agency_channel = 'Independent Agent'"),
    (-0.20, "agency_channel = 'Direct Online'"),
    (-0.35, "claims_24m >= 2"),
    (0.10, "household_size >= 3"),
    (-0.15, "tenure_months < 6"),
]


def add_log_odds(df: DataFrame, intercept: float = SCORECARD_INTERCEPT) -> DataFrame:
    points = F.lit(intercept)
    for weight, rule in SCORECARD:
        points = points + F.expr(rule).cast("double") * weight
    return df.withColumn("log_odds", points)


def score_tenths(log_odds: Column) -> Column:
    """Logistic score in whole tenths of a percent, kept within 1.0 and 99.0 percent."""
    raw = F.floor(F.lit(1000.0) / (F.lit(1.0) + F.exp(-log_odds)) + 0.5)
    return F.least(F.lit(990), F.greatest(F.lit(10), raw))


def scorecard(df: DataFrame, intercept: float = SCORECARD_INTERCEPT) -> DataFrame:
    """Replace ``propensity_score`` by the scorecard's own, 1 to 99 with one decimal."""
    return (add_log_odds(df, intercept)
            .withColumn("propensity_score", score_tenths(F.col("log_odds")).cast("double") / 10.0)
            .drop("log_odds"))


# ---- profile and checks -----------------------------------------------------------------

def require_columns(df: DataFrame, required: list[str] = S.BENCHMARK_COLUMNS) -> DataFrame:
    """Return the frame unchanged, or fail naming the missing columns."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def schema_check(df: DataFrame, required: list[str] = S.BENCHMARK_COLUMNS) -> DataFrame:
    """Per required column: whether it is present, and how many rows fill it."""
    have = set(df.columns)
    filled = [(F.count(c) if c in have else F.max(F.lit(0).cast("bigint"))).alias(f"c{i}") for i, c in enumerate(required)]
    lines = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"),
                               F.col(f"c{i}").alias("filled_rows")) for i, c in enumerate(required)])
    return df.agg(*filled).select(F.inline(lines))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One metadata row: rows, conversion rate, columns, leakage and financial columns."""
    words = lambda names: F.array(*[F.lit(c) for c in names])
    return df.agg(num.rows().alias("n_rows"),
                  num.rnd(num.ratio(num.total(S.TARGET), F.count(S.TARGET)), 4).alias("conversion_rate")).select(
        F.lit(S.TARGET).alias("target_variable"), "n_rows", "conversion_rate",
        words(df.columns).alias("columns"), words(S.LEAKAGE_COLUMNS).alias("leakage_columns"),
        words(S.FINANCIAL_COLUMNS).alias("financial_columns"))


def quality_checks(df: DataFrame, low: float = 0.20, high: float = 0.35, quarters: int = 12,
                   required: list[str] = S.BENCHMARK_COLUMNS) -> DataFrame:
    """Rate within bounds, number of quarters, nulls per required column: (check, value, passed)."""
    one = df.agg(num.ratio(num.total(S.TARGET), F.count(S.TARGET)).alias("rate"),
                 F.count_distinct("quarter").cast("double").alias("quarters"),
                 *[F.count_if(F.col(c).isNull()).cast("double").alias(f"n{i}") for i, c in enumerate(required)])
    line = lambda name, value, passed: F.struct(F.lit(name).alias("check_name"), value.alias("value"),
                                                F.coalesce(passed, F.lit(False)).alias("passed"))
    rate, seen = F.col("rate"), F.col("quarters")
    lines = [line("conversion_rate", rate, (rate > low) & (rate < high)), line("quarters", seen, seen == quarters)]
    lines += [line(f"nulls_{c}", F.col(f"n{i}"), F.col(f"n{i}") == 0) for i, c in enumerate(required)]
    return one.select(F.inline(F.array(*lines)))


def value_counts(df: DataFrame, column: str = "quarter") -> DataFrame:
    return df.groupBy(column).agg(num.rows().alias("households")).orderBy(column)


def agents_per_channel(df: DataFrame) -> DataFrame:
    """Distinct agents of each channel, and of all channels together."""
    pairs = df.select("agency_channel", "agent_id").distinct()
    return (pairs.rollup("agency_channel").agg(F.count_distinct("agent_id").alias("agents"),
                                               F.grouping("agency_channel").alias("g"))
            .select(F.when(F.col("g") == 1, "All").otherwise(F.col("agency_channel")).alias("agency_channel"), "agents"))


FILTER_COLUMNS = ["agency_channel", "anchor_product", "policy_tier", "home_ownership", "region", "state", "year"]


def filter_domains(df: DataFrame, columns: list[str] = FILTER_COLUMNS, ranged: str = "tenure_months", max_values: int = 1000) -> DataFrame:
    """Choices offered by each filter: sorted distinct values, and the least and greatest tenure.

    Rows (filter_column, position, value). Values are grouped per column before they are put in order. A column with more than
    ``max_values`` of them is no filter of coded values and is an error that names it; no task sorts more than that.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("filter_column"), F.col(c).cast("string").alias("value")) for c in columns])
    seen = df.select(F.inline(pairs)).filter("value is not null").groupBy("filter_column", "value").agg(F.lit(1).alias("_one"))
    place = F.row_number().over(Window.partitionBy("filter_column").orderBy("value"))
    too_many = F.raise_error(F.concat(F.col("filter_column"), F.lit(f" has more than {max_values} values")))
    listed = (seen.withColumn("_place", place).filter(F.col("_place") <= max_values + 1)
              .select("filter_column", F.when(F.col("_place") > max_values, too_many).otherwise(F.col("_place") - 1).cast("bigint").alias("position"), "value"))
    ends = (df.agg(F.array(F.min(ranged), F.max(ranged)).cast("array<string>").alias("ends"))
            .select(F.lit(ranged).alias("filter_column"), F.posexplode("ends").alias("position", "value")).withColumn("position", F.col("position").cast("bigint")))
    return listed.unionByName(ends)
