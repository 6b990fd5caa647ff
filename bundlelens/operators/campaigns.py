"""Who to contact, and what a campaign would return."""

from pyspark.sql import DataFrame, functions as F

from bundlelens.functions import numeric as num
from bundlelens.functions.ordering import top_n_per_group
from bundlelens.operators.filters import is_open

LIST_COLUMNS = ["household_id", "snapshot_date", "state", "agency_channel", "anchor_product", "policy_tier",
                "tenure_months", "home_ownership", "income_band", "outreach_contacts_12m", "property_quote_started",
                "digital_engagement_score", "annual_premium_anchor", "projected_mphh_cltv", "propensity_score",
                "propensity_tier"]


def add_intervention_segment(df: DataFrame) -> DataFrame:
    score, contacts = F.col("propensity_score"), F.col("outreach_contacts_12m")
    return df.withColumn("intervention_segment",
                         F.when((F.col("property_quote_started") == 1) & is_open(), "Warm Lead: Quote Abandoned")
                         .when((score >= 65) & (contacts == 0), "Warm Lead: High Score, No Outreach")
                         .when((score >= 50) & contacts.between(1, 3), "Active Nurture")
                         .when((F.col("home_ownership") == "Homeowner") & (score >= 55), "Property Target: Homeowner")
                         .otherwise("Standard Pipeline"))


def campaign_list(df: DataFrame, min_score: float = 40, max_claims: int = 1, per_channel: int = 500) -> DataFrame:
    """Open households worth contacting: the best of each channel by score, then value, then key."""
    candidates = df.filter(is_open() & (F.col("propensity_score") >= min_score) & (F.col("claims_24m") <= max_claims))
    order = [F.col("propensity_score").desc(), F.col("projected_mphh_cltv").desc(), F.col("household_id")]
    best = top_n_per_group(add_intervention_segment(candidates).select(*LIST_COLUMNS, "intervention_segment"),
                           ["agency_channel"], order, per_channel, "rank_within_channel")
    return best.orderBy("agency_channel", "rank_within_channel")


def opportunity_summary(df: DataFrame) -> DataFrame:
    """Open households and their value; the average value is over all rows given."""
    cltv = F.col("projected_mphh_cltv")
    return df.agg(num.count_where(is_open()).alias("open_households"),
                  F.coalesce(num.money_sum(F.when(is_open(), cltv)), F.lit(0.0)).alias("open_cltv"),
                  num.money_mean(cltv).alias("avg_cltv"))


def campaign_case(df: DataFrame, save_rate: float = 0.15, unit_cost: float = 35) -> DataFrame:
    """One campaign: whole households saved, gross value, cost, net and return (0 when it costs nothing)."""
    n = F.col("open_households").cast("double")
    return (opportunity_summary(df)
            .withColumns({"saved_households": F.floor(n * float(save_rate)), "total_cost": n * float(unit_cost)})
            .withColumn("gross_revenue", F.col("saved_households").cast("double") * F.col("avg_cltv"))
            .withColumns({"net_revenue": F.col("gross_revenue") - F.col("total_cost"),
                          "roi": F.coalesce(num.ratio("gross_revenue", "total_cost"), F.lit(0.0))})
            .select("open_households", "saved_households", "gross_revenue", "total_cost", "net_revenue", "roi"))


def campaign_grid(df: DataFrame, save_rates: tuple[int, ...] = (5, 10, 15, 20, 25, 30), selected: int = 15,
                  unit_costs: tuple[float, ...] = (35,)) -> DataFrame:
    """Net revenue in millions for every save rate (percent) and unit cost, without truncating households."""
    cases = F.array(*[F.struct(F.lit(r).alias("save_rate_pct"), F.lit(float(c)).alias("unit_cost"))
                      for c in unit_costs for r in save_rates])
    n, rate = F.col("open_households").cast("double"), F.col("save_rate_pct")
    net = n * (rate / 100.0) * F.col("avg_cltv") - n * F.col("unit_cost")
    return (opportunity_summary(df).select("open_households", "avg_cltv", F.inline(cases))
            .select("save_rate_pct", "unit_cost", (net / 1000000.0).alias("net_revenue_M"),
                    F.when(rate == selected, "selected").when(rate < selected, "below").otherwise("above").alias("scenario"))
            .orderBy("unit_cost", "save_rate_pct"))
