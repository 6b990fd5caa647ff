"""Quote funnel and outreach."""

from pyspark.sql import Column, DataFrame, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.operators.segments import CONVERTED, averages, rate_measures, volume, with_contact_index

STARTED = "property_quote_started"


def _quote_counts(df: DataFrame) -> DataFrame:
    """One row: households, quote starts, and the four outcomes."""
    started, won = F.col(STARTED) == 1, F.col(CONVERTED) == 1
    return df.agg(num.rows().alias("total_households"), F.count_if(started).alias("quote_started"),
                  F.count_if(started & won).alias("converted_with_quote"), F.count_if(started & ~won).alias("abandoned"),
                  F.count_if(~started & won).alias("converted_no_quote"),
                  F.count_if(~started & ~won).alias("never_started_not_converted"))


def quote_funnel(df: DataFrame) -> DataFrame:
    """Funnel counts and rates; rates without a denominator are null."""
    with_quote = num.ratio("converted_with_quote", "quote_started")
    without = num.ratio("converted_no_quote", F.col("total_households") - F.col("quote_started"))
    return _quote_counts(df).withColumns({
        "quote_start_rate_pct": num.pct("quote_started", "total_households"),
        "quote_conversion_rate_pct": num.pct("converted_with_quote", "quote_started"),
        "abandonment_rate_pct": num.pct("abandoned", "quote_started"),
        "quote_starter_lift_vs_non_starter": num.rnd(num.ratio(with_quote, without))})


def funnel_stages(df: DataFrame) -> DataFrame:
    """Three stages with their share of all households, and abandonment, quote rate and lift over the overall rate."""
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    quote_rate = or_zero(num.ratio("converted_with_quote", "quote_started"))
    overall = num.ratio(F.col("converted_with_quote") + F.col("converted_no_quote"), "total_households")
    stage = lambda i, name, n: F.struct(F.lit(i).cast("bigint").alias("stage_ord"), F.lit(name).alias("stage"), F.col(n).alias("households"))
    return (_quote_counts(df).select(
                "total_households", or_zero(num.ratio("abandoned", "quote_started")).alias("abandon_rate"),
                quote_rate.alias("quote_rate"), num.ratio(quote_rate, overall).alias("lift_vs_overall"),
                F.inline(F.array(stage(1, "All Households", "total_households"), stage(2, "Quote Started", "quote_started"),
                                 stage(3, "Converted (w/ Quote)", "converted_with_quote"))))
            .select("stage_ord", "stage", "households", (num.ratio("households", "total_households") * 100.0).alias("pct_of_all"),
                    "abandon_rate", "quote_rate", "lift_vs_overall"))


def quote_outcomes(df: DataFrame) -> DataFrame:
    """Four outcomes that exclude each other, and their shares."""
    line = lambda name, c: F.struct(F.lit(name).alias("outcome"), F.col(c).alias("households"),
                                    num.pct(c, "total_households", None).alias("share_pct"))
    return _quote_counts(df).select(F.inline(F.array(
        line("Converted (started quote)", "converted_with_quote"),
        line("Abandoned (started, not converted)", "abandoned"),
        line("Converted (no quote)", "converted_no_quote"),
        line("Never started, not converted", "never_started_not_converted"))))


def outreach_band(contacts: str = "contacts") -> Column:
    c = F.col(contacts)
    return F.when(c.between(1, 3), "Sweet Spot").when(c > 3, "Diminishing Returns").otherwise("No Outreach")


def _contacts() -> Column:
    return F.col("outreach_contacts_12m").alias("contacts")


def outreach_bands(df: DataFrame) -> DataFrame:
    groups = df.groupBy(_contacts()).agg(*volume(), num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score"),
                                         *averages(premium=None, cltv="avg_cltv"))
    return with_contact_index(groups, "contacts").withColumn("outreach_band", outreach_band()).orderBy("contacts")


def outreach_stats(df: DataFrame) -> DataFrame:
    return (df.groupBy(_contacts()).agg(*rate_measures())
            .withColumn("outreach_band", outreach_band()).orderBy("contacts"))


def _tier_order() -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in S.PROPENSITY_TIERS]), F.col("propensity_tier"))


def tier_outreach_sql(df: DataFrame) -> DataFrame:
    return df.groupBy("propensity_tier", _contacts()).agg(*volume()).orderBy(_tier_order(), "contacts")


def tier_outreach(df: DataFrame) -> DataFrame:
    """Rate per propensity tier and contact count, tiers in their fixed order."""
    return (df.filter(F.col("propensity_tier").isin(S.PROPENSITY_TIERS)).groupBy("propensity_tier", _contacts())
            .agg(rate_measures()[3]).withColumn("tier_ord", _tier_order().cast("bigint")).orderBy("tier_ord", "contacts"))
