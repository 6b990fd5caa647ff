"""State performance."""

from pyspark.sql import DataFrame, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.operators.segments import (CLTV, CONVERTED, MILLION, PREMIUM, averages, by_desc, over_all, rank_of,
                                           rate_measures, volume)


def state_vs_portfolio(df: DataFrame) -> DataFrame:
    """State measures against the pooled rate, which is summed over the state rows instead of a second scan."""
    states = df.groupBy("state").agg(
        *volume("rate_pct"), *averages(cltv="avg_cltv"), num.rnd(num.money_sum(CLTV) / MILLION).alias("total_cltv_M"),
        num.rnd(num.mean("outreach_contacts_12m")).alias("avg_outreach_contacts"),
        num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score"))
    raw = num.pct("converted", "total_households", None)
    overall = num.pct(F.sum("converted").over(over_all()), F.sum("total_households").over(over_all()))
    return (states.withColumn("_overall", overall)
            .withColumns({"unconverted": F.col("total_households") - F.col("converted"),
                          "vs_portfolio_avg_pp": num.rnd(raw - F.col("_overall")),
                          "vs_avg_status": F.when(raw >= F.col("_overall"), "Above Avg").otherwise("Below Avg")})
            .drop("_overall").orderBy(*by_desc("rate_pct", "state")))


def state_channel_rank(df: DataFrame) -> DataFrame:
    return (df.groupBy("state", "agency_channel").agg(*volume())
            .withColumn("rank_within_state", rank_of(num.ratio("converted", "total_households"), "state"))
            .orderBy("state", F.col("conversion_rate_pct").desc(), "agency_channel"))


def state_summary(df: DataFrame) -> DataFrame:
    """State measures against the unweighted mean of the states' rounded rates."""
    rate, n, hits, _ = rate_measures()
    total = num.money_sum(CLTV)
    states = df.groupBy("state").agg(
        n.alias("total"), hits, rate, num.money_mean(CLTV).alias("avg_cltv"), total.alias("total_cltv"),
        num.money_mean(PREMIUM).alias("avg_premium"), num.mean("outreach_contacts_12m").alias("avg_outreach"),
        num.mean("digital_engagement_score").alias("avg_digital"),
        num.rnd(num.ratio(num.total(CONVERTED), num.rows()) * 100.0).alias("rate_pct"),
        num.rnd(total / MILLION).alias("total_cltv_M"))
    # Rounded rates are whole hundredths: their sum over the states is exact.
    mean = num.ratio(num.scaled_sum("rate_pct", 100).over(over_all()), F.count("state").over(over_all())) / 100.0
    return (states.withColumn("_mean", mean)
            .withColumns({"unconverted": F.col("total") - F.col("converted"), "vs_avg": F.col("rate_pct") - F.col("_mean"),
                          "vs_avg_status": F.when(F.col("rate_pct") >= F.col("_mean"), "Above Avg").otherwise("Below Avg")})
            .drop("_mean").orderBy(*by_desc("rate_pct", "state")))


def state_spread(summary: DataFrame) -> DataFrame:
    """Best and worst state of ``state_summary`` and the distance between them; ties go to the first by name."""
    best = F.min(F.struct((-F.col("rate_pct")).alias("v"), "state"))
    worst = F.max(F.struct((-F.col("rate_pct")).alias("v"), "state"))
    return (summary.agg(best.alias("b"), worst.alias("w"))
            .select(F.col("b.state").alias("top_state"), (-F.col("b.v")).alias("top_rate_pct"),
                    F.col("w.state").alias("bottom_state"), (-F.col("w.v")).alias("bottom_rate_pct"),
                    num.rnd(F.col("w.v") - F.col("b.v")).alias("spread_pp")))


def state_by_cltv(summary: DataFrame) -> DataFrame:
    return summary.select("state", "total_cltv_M").orderBy(*by_desc("total_cltv_M", "state"))


def state_channel_matrix(df: DataFrame, channels: list[str] = S.CHANNELS) -> DataFrame:
    """States down, channels across, rate rounded to two decimals; empty cells are null."""
    rate = num.rnd(num.ratio(num.total(CONVERTED), num.rows()) * 100.0)
    return df.groupBy("state").pivot("agency_channel", channels).agg(rate).orderBy("state")
