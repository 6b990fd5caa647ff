"""Decile tables of a stored score or of model output."""

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from bundlelens.functions import numeric as num
from bundlelens.functions.ordering import exact_ntile
from bundlelens.operators.segments import over_all

def cumulative() -> WindowSpec:
    return Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def score_deciles(df: DataFrame, tiles: int = 10, score: str = "propensity_score", key: str = "household_id") -> DataFrame:
    """Equal-sized tiles by descending score: volume, rate, score, value, lift and cumulative gain."""
    rows = df.select(key, score, "converted_mphh", "projected_mphh_cltv")
    hits = num.total("converted_mphh")
    stats = (exact_ntile(rows, score, key, tiles, "decile").groupBy("decile").agg(
        num.rows().alias("households"), hits.alias("converted"), num.pct(hits, num.rows()).alias("conversion_rate_pct"),
        num.rnd(num.score_mean(score), 1).alias("avg_score"),
        num.rnd(num.money_sum("projected_mphh_cltv") / 1000000.0).alias("total_cltv_M")))
    all_hits = F.sum("converted").over(over_all())
    overall = num.pct(all_hits, F.sum("households").over(over_all()), None)
    return (stats.withColumns({"lift_vs_random": num.rnd(num.ratio("conversion_rate_pct", overall)),
                               "cumulative_gain_pct": num.pct(F.sum("converted").over(cumulative()), all_hits)})
            .withColumnRenamed("decile", "propensity_decile").orderBy("propensity_decile"))


def lift_table(df: DataFrame) -> DataFrame:
    """Per decile of a frame that has one: volume, rate, lift, cumulative converted and gain, unrounded."""
    hits = num.total("converted_mphh")
    stats = df.groupBy("decile").agg(num.rows().alias("households"), hits.alias("converted"))
    all_hits, all_rows = F.sum("converted").over(over_all()), F.sum("households").over(over_all())
    return (stats.withColumns({"rate": num.ratio("converted", "households"),
                               "cum_converted": F.sum("converted").over(cumulative()),
                               "_overall": num.ratio(all_hits, all_rows), "_hits": all_hits})
            .select("decile", "households", "converted", "rate", num.ratio("rate", F.col("_overall")).alias("lift"),
                    "cum_converted", (num.ratio("cum_converted", "_hits") * 100.0).alias("cum_gain_pct"))
            .orderBy("decile"))


def decile_profile(df: DataFrame, bands: tuple[int, ...] = (1, 2, 3, 10)) -> DataFrame:
    """Per band of deciles 1..k: volume, average value, most common channel and median tenure.

    Rows are counted once per (decile, channel, tenure); the overlapping bands are read off those cells.
    """
    cells = (df.groupBy("decile", "agency_channel", "tenure_months")
             .agg(num.rows().alias("n"), num.exact_sum("projected_mphh_cltv").alias("value"),
                  F.count("projected_mphh_cltv").alias("valued")))
    banded = cells.withColumn("max_decile", F.explode(F.array(*[F.lit(b) for b in bands]))).filter("decile <= max_decile")
    # A channel's rows in the band stand beside each of its cells; ties go to the first channel by name.
    channel_n = F.sum("n").over(Window.partitionBy("max_decile", "agency_channel"))
    return (banded.withColumn("channel_n", channel_n).groupBy("max_decile").agg(
                F.sum("n").alias("households"),
                num.ratio(F.sum("value"), F.sum("valued")).alias("avg_cltv"),
                F.floor(F.percentile("tenure_months", F.lit(0.5), F.col("n"))).alias("median_tenure_months"),
                F.min_by("agency_channel", F.struct(-F.col("channel_n"), "agency_channel")).alias("top_channel"))
            .orderBy("max_decile"))
