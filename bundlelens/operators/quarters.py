"""Quarters against target, against earlier years, and by tenure cohort."""

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from bundlelens import schema as S
from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import add_tenure_bucket, lookup, quarter_spine
from bundlelens.operators.segments import (CLTV, CONVERTED, MILLION, PREMIUM, averages, by_desc, over_all, rank_of,
                                           rate_measures, volume)

TARGET_PCT = "robinson_target_pct"


def _trend(later: Column, earlier: Column) -> Column:
    return F.when(later > earlier, "Improved").when(later < earlier, "Declined").otherwise("Flat")


# ---- against target ---------------------------------------------------------------------

def quarter_vs_target(df: DataFrame) -> DataFrame:
    rate = num.pct(num.total(CONVERTED), num.rows(), None)
    target = F.min(TARGET_PCT)
    return (df.groupBy("quarter").agg(
                *volume("actual_rate_pct"), target.alias("target_pct"), num.rnd(rate - target).alias("vs_target_pp"),
                F.when(rate >= target, "On Track").otherwise("Behind").alias("status"),
                *averages("avg_premium", "avg_cltv"), num.rnd(num.money_sum(CLTV) / MILLION).alias("total_cltv_M"))
            .orderBy("quarter"))


def target_gap_summary(df: DataFrame) -> DataFrame:
    """Quarters behind and on track by their rounded rates, and the mean, worst and best gap."""
    perf = df.groupBy("quarter").agg(num.pct(num.total(CONVERTED), num.rows()).alias("rate"),
                                     F.min(TARGET_PCT).alias("target"))
    gap = (F.col("rate") - F.col("target")).cast("decimal(28,9)")
    mean_gap = num.ratio(F.sum(gap), F.count("target"))
    return perf.agg(num.rows().alias("total_quarters"),
                    F.count_if(F.col("rate") < F.col("target")).alias("quarters_behind"),
                    F.count_if(F.col("rate") >= F.col("target")).alias("quarters_on_track"),
                    num.rnd(mean_gap).alias("avg_gap_pp"),
                    F.min(gap).cast("double").alias("worst_gap_pp"),
                    F.max(gap).cast("double").alias("best_gap_pp"))


def channel_contribution(df: DataFrame) -> DataFrame:
    return (df.groupBy("quarter", "agency_channel").agg(*volume("channel_rate_pct"))
            .withColumn("pct_of_quarter_conversions",
                        num.pct("converted", F.sum("converted").over(Window.partitionBy("quarter")), 1))
            .orderBy("quarter", F.col("converted").desc(), "agency_channel"))


def quarter_summary(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Measures per quarter of the spine; a quarter without rows is kept as nulls, one outside is dropped."""
    rate, n, hits, rate_pct = rate_measures()
    measures = df.groupBy("quarter").agg(n.alias("total"), hits, rate, rate_pct, num.money_mean(CLTV).alias("avg_cltv"),
                                         num.money_sum(CLTV).alias("total_cltv"), num.money_mean(PREMIUM).alias("avg_premium"))
    gap = F.col("rate_pct") - F.col("target_pct")
    return (quarter_spine(df.sparkSession, spine).join(measures, "quarter", "left")
            .withColumn("target_pct", F.when(F.col("total").isNotNull(), F.col("target_pct")))
            .withColumns({"vs_target": gap, "status": F.when(gap >= 0, "On Track").when(gap < 0, "Behind")})
            .orderBy("quarter"))


def kpi_benchmark(df: DataFrame, predicate: Column, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Latest quarter of all rows against its target and a year before; rate and open value of the filtered rows."""
    quarters = list(spine)
    current, previous = quarters[-1], quarters[-2]
    a_year_before = f"{int(current[:4]) - 1}{current[4:]}"
    kept, hit = F.coalesce(predicate, F.lit(False)), F.col(CONVERTED) == 1

    def rate_of(quarter: str) -> Column:
        inside = F.col("quarter") == quarter
        return F.coalesce(num.ratio(F.count_if(inside & hit), F.count_if(inside)) * 100.0, F.lit(0.0))

    one = df.agg(rate_of(current).alias("current_rate_pct"), rate_of(previous).alias("previous_rate_pct"),
                 rate_of(a_year_before).alias("_before"),
                 num.count_where(kept).alias("filtered_households"), num.count_where(kept & hit).alias("filtered_converted"),
                 F.coalesce(num.money_sum(F.when(kept & ~hit, F.col(CLTV))), F.lit(0.0)).alias("open_cltv"))
    rate = F.col("current_rate_pct")
    return one.select(
        F.lit(current).alias("current_quarter"), "current_rate_pct", "previous_rate_pct",
        F.lit(float(spine[current])).alias("current_target_pct"), (rate - float(spine[current])).alias("vs_target"),
        "filtered_households", "filtered_converted",
        F.coalesce(num.ratio("filtered_converted", "filtered_households") * 100.0, F.lit(0.0)).alias("filtered_rate_pct"),
        "open_cltv", (rate - F.col("_before")).alias("yoy_delta"))


def tracker_status(summary: DataFrame) -> DataFrame:
    """From ``quarter_summary``: quarters behind, on track and tracked, and the latest quarter that has a rate."""
    seen = F.col("rate_pct").isNotNull()
    latest = F.max_by(F.struct("quarter", "rate_pct", "target_pct", "vs_target"), F.when(seen, F.col("quarter")))
    return (summary.agg(F.count_if(F.col("status") == "Behind").alias("quarters_behind"),
                        F.count_if(F.col("status") == "On Track").alias("quarters_on_track"),
                        F.count_if(seen).alias("quarters_tracked"), latest.alias("latest"))
            .select("quarters_behind", "quarters_on_track", "quarters_tracked", F.col("latest.quarter").alias("latest_quarter"),
                    F.col("latest.rate_pct").alias("latest_rate_pct"), F.col("latest.target_pct").alias("latest_target_pct"),
                    F.col("latest.vs_target").alias("latest_gap")))


def channel_quarter_grid(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Conversions of every channel seen in every quarter of the spine; missing cells are zero."""
    in_quarter = [F.sum(F.when(F.col("quarter") == q, F.col(CONVERTED)).cast("bigint")).alias(q) for q in spine]
    cells = F.array(*[F.struct(F.lit(q).alias("quarter"), F.coalesce(q, F.lit(0)).alias("converted")) for q in spine])
    return (df.groupBy("agency_channel").agg(*in_quarter).select("agency_channel", F.inline(cells))
            .select("quarter", "agency_channel", "converted").orderBy("quarter", "agency_channel"))


# ---- against earlier years --------------------------------------------------------------

def _pairs(years: Sequence[str]) -> dict[str, tuple[str, str]]:
    """Each year with the next, by the name that its columns carry (23_24)."""
    if len(years) < 2:
        raise ValueError("a comparison takes two years or more")
    return {f"{a[-2:]}_{b[-2:]}": (f"rate_{a}", f"rate_{b}") for a, b in zip(years, years[1:])}


def _rates_by_year(df: DataFrame, key: Column, name: str, years: Sequence[str]) -> DataFrame:
    """One row per key, with a rate in the first two years, and a rounded rate column per year, in one grouped pass.

    Rows of other years are left out before it, so their folders are not read.
    """
    hits, pairs = num.total(CONVERTED), _pairs(years)
    rated = (df.filter(_quarter_year().isin(list(years))).groupBy(key.alias(name), _quarter_year().alias("_year"))
             .agg(num.pct(hits, num.rows()).alias("rate")).groupBy(name).pivot("_year", list(years)).agg(F.max("rate"))
             .select(name, *[F.col(y).alias(f"rate_{y}") for y in years])
             .filter(F.col(f"rate_{years[0]}").isNotNull() & F.col(f"rate_{years[1]}").isNotNull()))
    return rated.withColumns({f"delta_{p}_pp": num.rnd(F.col(b) - F.col(a)) for p, (a, b) in pairs.items()}
                             | {f"direction_{p}": _trend(F.col(b), F.col(a)) for p, (a, b) in pairs.items()})


def _quarter_year() -> Column:
    return F.substring("quarter", 1, 4)


def yoy_quarter(df: DataFrame, years: Sequence[str] = S.YEARS) -> DataFrame:
    return _rates_by_year(df, F.substring("quarter", -2, 2), "quarter_label", years).orderBy("quarter_label")


def yoy_channel(df: DataFrame, years: Sequence[str] = S.YEARS) -> DataFrame:
    *earlier, last = _pairs(years)
    return (_rates_by_year(df, F.col("agency_channel"), "agency_channel", years).drop(*[f"direction_{p}" for p in earlier])
            .orderBy(F.col(f"delta_{last}_pp").desc_nulls_last(), "agency_channel"))


def yoy_cltv(df: DataFrame, years: Sequence[str] = S.YEARS) -> DataFrame:
    """Value per year; rows of years not given are one group without a year."""
    year = F.when(_quarter_year().isin(list(years)), _quarter_year())
    return (df.groupBy(year.alias("year")).agg(num.rows().alias("total_households"), *averages(cltv="avg_cltv"),
                                               num.rnd(num.money_sum(CLTV) / MILLION).alias("total_cltv_M"))
            .orderBy("year"))


def yoy_table(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS, years: Sequence[str] = S.YEARS) -> DataFrame:
    """Q1..Q4 rates of the years and their differences; a missing quarter stays null."""
    rate_in = lambda y: F.max(F.when(_quarter_year() == y, F.col("rate_pct"))).alias(f"rate_{y}")
    return (quarter_summary(df, spine).groupBy(F.substring("quarter", -2, 2).alias("label")).agg(*[rate_in(y) for y in years])
            .withColumns({f"delta_{p}": F.col(b) - F.col(a) for p, (a, b) in _pairs(years).items()})
            .orderBy("label"))


def yoy_summary(table: DataFrame, years: Sequence[str] = S.YEARS) -> DataFrame:
    """From ``yoy_table``: mean difference, quarters compared and quarters improved, per pair of years."""
    pairs = [F.struct(F.lit(f"{a[5:]}-{b[5:]}").alias("years"), F.col(f"delta_{p}").alias("delta")) for p, (a, b) in _pairs(years).items()]
    return (table.select(F.inline(F.array(*pairs)))
            .groupBy("years").agg(num.rnd(F.coalesce(F.avg("delta"), F.lit(0.0)), 6).alias("avg_delta_pp"),
                                  F.count("delta").alias("quarters_compared"),
                                  F.count_if(F.col("delta") > 0).alias("quarters_improved"))
            .orderBy("years"))


def channel_year_pivot(df: DataFrame, years: Sequence[str] = S.YEARS) -> DataFrame:
    """Channel rates by year, unrounded, sorted by the latest pair of years whose later year any channel has."""
    pairs = _pairs(years)
    seen = lambda p: F.max(pairs[p][1]).over(over_all()).isNotNull()
    # A struct keeps a channel's missing difference from falling through to an earlier pair.
    sort_delta = F.coalesce(*[F.when(seen(p), F.struct(F.col(f"delta_{p}").alias("d"))) for p in reversed(list(pairs))])["d"]
    return (df.filter(F.col("year").isin(list(years))).groupBy("agency_channel").pivot("year", list(years))
            .agg(num.ratio(num.total(CONVERTED), num.rows()) * 100.0)
            .select("agency_channel", *[F.col(y).alias(f"rate_{y}") for y in years])
            .withColumns({f"delta_{p}": F.col(b) - F.col(a) for p, (a, b) in pairs.items()})
            .withColumn("sort_delta", sort_delta)
            .orderBy(F.col("sort_delta").desc_nulls_last(), "agency_channel"))


def cltv_year(df: DataFrame) -> DataFrame:
    total = num.money_sum(CLTV)
    return (df.groupBy("year").agg(num.money_mean(CLTV).alias("avg_cltv"), total.alias("total_cltv"),
                                   (total / MILLION).alias("total_cltv_M")).orderBy("year"))


# ---- tenure cohorts ---------------------------------------------------------------------

def cohort_tenure(df: DataFrame) -> DataFrame:
    return (add_tenure_bucket(df, "case").groupBy(F.col("quarter").alias("acquisition_quarter"), "tenure_bucket")
            .agg(*volume()).orderBy("acquisition_quarter", "tenure_bucket"))


def tenure_pooled_rank(df: DataFrame) -> DataFrame:
    return (add_tenure_bucket(df, "case").groupBy("tenure_bucket").agg(*volume("avg_conversion_rate_pct"))
            .withColumn("rank_by_rate", rank_of(num.ratio("converted", "total_households")))
            .orderBy(*by_desc("avg_conversion_rate_pct", "tenure_bucket")))


def long_tenure_trend(df: DataFrame, min_tenure: int = 60) -> DataFrame:
    return (df.filter(F.col("tenure_months") >= min_tenure).groupBy(F.col("quarter").alias("acquisition_quarter"))
            .agg(*volume(n="households_60plus_months")).orderBy("acquisition_quarter"))


def cohort_groups_pooled(df: DataFrame, cohort_groups: Mapping[str, str] = S.COHORT_GROUPS) -> DataFrame:
    grouped = df.filter(F.col("quarter").isin(list(cohort_groups))).withColumn("cohort_group", lookup("quarter", cohort_groups))
    return (add_tenure_bucket(grouped, "case").groupBy("tenure_bucket", "cohort_group").agg(*volume())
            .orderBy("tenure_bucket", "cohort_group"))


def _cohort_cells(df: DataFrame, quarters: Iterable[str]) -> DataFrame:
    """Rate per given quarter and half-open tenure bucket: the cells of the cohort matrix."""
    return (add_tenure_bucket(df.filter(F.col("quarter").isin(list(quarters))), "cut").filter(F.col("bucket_ord").isNotNull())
            .groupBy("quarter", "bucket_ord", "tenure_bucket")
            .agg((num.ratio(num.total(CONVERTED), num.rows()) * 100.0).alias("rate_pct")))


def cohort_matrix(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Quarters of the spine down, tenure buckets across; empty cells are null."""
    wide = _cohort_cells(df, spine).groupBy("quarter").pivot("tenure_bucket", S.TENURE_MO).agg(F.max("rate_pct"))
    return quarter_spine(df.sparkSession, spine).select("quarter").join(wide, "quarter", "left").orderBy("quarter")


def tenure_mean_of_quarters(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Unweighted mean of the quarter rates per bucket, and which bucket is best."""
    return (_cohort_cells(df, spine).groupBy("bucket_ord", "tenure_bucket").agg(num.rnd(F.avg("rate_pct"), 6).alias("avg_rate_pct"))
            .withColumn("is_best", F.col("avg_rate_pct") == F.max("avg_rate_pct").over(over_all()))
            .orderBy("bucket_ord").drop("bucket_ord"))


def cohort_groups_mean(df: DataFrame, cohort_groups: Mapping[str, str] = S.COHORT_GROUPS) -> DataFrame:
    """Unweighted mean of quarter rates per bucket for the given groups of quarters."""
    cells = _cohort_cells(df, cohort_groups)
    return (cells.groupBy(lookup("quarter", cohort_groups).alias("cohort"), "bucket_ord", "tenure_bucket")
            .agg(num.rnd(F.avg("rate_pct"), 6).alias("rate_pct")).orderBy("cohort", "bucket_ord").drop("bucket_ord"))


# ---- leading indicators -----------------------------------------------------------------

def leading_indicators_sql(df: DataFrame) -> DataFrame:
    return (df.groupBy("quarter").agg(
                num.rows().alias("total_households"),
                num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score"),
                num.rnd(num.score_mean("propensity_score")).alias("avg_propensity_score"),
                num.rnd(num.mean("outreach_contacts_12m")).alias("avg_outreach_contacts"),
                num.pct(num.total(CONVERTED), num.rows()).alias("actual_conversion_rate_pct"),
                F.min(TARGET_PCT).alias(TARGET_PCT))
            .orderBy("quarter"))


def leading_indicators(df: DataFrame, spine: Mapping[str, float] = S.QUARTER_TARGETS) -> DataFrame:
    """Means per quarter of the spine; a quarter without rows is kept as nulls."""
    means = df.groupBy("quarter").agg(num.mean("digital_engagement_score").alias("avg_digital"),
                                      num.score_mean("propensity_score").alias("avg_propensity"),
                                      num.mean("outreach_contacts_12m").alias("avg_outreach"))
    return quarter_spine(df.sparkSession, spine).select("quarter").join(means, "quarter", "left").orderBy("quarter")
