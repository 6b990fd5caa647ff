"""Conversion and value of cross-sell segments: one grouped pass each, windows only over group rows."""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import add_tenure_bucket
from bundlelens import schema as S
from bundlelens.operators.filters import having_min_group, is_open

CONVERTED, CLTV, PREMIUM = "converted_mphh", "projected_mphh_cltv", "annual_premium_anchor"
MILLION = 1000000.0
def over_all() -> WindowSpec:
    """All group rows at once: for groups of a small fixed domain."""
    return Window.partitionBy()


def by_desc(*cols: str) -> list[Column]:
    """First column descending, the rest ascending to settle ties."""
    return [F.col(cols[0]).desc(), *[F.col(c) for c in cols[1:]]]


def volume(rate: str = "conversion_rate_pct", n: str = "total_households", converted: str = "converted") -> list[Column]:
    """Row count, converted count and rounded rate."""
    hits = num.total(CONVERTED)
    return [num.rows().alias(n), hits.alias(converted), num.pct(hits, num.rows()).alias(rate)]


def averages(premium: str | None = "avg_anchor_premium", cltv: str | None = "avg_mphh_cltv") -> list[Column]:
    out = []
    if premium:
        out.append(num.rnd(num.money_mean(PREMIUM)).alias(premium))
    if cltv:
        out.append(num.rnd(num.money_mean(CLTV)).alias(cltv))
    return out


def rank_of(value: Column, *partition: str, descending: bool = True) -> Column:
    """Rank over group rows, as bigint. Only for groups of a small fixed domain."""
    order = value.desc() if descending else value.asc()
    return F.rank().over(Window.partitionBy(*partition).orderBy(order)).cast("bigint")


def overview_quality(df: DataFrame) -> DataFrame:
    audited = {"household_id": "null_household_id", "agency_channel": "null_agency_channel",
               "anchor_product": "null_anchor_product", "policy_tier": "null_policy_tier",
               "tenure_months": "null_tenure_months", PREMIUM: "null_annual_premium", CLTV: "null_projected_cltv"}
    return df.agg(*volume(converted="total_converted"),
                  *[F.count_if(F.col(c).isNull()).alias(name) for c, name in audited.items()],
                  F.min("tenure_months").alias("min_tenure_months"), F.max("tenure_months").alias("max_tenure_months"),
                  num.rnd(num.mean("tenure_months"), 1).alias("avg_tenure_months"),
                  num.rnd(num.money_mean(PREMIUM)).alias("avg_annual_premium"))


def segment_distribution(df: DataFrame, limit: int = 30) -> DataFrame:
    keys = ["agency_channel", "anchor_product", "policy_tier"]
    return (df.groupBy(*keys).agg(*volume(n="household_count", converted="converted_count"))
            .withColumn("pct_of_total", num.pct("household_count", F.sum("household_count").over(over_all())))
            .orderBy(*by_desc("household_count", *keys)).limit(limit))


def _rate_ranked(df: DataFrame, key: str, extra: list[Column]) -> DataFrame:
    return (df.groupBy(key).agg(*volume(), *extra)
            .withColumn("rank_by_rate", rank_of(num.ratio("converted", "total_households")))
            .orderBy(*by_desc("conversion_rate_pct", key)))


def channel_rate(df: DataFrame) -> DataFrame:
    return _rate_ranked(df, "agency_channel", averages())


def tier_rate(df: DataFrame) -> DataFrame:
    millions = lambda c: num.rnd(num.money_sum(c) / MILLION, 3)
    return _rate_ranked(df, "policy_tier", averages(cltv=None) + [
        millions(PREMIUM).alias("total_anchor_premium_M"), millions(CLTV).alias("total_mphh_cltv_M")])


def segment_rank(df: DataFrame, min_n: int = 500, limit: int = 20) -> DataFrame:
    keys = ["agency_channel", "policy_tier", "anchor_product"]
    groups = df.groupBy(*keys).agg(*volume(n="household_count"), *averages(premium=None))
    rate = F.col("conversion_rate_pct")
    return (having_min_group(groups, min_n, "household_count")
            .withColumns({"rank_high": rank_of(rate), "rank_low": rank_of(rate, descending=False)})
            .orderBy(*by_desc("conversion_rate_pct", *keys)).limit(limit))


def channel_opportunity(df: DataFrame) -> DataFrame:
    won = F.col(CONVERTED) == 1
    # A group may be all open or all converted: its other sum is then zero, not null.
    millions = lambda cond: num.rnd(F.coalesce(num.money_sum(F.when(cond, F.col(CLTV))), F.lit(0.0)) / MILLION)
    both = F.col("realized_cltv_M") + F.col("unrealized_cltv_M")
    return (df.groupBy("agency_channel").agg(
                num.rows().alias("total_households"), F.count_if(won).alias("already_converted"),
                F.count_if(is_open()).alias("not_yet_converted"),
                millions(won).alias("realized_cltv_M"), millions(is_open()).alias("unrealized_cltv_M"),
                num.rnd(num.money_mean(F.when(is_open(), F.col(CLTV)))).alias("avg_cltv_per_unconverted"))
            .withColumn("pct_unrealized", num.rnd(num.ratio("unrealized_cltv_M", both) * 100.0, 1))
            .orderBy(*by_desc("unrealized_cltv_M", "agency_channel")))


def ownership_opportunity(df: DataFrame) -> DataFrame:
    open_value = F.when(is_open(), F.col(CLTV))
    return (df.groupBy("home_ownership").agg(
                num.rows().alias("total_households"), F.count_if(is_open()).alias("unconverted"),
                num.rnd(num.money_mean(open_value)).alias("avg_cltv_unconverted"),
                num.rnd(F.coalesce(num.money_sum(open_value), F.lit(0.0)) / MILLION).alias("total_opportunity_M"),
                num.pct(num.total(CONVERTED), num.rows()).alias("conversion_rate_pct"))
            .orderBy(*by_desc("total_opportunity_M", "home_ownership")))


def tenure_rate(df: DataFrame) -> DataFrame:
    return (add_tenure_bucket(df, "case", S.TENURE_SORTABLE).groupBy("tenure_bucket")
            .agg(*volume(), *averages()).orderBy("tenure_bucket"))


def with_contact_index(groups: DataFrame, contacts: str) -> DataFrame:
    """Index of each group's rate against the group with the fewest contacts."""
    rate = num.ratio("converted", "total_households")
    first = F.first(rate).over(Window.orderBy(contacts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return groups.withColumn("index_vs_zero_contact", num.rnd(num.ratio(
        num.pct("converted", "total_households", None), first), 1))


def outreach_index(df: DataFrame) -> DataFrame:
    key = "outreach_contacts_12m"
    groups = df.groupBy(key).agg(*volume(), num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score"),
                                 *averages(premium=None))
    return with_contact_index(groups, key).orderBy(key)


def quote_outcome(df: DataFrame) -> DataFrame:
    keys = ["property_quote_started", CONVERTED]
    return (df.groupBy(*keys).agg(num.rows().alias("household_count"), *averages(),
                                  num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score"),
                                  num.rnd(num.mean("outreach_contacts_12m")).alias("avg_outreach_contacts"))
            .withColumn("pct_of_total", num.pct("household_count", F.sum("household_count").over(over_all())))
            .orderBy(*[F.col(k).desc() for k in keys]))


# ---- dashboard forms: unrounded measures -------------------------------------------------

def rate_measures() -> list[Column]:
    hits = num.total(CONVERTED)
    rate = num.ratio(hits, num.rows())
    return [rate.alias("rate"), num.rows().alias("households"), hits.alias("converted"), (rate * 100.0).alias("rate_pct")]


def kpi_crosssell(df: DataFrame, predicate: Column) -> DataFrame:
    """Headline figures of the filtered rows and their difference to all rows, in one pass."""
    kept = F.coalesce(predicate, F.lit(False))
    hit = F.col(CONVERTED) == 1
    one = df.agg(num.count_where(kept).alias("households"), num.rows().alias("_all"),
                 num.count_where(kept & hit).alias("_won"), num.count_where(hit).alias("_all_won"),
                 num.money_mean(F.when(kept, F.col(CLTV))).alias("avg_cltv"),
                 F.coalesce(num.money_sum(F.when(kept & is_open(), F.col(CLTV))), F.lit(0.0)).alias("open_cltv"),
                 num.money_mean(F.when(kept, F.col(PREMIUM))).alias("avg_premium"))
    return (one.withColumn("rate", F.coalesce(num.ratio("_won", "households"), F.lit(0.0)))
            .select("households", "rate", (F.col("rate") - num.ratio("_all_won", "_all")).alias("rate_vs_total"),
                    num.ratio("households", "_all").alias("share_of_total"), "avg_cltv", "avg_premium", "open_cltv",
                    (F.col("households") - F.col("_won")).alias("open_households")))


def _by_tenure(df: DataFrame, labels: list[str], measures: list[Column]) -> DataFrame:
    return (add_tenure_bucket(df, "cut", labels).filter(F.col("bucket_ord").isNotNull())
            .groupBy("bucket_ord", "tenure_bucket").agg(*measures).orderBy("bucket_ord"))


def tenure_spark(df: DataFrame) -> DataFrame:
    return _by_tenure(df, S.TENURE_PLAIN, [rate_measures()[3]]).drop("bucket_ord")


def tenure_summary(df: DataFrame) -> DataFrame:
    return _by_tenure(df, S.TENURE_MO_SPACED, rate_measures()).drop("bucket_ord")


def tenure_value(df: DataFrame) -> DataFrame:
    total = num.money_sum(CLTV)
    return _by_tenure(df, S.TENURE_MO_SPACED, [rate_measures()[0], total.alias("total_cltv"),
                                              (total / MILLION).alias("total_cltv_M")]).drop("bucket_ord")


def conversion_composition(df: DataFrame) -> DataFrame:
    one = df.agg(num.count_where(F.col(CONVERTED) == 1).alias("won"), num.rows().alias("n"))
    line = lambda name, n: F.struct(F.lit(name).alias("outcome"), n.alias("households"),
                                    num.pct(n, "n", None).alias("share_pct"))
    return one.select(F.inline(F.array(line("Converted", F.col("won")),
                                       line("Single-Product Household", F.col("n") - F.col("won")))))


def _summary(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(*rate_measures()).orderBy(*by_desc("rate", key))


def channel_summary(df: DataFrame) -> DataFrame:
    return _summary(df, "agency_channel")


def tier_summary(df: DataFrame) -> DataFrame:
    return _summary(df, "policy_tier")


def outreach_summary(df: DataFrame, useful_contacts: int = 3) -> DataFrame:
    return (df.groupBy(F.col("outreach_contacts_12m").alias("contacts")).agg(*rate_measures())
            .withColumn("within_useful", F.col("contacts") <= useful_contacts).orderBy("contacts"))


def priority_matrix(df: DataFrame) -> DataFrame:
    """Channel x tier volume, rate and value, labelled tier / first word of the channel."""
    rate, n, _, pct = rate_measures()
    return (df.groupBy("agency_channel", "policy_tier").agg(n, rate, pct, num.money_mean(CLTV).alias("avg_cltv"))
            .withColumn("label", F.concat("policy_tier", F.lit(" / "), F.split("agency_channel", " ")[0]))
            .orderBy("agency_channel", "policy_tier"))


def channel_rate_value(df: DataFrame) -> DataFrame:
    return (df.groupBy("agency_channel").agg(rate_measures()[0], num.money_mean(CLTV).alias("avg_cltv"))
            .orderBy(*by_desc("rate", "agency_channel")))


def ownership_open_share(df: DataFrame) -> DataFrame:
    return (df.filter(is_open()).groupBy("home_ownership").agg(num.scaled_sum(CLTV, 100).alias("_cents"))
            .select("home_ownership", (F.col("_cents").cast("double") / 100.0).alias("open_cltv"),
                    num.pct("_cents", F.sum("_cents").over(over_all()), None).alias("share_pct"))
            .orderBy("home_ownership"))


def ownership_avg(df: DataFrame) -> DataFrame:
    return (df.groupBy("home_ownership").agg(num.money_mean(CLTV).alias("avg_cltv"))
            .orderBy(*by_desc("avg_cltv", "home_ownership")))
