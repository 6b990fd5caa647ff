"""What the physical plans must show: pushdown, pruning, shared exchanges, early limits, no whole-table sort."""

import re
from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from bundlelens.functions.ordering import _range_of, count_before, exact_ntile, quantile_deciles
from bundlelens.operators import agents, campaigns, deciles, filters, propensity, quarters, segments, states
from bundlelens.sources.households import order_households, stored_households
from conftest import SF001


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def finished(df) -> str:
    df.collect()
    return planned(df).split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def fact(spark):
    return stored_households(spark, SF001)


def test_filters_reach_the_scan(fact):
    plan = planned(filters.filter_benchmark(fact, channels=["Call Center"], states=["OH", "TX"]))
    assert "EqualTo(agency_channel,Call Center)" in plan and "In(state, [OH,TX])" in plan
    plan = planned(campaigns.campaign_list(fact))
    assert "EqualTo(converted_mphh,0)" in plan and "GreaterThanOrEqual(propensity_score,40.0)" in plan


def test_scan_reads_only_the_columns_used(fact):
    plan = planned(segments.channel_rate(fact))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan) == [
        "agency_channel:string,annual_premium_anchor:double,projected_mphh_cltv:double,converted_mphh:int"]


def test_cohort_quarters_prune_folders(fact):
    assert "PartitionFilters: [quarter" in planned(quarters.cohort_groups_mean(fact))


def test_two_sided_reports_still_scan_once(fact):
    rows = quantile_deciles(fact, "propensity_score")
    for df in (quarters.channel_quarter_grid(fact), states.state_vs_portfolio(fact), quarters.yoy_channel(fact)):
        assert planned(df).count("FileScan") == 1
    # The edges read the score alone.
    for df in (deciles.decile_profile(rows), deciles.lift_table(rows)):
        scans = [x for x in planned(df).splitlines() if "FileScan" in x]
        assert sum("ReadSchema: struct<propensity_score:double>" not in x for x in scans) == 1


def test_one_scan_and_one_small_shuffle_per_grouped_report(fact):
    plan = planned(quarters.quarter_vs_target(fact))
    assert plan.count("FileScan") == 1 and "partial_sum" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_top_rows_are_limited_before_each_shuffle(fact):
    plan = planned(campaigns.campaign_list(fact))
    assert plan.count("WindowGroupLimit") >= 3 and ", Partial" in plan


def test_counting_before_shares_its_groups(fact):
    plan = finished(count_before(fact.select("propensity_score"), "propensity_score", descending=True))
    assert "ReusedExchange" in plan
    # The only single-task step runs over the ranges' sums.
    assert plan.count("SinglePartition") == 1 and plan.index("_range") < plan.index("SinglePartition")


def started(spark, make):
    """What ``make`` returns, and the number of jobs that ran meanwhile."""
    spark.sparkContext.setJobGroup(group := f"lazy-{uuid4().hex}", "")
    try:
        made = make()
        return made, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_orderings_start_no_job(spark, fact):
    rows = fact.select("household_id", "propensity_score")
    for make in (lambda: exact_ntile(rows, "propensity_score", "household_id"), lambda: quantile_deciles(rows, "propensity_score"),
                 lambda: deciles.score_deciles(fact), lambda: agents.agent_leaderboard(fact, 5), lambda: agents.agent_leaderboard_sql(fact, 5),
                 lambda: agents.agent_gap_sql(fact, 5), lambda: propensity.model_auc(fact, "propensity_score")):
        df, jobs = started(spark, make)
        assert jobs == 0
        assert started(spark, df.collect)[1] > 0


def test_a_leaderboard_groups_the_households_once(fact):
    plan = finished(agents.agent_leaderboard(fact, 5))
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


@pytest.mark.parametrize("low, high", [(0.0, 1.0), (0.4, 0.6), (1e-7, 1e-6), (-3.0, 5e6)])
def test_a_continuous_score_spreads(spark, low, high):
    """No range holds more than a task's fair share of the distinct values."""
    n, width = 200_000, 200
    values = spark.range(n).select((F.lit(low) + F.rand(3) * (high - low)).alias("s"))
    sizes = [r["count"] for r in values.groupBy(_range_of(F.col("s")).alias("r")).count().collect()]
    assert len(sizes) > 5 * width and max(sizes) <= n / width


def test_line_counts_are_combined_before_the_shuffle(spark):
    plan = planned(order_households(spark, SF001).select("outreach_contacts_12m"))
    assert plan.count("partial_count") >= 1 and "ReadSchema: struct<l_orderkey:bigint>" in plan


def test_a_hot_customer_is_split(spark, tmp_path):
    """A third of all orders on one customer: the join splits that partition instead of giving it to one task."""
    n = 60000
    orders = spark.range(n).select(
        F.col("id").alias("o_orderkey"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("bigint").alias("o_custkey"),
        F.lit(1000.0).alias("o_totalprice"), F.lit("1996-03-01 00:00:00").cast("timestamp_ntz").alias("o_orderdate"),
        F.concat(F.lit("1-"), F.md5(F.col("id").cast("string"))).alias("o_orderpriority"))
    customer = spark.range(500).select(F.col("id").alias("c_custkey"), F.lit(3).alias("c_nationkey"), F.lit(5000.0).alias("c_acctbal"),
                                       F.lit("MACHINERY").alias("c_mktsegment"))
    lines = spark.range(2 * n).select((F.col("id") % n).alias("l_orderkey"), F.lit("R").alias("l_returnflag"))
    for name, df in (("orders", orders.repartition(16)), ("customer", customer), ("lineitem", lines)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        df = order_households(spark, str(tmp_path)).groupBy("anchor_product", "outreach_contacts_12m").count()
        plan = finished(df)
        assert df.collect()[0]["count"] == n
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plan
