"""Agent leaderboards and performance gaps.

The number of agents is not bounded by a code list, so ranks over them count the rows before each value and the best
and worst k are top-k selections; neither gathers the leaderboard in one task.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from bundlelens.functions import numeric as num
from bundlelens.functions.ordering import sums_before
from bundlelens.operators.filters import having_min_group
from bundlelens.operators.segments import CLTV, CONVERTED, by_desc, rate_measures

GRAIN = ["agent_id", "agency_channel", "region", "state"]


def _ranked(board: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """Add a descending rank per measure.

    All measures are ranked in one pass over (measure, value) lines, which are then folded back to rows. Counting the rows by all
    their columns makes lines and ranks read the same groups, so the plan groups the households once for both.
    """
    counted = board.groupBy(*board.columns).agg(F.count(F.lit(1)).alias("_rows"))
    pairs = ", ".join(f"struct('{c}' as _measure, double({c}) as _value)" for c in ranks)
    lines = counted.select("*", F.expr(f"inline(array({pairs}))"))
    levels = lines.groupBy("_measure", "_value").agg(F.sum("_rows").alias("n"))
    places = sums_before(levels, "_value", ["n"], descending=True, within=("_measure",))
    return (lines.join(places.select("_measure", "_value", "n_before"), ["_measure", "_value"])
            .groupBy(*counted.columns).agg(*[F.expr(f"max(n_before + 1) filter (where _measure = '{c}')").alias(name) for c, name in ranks.items()])
            .drop("_rows"))


def agent_leaderboard_sql(df: DataFrame, min_households: int = 50) -> DataFrame:
    """Rounded measures per agent, channel, region and state, ranked on the rounded values."""
    hits = num.total(CONVERTED)
    board = having_min_group(df.groupBy(*GRAIN).agg(
        num.rows().alias("households"), hits.alias("converted"), num.pct(hits, num.rows()).alias("rate_pct"),
        num.rnd(num.money_mean(CLTV)).alias("avg_cltv"), num.rnd(num.money_sum(CLTV) / 1000.0, 1).alias("total_cltv_k"),
        num.rnd(num.mean("outreach_contacts_12m")).alias("avg_outreach"),
        num.rnd(num.mean("digital_engagement_score")).alias("avg_digital_score")), min_households)
    board = _ranked(board, {"rate_pct": "rank_by_rate", "converted": "rank_by_conversions", "total_cltv_k": "rank_by_cltv"})
    return board.orderBy(*by_desc("converted", *GRAIN))


def agent_measures(df: DataFrame, min_households: int = 50) -> DataFrame:
    """Unrounded measures per agent, channel, region and state with enough households: a leaderboard without ranks."""
    rate, n, hits, _ = rate_measures()
    total = num.money_sum(CLTV)
    return having_min_group(df.groupBy(*GRAIN).agg(
        n, hits, rate, num.money_mean(CLTV).alias("avg_cltv"), total.alias("total_cltv"),
        num.mean("outreach_contacts_12m").alias("avg_outreach"), num.mean("digital_engagement_score").alias("avg_digital"),
        num.rnd(num.ratio(num.total(CONVERTED), num.rows()) * 100.0).alias("rate_pct"),
        num.rnd(total / 1000.0, 1).alias("total_cltv_k")), min_households)


def agent_leaderboard(df: DataFrame, min_households: int = 50) -> DataFrame:
    """``agent_measures`` ranked on unrounded values."""
    board = _ranked(agent_measures(df, min_households),
                    {"converted": "rank_converted", "rate": "rank_rate", "total_cltv": "rank_cltv"})
    return board.orderBy(*by_desc("converted", *GRAIN))


RANK_COLUMNS = {"rate": "rate_pct", "conversions": "converted", "cltv": "total_cltv"}


def leaderboard_top(board: DataFrame, rank_by: str = "rate", limit: int = 15) -> DataFrame:
    """First rows of a leaderboard by rate, conversions or value, with a position label."""
    order = by_desc(RANK_COLUMNS[rank_by], *GRAIN)
    top = board.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return (top.withColumn("position", place).withColumn("position_label", num.rank_label("position"))
            .select("position", "position_label", *GRAIN, "households", "converted", "rate_pct", "total_cltv")
            .orderBy("position"))


def agent_rate_spread(board: DataFrame) -> DataFrame:
    """Quartiles, median and mean of the leaderboard rates of each channel."""
    quartiles = F.percentile("rate_pct", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (board.groupBy("agency_channel").agg(
                num.rows().alias("leaderboard_rows"), quartiles.alias("q"),
                num.rnd(num.ratio(num.scaled_sum("rate_pct", 100), num.rows()) / 100.0, 4).alias("mean_rate_pct"))
            .select("agency_channel", "leaderboard_rows", num.rnd(F.col("q")[0], 4).alias("q1_rate_pct"),
                    num.rnd(F.col("q")[1], 4).alias("median_rate_pct"), num.rnd(F.col("q")[2], 4).alias("q3_rate_pct"),
                    "mean_rate_pct")
            .orderBy("agency_channel"))


def region_agents(board: DataFrame) -> DataFrame:
    """Leaderboard rows, mean rate and mean value per region."""
    return (board.groupBy("region").agg(
                num.rows().alias("agents"),
                num.rnd(num.ratio(num.scaled_sum("rate_pct", 100), num.rows()) / 100.0, 6).alias("avg_rate_pct"),
                num.rnd(num.ratio(num.scaled_sum("total_cltv_k", 10), num.rows()) / 10.0, 6).alias("avg_cltv_k"))
            .orderBy(*by_desc("avg_rate_pct", "region")))


def region_agents_sql(df: DataFrame, min_households: int = 50) -> DataFrame:
    """Agents of each region with enough households there: number, mean, least, greatest rate, spread, mean value."""
    agents = having_min_group(df.groupBy("agent_id", "region").agg(
        num.rows().alias("households"), num.pct(num.total(CONVERTED), num.rows()).alias("rate_pct"),
        num.rnd(num.money_sum(CLTV) / 1000.0, 1).alias("total_cltv_k")), min_households)
    return (agents.groupBy("region").agg(
                num.rows().alias("agent_count"),
                num.rnd(num.ratio(num.scaled_sum("rate_pct", 100), num.rows()) / 100.0).alias("avg_rate_pct"),
                F.min("rate_pct").alias("min_rate_pct"), F.max("rate_pct").alias("max_rate_pct"),
                num.rnd(F.max("rate_pct") - F.min("rate_pct")).alias("rate_spread_pp"),
                num.rnd(num.ratio(num.scaled_sum("total_cltv_k", 10), num.rows()) / 10.0, 1).alias("avg_cltv_k"))
            .orderBy(*by_desc("avg_rate_pct", "region")))


def _mean_of_first(rows: DataFrame, order: list[Column], k: int) -> Column:
    """Mean rate of the first k rows: a top-k selection read as a scalar, in whole hundredths."""
    best = rows.orderBy(*order).limit(k)
    return best.agg(num.ratio(num.scaled_sum("rate_pct", 100), num.rows()) / 100.0).scalar()


def _gap(rows: DataFrame, best: list[Column], worst: list[Column], k: int) -> DataFrame:
    # Three readings of the same group rows, which the plan shares.
    top, bottom = _mean_of_first(rows, best, k), _mean_of_first(rows, worst, k)
    # Rates have two decimals, so the percentile buffers at most 10,001 distinct values.
    return rows.agg(F.percentile("rate_pct", F.lit(0.5)).alias("median")).select(
        top.alias("top"), "median", bottom.alias("bottom"))


def agent_gap_sql(df: DataFrame, min_households: int = 50, k: int = 10) -> DataFrame:
    """Mean rate of the k best and k worst agents, the median, and the gap between best and worst."""
    rates = having_min_group(df.groupBy("agent_id").agg(
        num.rows().alias("households"), num.pct(num.total(CONVERTED), num.rows()).alias("rate_pct")), min_households)
    gap = _gap(rates, [F.col("rate_pct").desc(), F.col("agent_id")], [F.col("rate_pct"), F.col("agent_id")], k)
    return gap.select(num.rnd("top").alias("top_10_avg_rate"), num.rnd("median").alias("median_rate"),
                      num.rnd("bottom").alias("bottom_10_avg_rate"), num.rnd(F.col("top") - F.col("bottom")).alias("top_bottom_gap_pp"))


def agent_gap(board: DataFrame, rank_by: str = "rate", k: int = 10) -> DataFrame:
    """Mean rate of the first and last k leaderboard rows in the chosen order, and the median rate."""
    column = RANK_COLUMNS[rank_by]
    backwards = [F.col(column), *[F.col(c).desc() for c in GRAIN]]
    order_columns = dict.fromkeys([column, "rate_pct", *GRAIN])
    gap = _gap(board.select(*order_columns), by_desc(column, *GRAIN), backwards, k)
    return gap.select(num.rnd("top", 6).alias("top_avg_rate"), num.rnd("median", 4).alias("median_rate"),
                      num.rnd("bottom", 6).alias("bottom_avg_rate"))


def top_agent(board: DataFrame) -> DataFrame:
    """Leaderboard size, the leader by conversions, the leader by rate, and the leading rate of Independent Agents."""
    def leader(column: str) -> Column:
        # The smallest (-value, names) is the highest value, ties settled by name.
        return F.min(F.struct((-F.col(column).cast("double")).alias("v"), *GRAIN))

    independent = F.col("agency_channel") == "Independent Agent"
    return (board.agg(num.rows().alias("leaderboard_rows"), leader("converted").alias("c"), leader("rate_pct").alias("r"),
                      F.max(F.when(independent, F.col("rate_pct"))).alias("top_independent_rate_pct"))
            .select("leaderboard_rows", F.col("c.agent_id").alias("top_agent_by_conversions"),
                    (-F.col("c.v")).cast("bigint").alias("top_converted"), F.col("r.agent_id").alias("top_agent_by_rate"),
                    F.col("r.agency_channel").alias("top_rate_channel"), (-F.col("r.v")).alias("top_rate_pct"),
                    "top_independent_rate_pct"))
