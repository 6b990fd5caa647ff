"""Predicates and filtered views."""

from pyspark.sql import Column, DataFrame, functions as F

from bundlelens.functions import numeric as num


def _in_lists(choices: dict[str, list[str] | None]) -> Column:
    """All IN lists at once: None leaves a column free, an empty list lets no row through."""
    keep = F.lit(True)
    for column, values in choices.items():
        if values is not None:
            keep = keep & (F.col(column).isin(list(values)) if values else F.lit(False))
    return keep


def crosssell_predicate(channels=None, products=None, tiers=None, ownership=None,
                        tenure: tuple[int, int] | None = None) -> Column:
    keep = _in_lists({"agency_channel": channels, "anchor_product": products,
                      "policy_tier": tiers, "home_ownership": ownership})
    return keep if tenure is None else keep & F.col("tenure_months").between(*tenure)


def benchmark_predicate(channels=None, regions=None, states=None, years=None, tiers=None) -> Column:
    return _in_lists({"agency_channel": channels, "region": regions, "state": states,
                      "year": years, "policy_tier": tiers})


def filter_crosssell(df: DataFrame, **choices) -> DataFrame:
    return df.filter(crosssell_predicate(**choices))


def filter_benchmark(df: DataFrame, **choices) -> DataFrame:
    """Rows of the choices; a choice of years also names the quarters, so other quarters' folders are not read."""
    if choices.get("years") and "quarter" in df.columns:
        df = df.filter(F.substring("quarter", 1, 4).isin(list(choices["years"])))
    return df.filter(benchmark_predicate(**choices))


def filtered_share(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows kept, all rows and their ratio, in one pass."""
    return (df.agg(num.count_where(predicate).alias("filtered"), num.rows().alias("total"))
            .withColumn("share", num.ratio("filtered", "total")))


def is_open() -> Column:
    return F.col("converted_mphh") == 0


def open_households(df: DataFrame) -> DataFrame:
    """Households not yet converted: how many, and their projected value."""
    return df.filter(is_open()).agg(num.rows().alias("open_households"),
                                    F.coalesce(num.money_sum("projected_mphh_cltv"), F.lit(0.0)).alias("open_cltv"))


def warm_leads(df: DataFrame) -> DataFrame:
    """Quote started, not converted."""
    return df.filter((F.col("property_quote_started") == 1) & is_open())


def decile_band(df: DataFrame, max_decile: int, decile: str = "decile") -> DataFrame:
    return df.filter(F.col(decile) <= max_decile)


def leaderboard_channel(leaderboard: DataFrame, channels: list[str]) -> DataFrame:
    return leaderboard.filter(_in_lists({"agency_channel": channels}))


def having_min_group(groups: DataFrame, min_n: int, count_col: str = "households") -> DataFrame:
    """Groups of at least min_n rows."""
    return groups.filter(F.col(count_col) >= min_n)
