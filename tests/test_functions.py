import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from bundlelens.functions import numeric as num
from bundlelens.functions.mapping import add_tenure_bucket, lookup
from bundlelens.functions.ordering import count_before, exact_ntile, quantile_deciles, quantile_edges, top_n_per_group


def test_rounding_goes_away_from_zero(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (-0.001,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(num.rnd("x", 2)).collect()] == [0.13, -0.13, 0.0, 2.5, None]
    assert [r[0] for r in df.select(num.rnd("x", 0)).collect()] == [0.0, 0.0, 0.0, 3.0, None]


def test_money_is_exact_in_any_order(spark):
    df = spark.createDataFrame([(0.1,)] * 1000 + [(None,)], "x double").repartition(7)
    row = df.agg(num.money_sum("x").alias("s"), num.money_mean("x").alias("m")).first()
    assert row.s == 100.0 and row.m == 0.1


def test_padding_never_cuts_digits(spark):
    df = spark.createDataFrame([(7,), (1234567,), (12345678901,)], "n bigint")
    assert [r[0] for r in df.select(num.padded("n", 7)).collect()] == ["0000007", "1234567", "12345678901"]


def test_ratio_without_denominator_is_null(spark):
    assert spark.range(0).agg(num.pct(F.sum("id"), num.rows()).alias("p")).first().p is None


def test_lookup_unknown_and_null(spark):
    df = spark.createDataFrame([("OH",), ("ZZ",), (None,)], "state string")
    assert [r[0] for r in df.select(lookup("state", {"OH": 1})).collect()] == [1, None, None]
    assert [r[0] for r in df.select(lookup("state", {"OH": 1}, 9)).collect()] == [1, 9, 9]


def test_tenure_bucket_modes(spark):
    months = [None, -1, 0, 5, 6, 59, 60, 120, 121]
    df = spark.createDataFrame([(m,) for m in months], "tenure_months int")
    label = lambda mode: [r.tenure_bucket for r in add_tenure_bucket(df, mode).collect()]
    assert label("case") == ["60+mo", "0-5mo", "0-5mo", "0-5mo", "6-11mo", "36-59mo", "60+mo", "60+mo", "60+mo"]
    assert label("cut") == [None, None, "0-5mo", "0-5mo", "6-11mo", "36-59mo", "60+mo", "60+mo", None]
    with pytest.raises(ValueError):
        add_tenure_bucket(df, "other")


def _scores(kind: str, n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if kind == "hot":                      # one score holds more than a third of the rows
        return np.where(rng.random(n) < 0.4, 50.0, np.round(rng.uniform(1, 99, n), 1))
    if kind == "few":
        return rng.choice([10.0, 20.0, 30.0], n)
    if kind == "signed":
        return rng.normal(0, 1000, n)
    return np.round(rng.uniform(1, 99, n), 1)


@pytest.mark.parametrize("kind,n,tiles", [("hot", 3001, 10), ("few", 997, 10), ("signed", 500, 7), ("tenths", 2000, 10), ("few", 4, 10), ("hot", 10, 3)])
def test_exact_ntile_equals_builtin(spark, kind, n, tiles):
    scores = _scores(kind, n, n)
    df = spark.createDataFrame(pd.DataFrame({"k": [f"HH-{i:07d}" for i in range(n)], "s": scores}))
    built_in = Window.orderBy(F.col("s").desc(), F.md5("k"), "k")
    want = {r.k: r.t for r in df.withColumn("t", F.ntile(tiles).over(built_in)).collect()}
    got = {r.k: r.tile for r in exact_ntile(df, "s", "k", tiles).collect()}
    assert got == want


@pytest.mark.parametrize("kind,n", [("hot", 3001), ("few", 997), ("signed", 501), ("tenths", 2000), ("tenths", 11), ("few", 1)])
def test_quantile_deciles_equal_pandas(spark, kind, n):
    pdf = pd.DataFrame({"k": range(n), "s": _scores(kind, n, n)})
    got = quantile_deciles(spark.createDataFrame(pdf), "s").toPandas().set_index("k")["decile"].sort_index()
    if n == 1:
        assert got.tolist() == [1]
        return
    want = pd.qcut(-pdf["s"], 10, labels=False, duplicates="drop") + 1
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("kind", ["hot", "few", "signed"])
def test_count_before_is_minimum_rank(spark, kind):
    pdf = pd.DataFrame({"s": _scores(kind, 800, 5)})
    want = dict(zip(pdf["s"], pdf["s"].rank(ascending=False, method="min").astype(int) - 1))
    rows = count_before(spark.createDataFrame(pdf), "s", descending=True).collect()
    assert {r.s: r.before for r in rows} == want
    assert {r.total for r in rows} == {800} and sum(r.n for r in rows) == 800


def test_count_before_skips_null_and_survives_empty(spark):
    df = spark.createDataFrame([(1.0,), (None,), (1.0,)], "s double")
    assert [(r.s, r.n, r.before, r.total) for r in count_before(df, "s").collect()] == [(1.0, 2, 0, 2)]
    assert count_before(df.filter("s > 5"), "s").count() == 0
    assert quantile_deciles(df, "s").filter("s IS NULL").first().decile is None


def test_top_n_per_group_equals_window(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": range(5000), "g": np.where(rng.random(5000) < 0.6, "hot", rng.choice(["a", "b"], 5000)),
                        "v": rng.integers(0, 30, 5000)})
    df = spark.createDataFrame(pdf).repartition(16)
    order = [F.col("v").desc(), F.col("k")]
    want = (df.withColumn("p", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("p <= 40"))
    got = top_n_per_group(df, ["g"], order, 40, "p")
    assert {(r.g, r.k, r.p) for r in got.collect()} == {(r.g, r.k, r.p) for r in want.collect()}


@pytest.mark.parametrize("kind,n,bins", [("hot", 3001, 10), ("few", 997, 4), ("signed", 501, 7), ("signed", 2, 10), ("tenths", 11, 10), ("few", 1, 3)])
def test_quantile_edges_look_closely_at_few_levels(spark, kind, n, bins):
    """Lists of spots are made for the levels that hold one, at most two per edge; the edges are those of numpy."""
    pdf = pd.DataFrame({"s": _scores(kind, n, n)})
    edges = quantile_edges(spark.createDataFrame(pdf), "s", bins)
    want = np.unique(np.quantile(-pdf["s"], np.arange(bins + 1) / bins))
    assert np.allclose(edges.first().edges, want, rtol=1e-12)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Generate"):].splitlines()
    assert any("Filter" in x and " div " in x for x in below[1:4])
