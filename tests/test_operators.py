import json
from datetime import date
from pathlib import Path

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from bundlelens import schema as S
from bundlelens.operators import agents, campaigns, filters, funnel, preparation as prep, propensity, quarters, segments, states
from bundlelens.plans import registry
from bundlelens.sources import households
from bundlelens.sources.households import scan_households, scan_rejects, stored_households
from bundlelens.sources.snapshots import SnapshotError, check_snapshot, read_snapshot, write_profile, write_snapshot
from bundlelens.session import shared_dir
from conftest import SF001


# ---- sources ----------------------------------------------------------------------------

def test_csv_and_parquet_give_the_same_fact(spark, tmp_path):
    fact = stored_households(spark, SF001).select(*S.BENCHMARK_COLUMNS)
    for fmt in ("csv", "parquet"):
        write_snapshot(fact, str(tmp_path / fmt), fmt=fmt)
        back = scan_households(spark, str(tmp_path / fmt), fmt, benchmark=True)
        assert back.schema.simpleString() == S.BENCHMARK_SCHEMA.simpleString()
        assert back.count() == 1500 and back.exceptAll(fact).count() == 0


def test_snapshot_folders_prune(spark, tmp_path):
    path = write_snapshot(stored_households(spark, SF001), str(tmp_path / "s"), by="quarter")
    assert sum(1 for p in (tmp_path / "s").iterdir() if p.name.startswith("quarter=")) == 12
    plan = spark.read.parquet(path).filter("quarter = '2024Q1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(quarter" in plan


def test_profile_as_json(spark, tmp_path):
    write_profile(stored_households(spark, SF001).select(*S.HOUSEHOLD_COLUMNS), str(tmp_path / "p"))
    (line,) = [x for f in (tmp_path / "p").glob("*.json") for x in f.read_text().splitlines()]
    record = json.loads(line)
    assert record["n_rows"] == 1500 and record["columns"] == S.HOUSEHOLD_COLUMNS
    assert record["leakage_columns"] == ["propensity_score", "propensity_tier"]


@pytest.fixture
def built(spark, monkeypatch, tmp_path):
    """The stored fact in a folder of its own; the list of what was written there."""
    paths = []
    real = households.write_snapshot
    monkeypatch.setattr(households, "write_snapshot", lambda *a, **k: paths.append(a[1]) or real(*a, **k))
    monkeypatch.setattr(households, "shared_dir", lambda spark: str(tmp_path))
    return paths


def test_fact_is_built_once_for_all_sessions(spark, built, monkeypatch):
    assert stored_households(spark, SF001).count() == 1500
    monkeypatch.setattr(households, "_marks", {})      # what a session knows
    other = spark.newSession()
    assert stored_households(other, SF001).count() == 1500 and len(built) == 1


@pytest.mark.parametrize("harm", ["lost", "changed", "added", "unfinished"])
def test_a_damaged_fact_is_built_anew(spark, built, harm):
    assert stored_households(spark, SF001).count() == 1500
    folder = Path(built[0])
    file = next(folder.glob("quarter=2024Q1/*.parquet"))
    if harm == "lost":
        file.unlink()
    elif harm == "changed":
        file.write_bytes(file.read_bytes() + b"x")
    elif harm == "added":
        (folder / "quarter=2024Q1" / "part-9.parquet").write_bytes(file.read_bytes())
    else:
        (folder / "_manifest.json").unlink()
    with pytest.raises(SnapshotError):
        read_snapshot(spark, built[0], households.STORED_SCHEMA)
    assert stored_households(spark, SF001).count() == 1500 and len(built) == 2
    assert stored_households(spark, SF001).count() == 1500 and len(built) == 2


def test_manifest(spark, tmp_path):
    fact, path = stored_households(spark, SF001), str(tmp_path / "s")
    write_snapshot(fact, path, by="quarter", source="first")
    whole = check_snapshot(spark, path, "first")
    assert whole["rows"] == 1500 and sum(whole["folders"].values()) == 1500 and set(whole["folders"]) == set(S.QUARTERS)
    with pytest.raises(SnapshotError, match="another input"):
        read_snapshot(spark, path, fact.schema, source="second")
    # A refresh of one quarter by another session replaces that folder, its count and its files.
    fresh = spark.newSession().createDataFrame(fact.filter("quarter = '2024Q1'").limit(7).collect(), fact.schema)
    write_snapshot(fresh, path, by="quarter", replace="folders", source="second")
    now = check_snapshot(spark, path, "second")
    assert now["folders"]["2024Q1"] == 7 and now["rows"] == 1500 - whole["folders"]["2024Q1"] + 7
    assert read_snapshot(spark, path, fact.schema).count() == now["rows"]
    assert {f for f in whole["files"] if "2024Q1" not in f} == {f for f in now["files"] if "2024Q1" not in f}
    with pytest.raises(SnapshotError, match="no manifest"):
        read_snapshot(spark, str(tmp_path / "nothing"), fact.schema)
    empty = write_snapshot(fact.limit(0), str(tmp_path / "e"), by="quarter")
    assert check_snapshot(spark, empty)["rows"] == 0


def test_bad_cells_are_set_aside(spark, make, tmp_path):
    rows = make([{"household_id": f"HH-{i}", "snapshot_date": date(2023, 1, 5)} for i in range(4)]).select(*S.HOUSEHOLD_COLUMNS)
    write_snapshot(rows.coalesce(1), path := str(tmp_path / "c"), fmt="csv")
    (file,) = Path(path).glob("part-*.csv")
    header, *lines = file.read_text().splitlines()
    cells = lines[1].split(",")
    cells[S.HOUSEHOLD_COLUMNS.index("tenure_months")] = "12 months"
    cells[S.HOUSEHOLD_COLUMNS.index("snapshot_date")] = "soon"
    empty = lines[3].split(",")
    empty[S.HOUSEHOLD_COLUMNS.index("claims_24m")] = ""
    (tmp_path / "d").mkdir()
    path = str(tmp_path / "d")
    (tmp_path / "d" / "rows.csv").write_text("\n".join([header, lines[0], ",".join(cells), lines[2] + ",one more", ",".join(empty), "too,few"]) + "\n")
    good = scan_households(spark, path, "csv")
    assert [(r.household_id, r.claims_24m) for r in good.orderBy("household_id").collect()] == [("HH-0", 0), ("HH-3", None)]
    # The same rows go whichever columns are read.
    assert good.select("state").count() == good.select("age_of_primary").count() == good.count() == 2
    rejects = {r.household_id: r for r in scan_rejects(spark, path, "csv").collect()}
    assert {k: r.bad_columns for k, r in rejects.items()} == {"HH-1": "snapshot_date,tenure_months", "HH-2": "line", "too": "snapshot_date,line"}
    assert rejects["HH-1"].tenure_months == "12 months"
    with pytest.raises(Exception, match="bad cells in snapshot_date, tenure_months"):
        scan_households(spark, path, "csv", on_bad="fail").collect()
    write_snapshot(rows.drop("state"), p := str(tmp_path / "p"))
    with pytest.raises(ValueError, match="state"):
        scan_households(spark, p)
    assert scan_rejects(spark, write_snapshot(rows, str(tmp_path / "q"))).count() == 0


def test_filter_domains_have_a_limit(make):
    df = make([{"agent_id": f"IA-{i:04d}", "state": None if i == 3 else "OH"} for i in range(30)])
    rows = prep.filter_domains(df, ["agent_id", "state"], max_values=30).collect()
    assert [r.value for r in sorted((r for r in rows if r.filter_column == "agent_id"), key=lambda r: r.position)] == [f"IA-{i:04d}" for i in range(30)]
    assert [(r.position, r.value) for r in rows if r.filter_column == "state"] == [(0, "OH")]
    with pytest.raises(Exception, match="agent_id has more than 29 values"):
        prep.filter_domains(df, ["agent_id", "state"], max_values=29).collect()


def test_shared_dir_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


# ---- preparation ------------------------------------------------------------------------

def test_unmapped_state_and_quarter(make):
    df = prep.add_target(prep.add_region(make([{"state": "ZZ", "quarter": "2030Q1"}, {}])))
    assert {(r.state, r.region, r.robinson_target_pct) for r in df.collect()} == {("ZZ", "Other", None), ("OH", "Midwest", 25.0)}
    assert [r.state for r in prep.unmapped_states(df).collect()] == ["ZZ"]
    assert [r.quarter for r in prep.unmapped_quarters(df).collect()] == ["2030Q1"]


def test_schema_check_names_what_is_missing(make):
    df = make([{}, {}]).drop("region")
    rows = {r.column_name: (r.present, r.filled_rows) for r in prep.schema_check(df).collect()}
    assert rows["region"] == (False, 0) and rows["state"] == (True, 2)
    with pytest.raises(ValueError, match="region"):
        prep.require_columns(df)


def test_quality_checks_fail_on_bad_data(make):
    rows = {r.check_name: r.passed for r in prep.quality_checks(make([{"state": None}, {}])).collect()}
    assert not rows["conversion_rate"] and not rows["quarters"] and not rows["nulls_state"] and rows["nulls_region"]
    assert not any(r.passed for r in prep.quality_checks(make([])).filter("check_name = 'conversion_rate'").collect())


def test_score_and_value_stay_in_range(spark):
    fact = stored_households(spark, SF001)
    low, high = prep.scorecard(fact).agg(F.min("propensity_score"), F.max("propensity_score")).first()
    assert 1.0 <= low < high <= 99.0
    # (premium + property) * years * margin, with property in 400..1800 and years in 1..8
    assert prep.add_projected_cltv(fact).filter(
        "projected_mphh_cltv < (annual_premium_anchor + 400) * 0.18 - 0.01 OR projected_mphh_cltv > (annual_premium_anchor + 1800) * 8 * 0.18 + 0.01").count() == 0


def test_agents_come_from_their_channels_pool(spark):
    rows = prep.agents_per_channel(prep.assign_agents(stored_households(spark, SF001))).collect()
    assert all(r.agents <= S.AGENT_POOLS.get(r.agency_channel, ("", 450))[1] for r in rows)


# ---- filters ----------------------------------------------------------------------------

def test_empty_choice_keeps_nothing(make):
    df = make([{}, {}])
    assert filters.filter_crosssell(df, channels=[]).count() == 0
    assert filters.filter_crosssell(df).count() == 2
    none = filters.crosssell_predicate(channels=[])
    row = segments.kpi_crosssell(df, none).first()
    assert (row.households, row.rate, row.avg_cltv, row.open_cltv) == (0, 0.0, None, 0.0)
    assert filters.filtered_share(df, none).first().share == 0.0


def test_floor_keeps_fifty(make):
    df = make([{"agent_id": "A"}] * 50 + [{"agent_id": "B"}] * 49)
    assert [r.agent_id for r in agents.agent_measures(df).collect()] == ["A"]


# ---- quarters ---------------------------------------------------------------------------

def test_spine_keeps_missing_and_drops_unknown_quarters(make):
    rows = quarters.quarter_summary(make([{"quarter": "2023Q2", "converted_mphh": 1}, {"quarter": "1999Q1"}])).collect()
    assert [r.quarter for r in rows] == S.QUARTERS
    seen = [r for r in rows if r.total is not None]
    assert [(r.quarter, r.status, r.rate_pct) for r in seen] == [("2023Q2", "On Track", 100.0)]
    assert all(r.target_pct is None and r.status is None for r in rows if r.total is None)


def test_latest_quarter_is_the_last_with_rows(make):
    df = make([{"quarter": "2023Q1"}, {"quarter": "2024Q3", "converted_mphh": 1}])
    row = quarters.tracker_status(quarters.quarter_summary(df)).first()
    assert (row.quarters_behind, row.quarters_on_track, row.quarters_tracked, row.latest_quarter) == (1, 1, 2, "2024Q3")


def test_year_comparison_without_the_last_year(make):
    df = prep.add_quarter_year(make([{"quarter": "2023Q1"}, {"quarter": "2024Q1", "converted_mphh": 1}]).withColumn(
        "snapshot_date", F.to_date(F.concat(F.substring("quarter", 1, 4), F.lit("-02-01")))))
    row = quarters.yoy_quarter(df).first()
    assert (row.delta_23_24_pp, row.delta_24_25_pp, row.direction_23_24, row.direction_24_25) == (100.0, None, "Improved", "Flat")
    pivot = quarters.channel_year_pivot(df).first()
    assert pivot.delta_24_25 is None and pivot.sort_delta == 100.0
    assert quarters.yoy_quarter(make([{"quarter": "2023Q1"}])).count() == 0


def test_grid_fills_missing_cells_with_zero(make):
    rows = quarters.channel_quarter_grid(make([{"converted_mphh": 1}, {"agency_channel": "Direct Online"}])).collect()
    assert len(rows) == 24 and sum(r.converted for r in rows) == 1


# The pooled and the mean-of-quarters forms must differ where quarters differ in size.
def test_pooled_is_not_mean_of_means(make):
    df = make([{"converted_mphh": 1}] + [{"quarter": "2023Q2"}] * 3)
    assert quarters.tenure_pooled_rank(df).first().avg_conversion_rate_pct == 25.0
    assert quarters.tenure_mean_of_quarters(df).first().avg_rate_pct == 50.0


# ---- agents and states ------------------------------------------------------------------

def test_gap_with_fewer_than_twenty_agents(make):
    rows = [{"agent_id": f"A{a}", "converted_mphh": int(i < a)} for a in range(4) for i in range(4)]
    row = agents.agent_gap_sql(make(rows), min_households=1, k=3).first()
    assert (row.top_10_avg_rate, row.median_rate, row.bottom_10_avg_rate, row.top_bottom_gap_pp) == (50.0, 37.5, 25.0, 25.0)


def test_tied_ranks_share_the_smallest(make):
    rows = [{"agent_id": a, "converted_mphh": c} for a, c in (("A", 1), ("B", 1), ("C", 0))]
    got = {r.agent_id: r.rank_rate for r in agents.agent_leaderboard(make(rows), 1).collect()}
    assert got == {"A": 1, "B": 1, "C": 3}


def test_leaderboard_orders(make):
    rows = [{"agent_id": "A", "converted_mphh": 1, "projected_mphh_cltv": 1.0}] + [{"agent_id": "B", "converted_mphh": int(i < 2)} for i in range(4)]
    board = agents.agent_measures(make(rows), 1)
    first = lambda by: agents.leaderboard_top(board, by).first()
    assert first("rate").agent_id == "A" and first("conversions").agent_id == "B" and first("cltv").agent_id == "B"
    assert first("rate").position_label == "1st"
    with pytest.raises(KeyError):
        agents.leaderboard_top(board, "other")


def test_state_average_forms_differ(make):
    df = make([{"state": "OH", "converted_mphh": 1}] + [{"state": "TX"}] * 3)
    pooled = {r.state: r.vs_portfolio_avg_pp for r in states.state_vs_portfolio(df).collect()}
    mean = {r.state: r.vs_avg for r in states.state_summary(df).collect()}
    assert pooled == {"OH": 75.0, "TX": -25.0} and mean == {"OH": 50.0, "TX": -50.0}


# ---- funnel and campaign ----------------------------------------------------------------

def test_funnel_without_quote_starts(make):
    row = funnel.quote_funnel(make([{}, {"converted_mphh": 1}])).first()
    assert row.quote_conversion_rate_pct is None and row.abandonment_rate_pct is None
    assert row.quote_starter_lift_vs_non_starter is None
    assert {r.abandon_rate for r in funnel.funnel_stages(make([{}])).collect()} == {0.0}


def test_outcomes_add_up(spark):
    rows = funnel.quote_outcomes(stored_households(spark, SF001)).collect()
    assert sum(r.households for r in rows) == 1500 and abs(sum(r.share_pct for r in rows) - 100) < 1e-9


def test_campaign_arithmetic(make):
    df = make([{}] * 10 + [{"converted_mphh": 1, "projected_mphh_cltv": 12000.0}])
    row = campaigns.campaign_case(df, 0.15, 35).first()
    assert (row.open_households, row.saved_households, row.gross_revenue, row.total_cost) == (10, 1, 2000.0, 350.0)
    assert campaigns.campaign_case(df, 0.15, 0).first().roi == 0.0
    grid = campaigns.campaign_grid(df).collect()
    assert [r.scenario for r in grid] == ["below", "below", "selected", "above", "above", "above"]
    assert grid[2].net_revenue_M == pytest.approx((10 * 0.15 * 2000 - 350) / 1e6)


def test_campaign_list_segments_and_limit(make):
    df = make([{"propensity_score": 70.0, "outreach_contacts_12m": 0}, {"propensity_score": 55.0},
               {"propensity_score": 56.0, "outreach_contacts_12m": 5, "home_ownership": "Homeowner"},
               {"propensity_score": 41.0, "property_quote_started": 1}, {"propensity_score": 40.0, "outreach_contacts_12m": 4},
               {"propensity_score": 39.9}, {"propensity_score": 90.0, "converted_mphh": 1}, {"propensity_score": 90.0, "claims_24m": 2}])
    rows = campaigns.campaign_list(df).collect()
    assert [r.intervention_segment for r in rows] == ["Warm Lead: High Score, No Outreach", "Property Target: Homeowner",
                                                      "Active Nurture", "Warm Lead: Quote Abandoned", "Standard Pipeline"]
    assert [r.rank_within_channel for r in campaigns.campaign_list(df, per_channel=2).collect()] == [1, 2]


# ---- model ------------------------------------------------------------------------------

def test_leaking_columns_are_refused(spark):
    with pytest.raises(ValueError, match="propensity_score"):
        propensity.check_features(["tenure_months", "propensity_score"])


def test_model_separates_and_scores(spark, monkeypatch, tmp_path):
    rows = propensity.stratified_split(propensity.encode_features(stored_households(spark, SF001)))
    model = propensity.train_gbt(rows.filter("split = 'train'"), rounds=5)
    scored = propensity.score_households(model, rows).cache()
    assert scored.filter("model_prob < 0 OR model_prob > 1").count() == 0
    got = propensity.model_auc(scored).first()
    pdf = scored.select("model_prob", "converted_mphh").toPandas()
    ranks, won = pdf["model_prob"].rank(), pdf["converted_mphh"] == 1
    n1, n0 = won.sum(), (~won).sum()
    assert got.auc == pytest.approx((ranks[won].sum() - n1 * (n1 + 1) / 2) / (n1 * n0), abs=1e-9) and got.auc > 0.6
    cells = propensity.confusion(scored).first()
    assert cells.tn + cells.fp + cells.fn + cells.tp == 1500
    shown = propensity.feature_importance(spark, model).collect()
    assert len(shown) == 10 and [r.importance for r in shown] == sorted((r.importance for r in shown), reverse=True)
    assert sum(r.above_median for r in shown) == 5

    # The registered model queries read one fit and one scored table.
    monkeypatch.setattr(propensity, "train_gbt", lambda train, **k: model)
    monkeypatch.setattr(registry, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(registry, "_fitted", {})
    lift = registry.queries()["model_lift_table"](spark, SF001).collect()
    assert lift[-1].cum_gain_pct == 100.0 and lift[0].lift > 1 > lift[-1].lift
    profile = registry.queries()["model_decile_profile"](spark, SF001).collect()
    assert [r.max_decile for r in profile] == [1, 2, 3, 10]
    assert registry.queries()["model_scores"](spark, SF001).count() == rows.filter("split = 'test'").count()
    checks = registry.queries()["score_households"](spark, SF001).collect()
    assert len(checks) == 1500 and all(r.is_probability and r.class_follows for r in checks)
    # Another session finds the saved model and the scores; scores that have lost a file are written anew.
    first = registry._fitted.popitem()[1]
    monkeypatch.setattr(propensity, "train_gbt", None)
    assert registry.fitted(spark, SF001).scored == first.scored
    next(Path(first.scored.removeprefix("file:")).glob("quarter=*/*.parquet")).unlink()
    assert registry.fitted(spark, SF001).scored != first.scored
    again = registry.scored_test(spark, SF001)
    assert again.count() == rows.filter("split = 'test'").count()
    scored.unpersist()


def test_a_saved_model_scores_the_same(spark, tmp_path):
    rows = propensity.stratified_split(propensity.encode_features(prep.add_quarter_year(stored_households(spark, SF001))))
    model = propensity.train_gbt(rows.filter("split = 'train'"), rounds=3)
    path = propensity.save_model(model, str(tmp_path / "m"), note="x")
    loaded, card = propensity.load_model(spark.newSession(), path)
    assert card["features"] == S.FEATURES and card["note"] == "x"
    columns = ["household_id", "model_prob", "prediction"]
    before, after = (propensity.score_households(m, rows).select(*columns) for m in (model, loaded))
    assert before.count() == 1500 and before.exceptAll(after).count() == 0
    # Scores lie in dated folders, of which one can be scored again.
    keep = ["household_id", "converted_mphh"]
    out = propensity.write_scores(loaded, rows, str(tmp_path / "s"), keep)
    propensity.write_scores(loaded, rows.filter("quarter = '2025Q4'"), out, keep, replace="folders")
    assert check_snapshot(spark, out)["rows"] == 1500 and len(check_snapshot(spark, out)["folders"]) == 12
    with pytest.MonkeyPatch.context() as m:
        m.setitem(S.ORDINAL_CODES, "policy_tier", {"Basic": 9})
        with pytest.raises(ValueError, match="other codes"):
            propensity.load_model(spark, path)


def test_training_sample_keeps_the_bound_and_the_classes(spark):
    rows = propensity.stratified_split(stored_households(spark, SF001)).filter("split = 'train'")
    n = rows.count()
    assert propensity.training_sample(rows, n).count() == n
    for most in (900, 300, 40):
        sample = propensity.training_sample(rows, most)
        kept = sample.count()
        assert most - 9 * most ** 0.5 <= kept <= most
        assert sorted(r[0] for r in sample.select("household_id").collect()) == sorted(r[0] for r in propensity.training_sample(rows.repartition(7), most).select("household_id").collect())
    share = lambda df: df.agg(F.avg("converted_mphh")).first()[0]
    assert abs(share(propensity.training_sample(rows, 900)) - share(rows)) < 0.05


def test_area_of_ties_and_missing_scores(spark):
    area = lambda rows: propensity.model_auc(spark.createDataFrame(rows, "model_prob double, converted_mphh int")).first()
    assert area([(0.1, 0), (0.2, 1), (0.2, 0), (0.9, 1)]).auc == pytest.approx(3.5 / 4, abs=1e-12)
    assert area([(0.5, 0), (0.5, 1)]).auc == 0.5 and area([(-3.0, 1), (-2.0, 0)]).auc == 0.0
    got = area([(0.1, 0), (None, 1), (float("nan"), 1), (0.7, 1), (0.8, None)])
    assert (got.households, got.converted, got.auc) == (5, 3, 1.0)
    assert area([(0.4, 1)]).auc is None and area([]).auc is None


def test_area_equals_the_evaluator(spark):
    rows = stored_households(spark, SF001).select("propensity_score", "converted_mphh")
    ready = rows.select(F.col("propensity_score").alias("rawPrediction"), F.col("converted_mphh").cast("double").alias("label"))
    want = BinaryClassificationEvaluator(numBins=0).evaluate(ready)
    assert propensity.model_auc(rows, "propensity_score").first().auc == pytest.approx(want, abs=1e-9)


def test_confusion_without_positive_predictions(make):
    row = propensity.confusion(make([{}]).withColumn("prediction", F.lit(0))).first()
    assert (row.precision, row.recall, row.accuracy) == (0.0, 0.0, 1.0)


def test_importances_need_no_scores(spark, monkeypatch, tmp_path):
    model = propensity.train_gbt(propensity.stratified_split(propensity.encode_features(stored_households(spark, SF001))).filter("split = 'train'"), rounds=2)
    monkeypatch.setattr(propensity, "train_gbt", lambda train, **k: model)
    monkeypatch.setattr(propensity, "write_scores", None)
    monkeypatch.setattr(registry, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(registry, "_fitted", {})
    assert registry.queries()["leading_features"](spark, SF001).count() == 10
    assert registry.queries()["feature_importance"](spark, SF001).count() == len(S.FEATURES)
    assert registry.queries()["train_gbt"](spark, SF001).first().trees == 2


@pytest.mark.parametrize("most", [2000, 300, 40])
def test_the_fit_gets_the_sample_in_one_reading(spark, monkeypatch, most):
    """The rows of ``training_sample``, without its two counts over the whole table."""
    rows = propensity.stratified_split(propensity.encode_features(stored_households(spark, SF001))).filter("split = 'train'")
    want, got = propensity.training_sample(rows, most), []
    monkeypatch.setattr(propensity.GBTClassifier, "fit", lambda self, df: got.append((df.columns, sorted((*r.features, r.label) for r in df.collect()))))
    want = sorted((*(float(r[c]) for c in S.FEATURES), float(r[S.TARGET])) for r in want.collect())
    monkeypatch.setattr(propensity, "training_sample", None)
    propensity.train_gbt(rows, max_train_rows=most)
    assert got == [(["features", "label"], want)]
