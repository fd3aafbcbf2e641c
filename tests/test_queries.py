"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from oracle import connect, same

from panelry.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    same(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], con)


@pytest.fixture
def small_models(monkeypatch):
    """Small trees: the sizes of the registered queries take minutes."""
    monkeypatch.setattr("panelry.plans.q_evaluate.FOREST", (20, 6))
    monkeypatch.setattr("panelry.plans.q_evaluate.BOOSTED", (36, 3))


def test_queries_without_sql_are_those_of_models():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"baseline_experiment", "model_forest", "model_boosted", "ablation_experiment"}


def test_every_event_is_a_request_and_every_hour_has_a_graph(spark, sf_dir):
    for name in ("score_as_of", "request_errors"):
        got = registry.QUERIES[name](spark, sf_dir)
        assert {x[0] for x in got.selectExpr("request_id % 3").distinct().collect()} == {0, 1, 2}
    hours = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("date_trunc('hour', ts)").distinct().count()
    assert registry.QUERIES["replicate_graph"](spark, sf_dir).select("timestamp").distinct().count() == hours


def test_models_beat_persistence_for_every_target(spark, sf_dir, small_models):
    rows = registry.QUERIES["baseline_experiment"](spark, sf_dir).collect()
    rmse = {(r.target, r.model, r.split): r.rmse for r in rows}
    targets = {"target_pm25_h1", "target_pm25_h2", "target_no2_h1"}
    assert set(rmse) == {(y, name, part) for y in targets for name in ("persistence", "linear", "forest", "boosted") for part in ("train", "val", "test")}
    for y in targets:
        for name in ("forest", "boosted"):
            assert rmse[y, name, "test"] < rmse[y, "persistence", "test"], (y, name)
    assert len({(r.target, r.split, r.n) for r in rows}) == 9


@pytest.mark.parametrize("name", ["forest", "boosted"])
def test_single_models(spark, sf_dir, small_models, name):
    found = {(r.model, r.split): r.rmse for r in registry.QUERIES[f"model_{name}"](spark, sf_dir).collect()}
    assert found[name, "test"] < found["persistence", "test"]


def test_ablation_has_every_tier(spark, sf_dir):
    rows = registry.QUERIES["ablation_experiment"](spark, sf_dir).collect()
    assert {(r.target, r.model, r.split) for r in rows} == {(y, a, b) for y in ("target_pm25_h1", "target_pm25_h2") for a in "ABCD" for b in ("train", "val", "test")}
    rmse = {(r.model, r.split): r.rmse for r in rows if r.target == "target_pm25_h1"}
    assert rmse["A", "train"] >= rmse["B", "train"] >= rmse["C", "train"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sequence_windows_are_summed_where_they_are(spark, sf_dir):
    """No window is taken apart into rows and grouped again."""
    plan = registry.QUERIES["sequence_windows"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
