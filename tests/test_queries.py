"""Registered queries against their SQL on the smallest tables, and the forecasters' contract."""

import datetime

import numpy as np
import pytest

from weekloom.config import PROTOCOL
from weekloom.operators import backtest, baselines, forecasters, runs, score, split
from weekloom.plans import fixtures
from weekloom.plans.oracle import oracle
from weekloom.plans.queries import QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
CHECKED = ["panel_grid", "eligibility", "strata", "future_covariates", "impute_gaps", "score_point", "score_quantile", "backtest_leaderboard", "cost_table", "dm_pairwise", "wilcoxon_holm", "scaling_table", "bootstrap_skill", "best_trial", "nested_ladder", "score_absent"]


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, engine, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = engine.execute(oracle()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    text = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).map(lambda x: str(x)[:10] if hasattr(x, "year") else round(float(x), 6) if isinstance(x, (float, np.floating)) else x).values.tolist()))
    assert text(got) == text(want)


def test_every_oracle_has_its_query():
    assert set(oracle()) <= set(QUERIES)


@pytest.mark.parametrize("name", list(forecasters.LOCAL))
def test_forecasters_follow_a_season(name):
    y = 100 + 20 * np.sin(np.arange(208) * 2 * np.pi / 52)
    (point,), (spread,) = forecasters.LOCAL[name]([y], 13, 52)
    want = 100 + 20 * np.sin(np.arange(208, 221) * 2 * np.pi / 52)
    assert np.abs(point - want).mean() < 6 and (spread >= 0).all()


@pytest.mark.parametrize("name", list(forecasters.LOCAL))
def test_a_batch_is_its_series_and_short_ones_do_not_fail(name):
    rng = np.random.default_rng(2)
    series = [rng.gamma(2, 50, n) for n in [*range(61), 120, 160, 300]] + [np.zeros(150), np.full(90, 7.0)]
    points, spreads = forecasters.LOCAL[name](series, 13, 52)
    assert np.isnan(points[0]).all() and np.isfinite(points[61:65]).all() and np.isfinite(spreads[61:65]).all()
    for k, y in enumerate(series):
        alone = forecasters.LOCAL[name]([y], 13, 52)
        assert np.allclose(points[k], alone[0][0], equal_nan=True) and np.allclose(spreads[k], alone[1][0], equal_nan=True)


def test_ridge_over_one_series_is_the_local_one(spark):
    """Pooled over one series, the regression sees all of its rows, as the local one does."""
    y = 100 + np.arange(300) * 0.5 + np.random.default_rng(1).normal(0, 20, 300)
    rows = [(0, "a", datetime.date(1995, 1, 1) + datetime.timedelta(weeks=k), float(v)) for k, v in enumerate(y)]
    made = forecasters.ridge_global(spark.createDataFrame(rows, "fold int, unique_id string, ds date, y double"), PROTOCOL).orderBy("step").collect()
    assert [r.yhat for r in made] == pytest.approx(forecasters.ridge_local(y, PROTOCOL.longest, PROTOCOL.season)[0].tolist())


def weekly(values, uid="a", fold=0):
    return [(fold, uid, datetime.date(1995, 1, 1) + datetime.timedelta(weeks=k), float(v)) for k, v in enumerate(values)]


def test_global_models_learn_a_common_season_and_skip_short_series(spark):
    season = lambda n, size: size * (3 + np.sin(np.arange(n) * 2 * np.pi / 52))
    rows = [r for k in range(6) for r in weekly(season(260, 10.0**k), f"s{k}")] + weekly([1, 2, 3], "short")
    filled = spark.createDataFrame(rows, "fold int, unique_id string, ds date, y double")
    for fit in (forecasters.ridge_global, forecasters.linear_global, forecasters.gbt_global):
        made = {(r.unique_id, r.step): r.yhat for r in fit(filled, PROTOCOL).collect()}
        assert len(made) == 7 * 13 and made["short", 1] is None
        for k in range(6):
            want = season(273, 10.0**k)[260:]
            assert np.abs(np.array([made[f"s{k}", h] for h in range(1, 14)]) - want).mean() < 0.12 * 10.0**k * 3


def test_covariates_are_used(spark):
    """A series that repeats last year's units is foretold by them alone."""
    rng = np.random.default_rng(3)
    units = np.concatenate([u := rng.gamma(2, 20, 52)] * 6)[:300]
    rows = [(f, i, d, y, y, 5.0) for f, i, d, y in weekly(units)]
    filled = spark.createDataFrame(rows, "fold int, unique_id string, ds date, y double, units double, arp double")
    ahead = spark.createDataFrame([(0, "a", k + 1, float(u[(300 + k) % 52]), 5.0, 5.0, 1) for k in range(13)], "fold int, unique_id string, step int, units_yago double, arp_yago double, planned_arp double, week_of_year int")
    made = [r.yhat for r in forecasters.ridge_global(filled, PROTOCOL, future=ahead).orderBy("step").collect()]
    assert np.abs(np.array(made) - np.array([u[(300 + k) % 52] for k in range(13)])).mean() < 6


def test_backtest_keeps_failures_and_resumes(spark, tmp_path):
    root, days = f"file://{tmp_path}/store", lambda k: datetime.date(2000, 1, 2) + datetime.timedelta(weeks=k)
    filled = spark.createDataFrame([(0, "a", days(k), float(k % 7)) for k in range(120)], "fold int, unique_id string, ds date, y double")
    actual = spark.createDataFrame([(0, "a", k + 1, days(120 + k), 3.0) for k in range(13)], "fold int, unique_id string, step int, ds date, y double")
    scale = spark.createDataFrame([("a", 2.0, 2.0)], "unique_id string, mase_den double, rmsse_den double")
    calls = []

    def broken(rows, seed):
        calls.append(seed)
        raise RuntimeError("no luck")

    good = backtest.Model("naive", lambda rows, seed: calls.append(seed) or baselines.naive(rows, PROTOCOL), "baseline", repeats=2)
    assert {(r.model, r.status) for r in backtest.run(filled, actual, scale, [good, backtest.Model("bad", broken)], PROTOCOL, root).collect()} == {("naive", "ok"), ("bad", "failed")}
    assert calls == [42, 43, 42]
    metrics, timings = backtest.collect(spark, root)
    assert {r.repeat for r in metrics.select("repeat").distinct().collect()} == {0, 1} and {r.model for r in metrics.select("model").distinct().collect()} == {"naive"}
    assert timings.where("model = 'bad'").first().error.startswith("RuntimeError: no luck") and timings.where("model = 'naive' AND fit_seconds > 0 AND predict_seconds > 0").count() == 4
    assert [r.model for r in backtest.run(filled, actual, scale, [good, backtest.Model("bad", broken)], PROTOCOL, root).collect()] == ["bad"]
    with pytest.raises(ValueError, match="both hold 1 series"):
        backtest.load_ladder(spark, [root, root])
    assert backtest.load_ladder(spark, [f"{root}/none", root])[0].first().n_series == 1


def test_best_parameters_are_read_back(spark, tmp_path):
    assert runs.load_best(spark, f"file://{tmp_path}/none") == ({}, {})
    runs.save_best(spark.createDataFrame([("m", 3, "a=1", 0.5)], "model string, trial int, params string, value double"), 20, f"file://{tmp_path}/best")
    assert runs.load_best(spark, f"file://{tmp_path}/best") == ({"m": "a=1"}, {"m": 20})


def test_contract_names_the_first_series(spark):
    want = spark.createDataFrame([(0, f"s{k}", 1) for k in range(9)], "fold int, unique_id string, step int")
    made = spark.createDataFrame([("m", 0, f"s{k}", 1, 1.0, [1.0, 2.0]) for k in range(2)], "model string, fold int, unique_id string, step int, yhat double, q array<double>")
    with pytest.raises(ValueError, match="7 rows are absent, of series s2, s3, s4, s5, s6 and others"):
        score.assert_contract(want, made)
    with pytest.raises(ValueError, match="no column q"):
        score.assert_contract(want, made.drop("q"))
    assert score.quantile_columns(["yhat_q90", "yhat", "yhat_q10", "yhat_q55"], PROTOCOL.levels) == {0.1: "yhat_q10", 0.9: "yhat_q90"}
    assert split.covariate_roles("Units")["measured"] == ("arp",)


def test_forecast_contract_holds(spark):
    made = forecasters.ridge_global(fixtures.filled(spark, SF), PROTOCOL)
    row = score.contract(fixtures.actual(spark, SF), made).agg({"n_duplicate": "sum", "n_absent": "sum", "n_unexpected": "sum", "n_crossed": "sum"}).first()
    assert all(v == 0 for v in row)
