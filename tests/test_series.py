"""Series are gathered once for all models, dealt by length, and fitted together."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.config import PROTOCOL
from weekloom.operators import backtest, boosting, forecasters, pooled, score


def frame(spark, lengths, folds=(0, 1)):
    rng, rows = np.random.default_rng(3), []
    last = datetime.date(2000, 1, 2)
    for k, n in enumerate(lengths):
        y = 50 + 10 * np.sin(2 * np.pi * np.arange(n) / 52) + rng.normal(0, 2, n)
        rows += [(f, f"s{k:03}", last - datetime.timedelta(weeks=n - i), float(v)) for f in folds for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "fold int, unique_id string, ds date, y double")


def test_a_store_gathers_the_series_once(spark, tmp_path, monkeypatch):
    filled = frame(spark, [160 + k % 3 for k in range(12)])
    steps = F.explode(F.sequence(F.lit(1), F.lit(PROTOCOL.longest))).alias("step")
    actual = filled.select("fold", "unique_id").distinct().select("fold", "unique_id", steps).withColumn("ds", F.date_add(F.lit(datetime.date(2000, 1, 2)), F.col("step") * 7)).withColumn("y", F.lit(50.0))
    models = [backtest.Model(n, lambda rows, _, n=n: forecasters.per_series(rows, n, forecasters.LOCAL[n], PROTOCOL), one_pass=True, gathered=True) for n in ("theta", "ridge_local")]
    models.append(backtest.Model("ridge_global", lambda rows, _: forecasters.ridge_global(rows, PROTOCOL), "global", gathered=True))
    models.append(backtest.Model("gbt_global", lambda rows, seed: boosting.gbt_global(rows, PROTOCOL, trees=4, seed=seed), "global", repeats=2, gathered=True))
    calls, plain = [], pooled.gathered
    monkeypatch.setattr(pooled, "gathered", lambda *a, **k: calls.append(1) or plain(*a, **k))
    done = backtest.run(filled, actual, score.seasonal_denominators(filled.where("fold = 0"), None, 52), models, PROTOCOL, str(tmp_path / "store"), workers=2).collect()
    assert len(done) == 8 and {r.status for r in done} == {"ok"}
    assert len(calls) == 1
    own = spark.read.parquet(str(tmp_path / "store/forecasts/model=theta")).select("fold", "unique_id", "step", "yhat").collect()
    rows = forecasters.per_series(filled, "theta", forecasters.theta, PROTOCOL).select("fold", "unique_id", "step", "yhat").collect()
    assert {tuple(r)[:3]: r.yhat for r in own} == pytest.approx({tuple(r)[:3]: r.yhat for r in rows})


def test_features_of_one_value_are_not_counted(monkeypatch):
    rng, calls, count = np.random.default_rng(5), [], np.bincount
    x = rng.normal(size=(3000, 4))
    y = x[:, 1] * x[:, 2] + rng.normal(size=3000)
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    model = boosting.grown(x, y, 6, 4, 1)
    without = len(calls)
    more = boosting.grown(np.column_stack([np.ones(3000), x]), y, 6, 4, 1)
    assert len(calls) == 2 * without
    assert np.array_equal(np.where(model.cut < 64, model.feature + 1, 0), np.where(more.cut < 64, more.feature, 0)) and np.array_equal(model.leaf, more.leaf)


def test_lengths_lie_together(spark):
    series = pooled.series_of(frame(spark, [60 + k % 37 for k in range(222)]))
    dealt = pooled.by_length(series).select(F.spark_partition_id().alias("task"), F.size("context").alias("n"))
    tasks, met = dealt.select("task").distinct().count(), dealt.distinct().count()
    assert dealt.count() == 444 and tasks > 1
    assert met < 37 + tasks  # a length is in two tasks only at their border


@pytest.mark.parametrize("name", ["ridge_local", "fourier_trend"])
def test_series_of_one_length_are_fitted_together(name):
    fit = getattr(forecasters, name)
    rng, sizes = np.random.default_rng(6), []
    series = [rng.normal(10, 3, n) * 10.0 ** (k % 3) for k, n in enumerate([120, 3, 90, 120, 53, 120, 90, 0, 52] * 3)]

    def counted(y, *rest, **more):
        sizes.append(y.shape)
        return fit(y, *rest, **more)

    points, spreads = forecasters.by_lengths(counted, most=8)(series, 13, 52)
    if name == "fourier_trend":
        assert len(sizes) == 5 and (8, 120) in sizes  # 9 of 120 weeks in two blocks, 90, 53 and 52
    alone = forecasters.one_by_one(fit)(series, 13, 52)
    assert np.allclose(points, alone[0], equal_nan=True, rtol=1e-8) and np.allclose(spreads, alone[1], equal_nan=True, rtol=1e-6)
    assert np.isnan(points[1]).all() and np.isfinite(points[0]).all()


def test_a_store_scores_its_units_by_one_join(spark, tmp_path, monkeypatch):
    filled = frame(spark, [160 + k % 3 for k in range(6)])
    steps = F.explode(F.sequence(F.lit(1), F.lit(PROTOCOL.longest))).alias("step")
    actual = filled.select("fold", "unique_id").distinct().select("fold", "unique_id", steps).withColumn("ds", F.date_add(F.lit(datetime.date(2000, 1, 2)), F.col("step") * 7)).withColumn("y", F.when(F.col("step") != 2, F.lit(50.0)))
    scale = score.seasonal_denominators(filled.where("fold = 0"), None, 52)
    model = backtest.Model("ridge_local", lambda rows, _: forecasters.per_series(rows, "ridge_local", forecasters.LOCAL["ridge_local"], PROTOCOL), one_pass=True, gathered=True)
    joins, joined = [], score._scored
    monkeypatch.setattr(score, "_scored", lambda *a, **k: joins.append(1) or joined(*a, **k))
    assert {r.status for r in backtest.run(filled, actual, scale, [model], PROTOCOL, str(tmp_path / "store")).collect()} == {"ok"}
    assert len(joins) == 1
    made = spark.read.parquet(str(tmp_path / "store/forecasts")).drop("repeat")
    want = score.score_point(actual, made, scale, PROTOCOL).unionByName(score.score_quantile(actual, made, PROTOCOL))
    key = lambda r: (r.fold, r.horizon, r.unique_id, r.metric)
    got = {key(r): (r.value, r.n_points, r.n_undefined) for r in spark.read.parquet(str(tmp_path / "store/metrics")).collect()}
    wanted = {key(r): (r.value, r.n_points, r.n_undefined) for r in want.collect()}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k]) for k in got)
