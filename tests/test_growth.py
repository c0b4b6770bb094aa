"""Steps whose work per row must not grow with a series or with the number of series."""

import datetime
import hashlib

import numpy as np
import pytest

from weekloom.config import PROTOCOL
from weekloom.operators import arima, backtest, baselines, forecasters, panel, smoothing, split, stats

DAY = datetime.date(1995, 1, 1)


def test_gaps_are_filled_by_frames_that_only_grow(spark):
    """A frame up to the last row is read anew for every row, which squares the length of a series."""
    rng = np.random.default_rng(5)
    values = {k: np.where(rng.random(80) < 0.4, np.nan, rng.normal(50, 9, 80)) for k in range(4)} | {4: np.full(80, np.nan)}
    rows = [(f"s{k}", DAY + datetime.timedelta(weeks=w), None if np.isnan(v) else float(v)) for k, y in values.items() for w, v in enumerate(y)]
    made = split.impute(spark.createDataFrame(rows, "unique_id string, ds date, y double"))
    assert "unboundedfollowing" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    for k, y in values.items():
        got = [r.y for r in made.where(f"unique_id = 's{k}'").orderBy("ds").collect()]
        known = np.flatnonzero(~np.isnan(y))
        want = [None if not len(known) or w < known[0] else float(np.interp(w, known, y[known])) for w in range(80)]
        assert [g is None for g in got] == [w is None for w in want]
        assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None])


def test_grid_takes_statics_from_either_side_by_frames_that_only_grow(spark):
    rows = [("a@@x", DAY + datetime.timedelta(weeks=w), float(w), 1.0, 1.0, i, "x") for w, i in ((0, None), (3, "a"), (5, None))]
    made = panel.grid(spark.createDataFrame(rows, "unique_id string, ds date, y double, units double, arp double, internal_id string, geography string"), PROTOCOL)
    assert "unboundedfollowing" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = made.orderBy("ds").collect()
    assert [r.internal_id for r in got] == ["a"] * 6 and [r.y for r in got] == [0.0, 0.0, 0.0, 3.0, 0.0, 5.0]


def drawn_one_by_one(rows: dict[str, list[float | None]], resamples: int, seed: str) -> list[float]:
    """Medians of resamples of the series, by the definition."""
    names, out = sorted(rows), []
    for b in range(resamples):
        own = [v for i in range(len(names)) for v in rows[names[int(hashlib.md5(f"{seed}|{b}|{i}".encode()).hexdigest()[:12], 16) % len(names)]] if v is not None]
        out.append(float(np.median(own)) if own else np.nan)
    return out


def test_median_band_is_that_of_its_definition_and_draws_once_for_groups_of_a_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    groups = {"a": 90, "b": 90, "c": 7, "d": 2}
    made = {g: {f"s{k}": [None if rng.random() < 0.2 else round(float(v), 1) for v in rng.gamma(2, 2, 1 + k % 5)] for k in range(n)} for g, n in groups.items()}
    made["e"] = {"s0": [None], "s1": [None]}
    rows = spark.createDataFrame([(g, s, v) for g, own in made.items() for s, vs in own.items() for v in vs], "model string, unique_id string, value double")
    seen = []
    whole = stats.written
    monkeypatch.setattr(stats, "written", lambda frame: seen.append(frame.columns) or whole(frame))
    got = {r.model: r for r in stats.bootstrap_median_band(rows, ["model"], 40, "7").collect()}
    assert set(got) == set(made) and got["e"].low is None and ["drawn", "gids", "own"] in seen
    for g in groups:
        want = drawn_one_by_one(made[g], 40, "7")
        assert (got[g].low, got[g].high) == pytest.approx(tuple(np.nanpercentile(want, [2.5, 97.5])))


def test_folds_of_a_model_go_in_one_job_and_failures_are_told_by_fold(spark, tmp_path):
    root, days = f"file://{tmp_path}/store", lambda k: DAY + datetime.timedelta(weeks=k)
    filled = spark.createDataFrame([(f, "a", days(k), float(k % 7)) for f in range(3) for k in range(60)], "fold int, unique_id string, ds date, y double")
    actual = spark.createDataFrame([(f, "a", k + 1, days(60 + k), 3.0) for f in range(3) for k in range(13)], "fold int, unique_id string, step int, ds date, y double")
    scale = spark.createDataFrame([("a", 2.0, 2.0)], "unique_id string, mase_den double, rmsse_den double")
    calls, bad = [], [True]

    def fit(name):
        def run(rows, seed):
            own = sorted(r[0] for r in rows.select("fold").distinct().collect())
            calls.append((name, own))
            if name == "odd" and bad[0] and 1 in own:
                raise RuntimeError("no luck")
            return baselines.naive(rows, PROTOCOL)

        return run

    models = [backtest.Model(n, fit(n)) for n in ("even", "odd")]
    done = {(r.model, r.fold): r.status for r in backtest.run(filled, actual, scale, models, PROTOCOL, root).collect()}
    assert done == {(m, f): "failed" if (m, f) == ("odd", 1) else "ok" for m in ("even", "odd") for f in range(3)}
    assert calls == [("even", [0, 1, 2]), ("odd", [0, 1, 2]), ("odd", [0]), ("odd", [1]), ("odd", [2])]
    before = backtest.collect(spark, root)[0].where("model = 'even'").count()
    bad[0] = False
    assert [(r.model, r.fold, r.status) for r in backtest.run(filled, actual, scale, models, PROTOCOL, root).collect()] == [("odd", 1, "ok")]
    metrics, timings = backtest.collect(spark, root)
    assert metrics.where("model = 'even'").count() == before == metrics.where("model = 'odd'").count()
    assert timings.count() == 2 * 3 * 2 and timings.where("status <> 'ok'").count() == 0


def test_smoothing_goes_in_batches_and_fits_no_error_that_a_series_lacks(monkeypatch):
    rng = np.random.default_rng(3)
    series = [rng.gamma(2, 30, 40 + k % 5) * (k % 2 or rng.random(40 + k % 5) > 0.2) for k in range(20)]
    want = smoothing.chosen(series, 6, 12)[:2]
    monkeypatch.setattr(smoothing, "TOGETHER", 8)
    sizes, whole = [], smoothing.Batch.fitted

    def fitted(self, form, *rest, errors="AM", **more):
        sizes.append(len(self.n))
        assert errors == "A" or self.positive.all()
        return whole(self, form, *rest, errors=errors, **more)

    monkeypatch.setattr(smoothing.Batch, "fitted", fitted)
    got = smoothing.ets(series, 6, 12)
    assert np.allclose(got, want, rtol=1e-9) and max(sizes) <= 8


def test_arima_goes_in_batches_and_blocks_of_weeks(monkeypatch):
    rng = np.random.default_rng(4)
    series = [rng.gamma(2, 30, 60 + k % 5) for k in range(12)]
    order = arima.Order(2, 2, 1, 1)
    fit, u = arima.Fit([y - y.mean() for y in series], 12), rng.normal(0, 0.5, (3, 12, order.size))
    made = fit.innovations(order, u)
    ar, ma = fit.parts(order, u)
    for c in range(3):
        for k, y in enumerate(series):
            x, e = y - y.mean(), []
            for t in range(len(y)):
                e.append(x[t] - sum(w[c, k] * x[t - lag] for lag, w in ar if lag <= t) + sum(w[c, k] * e[t - lag] for lag, w in ma if lag <= t))
            assert np.allclose(made[fit.start[k] :, c, k], e) and not made[: fit.start[k], c, k].any()
    want, sizes, whole = arima.arima(series, 6, 12), [], arima.Fit.fitted
    monkeypatch.setattr(arima, "TOGETHER", 5)
    monkeypatch.setattr(arima.Fit, "fitted", lambda self, *rest: sizes.append(len(self.n)) or whole(self, *rest))
    assert np.allclose(arima.arima(series, 6, 12), want, rtol=1e-6) and max(sizes) <= 5


def test_series_of_global_models_are_dealt_to_all_cores_and_repeated_models_begin_first(spark, tmp_path):
    rows = spark.createDataFrame([(0, f"s{k}", DAY + datetime.timedelta(weeks=w), float(k + w % 5 + 1)) for k in range(3) for w in range(70)], "fold int, unique_id string, ds date, y double")
    for made in (forecasters.ridge_global(rows, PROTOCOL), forecasters.gbt_global(rows, PROTOCOL, trees=2, depth=2)):
        assert "RepartitionByExpression" in made._jdf.queryExecution().optimizedPlan().toString() and made.count() == 3 * PROTOCOL.longest
    calls = []
    models = [backtest.Model(n, lambda rows, _, n=n: calls.append(n) or baselines.naive(rows, PROTOCOL), repeats=r) for n, r in (("once", 1), ("often", 2))]
    actual = spark.createDataFrame([(0, f"s{k}", h, DAY, 1.0) for k in range(3) for h in range(1, PROTOCOL.longest + 1)], "fold int, unique_id string, step int, ds date, y double")
    scale = spark.createDataFrame([("s0", 1.0, 1.0)], "unique_id string, mase_den double, rmsse_den double")
    backtest.run(rows, actual, scale, models, PROTOCOL, f"file://{tmp_path}/store")
    assert calls == ["often", "often", "once"]
