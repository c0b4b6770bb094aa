"""Pooled models from summed moments, and the ladder's prefix sums against fits on each rung by itself."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.config import PROTOCOL
from weekloom.operators import pooled
from weekloom.plans import fixtures
from weekloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def frame(spark, n=14, weeks=230):
    rng, rows = np.random.default_rng(1), []
    for k in range(n):
        y = 50 * (k + 1) + 10 * np.sin(np.arange(weeks - 9 * (k % 3)) * 2 * np.pi / 52) + rng.normal(0, 4, weeks - 9 * (k % 3))
        rows += [(f, f"s{k:02}", datetime.date(1995, 1, 1) + datetime.timedelta(weeks=i), float(v)) for f in (0, 1) for i, v in enumerate(y[: len(y) - 4 * (1 - f)])]
    rows += [(0, "short", datetime.date(1995, 1, 1), 1.0)]
    return spark.createDataFrame(rows, "fold int, unique_id string, ds date, y double")


@pytest.mark.parametrize("make", [pooled.lagged, pooled.direct])
def test_rungs_are_fits_on_their_own_series(spark, make):
    filled, model = frame(spark), make(PROTOCOL)
    ids = [f"s{k:02}" for k in (3, 7, 1, 0, 12, 5, 9, 2, 4, 13)] + ["short"]
    rungs = spark.createDataFrame([(i, n) for n in (3, 6, 11) for i in ids[:n]], "unique_id string, n_series long")
    got = {(r.n_series, r.fold, r.unique_id, r.step): (r.yhat, *(r.q or ())) for r in pooled.ladder(filled, rungs, [model], PROTOCOL).collect()}
    assert {k[0] for k in got} == {3, 6, 11} and {k[2] for k in got} == set(ids[:3])
    for n in (3, 6, 11):
        alone = pooled.forecast(filled.where(F.col("unique_id").isin(ids[:n])), model, PROTOCOL).where(F.col("unique_id").isin(ids[:3])).collect()
        assert len(alone) == 3 * 2 * 13
        for r in alone:
            assert got[n, r.fold, r.unique_id, r.step] == pytest.approx((r.yhat, *r.q))
    every = pooled.ladder(filled, rungs, [model], PROTOCOL, series=filled.select("unique_id").distinct())
    assert every.count() == (14 * 2 + 1) * 13 * 3 and every.where("unique_id = 'short' AND yhat IS NOT NULL").count() == 0


def test_all_penalties_from_one_decomposition():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 6)), rng.normal(size=(50, 3))
    moments = pooled.Moments.of(x[:20], y[:20]) + pooled.Moments.of(x[20:], y[20:])
    back = pooled.Moments.unflat(moments.flat(), 3)
    for penalty, (coef, sigma) in zip((0.0, 0.1, 50.0), back.solved([0.0, 0.1, 50.0]), strict=True):
        want = np.linalg.solve(x.T @ x + penalty * np.eye(6), x.T @ y)
        assert np.allclose(coef, want) and np.allclose(sigma, np.sqrt(((y - x @ want) ** 2).mean(axis=0)))


def test_stacked_covariates_are_those_of_single_series():
    import pandas as pd

    rng = np.random.default_rng(3)
    row = lambda n: {"units": [None if rng.random() < 0.2 else float(v) for v in rng.gamma(2, 9, n)], "arp": [float(v) for v in rng.gamma(2, 1, n)], "week": [int(k % 52 + 1) for k in range(n)], **{c: [None if rng.random() < 0.3 else float(v) for v in rng.gamma(2, 3, 13)] for c in pooled.AHEAD}}
    rows = pd.DataFrame([row(80), row(80), {**row(80), "units": [None] * 80}])
    whole = pooled.known_of(rows, 80)
    assert whole.shape == (3, 93, 5) and np.isfinite(whole).all()
    for k in range(3):
        r = rows.iloc[k]
        fill = lambda x: pd.Series(np.asarray(x, float)).ffill().bfill().fillna(0.0).to_numpy()
        units, yago = fill(r["units"]), fill(r["units_yago"])
        size = max(np.abs(units).mean(), 1e-9)
        assert np.allclose(whole[k, :, 0], np.r_[np.zeros(52), units[:28], yago] / np.r_[np.full(80, size), np.full(13, size)])
    assert np.allclose(pooled.known_of(rows.iloc[[1]], 80)[0], whole[1])


def test_fitted_ladder_on_the_tables(spark):
    rows = QUERIES["ladder_fitted"](spark, SF).collect()
    sizes = {r.n_series for r in fixtures.nested(spark, SF).select("n_series").distinct().collect()}
    assert {(r.model, r.n_series) for r in rows} == {(m, n) for m in ("ridge_global", "linear_global") for n in sizes}
    for r in rows:
        assert r.eval_series == min(sizes)
        for h in (4, 13):
            assert r[f"MASE_h{h}"] is None or r[f"MASE_h{h}_lo"] <= r[f"MASE_h{h}"] <= r[f"MASE_h{h}_hi"]
    tests = QUERIES["ladder_fitted_tests"](spark, SF)
    assert tests.where("p_value IS NULL").count() == 0 and tests.count() == 2 * 2 * (1 + len(sizes))


def test_series_of_one_length_are_stacked_a_bounded_number_at_once():
    import pandas as pd

    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"fold": [0, 1] * 700, "unique_id": [f"s{k}" for k in range(1400)], "context": [rng.random(130) for _ in range(1400)]})
    found = list(pooled.stacks(rows, ["fold"]))
    assert max(len(v) for _, _, v, _, _ in found) <= 512
    assert sorted(k for _, places, _, _, _ in found for k in places) == list(range(1400))
    for (fold,), places, v, scale, _ in found:
        assert all(rows["fold"][k] == fold and np.allclose(v[i] * scale[i], rows["context"][k]) for i, k in enumerate(places))
