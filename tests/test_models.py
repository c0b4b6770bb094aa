"""The per-series models: fitted smoothing, seasonal ARIMA and the sparse trend, on series of which the truth is known."""

from collections import Counter

import numpy as np
import pytest

from weekloom.config import PROTOCOL
from weekloom.operators import arima, forecasters, smoothing, trend
from weekloom.plans.queries import QUERIES


def noisy(seed, n, level=100.0, slope=0.0, season=0.0, noise=5.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return level + slope * t + season * np.sin(2 * np.pi * t / 12) + rng.normal(0, noise, n)


# -- exponential smoothing


def plain_loss(y, form, season, p, batch, k):
    """Both likelihoods of one series by the textbook recursion."""
    alpha, beta, gamma, phi = p
    level, slope = batch.level[k], batch.slope[k] if form.trend != "N" else 0.0
    states = list((batch.times if form.season == "M" else batch.added)[:, k]) if form.season != "N" else [1.0 if form.season == "M" else 0.0] * season
    squares, shares, logs, n, bad = 0.0, 0.0, 0.0, 0, False
    for t, v in enumerate(y):
        base = level + (phi if form.trend == "Ad" else 1.0) * slope
        s = states[t % season]
        fit = base * s if form.season == "M" else base + s
        e = v - fit
        if batch.judged[batch.start[k] + t, k]:
            n += 1
            squares += e * e
            bad |= fit <= 1e-9
            if fit > 1e-9:
                shares, logs = shares + (e / fit) ** 2, logs + np.log(fit)
        a, b = (e / s, e / base) if form.season == "M" else (e, e)
        level, slope = base + alpha * a, ((phi if form.trend == "Ad" else 1.0) * slope + alpha * beta * a if form.trend != "N" else 0.0)
        if form.season != "N":
            states[t % season] = s + gamma * (1 - alpha) * b
    return n * np.log(max(squares / n, 1e-12)), np.inf if bad else n * np.log(max(shares / n, 1e-12)) + 2 * logs


@pytest.mark.parametrize("form", [f for f in smoothing.FORMS if f.error == "A"])
def test_smoothing_recursion_and_its_fit(form):
    series = [noisy(k, n, 1.0 + k, 0.01 * k, 0.3, 0.05) for k, n in enumerate((60, 41, 24, 30))]
    batch = smoothing.Batch(series, 12)
    rng = np.random.default_rng(1)
    p = rng.uniform(smoothing.LOW, smoothing.HIGH, (3, 4, 4))
    losses = batch.loss(form, p)
    for c in range(3):
        for k, y in enumerate(series):
            assert losses[:, c, k] == pytest.approx(plain_loss(y, form, 12, p[c, k], batch, k))
    best, loss = batch.fitted(form)
    grid = np.array([[x if k in form.free else 0.0 for k, x in enumerate(row)] for row in smoothing.GRID])
    on_grid = batch.loss(form, np.repeat(grid[:, None, :], 4, axis=1)).min(axis=1)
    assert (loss <= on_grid + 1e-9).all() and (loss < on_grid - 1e-6).any()
    assert ((best >= smoothing.LOW - 1e-12) | (best == 0)).all() and (best <= smoothing.HIGH + 1e-12).all()
    assert np.allclose(np.diagonal(batch.loss(form, best), axis1=0, axis2=1).T, loss)


def test_smoothing_takes_the_form_of_least_aicc():
    t = np.arange(120)
    rng = np.random.default_rng(4)
    times = (50 + 2 * t) * (1 + 0.5 * np.sin(2 * np.pi * t / 12)) * (1 + rng.normal(0, 0.01, 120))
    added = 300 + 40 * np.sin(2 * np.pi * t / 12) + rng.normal(0, 2, 120)
    flat = 50 + rng.normal(0, 3, 120)
    points, spreads, forms, score = smoothing.chosen([times, added, flat, -added], 12, 12)
    assert forms[0].season == "M" and forms[0].trend != "N" and forms[1].season != "N" and forms[2].season == "N" and forms[3].error == "A" and forms[3].season != "M"
    ahead = np.arange(120, 132)
    assert np.abs(points[0] - (50 + 2 * ahead) * (1 + 0.5 * np.sin(2 * np.pi * ahead / 12))).mean() < 15
    assert np.abs(points[1] - 300 - 40 * np.sin(2 * np.pi * ahead / 12)).mean() < 6
    alone = [smoothing.chosen([times], 12, 12, (f,))[3][0] for f in smoothing.FORMS]
    assert score[0] == pytest.approx(min(alone)) and (np.diff(spreads[2]) >= 0).all()


# -- seasonal ARIMA


def simulated(seed, ar, ma, n=300, d=0, seasonal=0):
    rng = np.random.default_rng(seed)
    e, x = rng.normal(0, 1, n + 100), np.zeros(n + 100)
    for t in range(30, n + 100):
        x[t] = sum(w * x[t - k] for k, w in ar.items()) + e[t] - sum(w * e[t - k] for k, w in ma.items())
    x = x[100:]
    for _ in range(d):
        x = np.cumsum(x)
    for _ in range(seasonal):
        for t in range(12, n):
            x[t] += x[t - 12]
    return x


@pytest.mark.parametrize(("ar", "ma", "d", "order"), [({1: 0.7}, {}, 0, (1, 0)), ({}, {1: -0.6}, 0, (0, 1)), ({1: 0.5, 2: -0.4}, {}, 0, (2, 0)), ({}, {1: 0.7}, 1, (0, 1))])
def test_arima_finds_planted_orders(ar, ma, d, order):
    series = [simulated(k, ar, ma, d=d) + 50 for k in range(24)]
    _, _, found = arima.chosen(series, 4, 52, tuple(o for o in arima.ORDERS if not o.sp + o.sq))
    (most, times), *_ = Counter(((f.order.p, f.order.q), f.d) for f in found).most_common()
    assert most == (order, d) and times >= 12
    fit = arima.Fit([np.diff(s) if d else s - s.mean() for s in series], 52)
    u, _ = fit.fitted(arima.Order(*order, 0, 0))
    weights = dict(fit.parts(arima.Order(*order, 0, 0), u)[0 if ar else 1])
    assert all(abs(float(np.median(weights[k])) - w) < 0.1 for k, w in (ar or ma).items())


def test_arima_seasonal_orders_and_differences():
    series = [simulated(k, {12: 0.6}, {}, 240) + 20 for k in range(10)]
    _, _, found = arima.chosen(series, 4, 12)
    assert Counter(f.order.sp for f in found)[1] >= 6
    strong = [100 + 30 * np.sin(2 * np.pi * np.arange(200) / 12) + np.random.default_rng(k).normal(0, 2, 200) for k in range(5)]
    points, _, found = arima.chosen(strong, 12, 12)
    assert all(f.seasonal for f in found)
    assert np.abs(points - (100 + 30 * np.sin(2 * np.pi * np.arange(200, 212) / 12))).mean() < 3
    assert arima.kpss(simulated(1, {1: 0.3}, {})) < arima.KPSS_LIMIT < arima.kpss(np.cumsum(simulated(1, {}, {})))


def test_arima_forecast_of_a_known_process():
    """Points decay by the coefficient, and the spread adds up its powers."""
    y = simulated(3, {1: 0.8}, {}, 400)
    fit, order = arima.Fit([y], 52), arima.Order(1, 0, 0, 0)
    w, answer = fit.ahead(order, np.array([[np.arctanh(0.8)]]), 6, np.zeros(1))
    assert np.allclose(w[0], y[-1] * 0.8 ** np.arange(1, 7)) and np.allclose(answer[0], 0.8 ** np.arange(6))
    for d, seasonal in ((1, 0), (2, 0), (0, 1), (1, 1)):
        x = simulated(5, {1: 0.4}, {}, 90, d, seasonal)
        known = x[:78]
        rest = x[12:] - x[:-12] if seasonal else x
        for _ in range(d):
            rest = np.diff(rest)
        back, reply = arima.undone(known, rest[-12:], np.r_[1.0, np.zeros(11)], d, seasonal, 12)
        assert np.allclose(back, x[78:]) and reply[0] == 1


def test_weights_are_stationary():
    rng = np.random.default_rng(2)
    for size in (1, 2, 3):
        for w in arima.lag_weights(np.tanh(rng.normal(0, 1.5, (50, size)))):
            assert np.abs(np.roots(np.r_[1, -w])).max() < 1


# -- sparse trend


def test_sparse_trend_finds_a_planted_bend():
    t = np.arange(208)
    series = np.array([100 + 0.5 * t - 1.5 * np.maximum(t - 90, 0) + 10 * np.sin(2 * np.pi * t / 52) + np.random.default_rng(k).normal(0, 3, 208) for k in range(30)])
    d = trend.design(208, 13, 52, 25, 0.95, 6)
    f = trend.fitted(series / np.abs(series).mean(axis=1, keepdims=True), d)
    bends = np.abs(f.coef[:, d.bends])
    centre = (bends * d.points).sum(axis=1) / bends.sum(axis=1)
    assert (np.abs(centre - 90) < 12).all() and (bends > 1e-9).sum(axis=1).mean() < 6
    straight = np.array([100 + 0.5 * t + np.random.default_rng(k).normal(0, 3, 208) for k in range(30)])
    f = trend.fitted(straight / np.abs(straight).mean(axis=1, keepdims=True), d)
    assert np.median((np.abs(f.coef[:, d.bends]) > 1e-9).sum(axis=1)) == 0


def test_descent_meets_the_conditions_of_its_minimum():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 8)), rng.normal(size=(4, 60)) * 3
    gram, xy, soft, ridge = x.T @ x, y @ x, np.full((4, 8), 9.0), np.full(8, 0.5)
    coef = trend.descended(gram, xy, np.zeros((4, 8)), soft, ridge, 500)
    slope = xy - coef @ gram - coef * ridge
    assert np.allclose(slope[coef != 0], 9.0 * np.sign(coef[coef != 0]), atol=1e-4) and (np.abs(slope) <= 9.0 + 1e-4).all() and (coef == 0).any()


@pytest.mark.parametrize(("often", "size"), [(0.02, 0.8), (0.01, 0.5)])
def test_sparse_trend_covers_what_it_says(often, size):
    rng, series, ahead = np.random.default_rng(6), [], []
    for _ in range(300):
        y = 200 + np.cumsum(0.2 + np.cumsum(np.where(rng.random(221) < often, rng.laplace(size=221) * size, 0))) + 8 * np.sin(2 * np.pi * np.arange(221) / 52) + rng.normal(0, 4, 221)
        series.append(y[:208])
        ahead.append(y[208:])
    _, _, q = trend.sparse_trend(series, 13, 52, levels=(0.1, 0.9))
    ahead = np.array(ahead)
    assert 0.74 < ((ahead >= q[:, :, 0]) & (ahead <= q[:, :, 1])).mean() < 0.9


@pytest.mark.parametrize("name", ["ets", "arima", "sparse_trend"])
def test_queries_keep_the_contract(spark, name):
    from weekloom.operators import score
    from weekloom.plans import fixtures

    sf = "/root/testdata/sf0.001"
    made = forecasters.per_series(fixtures.filled(spark, sf), name, forecasters.LOCAL[name], PROTOCOL)
    score.assert_contract(fixtures.actual(spark, sf), made)
    assert made.where("yhat IS NULL").count() == 0
    assert QUERIES[f"forecast_{name}"](spark, sf).count() == made.count()
