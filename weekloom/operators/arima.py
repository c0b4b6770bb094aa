"""Seasonal ARIMA by conditional likelihood, for many series at once.

A series is differenced once at the season's lag if its seasonal pattern is strong, and then up to twice at lag 1 for as long as a
KPSS test rejects a constant level.  For what is left, every order (p, q)(P, Q) is fitted: innovations are computed week by week for all
series together, and their sum of squares is lowered by damped Gauss-Newton steps.  Parameters are partial autocorrelations behind a tanh, so every point
of the search is stationary and invertible.  The order is chosen for each series by AICc.
"""

from __future__ import annotations

from itertools import product
from typing import NamedTuple

import numpy as np

from weekloom.operators.smoothing import Aligned, aicc

SHORTEST = 10
#: Series that are fitted at a time, and weeks whose innovations are: larger arrays leave the processor's cache, and memory would grow with a task.
TOGETHER, BLOCK = 512, 52
#: Critical value of the KPSS test for a level at 5 percent, and the strength from which a season is differenced.
KPSS_LIMIT, STRONG = 0.463, 0.64


class Order(NamedTuple):
    p: int
    q: int
    sp: int
    sq: int

    @property
    def size(self) -> int:
        return sum(self)


ORDERS = [Order(p, q, sp, sq) for p, q, sp, sq in product(range(3), range(3), range(2), range(2))]


def kpss(w: np.ndarray) -> float:
    """The KPSS statistic for a constant level, with Bartlett weights."""
    n = len(w)
    e = w - w.mean()
    lags = int(4 * (n / 100) ** 0.25)
    spread = float(e @ e) + 2 * sum((1 - k / (lags + 1)) * float(e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float((np.cumsum(e) ** 2).sum() / n / max(spread, 1e-12 * max(float(w @ w), 1e-300)))


def strength(y: np.ndarray, season: int) -> float:
    """Share of the detrended variance that the mean season takes, 0 to 1, freed of what chance would give it."""
    n = len(y)
    pad = np.concatenate([np.full(season // 2, y[0]), y, np.full(season - season // 2 - 1, y[-1])])
    x = (y - np.convolve(pad, np.ones(season) / season, "valid"))[: n // season * season].reshape(-1, season)
    total = float(((x - x.mean()) ** 2).sum())
    rest = float(((x - x.mean(axis=0)) ** 2).sum()) * (x.size - 1) / max(x.size - season, 1)
    return max(0.0, 1 - rest / total) if total > 0 else 0.0


def differenced(y: np.ndarray, season: int) -> tuple[np.ndarray, int, int]:
    """The differenced series, and how often at lag 1 and at the season's."""
    seasonal = int(season > 1 and len(y) >= 2 * season + SHORTEST and strength(y, season) > STRONG)
    w = y[season:] - y[:-season] if seasonal else y
    d = 0
    while d < 2 and len(w) > SHORTEST and np.ptp(w) > 0 and kpss(w) > KPSS_LIMIT:
        w, d = np.diff(w), d + 1
    return w, d, seasonal


def lag_weights(partial: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression from partial autocorrelations (last axis), by Durbin and Levinson."""
    out = partial[..., :1]
    for k in range(1, partial.shape[-1]):
        r = partial[..., k : k + 1]
        out = np.concatenate([out - r * out[..., ::-1], r], axis=-1)
    return out


def polynomial(short: np.ndarray, long: np.ndarray, season: int) -> list[tuple[int, np.ndarray]]:
    """Lags and weights of (1 - short)(1 - long at the season) = 1 - sum of weight * lag."""
    own = [(k + 1, short[..., k]) for k in range(short.shape[-1])]
    if not long.shape[-1]:
        return own
    s = long[..., 0]
    return [*own, (season, s), *[(season + k, -s * w) for k, w in own]]


class Fit(Aligned):
    """Differenced series of any lengths, without their mean, and their innovations."""

    def __init__(self, series: list[np.ndarray], season: int):
        super().__init__(series)
        self.season = season
        self.on, self.last = np.arange(self.rows)[:, None] >= self.start, int(self.start.max())

    def parts(self, order: Order, u: np.ndarray) -> tuple[list, list]:
        """Autoregressive and moving-average lags with weights, from free parameters (last axis: p, P, q, Q)."""
        r = np.tanh(u)
        p, sp, q = order.p, order.p + order.sp, order.p + order.sp + order.q
        cut = lambda a, b: lag_weights(r[..., a:b]) if b > a else r[..., :0]
        return polynomial(cut(0, p), cut(p, sp), self.season), polynomial(cut(sp, q), cut(q, order.size), self.season)

    def innovations(self, order: Order, u: np.ndarray) -> np.ndarray:
        """rows x candidates x series, for parameters of candidates x series x size; nothing is known before a series begins."""
        ar, ma = ([(lag, np.ascontiguousarray(w)) for lag, w in side] for side in self.parts(order, u))
        out, part = np.empty((self.rows, *u.shape[:2])), np.empty((BLOCK, *u.shape[:2]))
        size = min(self.season, BLOCK) if any(lag >= self.season for lag, _ in ma) else BLOCK
        near, far = [(lag, w) for lag, w in ma if lag < size], [(lag, w) for lag, w in ma if lag >= size]
        for lo in range(0, self.rows, size):  # some weeks at a time, so that the arrays at work stay in the processor's cache
            hi = min(lo + size, self.rows)
            out[lo:hi] = self.y[lo:hi, None, :]
            for lag, w in ar:
                if (first := max(lo, lag)) < hi:
                    out[first:hi] -= np.multiply(w, self.y[first - lag : hi - lag, None, :], out=part[: hi - first])
            if lo < self.last:
                out[lo:hi] *= self.on[lo:hi, None, :]
            for lag, w in far:  # these innovations are all from before the block
                if (first := max(lo, lag)) < hi:
                    out[first:hi] += np.multiply(w, out[first - lag : hi - lag], out=part[: hi - first])
            if far and lo < self.last:
                out[lo:hi] *= self.on[lo:hi, None, :]
            for t in range(lo, hi) if near else ():
                for lag, w in near:
                    if lag <= t:
                        out[t] += np.multiply(w, out[t - lag], out=part[0])
                if t < self.last:
                    out[t] *= self.on[t]
        return out

    def fitted(self, order: Order, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Parameters (series x size) and mean squares of the innovations."""
        n, size = len(self.n), order.size
        u = np.full((n, size), 0.1)
        if not size:
            return u, (self.innovations(order, u[None])[:, 0] ** 2).sum(axis=0) / self.n
        step, damping, base = 1e-4, np.full(n, 1e-2), self.innovations(order, u[None])[:, 0]
        for _ in range(rounds):
            tried = np.repeat(u[None], size, axis=0)
            tried[np.arange(size), :, np.arange(size)] += step
            loss = (base**2).sum(axis=0)
            slopes = self.innovations(order, tried)
            slopes -= base[:, None]
            slopes /= step  # rows x size x series
            normal, right = np.einsum("tis,tjs->sij", slopes, slopes), -np.einsum("tis,ts->si", slopes, base)
            weight = np.maximum(np.einsum("sii->si", normal), 1e-12)
            moves = [np.linalg.solve(normal + (damping * f)[:, None, None] * (weight[:, :, None] * np.eye(size)) + 1e-12 * np.eye(size), right[..., None])[..., 0] for f in (1.0, 30.0)]
            options = np.clip(u + np.stack(moves), -3.0, 3.0)
            moved = self.innovations(order, options)
            losses = (moved**2).sum(axis=0)
            at = losses.argmin(axis=0)
            lower = losses[at, np.arange(n)]
            better = lower < loss
            u = np.where(better[:, None], options[at, np.arange(n)], u)
            base = np.where(better, np.where(at == 1, moved[:, 1], moved[:, 0]), base)
            loss, damping = np.where(better, lower, loss), np.clip(np.where(better, damping * np.where(at == 1, 3.0, 0.3), damping * 10), 1e-6, 1e4)
        return u, loss / self.n

    def ahead(self, order: Order, u: np.ndarray, steps: int, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forecasts of the differenced series (series x steps) and the weights of past innovations, of which the first is 1."""
        ar, ma = self.parts(order, u[None])
        e = self.innovations(order, u[None])[:, 0]
        path, noise = np.concatenate([self.y, np.zeros((steps, len(self.n)))]), np.concatenate([e, np.zeros((steps, len(self.n)))])
        pulse, answer = np.zeros((steps, len(self.n))), np.zeros((steps, len(self.n)))
        pulse[0] = 1.0
        for t in range(self.rows, self.rows + steps):
            path[t] = sum((w[0] * path[t - lag] for lag, w in ar if lag <= t), np.zeros(len(self.n))) - sum((w[0] * noise[t - lag] for lag, w in ma if lag <= t), np.zeros(len(self.n)))
        for k in range(steps):
            answer[k] = pulse[k] + sum((w[0] * answer[k - lag] for lag, w in ar if lag <= k), np.zeros(len(self.n))) - sum((w[0] * pulse[k - lag] for lag, w in ma if lag <= k), np.zeros(len(self.n)))
        return path[self.rows :].T + mean[:, None], answer.T


def undone(y: np.ndarray, w: np.ndarray, answer: np.ndarray, d: int, seasonal: int, season: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecasts of the series itself from those of its differences, and the weights of its innovations likewise."""
    history = y[season:] - y[:-season] if seasonal else y
    levels = [history]
    for _ in range(d):
        levels.append(np.diff(levels[-1]))
    for k in range(d):
        w = levels[d - 1 - k][-1] + np.cumsum(w)
        answer = np.cumsum(answer)
    if seasonal:
        path, reply = list(y), []
        for h in range(len(w)):
            path.append(w[h] + path[len(path) - season])
            reply.append(answer[h] + (reply[h - season] if h >= season else 0.0))
        w, answer = np.array(path[len(y) :]), np.array(reply)
    return w, answer


class Chosen(NamedTuple):
    order: Order
    d: int
    seasonal: int
    score: float
    parameters: np.ndarray


def chosen(series: list[np.ndarray], steps: int, season: int, orders: tuple[Order, ...] = tuple(ORDERS)) -> tuple[np.ndarray, np.ndarray, list[Chosen]]:
    """Points, spreads and choice of each series; a differenced series keeps its mean only if it was differenced at most once."""
    n = len(series)
    points, spreads, found = np.full((n, steps), np.nan), np.full((n, steps), np.nan), [Chosen(Order(0, 0, 0, 0), 0, 0, np.inf, np.zeros(0))] * n
    scale = np.array([max(float(np.mean(np.abs(y))), 1e-9) for y in series])
    scaled = [np.asarray(y, float) / s for y, s in zip(series, scale, strict=True)]
    made = [differenced(y, season) for y in scaled]
    mean = np.array([w.mean() if d + s < 2 else 0.0 for w, d, s in made])
    centred, size = [w - m for (w, _, _), m in zip(made, mean, strict=True)], np.array([len(w) for w, _, _ in made])
    score = np.full(n, np.inf)
    for order in orders:
        if season <= 1 and order.sp + order.sq:
            continue
        at = np.flatnonzero(size >= np.maximum(SHORTEST - 2, 3 * order.size + 4) + 2 * season * max(order.sp, order.sq)) if order.size else np.arange(n)
        if not len(at):
            continue
        part = Fit([centred[k] for k in at], season)
        u, squares = part.fitted(order)
        value = aicc(part.n * np.log(np.maximum(squares, 1e-12)), part.n, order.size + 1 + 1)
        better = value < score[at]
        w, answer = part.ahead(order, u, steps, mean[at])
        for k in np.flatnonzero(better):
            i = at[k]
            _, d, seasonal = made[i]
            point, reply = undone(scaled[i], w[k], answer[k], d, seasonal, season)
            spread = np.sqrt(squares[k] * np.cumsum(reply**2))
            if np.isfinite(point).all() and np.isfinite(spread).all():
                score[i], points[i], spreads[i] = value[k], point, spread
                found[i] = Chosen(order, d, seasonal, float(value[k]), u[k])
    return points * scale[:, None], spreads * scale[:, None], found


def arima(series: list[np.ndarray], steps: int, season: int, orders: tuple[Order, ...] = tuple(ORDERS)) -> tuple[np.ndarray, np.ndarray]:
    """Points and spreads of each series; NaN for series of fewer than ``SHORTEST`` weeks."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    good = np.array([k for k, y in enumerate(series) if len(y) >= SHORTEST], int)
    for some in np.split(good, range(TOGETHER, len(good), TOGETHER)):
        if len(some):
            points[some], spreads[some], _ = chosen([series[k] for k in some], steps, season, orders)
    return points, spreads
