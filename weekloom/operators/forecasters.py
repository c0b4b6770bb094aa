"""Forecasters: per-series models over batches of series, global models on pooled rows, and batch plug-ins.

Each takes the gap-filled training frame of all folds (fold, origin, unique_id, ds, y), or the series gathered
from it (fold, unique_id, context), and returns the forecast schema.  A series travels as one row with an array of its weeks (some hundreds), so a task fits a whole
Arrow batch of series at once.  A series on which a model fails gives NULL forecasts, which the contract check counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.operators import arima, pooled, smoothing, trend
from weekloom.operators.baselines import SERIES, z_values
from weekloom.operators.boosting import gbt_global  # noqa: F401  one of the models
from weekloom.operators.features import context_padded, context_tail
from weekloom.operators.pooled import SCHEMA, by_length, lag_design, of_weeks, reach, rows_of, run_forward, series_of

#: (values, steps, season) to points and spreads of one series.
Fit = Callable[..., tuple[np.ndarray, np.ndarray]]
#: The same for a list of series, a row of NaN for each that can't be fitted; a third result are quantiles at the protocol's levels.
FitMany = Callable[..., tuple[np.ndarray, np.ndarray]]
SHORTEST = 4


def one_by_one(fit: Fit) -> FitMany:
    """A fit of many series from that of one; series that are too short, or on which it fails, give NaN."""

    def run(series: list[np.ndarray], steps: int, season: int, **parameters) -> tuple[np.ndarray, np.ndarray]:
        points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
        for k, y in enumerate(series):
            if len(y) >= SHORTEST:
                try:
                    points[k], spreads[k] = fit(y, steps, season, **parameters)
                except (ValueError, IndexError, TypeError, ArithmeticError, np.linalg.LinAlgError):
                    points[k] = spreads[k] = np.nan
        return points, spreads

    return run


def by_lengths(fit: Fit, most: int = 512) -> FitMany:
    """A fit of many series from one that takes rows of series of one length, at most ``most`` at once; if it fails on rows together, each is fitted by itself."""
    alone = one_by_one(fit)

    def run(series: list[np.ndarray], steps: int, season: int, **parameters) -> tuple[np.ndarray, np.ndarray]:
        points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
        by: dict[int, list[int]] = {}
        for k, y in enumerate(series):
            by.setdefault(len(y), []).append(k)
        for n, places in by.items():
            for lo in range(0, len(places) if n >= SHORTEST else 0, most):
                at = places[lo : lo + most]
                own = np.array([series[k] for k in at], float)
                try:
                    points[at], spreads[at] = fit(own, steps, season, **parameters)
                except (ValueError, IndexError, TypeError, ArithmeticError, np.linalg.LinAlgError):
                    points[at], spreads[at] = alone(list(own), steps, season, **parameters)
        return points, spreads

    return run


def contexts(filled: DataFrame, keys: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    return filled.groupBy(*keys).agg(of_weeks("y").alias("context"))


def per_series(filled: DataFrame, name: str, fit: FitMany, protocol: Protocol, **parameters) -> DataFrame:
    z, steps, season = np.array(z_values(protocol)), protocol.longest, protocol.season
    if fit in SIMULATED:
        parameters = {"levels": tuple(protocol.levels)} | parameters

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                points, spreads, *quantiles = fit([np.asarray(y, float) for y in rows["context"]], steps, season, **parameters)
                yield rows_of(name, rows["fold"], rows["unique_id"], points, spreads, z, *quantiles)

    return by_length(series_of(filled)).mapInPandas(run, SCHEMA)


def _grow(errors: np.ndarray, steps: int) -> np.ndarray:
    """Of one series or rows of series."""
    return np.sqrt(np.mean(errors**2, axis=-1, keepdims=True)) * np.sqrt(np.arange(1, steps + 1)) if errors.shape[-1] else np.zeros((*errors.shape[:-1], steps))


def _aicc(squares: np.ndarray, n: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    return n * np.log(np.maximum(squares / np.maximum(n, 1), 1e-12)) + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)


class Smoothing:
    """Additive exponential smoothing of many series at once: a loop over the weeks, arrays over the series.

    Series end in the same row; ``start`` is the first row of each.
    """

    def __init__(self, series: list[np.ndarray], season: int):
        self.season, self.n = season, np.array([len(y) for y in series])
        self.rows = int(self.n.max())
        self.start, self.cols = self.rows - self.n, np.arange(len(series))
        self.y = np.zeros((self.rows, len(series)))
        self.first = np.zeros((season, len(series)))
        self.level = np.zeros(len(series))
        for k, y in enumerate(series):
            self.y[self.start[k] :, k] = y
            self.level[k] = np.mean(y[:season])
            if len(y) >= season:
                self.first[:, k] = y[:season] - self.level[k]

    def run(self, alpha: float, beta: float, gamma: float, seasonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Errors (rows x series), level, slope and seasonal state (season x series)."""
        level, slope, state = self.level.copy(), np.zeros(len(self.cols)), self.first.copy() if seasonal else np.zeros_like(self.first)
        errors = np.zeros_like(self.y)
        for t in range(self.rows):
            on, at = t >= self.start, (t - self.start) % self.season
            e = np.where(on, self.y[t] - level - slope - state[at, self.cols], 0.0)
            errors[t] = e
            level += np.where(on, slope, 0.0) + alpha * e
            slope += alpha * beta * e
            state[at, self.cols] += gamma * (1 - alpha) * e
        return errors, level, slope, state

    def behind(self, rows: np.ndarray) -> np.ndarray:
        """Of rows x series, those at least so many rows behind a series' first."""
        return np.arange(self.rows)[:, None] >= self.start + rows


def ets(series: list[np.ndarray], steps: int, season: int, alphas: tuple[float, ...] = (0.05, 0.2, 0.5), betas: tuple[float, ...] = (0.0, 0.05), gammas: tuple[float, ...] = (0.1,)) -> tuple[np.ndarray, np.ndarray]:
    """Exponential smoothing; level, trend and season are chosen for each series by AICc on a grid."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    good = np.array([k for k, y in enumerate(series) if len(y) >= SHORTEST], int)
    if not len(good):
        return points, spreads
    s = Smoothing([series[k] for k in good], season)
    judged = s.behind(np.minimum(season, s.n // 2))
    k = np.arange(1, steps + 1)
    best = np.full(len(good), np.inf)
    for alpha in alphas:
        for beta in betas:
            for gamma in (None, *gammas):
                errors, level, slope, state = s.run(alpha, beta, gamma or 0.0, gamma is not None)
                score = _aicc((errors**2 * judged).sum(axis=0), judged.sum(axis=0), 2 + (beta > 0) + (season // 4 if gamma is not None else 0))
                score = np.where((s.n >= 2 * season) | (gamma is None), score, np.inf)
                better = score < best
                ahead = level[:, None] + slope[:, None] * k + state[(s.n[:, None] + k - 1) % season, s.cols[:, None]]
                late = s.behind(s.n // 4)
                width = np.sqrt((errors**2 * late).sum(axis=0) / late.sum(axis=0))[:, None] * np.sqrt(k)
                points[good[better]], spreads[good[better]] = ahead[better], width[better]
                best = np.where(better, score, best)
    return points, spreads


def theta(series: list[np.ndarray], steps: int, season: int, alphas: tuple[float, ...] = (0.05, 0.1, 0.2, 0.4, 0.7)) -> tuple[np.ndarray, np.ndarray]:
    """Classical theta: seasonally adjusted, the mean of the trend line and smoothing of twice the curvature."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    good = [k for k, y in enumerate(series) if len(y) >= SHORTEST]
    if not good:
        return points, spreads
    k, adjusted, lines, doubles = np.arange(1, steps + 1), [], [], []
    for y in (series[i] for i in good):
        n, adjust = len(y), np.zeros(season)
        if n >= 2 * season:
            adjust = np.array([np.mean(y[j::season]) for j in range(season)]) - np.mean(y)
        x = y - adjust[np.arange(n) % season]
        t = np.arange(n) - (n - 1) / 2
        slope = float(t @ x / (t @ t))
        line = np.mean(x) + slope * t
        adjusted.append(adjust[(n + k - 1) % season])
        lines.append(line[-1] + slope * k)
        doubles.append(2 * x - line)
    s = Smoothing(doubles, 1)
    best = np.full(len(good), np.inf)
    for alpha in alphas:
        errors, level, _, _ = s.run(alpha, 0.0, 0.0, False)
        squares = (errors**2).sum(axis=0) / s.n
        better = np.flatnonzero(squares < best)
        at = np.array(good)[better]
        points[at] = (np.array(lines)[better] + level[better, None]) / 2 + np.array(adjusted)[better]
        spreads[at] = np.sqrt(squares[better, None]) / 2 * np.sqrt(k)
        best = np.minimum(best, squares)
    return points, spreads


def seasonal_ar(y: np.ndarray, steps: int, season: int, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Autoregression of the seasonal (or first) differences; the order is chosen by AICc."""
    lag = season if len(y) >= 2 * season + 8 else 1
    d = y[lag:] - y[:-lag]
    most = min(most, (len(d) - 1) // 4)
    best = None
    for p in range(most + 1):
        design = np.column_stack([np.ones(len(d) - most), *[d[most - j : len(d) - j] for j in range(1, p + 1)]])
        coef, *_ = np.linalg.lstsq(design, d[most:], rcond=None)
        errors = d[most:] - design @ coef
        score = float(_aicc(errors @ errors, len(errors), p + 1))
        if best is None or score < best[0]:
            best = score, coef, errors
    _, coef, errors = best
    path, values = list(d), list(y)
    for _ in range(steps):
        path.append(coef[0] + sum(c * path[-j] for j, c in enumerate(coef[1:], 1)))
        values.append(values[len(values) - lag] + path[-1])
    return np.array(values[len(y) :]), _grow(errors, steps)


def fourier_trend(y: np.ndarray, steps: int, season: int, knots: int = 5, terms: int = 6, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Piecewise linear trend and yearly Fourier terms by ridge regression; the spread grows with the trend's uncertainty ahead.  ``y`` is one series or rows of series, which share the design."""
    n = y.shape[-1]
    t = np.arange(n + steps) / n
    bends = [np.maximum(t - k, 0) for k in np.linspace(0.1, 0.8, knots)]
    waves = [f(2 * np.pi * k * np.arange(n + steps) / season) for k in range(1, terms + 1) for f in (np.sin, np.cos)]
    design = np.column_stack([np.ones(n + steps), t, *bends, *waves])
    penalty = np.diag([0.0, 0.0] + [ridge * 5] * knots + [ridge] * (2 * terms))
    normal = design[:n].T @ design[:n] + penalty
    coef = np.linalg.solve(normal, design[:n].T @ y.T).T
    fitted = coef @ design.T
    ahead = design[n:]
    leverage = np.einsum("ij,ij->i", ahead, np.linalg.solve(normal, ahead.T).T)
    return fitted[..., n:], np.std(y - fitted[..., :n], axis=-1, keepdims=True) * np.sqrt(1 + np.maximum(leverage, 0))


def ridge_local(y: np.ndarray, steps: int, season: int, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Ridge regression on lags and rolling means, one model per series, run forward step by step.  ``y`` is one series or rows of series."""
    n = y.shape[-1]
    if n <= reach(season):
        raise ValueError("too short for its lags")
    scale = np.maximum(np.mean(np.abs(y), axis=-1, keepdims=True), 1e-9)
    v, at = y / scale, np.arange(reach(season), n)
    x, target = lag_design(v, season, at), v[..., at, None]
    turned = np.swapaxes(x, -1, -2)
    coef = np.linalg.solve(turned @ x + ridge * np.eye(x.shape[-1]), turned @ target)
    return run_forward(v, steps, season, lambda f, _: (f * coef[..., 0]).sum(axis=-1)) * scale, _grow((target - x @ coef)[..., 0] * scale, steps)


def ridge_global(filled: DataFrame, protocol: Protocol, ridge: float = 1.0, future: DataFrame | None = None) -> DataFrame:
    """The regression of ``ridge_local`` pooled over all series of a fold, refitted for each fold.

    With ``future`` (of split.future_covariates; ``filled`` then has units and arp too) it also sees what is known of each week ahead.
    """
    return pooled.forecast(filled, pooled.lagged(protocol, informed=future is not None), protocol, ridge, future)


def linear_global(filled: DataFrame, protocol: Protocol, ridge: float = 1.0) -> DataFrame:
    """A direct linear map from the last season of values to all weeks ahead, pooled over all windows of all series of a fold.

    A model with one linear head for the moving average and one for the remainder of a window is such a map too.
    """
    return pooled.forecast(filled, pooled.direct(protocol), protocol, ridge)


def plugin(filled: DataFrame, protocol: Protocol, name: str, forecast: Callable[[np.ndarray, np.ndarray, int], np.ndarray], context: int = 104) -> DataFrame:
    """Batch inference by a function of (contexts, masks, steps) that gives quantiles (series x steps x levels)."""
    steps, middle = protocol.longest, protocol.levels.index(0.5)
    tails = context_padded(context_tail(filled, context, tuple(SERIES)), context).select(*SERIES, "padded", "mask")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if not len(rows):
                continue
            q = np.sort(forecast(np.stack(rows["padded"].to_numpy()), np.stack(rows["mask"].to_numpy()), steps), axis=2)
            n = len(rows)
            yield pd.DataFrame({"model": name, "fold": np.repeat(rows["fold"].to_numpy(), steps).astype("int32"), "unique_id": np.repeat(rows["unique_id"].to_numpy(), steps), "step": np.tile(np.arange(1, steps + 1, dtype="int32"), n), "yhat": q[:, :, middle].ravel(), "q": list(q.reshape(n * steps, -1))})

    return tails.mapInPandas(run, SCHEMA)


def tune(filled: DataFrame, actual: DataFrame, denominators: DataFrame, trials: list[tuple[str, int, dict]], fits: dict[str, FitMany], protocol: Protocol) -> DataFrame:
    """Mean MASE over all series of each trial (model, number, parameters): trials x series run as one job.

    A trial that fails on a series is recorded as failed.
    """
    spark = filled.sparkSession
    points = spark.createDataFrame([(m, t, ",".join(f"{k}={v}" for k, v in sorted(p.items()))) for m, t, p in trials], "model string, trial int, params string")
    own, steps, season, z = {(m, t): p for m, t, p in trials}, protocol.longest, protocol.season, np.zeros(1)
    work = contexts(filled, ("unique_id",)).join(F.broadcast(points)).repartition("unique_id", "model", "trial")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for (model, trial), part in rows.groupby(["model", "trial"]):
                made = fits[model]([np.asarray(y, float) for y in part["context"]], steps, season, **own[model, trial])
                yield rows_of(model, np.full(len(part), trial), part["unique_id"], *made, z).rename(columns={"fold": "trial"})[["model", "trial", "unique_id", "step", "yhat"]]

    made = work.select("model", "trial", "unique_id", "context").mapInPandas(run, "model string, trial int, unique_id string, step int, yhat double")
    scored = made.join(actual.select("unique_id", "step", "y"), ["unique_id", "step"]).join(denominators.select("unique_id", "mase_den"), "unique_id")
    per = scored.groupBy("model", "trial", "unique_id").agg((F.avg(F.abs(F.col("y") - F.col("yhat"))) / F.first(F.nullif("mase_den", F.lit(0.0)))).alias("mase"), F.count_if(F.col("yhat").isNull()).alias("n_failed"))
    by = per.groupBy("model", "trial").agg(F.avg("mase").alias("value"), F.sum("n_failed").alias("n_failed"))
    ok = F.col("n_failed") == 0
    return by.join(F.broadcast(points), ["model", "trial"]).select("model", "trial", "params", F.when(ok, F.col("value")).alias("value"), F.when(ok, "ok").otherwise("failed").alias("status"))


#: Models that fit each series by itself.
LOCAL: dict[str, FitMany] = {
    "ets": smoothing.ets, "theta": theta, "arima": arima.arima, "sparse_trend": trend.sparse_trend,
    "ets_grid": ets, "seasonal_ar": one_by_one(seasonal_ar), "fourier_trend": by_lengths(fourier_trend), "ridge_local": by_lengths(ridge_local),
}
#: Those that simulate their quantiles.
SIMULATED = (trend.sparse_trend,)
