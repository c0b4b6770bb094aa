"""Regressions pooled over the series of a fold, from sums that Spark adds up.

A series gives rows of features and targets, of which only the normal equations are needed: small matrices, summed over
the series of a group in one pass.  The sums of disjoint groups can be added, so one pass over the slices of a nested ladder
gives the equations of every rung as prefix sums, and one eigendecomposition gives the fit for every penalty.
Series of equal length are stacked, so that a batch is worked on in whole arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.operators.baselines import SERIES, z_values
from weekloom.sources.scratch import written

LAGS = (1, 2, 3, 4, 13, 26)
SCHEMA = "model string, fold int, unique_id string, step int, yhat double, q array<double>"
AHEAD = ("units_yago", "arp_yago", "planned_arp", "week_of_year")


def reach(season: int) -> int:
    return max(season, *LAGS)


def lag_design(y: np.ndarray, season: int, at: np.ndarray) -> np.ndarray:
    """One, lags and rolling means before each of the places ``at``; ``y`` may be one series or rows of series (weeks last)."""
    sums = np.concatenate([np.zeros((*y.shape[:-1], 1)), np.cumsum(y, axis=-1)], axis=-1)
    columns = [np.ones((*y.shape[:-1], len(at))), *[y[..., at - k] for k in (*LAGS, season)], *[(sums[..., at] - sums[..., at - k]) / k for k in (4, 13, season)]]
    return np.stack(columns, axis=-1)


def run_forward(y: np.ndarray, steps: int, season: int, predict: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """``predict(features, step)`` applied to its own output; ``y`` is one series or rows of series."""
    path = y[..., -reach(season) :]
    for k in range(steps):
        fresh = predict(lag_design(path, season, np.array([path.shape[-1]]))[..., 0, :], k)
        path = np.concatenate([path, fresh[..., None]], axis=-1)
    return path[..., -steps:]


def of_weeks(column: str) -> Column:
    """The column's values in order of the weeks for which y is known; a series is some hundred rows."""
    return F.transform(F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("ds", column)))), lambda x: x[column])


@dataclass(frozen=True)
class Moments:
    """X'X, X'y, the sums of squares of each target, and the number of rows."""

    xx: np.ndarray
    xy: np.ndarray
    yy: np.ndarray
    n: float

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.xx + other.xx, self.xy + other.xy, self.yy + other.yy, self.n + other.n)

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray) -> Moments:
        """From features and targets, rows last but one."""
        x, y = x.reshape(-1, x.shape[-1]), y.reshape(-1, y.shape[-1])
        return Moments(x.T @ x, x.T @ y, (y**2).sum(axis=0), float(len(y)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.xx.ravel(), self.xy.ravel(), self.yy, [self.n]])

    @staticmethod
    def unflat(v: np.ndarray, outputs: int) -> Moments:
        width = int((-outputs + np.sqrt(outputs**2 + 4 * (len(v) - outputs - 1))) / 2 + 0.5)  # width^2 + width * outputs + outputs + 1 numbers
        return Moments(v[: width**2].reshape(width, width), v[width**2 : width * (width + outputs)].reshape(width, outputs), v[-outputs - 1 : -1], float(v[-1]))

    def solved(self, penalties: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Coefficients and residual root mean squares of each target, for each penalty."""
        values, vectors = np.linalg.eigh(self.xx)
        turned, out = vectors.T @ self.xy, []
        for penalty in penalties:
            coef = vectors @ (turned / np.maximum(values + penalty, 1e-12 * max(values[-1], 1.0))[:, None])
            squares = self.yy - 2 * (coef * self.xy).sum(axis=0) + np.einsum("ij,ik,kj->j", coef, self.xx, coef)
            out.append((coef, np.sqrt(np.maximum(squares, 0) / max(self.n, 1))))
        return out


@dataclass(frozen=True)
class Pooled:
    """A pooled model.  ``design(v, known)`` gives features and targets of stacked series (series x weeks, over their mean size), None if they are too short;
    ``ahead(v, known, coef)`` their forecasts, None likewise; ``grows`` says whether the spread is that of one step and grows, or one of each step."""

    name: str
    outputs: int
    design: Callable[[np.ndarray, np.ndarray | None], tuple[np.ndarray, np.ndarray] | None]
    ahead: Callable[[np.ndarray, np.ndarray | None, np.ndarray], np.ndarray | None]
    grows: bool


def lagged(protocol: Protocol, name: str = "ridge_global", informed: bool = False) -> Pooled:
    """One step ahead from lags and rolling means, applied to its own forecasts; if ``informed``, also from what is known of each week."""
    season, steps = protocol.season, protocol.longest

    def design(v: np.ndarray, known: np.ndarray | None):
        first, n = max(reach(season), 52 if informed else 0), v.shape[1]
        if n <= first:
            return None
        at = np.arange(first, n)
        x = lag_design(v, season, at)
        return (np.concatenate([x, known[:, at]], axis=-1) if informed else x), v[:, at, None]

    def ahead(v: np.ndarray, known: np.ndarray | None, coef: np.ndarray):
        n = v.shape[1]
        if n < reach(season):
            return None
        extra = known[:, n:] if informed else np.zeros((len(v), steps, 0))
        return run_forward(v, steps, season, lambda f, h: np.concatenate([f, extra[:, h]], axis=-1) @ coef[:, 0])

    return Pooled(name, 1, design, ahead, True)


def direct(protocol: Protocol, name: str = "linear_global") -> Pooled:
    """A linear map from the last season of values to all weeks ahead, from all windows of all series."""
    season, steps = protocol.season, protocol.longest

    def design(v: np.ndarray, _):
        if v.shape[1] < season + steps:
            return None
        windows = np.lib.stride_tricks.sliding_window_view(v, season + steps, axis=1)
        return np.concatenate([np.ones((*windows.shape[:2], 1)), windows[..., :season]], axis=-1), windows[..., season:]

    def ahead(v: np.ndarray, _, coef: np.ndarray):
        return np.concatenate([np.ones((len(v), 1)), v[:, -season:]], axis=1) @ coef if v.shape[1] >= season else None

    return Pooled(name, steps, design, ahead, False)


def _tasks(rows: DataFrame) -> int:
    """A task for each core: work on a series is heavy for its few bytes, whose size would suggest a few tasks."""
    spark = rows.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by series in a task for each core."""
    return rows.repartition(_tasks(rows), *SERIES)


def series_of(filled: DataFrame, future: DataFrame | None = None) -> DataFrame:
    """The rows of ``gathered``, written, as models read them more than once; a frame of such rows stays as it is."""
    return filled if "context" in filled.columns else written(gathered(dealt(filled), future))


def by_length(series: DataFrame) -> DataFrame:
    """Series in a task for each core, those of one length together: models that take all series of a length at once have few lengths in a task."""
    return series.repartitionByRange(_tasks(series), F.size("context"), *SERIES)


def gathered(filled: DataFrame, future: DataFrame | None = None, keys: tuple[str, ...] = tuple(SERIES)) -> DataFrame:
    """A row per series: its values as ``context``; with ``future`` also its units, prices and weeks, and what is known of the weeks ahead, as arrays."""
    if future is None:
        return filled.groupBy(*keys).agg(of_weeks("y").alias("context"))
    steps = F.array_sort(F.collect_list(F.struct("step", *AHEAD)))
    field = lambda c: lambda x: x[c].cast("double")
    ahead = future.groupBy(*SERIES).agg(*[F.transform(steps, field(c)).alias(c) for c in AHEAD])
    measured = filled.withColumn("week", F.weekofyear("ds")).groupBy(*keys).agg(of_weeks("y").alias("context"), *[of_weeks(c).alias(c) for c in ("units", "arp", "week")])
    return measured.join(ahead, list(SERIES))


def carried(x: np.ndarray) -> np.ndarray:
    """Unknown values of each row by the last known one, before any by the first, and 0 in rows without any."""
    for step in (1, -1):
        y = x[:, ::step]
        last = np.maximum.accumulate(np.where(np.isnan(y), 0, np.arange(y.shape[1])), axis=1)
        x = np.take_along_axis(y, last, axis=1)[:, ::step]
    return np.nan_to_num(x)


def known_of(rows: pd.DataFrame, n: int) -> np.ndarray:
    """Year-ago units and prices, the price planned and the season's phase of ``n`` weeks and those ahead: series x weeks x 5; amounts and prices over their series' mean."""
    stacked = lambda c: np.array([np.asarray(x, float) for x in rows[c]])
    units, arp = carried(stacked("units")), carried(stacked("arp"))
    units_yago, arp_yago, planned, weeks = (carried(stacked(c)) for c in AHEAD)
    per = lambda x, of: x / np.maximum(np.abs(of).mean(axis=1, keepdims=True), 1e-9)
    ago = lambda x: np.concatenate([np.zeros((len(x), min(52, n))), x[:, : max(n - 52, 0)]], axis=1)
    phase = 2 * np.pi * np.concatenate([stacked("week"), weeks], axis=1) / 52
    before = np.concatenate([arp[:, :1], arp[:, :-1]], axis=1)
    pairs = [(ago(units), units_yago, units), (ago(arp), arp_yago, arp), (before, planned, arp)]
    return np.stack([*[np.concatenate([per(a, of), per(b, of)], axis=1) for a, b, of in pairs], np.sin(phase), np.cos(phase)], axis=-1)


def stacks(rows: pd.DataFrame, keys: list[str], most: int = 512) -> Iterator[tuple[tuple, pd.Index, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Rows of equal keys and length, at most ``most`` at once: keys, places, values over their scale, scale, what is known.

    A model's features are many times as large as its series, so those of a whole Arrow batch would fill an executor's memory.
    """
    size = rows["context"].map(len)
    for key, whole in rows.groupby([*[rows[k] for k in keys], size]):
        n = key[-1]
        for lo in range(0, len(whole), most):
            own = whole.iloc[lo : lo + most]
            y = np.array([np.asarray(x, float) for x in own["context"]]).reshape(len(own), n)
            scale = np.maximum(np.abs(y).mean(axis=1), 1e-9) if n else np.ones(len(own))
            yield key[:-1], own.index, y / scale[:, None], scale, known_of(own, n) if "units" in rows and n else None


def summed(rows: DataFrame, model: Pooled, keys: tuple[str, ...] = ("fold",)) -> dict[tuple, Moments]:
    """The moments of each group of series, in one job; groups x features^2 numbers come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, Moments] = {}
        for part in batches:
            for key, _, v, _, known in stacks(part, list(keys)):
                if (made := model.design(v, known)) is not None:
                    own = Moments.of(*made)
                    total[key] = total[key] + own if key in total else own
        for key, moments in total.items():
            yield pd.DataFrame([[*map(int, key), moments.flat()]], columns=[*keys, "moments"])

    schema = ", ".join(f"{k} long" for k in keys)
    found = rows.mapInPandas(run, f"{schema}, moments array<double>").select(*keys, F.posexplode("moments").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v")).toPandas()
    return {tuple(map(int, key)): Moments.unflat(part.sort_values("i")["v"].to_numpy(), model.outputs) for key, part in found.groupby(list(keys))}


def rows_of(name: str, folds, ids, points: np.ndarray, spreads: np.ndarray, z: np.ndarray, quantiles: np.ndarray | None = None) -> pd.DataFrame:
    """Forecast rows; the quantiles are given, or the points widened by the spreads."""
    n, steps = points.shape
    yhat = points.ravel()
    q = yhat[:, None] + spreads.ravel()[:, None] * z if quantiles is None else quantiles.reshape(n * steps, -1)
    good = np.isfinite(q).all(axis=1) & np.isfinite(yhat)
    return pd.DataFrame({
        "model": name, "fold": np.repeat(np.asarray(folds, np.int32), steps), "unique_id": np.repeat(np.asarray(ids, object), steps), "step": np.tile(np.arange(1, steps + 1, dtype=np.int32), n),
        "yhat": pd.Series(np.where(good, yhat, np.nan)).astype(object).where(good, None), "q": [list(x) if ok else None for x, ok in zip(q, good, strict=True)],
    })


def predicted(rows: DataFrame, model: Pooled, fits: dict[int, list[tuple[int | None, np.ndarray, np.ndarray]]], protocol: Protocol) -> DataFrame:
    """Forecasts of all series by the fits of their fold: (number, coefficients, residual scale) each.  Adds n_series, the fit's number, unless that is None."""
    steps, z = protocol.longest, np.array(z_values(protocol))
    numbered = any(n is not None for own in fits.values() for n, _, _ in own)
    every = [n for n, _, _ in max(fits.values(), key=len, default=[(None, None, None)])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            part = part.reset_index(drop=True)
            made = {n: tuple(np.full((len(part), steps), np.nan) for _ in range(2)) for n in every}
            for (fold,), places, v, scale, known in stacks(part, ["fold"]):
                for n, coef, sigma in fits.get(int(fold), ()):
                    points = model.ahead(v, known, coef)
                    if points is not None:
                        made[n][0][places] = points * scale[:, None]
                        made[n][1][places] = sigma * scale[:, None] * (np.sqrt(np.arange(1, steps + 1)) if model.grows else 1.0)
            for n, (points, spreads) in made.items():
                out = rows_of(model.name, part["fold"], part["unique_id"], points, spreads, z)
                yield out.assign(n_series=np.int64(n)) if numbered else out

    return rows.mapInPandas(run, SCHEMA + (", n_series long" if numbered else ""))


def forecast(filled: DataFrame, model: Pooled, protocol: Protocol, ridge: float = 1.0, future: DataFrame | None = None) -> DataFrame:
    """Fitted anew for each fold on all of its series, and applied to them; NULL forecasts for series that are too short."""
    whole = by_length(series_of(filled, future))
    fits = {fold: [(None, *moments.solved([ridge])[0])] for (fold,), moments in summed(whole, model).items()}
    return predicted(whole, model, fits, protocol)


def ladder(filled: DataFrame, rungs: DataFrame, models: list[Pooled], protocol: Protocol, ridge: float = 1.0, series: DataFrame | None = None) -> DataFrame:
    """Forecasts of models fitted on each rung of a nested ladder (unique_id, n_series), for ``series`` (those of the smallest rung if None); adds n_series.

    A series counts in one slice, that of the first rung which has it; the equations of a rung are the sum of those of all slices up to it.
    So the whole ladder costs one pass over its largest rung, whatever the number of rungs.
    """
    first = rungs.groupBy("unique_id").agg(F.min("n_series").alias("first"))
    sizes = sorted(r["n_series"] for r in rungs.select("n_series").distinct().collect())  # rungs
    whole = gathered(filled.join(first, "unique_id"), keys=(*SERIES, "first"))
    kept = whole.where(F.col("first") == (sizes[0] if sizes else 0)) if series is None else gathered(filled).join(series.select("unique_id"), "unique_id", "left_semi")
    out = None
    for model in models:
        slices = summed(whole, model, ("fold", "first"))
        fits: dict[int, list] = {}
        for fold in sorted({f for f, _ in slices}):
            total = None
            for n in sizes:
                own = slices.get((fold, n))
                total = own if total is None else total + own if own is not None else total
                if total is not None:
                    fits.setdefault(fold, []).append((n, *total.solved([ridge])[0]))
        made = predicted(kept.select(*SERIES, "context"), model, fits, protocol)
        out = made if out is None else out.unionByName(made)
    return out


def tune(filled: DataFrame, actual: DataFrame, denominators: DataFrame, models: list[Pooled], penalties: dict[str, list[float]], protocol: Protocol) -> DataFrame:
    """Mean MASE of each model with each of its penalties (model, trial, params, value, status), of one fold: a single pass for the equations of a model, whatever the number of trials."""
    whole, out = gathered(filled), None
    for model in models:
        fits = {fold: [(k, *fit) for k, fit in enumerate(moments.solved(penalties[model.name]))] for (fold,), moments in summed(whole, model).items()}
        made = predicted(whole, model, fits, protocol)
        made = made if "n_series" in made.columns else made.withColumn("n_series", F.lit(0).cast("long"))
        scored = made.join(actual.select("unique_id", "step", "y"), ["unique_id", "step"]).join(denominators.select("unique_id", "mase_den"), "unique_id")
        per = scored.groupBy("n_series", "unique_id").agg((F.avg(F.abs(F.col("y") - F.col("yhat"))) / F.first(F.nullif("mase_den", F.lit(0.0)))).alias("mase"))
        params = F.element_at(F.array(*[F.lit(f"ridge={p}") for p in penalties[model.name]]), (F.col("n_series") + 1).cast("int"))
        by = per.groupBy("n_series").agg(F.avg("mase").alias("value")).select(F.lit(model.name).alias("model"), F.col("n_series").cast("int").alias("trial"), params.alias("params"), "value", F.when(F.col("value").isNull(), "failed").otherwise("ok").alias("status"))
        out = by if out is None else out.unionByName(by)
    return out
