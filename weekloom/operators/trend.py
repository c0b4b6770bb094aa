"""Piecewise linear trend with sparse change points and a yearly season, for many series at once.

The slope may change at evenly spaced points of the first part of a series.  The changes carry an L1 penalty and the
Fourier terms of the season a small L2 penalty; coordinate descent fits all series of one length together, as they share the design and its Gram matrix.
Along a path of warm starts the L1 penalty only chooses which bends stay: those are fitted again without it, and each series takes the choice of
least AICc.  Forecast quantiles come from simulated futures, in which the slope goes
on changing as often, and by as much, as it did, on top of the error of the fit itself.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np


SHORTEST = 4
#: Shares of the largest penalty that leaves any change; the last but fits freely.
PATH = (1.0, 0.5, 0.25, 0.12, 0.06, 0.03, 0.015)


class Design(NamedTuple):
    x: np.ndarray  # weeks and weeks ahead x columns: one, time, bends, season
    bends: slice
    points: np.ndarray  # where each bend lies, in weeks


@lru_cache(256)
def design(n: int, steps: int, season: int, bends: int, share: float, terms: int) -> Design:
    t = np.arange(n + steps) / n
    bends, terms = min(bends, max(n // 6 - 1, 0)), min(terms, n // 12)
    at = np.linspace(0, share, bends + 2)[1:-1]
    waves = [f(2 * np.pi * k * np.arange(n + steps) / season) for k in range(1, terms + 1) for f in (np.sin, np.cos)]
    return Design(np.column_stack([np.ones(n + steps), t, *[np.maximum(t - a, 0) for a in at], *waves]), slice(2, 2 + bends), at * n)


class Fitted(NamedTuple):
    coef: np.ndarray  # series x columns
    sigma: np.ndarray
    score: np.ndarray
    inverse: np.ndarray  # of the normal equations: series x columns x columns


def descended(gram: np.ndarray, xy: np.ndarray, coef: np.ndarray, soft: np.ndarray, ridge: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Minimises half the squares plus L1 (``soft``, series x columns) and L2 (``ridge``, columns) penalties, one column after the other."""
    coef, size = coef.copy(), np.diag(gram) + ridge
    left = xy - coef @ gram
    for _ in range(rounds):
        most = 0.0
        for j in range(len(size)):
            old = coef[:, j]
            z = left[:, j] + gram[j, j] * old
            new = np.sign(z) * np.maximum(np.abs(z) - soft[:, j], 0) / size[j]
            move = new - old
            left -= move[:, None] * gram[j]
            coef[:, j] = new
            most = max(most, float(np.max(np.abs(move) * np.sqrt(size[j]), initial=0.0)))
        if most < 1e-7:
            break
    return coef


def solved(gram: np.ndarray, xy: np.ndarray, coef: np.ndarray, soft: np.ndarray, ridge: np.ndarray, free: np.ndarray) -> np.ndarray:
    """As ``descended``, with the columns that carry no L1 penalty taken out exactly: they are fitted to what the others leave."""
    inner = np.linalg.solve(gram[np.ix_(free, free)] + np.diag(ridge[free] + 1e-9), gram[free])
    bends = ~free
    if not bends.any():
        coef = coef.copy()
        coef[:, free] = np.linalg.solve(gram[np.ix_(free, free)] + np.diag(ridge[free] + 1e-9), xy[:, free].T).T
        return coef
    reduced = gram[np.ix_(bends, bends)] - gram[np.ix_(bends, free)] @ inner[:, bends]
    target = xy[:, bends] - xy[:, free] @ inner[:, bends]
    out = np.empty_like(coef)
    out[:, bends] = descended(reduced, target, coef[:, bends], soft[:, bends], ridge[bends])
    out[:, free] = np.linalg.solve(gram[np.ix_(free, free)] + np.diag(ridge[free] + 1e-9), (xy[:, free] - out[:, bends] @ gram[np.ix_(bends, free)]).T).T
    return out


def fitted(y: np.ndarray, d: Design, ridge: float = 1.0) -> Fitted:
    """All series (rows) of one length; a kept bend counts as one parameter, and the season's as far as the penalty leaves them."""
    n = y.shape[1]
    x = d.x[:n]
    gram, xy = x.T @ x, y @ x
    columns = np.arange(x.shape[1])
    free = ~((columns >= d.bends.start) & (columns < d.bends.stop))
    shrink = np.where(columns >= d.bends.stop, ridge, 0.0)
    fixed = 2 + int(round(float(sum(g / (g + ridge) for g in np.diag(gram)[d.bends.stop :]))))
    start = solved(gram, xy, np.zeros((len(y), x.shape[1])), np.full((len(y), x.shape[1]), np.inf), shrink, free)
    top = np.abs((xy - start @ gram)[:, d.bends]).max(axis=1, initial=0.0)
    best = None
    coef, whole = start, np.eye(x.shape[1])
    for share in (None, *PATH):
        if share is not None:
            soft = np.zeros_like(coef)
            soft[:, d.bends] = (top * share)[:, None]
            coef = solved(gram, xy, coef, soft, shrink, free)
        kept = free | (np.abs(coef) > 1e-9)
        # columns that went have an equation of their own, with solution 0
        both = kept[:, :, None] & kept[:, None, :]
        inverse = np.linalg.inv(np.where(both, gram + np.diag(shrink + 1e-9), whole)) * both
        again = np.einsum("sij,sj->si", inverse, xy * kept)
        squares = ((y - again @ x.T) ** 2).sum(axis=1)
        k = fixed + kept[:, d.bends].sum(axis=1)
        score = n * np.log(np.maximum(squares / n, 1e-12)) + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)
        fresh = Fitted(again, np.sqrt(squares / np.maximum(n - k, 1)), score, inverse)
        if best is None:
            best = fresh
        else:
            better = score < best.score
            best = Fitted(*[np.where(better.reshape(-1, *[1] * (a.ndim - 1)), a, b) for a, b in zip(fresh, best, strict=True)])
    return best


def widths(d: Design, f: Fitted, n: int) -> np.ndarray:
    """Standard error of a week ahead, that of the fit included: series x steps."""
    ahead = d.x[n:]
    return f.sigma[:, None] * np.sqrt(1 + np.maximum(np.einsum("hi,sij,hj->sh", ahead, f.inverse, ahead), 0))


@lru_cache(8)
def draws(futures: int, steps: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each future and step: a uniform number, a Laplace change of scale 1, a normal error.  The same for all series, so that results don't depend on batches."""
    rng = np.random.default_rng(seed)
    shape = (futures, steps)
    return rng.random(shape), rng.laplace(size=shape), rng.normal(size=shape)


def simulated(points: np.ndarray, d: Design, f: Fitted, n: int, levels: tuple[float, ...], futures: int = 400, seed: int = 7) -> np.ndarray:
    """Quantiles (series x steps x levels) of futures in which bends come with the past's frequency and mean size.

    They start at the last place where a bend could be told, as one may have come since.
    """
    wide, steps = widths(d, f, n), points.shape[1]
    unseen = int(np.ceil(n - d.points[-1])) if len(d.points) else 0
    uniform, change, error = draws(futures, unseen + steps, seed)
    bends = np.abs(f.coef[:, d.bends])
    kept = (bends > 1e-9).sum(axis=1)
    size = np.where(kept > 0, bends.sum(axis=1) / np.maximum(kept, 1), 0.0) / n  # per week
    often = kept / n
    out = np.empty((*points.shape, len(levels)))
    for k in range(len(points)):
        slopes = np.cumsum(np.where(uniform < often[k], change * size[k], 0.0), axis=1)
        out[k] = np.quantile(points[k] + np.cumsum(slopes, axis=1)[:, unseen:] + wide[k] * error[:, unseen:], levels, axis=0).T
    return out


def sparse_trend(series: list[np.ndarray], steps: int, season: int, bends: int = 25, share: float = 0.95, terms: int = 6, ridge: float = 1.0, levels: tuple[float, ...] = ()) -> tuple[np.ndarray, ...]:
    """Points and spreads of each series, and with ``levels`` also its simulated quantiles; NaN for series of fewer than ``SHORTEST`` weeks."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    quantiles = np.full((len(series), steps, len(levels)), np.nan)
    by: dict[int, list[int]] = {}
    for k, y in enumerate(series):
        if len(y) >= SHORTEST:
            by.setdefault(len(y), []).append(k)
    for n, at in by.items():
        y = np.array([series[k] for k in at], float)
        scale = np.maximum(np.abs(y).mean(axis=1, keepdims=True), 1e-9)
        d = design(n, steps, season, bends, share, terms)
        f = fitted(y / scale, d, ridge)
        ahead = f.coef @ d.x[n:].T
        points[at] = ahead * scale
        spreads[at] = widths(d, f, n) * scale
        if levels:
            quantiles[at] = simulated(ahead, d, f, n, levels) * scale[:, :, None]
    return (points, spreads, quantiles) if levels else (points, spreads)
