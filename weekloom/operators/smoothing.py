"""Exponential smoothing with fitted parameters, for many series at once.

Forms: error additive or multiplicative; trend none, additive or damped; season none, additive or multiplicative.  The parameters of each
form are fitted by likelihood, those of all series together: from the best point of a coarse grid, one parameter after
the other is searched in a bracket of a few points that shrinks around the best of them.  A step is taken only where it raises a series'
likelihood, so no series ends below the grid.  The form is chosen for each series by AICc.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

SHORTEST = 4
#: Series that are fitted at a time: arrays of more of them leave the processor's cache.
TOGETHER = 1024
#: Bounds of the smoothing parameters (level; trend and season as shares of what the level leaves) and of the damping.
LOW, HIGH = np.array([0.001, 0.0, 0.0, 0.8]), np.array([0.99, 0.9, 0.9, 0.98])
GRID = [(a, b, g, 0.95) for a in (0.05, 0.2, 0.5, 0.8) for b in (0.02, 0.15) for g in (0.05, 0.3)]


class Form(NamedTuple):
    error: str
    trend: str
    season: str

    @property
    def free(self) -> list[int]:
        """Which of level, trend, season and damping are fitted."""
        return [0, *([1] if self.trend != "N" else []), *([2] if self.season != "N" else []), *([3] if self.trend == "Ad" else [])]

    def size(self, season: int) -> int:
        """Parameters and states that count: a season's states as a quarter of them, as neighbours hardly differ."""
        return len(self.free) + 1 + (self.trend != "N") + (season // 4 if self.season != "N" else 0)


FORMS = [Form(e, t, s) for e in "AM" for t in ("N", "A", "Ad") for s in "NAM"]


class Aligned:
    """Series as the columns of an array, all ending in its last row; ``start`` is the first row of each."""

    def __init__(self, series: list[np.ndarray]):
        self.n = np.array([len(y) for y in series])
        self.rows = int(self.n.max())
        self.start = self.rows - self.n
        self.y = np.zeros((self.rows, len(series)))
        for k, y in enumerate(series):
            self.y[self.start[k] :, k] = y

    def behind(self, rows: np.ndarray) -> np.ndarray:
        """Of rows x series, those at least so many rows behind a series' first."""
        return np.arange(self.rows)[:, None] >= self.start + rows


class State(NamedTuple):
    level: np.ndarray
    slope: np.ndarray
    season: np.ndarray


class Batch(Aligned):
    def __init__(self, series: list[np.ndarray], season: int):
        super().__init__(series)
        self.season = season
        self.level, self.slope = np.zeros(len(series)), np.zeros(len(series))
        self.added, self.times = np.zeros((season, len(series))), np.ones((season, len(series)))
        for k, y in enumerate(series):
            self.level[k] = np.mean(y[:season])
            if len(y) >= 2 * season:
                self.slope[k] = (np.mean(y[season : 2 * season]) - self.level[k]) / season
                self.added[:, k] = y[:season] - self.level[k]
                self.times[:, k] = np.maximum(y[:season], 1e-3 * abs(self.level[k])) / max(self.level[k], 1e-9)
        self.judged = self.behind(np.minimum(season, self.n // 2))
        self.any, self.all, self.last = self.judged.any(axis=1), self.judged.all(axis=1), int(self.start.max())
        self.positive = np.array([len(y) > 0 and float(np.min(y)) > 0 for y in series])

    def allowed(self, form: Form) -> np.ndarray:
        long = (self.n >= 2 * self.season) & (self.season > 1) if form.season != "N" else np.ones(len(self.n), bool)
        return long & (self.positive | ("M" not in (form.error, form.season)))

    def run(self, form: Form, p: np.ndarray, errors: str = "AM", each: bool = False) -> tuple[list[np.ndarray], State | None, np.ndarray | None]:
        """For parameters p (candidates x series x 4): -2 log likelihood (candidates x series, without constants) for each kind of error asked for, and if asked for ``each``, the last state and all errors."""
        alpha, beta, gamma, phi = np.moveaxis(p, -1, 0)
        trend, times = form.trend != "N", form.season == "M"
        beta, gamma, damped = alpha * beta, gamma * (1 - alpha), form.trend == "Ad"
        shape = alpha.shape
        level, slope = np.broadcast_to(self.level, shape).copy(), np.broadcast_to(self.slope, shape).copy() if trend else np.zeros(shape)
        # a season's states lie by the week of the batch, which is the same for all series, and not by that of each series
        own = (self.start + np.arange(self.season)[:, None]) % self.season, np.arange(len(self.n))
        state = None
        if form.season != "N":
            placed = np.empty_like(self.added)
            placed[own] = self.times if times else self.added
            state = np.broadcast_to(placed[:, None, :], (self.season, *shape)).copy()
        squares, shares, logs, bad = np.zeros(shape), np.zeros(shape), np.zeros(shape), np.zeros(shape, bool)
        kept = np.empty((self.rows, *shape)) if each else None
        tiny = 1e-9
        for t in range(self.rows):
            base = level + (phi * slope if damped else slope) if trend else level
            s = state[t % self.season] if state is not None else None
            fit = base if s is None else base * s if times else base + s
            e = self.y[t] - fit
            on = None if t >= self.last else t >= self.start
            if on is not None:
                e = np.where(on, e, 0.0)
            if each:
                kept[t] = e
            judged = self.judged[t]
            if self.any[t]:
                if "A" in errors:
                    squares += e * e if self.all[t] else e * e * judged
                if "M" in errors:
                    good = fit > tiny
                    bad |= judged & ~good
                    safe = np.where(good & judged, fit, 1.0)
                    shares += (e / safe) ** 2 * judged
                    logs += np.log(safe)
            by_level = e / np.where(np.abs(s) > tiny, s, tiny) if times else e
            if s is not None:
                by_season = e / np.where(np.abs(base) > tiny, base, tiny) if times else e
                s += gamma * by_season if on is None else gamma * by_season * on
            level = base + alpha * by_level if on is None else np.where(on, base, level) + alpha * by_level * on
            if trend:
                moved = (phi * slope if damped else slope) + beta * by_level
                slope = moved if on is None else np.where(on, moved, slope)
        n = np.maximum(self.judged.sum(axis=0), 1)
        losses = {"A": lambda: n * np.log(np.maximum(squares / n, 1e-12)), "M": lambda: np.where(bad, np.inf, n * np.log(np.maximum(shares / n, 1e-12)) + 2 * logs)}
        found = [np.where(np.isfinite(loss), loss, np.inf) for loss in (losses[kind]() for kind in errors)]
        if not each:
            return found, None, None
        seasons = np.moveaxis(state[own[0], :, own[1]], -1, 1) if state is not None else np.broadcast_to((np.ones if times else np.zeros)((self.season, 1, 1)), (self.season, *shape))
        return found, State(level, slope, seasons), kept

    def loss(self, form: Form, p: np.ndarray, errors: str = "AM") -> np.ndarray:
        """-2 log likelihood without constants, for each kind of error (kinds x candidates x series)."""
        with np.errstate(all="ignore"):
            return np.stack(self.run(form, p, errors)[0])

    def fitted(self, form: Form, rounds: int = 2, shrinks: int = 2, points: int = 7, errors: str = "AM") -> tuple[np.ndarray, np.ndarray]:
        """Parameters (kinds x series x 4) and loss (kinds x series) of each series with each kind of error, whose states are the same."""
        series, kinds = np.arange(len(self.n)), np.arange(len(errors))[:, None]
        grid = np.unique(np.array([[x if k in form.free else 0.0 for k, x in enumerate(row)] for row in GRID]), axis=0)
        losses = self.loss(form, np.repeat(grid[:, None, :], len(series), axis=1), errors)
        at = losses.argmin(axis=1)
        best, loss = grid[at], losses[kinds, at, series]
        sides = np.delete(np.linspace(-1, 1, points), points // 2) if points % 2 else np.linspace(-1, 1, points)  # the middle is the best point itself
        for turn in range(rounds):
            for k in form.free:
                width = (HIGH[k] - LOW[k]) / 4 / (turn + 1)
                for _ in range(shrinks):
                    tried = np.repeat(best[:, None], len(sides), axis=1)
                    tried[..., k] = np.clip(best[:, None, :, k] + (width * sides)[:, None], LOW[k], HIGH[k])
                    own = np.concatenate([self.loss(form, tried[i], kind) for i, kind in enumerate(errors)])  # each kind of error by its own candidates
                    at = own.argmin(axis=1)
                    lower = own[kinds, at, series]
                    better = lower < loss
                    best, loss = np.where(better[..., None], tried[kinds, at, series], best), np.where(better, lower, loss)
                    width *= 2 / (points - 1)
        return best, loss

    def ahead(self, form: Form, p: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Points and spreads (series x steps) from fitted parameters."""
        _, state, errors = self.run(form, p[None], "A", each=True)
        level, slope, season = state.level[0], state.slope[0], state.season[:, 0]
        k, cols = np.arange(1, steps + 1), np.arange(len(self.n))
        phi = p[:, 3:] if form.trend == "Ad" else np.ones((len(cols), 1))
        damped = np.cumsum(phi**k, axis=1)
        base, s = level[:, None] + slope[:, None] * damped, season[(self.n[:, None] + k - 1) % self.season, cols[:, None]]
        points = base * s if form.season == "M" else base + s
        late = self.behind(self.n // 4)
        sigma = np.sqrt((errors[:, 0] ** 2 * late).sum(axis=0) / late.sum(axis=0))
        # an error moves the level by alpha and the slope by alpha * beta, and the same week of later seasons by gamma
        alpha, beta, gamma = p[:, :1], p[:, 1:2] * p[:, :1] * (form.trend != "N"), p[:, 2:3] * (1 - p[:, :1]) * (form.season != "N")
        passed = alpha + beta * damped + gamma * (k % self.season == 0)
        return points, sigma[:, None] * np.sqrt(1 + np.cumsum(np.concatenate([np.zeros((len(cols), 1)), passed[:, :-1] ** 2], axis=1), axis=1))


def aicc(loss: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    return loss + 2 * k + 2 * k * (k + 1) / np.maximum(n - k - 1, 1)


def ets(series: list[np.ndarray], steps: int, season: int, forms: tuple[Form, ...] = tuple(FORMS)) -> tuple[np.ndarray, np.ndarray]:
    """Points and spreads of each series by its best form; NaN for series of fewer than ``SHORTEST`` weeks."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    good = np.array([k for k, y in enumerate(series) if len(y) >= SHORTEST], int)
    for some in np.split(good, range(TOGETHER, len(good), TOGETHER)):
        if len(some):
            points[some], spreads[some] = chosen([series[k] for k in some], steps, season, forms)[:2]
    return points, spreads


def chosen(series: list[np.ndarray], steps: int, season: int, forms: tuple[Form, ...] = tuple(FORMS)) -> tuple[np.ndarray, np.ndarray, list[Form], np.ndarray]:
    """Points, spreads, form and AICc of each series."""
    points, spreads = (np.full((len(series), steps), np.nan) for _ in range(2))
    score, names = np.full(len(series), np.inf), [forms[0]] * len(series)
    scale = np.array([max(float(np.mean(np.abs(y))), 1e-9) for y in series])
    scaled = [np.asarray(y, float) / s for y, s in zip(series, scale, strict=True)]
    able = Batch(scaled, season)
    for kind in dict.fromkeys((f.trend, f.season) for f in forms):
        tried = [Form(error, *kind) for error in "AM" if Form(error, *kind) in forms]
        at = np.flatnonzero(np.any([able.allowed(f) for f in tried], axis=0))
        if not len(at):
            continue
        can = {form.error: able.allowed(form) for form in tried}
        some = can.get("M", np.zeros(len(series), bool))[at]
        for own, errors in ((at[~some], "A"), (at[some], "AM")):  # series that allow no multiplicative error are not fitted with one
            if not len(own):
                continue
            batch = Batch([scaled[k] for k in own], season)
            fits, losses = batch.fitted(tried[0], errors=errors)
            for form in tried:
                if form.error not in errors:
                    continue
                p, loss = fits[errors.index(form.error)], losses[errors.index(form.error)]
                value = np.where(batch.allowed(form), aicc(loss, batch.judged.sum(axis=0), form.size(season)), np.inf)
                with np.errstate(all="ignore"):
                    made = batch.ahead(form, p, steps)
                better = (value < score[own]) & np.isfinite(made[0]).all(axis=1) & np.isfinite(made[1]).all(axis=1)
                score[own[better]], points[own[better]], spreads[own[better]] = value[better], made[0][better], made[1][better]
                for k in own[better]:
                    names[k] = form
    return points * scale[:, None], spreads * scale[:, None], names, score
