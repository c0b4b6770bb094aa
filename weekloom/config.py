"""The evaluation protocol, as values of one small record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Protocol:
    season: int = 52
    folds: int = 5
    step: int = 4
    horizons: tuple[int, ...] = (4, 13)
    min_train: int = 104
    min_observed: int = 156
    deciles: int = 10
    zero_bins: tuple[float, ...] = (0.0, 0.05, 0.2, 1.01)
    levels: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
    coverage: tuple[float, ...] = (0.8,)
    seed: int = 42
    absent: str = "zero"
    geography_levels: tuple[str, ...] = ("MARKET",)
    channels: tuple[str, ...] = ("CONVENTIONAL|MULTI OUTLET",)
    target: str = "Dollars"
    baseline: str = "seasonal_naive"

    @property
    def longest(self) -> int:
        return max(self.horizons)


PROTOCOL = Protocol()
