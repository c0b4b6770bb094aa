"""Baseline forecasts as plain DataFrame jobs: last value, last season, mean of the last weeks; and quantile tools.

``filled`` is the gap-filled training frame of all folds (fold, origin, unique_id, ds, y).
Forecasts have model, fold, unique_id, step, yhat and q, the quantiles at the protocol's levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol

SERIES = ["fold", "unique_id"]


def z_values(protocol: Protocol) -> list[float]:
    return [NormalDist().inv_cdf(q) for q in protocol.levels]


def widened(point: Column, spread: Column, protocol: Protocol) -> Column:
    """point + spread * z at each level."""
    return F.array(*[point + spread * F.lit(z) for z in z_values(protocol)])


def repaired(q: Column) -> Column:
    """Quantiles in order."""
    return F.array_sort(q)


def interval_quantiles(bounds: dict[int, tuple[Column, Column]], point: Column) -> Column:
    """Central intervals (80, 60, 40, 20 percent: low, high) and the point as the nine deciles, in order."""
    lows = [bounds[c][0] for c in (80, 60, 40, 20)]
    highs = [bounds[c][1] for c in (20, 40, 60, 80)]
    return repaired(F.array(*lows, point, *highs))


def _steps(protocol: Protocol) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(protocol.longest))).alias("step")


def _finish(rows: DataFrame, model: str, point: Column, spread: Column, protocol: Protocol) -> DataFrame:
    return rows.select(F.lit(model).alias("model"), *SERIES, "step", point.alias("yhat"), widened(point, spread, protocol).alias("q"))


def summaries(series: DataFrame, season: int, weeks: int) -> DataFrame:
    """What the baselines ask of each series (fold, unique_id, context): its last value and season, root mean square differences over a week and a season, mean and deviation of the last weeks."""

    def differences(y: np.ndarray, lag: int) -> float | None:
        d = y[lag:] - y[:-lag]
        return float(np.sqrt(np.mean(d * d))) if len(d) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            y = [np.asarray(x, float) for x in rows["context"]]
            tails = [x[-weeks:] for x in y]
            yield rows[SERIES].assign(
                last=[x[-1] if len(x) else None for x in y], by_week=[differences(x, 1) for x in y], by_season=[differences(x, season) for x in y], season=[x[-season:] for x in y],
                mean=[x.mean() if len(x) else None for x in tails], sd=[x.std() if len(x) else None for x in tails],
            )

    return series.select(*SERIES, "context").mapInPandas(run, "fold int, unique_id string, last double, by_week double, by_season double, season array<double>, mean double, sd double")


def of_series(series: DataFrame, protocol: Protocol, weeks: int = 13) -> DataFrame:
    """The forecasts of ``naive``, ``seasonal_naive`` and ``window_mean`` from gathered series, each read once for all three."""
    m, step, grown = protocol.season, F.col("step"), lambda n: F.sqrt(n.cast("double"))
    back = F.size("season") - (m - 1 - (step - 1) % m)  # from 1, the place of the week a season before the one ahead
    models = F.array(*[F.struct(F.lit(name).alias("model"), point.alias("yhat"), spread.alias("spread")) for name, point, spread in (
        ("naive", F.col("last"), F.col("by_week") * grown(step)),
        ("seasonal_naive", F.when(back >= 1, F.try_element_at("season", F.greatest(back, F.lit(1)).cast("int"))), F.col("by_season") * grown(F.floor((step - 1) / m) + 1)),
        (f"mean_{weeks}", F.col("mean"), F.col("sd")),
    )])
    rows = summaries(series, m, weeks).select("*", _steps(protocol)).select(*SERIES, "step", F.explode(models).alias("f"))
    return rows.select("f.model", *SERIES, "step", "f.yhat", widened(F.col("f.yhat"), F.col("f.spread"), protocol).alias("q"))


def naive(filled: DataFrame, protocol: Protocol) -> DataFrame:
    d = F.col("y") - F.lag("y").over(Window.partitionBy(*SERIES).orderBy("ds"))
    by = filled.select(*SERIES, "ds", "y", d.alias("d")).groupBy(*SERIES).agg(F.max_by("y", "ds").alias("last"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sigma"))
    return _finish(by.select("*", _steps(protocol)), "naive", F.col("last"), F.col("sigma") * F.sqrt(F.col("step").cast("double")), protocol)


def seasonal_naive(filled: DataFrame, protocol: Protocol) -> DataFrame:
    m = protocol.season
    w = Window.partitionBy(*SERIES).orderBy("ds")
    d = F.col("y") - F.lag("y", m).over(w)
    rows = filled.select(*SERIES, "ds", "y", d.alias("d"), F.row_number().over(w.orderBy(F.desc("ds"))).alias("back"))
    by = rows.groupBy(*SERIES).agg(
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("sigma"), F.map_from_entries(F.collect_list(F.when(F.col("back") <= m, F.struct("back", "y")))).alias("season"),
    )  # at most m entries
    step = F.col("step")
    ago = m - (step - 1) % m
    point = F.try_element_at("season", ago.cast("int"))
    return _finish(by.select("*", _steps(protocol)), "seasonal_naive", point, F.col("sigma") * F.sqrt((F.floor((step - 1) / m) + 1).cast("double")), protocol)


def window_mean(filled: DataFrame, protocol: Protocol, weeks: int = 13, name: str = "mean_13") -> DataFrame:
    rows = filled.withColumn("back", F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("ds"))))
    by = rows.where(F.col("back") <= weeks).groupBy(*SERIES).agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))
    return _finish(by.select("*", _steps(protocol)), name, F.col("mean"), F.col("sd"), protocol)
