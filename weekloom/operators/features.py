"""Features of series: lags, rolling means, context windows and spreads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol


def lag_features(rows: DataFrame, protocol: Protocol, by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """Lags 1, 2, 3, 4, 13, 26 and a season; means of the last 4, 13 and a season of weeks before (NULL until full); calendar parts."""
    w = Window.partitionBy(*by).orderBy("ds")
    lags = {f"lag_{k}": F.lag("y", k).over(w) for k in sorted({1, 2, 3, 4, 13, 26, protocol.season})}
    means = {}
    for k in sorted({4, 13, protocol.season}):
        frame = w.rowsBetween(-k, -1)
        means[f"mean_{k}"] = F.when(F.count("y").over(frame) == k, F.avg("y").over(frame))
    return rows.withColumns({**lags, **means, "week": F.weekofyear("ds"), "month": F.month("ds"), "quarter": F.quarter("ds")})


def context_tail(rows: DataFrame, size: int, by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """The last ``size`` values of each series in order of time, as an array; missing ones are left out."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ds")))
    kept = rows.where(F.col("y").isNotNull()).withColumn("back", back).where(F.col("back") <= size)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda x: x["y"]).alias("context"))


def context_padded(tails: DataFrame, size: int) -> DataFrame:
    """Contexts brought to one length by repeating their first value before them, and which places are real."""
    short = F.lit(size) - F.size("context")
    mask = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: k > short)
    return tails.withColumn("padded", F.concat(F.array_repeat(F.col("context")[0], short), "context")).withColumn("mask", mask)


def context_spread(tails: DataFrame) -> DataFrame:
    """Population standard deviation of the first differences of each context; 0 for a single value."""
    diffs = F.zip_with(F.slice("context", F.lit(2), F.greatest(F.size("context") - 1, F.lit(0))), "context", lambda a, b: F.when(a.isNotNull(), a - b))
    diffs = F.filter(diffs, lambda x: x.isNotNull())
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = tails.withColumn("d", diffs).withColumn("m", F.try_divide(total(F.col("d")), F.size("d")))
    return rows.withColumn("spread", F.coalesce(F.sqrt(F.try_divide(total(F.transform("d", lambda x: (x - F.col("m")) * (x - F.col("m")))), F.size("d"))), F.lit(0.0))).drop("d", "m")
