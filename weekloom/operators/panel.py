"""From export rows to a complete weekly panel, and its integrity checks.

An omitted week is an observed zero; a week that is present with a NULL amount is unknown.
``row_present`` keeps the two apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.sources.raw import in_scope

STATICS = ("internal_id", "geography")
KEY = "unique_id"


def scoped(raw: DataFrame, protocol: Protocol) -> DataFrame:
    return raw.where(in_scope(protocol))


def keyed(raw: DataFrame, protocol: Protocol) -> DataFrame:
    """unique_id, ds, y, units, arp and statics of the rows in scope."""
    return scoped(raw, protocol).select(
        F.concat_ws("@@", "internal_id", "Geography").alias("unique_id"), F.col("Time_Period_End_Date").alias("ds"), F.col(protocol.target).alias("y"),
        F.col("Units").alias("units"), F.col("ARP").alias("arp"), "internal_id", F.col("Geography").alias("geography"),
    )


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """How many rows are beyond the first of their (series, week)."""
    return rows.groupBy("unique_id", "ds").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_extra_rows"))


def first_five(names: DataFrame) -> str:
    """The first five names of a one-column frame, in order, as text for a message."""
    found = [str(r[0]) for r in names.distinct().orderBy(names.columns[0]).limit(6).collect()]
    return ", ".join(found[:5]) + (" and others" if len(found) > 5 else "")


def assert_unique_keys(rows: DataFrame) -> DataFrame:
    """The rows, or an error that names the first series with two rows in a week."""
    extra = duplicate_keys(rows).first()[0]
    if extra:
        raise ValueError(f"{extra} rows repeat a week, of series {first_five(rows.groupBy('unique_id', 'ds').count().where('count > 1').select('unique_id'))}")
    return rows


def assert_weekly(rows: DataFrame) -> DataFrame:
    """The rows, or an error that names the first dates on another weekday than most, or after a gap that is no whole number of weeks."""
    found = weekly_check(rows).first()
    if found["n_weekdays"] > 1:
        usual = rows.select("ds").distinct().groupBy(F.dayofweek("ds").alias("day")).count().orderBy(F.desc("count"), "day").first()["day"]
        raise ValueError(f"dates fall on {found['n_weekdays']} weekdays, not one: {first_five(rows.where(F.dayofweek('ds') != usual).select('ds'))}")
    if found["n_bad_gaps"]:
        raise ValueError(f"{found['n_bad_gaps']} gaps between dates are no whole number of weeks")
    return rows


def weekly_check(rows: DataFrame) -> DataFrame:
    """Distinct dates, weekdays, and gaps that are no whole number of weeks."""
    dates = rows.select("ds").distinct()
    gaps = dates.select("ds", F.date_diff("ds", F.lag("ds").over(Window.orderBy("ds"))).alias("gap"))  # one row per week of the calendar
    return gaps.agg(
        F.count("*").alias("n_dates"), F.count_distinct(F.dayofweek("ds")).alias("n_weekdays"), F.count_if(F.col("gap") % 7 != 0).alias("n_bad_gaps"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.min(F.dayofweek("ds")).cast("long").alias("weekday"),
    )


def next_known(value: str, by: tuple[str, ...] = (KEY,)) -> Column:
    """The value of the next week of a series that has one, from the sort by week that the windows over earlier weeks need as well."""
    return F.expr(f"lead({value}) IGNORE NULLS OVER (PARTITION BY {', '.join(by)} ORDER BY ds)")


def grid(rows: DataFrame, protocol: Protocol) -> DataFrame:
    """Every week between a series' first and last row.

    Each row is followed by the weeks up to the next one, so no grid has to be joined.
    """
    series = Window.partitionBy("unique_id").orderBy("ds")
    upto = F.greatest("ds", F.coalesce(F.date_sub(F.lead("ds").over(series), 7), F.col("ds")))
    # statics come from the last row that has them, before any from the next one; the weeks that follow a row take its own
    known = {c: F.coalesce(F.last(c, ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0)), next_known(c)) for c in STATICS}
    weeks = rows.withColumns({"upto": upto, **known}).withColumn("week", F.explode(F.sequence("ds", "upto", F.expr("INTERVAL 7 DAYS"))))
    present = F.col("week") == F.col("ds")
    absent = F.lit(0.0) if protocol.absent == "zero" else F.lit(None).cast("double")
    return weeks.select(
        "unique_id", F.col("week").alias("ds"), F.when(present, F.col("y")).otherwise(absent).alias("y"), present.alias("row_present"),
        *[F.when(present, F.col(c)).alias(c) for c in ("units", "arp")], *STATICS,
    )


def panel(raw: DataFrame, protocol: Protocol) -> DataFrame:
    if protocol.absent not in ("zero", "missing"):
        raise ValueError(f"absent must be 'zero' or 'missing', not {protocol.absent!r}")
    return grid(keyed(raw, protocol), protocol)


def panel_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_distinct("unique_id").alias("n_series"), F.count("*").alias("n_rows"), F.count_if("row_present").alias("n_present"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


def first_series(rows: DataFrame, n: int) -> DataFrame:
    """The rows of the first n series by name."""
    return rows.join(rows.select("unique_id").distinct().orderBy("unique_id").limit(n), "unique_id", "left_semi")
