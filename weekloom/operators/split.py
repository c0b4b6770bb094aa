"""Rolling origins: folds, windows, eligibility, gap filling and covariates that are known beforehand.

Nothing after a fold's origin is ever read for that fold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.operators.panel import first_five, next_known


def origins(panel: DataFrame, protocol: Protocol) -> DataFrame:
    """fold, origin: as many rows as folds.  The last origin leaves the longest horizon."""
    ends = panel.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    back = protocol.longest * 7
    return ends.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(protocol.folds - 1))).alias("fold")).select(
        "fold", F.date_sub(F.col("hi"), F.lit(back) + (protocol.folds - 1 - F.col("fold")) * protocol.step * 7).alias("origin"),
        F.when(F.date_sub("hi", back + (protocol.folds - 1) * protocol.step * 7) <= F.col("lo"), F.raise_error(F.lit("the panel is too short for the folds"))).cast("string").alias("error"),
    ).where("error IS NULL").select("fold", "origin")


def tuning_origin(folds: DataFrame, protocol: Protocol) -> DataFrame:
    """A whole longest horizon before the first origin, so that tuning never sees test weeks."""
    return folds.agg(F.date_sub(F.min("origin"), protocol.longest * 7).alias("tuning_origin"))


def training(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """All rows up to each fold's origin.  ``folds`` has one row per fold (a handful), so it is broadcast."""
    return panel.join(F.broadcast(folds), F.col("ds") <= F.col("origin"))


def train_counts(panel: DataFrame, folds: DataFrame, protocol: Protocol) -> DataFrame:
    return training(panel, folds).groupBy("fold", "origin").agg(F.count("*").alias("n_rows"), F.count_distinct("ds").alias("n_train_weeks"), F.count_distinct("unique_id").alias("n_series"), F.max("ds").alias("last_ds")).withColumn("overlap", F.lit(protocol.step < protocol.longest))


def test_window(panel: DataFrame, folds: DataFrame, protocol: Protocol) -> DataFrame:
    """fold, unique_id, step, ds, y: exactly one row per week ahead for each series that has training rows."""
    spans = panel.groupBy("unique_id").agg(F.min("ds").alias("first_ds"))
    grid = spans.join(F.broadcast(folds), F.col("first_ds") <= F.col("origin")).select("fold", "unique_id", "origin", F.explode(F.sequence(F.lit(1), F.lit(protocol.longest))).alias("step"))
    grid = grid.withColumn("ds", F.date_add("origin", F.col("step") * 7))
    first = folds.agg(F.min("origin").alias("first"))
    late = panel.select("unique_id", "ds", "y").join(F.broadcast(first), F.col("ds") > F.col("first"))  # no window holds an earlier week
    return grid.join(late, ["unique_id", "ds"], "left").select("fold", "unique_id", "step", "ds", "y")


def eligibility(panel: DataFrame, folds: DataFrame, protocol: Protocol) -> DataFrame:
    """Observed weeks at the earliest origin, last observation, and the two requirements, of every series."""
    ends = folds.agg(F.min("origin").alias("lo"), F.max("origin").alias("hi"))
    seen = F.col("y").isNotNull()
    by = panel.join(F.broadcast(ends)).groupBy("unique_id").agg(
        F.count_if(seen & (F.col("ds") <= F.col("lo"))).alias("n_train"), F.max(F.when(seen, F.col("ds"))).alias("last_obs"), F.date_add(F.first("hi"), protocol.longest * 7).alias("needs"),
    )
    return by.select("unique_id", "n_train", "last_obs", (F.col("n_train") >= protocol.min_train).alias("meets_min_train"), F.coalesce(F.col("last_obs") >= F.col("needs"), F.lit(False)).alias("covers_span"))


def feasible(checked: DataFrame) -> DataFrame:
    """One row that says whether every series meets the protocol."""
    return checked.agg(
        F.count("*").alias("n_series"), F.count_if(~F.col("meets_min_train")).alias("n_below_min_train"), F.count_if(~F.col("covers_span")).alias("n_uncovered"), F.min("n_train").alias("least_train"),
        (F.count_if(~F.col("meets_min_train") | ~F.col("covers_span")) == 0).alias("feasible"),
    )


def assert_feasible(checked: DataFrame) -> dict:
    row = feasible(checked).first().asDict()
    if not row["feasible"]:
        raise ValueError(f"{row['n_below_min_train']} series are below the minimum, {row['n_uncovered']} do not cover the span")
    return row


def between(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds ``before`` and ``after``, the last and the next known week (ds, y) of each week, by one sort of each series."""
    forth = Window.partitionBy(*by).orderBy("ds").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("seen", F.when(F.col("y").isNotNull(), F.struct("ds", "y")))
    return seen.withColumns({"before": F.last("seen", ignorenulls=True).over(forth), "after": next_known("seen", by)}).drop("seen")


def bridged(rows: DataFrame) -> DataFrame:
    """Rows of ``between`` with their gaps filled."""
    share = F.date_diff("ds", "before.ds") / F.date_diff("after.ds", "before.ds")
    line = F.col("before.y") + (F.col("after.y") - F.col("before.y")) * share
    gap = F.col("y").isNull()
    filled = F.when(~gap, "observed").when(F.col("before").isNull(), "missing").when(F.col("after").isNull(), "carried").otherwise("imputed")
    value = F.when(~gap, F.col("y")).when(F.col("after").isNull(), F.col("before.y")).when(F.col("before").isNotNull(), line)
    return rows.withColumn("filled", filled).withColumn("y", value).drop("before", "after")


def impute(rows: DataFrame, by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """Fills gaps between two observations linearly and carries the last one forward; ``filled`` says how."""
    return bridged(between(rows, by))


def imputed_folds(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """The training rows of all folds with their gaps filled, as ``impute`` of ``training`` gives them.

    A series is sorted once for all folds: a fold only differs in that a next known week after its origin is none.
    """
    rows = training(between(panel, ("unique_id",)), folds)
    return bridged(rows.withColumn("after", F.when(F.col("after.ds") <= F.col("origin"), F.col("after"))))


def imputed_series(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, unique_id, context: the known values of each series of ``imputed_folds`` in order of the weeks, as an array.

    A series (some hundred weeks) is gathered once and cut for each fold; in a gap whose end lies after the cut, the last known value is carried.
    """
    rows = between(panel.select("unique_id", "ds", "y"), ("unique_id",))
    held = F.when(F.col("y").isNull(), F.col("before.y")).alias("held")
    weeks = bridged(rows.withColumns({"until": F.when(F.col("y").isNull(), F.col("after.ds")), "held": held})).groupBy("unique_id").agg(F.array_sort(F.collect_list(F.struct("ds", "y", "until", "held"))).alias("weeks"))
    cut = weeks.join(F.broadcast(folds), F.col("weeks")[0]["ds"] <= F.col("origin"))
    upto = F.filter("weeks", lambda x: (x["ds"] <= F.col("origin")) & x["y"].isNotNull())
    return cut.select("fold", "unique_id", F.transform(upto, lambda x: F.when(x["until"] > F.col("origin"), x["held"]).otherwise(x["y"])).alias("context"))


def impute_report(filled: DataFrame) -> DataFrame:
    return filled.agg(*[f for kind in ("imputed", "carried", "missing") for f in (F.count_if(F.col("filled") == kind).alias(f"n_{kind}"), F.count_distinct(F.when(F.col("filled") == kind, F.col("unique_id"))).alias(f"n_series_{kind}"))])


def behind_origin(train: DataFrame) -> DataFrame:
    """Series of a training frame whose last value lies before the fold's origin."""
    last = train.groupBy("fold", "unique_id").agg(F.max(F.when(F.col("y").isNotNull(), F.col("ds"))).alias("last_ds"), F.first("origin").alias("origin"))
    return last.where("last_ds IS NULL OR last_ds < origin")


def assert_reaches_origin(train: DataFrame) -> DataFrame:
    """The frame, or an error that names the first series whose last value lies before its fold's origin."""
    late = behind_origin(train)
    n = late.count()
    if n:
        raise ValueError(f"{n} series of a fold end before its origin: {first_five(late.select('unique_id'))}")
    return train


def assert_feasible(checked: DataFrame, protocol: Protocol) -> DataFrame:
    """The checked series, or an error that names the first that are too short for the protocol or do not reach its span."""
    short, open_ = checked.where("NOT meets_min_train"), checked.where("NOT covers_span")
    for rows, what in ((short, f"have fewer than {protocol.min_train} weeks to learn from"), (open_, "do not cover the folds")):
        if n := rows.count():
            raise ValueError(f"{n} series {what}: {first_five(rows.select('unique_id'))}")
    return checked


#: What each column beside the target is to a model.
STATIC, KNOWN, MEASURED = ("internal_id", "geography"), ("y_yago", "units_yago", "arp_yago", "planned_arp", "week_of_year"), {"Units": "units", "ARP": "arp"}


def covariate_roles(target: str) -> dict[str, tuple[str, ...]]:
    """Columns by role: constant for a series, known of the weeks ahead, and measured in the week itself (never the target)."""
    return {"static": STATIC, "known": KNOWN, "measured": tuple(c for name, c in MEASURED.items() if name != target)}


def future_covariates(panel: DataFrame, folds: DataFrame, protocol: Protocol) -> DataFrame:
    """What a forecast may know about the weeks ahead: year-ago values, the last price, the calendar, statics."""
    train = training(panel, folds)
    held = train.groupBy("fold", "unique_id").agg(
        F.first("origin").alias("origin"), F.max_by("arp", F.when(F.col("arp").isNotNull(), F.col("ds"))).alias("planned_arp"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ds"))).alias(c) for c in ("internal_id", "geography")],
    )
    ahead = held.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(protocol.longest)))).withColumn("ds", F.date_add("origin", F.col("step") * 7))
    ago = train.select("fold", "unique_id", F.date_add("ds", 7 * 52).alias("ds"), F.col("y").alias("y_yago"), F.col("units").alias("units_yago"), F.col("arp").alias("arp_yago"))
    return ahead.join(ago, ["fold", "unique_id", "ds"], "left").select("fold", "unique_id", "ds", "step", "y_yago", "units_yago", "arp_yago", "planned_arp", F.weekofyear("ds").alias("week_of_year"), "internal_id", "geography")
