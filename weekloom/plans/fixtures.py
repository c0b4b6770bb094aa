"""The frames that the registered queries share, derived from the sales tables of a directory.

Shared results are written once per session and directory, which keeps the plans that use them short.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weekloom.config import PROTOCOL
from weekloom.operators import backtest, baselines, forecasters, panel, pooled, sampling, score, split
from weekloom.sources.raw import raw_export, weekly_sales
from weekloom.sources.scratch import root_of, written

_held: dict[tuple, DataFrame] = {}


def shared(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(make)
    def held(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = spark.sparkContext.applicationId, sf_dir, make.__name__
        if key not in _held:
            _held[key] = written(make(spark, sf_dir))
        return _held[key]

    return held


@shared
def weekly(spark, d):
    """The sums over all lines that every level and channel of the export is made of."""
    return weekly_sales(spark, d)


@shared
def raw(spark, d):
    return raw_export(weekly(spark, d))


@shared
def panel_rows(spark, d):
    """From the export as a view: levels and channels out of scope are not made."""
    return panel.panel(raw_export(weekly(spark, d)), PROTOCOL)


@shared
def folds(spark, d):
    return split.origins(panel_rows(spark, d), PROTOCOL)


@shared
def checked(spark, d):
    return split.eligibility(panel_rows(spark, d), folds(spark, d), PROTOCOL)


def first_origin(spark, d):
    return folds(spark, d).agg(F.min("origin").alias("origin"))


@shared
def denominators(spark, d):
    return score.seasonal_denominators(panel_rows(spark, d), first_origin(spark, d), PROTOCOL.season)


@shared
def eligible(spark, d):
    return sampling.eligible_profile(sampling.series_profile(panel_rows(spark, d)), checked(spark, d), denominators(spark, d))


@shared
def eligible_panel(spark, d):
    return panel_rows(spark, d).join(eligible(spark, d).select("unique_id"), "unique_id", "left_semi")


@shared
def filled(spark, d):
    return split.imputed_folds(eligible_panel(spark, d).select("unique_id", "ds", "y"), folds(spark, d)).select("fold", "origin", "unique_id", "ds", "y", "filled")


@shared
def series(spark, d):
    """The training frame with a row per series and fold."""
    return split.imputed_series(eligible_panel(spark, d), folds(spark, d))


@shared
def filled_known(spark, d):
    """The training frame with the covariates measured in its weeks."""
    return split.imputed_folds(eligible_panel(spark, d).select("unique_id", "ds", "y", "units", "arp"), folds(spark, d)).select("fold", "origin", "unique_id", "ds", "y", "units", "arp", "filled")


@shared
def future(spark, d):
    return split.future_covariates(eligible_panel(spark, d), folds(spark, d), PROTOCOL)


@shared
def actual(spark, d):
    return split.test_window(eligible_panel(spark, d), folds(spark, d), PROTOCOL)


@shared
def forecasts(spark, d):
    return baselines.of_series(series(spark, d), PROTOCOL)


@shared
def metrics(spark, d):
    made, test = forecasts(spark, d), actual(spark, d)
    rows = score.score_both(test, made, denominators(spark, d), PROTOCOL)
    return rows.withColumn("repeat", F.lit(0)).withColumn("covariates", F.when(F.col("fold") < 4, F.col("fold") % 2 == 1))


def timings_of(rows: DataFrame, *by: str) -> DataFrame:
    """Cost rows that follow from the size of each unit, for three repeats, and a failed unit per model."""
    units = rows.groupBy(*by, "model", "fold", "horizon").agg(F.count_distinct("unique_id").alias("units"))
    base = F.when(F.col("model") == "naive", 1.0).when(F.col("model") == "seasonal_naive", 2.0).otherwise(3.0)
    ok = units.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        *by, "model", F.lit("baseline").alias("family"), "fold", "horizon", "repeat",
        F.concat_ws("|", "model", "fold", "repeat", F.when(F.col("model") == "mean_13", F.col("horizon")).otherwise(0)).alias("fit_key"),
        ((F.col("horizon") == 13) & (F.col("model") != "mean_13")).alias("fit_reused"),
        (base * F.col("units") / 100 + 0.1 * F.col("fold") + 0.01 * F.col("repeat")).alias("fit_seconds"), (0.01 * F.col("horizon") + 0.001 * F.col("repeat")).alias("predict_seconds"),
        (F.col("units") * 1.5).alias("peak_memory_mb"), F.col("units").alias("unit_series"), (F.col("units") * 2).alias("n_params"), F.lit(0).alias("tuning_trials"),
        F.lit("ok").alias("status"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("error"),
    )
    failed = units.where("horizon = 4 AND fold = 0").select(
        *by, "model", F.lit("baseline").alias("family"), "fold", "horizon", F.lit(9).alias("repeat"), F.concat_ws("|", "model", F.lit("failed")).alias("fit_key"), F.lit(False).alias("fit_reused"),
        F.lit("failed").alias("status"), F.lit("fit").alias("stage"), F.repeat(F.concat("model", F.lit(" broke. ")), F.lit(40)).alias("error"), F.lit(0).alias("tuning_trials"),
    )
    build = F.concat(F.lit("b"), (F.col("fold") % 2).cast("string"))
    out = ok.unionByName(failed, allowMissingColumns=True).withColumn("build", F.when(F.col("model") == "naive", "b0").otherwise(build)).withColumn("built_at", F.when(F.col("build") == "b0", 1).otherwise(2))
    out = out.withColumn("result_key", F.substring(F.md5(F.col("model").cast("binary")), 1, 8))
    return out if "n_series" in by else out.withColumnRenamed("unit_series", "n_series")


@shared
def timings(spark, d):
    return timings_of(metrics(spark, d))


def models(spark, d) -> list[backtest.Model]:
    """Every model of the package, and one with covariates."""
    ahead = future(spark, d)
    by_rule = {"naive": baselines.naive, "seasonal_naive": baselines.seasonal_naive, "mean_13": baselines.window_mean}
    pooled = {"ridge_global": forecasters.ridge_global, "linear_global": forecasters.linear_global}
    return [
        *[backtest.Model(name, lambda rows, _, fit=fit: fit(rows, PROTOCOL), "baseline", one_pass=True) for name, fit in by_rule.items()],
        *[backtest.Model(name, lambda rows, _, name=name, fit=fit: forecasters.per_series(rows, name, fit, PROTOCOL), one_pass=True, gathered=True) for name, fit in forecasters.LOCAL.items()],
        *[backtest.Model(name, lambda rows, _, fit=fit: fit(rows, PROTOCOL), "global", covariates=False if name == "ridge_global" else None, gathered=True) for name, fit in pooled.items()],
        backtest.Model("ridge_global", lambda rows, _: forecasters.ridge_global(rows, PROTOCOL, future=ahead), "global", covariates=True),
        backtest.Model("gbt_global", lambda rows, seed: forecasters.gbt_global(rows, PROTOCOL, seed=seed), "global", repeats=3, gathered=True),
    ]


_stores: dict[tuple, str] = {}


def store(spark, d) -> str:
    """The results store of the whole backtest, run once per session and directory."""
    key = spark.sparkContext.applicationId, d
    if key not in _stores:
        root = f"{root_of(spark)}/{uuid.uuid4().hex}"
        backtest.run(filled_known(spark, d), actual(spark, d), denominators(spark, d), models(spark, d), PROTOCOL, root, workers=4)
        _stores[key] = root
    return _stores[key]


@shared
def labelled(spark, d):
    return sampling.strata(eligible(spark, d), PROTOCOL)


@shared
def ladder(spark, d):
    """Stratified samples of a quarter, half and all of the labelled series, each drawn with the same seed."""
    pool = labelled(spark, d)
    n = pool.count()
    out = None
    for size in sorted({n // 4, n // 2, n}):
        rung = sampling.stratified_sample(pool, size, PROTOCOL.seed).select("unique_id", "stratum").withColumn("n_series", F.lit(size).cast("long"))
        out = rung if out is None else out.unionByName(rung)
    return out


@shared
def nested(spark, d):
    """Nested rungs of a quarter, half and all of the labelled series; the stratified sample of a half is the anchor."""
    pool = labelled(spark, d)
    n = pool.count()
    return sampling.nested_ladder(pool, sampling.stratified_sample(pool, n // 2, PROTOCOL.seed), sorted({max(n // 4, 1), n // 2, n}), PROTOCOL.seed).select("unique_id", "stratum", "n_series")


@shared
def fitted_rungs(spark, d):
    """Scores of the pooled models fitted on each rung, for the series that all rungs have."""
    rows, ladder_rows = filled(spark, d), nested(spark, d)
    made = written(pooled.ladder(rows, ladder_rows, [pooled.lagged(PROTOCOL), pooled.direct(PROTOCOL)], PROTOCOL))
    ids = ladder_rows.where(F.col("n_series") == ladder_rows.agg(F.min("n_series")).first()[0]).select("unique_id")
    test, arm = actual(spark, d).join(ids, "unique_id", "left_semi"), F.concat_ws("|", "model", "n_series")
    made = made.withColumn("model", arm).drop("n_series")
    rows = score.score_both(test, made, denominators(spark, d), PROTOCOL)
    parts = F.split("model", r"\|")
    return rows.withColumn("n_series", parts[1].cast("long")).withColumn("model", parts[0])


@shared
def rungs(spark, d):
    return metrics(spark, d).join(ladder(spark, d).select("unique_id", "n_series"), "unique_id")


@shared
def rung_timings(spark, d):
    return timings_of(rungs(spark, d), "n_series")


@shared
def blocks(spark, d):
    from weekloom.operators.tables import blocks as of

    return of(metrics(spark, d), "MASE", 4)


@shared
def trials(spark, d):
    """Mean MASE of window means and medians of several lengths, over the weeks after the tuning origin."""
    rows, start = eligible_panel(spark, d), split.tuning_origin(folds(spark, d), PROTOCOL)
    at = rows.join(F.broadcast(start))  # one row
    train = split.impute(at.where("ds <= tuning_origin").select("unique_id", "ds", "y"))
    back = train.withColumn("back", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds"))))
    weeks = F.array(*[F.struct(F.lit(k).alias("trial"), F.lit(w).alias("weeks")) for k, w in enumerate((4, 8, 13, 26))])
    made = back.withColumn("t", F.explode(weeks)).where("back <= t.weeks").groupBy("unique_id", "t.trial", "t.weeks").agg(F.avg("y").alias("mean"), F.median("y").alias("median"))
    made = made.select("unique_id", "trial", "weeks", F.explode(F.array(F.struct(F.lit("recent_mean").alias("model"), F.col("mean").alias("yhat")), F.struct(F.lit("recent_median").alias("model"), F.col("median").alias("yhat")))).alias("f")).select("unique_id", "trial", "weeks", "f.*")
    test = at.where((F.col("ds") > F.col("tuning_origin")) & (F.col("ds") <= F.date_add("tuning_origin", PROTOCOL.longest * 7)) & F.col("y").isNotNull()).select("unique_id", "y")
    per = test.join(made, "unique_id").groupBy("model", "trial", "weeks", "unique_id").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae")).join(denominators(spark, d).select("unique_id", "mase_den"), "unique_id")
    by = per.groupBy("model", "trial", "weeks").agg(F.round(F.avg(F.col("mae") / F.col("mase_den")), 9).alias("value"))
    failed = (F.col("model") == "recent_median") & (F.col("trial") == 0)
    return by.select("model", "trial", F.concat(F.lit("weeks="), F.col("weeks").cast("string")).alias("params"), F.when(~failed, F.col("value")).alias("value"), F.when(failed, "failed").otherwise("ok").alias("status"))
