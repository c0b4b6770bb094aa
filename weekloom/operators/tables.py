"""Accuracy, cost and ranking tables over the long result tables ``metrics`` and ``timings``.

metrics: model, fold, horizon, repeat, unique_id, metric, value, n_points, n_undefined [, covariates]
timings: model, family, fold, horizon, repeat, fit_key, fit_reused, fit_seconds, predict_seconds, peak_memory_mb,
         n_series, n_params, status, tuning_trials
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol

def of_metric(metrics: DataFrame, metric: str) -> DataFrame:
    return metrics.where(F.col("metric") == metric)


def label_ablation_arms(metrics: DataFrame) -> DataFrame:
    """Runs with covariates become models of their own, ``model+cov``."""
    if "covariates" not in metrics.columns:
        return metrics
    return metrics.withColumn("model", F.when(F.coalesce("covariates", F.lit(False)), F.concat("model", F.lit("+cov"))).otherwise(F.col("model")))


def accuracy_table(metrics: DataFrame, metric: str) -> DataFrame:
    return of_metric(metrics, metric).groupBy("model", "horizon").agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n"))


def main_accuracy(metrics: DataFrame, protocol: Protocol, names: tuple[str, ...] = ("MASE", "RMSSE", "sMAPE")) -> DataFrame:
    """One wide row per model: median of each metric at each horizon, and the pooled coverage."""
    cell = lambda m, h: (F.col("metric") == m) & (F.col("horizon") == h)
    cells = [F.median(F.when(cell(m, h), F.col("value"))).alias(f"{m}_h{h}") for m in names for h in protocol.horizons]
    covered = [F.try_divide(F.sum(F.when(cell("coverage_80", h), F.col("value") * F.col("n_points"))), F.sum(F.when(cell("coverage_80", h) & F.col("value").isNotNull(), F.col("n_points")))).alias(f"coverage_80_h{h}") for h in protocol.horizons]
    return metrics.where(F.col("metric").isin(*names, "coverage_80")).groupBy("model").agg(*cells, *covered)


def pooled_coverage(metrics: DataFrame, metric: str = "coverage_80") -> DataFrame:
    return of_metric(metrics, metric).where("value IS NOT NULL").groupBy("model", "horizon").agg((F.sum(F.col("value") * F.col("n_points")) / F.sum("n_points")).alias("coverage"), F.sum("n_points").alias("n_points"))


def skill_scores(metrics: DataFrame, baseline: str, metric: str = "MASE") -> DataFrame:
    """1 - value / baseline's value of each model, series, horizon and fold; NULL where that is not finite."""
    keys = ["unique_id", "horizon", "fold"]
    per = of_metric(metrics, metric).groupBy("model", *keys).agg(F.avg("value").alias("value"))
    base = per.where(F.col("model") == baseline).select(*keys, F.col("value").alias("baseline"))
    return per.join(base, keys, "left").withColumn("skill", 1 - F.try_divide("value", "baseline"))


def error_distribution(metrics: DataFrame, metric: str = "MASE") -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    by = of_metric(metrics, metric).groupBy("model", "horizon").agg(q.alias("q"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    return by.select("model", "horizon", "low", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "high", "n")


def ranking_flip(metrics: DataFrame, ids: DataFrame, horizon: int, pair: tuple[str, str] = ("MASE", "sMAPE")) -> DataFrame:
    """Medians of two metrics on one set of series, their ranks (ties take the least) and the difference."""
    a, b = pair
    rows = metrics.where((F.col("horizon") == horizon) & F.col("metric").isin(a, b)).join(ids.select("unique_id"), "unique_id", "left_semi")
    by = rows.groupBy("model").agg(*[F.median(F.when(F.col("metric") == m, F.round("value", 9))).alias(m) for m in pair])
    rank = lambda m: F.rank().over(Window.orderBy(m))  # noqa: E731  one row per model
    return by.select("model", F.col(a).alias("first"), F.col(b).alias("second"), rank(a).alias("rank_first"), rank(b).alias("rank_second")).withColumn("delta", F.col("rank_second") - F.col("rank_first"))


def dataset_profile(profile: DataFrame, threshold: float) -> DataFrame:
    """Properties of the data as rows of name and number."""
    sparse = F.col("zero_share") >= threshold
    by = profile.agg(
        F.count("*").cast("double").alias("n_series"), F.median("n_obs").alias("median_n_obs"), F.min("n_obs").cast("double").alias("min_n_obs"), F.count_if(sparse).cast("double").alias("n_intermittent"),
        F.avg(sparse.cast("int")).alias("share_intermittent"), F.median("zero_share").alias("median_zero_share"), F.max("zero_share").alias("max_zero_share"), F.sum("total_volume").alias("total_volume"),
    )
    return by.unpivot([], by.columns, "property", "value")


def _fresh(timings: DataFrame) -> DataFrame:
    """Each fit that was made, once."""
    rows = timings.where("status = 'ok' AND NOT fit_reused")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("model", "fit_key").orderBy("fold", "repeat", "horizon"))).where("k = 1").drop("k")


def cost_table(timings: DataFrame, usd_per_hour: float | None = None) -> DataFrame:
    ok = timings.where("status = 'ok'")
    fits = _fresh(timings).groupBy("model").agg(F.sum("fit_seconds").alias("fit_seconds_total"), F.median("fit_seconds").alias("fit_seconds_median"), F.count("fit_seconds").alias("n_fits"))
    rest = ok.groupBy("model").agg(
        F.sum("predict_seconds").alias("predict_seconds_total"), F.median("predict_seconds").alias("predict_seconds_median"), F.min("family").alias("family"), F.max("peak_memory_mb").alias("peak_memory_mb"),
        F.max("n_series").alias("n_series"), F.max("n_params").alias("n_params"), F.min("tuning_trials").alias("tuning_trials"),
    )
    out = rest.join(fits, "model", "left").withColumn("total_seconds", F.col("fit_seconds_total") + F.col("predict_seconds_total"))
    if usd_per_hour is not None:
        out = out.withColumn("usd_per_1k_series", F.try_divide("total_seconds", F.nullif("n_series", F.lit(0))) * 1000 * usd_per_hour / 3600)
    return out


def cost_per_1k(timings: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One fit plus one predict by model and horizon: the horizon's own median fit, else the model's; relative to the cheapest.  ``timings`` are of 1,000 series (see ``per_thousand``)."""
    ok = timings.where("status = 'ok'")
    fresh = ok.where("NOT fit_reused")
    keys = [*by, "model"]
    shared = fresh.groupBy(*keys).agg(F.median("fit_seconds").alias("shared"))
    own = fresh.groupBy(*keys, "horizon").agg(F.median("fit_seconds").alias("own"))
    predict = ok.groupBy(*keys, "horizon").agg(F.median("predict_seconds").alias("predict_s"), F.min("tuning_trials").alias("tuning_trials"), F.max("n_params").alias("n_params"))
    rows = predict.join(shared, keys).join(own, [*keys, "horizon"], "left").withColumn("fit_s", F.coalesce("own", "shared")).withColumn("per1k_s", F.col("fit_s") + F.col("predict_s"))
    rel = F.col("per1k_s") / F.min("per1k_s").over(Window.partitionBy(*by, "horizon"))
    return rows.select(*keys, "horizon", "fit_s", "predict_s", "per1k_s", rel.alias("rel"), "tuning_trials", "n_params")


def per_thousand(timings: DataFrame) -> DataFrame:
    """Measured seconds as those of 1,000 series, for units of any size."""
    scale = F.try_divide(F.lit(1000.0), F.nullif("n_series", F.lit(0)))
    return timings.withColumns({c: F.col(c) * scale for c in ("fit_seconds", "predict_seconds")})


def fold_timings(timings: DataFrame) -> DataFrame:
    return timings.where("status = 'ok'").groupBy("model", "horizon", "fold").agg(F.median("fit_seconds").alias("fit_s"), F.median("predict_seconds").alias("predict_s"))


def run_summary(metrics: DataFrame, timings: DataFrame) -> DataFrame:
    ok = timings.where("status = 'ok'").groupBy("model").agg(F.median(F.when(~F.col("fit_reused"), F.col("fit_seconds"))).alias("fit_s"), F.median("predict_seconds").alias("predict_s"))
    of = lambda m: F.median(F.when(F.col("metric") == m, F.col("value"))).alias(m)
    scores = metrics.groupBy("model").agg(*[of(m) for m in ("MASE", "RMSSE", "sMAPE", "CRPS")], F.coalesce(F.sum(F.when(F.col("metric") == "sMAPE", F.col("n_undefined"))), F.lit(0)).alias("n_undefined_smape"))
    return scores.join(ok, "model", "left")


def failure_report(timings: DataFrame) -> DataFrame:
    """The first failed unit of each model and stage, with the beginning of its error."""
    rows = timings.where("status = 'failed'")
    first = F.row_number().over(Window.partitionBy("model", "stage").orderBy("fold", "horizon", "repeat"))
    return rows.withColumn("k", first).where("k = 1").select("model", "stage", "fold", "horizon", "repeat", F.substring("error", 1, 200).alias("error"))


def pareto(rows: DataFrame, cost: str, error: str) -> DataFrame:
    """Rows that no other beats on one axis without losing on the other.

    Sorted by cost, a row stays if its error is below that of all cheaper rows and least among rows of its cost.
    """
    by_cost = rows.groupBy(cost).agg(F.min(error).alias("_least"))
    before = F.min("_least").over(Window.orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = by_cost.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_least") < F.col("_before"))).select(F.col(cost).alias("_cost"), "_least")
    return rows.join(front, (rows[cost] == front["_cost"]) & (rows[error] == front["_least"])).drop("_cost", "_least")


def tied_with_best(medians: DataFrame, tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The model of least median, and those whose test against it has p >= alpha."""
    best = medians.agg(F.min_by("model", F.struct("median", "model")).alias("best"))
    pairs = tests.select(F.col("model_a").alias("x"), F.col("model_b").alias("y"), "p_value").union(tests.select("model_b", "model_a", "p_value"))
    near = pairs.join(F.broadcast(best), F.col("x") == F.col("best")).where(F.col("p_value") >= alpha).select(F.col("y").alias("model"))
    return best.select(F.col("best").alias("model")).union(near).distinct()


def blocks(metrics: DataFrame, metric: str, horizon: int) -> DataFrame:
    """unique_id, model, value: mean over folds and repeats, for series that every model has a value for."""
    rows = of_metric(metrics, metric).where(F.col("horizon") == horizon).groupBy("unique_id", "model").agg(F.avg("value").alias("value"))
    n = rows.agg(F.count_distinct("model").alias("n_models"))
    whole = F.count("value").over(Window.partitionBy("unique_id"))
    return rows.withColumn("have", whole).join(F.broadcast(n)).where("have = n_models").drop("have", "n_models")
