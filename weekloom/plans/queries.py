"""The registered queries: one per operator, over the frames of ``fixtures``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import PROTOCOL as P
from weekloom.operators import backtest, baselines, features, forecasters, panel, pooled, ranks, runs, sampling, scaling, score, split, stats, tables
from weekloom.plans import fixtures as fx
from weekloom.sources.scratch import root_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


#: Sums of many amounts, and prices, which are quotients of them.
PLACES = dict.fromkeys(("total_volume", "least_volume", "most_volume"), 4) | dict.fromkeys(("ARP", "arp", "arp_yago", "planned_arp"), 10)


def places(column: str) -> int:
    return PLACES.get(column, 6)


def query(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; its doubles are rounded to ``places``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(spark, sf_dir)
        return out.withColumns({c: F.round(c, places(c)) for c, t in out.dtypes if t == "double"})

    QUERIES[make.__name__] = run
    return make




def measured(rows: DataFrame) -> DataFrame:
    """Amounts in their unit are rounded more coarsely than ratios."""
    return rows.withColumn("value", F.when(F.col("metric").isin("MAE", "RMSE", "pinball", "CRPS"), F.round("value", 2)).otherwise(F.col("value")))


# -- sources and the panel


@query
def raw_scan_scoped(spark, d):
    return panel.scoped(fx.raw(spark, d), P).select("internal_id", "Geography", "Time_Period_End_Date", "Dollars", "Units", "ARP")


@query
def csv_scan(spark, d):
    """The export written as CSV, some weeks of it without a date, with a broken line for each product; read back, bad rows set aside."""
    from weekloom.sources.raw import scan_csv_apart

    path, export = f"{root_of(spark)}/{uuid.uuid4().hex}", fx.raw(spark, d)
    undated = F.weekofyear("Time_Period_End_Date") % 13 == 5
    text = export.withColumn("Time_Period_End_Date", F.when(undated, F.lit("n/a")).otherwise(F.col("Time_Period_End_Date").cast("string")))
    text.write.csv(path, header=True, nullValue="null")
    broken = F.concat("internal_id", F.lit(",only,three fields"))
    header = ",".join(export.columns)
    lines = export.select(broken.alias("line")).distinct()  # a line a product
    lines.agg(F.concat(F.lit(header + "\n"), F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("value")).write.mode("append").text(path)
    kept, aside = scan_csv_apart(spark, path, P)
    good = kept.groupBy("internal_id").agg(F.lit("kept").alias("outcome"), F.count("*").alias("n_rows"), F.count("Dollars").alias("n_amounts"), F.count_distinct("Time_Period_End_Date").alias("n_weeks"))
    bad = aside.groupBy("internal_id", F.col("reason").alias("outcome")).agg(F.count("*").alias("n_rows"), F.lit(0).cast("long").alias("n_amounts"), F.lit(0).cast("long").alias("n_weeks"))
    return good.unionByName(bad)


@query
def coerce_numeric(spark, d):
    from weekloom.sources.raw import coerce_numeric as coerce

    text = fx.raw(spark, d).select("internal_id", F.when(F.col("Units") > 100, "n/a").otherwise(F.col("Units").cast("decimal(12,2)").cast("string")).alias("Units"))
    return coerce(text, ("Units",)).groupBy("internal_id").agg(F.count("*").alias("n"), F.count("Units").alias("n_numbers"), F.sum("Units").alias("total"))


@query
def panel_keys(spark, d):
    return panel.keyed(fx.raw(spark, d), P)


@query
def duplicate_keys(spark, d):
    return panel.duplicate_keys(fx.raw(spark, d).select(F.col("internal_id").alias("unique_id"), F.col("Time_Period_End_Date").alias("ds")))


@query
def weekly_check(spark, d):
    return panel.weekly_check(panel.keyed(fx.raw(spark, d), P))


@query
def panel_grid(spark, d):
    return fx.panel_rows(spark, d)


@query
def panel_summary(spark, d):
    return panel.panel_summary(fx.panel_rows(spark, d))


@query
def first_n_series(spark, d):
    return panel.first_series(fx.panel_rows(spark, d), 5).select("unique_id", "ds", "y")


# -- splits


@query
def origins(spark, d):
    return fx.folds(spark, d)


@query
def tuning_origin(spark, d):
    return split.tuning_origin(fx.folds(spark, d), P)


@query
def fold_train_counts(spark, d):
    return split.train_counts(fx.panel_rows(spark, d), fx.folds(spark, d), P)


@query
def fold_test_window(spark, d):
    return split.test_window(fx.panel_rows(spark, d), fx.folds(spark, d), P)


@query
def future_covariates(spark, d):
    return split.future_covariates(fx.panel_rows(spark, d), fx.folds(spark, d), P)


@query
def eligibility(spark, d):
    return fx.checked(spark, d)


@query
def protocol_feasible(spark, d):
    return split.feasible(fx.checked(spark, d))


@query
def frame_reaches_origin(spark, d):
    return split.behind_origin(split.training(fx.panel_rows(spark, d), fx.folds(spark, d)))


@query
def impute_gaps(spark, d):
    return split.impute(fx.panel_rows(spark, d).select("unique_id", "ds", "y"))


@query
def impute_report(spark, d):
    return split.impute_report(split.impute(fx.panel_rows(spark, d).select("unique_id", "ds", "y")))


# -- profiles and samples


@query
def series_profile(spark, d):
    return sampling.series_profile(fx.panel_rows(spark, d))


@query
def seasonal_denominators(spark, d):
    return fx.denominators(spark, d).withColumns({c: F.round(c, 3) for c in ("mase_den", "rmsse_den")})


@query
def eligible_profile(spark, d):
    return fx.eligible(spark, d)


@query
def eligibility_report(spark, d):
    return sampling.eligibility_report(fx.checked(spark, d), fx.denominators(spark, d))


@query
def dataset_profile(spark, d):
    rows = tables.dataset_profile(sampling.series_profile(fx.panel_rows(spark, d)), P.zero_bins[1])
    return rows.withColumn("value", F.when(F.col("property") == "total_volume", F.round("value", 1)).otherwise(F.col("value")))


@query
def strata(spark, d):
    return fx.labelled(spark, d)


@query
def quota(spark, d):
    pool = fx.labelled(spark, d)
    return sampling.quota(pool, pool.count() // 2)


@query
def stratified_sample(spark, d):
    pool = fx.labelled(spark, d)
    return sampling.stratified_sample(pool, pool.count() // 2, P.seed).select("unique_id", "stratum")


@query
def nested_ladder(spark, d):
    pool = fx.labelled(spark, d)
    n = pool.count()
    anchor = sampling.stratified_sample(pool, n // 2, P.seed)
    return sampling.nested_ladder(pool, anchor, sorted({n // 4, n // 2, 3 * n // 4}), P.seed).select("n_series", "unique_id", "stratum")


@query
def stratum_report(spark, d):
    return sampling.stratum_report(fx.labelled(spark, d))


@query
def ids_digest(spark, d):
    return sampling.ids_digest(fx.ladder(spark, d))


@query
def ids_tree_digest(spark, d):
    return sampling.ids_tree_digest(fx.ladder(spark, d))


@query
def ladder_nesting(spark, d):
    return sampling.nesting(fx.ladder(spark, d))


# -- features and quantile tools


@query
def lag_features(spark, d):
    rows = features.lag_features(fx.panel_rows(spark, d).select("unique_id", "ds", "y"), P)
    return rows.withColumns({c: F.round(c, 4) for c in rows.columns if c.startswith("lag_")})


@query
def context_tail(spark, d):
    return features.context_tail(fx.panel_rows(spark, d), 104).select("unique_id", F.size("context").alias("n"), F.array_join(F.transform("context", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("context"))


@query
def context_padded(spark, d):
    rows = features.context_padded(features.context_tail(fx.panel_rows(spark, d), 300), 300)
    return rows.select("unique_id", F.size("padded").alias("n"), F.size(F.filter("mask", lambda x: x)).alias("n_real"), F.round(F.col("padded")[0], 2).alias("first"), F.round(F.col("padded")[299], 2).alias("last"))


@query
def spread_quantiles(spark, d):
    rows = features.context_spread(features.context_tail(fx.panel_rows(spark, d), 104))
    last = F.element_at("context", -1)
    return rows.select("unique_id", F.round("spread", 3).alias("spread"), F.posexplode(baselines.widened(last, F.col("spread"), P)).alias("level", "quantile")).withColumn("quantile", F.round("quantile", 2))


@query
def quantile_repair(spark, d):
    rows = features.context_spread(features.context_tail(fx.panel_rows(spark, d), 104))
    at, s = F.element_at("context", -1), F.col("spread")
    bounds = {c: (at - s * k, at + s * k * 0.5) for c, k in ((80, 1.0), (60, 1.2), (40, 0.4), (20, 0.1))}
    return rows.select("unique_id", F.posexplode(baselines.interval_quantiles(bounds, at)).alias("level", "quantile")).withColumn("quantile", F.round("quantile", 2))


# -- forecasts and scores


def _forecast(rows: DataFrame) -> DataFrame:
    return rows.select("model", "fold", "unique_id", "step", "yhat", F.round(F.col("q")[0], 2).alias("q10"), F.round(F.col("q")[8], 2).alias("q90"))


@query
def forecast_naive(spark, d):
    return _forecast(baselines.naive(fx.filled(spark, d), P))


@query
def forecast_seasonal_naive(spark, d):
    return _forecast(baselines.seasonal_naive(fx.filled(spark, d), P))


@query
def forecast_window_mean(spark, d):
    return _forecast(baselines.window_mean(fx.filled(spark, d), P))


@query
def forecast_contract(spark, d):
    broken = fx.forecasts(spark, d).where("NOT (model = 'naive' AND step = 13 AND fold = 2)")
    return score.contract(fx.actual(spark, d), broken)


@query
def score_point(spark, d):
    return measured(score.score_point(fx.actual(spark, d), fx.forecasts(spark, d), fx.denominators(spark, d), P))


@query
def score_quantile(spark, d):
    return measured(score.score_quantile(fx.actual(spark, d), fx.forecasts(spark, d), P))


@query
def backtest_leaderboard(spark, d):
    rows = fx.metrics(spark, d).where("metric = 'MASE'")
    return rows.groupBy("model", "horizon").agg(F.median("value").alias("median_mase"), F.count("value").alias("n_scores"), F.count_distinct("unique_id").alias("n_series"))


@query
def quantiles_by_ranges(spark, d):
    """Quartiles of the scale-free metrics of every model, of groups of any size."""
    rows = fx.metrics(spark, d).where(F.col("metric").isin("MASE", "RMSSE", "sMAPE", "MAPE", "coverage_80"))
    return ranks.quantiles(rows, ["model", "horizon", "metric"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def _model(name: str, fit) -> None:
    def run(spark, d):
        return forecasters.per_series(fx.series(spark, d), name, fit, P).drop("q")

    run.__name__ = f"forecast_{name}"
    query(run)


for _name, _fit in forecasters.LOCAL.items():
    _model(_name, _fit)


@query
def forecast_ridge_global(spark, d):
    return forecasters.ridge_global(fx.series(spark, d), P).drop("q")


@query
def forecast_ridge_covariates(spark, d):
    return forecasters.ridge_global(fx.filled_known(spark, d), P, future=fx.future(spark, d)).drop("q")


@query
def forecast_linear_global(spark, d):
    return forecasters.linear_global(fx.series(spark, d), P).drop("q")


@query
def forecast_gbt_global(spark, d):
    return forecasters.gbt_global(fx.series(spark, d), P).drop("q")


def context_quantiles(contexts: np.ndarray, masks: np.ndarray, steps: int) -> np.ndarray:
    """A batch function for ``plugin``: the quantiles of each context, for every step."""
    values = np.where(masks, contexts, np.nan)
    return np.repeat(np.nanquantile(values, P.levels, axis=1).T[:, None, :], steps, axis=1)


@query
def forecast_plugin(spark, d):
    return forecasters.plugin(fx.filled(spark, d), P, "context_quantiles", context_quantiles).drop("q")


@query
def score_absent(spark, d):
    """A forecast that is not there counts as undefined."""
    made = fx.forecasts(spark, d).where("NOT (model = 'naive' AND step = 13 AND fold = 2)")
    rows = score.score_point(fx.actual(spark, d), made, fx.denominators(spark, d), P).where("metric = 'MAE'")
    return rows.groupBy("model", "fold", "horizon").agg((F.sum("n_points") + F.sum("n_undefined")).alias("n_weeks"), F.sum("n_points").alias("n_scored"), F.sum("n_undefined").alias("n_undefined"))


# -- the whole backtest


def _stored(spark, d):
    return backtest.collect(spark, fx.store(spark, d))


@query
def backtest_models(spark, d):
    """Every model on every fold, from the results store."""
    rows = tables.label_ablation_arms(_stored(spark, d)[0])
    wanted = rows.where(F.col("metric").isin("MASE", "CRPS", "coverage_80"))
    return wanted.groupBy("model", "metric", "horizon").agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.count("value").alias("n_scores"), F.count_distinct("unique_id").alias("n_series"))


@query
def backtest_cost(spark, d):
    """Measured seconds of the fits and predictions of all models."""
    return tables.cost_per_1k(tables.per_thousand(tables.label_ablation_arms(_stored(spark, d)[1])))


def _arms(spark, d):
    """Scores of every model arm, whose name tells those with covariates apart."""
    return tables.label_ablation_arms(_stored(spark, d)[0]).groupBy("model", "fold", "horizon", "unique_id", "metric").agg(F.avg("value").alias("value"), F.max("n_undefined").alias("n_undefined"))


def _both_horizons(make):
    """The result of ``make(horizon)`` for each horizon of the protocol, with its column."""
    parts = [make(h).withColumn("horizon", F.lit(h)) for h in P.horizons]
    return reduce(DataFrame.unionByName, parts)


@query
def arms_accuracy(spark, d):
    return tables.accuracy_table(_arms(spark, d), "MASE")


@query
def arms_dm(spark, d):
    """Diebold-Mariano of every pair of model arms, at both horizons."""
    return _both_horizons(lambda h: stats.dm_p_values(stats.dm_clustered(tables.blocks(_arms(spark, d), "MASE", h)).withColumn("df", (F.col("n_clusters") - 1).cast("double"))))


@query
def arms_ranks(spark, d):
    """Mean ranks of all model arms at both horizons, and what the critical difference says of each pair."""
    return _both_horizons(lambda h: stats.nemenyi(tables.blocks(_arms(spark, d), "MASE", h)))


@query
def arms_friedman(spark, d):
    return _both_horizons(lambda h: stats.friedman(tables.blocks(_arms(spark, d), "MASE", h)))


@query
def arms_wilcoxon(spark, d):
    """Signed ranks of every pair of model arms at both horizons, with p-values after Holm within a horizon."""

    def tests(h):
        pairs = stats.paired(tables.blocks(_arms(spark, d), "MASE", h), ["unique_id"])
        return stats.holm(stats.wilcoxon_p(stats.wilcoxon(pairs, ["model_a", "model_b"]))).drop("ties")

    return _both_horizons(tests)


@query
def arms_tied_with_best(spark, d):
    def tied(h):
        tests = stats.dm_p_values(stats.dm_clustered(tables.blocks(_arms(spark, d), "MASE", h)).withColumn("df", (F.col("n_clusters") - 1).cast("double")))
        return tables.tied_with_best(tables.accuracy_table(_arms(spark, d), "MASE").where(F.col("horizon") == h), tests)

    return _both_horizons(tied)


@query
def arms_pareto(spark, d):
    """Model arms that no other beats in both measured cost and median error, at both horizons."""
    cost = tables.cost_per_1k(tables.per_thousand(tables.label_ablation_arms(_stored(spark, d)[1])))
    both = tables.accuracy_table(_arms(spark, d), "MASE").join(cost.select("model", "horizon", F.col("per1k_s").alias("cost")), ["model", "horizon"])
    return _both_horizons(lambda h: tables.pareto(both.where(F.col("horizon") == h).select("model", "cost", F.col("median").alias("error")), "cost", "error"))


@query
def backtest_resume(spark, d):
    """A second run over the store finds every unit complete and runs none."""
    root, models = fx.store(spark, d), fx.models(spark, d)
    again = backtest.run(fx.filled_known(spark, d), fx.actual(spark, d), fx.denominators(spark, d), models, P, root)
    timings = tables.label_ablation_arms(_stored(spark, d)[1])
    return runs.progress(timings.select("model", "result_key", "fold").distinct(), timings).join(F.broadcast(again.agg(F.count("*").alias("n_run_again"))))  # one row


@query
def covariate_ablation(spark, d):
    """The same model with and without what is known of the weeks ahead."""
    rows = tables.label_ablation_arms(_stored(spark, d)[0]).where(F.col("model").isin("ridge_global", "ridge_global+cov"))
    return tables.accuracy_table(rows, "MASE")


@query
def ladder_directories(spark, d):
    """One run per rung, each in a directory of its own, read back together."""
    roots, plain = [], [m for m in fx.models(spark, d) if m.name == P.baseline]
    for n in sorted(r["n_series"] for r in fx.ladder(spark, d).select("n_series").distinct().collect()):  # rungs
        ids = fx.ladder(spark, d).where(F.col("n_series") == n).select("unique_id")
        roots.append(f"{fx.store(spark, d)}/rung={n}")
        own = lambda rows: rows.join(ids, "unique_id", "left_semi")  # noqa: B023, E731
        backtest.run(own(fx.filled(spark, d)), own(fx.actual(spark, d)), fx.denominators(spark, d), plain, P, roots[-1])
    metrics, _ = backtest.load_ladder(spark, roots)
    return scaling.medians_by_rung(metrics)


# -- accuracy, cost and ranking tables


@query
def ablation_labels(spark, d):
    return tables.label_ablation_arms(fx.metrics(spark, d)).groupBy("model", "metric").agg(F.count("value").alias("n"), F.min("value").alias("least")).withColumn("least", F.round("least", 2))


@query
def accuracy_table(spark, d):
    return tables.accuracy_table(fx.metrics(spark, d), "MASE")


@query
def main_accuracy(spark, d):
    return tables.main_accuracy(fx.metrics(spark, d), P)


@query
def pooled_coverage(spark, d):
    return tables.pooled_coverage(fx.metrics(spark, d))


@query
def skill_scores(spark, d):
    return tables.skill_scores(fx.metrics(spark, d), P.baseline)


@query
def error_distribution(spark, d):
    return tables.error_distribution(fx.metrics(spark, d))


@query
def ranking_flip(spark, d):
    return tables.ranking_flip(fx.metrics(spark, d), fx.labelled(spark, d).where("zero_bin = 2"), 4)


@query
def cost_table(spark, d):
    return tables.cost_table(fx.timings(spark, d), 0.9)


@query
def cost_per_1k(spark, d):
    return tables.cost_per_1k(fx.timings(spark, d))


@query
def fold_timings(spark, d):
    return tables.fold_timings(fx.timings(spark, d))


@query
def run_summary(spark, d):
    return tables.run_summary(fx.metrics(spark, d), fx.timings(spark, d)).withColumn("CRPS", F.round("CRPS", 2))


@query
def failure_report(spark, d):
    return tables.failure_report(fx.timings(spark, d))


@query
def pareto_frontier(spark, d):
    cost = tables.cost_per_1k(fx.timings(spark, d)).where("horizon = 4").select("model", "per1k_s")
    error = tables.accuracy_table(fx.metrics(spark, d), "MASE").where("horizon = 4").select("model", "median")
    rows = cost.join(error, "model").where("per1k_s IS NOT NULL AND median IS NOT NULL").withColumns({"per1k_s": F.round("per1k_s", 6), "median": F.round("median", 6)})
    return tables.pareto(rows, "per1k_s", "median")


@query
def blocks(spark, d):
    return fx.blocks(spark, d)


# -- statistics


@query
def dm_pairwise(spark, d):
    return stats.dm_clustered(fx.blocks(spark, d))


@query
def dm_p_values(spark, d):
    return stats.dm_p_values(stats.dm_clustered(fx.blocks(spark, d)).withColumn("df", (F.col("n_clusters") - 1).cast("double")))


@query
def dm_time_indexed(spark, d):
    errors = fx.actual(spark, d).join(fx.forecasts(spark, d), ["fold", "unique_id", "step"]).where("step = 4").groupBy("model", "ds").agg(F.avg(F.col("y") - F.col("yhat")).alias("value"))
    return stats.dm_time_indexed(errors, 4, 1).withColumn("mean_diff", F.round("mean_diff", 2)).withColumn("statistic", F.round("statistic", 4))


@query
def mean_ranks(spark, d):
    return stats.mean_ranks(fx.blocks(spark, d))


@query
def friedman(spark, d):
    return stats.friedman(fx.blocks(spark, d)).select(F.col("n_blocks").cast("long"), F.col("n_models").cast("long"), "statistic")


@query
def nemenyi(spark, d):
    return stats.nemenyi(fx.blocks(spark, d))


@query
def cd_cliques(spark, d):
    cd = stats.nemenyi(fx.blocks(spark, d)).agg(F.max("cd")).first()[0]  # the same for all pairs
    return stats.cd_cliques(stats.mean_ranks(fx.blocks(spark, d)), cd).select(F.col("first_rank").cast("long"), F.col("last_rank").cast("long"))


@query
def wilcoxon_holm(spark, d):
    return stats.wilcoxon(stats.paired(fx.blocks(spark, d), ["unique_id"]), ["model_a", "model_b"]).drop("ties")


@query
def posthoc_comparison(spark, d):
    tests = stats.holm(stats.wilcoxon_p(stats.wilcoxon(stats.paired(fx.blocks(spark, d), ["unique_id"]), ["model_a", "model_b"])))
    both = stats.nemenyi(fx.blocks(spark, d)).join(tests.select("model_a", "model_b", "p_holm"), ["model_a", "model_b"])
    return both.withColumn("significant_holm", F.col("p_holm") < 0.05).withColumn("agree", F.col("significant") == F.col("significant_holm"))


@query
def holm_adjust(spark, d):
    tests = stats.wilcoxon_p(stats.wilcoxon(stats.paired(fx.blocks(spark, d), ["unique_id"]), ["model_a", "model_b"]))
    return stats.holm(tests.select("model_a", "model_b", "p_value"))


@query
def tied_with_best(spark, d):
    tests = stats.dm_p_values(stats.dm_clustered(fx.blocks(spark, d)).withColumn("df", (F.col("n_clusters") - 1).cast("double")))
    return tables.tied_with_best(tables.accuracy_table(fx.metrics(spark, d), "MASE").where("horizon = 4"), tests)


@query
def bootstrap_skill(spark, d):
    skill = tables.skill_scores(fx.metrics(spark, d), P.baseline).select("model", "horizon", "unique_id", "fold", F.col("skill").alias("value"))
    return stats.bootstrap_mean(skill, ["model", "horizon"], ["unique_id", "fold"], 2000, str(P.seed))


# -- the ladder


@query
def ladder_scan(spark, d):
    return fx.rungs(spark, d).groupBy("n_series").agg(F.count("*").alias("n_rows"), F.count_distinct("unique_id").alias("n_ids"), F.count_distinct("model").alias("n_models"))


@query
def common_series(spark, d):
    return scaling.common_series(fx.ladder(spark, d))


@query
def scaling_table(spark, d):
    return scaling.scaling_table(fx.rungs(spark, d), fx.rung_timings(spark, d), scaling.common_series(fx.ladder(spark, d)), P)


@query
def scaling_band(spark, d):
    rows = fx.rungs(spark, d).where("metric = 'MASE'")
    return stats.bootstrap_median_band(rows.select("model", "n_series", "horizon", "unique_id", "value"), ["model", "n_series", "horizon"], 300, str(P.seed))


@query
def ladder_fitted(spark, d):
    """The pooled models refitted on each nested rung, over the series that all rungs have, with bands of 300 resamples."""
    return scaling.scaling_table(fx.fitted_rungs(spark, d), None, None, P, band=300)


@query
def ladder_fitted_crossovers(spark, d):
    series = fx.fitted_rungs(spark, d).select("unique_id").distinct()
    return scaling.crossovers(scaling.medians_by_rung(fx.fitted_rungs(spark, d)), scaling.reference_levels(fx.metrics(spark, d), P.baseline, series))


@query
def ladder_fitted_tests(spark, d):
    """The largest rung against the smallest, and each against the baseline, by signed ranks."""
    rows = fx.fitted_rungs(spark, d)
    pairs = scaling.paired_rungs(rows, rows.select("unique_id").distinct(), fx.metrics(spark, d), P.baseline)
    return stats.wilcoxon_p(stats.wilcoxon(pairs, ["model", "horizon", "comparison"])).drop("ties")


@query
def reference_levels(spark, d):
    return scaling.reference_levels(fx.metrics(spark, d), P.baseline, fx.labelled(spark, d))


@query
def crossovers(spark, d):
    return scaling.crossovers(scaling.medians_by_rung(fx.rungs(spark, d)), scaling.reference_levels(fx.metrics(spark, d), P.baseline, fx.labelled(spark, d)))


@query
def crossover_report(spark, d):
    found = scaling.crossovers(scaling.medians_by_rung(fx.rungs(spark, d)), scaling.reference_levels(fx.metrics(spark, d), P.baseline, fx.labelled(spark, d)))
    return scaling.crossover_report(found)


@query
def noise_band(spark, d):
    return scaling.noise_band(scaling.medians_by_rung(fx.rungs(spark, d)), "naive")


@query
def per_series_scores(spark, d):
    return scaling.per_series_scores(fx.metrics(spark, d), "naive", "MASE", 4, scaling.common_series(fx.ladder(spark, d)))


@query
def paired_tests(spark, d):
    pairs = scaling.paired_rungs(fx.rungs(spark, d), scaling.common_series(fx.ladder(spark, d)), fx.metrics(spark, d), P.baseline)
    return stats.wilcoxon_p(stats.wilcoxon(pairs, ["model", "horizon", "comparison"])).drop("ties")


@query
def paired_statistics(spark, d):
    """The signed-rank statistics of ``paired_tests``."""
    pairs = scaling.paired_rungs(fx.rungs(spark, d), scaling.common_series(fx.ladder(spark, d)), fx.metrics(spark, d), P.baseline)
    return stats.wilcoxon(pairs, ["model", "horizon", "comparison"]).drop("ties")


@query
def ladder_warnings(spark, d):
    return scaling.ladder_warnings(fx.rung_timings(spark, d).where("NOT (model = 'mean_13' AND unit_series < n_series / 2)"))


# -- runs, trials and resuming


def _requested(spark, d):
    return fx.timings(spark, d).select("model", "result_key", "fold").distinct()


@query
def pending_units(spark, d):
    return runs.pending_units(_requested(spark, d), fx.timings(spark, d))


@query
def progress(spark, d):
    return runs.progress(_requested(spark, d), fx.timings(spark, d).where("NOT (model = 'naive' AND fold = 4)"))


@query
def mixed_builds(spark, d):
    return runs.mixed_builds(fx.timings(spark, d))


@query
def collect_results(spark, d):
    t = fx.timings(spark, d)
    return runs.collect_results(t.where("model = 'naive'").drop("error", "stage"), t.where("model <> 'naive'")).groupBy("model", "status").agg(F.count("*").alias("n"), F.count("error").alias("n_errors"))


@query
def trials(spark, d):
    return fx.trials(spark, d)


@query
def best_trial(spark, d):
    return runs.best_trial(fx.trials(spark, d))


@query
def trials_merge(spark, d):
    t = fx.trials(spark, d)
    return runs.merge_trials(t, t.where("model = 'recent_mean'").withColumn("trial", F.col("trial") + 10))


@query
def tuning_barren(spark, d):
    t = fx.trials(spark, d)
    return runs.barren(t.groupBy("model").agg(F.count("*").alias("budget")), runs.best_trial(t.where("model = 'recent_mean'")))


def _spaces(spark, d):
    weeks = F.split_part("params", F.lit("="), F.lit(2)).cast("double")
    by = fx.trials(spark, d).groupBy("model").agg(F.min(weeks).alias("low"), F.max(weeks).alias("high"), F.array_sort(F.collect_set(weeks)).alias("choices"))
    kind = F.when(F.col("model") == "recent_mean", "log").otherwise("choice")
    return by.select("model", F.lit("weeks").alias("parameter"), kind.alias("kind"), "low", "high", "choices")


@query
def param_grid(spark, d):
    return runs.param_grid(_spaces(spark, d), 20, str(P.seed))


@query
def search_space_report(spark, d):
    best = runs.best_trial(fx.trials(spark, d)).select("model", F.lit("weeks").alias("parameter"), F.split_part("params", F.lit("="), F.lit(2)).cast("double").alias("value"))
    return runs.search_space_report(_spaces(spark, d), best)


#: Parameter, kind, least and greatest value of each tuned model's search space.
SPACES = {"ets_grid": [("alphas", "log", 0.02, 0.8)], "fourier_trend": [("ridge", "log", 0.05, 50.0)], "ridge_local": [("ridge", "log", 0.05, 50.0)]}
TRIALS = 6


def tuning_points(spark, spaces: dict[str, list] | None = None) -> list[tuple[str, int, dict]]:
    rows = [(m, name, kind, low, high, [low, high]) for m, space in (spaces or SPACES).items() for name, kind, low, high in space]
    grid = runs.param_grid(spark.createDataFrame(rows, "model string, parameter string, kind string, low double, high double, choices array<double>"), TRIALS, str(P.seed))
    found: dict[tuple[str, int], dict] = {}
    for r in grid.collect():  # models x trials x parameters
        found.setdefault((r["model"], r["trial"]), {})[r["parameter"]] = (r["value"],) if r["parameter"] == "alphas" else r["value"]
    return [(m, t, p) for (m, t), p in sorted(found.items())]


@query
def tune_models(spark, d):
    """The same number of trials for each model, on weeks before the first fold."""
    start = split.tuning_origin(fx.folds(spark, d), P).select(F.lit(0).alias("fold"), F.col("tuning_origin").alias("origin"))
    rows = fx.eligible_panel(spark, d)
    train = split.impute(split.training(rows, start).select("fold", "origin", "unique_id", "ds", "y"), ("fold", "unique_id"))
    ahead = split.test_window(rows, start, P)
    local = forecasters.tune(train, ahead, fx.denominators(spark, d), tuning_points(spark), forecasters.LOCAL, P)
    models = [pooled.lagged(P), pooled.direct(P)]
    penalties = {m.name: [p["ridge"] for name, _, p in tuning_points(spark, {m.name: [("ridge", "log", 0.01, 1000.0)]}) if name == m.name] for m in models}
    return local.unionByName(pooled.tune(train, ahead, fx.denominators(spark, d), models, penalties, P))
