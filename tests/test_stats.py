"""Statistics, tables and run-state operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weekloom.functions import distributions as dist
from weekloom.operators import runs, scaling, stats, tables


def test_distributions():
    assert dist.student_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert dist.student_two_sided(-1.0, 1) == pytest.approx(0.5)
    assert dist.chi_square_tail(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert dist.chi_square_tail(1.0, 3) == pytest.approx(0.8012519569, abs=1e-9)
    assert dist.signed_rank_exact(0, 5) == pytest.approx(2 / 32)
    assert dist.range_quantile(0.05, 3) == pytest.approx(2.3437, abs=1e-4)
    assert dist.normal_two_sided(1.959963985) == pytest.approx(0.05)


def blocks(spark, rows):
    return spark.createDataFrame([(u, m, float(v)) for u, by in rows.items() for m, v in by.items()], "unique_id string, model string, value double")


def test_ranks_and_friedman(spark):
    b = blocks(spark, {f"s{k}@@x": {"a": 1, "b": 2, "c": 2 if k == 0 else 3} for k in range(4)})
    assert {r.model: r.mean_rank for r in stats.mean_ranks(b).collect()} == {"a": 1.0, "b": 2.125, "c": 2.875}
    r = stats.friedman(b).first()
    ss, n, k = 4.0**2 + 8.5**2 + 11.5**2, 4, 3
    want = (12 * ss / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - 6 / (n * k * (k * k - 1)))
    assert r.statistic == pytest.approx(want)
    assert stats.friedman(b.where("model <> 'c'")).first().statistic is None


def test_holm_and_cliques(spark):
    t = spark.createDataFrame([("a", "b", 0.01), ("a", "c", 0.04)], "model_a string, model_b string, p_value double")
    assert [r.p_holm for r in stats.holm(t).orderBy("model_b").collect()] == [0.02, 0.04]
    ranks = spark.createDataFrame([("a", 1.0), ("b", 1.4), ("c", 1.8), ("d", 3.0)], "model string, mean_rank double")
    assert [(r.first_rank, r.last_rank) for r in stats.cd_cliques(ranks, 0.5).collect()] == [(1, 2), (2, 3)]


def test_diebold_mariano(spark):
    b = blocks(spark, {f"p{k % 3}@@m{k}": {"a": k * 0.5, "b": 2.0} for k in range(6)})
    r = stats.dm_p_values(stats.dm_clustered(b).withColumn("df", (F.col("n_clusters") - 1).cast("double"))).first()
    d = [k * 0.5 - 2 for k in range(6)]
    mean = sum(d) / 6
    by = [sum(x - mean for k, x in enumerate(d) if k % 3 == c) for c in range(3)]
    want = mean / math.sqrt(sum(x * x for x in by) / 6 / 6)
    assert (r.statistic, r.n, r.n_clusters) == (pytest.approx(want), 6, 3) and 0 < r.p_value < 1
    same = stats.dm_p_values(stats.dm_clustered(blocks(spark, {f"p{k}@@m": {"a": 1, "b": 1} for k in range(4)})).withColumn("df", F.lit(3.0))).first()
    assert (same.statistic, same.p_value) == (0.0, 1.0)


def test_wilcoxon(spark):
    b = blocks(spark, {f"s{k}": {"a": 0, "b": d} for k, d in enumerate([1, 2, 3, 4, -5])})
    r = stats.wilcoxon_p(stats.wilcoxon(stats.paired(b, ["unique_id"]), ["model_a", "model_b"])).first()
    assert (r.statistic, r.n, r.median_diff) == (5.0, 5, -2.0) and r.p_value == pytest.approx(0.625)
    none = stats.wilcoxon_p(stats.wilcoxon(stats.paired(blocks(spark, {f"s{k}": {"a": 1, "b": 1} for k in range(3)}), ["unique_id"]), ["model_a", "model_b"])).first()
    assert (none.p_value, none.n_nonzero) == (1.0, 0)


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([("m", f"s{k}", float(k)) for k in range(30)], "model string, unique_id string, value double")
    one, two = (stats.bootstrap_mean(rows.repartition(p), ["model"], ["unique_id"], 200, "7").first() for p in (1, 5))
    assert one == two and one.low < one["mean"] < one.high
    band = stats.bootstrap_median_band(rows.where("unique_id = 's3'"), ["model"], 20, "7").first()
    assert band.low == band.high == 3.0


def test_poisson_weights_are_drawn_evenly():
    """Mean and variance are 1, rows and resamples do not hang together, and a draw depends on its seed and number alone."""
    seeds = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    w = stats.poisson_weights(seeds, 400).astype(float)
    share = [math.exp(-1) / math.factorial(k) for k in range(5)]
    assert np.allclose([(w == k).mean() for k in range(5)], share, atol=0.004)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15
    assert np.abs(np.corrcoef(w)[np.triu_indices(500, 1)]).mean() < 0.06
    assert np.array_equal(stats.poisson_weights(seeds[7:8], 30)[0], w[7, :30])


def test_bootstrap_of_means_against_plain_draws(spark):
    rng = np.random.default_rng(2)
    rows = [(g, f"s{k}", float(v)) for g in ("a", None) for k, v in enumerate(rng.normal(3, 2, 200))] + [("a", "none", None)]
    got = {r.g: r for r in stats.bootstrap_mean(spark.createDataFrame(rows, "g string, unique_id string, value double"), ["g"], ["unique_id"], 500, "1").collect()}
    values = np.array([v for g, _, v in rows if g == "a" and v is not None])
    plain = np.quantile([np.mean(rng.choice(values, 200)) for _ in range(4000)], [0.025, 0.975])
    assert got["a"].n == 200 and np.allclose([got["a"].low, got["a"].high], plain, atol=0.08)


def test_pareto_and_best(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.5), (2, 2.0, 0.6), (3, 3.0, 0.4), (4, 0.5, 0.9)], "row int, cost double, error double")
    assert {r.row for r in tables.pareto(rows, "cost", "error").collect()} == {1, 3, 4}
    medians = spark.createDataFrame([("a", 0.5), ("b", 0.6), ("c", 0.9)], "model string, median double")
    tests = spark.createDataFrame([("a", "b", 0.2), ("a", "c", 0.01), ("b", "c", 0.9)], "model_a string, model_b string, p_value double")
    assert {r.model for r in tables.tied_with_best(medians, tests).collect()} == {"a", "b"}


def timings(spark):
    rows = [("x", "f", 0, 4, r, f"x|0|{r}", False, 10.0 + r, 1.0, "ok") for r in (0, 1)] + [("x", "f", 0, 13, r, f"x|0|{r}", True, 10.0 + r, 2.0, "ok") for r in (0, 1)] + [("x", "f", 0, 4, 9, "bad", False, None, None, "failed")]
    return spark.createDataFrame(rows, "model string, family string, fold int, horizon int, repeat int, fit_key string, fit_reused boolean, fit_seconds double, predict_seconds double, status string").withColumns(
        {"peak_memory_mb": F.lit(1.0), "n_series": F.lit(10), "n_params": F.lit(3), "tuning_trials": F.lit(0), "result_key": F.lit("k"), "build": F.when(F.col("horizon") == 4, "b1").otherwise("b2"), "built_at": F.col("horizon"), "stage": F.lit("fit"), "error": F.repeat(F.lit("e"), F.lit(500))}
    )


def test_costs(spark):
    r = tables.cost_table(timings(spark), 3.6).first()
    assert (r.fit_seconds_total, r.n_fits, r.predict_seconds_total, r.total_seconds) == (21.0, 2, 6.0, 27.0)
    assert r.usd_per_1k_series == pytest.approx(2.7)
    by = {r.horizon: r for r in tables.cost_per_1k(timings(spark)).collect()}
    assert (by[13].fit_s, by[13].per1k_s, by[4].rel) == (10.5, 12.5, 1.0)
    assert len(tables.failure_report(timings(spark)).first().error) == 200


def test_resume(spark):
    t, units = timings(spark), spark.createDataFrame([("x", "k", 0), ("y", "k", 0)], "model string, result_key string, fold int")
    assert runs.pending_units(units, t).count() == 2
    assert [r.model for r in runs.pending_units(units, t.where("status = 'ok'")).collect()] == ["y"]
    assert runs.pending_units(units, t, force=True).count() == 2
    assert runs.mixed_builds(t).first().n_stale_rows == 3
    assert runs.result_key("m", {"b": 1, "a": 2}, {}) == runs.result_key("m", {"a": 2, "b": 1}, {}) != runs.result_key("n", {"a": 2, "b": 1}, {})


def test_trials(spark):
    t = spark.createDataFrame([("m", 0, "p0", 2.0, "ok"), ("m", 1, "p1", 1.0, "ok"), ("m", 2, "p2", 1.0, "ok"), ("m", 3, "p3", 0.0, "failed"), ("n", 0, "q", None, "failed")], "model string, trial int, params string, value double, status string")
    assert [(r.model, r.trial) for r in runs.best_trial(t).collect()] == [("m", 1)]
    assert [r.model for r in runs.barren(t.groupBy("model").agg(F.count("*").alias("budget")), runs.best_trial(t)).collect()] == ["n"]
    assert runs.merge_trials(t, t.where("model = 'n'")).count() == 5


def test_sinks(spark, tmp_path):
    t = timings(spark)
    runs.write_results(t, t, str(tmp_path / "r"))
    runs.write_results(t.where("horizon = 4"), t.where("horizon = 4"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r" / "timings")).count() == 3
    sample = spark.createDataFrame([("s",)], "unique_id string")
    runs.save_sample(sample, str(tmp_path / "s"), "key", 1)
    assert runs.load_sample(spark, str(tmp_path / "s"), "key").collect() == sample.collect()
    with pytest.raises(ValueError):
        runs.load_sample(spark, str(tmp_path / "s"), "other")
    runs.write_report(sample, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1


def test_crossovers(spark):
    m = spark.createDataFrame([("x", 10, 4, 0.9), ("x", 20, 4, 0.4), ("x", 40, 4, 0.6), ("y", 10, 4, 0.9), ("y", 40, 4, 0.8)], "model string, n_series long, horizon int, median double")
    levels = spark.createDataFrame([(4, 0.5)], "horizon int, reference double")
    got = {r.model: r for r in scaling.crossovers(m, levels).collect()}
    assert (got["x"].first_n_below, got["x"].at_max_n, got["y"].first_n_below) == (20, 0.6, None)
    assert [r.first_below for r in scaling.crossover_report(scaling.crossovers(m, levels)).orderBy("model").collect()] == ["20", "none"]
