"""Tables over rungs of growing sample size; ``n_series`` is a column, so that all rungs are one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.operators import stats, tables


def common_series(rows: DataFrame) -> DataFrame:
    """The series that every rung has."""
    n = rows.agg(F.count_distinct("n_series").alias("n_rungs"))
    return rows.groupBy("unique_id").agg(F.count_distinct("n_series").alias("have")).join(F.broadcast(n)).where("have = n_rungs").select("unique_id")


def scaling_table(rungs: DataFrame, timings: DataFrame | None, series: DataFrame | None, protocol: Protocol, band: int = 0) -> DataFrame:
    """A row per (model, rung): median accuracy over the fixed series and cost of the whole rung, also per 1,000 series.

    Without ``timings`` the costs are left out.  ``band`` is the number of resamples of the interval around the medians (none if 0).
    """
    kept = rungs if series is None else rungs.join(series.select("unique_id"), "unique_id", "left_semi")
    cell = lambda m, h: F.median(F.when((F.col("metric") == m) & (F.col("horizon") == h), F.col("value"))).alias(f"{m}_h{h}")
    out = kept.groupBy("model", "n_series").agg(F.count_distinct("unique_id").alias("eval_series"), *[cell(m, h) for m in ("MASE", "RMSSE") for h in protocol.horizons])
    if timings is not None:
        cost = tables.cost_per_1k(timings, ("n_series",))
        wide = cost.groupBy("model", "n_series").agg(*[F.max(F.when(F.col("horizon") == h, F.col(c))).alias(name) for h in protocol.horizons for c, name in (("fit_s", f"fit_s_h{h}"), ("per1k_s", f"run_s_h{h}"))])
        out = out.join(wide, ["model", "n_series"], "left").withColumns({f"per1k_s_h{h}": F.col(f"run_s_h{h}") * 1000 / F.col("n_series") for h in protocol.horizons})
    if band:
        for h in protocol.horizons:
            of = kept.where((F.col("metric") == "MASE") & (F.col("horizon") == h))
            ends = stats.bootstrap_median_band(of, ["model", "n_series"], band, str(protocol.seed))
            out = out.join(ends.select("model", "n_series", F.col("low").alias(f"MASE_h{h}_lo"), F.col("high").alias(f"MASE_h{h}_hi")), ["model", "n_series"], "left")
    return out


def reference_levels(metrics: DataFrame, model: str, series: DataFrame | None = None, metric: str = "MASE") -> DataFrame:
    rows = metrics.where((F.col("model") == model) & (F.col("metric") == metric))
    if series is not None:
        rows = rows.join(series.select("unique_id"), "unique_id", "left_semi")
    return rows.groupBy("horizon").agg(F.median("value").alias("reference"))


def crossovers(medians: DataFrame, levels: DataFrame) -> DataFrame:
    """The smallest rung whose median lies strictly below the reference, and the gap at the largest.  ``medians``: model, n_series, horizon, median."""
    rows = medians.join(F.broadcast(levels), "horizon")  # a row per horizon
    by = rows.groupBy("model", "horizon").agg(F.first("reference").alias("reference"), F.min(F.when(F.col("median") < F.col("reference"), F.col("n_series"))).alias("first_n_below"), F.max("n_series").alias("max_n"), F.max_by("median", "n_series").alias("at_max_n"))
    return by.withColumn("gap_at_max_pct", (F.col("at_max_n") / F.col("reference") - 1) * 100)


def crossover_report(found: DataFrame) -> DataFrame:
    """As text: "none" where there is no crossover."""
    return found.select("model", "horizon", F.coalesce(F.format_number("first_n_below", 0), F.lit("none")).alias("first_below"), F.format_number("max_n", 0).alias("largest"))


def medians_by_rung(rungs: DataFrame, metric: str = "MASE") -> DataFrame:
    return rungs.where(F.col("metric") == metric).groupBy("model", "n_series", "horizon").agg(F.median("value").alias("median"))


def noise_band(medians: DataFrame, model: str) -> DataFrame:
    """Least and greatest median across rungs; no row if the model is absent."""
    return medians.where(F.col("model") == model).groupBy("horizon").agg(F.min("median").alias("low"), F.max("median").alias("high"))


def per_series_scores(metrics: DataFrame, model: str, metric: str, horizon: int, series: DataFrame | None = None) -> DataFrame:
    rows = metrics.where((F.col("model") == model) & (F.col("metric") == metric) & (F.col("horizon") == horizon))
    if series is not None:
        rows = rows.join(series.select("unique_id"), "unique_id", "left_semi")
    return rows.groupBy("unique_id").agg(F.avg("value").alias("value"))


def paired_rungs(rungs: DataFrame, series: DataFrame, reference: DataFrame, reference_model: str, metric: str = "MASE") -> DataFrame:
    """Largest rung against smallest, and each rung against a reference model, on the same series: model, horizon, comparison, a, b."""
    of = lambda rows: rows.where(F.col("metric") == metric).join(series.select("unique_id"), "unique_id", "left_semi")
    keys = ["model", "horizon", "unique_id"]
    per = of(rungs).groupBy("n_series", *keys).agg(F.avg("value").alias("value"))
    ends = per.agg(F.min("n_series").alias("lo"), F.max("n_series").alias("hi"))
    both = per.join(F.broadcast(ends))  # one row
    top = both.where("n_series = hi").select(*keys, "lo", "hi", F.col("value").alias("a"))
    low = both.where("n_series = lo").select(*keys, F.col("value").alias("b"))
    first = top.join(low, keys).select("model", "horizon", F.concat(F.lit("N="), F.col("hi").cast("string"), F.lit(" vs N="), F.col("lo").cast("string")).alias("comparison"), "a", "b")
    ref = of(reference).where(F.col("model") == reference_model).groupBy("horizon", "unique_id").agg(F.avg("value").alias("b"))
    second = per.join(ref, ["horizon", "unique_id"]).select("model", "horizon", F.concat(F.lit("N="), F.col("n_series").cast("string"), F.lit(f" vs {reference_model}")).alias("comparison"), F.col("value").alias("a"), "b")
    return first.unionByName(second)


def ladder_warnings(timings: DataFrame) -> DataFrame:
    """Per rung: models that are missing, failed units and builds beyond the first."""
    models, sizes = timings.select("model").distinct(), timings.select("n_series").distinct()
    missing = sizes.join(F.broadcast(models)).join(timings.select("n_series", "model").distinct(), ["n_series", "model"], "left_anti").groupBy("n_series").agg(F.count("*").alias("n_missing_models"))
    by = timings.groupBy("n_series").agg(F.count_if(F.col("status") != "ok").alias("n_failed"), F.count_distinct("build").alias("n_builds"))
    every = timings.agg(F.count_distinct("build").alias("n_builds_overall"))
    return by.join(missing, "n_series", "left").join(F.broadcast(every)).fillna(0, ["n_missing_models"])
