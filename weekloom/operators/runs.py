"""Units of work, resuming, provenance, and tuning trials, as tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT = ["model", "result_key", "fold"]


def result_key(model: str, parameters: dict, protocol: dict) -> str:
    """A digest of what determines one model's results, and of nothing else."""
    return hashlib.sha256(json.dumps({"model": model, "parameters": parameters, "protocol": protocol}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def sample_key(protocol: dict) -> str:
    return hashlib.sha256(json.dumps(protocol, sort_keys=True, default=str).encode()).hexdigest()[:16]


def write_results(metrics: DataFrame, timings: DataFrame, root: str) -> None:
    """Replaces only the (model, fold) partitions that are written."""
    for name, rows in (("metrics", metrics), ("timings", timings)):
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "fold").parquet(f"{root}/{name}")


def save_sample(sample: DataFrame, path: str, key: str, seed: int) -> None:
    sample.withColumns({"sample_key": F.lit(key), "sample_seed": F.lit(seed)}).write.mode("overwrite").parquet(path)


def load_sample(spark, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("sample_key") == key).drop("sample_key", "sample_seed")
    if rows.isEmpty():
        raise ValueError(f"no sample of key {key} in {path}")
    return rows


def write_report(table: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def collect_results(*frames: DataFrame) -> DataFrame:
    """All units there are; columns that some lack are NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def complete_units(timings: DataFrame) -> DataFrame:
    """Units all of whose rows are ok."""
    return timings.groupBy(*UNIT).agg(F.bool_and(F.col("status") == "ok").alias("clean")).where("clean").select(*UNIT)


def pending_units(requested: DataFrame, timings: DataFrame, force: bool = False) -> DataFrame:
    return requested if force else requested.join(complete_units(timings), UNIT, "left_anti")


def progress(requested: DataFrame, timings: DataFrame) -> DataFrame:
    """Per model: units asked for, complete and failed, and how many builds made them."""
    units = timings.groupBy(*UNIT).agg(F.bool_or(F.col("status") != "ok").alias("failed"))
    by = requested.join(units, UNIT, "left").groupBy("model").agg(F.count("*").alias("n_expected"), F.count_if(F.col("failed") == F.lit(False)).alias("n_complete"), F.count_if("failed").alias("n_failed"))
    builds = timings.groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("build")), ",").alias("builds"))
    return by.join(builds, "model", "left")


def mixed_builds(timings: DataFrame) -> DataFrame:
    """Models whose rows are not all of the newest build (by the time it was recorded)."""
    newest = timings.agg(F.max_by("build", F.struct("built_at", "build")).alias("newest"))
    return timings.join(F.broadcast(newest)).groupBy("model").agg(F.count_distinct("build").alias("n_builds"), F.count_if(F.col("build") != F.col("newest")).alias("n_stale_rows")).withColumn("stale", F.col("n_stale_rows") > 0)


def best_trial(trials: DataFrame) -> DataFrame:
    """The ok trial of least value of each model; the first of equals."""
    return trials.where("status = 'ok' AND value IS NOT NULL").groupBy("model").agg(F.min_by(F.struct("trial", "params", "value"), F.struct("value", "trial")).alias("best")).select("model", "best.*")


def merge_trials(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replaces the trials of the models in ``new`` and keeps all others."""
    return old.join(new.select("model").distinct(), "model", "left_anti").unionByName(new)


def save_best(best: DataFrame, budget: int, path: str) -> None:
    best.withColumn("budget", F.lit(budget)).write.mode("overwrite").json(path)


def load_best(spark: SparkSession, path: str) -> tuple[dict[str, str], dict[str, int]]:
    """Best parameters and trials spent by model, a row per model; nothing if nothing was recorded."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {}, {}
    rows = spark.read.schema("model string, params string, budget int").json(path).collect()
    return {r["model"]: r["params"] for r in rows}, {r["model"]: r["budget"] for r in rows}


def barren(budget: DataFrame, best: DataFrame) -> DataFrame:
    """Models that had trials to spend and found no parameters."""
    return budget.where("budget > 0").join(best, "model", "left_anti").select("model", "budget")


def param_grid(spaces: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` points of each parameter by a seeded hash: ``spaces`` has model, parameter, kind (log or choice), low, high, choices."""
    points = spaces.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat_ws("|", F.lit(seed), "model", "parameter", F.col("trial").cast("string"))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)
    value = F.when(F.col("kind") == "log", F.round(F.exp(F.ln("low") + u * (F.ln("high") - F.ln("low"))), 9)).otherwise(F.try_element_at("choices", (F.floor(u * F.size("choices")) + 1).cast("int")))
    return points.select("model", "trial", "parameter", value.alias("value"))


def search_space_report(spaces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Range of each parameter and the value of the best trial (columns model, parameter, value)."""
    return spaces.select("model", "parameter", "low", "high").join(chosen, ["model", "parameter"], "left")
