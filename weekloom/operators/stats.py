"""Paired significance tests over blocks (unique_id, model, value), all pairs of models at once.

Statistics are grouped aggregations; p-values are computed for tens of rows by a pandas function.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weekloom.functions import distributions as dist
from weekloom.operators import ranks
from weekloom.sources.scratch import written


def paired(rows: DataFrame, keys: list[str], model_a: str = "model_a", model_b: str = "model_b") -> DataFrame:
    """Every pair of models (in name order) on the same keys: model_a, model_b, a, b."""
    left = rows.select(*keys, F.col("model").alias(model_a), F.col("value").alias("a"))
    right = rows.select(*keys, F.col("model").alias(model_b), F.col("value").alias("b"))
    return left.join(right, keys).where(F.col(model_a) < F.col(model_b))


def _p(function, *columns: str) -> Column:
    @F.pandas_udf("double")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([function(*[None if pd.isna(v) else float(v) for v in row]) for row in zip(*values, strict=True)], dtype="float64")

    return run(*columns)


def _degenerate(mean: Column, variance: Column, n: Column, statistic: Column) -> Column:
    return F.when(n < 3, None).when(variance > 0, statistic).when(mean == 0, 0.0)


def dm_clustered(blocks: DataFrame, power: int = 1) -> DataFrame:
    """Diebold-Mariano with clusters of series (the id before ``@@``): statistic, n, clusters."""
    d = F.pow(F.abs("a"), F.lit(float(power))) - F.pow(F.abs("b"), F.lit(float(power)))
    pairs = paired(blocks, ["unique_id"]).select("model_a", "model_b", F.split_part("unique_id", F.lit("@@"), F.lit(1)).alias("cluster"), d.alias("d")).where("d IS NOT NULL")
    by = pairs.groupBy("model_a", "model_b", "cluster").agg(F.sum("d").alias("s"), F.count("*").alias("k"))
    pair = ["model_a", "model_b"]
    mean = F.sum("s").over(Window.partitionBy(*pair)) / F.sum("k").over(Window.partitionBy(*pair))  # one row per cluster
    centred = by.withColumn("c", F.col("s") - F.col("k") * mean)
    out = centred.groupBy(*pair).agg((F.sum("s") / F.sum("k")).alias("mean_diff"), F.sum("k").alias("n"), F.count("*").alias("n_clusters"), (F.sum(F.col("c") * F.col("c")) / F.sum("k")).alias("variance"))
    statistic = _degenerate(F.col("mean_diff"), F.col("variance"), F.col("n"), F.col("mean_diff") / F.sqrt(F.col("variance") / F.col("n")))
    return out.withColumn("statistic", statistic).drop("variance")


def dm_p_values(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", F.when((F.col("statistic") == 0) & (F.col("mean_diff") == 0), 1.0).otherwise(_p(dist.student_two_sided, "statistic", "df")))


def dm_time_indexed(errors: DataFrame, horizon: int, power: int = 2) -> DataFrame:
    """Diebold-Mariano over time: ``errors`` has model, ds and value.  Autocovariances up to horizon - 1 and the small-sample factor."""
    d = F.pow(F.abs("a"), F.lit(float(power))) - F.pow(F.abs("b"), F.lit(float(power)))
    pair = ["model_a", "model_b"]
    rows = paired(errors, ["ds"]).select(*pair, "ds", d.alias("d")).where("d IS NOT NULL")
    rows = rows.withColumn("c", F.col("d") - F.avg("d").over(Window.partitionBy(*pair)))
    w = Window.partitionBy(*pair).orderBy("ds")
    rows = rows.withColumns({f"l{k}": F.lag("c", k).over(w) for k in range(1, horizon)})
    covariances = [F.coalesce(F.sum(F.col("c") * F.col(f"l{k}")), F.lit(0.0)) for k in range(1, horizon)]
    total = F.sum(F.col("c") * F.col("c"))
    for x in covariances:
        total = total + 2 * x
    by = rows.groupBy(*pair).agg(F.avg("d").alias("mean_diff"), F.count("*").alias("n"), (total / F.count("*")).alias("variance"))
    n = F.col("n")
    factor = F.greatest((n + 1 - 2 * horizon + F.lit(float(horizon)) * (horizon - 1) / n) / n, F.lit(1e-12))
    raw = F.col("mean_diff") / F.sqrt(F.col("variance") / n)
    return by.withColumn("statistic", _degenerate(F.col("mean_diff"), F.col("variance"), n, raw * F.sqrt(factor))).drop("variance")


def ranked(blocks: DataFrame) -> DataFrame:
    """Rank of each model within its series; ties share the mean rank."""
    w = Window.partitionBy("unique_id")
    value = F.round("value", 12)
    same = F.count("*").over(Window.partitionBy("unique_id", value))
    return blocks.withColumn("rank", F.rank().over(w.orderBy(value)) + (same - 1) / 2).withColumn("tied", same)


def mean_ranks(blocks: DataFrame) -> DataFrame:
    return ranked(blocks).groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def friedman(blocks: DataFrame) -> DataFrame:
    """Chi-square over the rank sums, corrected for ties; NULL with fewer than 2 blocks or 3 models."""
    r = ranked(blocks)
    ties = r.agg(F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"))  # each tie group of size t counts t times t^2 - 1
    sums = r.groupBy("model").agg(F.sum("rank").alias("s"), F.count("*").alias("n"))
    by = sums.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.count("*").alias("k")).join(F.broadcast(ties))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    chi = (12 * F.col("ss") / (n * k * (k + 1)) - 3 * n * (k + 1)) / F.nullif(1 - F.col("ties") / (n * k * (k * k - 1)), F.lit(0.0))
    return by.select(F.col("n").alias("n_blocks"), F.col("k").alias("n_models"), F.when((n >= 2) & (k >= 3), chi).alias("statistic"))


def nemenyi(blocks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairs of models with the difference of mean ranks and the critical difference."""
    ranks = mean_ranks(blocks)
    k = ranks.count()  # models
    q = dist.range_quantile(alpha, k) if k > 1 else 0.0
    a, b = ranks.toDF("model_a", "rank_a", "n"), ranks.toDF("model_b", "rank_b", "n_b")
    cd = F.lit(q) * F.sqrt(F.lit(k * (k + 1.0)) / (6 * F.col("n")))
    pairs = a.join(F.broadcast(b), F.col("model_a") < F.col("model_b"))  # a row per model
    return pairs.select("model_a", "model_b", F.abs(F.col("rank_a") - F.col("rank_b")).alias("rank_diff"), cd.alias("cd")).withColumn("significant", F.col("rank_diff") > F.col("cd"))


def cd_cliques(ranks: DataFrame, cd: float) -> DataFrame:
    """Longest runs of models in rank order whose mean ranks lie within ``cd``; runs inside an earlier one are left out."""
    order = Window.orderBy("mean_rank", "model")  # a row per model
    r = ranks.select("model", "mean_rank", F.row_number().over(order).alias("pos"))
    other = r.select(F.col("pos").alias("p2"), F.col("mean_rank").alias("r2"))
    ends = r.join(F.broadcast(other), (F.col("p2") >= F.col("pos")) & (F.col("r2") - F.col("mean_rank") <= cd)).groupBy("pos").agg(F.max("p2").alias("last"))
    reached = F.max("last").over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return ends.withColumn("reached", reached).where("last > pos AND (reached IS NULL OR last > reached)").select(F.col("pos").alias("first_rank"), F.col("last").alias("last_rank"))


def wilcoxon(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Signed ranks of a - b within ``by``: zeros dropped, ties share mean ranks.  Statistic is the lesser rank sum.  Ranks and medians go by ranges, so no task holds a whole pair."""
    d = F.round(F.col("a") - F.col("b"), 12)
    rows = written(pairs.select(*by, d.alias("d")).where("d IS NOT NULL"))
    some = ranks.counted(rows.where("d <> 0").withColumn("m", F.abs("d")), by, "m", over=F.count_if(F.col("d") > 0))
    n, rank = F.col("n"), ranks.mean_rank()
    sums = some.groupBy(*by).agg(F.sum(F.col("over") * rank).alias("plus"), F.sum((n - F.col("over")) * rank).alias("minus"), F.sum("n").alias("n_nonzero"), F.sum(n * (n * n - 1)).cast("double").alias("ties"))
    middle = ranks.quantiles(rows, by, "d", {"median_diff": 0.5})
    share = rows.groupBy(*by).agg(F.avg((F.col("d") < 0).cast("int")).alias("share_first_better"))
    out = middle.join(share, by).join(sums, by, "left").fillna(0, ["n_nonzero"]).fillna(0.0, ["plus", "minus", "ties"])
    n = F.col("n_nonzero").cast("double")
    sd = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("ties") / 2) / 24)
    statistic = F.least("plus", "minus")
    z = F.try_divide(statistic - n * (n + 1) / 4, F.nullif(sd, F.lit(0.0)))
    return out.select(*by, "n", "n_nonzero", "median_diff", "share_first_better", statistic.alias("statistic"), z.alias("z"), "ties")


def wilcoxon_p(tests: DataFrame) -> DataFrame:
    """Exact for at most 50 differences without ties and zeros, else the normal approximation; 1 with nothing to compare."""

    def p(statistic, z, n, n_nonzero, ties):
        if n < 2 or n_nonzero == 0:
            return 1.0
        if n <= 50 and ties == 0 and n == n_nonzero:
            return dist.signed_rank_exact(statistic, int(n))
        return 1.0 if z is None else dist.normal_two_sided(z)

    return tests.withColumn("p_value", _p(p, "statistic", "z", "n", "n_nonzero", "ties"))


def holm(tests: DataFrame, p: str = "p_value", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_holm: sorted p-values times the number of those not smaller, made monotone, at most 1."""
    w = Window.partitionBy(*by)
    order = w.orderBy(p, "model_a", "model_b")
    rows = tests.withColumn("_k", F.row_number().over(order)).withColumn("_m", F.count(p).over(w))
    rows = rows.withColumn("_x", (F.col("_m") - F.col("_k") + 1) * F.col(p))
    return rows.withColumn("p_holm", F.least(F.max("_x").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))).drop("_k", "_m", "_x")


def hash_index(seed: str, columns: list[Column], n: Column) -> Column:
    """A number from 0 to n - 1 that depends on the columns alone."""
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % n


#: Distribution function of the Poisson distribution of mean 1 at 0, 1, 2, ..., as 48-bit numbers.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**48) for k in range(12))
#: The step and the multipliers of the counter-based generator (splitmix64).
STEP, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def poisson_weights(seeds: np.ndarray, resamples: int) -> np.ndarray:
    """Draws from the Poisson distribution of mean 1 (seeds x resamples): the b-th is a function of the seed and b alone."""
    steps = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(STEP)
    x = seeds[:, None] ^ steps
    x ^= x >> np.uint64(30)
    x *= np.uint64(FIRST)
    x ^= x >> np.uint64(27)
    x *= np.uint64(SECOND)
    x ^= x >> np.uint64(31)
    x >>= np.uint64(16)
    weight = (x >= np.uint64(POISSON[0])).astype(np.uint8)
    for p in POISSON[1:]:
        weight += x >= np.uint64(p)
    return weight


def bootstrap_mean(values: DataFrame, group: list[str], keys: list[str], resamples: int, seed: str, alpha: float = 0.05, block: int = 128) -> DataFrame:
    """Percentile interval of the mean of ``value`` by group.  In each resample a row (told by ``keys``) counts a Poisson number of times.

    Rows need no numbers and no join.  A task draws for a block of rows and all resamples at once and adds up, so what is shuffled are two
    sums for each resample, group and task, and the result is the same at any partitioning.
    """
    rows = values.where(F.col("value").isNotNull())
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    seeded = rows.select(*group, F.col("value").cast("double").alias("value"), half(1).alias("high_half"), half(9).alias("low_half"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for part in batches:
            for key, own in part.groupby(group, dropna=False):
                seeds = own["high_half"].to_numpy().astype(np.uint64) << np.uint64(32) | own["low_half"].to_numpy().astype(np.uint64)
                key = tuple(None if pd.isna(k) else k for k in key)
                value, sums = own["value"].to_numpy(), total.setdefault(key, np.zeros((2, resamples)))
                for lo in range(0, len(own), block):
                    weight = poisson_weights(seeds[lo : lo + block], resamples).astype(np.float64)
                    sums[0] += weight.sum(axis=0)
                    sums[1] += value[lo : lo + block] @ weight
        for key, sums in total.items():
            yield pd.DataFrame([[*key, sums[0], sums[1]]], columns=[*group, "w", "wv"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeded.select(*group).schema)
    sums = seeded.mapInPandas(run, f"{schema}, w array<double>, wv array<double>")
    each = sums.select(*group, F.posexplode(F.arrays_zip("w", "wv")).alias("b", "x")).groupBy(*group, "b").agg((F.sum("x.wv") / F.nullif(F.sum("x.w"), F.lit(0.0))).alias("m"))
    ends = each.groupBy(*group).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))  # a value per resample
    return sizes.join(ends, group)


def bootstrap_median_band(rows: DataFrame, group: list[str], resamples: int, seed: str, level: float = 0.95, bins: int = 128) -> DataFrame:
    """Percentile band of the median by group; series are resampled with all their rows.  With one series the band is its median twice.

    Draws depend on a group's number of series alone, so groups of one size share them.  A series travels as one row with its values and the resamples
    that drew it; how much of each resample lies in each of ``bins`` ranges of values tells the range of its median, and only the values of such ranges
    are sorted.  Groups x bins x resamples numbers come to the driver.
    """
    spark, pairs = rows.sparkSession, group + ["unique_id"]
    scored = rows.select(*pairs, F.col("value").cast("double").alias("value"))
    ids = written(ranks.counted(scored.select(*pairs).distinct(), group, "unique_id").select(*pairs, F.col("before").cast("long").alias("j")))
    sizes = [tuple(r) for r in ids.groupBy(*group).agg(F.count("*").alias("n")).dropna(subset=group).collect()]  # a row for each group
    keyed = T.StructType([*ids.select(*group).schema.fields, T.StructField("n", T.LongType()), T.StructField("gid", T.IntegerType())])
    numbered = F.broadcast(spark.createDataFrame([(*r, k) for k, r in enumerate(sizes)], keyed))
    one_of_size = list({r[-1]: k for k, r in enumerate(sizes)}.values())
    known = scored.where("value IS NOT NULL").join(numbered, group)

    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    places = ids.join(numbered, group).where(F.col("gid").isin(one_of_size)).select("n", F.col("j").alias("i")).repartition(tasks)
    draws = places.select("n", "i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select("n", "b", hash_index(seed, [F.col("b"), F.col("i")], F.col("n")).alias("j"))
    drawn = draws.groupBy("n", "j").agg(F.collect_list("b").alias("drawn"))  # some ``resamples`` numbers
    values = known.join(ids, pairs).groupBy("n", "j").agg(F.collect_list(F.struct("gid", "value")).alias("x"))  # the rows of one series and size
    held = written(values.join(drawn, ["n", "j"]).select("drawn", F.col("x.gid").alias("gids"), F.col("x.value").alias("own")))
    cuts = known.groupBy("gid").agg(F.percentile_approx("value", [k / bins for k in range(1, bins)], 10_000).alias("cuts"))
    edges = {r["gid"]: np.unique(r["cuts"]) for r in cuts.collect()}

    def unpacked(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
        """How often each resample drew each series; then by group: its number, the series of its values, the values, their ranges."""
        for lo in range(0, len(part), 2048):
            own = part.iloc[lo : lo + 2048]
            row = np.repeat(np.arange(len(own)), own["drawn"].map(len))
            weight = np.bincount(row * resamples + np.concatenate(own["drawn"].to_numpy()), minlength=len(own) * resamples).reshape(len(own), resamples)
            owner, gid, value = np.repeat(np.arange(len(own)), own["own"].map(len)), np.concatenate(own["gids"].to_numpy()), np.concatenate(own["own"].to_numpy())
            for g in np.unique(gid):
                of = gid == g
                yield weight, int(g), owner[of], value[of], np.searchsorted(edges[g], value[of], "right")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for weight, g, owner, _, place in unpacked(part):
                cells = np.bincount(place * len(weight) + owner, minlength=bins * len(weight)).reshape(bins, len(weight))
                total[g] = total.get(g, 0) + cells.astype(float) @ weight  # whole numbers, far below 2^53
        for g, sums in total.items():
            yield pd.DataFrame({"gid": g, "bin": np.arange(bins), "w": list(sums.astype(np.int64))})

    sums = held.mapInPandas(counts, "gid int, bin int, w array<long>").select("gid", "bin", F.posexplode("w").alias("b", "w")).groupBy("gid", "bin", "b").agg(F.sum("w").alias("w")).toPandas()
    span: dict[int, tuple] = {}  # first and last range needed, what each resample has below, and in all
    for g, own in sums.groupby("gid"):
        by = np.zeros((bins, resamples), np.int64)
        by[own["bin"], own["b"]] = own["w"]
        upto, n = by.cumsum(axis=0), by.sum(axis=0)
        some = n > 0
        if some.any():
            first, last = ((upto <= at).sum(axis=0)[some] for at in ((n - 1) // 2, n // 2))
            span[int(g)] = int(first.min()), int(last.max()), upto[first.min()] - by[first.min()], n

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for weight, g, owner, value, place in unpacked(part):
                if g in span and len(at := np.flatnonzero((place >= span[g][0]) & (place <= span[g][1]))):
                    yield pd.DataFrame({"gid": g, "value": value[at], "w": list(weight[owner[at]].astype(np.int32))})

    def middle(part: pd.DataFrame) -> pd.DataFrame:
        part, g = part.sort_values("value"), int(part["gid"].iloc[0])
        _, _, below, n = span[g]
        value, upto = part["value"].to_numpy(), np.stack(part["w"].to_numpy()).cumsum(axis=0, dtype=np.int64) + below
        low, high = (value[np.minimum((upto <= at).sum(axis=0), len(value) - 1)] for at in ((n - 1) // 2, n // 2))
        return pd.DataFrame({"gid": g, "m": np.where(low == high, low, 0.5 * low + 0.5 * high)[n > 0]})

    medians = held.mapInPandas(near, "gid int, value double, w array<int>").groupBy("gid").applyInPandas(middle, "gid int, m double")
    a = (1 - level) / 2
    ends = medians.groupBy("gid").agg(F.percentile("m", F.lit(a)).alias("low"), F.percentile("m", F.lit(1 - a)).alias("high"))  # a value per resample
    return numbered.join(ends, "gid", "left").select(*group, "low", "high")
