"""Profiles, strata, quotas and seeded draws of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.sources.scratch import written


def series_profile(panel: DataFrame) -> DataFrame:
    by = panel.groupBy("unique_id").agg(
        F.count("y").alias("n_obs"), F.count("*").alias("n_grid"), F.sum("y").alias("total_volume"), F.count_if(F.col("y") == 0).alias("n_zero"),
        F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"), F.count_if(F.col("y").isNull()).alias("n_missing"),
    )
    return by.withColumn("zero_share", F.try_divide("n_zero", "n_obs"))


def eligible_profile(profile: DataFrame, checked: DataFrame, denominators: DataFrame) -> DataFrame:
    good = checked.where("meets_min_train AND covers_span").select("unique_id").join(denominators.where("mase_den > 0").select("unique_id"), "unique_id", "left_semi")
    return profile.join(good, "unique_id", "left_semi")


def eligibility_report(checked: DataFrame, denominators: DataFrame) -> DataFrame:
    """How many series each requirement turns away; one may count under several."""
    rows = checked.join(denominators.select("unique_id", "mase_den"), "unique_id", "left")
    flat = ~F.coalesce(F.col("mase_den") > 0, F.lit(False))
    short, open_ = ~F.col("meets_min_train"), ~F.col("covers_span")
    return rows.agg(F.count("*").alias("n_series"), F.count_if(short).alias("below_min_train"), F.count_if(open_).alias("uncovered"), F.count_if(flat).alias("flat_denominator"), F.count_if(~(short | open_ | flat)).alias("eligible"))


def global_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """A row number over all rows, without moving them to one task: ranges are numbered, then shifted by the sizes of those before."""
    placed = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    placed = written(placed)  # the ranges must not be dealt anew
    sizes = {r["range"]: r["count"] for r in placed.groupBy("range").count().collect()}  # one number per partition
    shift, pairs = 0, []
    for k in sorted(sizes):
        pairs += [F.lit(k), F.lit(shift)]
        shift += sizes[k]
    offset = F.create_map(*pairs)[F.col("range")] if pairs else F.lit(0)
    return placed.withColumn(name, F.row_number().over(Window.partitionBy("range").orderBy(*order)) + offset).drop("range")


def strata(profile: DataFrame, protocol: Protocol) -> DataFrame:
    """Labels "decile|zero bin" of all series with enough observed weeks and a known zero share.

    The decile is that of equal-frequency cuts of the ranks 1 to n, where a rank on a cut belongs below it.
    """
    rows = global_rank(profile.where((F.col("n_obs") >= protocol.min_observed) & F.col("zero_share").isNotNull()), ["total_volume", "unique_id"], "r")
    n = rows.agg(F.count("*").alias("n"))
    rows = rows.join(F.broadcast(n))  # one row
    top = (F.col("r") - 1) * protocol.deciles
    width = F.greatest(F.col("n") - 1, F.lit(1))
    decile = F.greatest(F.floor((top + width - 1) / width) - 1, F.lit(0)).cast("int")
    bins = protocol.zero_bins
    zero = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(bins, bins[1:], strict=False)):
        zero = F.when((F.col("zero_share") >= a) & (F.col("zero_share") < b), k).otherwise(zero)
    return rows.withColumn("decile", decile).withColumn("zero_bin", zero).withColumn("stratum", F.concat_ws("|", F.col("decile").cast("string"), F.col("zero_bin").cast("string"))).drop("r", "n")


def quota(labelled: DataFrame, n: int) -> DataFrame:
    """stratum, n_pool, quota: n series (all, if there are fewer) shared out in proportion to the strata's sizes.

    A stratum gets the whole part of its share; the series still missing go one each by the largest broken part, ties by stratum.
    No stratum gets more than it has, as a share of at most n of n_pool in all is at most the stratum's size.
    """
    sized = labelled.groupBy("stratum").agg(F.count("*").alias("n_pool"))  # at most deciles x zero bins rows
    every = Window.partitionBy()
    wanted = F.least(F.lit(n), F.sum("n_pool").over(every))
    shares = sized.withColumn("share", F.col("n_pool") * wanted / F.sum("n_pool").over(every)).withColumn("wanted", wanted).withColumn("whole", F.floor("share"))
    by_rest = Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("whole") - F.col("share"), 9), "stratum")
    one_more = F.row_number().over(by_rest) <= F.col("wanted") - F.sum("whole").over(every)
    return shares.select("stratum", "n_pool", (F.col("whole") + one_more.cast("long")).alias("quota"))


def shuffled(seed: str) -> list[Column]:
    """An order by a seeded hash: the same at any partitioning."""
    return [F.md5(F.concat_ws("|", F.lit(seed), "unique_id").cast("binary")), F.col("unique_id")]


def stratified_sample(labelled: DataFrame, n: int, seed: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("stratum").orderBy(*shuffled(str(seed))))
    shares = quota(labelled, n).select("stratum", "quota")
    return labelled.withColumn("place", place).join(F.broadcast(shares), "stratum").where("place <= quota").select(labelled.columns)


def nested_ladder(pool: DataFrame, anchor: DataFrame, sizes: list[int], seed: int) -> DataFrame:
    """Rungs of growing size over one order of the whole pool, so that each holds the one before.  Adds n_series.

    The anchor's series come first.  Among them, and then among all others, series come by (place - 1/2) / stratum size, where
    the place in the stratum is by seeded hash and goes on behind the anchor's: every rung is spread over the strata in proportion,
    and beyond the anchor the strata that it has too few of are filled up first.  A rung is the first n series; that of the anchor's size is the anchor.
    """
    held, total, chosen = (frame.count() for frame in (anchor.join(pool, "unique_id", "left_semi"), pool, anchor))
    if held < chosen:
        raise ValueError(f"the pool lacks {chosen - held} of the {chosen} series of the anchor")
    if chosen not in sizes or max(sizes) > total:
        raise ValueError(f"rungs {sorted(sizes)} need one of {chosen} series, the anchor, and none above {total}, the pool")
    marked = pool.join(anchor.select("unique_id", F.lit(0).alias("later")), "unique_id", "left").withColumn("later", F.coalesce("later", F.lit(1)))
    in_stratum = Window.partitionBy("stratum")
    place = F.row_number().over(in_stratum.orderBy("later", *shuffled(str(seed))))
    ordered = marked.withColumn("turn", (place - 0.5) / F.count("*").over(in_stratum))
    ordered = written(global_rank(ordered, ["later", "turn", "stratum"], "nth"))
    rungs = F.array(*[F.lit(n).cast("long") for n in sorted(sizes)])
    return ordered.select(*pool.columns, F.explode(F.filter(rungs, lambda n: n >= F.col("nth"))).alias("n_series"))


def stratum_report(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("decile").agg(F.count("*").alias("n_series"), F.count_if(F.col("zero_bin") > 0).alias("n_intermittent"), F.min("total_volume").alias("least_volume"), F.max("total_volume").alias("most_volume"), F.count_distinct("stratum").alias("n_strata"))


def ids_digest(rows: DataFrame) -> DataFrame:
    """First 16 hex digits of SHA-256 over the sorted ids of each rung; a rung's ids are at most its size."""
    joined = F.array_join(F.array_sort(F.collect_list("unique_id")), "\n")
    return rows.groupBy("n_series").agg(F.substring(F.sha2(joined.cast("binary"), 256), 1, 16).alias("digest"))


def ids_tree_digest(rows: DataFrame, parts: int = 4096) -> DataFrame:
    """A digest of each rung's set of ids that can be merged: ids are dealt to ``parts`` by their own hash, each part's sorted ids are hashed, and then the parts' hashes in order.

    The same at any partitioning; no array holds more than a part's ids.
    """
    part = F.pmod(F.conv(F.substring(F.md5(F.col("unique_id").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts))
    joined = F.array_join(F.array_sort(F.collect_list("unique_id")), "\n")
    leaves = rows.select("n_series", "unique_id", part.alias("part")).groupBy("n_series", "part").agg(F.sha2(joined.cast("binary"), 256).alias("leaf"))
    tree = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "leaf"))), lambda x: F.concat_ws(":", x.part.cast("string"), x.leaf)), "\n")  # at most parts
    return leaves.groupBy("n_series").agg(F.substring(F.sha2(tree.cast("binary"), 256), 1, 16).alias("digest"))


def nesting(rows: DataFrame) -> DataFrame:
    """For each rung the number of its series that the next rung lacks (0 if nested)."""
    sizes = rows.select("n_series").distinct()
    nxt = sizes.select("n_series", F.lead("n_series").over(Window.orderBy("n_series")).alias("next_n")).where("next_n IS NOT NULL")
    mine = rows.select("n_series", "unique_id").join(F.broadcast(nxt), "n_series")
    theirs = rows.select(F.col("n_series").alias("next_n"), "unique_id", F.lit(1).alias("there"))
    return mine.join(theirs, ["next_n", "unique_id"], "left").groupBy("n_series", "next_n").agg(F.count_if(F.col("there").isNull()).alias("n_missing"))
