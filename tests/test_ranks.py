"""Ranks and quantiles by ranges against whole groups."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weekloom.operators import ranks, stats


def rows(spark, seed=1):
    rng = np.random.default_rng(seed)
    out = [("hot", 7.0)] * 400 + [("one", 3.5), ("none", None), ("two", 1.0), ("two", 4.0)]
    out += [("ties", float(v)) for v in rng.integers(0, 9, 700)] + [("plain", float(v)) for v in rng.normal(size=501)] + [("hot", float(v)) for v in rng.normal(size=100)] + [("plain", None)] * 5
    return spark.createDataFrame(out, "g string, v double").repartition(7), pd.DataFrame(out, columns=["g", "v"])


def test_ranks_and_quantiles(spark):
    frame, plain = rows(spark)
    got = {(r.g, r.v): r for r in ranks.counted(frame, ["g"], "v").withColumn("rank", ranks.mean_rank()).collect()}
    known = plain.dropna()
    want = known.assign(rank=known.groupby("g")["v"].rank()).groupby(["g", "v"])["rank"].agg(["first", "size"])
    assert {k: (r["rank"], r.n) for k, r in got.items()} == {k: (r["first"], r["size"]) for k, r in want.iterrows()}
    made = {r.g: (r.n, r.low, r.mid, r.high) for r in ranks.quantiles(frame, ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.975}).collect()}
    assert set(made) == {"hot", "one", "two", "ties", "plain"}
    for g, (n, *values) in made.items():
        own = known[known.g == g].v
        assert n == len(own) and np.allclose(values, np.quantile(own, [0.1, 0.5, 0.975]))
    spark_own = {r.g: r.m for r in frame.groupBy("g").agg(F.median("v").alias("m")).where("m IS NOT NULL").collect()}
    assert all(np.isclose(spark_own[g], made[g][2]) for g in made)
    assert ranks.quantiles(frame.where("g = 'none'"), ["g"], "v", {"q": 0.5}).count() == 0


def test_signed_ranks_with_many_ties(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 6, 900).astype(float), rng.integers(0, 5, 900).astype(float)
    pairs = spark.createDataFrame([("x", float(p), float(q)) for p, q in zip(a, b)] + [("same", 1.0, 1.0)] * 4 + [("null", None, 1.0)], "g string, a double, b double")
    got = {r.g: r for r in stats.wilcoxon(pairs, ["g"]).collect()}
    d = pd.Series(a - b)
    some = d[d != 0]
    rank = some.abs().rank()
    r = got["x"]
    assert (r.n, r.n_nonzero, r.median_diff) == (900, len(some), d.median()) and np.isclose(r.statistic, min(rank[some > 0].sum(), rank[some < 0].sum()))
    assert np.isclose(r.ties, sum(c**3 - c for c in some.abs().value_counts())) and np.isclose(r.share_first_better, (d < 0).mean())
    assert (got["same"].n, got["same"].n_nonzero, got["same"].statistic) == (4, 0, 0.0) and "null" not in got
