"""The CSV scan with bad rows set aside, digests of sets, and tuning on shared sums."""

import numpy as np
from pyspark.sql import functions as F

from tests.test_pooled import frame
from weekloom.config import PROTOCOL
from weekloom.operators import pooled, sampling
from weekloom.sources import raw


def test_bad_rows_are_set_aside(spark, tmp_path):
    head = "internal_id,Geography,Time_Period_End_Date,Geography_Level,Channel_Outlet,Dollars,Units,ARP\n"
    scope = "MARKET,CONVENTIONAL|MULTI OUTLET"
    (tmp_path / "a.csv").write_text(head + f"p1,east,2000-01-02,{scope},1.5,2,null\np1,east,2000-01-32,{scope},1,2,3\np2,west\np3,east,2000-01-02,{scope},x,NaN,3\n")
    (tmp_path / "b.csv").write_text(head + f"null,east,2000-01-02,{scope},1,2,3\np4,east,2000-01-02,TOTAL,ALL,1,2,3\np5,east,2000-01-02,{scope},1,2,3,4\n\"p,6\",east,2000-01-09,{scope},7,8,9\n")
    rows, aside = raw.scan_csv_apart(spark, f"file://{tmp_path}", PROTOCOL)
    assert sorted((r.internal_id, str(r.Time_Period_End_Date), r.Dollars, r.Units, r.ARP) for r in rows.collect()) == [("p,6", "2000-01-09", 7.0, 8.0, 9.0), ("p1", "2000-01-02", 1.5, 2.0, None), ("p3", "2000-01-02", None, None, 3.0)]
    got = sorted((r.reason, r.line or "", r.internal_id or "") for r in aside.collect())
    assert [g[0] for g in got] == ["bad date", "malformed", "malformed", "no key"] and got[1][1].startswith("p2") and got[2][1].startswith("p5")


def test_tree_digest_is_that_of_a_set(spark):
    ids = [f"s{k}" for k in range(500)]
    digest = lambda x, parts, n: sampling.ids_tree_digest(spark.createDataFrame([(i, 1) for i in x], "unique_id string, n_series long").repartition(n), parts).first().digest
    one = digest(ids, 16, 1)
    assert one == digest(ids[::-1], 16, 7) and one != digest(ids[1:], 16, 3) and one != digest([*ids[1:], "s500"], 16, 3) and len(one) == 16


def test_penalties_are_tuned_on_one_pass(spark):
    filled = frame(spark).where("fold = 1")
    actual = filled.groupBy("unique_id").agg(F.max_by("y", "ds").alias("y")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(13))))
    scale = filled.select("unique_id").distinct().withColumn("mase_den", F.lit(2.0))
    made = {(r.model, r.trial): r for r in pooled.tune(filled, actual, scale, [pooled.lagged(PROTOCOL), pooled.direct(PROTOCOL)], {"ridge_global": [0.1, 10.0, 1e4], "linear_global": [1.0]}, PROTOCOL).collect()}
    assert set(made) == {("ridge_global", 0), ("ridge_global", 1), ("ridge_global", 2), ("linear_global", 0)} and made["ridge_global", 1].params == "ridge=10.0"
    alone = pooled.forecast(filled, pooled.lagged(PROTOCOL), PROTOCOL, ridge=10.0).join(actual, ["unique_id", "step"])
    want = np.mean([r.v / 2.0 for r in alone.groupBy("unique_id").agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("v")).collect()])
    assert np.isclose(made["ridge_global", 1].value, want)
