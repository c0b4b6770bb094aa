"""The panel, splits, gap filling and scores on hand-sized inputs."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.operators import baselines, features, panel, sampling, score, split
from weekloom.sources import raw

SMALL = Protocol(season=4, folds=2, step=2, horizons=(1, 3), min_train=8, min_observed=8, deciles=2)
SUNDAY = dt.date(2022, 1, 9)


def week(k):
    return SUNDAY + dt.timedelta(7 * k)


def series(spark, values, name="s@@m", at=None):
    at = at or range(len(values))
    return spark.createDataFrame([(name, week(k), None if v is None else float(v)) for k, v in zip(at, values, strict=True)], "unique_id string, ds date, y double")


def values(frame, *order):
    return [r.y for r in frame.orderBy(*(order or ("ds",))).collect()]


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, "internal_id string, Geography string, Time_Period_End_Date date, Geography_Level string, Channel_Outlet string, Dollars double, Units double, ARP double")


def export(spark):
    multi, food = "CONVENTIONAL|MULTI OUTLET", "CONVENTIONAL|FOOD"
    rows = [("A", "X ", week(k), "MARKET", multi, 10.0 * k, 1.0, 2.0) for k in (0, 1, 4)] + [("B", "X ", week(k), "MARKET", multi, None if k == 1 else 5.0, 1.0, 5.0) for k in (2, 1)]
    return raw_rows(spark, rows + [("A", "T", week(0), "CENSUS REGION", multi, 1.0, 1.0, 1.0), ("A", "X ", week(0), "MARKET", food, 1.0, 1.0, 1.0)])


def test_grid_keeps_absent_and_unknown_apart(spark):
    rows = panel.panel(export(spark), SMALL)
    a = rows.where("internal_id = 'A'").orderBy("ds").collect()
    assert [(r.unique_id, r.y, r.row_present, r.geography) for r in a] == [("A@@X ", y, p, "X ") for y, p in ((0.0, True), (10.0, True), (0.0, False), (0.0, False), (40.0, True))]
    b = rows.where("internal_id = 'B'").orderBy("ds").collect()
    assert [(r.y, r.row_present) for r in b] == [(None, True), (5.0, True)]
    missing = panel.panel(export(spark), Protocol(absent="missing")).where("internal_id = 'A'")
    assert values(missing) == [0.0, 10.0, None, None, 40.0]
    with pytest.raises(ValueError):
        panel.panel(export(spark), Protocol(absent="other"))


def test_contract_of_the_export(spark, tmp_path):
    with pytest.raises(raw.SchemaError, match="Units"):
        raw.validate_columns(export(spark).drop("Units"))
    export(spark).withColumn("Dollars", F.coalesce(F.col("Dollars").cast("string"), F.lit("null"))).coalesce(1).write.csv(str(tmp_path / "x"), header=True)
    read = raw.scan_csv(spark, str(tmp_path / "x"), SMALL)
    assert read.count() == 5 and read.where("Dollars IS NULL").count() == 1
    with pytest.raises(raw.SchemaError):
        raw.scan_csv(spark, str(tmp_path / "x"), Protocol(channels=("NONE",)))
    text = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "Units string")
    assert [r.Units for r in raw.coerce_numeric(text, ("Units",)).collect()] == [1.5, None, None, None]


def test_integrity_checks(spark):
    rows = series(spark, [1, 2, 3], at=[0, 1, 1])
    assert panel.duplicate_keys(rows).first()[0] == 1
    good = panel.weekly_check(series(spark, [1, 2, 3], at=[0, 1, 5])).first()
    assert (good.n_dates, good.n_weekdays, good.n_bad_gaps, good.weekday) == (3, 1, 0, 1)


@pytest.mark.parametrize("y, mase, rms, pairs, zero", [([1, 3, 5, 7, 4, 9, 14, 19], 7.5, 67.5, 4, False), ([1, 3, 5, 7, None, 9, 14, 19], 9.0, 87.0, 3, False), ([2] * 10, 0.0, 0.0, 6, True), ([1, 2, 3], None, None, 0, False)])
def test_denominators(spark, y, mase, rms, pairs, zero):
    r = score.seasonal_denominators(series(spark, y), None, 4).first()
    assert (r.mase_den, r.n_pairs, r.zero_denominator) == (mase, pairs, zero)
    assert rms is None and r.rmsse_den is None or r.rmsse_den == pytest.approx(math.sqrt(rms))


@pytest.mark.parametrize("y, want, filled", [([10, None, None, None, 50], [10, 20, 30, 40, 50], "imputed"), ([None, 2, 3], [None, 2, 3], "missing"), ([1, 2, None], [1, 2, 2], "carried")])
def test_imputation(spark, y, want, filled):
    out = split.impute(series(spark, y))
    assert values(out) == want
    report = split.impute_report(out).first()
    assert report[f"n_{filled}"] == sum(v is None for v in y) and report[f"n_series_{filled}"] == 1


def test_origins_and_windows(spark):
    rows = series(spark, range(20))
    folds = split.origins(rows, SMALL)
    assert [(r.fold, r.origin) for r in folds.orderBy("fold").collect()] == [(0, week(14)), (1, week(16))]
    assert split.tuning_origin(folds, SMALL).first()[0] == week(11)
    test = split.test_window(rows, folds, SMALL)
    assert [r.y for r in test.where("fold = 1").orderBy("step").collect()] == [17.0, 18.0, 19.0]
    with pytest.raises(Exception, match="too short"):
        split.origins(series(spark, range(5)), SMALL).collect()


def test_nothing_after_the_origin_is_read(spark):
    rows = series(spark, [k % 7 + 1 for k in range(80)]).withColumns({"units": F.col("y"), "arp": F.col("y"), "internal_id": F.lit("s"), "geography": F.lit("m")})
    folds = split.origins(rows, SMALL).where("fold = 0")
    origin = folds.first().origin
    poisoned = rows.withColumns({c: F.when(F.col("ds") > F.lit(origin), 1e9).otherwise(F.col(c)) for c in ("y", "units", "arp")})
    for make in (lambda p: split.future_covariates(p, folds, SMALL), lambda p: baselines.seasonal_naive(split.impute(split.training(p, folds).select("fold", "origin", "unique_id", "ds", "y"), ("fold", "unique_id")), SMALL)):
        assert sorted(map(str, make(rows).collect())) == sorted(map(str, make(poisoned).collect()))


def scored(spark, pairs, den=1.0):
    actual = spark.createDataFrame([(0, "s", k + 1, week(k), y) for k, (y, _) in enumerate(pairs)], "fold int, unique_id string, step int, ds date, y double")
    made = spark.createDataFrame([("m", 0, "s", k + 1, f, [f] * 9) for k, (_, f) in enumerate(pairs)], "model string, fold int, unique_id string, step int, yhat double, q array<double>")
    dens = spark.createDataFrame([("s", den, den)], "unique_id string, mase_den double, rmsse_den double")
    protocol = Protocol(horizons=(len(pairs),))
    return {r.metric: r for r in score.score_point(actual, made, dens, protocol).unionByName(score.score_quantile(actual, made, protocol)).collect()}


def test_scores(spark):
    r = scored(spark, [(0.0, 0.0), (10.0, 12.0), (None, 3.0)], 4.0)
    assert (r["MAE"].value, r["MAE"].n_points, r["MAE"].n_undefined) == (1.0, 2, 1)
    assert r["RMSE"].value == pytest.approx(math.sqrt(2)) and r["MASE"].value == 0.25
    assert (r["sMAPE"].value, r["sMAPE"].n_points, r["sMAPE"].n_undefined) == (pytest.approx(400 / 22), 1, 2)
    assert r["MAPE"].value == pytest.approx(20.0)
    assert r["CRPS"].value == pytest.approx(r["MAE"].value) and r["coverage_80"].value == 0.5
    none = scored(spark, [(None, 1.0)], 0.0)
    assert none["MAE"].value is None and none["MAE"].n_points == 0 and "CRPS" not in none
    assert scored(spark, [(1.0, 2.0)], 0.0)["MASE"].value is None


def test_contract_counts(spark):
    want = spark.createDataFrame([(0, "a", 1), (0, "b", 1)], "fold int, unique_id string, step int")
    made = spark.createDataFrame([("m", 0, "a", 1, None, [1.0, 0.0]), ("m", 0, "a", 1, 2.0, [1.0, 2.0]), ("m", 0, "z", 1, 2.0, [1.0, 2.0])], "model string, fold int, unique_id string, step int, yhat double, q array<double>")
    r = score.contract(want, made).first()
    assert (r.n_duplicate, r.n_absent, r.n_unexpected, r.n_crossed, r.n_keys) == (1, 1, 1, 1, 3)


@pytest.mark.parametrize("n, q", [(10, 2), (11, 5), (13, 5), (37, 10), (100, 10), (125, 10)])
def test_deciles_equal_rank_quantile_bins(spark, n, q):
    import numpy as np

    rows = spark.createDataFrame([(f"s{k:04d}", float((k * 37) % 23), 300, 0.01) for k in range(n)], "unique_id string, total_volume double, n_obs long, zero_share double")
    got = {r.unique_id: r.decile for r in sampling.strata(rows, Protocol(deciles=q)).collect()}
    order = sorted(got, key=lambda s: (float((int(s[1:]) * 37) % 23), s))
    edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, q + 1))
    want = np.clip(np.searchsorted(edges, np.arange(1, n + 1), side="left") - 1, 0, q - 1)
    assert [got[s] for s in order] == want.tolist()


def test_ladder(spark):
    pool = spark.createDataFrame([(f"s{k:03d}", f"{k % 3}|0") for k in range(90)], "unique_id string, stratum string")
    anchor = sampling.stratified_sample(pool, 30, 1)
    assert anchor.count() == 30 and {r["count"] for r in anchor.groupBy("stratum").count().collect()} == {10}
    ladder = sampling.nested_ladder(pool, anchor, [9, 30, 61], 1)
    assert {r.n_series: r["count"] for r in ladder.groupBy("n_series").count().collect()} == {9: 9, 30: 30, 61: 61}
    assert all(r.n_missing == 0 for r in sampling.nesting(ladder).collect())
    assert {r.unique_id for r in ladder.where("n_series = 30").collect()} == {r.unique_id for r in anchor.collect()}
    for n in (9, 61):
        assert {r["count"] for r in ladder.where(f"n_series = {n}").groupBy("stratum").count().collect()} <= {n // 3, n // 3 + 1}
    for sizes in ([9, 61], [30, 500]):
        with pytest.raises(ValueError, match="rungs"):
            sampling.nested_ladder(pool, anchor, sizes, 1)
    with pytest.raises(ValueError, match="lacks 2 of"):
        sampling.nested_ladder(pool.where("unique_id <> 's000'"), spark.createDataFrame([("s000", "0|0"), ("x", "0|0"), ("s001", "1|0")], pool.schema), [3], 1)


def test_quota_by_largest_broken_part(spark):
    pool = spark.createDataFrame([(f"s{k}", "aaaaabbbcc"[k]) for k in range(10)], "unique_id string, stratum string")
    for n, want in ((5, {"a": 3, "b": 1, "c": 1}), (0, {"a": 0, "b": 0, "c": 0}), (99, {"a": 5, "b": 3, "c": 2})):
        assert {r.stratum: r.quota for r in sampling.quota(pool, n).collect()} == want


def test_ladder_fills_up_what_the_anchor_lacks(spark):
    pool = spark.createDataFrame([(f"s{k:03d}", "ab"[k % 2]) for k in range(100)], "unique_id string, stratum string")
    anchor = pool.where("stratum = 'a'").orderBy("unique_id").limit(20)
    ladder = sampling.nested_ladder(pool, anchor, [10, 20, 40, 60], 1)
    got = {(r.n_series, r.stratum): r["count"] for r in ladder.groupBy("n_series", "stratum").count().collect()}
    assert got == {(10, "a"): 10, (20, "a"): 20, (40, "a"): 20, (40, "b"): 20, (60, "a"): 30, (60, "b"): 30}


def test_contexts(spark):
    tails = features.context_tail(series(spark, [1, None, 3, 7]), 2)
    assert tails.first().context == [3.0, 7.0]
    r = features.context_spread(features.context_padded(tails, 4)).first()
    assert r.padded == [3.0, 3.0, 3.0, 7.0] and r["mask"] == [False, False, True, True] and r.spread == 0.0
    assert features.context_spread(features.context_tail(series(spark, [1, 2, 5]), 3)).first().spread == pytest.approx(1.0)


def test_grid_needs_one_exchange(spark):
    plan = panel.grid(panel.keyed(export(spark), SMALL), SMALL)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") <= 1
