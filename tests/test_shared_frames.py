"""Frames that all backtest queries share: each pass over the lines, the panel or the forecasts is made once, with the results of the plain form."""

import datetime

import pytest
from pyspark.sql import functions as F

from weekloom.config import PROTOCOL
from weekloom.operators import baselines, panel, pooled, score, split
from weekloom.sources import raw

DAY = datetime.date(1995, 1, 1)


def same(one, other):
    one = one.select(*other.columns)
    return one.count() == other.count() and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


@pytest.fixture(scope="module")
def sales(spark, tmp_path_factory):
    """Tables of 250 suppliers, with lines lacking an amount, a discount, a flag or a date, returns, a brand without FOOD lines and a region without a name."""
    d, day = f"file://{tmp_path_factory.mktemp('sales')}", datetime.datetime(1996, 1, 1)
    lines = [
        (k, k % 7 if k % 11 else 5, k % 250, float(k % 50 + 1), None if k % 13 == 0 else k * 17.13 - 900, None if k % 17 == 0 else (k % 11) / 100, None if k % 19 == 0 else "NRA"[k % 3] if k % 7 else "R", None if k % 23 == 0 else day + datetime.timedelta(days=k * 3 % 2500))
        for k in range(1, 1500)
    ]
    frames = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"),
        "part": ([(k, f"Brand#{10 + k % 5}") for k in range(7)], "p_partkey long, p_brand string"),
        "supplier": ([(k, k % 4) for k in range(250)], "s_suppkey long, s_nationkey int"),
        "nation": ([(k, k % 3) for k in range(4)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "ASIA"), (1, "EUROPE"), (2, None)], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_export_from_one_pass_over_the_lines_is_that_of_the_sql(spark, sales):
    weekly = raw.weekly_sales(spark, sales)
    want = spark.sql(raw.EXPORT_SQL, **{t: spark.read.parquet(f"{sales}/{t}.parquet") for t in raw.SALES_TABLES})
    got = raw.raw_export(weekly)
    assert got.dtypes == want.dtypes and want.count() > 1000 and same(got, want)
    plan = raw.weekly_sales(spark, sales)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.count("Expand") == 0 and sum("Relation [l_orderkey" in x for x in plan.splitlines()) == 1


def test_sums_beyond_the_whole_numbers_of_a_double_are_rounded_once(spark):
    weekly = spark.createDataFrame([("Brand#11", "ASIA", DAY, 9007199254740993, 200, None, None, 0)], "brand string, market string, wk date, rev long, qty long, food_rev long, food_qty long, n_food long")
    rows = raw.raw_export(weekly).where("Geography = 'ASIA'").collect()
    assert [(r.Dollars, r.Units) for r in rows] == [(900719925474.0993, 2.0)]


def test_panel_makes_no_channel_that_is_out_of_scope(spark, sales):
    plan = panel.panel(raw.raw_export(raw.weekly_sales(spark, sales)), PROTOCOL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "food_rev" not in plan and plan.count("Sort") == 0


@pytest.fixture(scope="module")
def gappy(spark):
    """Series with gaps across an origin, at either end, of one week, and without any value."""
    ys = {"a": [1.0, None, None, 4.0, None, None, 7.0, 9.0], "b": [None, None, 3.0, None, None, None, None, 8.0], "c": [2.0], "d": [None] * 6, "e": [5.0, 6.0, None, None], "f": [None, 1.5, 2.5, None, 9.5, 9.0]}
    start = {"f": 2}
    rows = [(s, DAY + datetime.timedelta(weeks=w + start.get(s, 0)), y) for s, own in ys.items() for w, y in enumerate(own)]
    folds = spark.createDataFrame([(k, DAY + datetime.timedelta(weeks=w)) for k, w in enumerate((1, 4, 5, 7))], "fold int, origin date")
    return spark.createDataFrame(rows, "unique_id string, ds date, y double"), folds


def test_folds_share_one_sort_of_each_series(gappy):
    rows, folds = gappy
    want = split.impute(split.training(rows, folds), ("fold", "unique_id"))
    got = split.imputed_folds(rows, folds)
    assert same(got, want)
    plan = got._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows, join = [k for k, x in enumerate(plan) if "Window [" in x], next(k for k, x in enumerate(plan) if "Join" in x)
    assert len(windows) == 1 and join < windows[0]  # once, below the join with the folds
    assert same(split.imputed_series(rows, folds), pooled.gathered(want))


def test_baselines_of_gathered_series_are_those_of_rows(spark, gappy):
    rows, folds = gappy
    long = spark.createDataFrame([("long", DAY - datetime.timedelta(weeks=w), float(w * 37 % 101)) for w in range(120)], "unique_id string, ds date, y double")
    rows = rows.unionByName(long)
    filled = split.imputed_folds(rows, folds)
    want = baselines.naive(filled, PROTOCOL).unionByName(baselines.seasonal_naive(filled, PROTOCOL)).unionByName(baselines.window_mean(filled, PROTOCOL))
    got = baselines.of_series(split.imputed_series(rows, folds), PROTOCOL)
    assert got.schema.simpleString() == want.schema.simpleString()
    rounded = lambda x: {(r.model, r.fold, r.unique_id, r.step): [r.yhat, *r.q] for r in x.collect()}
    one, other = rounded(got), rounded(want)
    assert one.keys() == other.keys()
    for key, values in other.items():
        assert [v is None for v in one[key]] == [v is None for v in values], key
        assert [v for v in one[key] if v is not None] == pytest.approx([v for v in values if v is not None], rel=1e-12, abs=1e-9), key


def test_point_and_quantile_scores_come_from_one_join(spark):
    q = lambda y: [y + k - 4.0 for k in range(9)]
    actual = spark.createDataFrame([(0, s, h, DAY, None if (s, h) == ("b", 2) or s == "d" else float(h * (s != "c"))) for s in "abcd" for h in range(1, 14)], "fold int, unique_id string, step int, ds date, y double")
    made = [(m, 0, s, h, float(h + (m == "n")), q(h + 0.5)) for m in "mn" for s in "abcd" for h in range(1, 14) if (m, s) != ("n", "a") and h != 3]
    forecast = spark.createDataFrame(made, "model string, fold int, unique_id string, step int, yhat double, q array<double>")
    scale = spark.createDataFrame([("a", 2.0, 3.0), ("b", 0.0, 0.0), ("c", 1.0, 1.0)], "unique_id string, mase_den double, rmsse_den double")
    want = score.score_point(actual, forecast, scale, PROTOCOL).unionByName(score.score_quantile(actual, forecast, PROTOCOL))
    got = score.score_both(actual, forecast, scale, PROTOCOL)
    near = lambda x: x.withColumn("value", F.round("value", 9))
    assert same(near(got), near(want)) and got.schema.simpleString() == want.schema.simpleString()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("avg(") and sum("Aggregate [model" in x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines()) <= 2


def test_windows_are_joined_with_the_weeks_after_the_first_origin_only(gappy):
    rows, folds = gappy
    made = split.test_window(rows, folds, PROTOCOL)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "first#" in plan
    known = {(r.unique_id, r.ds): r.y for r in rows.collect()}
    assert all(r.y == known.get((r.unique_id, r.ds)) for r in made.collect()) and made.count() == 13 * (4 * 5 + 3)
