"""Checks that raise and name the first offenders."""

import datetime

import pytest

from weekloom.config import PROTOCOL
from weekloom.operators import panel, split


def day(k):
    return datetime.date(2000, 1, 2) + datetime.timedelta(days=k)


def test_repeated_weeks(spark):
    rows = spark.createDataFrame([(f"s{k}", day(0)) for k in range(8)] * 2 + [("t", day(7))], "unique_id string, ds date")
    with pytest.raises(ValueError, match="8 rows repeat a week, of series s0, s1, s2, s3, s4 and others"):
        panel.assert_unique_keys(rows)
    assert panel.assert_unique_keys(rows.distinct()).count() == 9


def test_weeks(spark):
    rows = spark.createDataFrame([("a", day(7 * k)) for k in range(5)] + [("b", day(8))], "unique_id string, ds date")
    with pytest.raises(ValueError, match="2 weekdays, not one: 2000-01-10"):
        panel.assert_weekly(rows)
    assert panel.assert_weekly(rows.where("unique_id = 'a'")).count() == 5


def test_frames_that_end_too_early(spark):
    rows = spark.createDataFrame([(0, f"s{k}", day(7 * w), None if w == 3 and k < 6 else 1.0, day(21)) for k in range(8) for w in range(4)], "fold int, unique_id string, ds date, y double, origin date")
    with pytest.raises(ValueError, match="6 series of a fold end before its origin: s0, s1, s2, s3, s4 and others"):
        split.assert_reaches_origin(rows)
    assert split.assert_reaches_origin(rows.where("unique_id IN ('s6', 's7')")).count() == 8


def test_series_that_do_not_fit_the_protocol(spark):
    rows = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, False)], "unique_id string, meets_min_train boolean, covers_span boolean")
    with pytest.raises(ValueError, match="1 series have fewer than 104 weeks to learn from: b"):
        split.assert_feasible(rows, PROTOCOL)
    with pytest.raises(ValueError, match="1 series do not cover the folds: c"):
        split.assert_feasible(rows.where("unique_id <> 'b'"), PROTOCOL)
    assert split.assert_feasible(rows.where("unique_id = 'a'"), PROTOCOL).count() == 1
