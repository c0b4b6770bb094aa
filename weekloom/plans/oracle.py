"""Equivalent SQL of the registered queries, for an independent engine.

``TABLES`` are common table expressions; ``sql`` puts those that a query needs before it.
"""

from __future__ import annotations

import re
from statistics import NormalDist

from weekloom.config import PROTOCOL as P
from weekloom.functions.distributions import range_quantile
from weekloom.operators.stats import FIRST, POISSON, SECOND, STEP
from weekloom.plans.queries import places
from weekloom.sources.raw import EXPORT_SQL, SALES_TABLES

Z = [NormalDist().inv_cdf(q) for q in P.levels]
ZLIST = "[" + ", ".join(repr(z) for z in Z) + "]"

TABLES: dict[str, str] = {
    "raw_export": EXPORT_SQL.format(**{t: t for t in SALES_TABLES}),
    "keyed": """SELECT internal_id || '@@' || Geography AS unique_id, Time_Period_End_Date AS ds, Dollars AS y, Units AS units, ARP AS arp, internal_id, Geography AS geography
FROM raw_export WHERE Geography_Level = 'MARKET' AND Channel_Outlet = 'CONVENTIONAL|MULTI OUTLET'""",
    "panel": """SELECT g.unique_id, g.ds, CASE WHEN k.ds IS NULL THEN 0.0::DOUBLE ELSE k.y END AS y, k.ds IS NOT NULL AS row_present, k.units, k.arp, g.internal_id, g.geography
FROM (SELECT unique_id, internal_id, geography, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS ds
      FROM (SELECT unique_id, min(internal_id) AS internal_id, min(geography) AS geography, min(ds) AS lo, max(ds) AS hi FROM keyed GROUP BY unique_id)) g
LEFT JOIN keyed k ON k.unique_id = g.unique_id AND k.ds = g.ds""",
    "origins": """SELECT CAST(f AS INTEGER) AS fold, hi - 91 - CAST((4 - f) * 28 AS INTEGER) AS origin FROM (SELECT max(ds) AS hi FROM panel), range(5) AS t(f)""",
    "train": "SELECT p.*, o.fold, o.origin FROM panel p JOIN origins o ON p.ds <= o.origin",
    "checked": """SELECT *, n_train >= 104 AS meets_min_train, coalesce(last_obs >= needs, false) AS covers_span FROM (
SELECT unique_id, count(*) FILTER (WHERE y IS NOT NULL AND ds <= lo) AS n_train, max(ds) FILTER (WHERE y IS NOT NULL) AS last_obs, min(hi) + 91 AS needs
FROM panel, (SELECT min(origin) AS lo, max(origin) AS hi FROM origins) GROUP BY unique_id)""",
    "denominators": """SELECT unique_id, avg(abs(d)) AS mase_den, sqrt(avg(d * d)) AS rmsse_den, count(d) AS n_pairs, coalesce(avg(abs(d)) = 0, false) AS zero_denominator
FROM (SELECT unique_id, y - lag(y, 52) OVER (PARTITION BY unique_id ORDER BY ds) AS d FROM panel WHERE ds <= (SELECT min(origin) FROM origins)) GROUP BY unique_id""",
    "profile": """SELECT unique_id, count(y) AS n_obs, count(*) AS n_grid, sum(y) AS total_volume, count(*) FILTER (WHERE y = 0) AS n_zero, min(ds) AS first_ds, max(ds) AS last_ds,
count(*) FILTER (WHERE y IS NULL) AS n_missing, CASE WHEN count(y) > 0 THEN count(*) FILTER (WHERE y = 0) / count(y) END AS zero_share FROM panel GROUP BY unique_id""",
    "eligible": "SELECT * FROM profile WHERE unique_id IN (SELECT unique_id FROM checked WHERE meets_min_train AND covers_span) AND unique_id IN (SELECT unique_id FROM denominators WHERE mase_den > 0)",
    "epanel": "SELECT * FROM panel WHERE unique_id IN (SELECT unique_id FROM eligible)",
    "gap_filled": """SELECT fold, origin, unique_id, ds, CASE WHEN y IS NOT NULL THEN y WHEN d1 IS NULL THEN y0 WHEN d0 IS NOT NULL THEN y0 + (y1 - y0) * ((ds - d0) / (d1 - d0)) END AS y FROM (
SELECT fold, origin, unique_id, ds, y,
  last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d0, last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d1, first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y1
FROM epanel JOIN origins ON ds <= origin WINDOW w AS (PARTITION BY fold, unique_id ORDER BY ds))""",
    "steps": "SELECT CAST(range AS INTEGER) AS step FROM range(1, 14)",
    "marked": """SELECT *, y - lag(y) OVER (PARTITION BY fold, unique_id ORDER BY ds) AS d1, y - lag(y, 52) OVER (PARTITION BY fold, unique_id ORDER BY ds) AS d52,
row_number() OVER (PARTITION BY fold, unique_id ORDER BY ds DESC) AS back FROM gap_filled""",
    "by_series": """SELECT fold, unique_id, max(y) FILTER (WHERE back = 1) AS last, sqrt(avg(d1 * d1)) AS s1, sqrt(avg(d52 * d52)) AS s52,
avg(y) FILTER (WHERE back <= 13) AS m13, stddev_pop(y) FILTER (WHERE back <= 13) AS sd13 FROM marked GROUP BY fold, unique_id""",
    "f_naive": "SELECT 'naive' AS model, fold, unique_id, step, last AS yhat, s1 * sqrt(step) AS spread FROM by_series, steps",
    "f_seasonal": """SELECT 'seasonal_naive' AS model, b.fold, b.unique_id, step, m.y AS yhat, s52 AS spread
FROM by_series b CROSS JOIN steps LEFT JOIN marked m ON m.fold = b.fold AND m.unique_id = b.unique_id AND m.back = 53 - step""",
    "f_mean": "SELECT 'mean_13' AS model, fold, unique_id, step, m13 AS yhat, sd13 AS spread FROM by_series, steps",
    "forecasts": f"""SELECT *, list_transform({ZLIST}, lambda z: yhat + spread * z) AS q FROM (SELECT * FROM f_naive UNION ALL SELECT * FROM f_seasonal UNION ALL SELECT * FROM f_mean)""",
    "tests": """SELECT fold, g.unique_id, step, g.ds, p.y FROM (
SELECT fold, unique_id, step, origin + 7 * step AS ds FROM (SELECT unique_id, min(ds) AS lo FROM panel GROUP BY unique_id) JOIN origins ON lo <= origin CROSS JOIN steps) g
LEFT JOIN panel p ON p.unique_id = g.unique_id AND p.ds = g.ds""",
    "actual": "SELECT * FROM tests WHERE unique_id IN (SELECT unique_id FROM eligible)",
    "scored": "SELECT a.model, a.fold, h.horizon, a.unique_id, a.step, a.y, f.yhat, f.q, a.y IS NOT NULL AND f.yhat IS NOT NULL AS ok FROM (SELECT * FROM actual, (SELECT DISTINCT model FROM forecasts)) a LEFT JOIN forecasts f USING (model, fold, unique_id, step) JOIN (VALUES (4), (13)) h(horizon) ON a.step <= h.horizon",
    "point": """SELECT model, fold, horizon, unique_id, count(*) FILTER (WHERE ok) AS n, count(*) FILTER (WHERE NOT ok) AS u,
avg(abs(y - yhat)) FILTER (WHERE ok) AS mae, sqrt(avg((y - yhat) * (y - yhat)) FILTER (WHERE ok)) AS rmse,
avg(200 * abs(y - yhat) / (abs(y) + abs(yhat))) FILTER (WHERE ok AND abs(y) + abs(yhat) > 0) AS smape, count(*) FILTER (WHERE ok AND abs(y) + abs(yhat) > 0) AS n_s, count(*) FILTER (WHERE ok AND abs(y) + abs(yhat) = 0) AS u_s,
avg(100 * abs((y - yhat) / y)) FILTER (WHERE ok AND y <> 0) AS mape, count(*) FILTER (WHERE ok AND y <> 0) AS n_m, count(*) FILTER (WHERE ok AND y = 0) AS u_m
FROM scored GROUP BY ALL""",
    "point_long": """SELECT model, fold, horizon, unique_id, 'MAE' AS metric, mae AS value, n AS n_points, u AS n_undefined FROM point
UNION ALL SELECT model, fold, horizon, unique_id, 'RMSE', rmse, n, u FROM point
UNION ALL SELECT model, fold, horizon, unique_id, 'MASE', mae / nullif(mase_den, 0), n, u FROM point LEFT JOIN denominators USING (unique_id)
UNION ALL SELECT model, fold, horizon, unique_id, 'RMSSE', rmse / nullif(rmsse_den, 0), n, u FROM point LEFT JOIN denominators USING (unique_id)
UNION ALL SELECT model, fold, horizon, unique_id, 'sMAPE', smape, n_s, u + u_s FROM point
UNION ALL SELECT model, fold, horizon, unique_id, 'MAPE', mape, n_m, u + u_m FROM point""",
    "losses": f"""SELECT model, fold, horizon, unique_id, count(*) AS n, avg(loss) AS pinball, avg(CASE WHEN y BETWEEN q[1] AND q[9] THEN 1.0 ELSE 0.0 END) AS covered FROM (
SELECT *, list_sum(list_transform(range(1, 10), lambda i: greatest({list(P.levels)}[i] * (y - q[i]), ({list(P.levels)}[i] - 1) * (y - q[i])))) / 9 AS loss FROM scored WHERE ok) GROUP BY model, fold, horizon, unique_id""",
    "quantile_long": """SELECT model, fold, horizon, unique_id, 'pinball' AS metric, pinball AS value, n AS n_points, CAST(0 AS BIGINT) AS n_undefined FROM losses
UNION ALL SELECT model, fold, horizon, unique_id, 'CRPS', 2 * pinball, n, 0 FROM losses UNION ALL SELECT model, fold, horizon, unique_id, 'coverage_80', covered, n, 0 FROM losses""",
    "metrics": "SELECT *, CASE WHEN fold < 4 THEN fold % 2 = 1 END AS covariates FROM (SELECT * FROM point_long UNION ALL SELECT * FROM quantile_long)",
    "mase": "SELECT * FROM metrics WHERE metric = 'MASE'",
    "blocks": "SELECT unique_id, model, avg(value) AS value FROM mase WHERE horizon = 4 GROUP BY unique_id, model QUALIFY count(avg(value)) OVER (PARTITION BY unique_id) = (SELECT count(DISTINCT model) FROM mase)",
    "pairs": "SELECT x.unique_id, x.model AS model_a, y.model AS model_b, x.value AS a, y.value AS b FROM blocks x JOIN blocks y ON x.unique_id = y.unique_id AND x.model < y.model",
    "labelled": """SELECT *, decile || '|' || zero_bin AS stratum FROM (
SELECT * EXCLUDE (r, n), CAST(greatest(ceil((r - 1) * 10.0 / greatest(n - 1, 1)) - 1, 0) AS INTEGER) AS decile,
  CASE WHEN zero_share >= 0 AND zero_share < 0.05 THEN 0 WHEN zero_share >= 0.05 AND zero_share < 0.2 THEN 1 WHEN zero_share >= 0.2 AND zero_share < 1.01 THEN 2 END AS zero_bin
FROM (SELECT *, row_number() OVER (ORDER BY total_volume, unique_id) AS r, count(*) OVER () AS n FROM eligible WHERE n_obs >= 156 AND zero_share IS NOT NULL))""",
    "sizes": "SELECT DISTINCT unnest([count(*) // 4, count(*) // 2, count(*)]) AS n_series FROM labelled",
    "shares": "SELECT stratum, count(*) AS n_pool FROM labelled GROUP BY stratum",
    "quotas": """SELECT n_series, stratum, n_pool, CAST(base + CASE WHEN row_number() OVER (PARTITION BY n_series ORDER BY round(exact - base, 9) DESC, stratum) <= n_series - sum(base) OVER (PARTITION BY n_series) THEN 1 ELSE 0 END AS BIGINT) AS quota
FROM (SELECT *, floor(exact) AS base FROM (SELECT n_series, stratum, n_pool, CAST(n_pool * n_series AS DOUBLE) / sum(n_pool) OVER (PARTITION BY n_series) AS exact FROM shares, sizes))""",
    "ladder": "SELECT q.n_series, unique_id, d.stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('42|' || unique_id), unique_id) AS r FROM labelled) d JOIN quotas q ON q.stratum = d.stratum AND r <= quota",
    "common": "SELECT unique_id FROM ladder GROUP BY unique_id HAVING count(DISTINCT n_series) = (SELECT count(DISTINCT n_series) FROM ladder)",
    "rungs": "SELECT m.*, l.n_series FROM metrics m JOIN ladder l USING (unique_id)",
    "rung_medians": "SELECT model, n_series, horizon, median(value) AS median FROM rungs WHERE metric = 'MASE' GROUP BY model, n_series, horizon",
    "levels": "SELECT horizon, median(value) AS reference FROM mase WHERE model = 'seasonal_naive' AND unique_id IN (SELECT unique_id FROM labelled) GROUP BY horizon",
    "crossed": """SELECT model, horizon, reference, min(n_series) FILTER (WHERE median < reference) AS first_n_below, max(n_series) AS max_n, arg_max(median, n_series) AS at_max_n, (arg_max(median, n_series) / reference - 1) * 100 AS gap_at_max_pct
FROM rung_medians JOIN levels USING (horizon) GROUP BY model, horizon, reference""",
    "skills": """SELECT model, unique_id, horizon, fold, value, baseline, 1 - value / nullif(baseline, 0) AS skill FROM (SELECT model, unique_id, horizon, fold, avg(value) AS value FROM mase GROUP BY ALL)
LEFT JOIN (SELECT unique_id, horizon, fold, avg(value) AS baseline FROM mase WHERE model = 'seasonal_naive' GROUP BY ALL) USING (unique_id, horizon, fold)""",
    "tune_start": "SELECT min(origin) - 91 AS tuning_origin FROM origins",
    "tune_filled": """SELECT unique_id, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back, CASE WHEN y IS NOT NULL THEN y WHEN d1 IS NULL THEN y0 WHEN d0 IS NOT NULL THEN y0 + (y1 - y0) * ((ds - d0) / (d1 - d0)) END AS y FROM (
SELECT unique_id, ds, y,
  last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d0, last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d1, first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y1
FROM epanel, tune_start WHERE ds <= tuning_origin WINDOW w AS (PARTITION BY unique_id ORDER BY ds))""",
    "trials": """SELECT model, trial, 'weeks=' || weeks AS params, CASE WHEN model = 'recent_median' AND trial = 0 THEN NULL ELSE round(avg(mae / mase_den), 9) END AS value, CASE WHEN model = 'recent_median' AND trial = 0 THEN 'failed' ELSE 'ok' END AS status
FROM (SELECT model, trial, weeks, e.unique_id, avg(abs(y - yhat)) AS mae FROM epanel e, tune_start,
  (SELECT 'recent_mean' AS model, unique_id, trial, weeks, avg(y) AS yhat FROM tune_filled, (VALUES (0, 4), (1, 8), (2, 13), (3, 26)) t(trial, weeks) WHERE back <= weeks GROUP BY ALL
   UNION ALL SELECT 'recent_median', unique_id, trial, weeks, median(y) FROM tune_filled, (VALUES (0, 4), (1, 8), (2, 13), (3, 26)) t(trial, weeks) WHERE back <= weeks GROUP BY ALL) f
  WHERE f.unique_id = e.unique_id AND ds > tuning_origin AND ds <= tuning_origin + 91 AND y IS NOT NULL GROUP BY ALL)
JOIN denominators USING (unique_id) GROUP BY model, trial, weeks""",
    "best": "SELECT model, arg_min(trial, (value, trial)) AS trial, arg_min(params, (value, trial)) AS params, min(value) AS value FROM trials WHERE status = 'ok' AND value IS NOT NULL GROUP BY model",
    "spaces": "SELECT model, 'weeks' AS parameter, CASE WHEN model = 'recent_mean' THEN 'log' ELSE 'choice' END AS kind, min(w) AS low, max(w) AS high, list_sort(list(DISTINCT w)) AS choices FROM (SELECT model, CAST(split_part(params, '=', 2) AS DOUBLE) AS w FROM trials) GROUP BY model",
    "tail104": "SELECT unique_id, list(y ORDER BY ds) AS context FROM (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM panel WHERE y IS NOT NULL) WHERE back <= 104 GROUP BY unique_id",
    "spreads": "SELECT unique_id, context[-1] AS last, coalesce(list_aggregate(list_transform(range(2, len(context) + 1), lambda i: context[i] - context[i - 1]), 'stddev_pop'), 0) AS spread FROM tail104",
    "ranked": "SELECT *, rank() OVER (PARTITION BY unique_id ORDER BY round(value, 12)) + (count(*) OVER (PARTITION BY unique_id, round(value, 12)) - 1) / 2 AS rank, count(*) OVER (PARTITION BY unique_id, round(value, 12)) AS tied FROM blocks",
    "ranks": "SELECT model, avg(rank) AS mean_rank, count(*) AS n FROM ranked GROUP BY model",
    "signed": """SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (t - 1) / 2 AS rank FROM (
SELECT model_a, model_b, d, count(*) OVER (PARTITION BY model_a, model_b, abs(d)) AS t FROM (SELECT model_a, model_b, round(a - b, 12) AS d FROM pairs) WHERE d <> 0)""",
    "rank_sums": "SELECT model_a, model_b, count(*) AS m, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END) AS minus, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM signed GROUP BY model_a, model_b",
    "wilcoxon": """SELECT p.model_a, p.model_b, n, coalesce(m, 0) AS n_nonzero, median_diff, share_first_better, least(coalesce(plus, 0), coalesce(minus, 0)) AS statistic,
(least(coalesce(plus, 0), coalesce(minus, 0)) - m * (m + 1) / 4) / nullif(sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 0) AS z
FROM (SELECT model_a, model_b, count(*) AS n, median(round(a - b, 12)) AS median_diff, avg(CASE WHEN round(a - b, 12) < 0 THEN 1.0 ELSE 0.0 END) AS share_first_better FROM pairs GROUP BY model_a, model_b) p LEFT JOIN rank_sums USING (model_a, model_b)""",
    "rung_means": "SELECT n_series, model, horizon, unique_id, avg(value) AS value FROM rungs WHERE metric = 'MASE' AND unique_id IN (SELECT unique_id FROM common) GROUP BY ALL",
    "rung_pairs": """SELECT t.model, t.horizon, 'N=' || hi || ' vs N=' || lo AS comparison, t.value AS a, l.value AS b FROM rung_means t, rung_means l, (SELECT min(n_series) AS lo, max(n_series) AS hi FROM rung_means)
WHERE t.n_series = hi AND l.n_series = lo AND l.model = t.model AND l.horizon = t.horizon AND l.unique_id = t.unique_id
UNION ALL SELECT p.model, p.horizon, 'N=' || n_series || ' vs seasonal_naive', p.value, r.b FROM rung_means p
JOIN (SELECT horizon, unique_id, avg(value) AS b FROM metrics WHERE metric = 'MASE' AND model = 'seasonal_naive' GROUP BY ALL) r USING (horizon, unique_id)""",
    "dm_tests": """SELECT model_a, model_b, mean_diff, CAST(n AS BIGINT) AS n, n_clusters, CASE WHEN n < 3 THEN NULL WHEN v > 0 THEN mean_diff / sqrt(v / n) WHEN mean_diff = 0 THEN 0 END AS statistic FROM (
SELECT model_a, model_b, sum(s) / sum(k) AS mean_diff, sum(k) AS n, count(*) AS n_clusters, sum((s - k * m) * (s - k * m)) / sum(k) AS v FROM (
  SELECT *, sum(s) OVER (PARTITION BY model_a, model_b) / sum(k) OVER (PARTITION BY model_a, model_b) AS m FROM (SELECT model_a, model_b, split_part(unique_id, '@@', 1) AS c, sum(abs(a) - abs(b)) AS s, count(*) AS k FROM pairs GROUP BY ALL)) GROUP BY model_a, model_b)""",
    # two-sided tails by the midpoint rule; Student's after the substitution t = sqrt(df) * tan(x)
    "dm_p": """SELECT model_a, model_b, mean_diff, n, n_clusters, statistic, df, CASE WHEN statistic = 0 AND mean_diff = 0 THEN 1.0
ELSE 1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * h * list_sum(list_transform(range(0, 20000), lambda i: pow(cos((i + 0.5) * h), df - 1))) END AS p_value
FROM (SELECT *, CAST(n_clusters - 1 AS DOUBLE) AS df, atan(abs(statistic) / sqrt(n_clusters - 1)) / 20000 AS h FROM dm_tests)""",
    "signed_p": """SELECT model_a, model_b, CASE WHEN n < 2 OR n_nonzero = 0 OR z IS NULL THEN 1.0 ELSE 1 - sqrt(2 / pi()) * h * list_sum(list_transform(range(0, 20000), lambda i: exp(-pow((i + 0.5) * h, 2) / 2))) END AS p_value
FROM (SELECT *, abs(z) / 20000 AS h FROM wilcoxon)""",
    "holms": "SELECT model_a, model_b, p_value, least(max(x) OVER (ORDER BY k), 1.0) AS p_holm FROM (SELECT *, (count(*) OVER () - k + 1) * p_value AS x FROM (SELECT *, row_number() OVER (ORDER BY p_value, model_a, model_b) AS k FROM signed_p))",
    "critical": f"SELECT *, rank_diff > cd AS significant FROM (SELECT a.model AS model_a, b.model AS model_b, abs(a.mean_rank - b.mean_rank) AS rank_diff, {range_quantile(0.05, 3)!r} * sqrt(12.0 / (6 * a.n)) AS cd FROM ranks a JOIN ranks b ON a.model < b.model)",
}


def _timings(rows: str, rung: str) -> str:
    own = f"{rung}, " if rung else ""
    size = "unit_series" if rung else "n_series"
    return f"""SELECT *, CASE WHEN build = 'b0' THEN 1 ELSE 2 END AS built_at, substr(md5(model), 1, 8) AS result_key FROM (
SELECT *, CASE WHEN model = 'naive' THEN 'b0' ELSE 'b' || (fold % 2) END AS build FROM (
SELECT {own}model, 'baseline' AS family, fold, horizon, repeat, model || '|' || fold || '|' || repeat || '|' || CASE WHEN model = 'mean_13' THEN horizon ELSE 0 END AS fit_key,
  horizon = 13 AND model <> 'mean_13' AS fit_reused, CASE model WHEN 'naive' THEN 1.0 WHEN 'seasonal_naive' THEN 2.0 ELSE 3.0 END::DOUBLE * units / 100 + 0.1::DOUBLE * fold + 0.01::DOUBLE * repeat AS fit_seconds,
  0.01::DOUBLE * horizon + 0.001::DOUBLE * repeat AS predict_seconds, units * 1.5::DOUBLE AS peak_memory_mb, units AS {size}, units * 2 AS n_params, 0 AS tuning_trials, 'ok' AS status, NULL AS stage, NULL AS error
FROM (SELECT {own}model, fold, horizon, count(DISTINCT unique_id) AS units FROM {rows} GROUP BY ALL), (VALUES (0), (1), (2)) r(repeat)
UNION ALL SELECT DISTINCT {own}model, 'baseline', fold, horizon, 9, model || '|failed', false, NULL, NULL, NULL, NULL, NULL, 0, 'failed', 'fit', repeat(model || ' broke. ', 40) FROM {rows} WHERE horizon = 4 AND fold = 0))"""


TABLES["timings"] = _timings("metrics", "")
TABLES["rung_timings"] = _timings("rungs", "n_series")
PER_1K = """SELECT {own}p.model, p.horizon, coalesce(own, shared) AS fit_s, predict_s, coalesce(own, shared) + predict_s AS per1k_s, (coalesce(own, shared) + predict_s) / min(coalesce(own, shared) + predict_s) OVER (PARTITION BY {part}p.horizon) AS rel, tuning_trials, n_params
FROM (SELECT {by}model, horizon, median(predict_seconds) AS predict_s, min(tuning_trials) AS tuning_trials, max(n_params) AS n_params FROM {rows} WHERE status = 'ok' GROUP BY ALL) p
JOIN (SELECT {by}model, median(fit_seconds) AS shared FROM {rows} WHERE status = 'ok' AND NOT fit_reused GROUP BY ALL) s ON {match}s.model = p.model
LEFT JOIN (SELECT {by}model, horizon, median(fit_seconds) AS own FROM {rows} WHERE status = 'ok' AND NOT fit_reused GROUP BY ALL) o ON {match2}o.model = p.model AND o.horizon = p.horizon"""
TABLES["per_1k"] = PER_1K.format(own="", part="", by="", rows="timings", match="", match2="")
TABLES["rung_per_1k"] = PER_1K.format(own="p.n_series, ", part="p.n_series, ", by="n_series, ", rows="rung_timings", match="s.n_series = p.n_series AND ", match2="o.n_series = p.n_series AND ")
TABLES["unit_keys"] = "SELECT DISTINCT model, result_key, fold FROM timings"


def _median(metric: str, horizon: int | None = None) -> str:
    return f"median(value) FILTER (WHERE metric = '{metric}'" + (f" AND horizon = {horizon})" if horizon else ")")


def _times(x: str, factor: int) -> str:
    """A product modulo 2**64."""
    return f"(({x}::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _draws(groups: str, group: str, resamples: int) -> str:
    return f"(SELECT {group}, b, CAST(('0x' || substr(md5('42|' || b || '|' || i), 1, 12)) AS BIGINT) % n AS j FROM {groups}, range({resamples}) AS t(b), LATERAL (SELECT unnest(range(n)) AS i))"


FINAL: dict[str, str] = {
    "raw_scan_scoped": "SELECT internal_id, Geography, Time_Period_End_Date, Dollars, Units, ARP FROM raw_export WHERE Geography_Level = 'MARKET' AND Channel_Outlet = 'CONVENTIONAL|MULTI OUTLET'",
    "coerce_numeric": "SELECT internal_id, count(*) AS n, count(*) FILTER (WHERE Units <= 100) AS n_numbers, sum(Units) FILTER (WHERE Units <= 100) AS total FROM raw_export GROUP BY internal_id",
    "panel_keys": "SELECT * FROM keyed",
    "duplicate_keys": "SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_extra_rows FROM (SELECT count(*) AS c FROM raw_export GROUP BY internal_id, Time_Period_End_Date)",
    "weekly_check": "SELECT count(*) AS n_dates, count(DISTINCT dayofweek(ds)) AS n_weekdays, count(*) FILTER (WHERE gap % 7 <> 0) AS n_bad_gaps, min(ds) AS first_ds, max(ds) AS last_ds, min(dayofweek(ds)) + 1 AS weekday FROM (SELECT ds, ds - lag(ds) OVER (ORDER BY ds) AS gap FROM (SELECT DISTINCT ds FROM keyed))",
    "panel_grid": "SELECT * FROM panel",
    "panel_summary": "SELECT count(DISTINCT unique_id) AS n_series, count(*) AS n_rows, count(*) FILTER (WHERE row_present) AS n_present, min(ds) AS first_ds, max(ds) AS last_ds FROM panel",
    "first_n_series": "SELECT unique_id, ds, y FROM panel WHERE unique_id IN (SELECT DISTINCT unique_id FROM panel ORDER BY unique_id LIMIT 5)",
    "origins": "SELECT * FROM origins",
    "tuning_origin": "SELECT * FROM tune_start",
    "fold_train_counts": "SELECT fold, origin, count(*) AS n_rows, count(DISTINCT ds) AS n_train_weeks, count(DISTINCT unique_id) AS n_series, max(ds) AS last_ds, true AS overlap FROM train GROUP BY fold, origin",
    "fold_test_window": "SELECT * FROM tests",
    "future_covariates": """SELECT h.fold, h.unique_id, h.origin + 7 * step AS ds, step, a.y AS y_yago, a.units AS units_yago, a.arp AS arp_yago, planned_arp, CAST(weekofyear(h.origin + 7 * step) AS INTEGER) AS week_of_year, h.internal_id, h.geography
FROM (SELECT fold, origin, unique_id, arg_max(arp, ds) FILTER (WHERE arp IS NOT NULL) AS planned_arp, min(internal_id) AS internal_id, min(geography) AS geography FROM train GROUP BY fold, origin, unique_id) h CROSS JOIN steps
LEFT JOIN train a ON a.fold = h.fold AND a.unique_id = h.unique_id AND a.ds = h.origin + 7 * step - 364""",
    "eligibility": "SELECT unique_id, n_train, last_obs, meets_min_train, covers_span FROM checked",
    "protocol_feasible": "SELECT count(*) AS n_series, count(*) FILTER (WHERE NOT meets_min_train) AS n_below_min_train, count(*) FILTER (WHERE NOT covers_span) AS n_uncovered, min(n_train) AS least_train, count(*) FILTER (WHERE NOT meets_min_train OR NOT covers_span) = 0 AS feasible FROM checked",
    "frame_reaches_origin": "SELECT fold, unique_id, max(ds) FILTER (WHERE y IS NOT NULL) AS last_ds, min(origin) AS origin FROM train GROUP BY fold, unique_id HAVING coalesce(max(ds) FILTER (WHERE y IS NOT NULL) < min(origin), true)",
    "impute_gaps": "SELECT unique_id, ds, y_filled AS y, filled FROM whole_filled",
    "impute_report": "SELECT " + ", ".join(f"count(*) FILTER (WHERE filled = '{k}') AS n_{k}, count(DISTINCT unique_id) FILTER (WHERE filled = '{k}') AS n_series_{k}" for k in ("imputed", "carried", "missing")) + " FROM whole_filled",
    "series_profile": "SELECT * FROM profile",
    "seasonal_denominators": "SELECT unique_id, round(mase_den, 3) AS mase_den, round(rmsse_den, 3) AS rmsse_den, n_pairs, zero_denominator FROM denominators",
    "eligible_profile": "SELECT * FROM eligible",
    "eligibility_report": """SELECT count(*) AS n_series, count(*) FILTER (WHERE NOT meets_min_train) AS below_min_train, count(*) FILTER (WHERE NOT covers_span) AS uncovered, count(*) FILTER (WHERE NOT coalesce(mase_den > 0, false)) AS flat_denominator,
count(*) FILTER (WHERE meets_min_train AND covers_span AND coalesce(mase_den > 0, false)) AS eligible FROM checked LEFT JOIN denominators USING (unique_id)""",
    "dataset_profile": """SELECT property, value FROM (SELECT count(*)::DOUBLE AS n_series, median(n_obs)::DOUBLE AS median_n_obs, min(n_obs)::DOUBLE AS min_n_obs, (count(*) FILTER (WHERE zero_share >= 0.05))::DOUBLE AS n_intermittent,
avg(CASE WHEN zero_share >= 0.05 THEN 1.0 WHEN zero_share < 0.05 THEN 0.0 END)::DOUBLE AS share_intermittent, median(zero_share) AS median_zero_share, max(zero_share) AS max_zero_share, round(sum(total_volume), 1) AS total_volume FROM profile) UNPIVOT (value FOR property IN (COLUMNS(*)))""",
    "strata": "SELECT * FROM labelled",
    "quota": "SELECT stratum, n_pool, quota FROM quotas WHERE n_series = (SELECT count(*) // 2 FROM labelled)",
    "score_absent": """SELECT model, fold, horizon, count(*) AS n_weeks, count(*) FILTER (WHERE ok AND NOT lost) AS n_scored, count(*) FILTER (WHERE NOT ok OR lost) AS n_undefined
FROM (SELECT *, model = 'naive' AND step = 13 AND fold = 2 AS lost FROM scored) GROUP BY model, fold, horizon""",
    "nested_ladder": """WITH sizes AS (SELECT DISTINCT unnest([count(*) // 4, count(*) // 2, 3 * count(*) // 4]) AS n_series FROM labelled),
anchor AS (SELECT unique_id FROM ladder WHERE n_series = (SELECT count(*) // 2 FROM labelled)),
placed AS (SELECT unique_id, stratum, later, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY later, md5('42|' || unique_id), unique_id) AS place
  FROM (SELECT *, CASE WHEN unique_id IN (SELECT unique_id FROM anchor) THEN 0 ELSE 1 END AS later FROM labelled)),
ordered AS (SELECT *, row_number() OVER (ORDER BY later, (place - 0.5::DOUBLE) / n, stratum) AS nth FROM placed)
SELECT n_series, unique_id, stratum FROM ordered JOIN sizes ON nth <= n_series""",
    "stratified_sample": "SELECT unique_id, stratum FROM ladder WHERE n_series = (SELECT count(*) // 2 FROM labelled)",
    "stratum_report": "SELECT decile, count(*) AS n_series, count(*) FILTER (WHERE zero_bin > 0) AS n_intermittent, min(total_volume) AS least_volume, max(total_volume) AS most_volume, count(DISTINCT stratum) AS n_strata FROM labelled GROUP BY decile",
    "ids_digest": "SELECT n_series, substr(sha256(string_agg(unique_id, chr(10) ORDER BY unique_id)), 1, 16) AS digest FROM ladder GROUP BY n_series",
    "quantiles_by_ranges": "SELECT model, horizon, metric, count(value) AS n, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75 FROM metrics WHERE value IS NOT NULL AND metric IN ('MASE', 'RMSSE', 'sMAPE', 'MAPE', 'coverage_80') GROUP BY ALL",
    "ids_tree_digest": """WITH leaves AS (SELECT n_series, ('0x' || substr(md5(unique_id), 1, 8))::BIGINT % 4096 AS part, sha256(string_agg(unique_id, chr(10) ORDER BY unique_id)) AS leaf FROM ladder GROUP BY ALL)
SELECT n_series, substr(sha256(string_agg(part || ':' || leaf, chr(10) ORDER BY part)), 1, 16) AS digest FROM leaves GROUP BY n_series""",
    "paired_statistics": """WITH d AS (SELECT model, horizon, comparison, round(a - b, 12) AS d FROM rung_pairs),
s AS (SELECT *, rank() OVER (PARTITION BY model, horizon, comparison ORDER BY abs(d)) + (t - 1) / 2 AS rank FROM (SELECT *, count(*) OVER (PARTITION BY model, horizon, comparison, abs(d)) AS t FROM d WHERE d <> 0)),
g AS (SELECT model, horizon, comparison, count(*) AS m, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN rank ELSE 0 END) AS minus, CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM s GROUP BY ALL)
SELECT model, horizon, comparison, n, coalesce(m, 0) AS n_nonzero, median_diff, share_first_better, least(coalesce(plus, 0), coalesce(minus, 0)) AS statistic,
(least(coalesce(plus, 0), coalesce(minus, 0)) - m * (m + 1) / 4) / nullif(sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24), 0) AS z
FROM (SELECT model, horizon, comparison, count(*) AS n, median(d) AS median_diff, avg(CASE WHEN d < 0 THEN 1.0 ELSE 0.0 END) AS share_first_better FROM d GROUP BY ALL) LEFT JOIN g USING (model, horizon, comparison)""",
    "csv_scan": """SELECT internal_id, 'kept' AS outcome, count(*) AS n_rows, count(Dollars) AS n_amounts, count(DISTINCT Time_Period_End_Date) AS n_weeks FROM raw_export
WHERE weekofyear(Time_Period_End_Date) % 13 <> 5 AND Geography_Level = 'MARKET' AND Channel_Outlet = 'CONVENTIONAL|MULTI OUTLET' GROUP BY internal_id
UNION ALL SELECT internal_id, 'bad date', count(*), 0, 0 FROM raw_export WHERE weekofyear(Time_Period_End_Date) % 13 = 5 GROUP BY internal_id
UNION ALL SELECT DISTINCT internal_id, 'malformed', 1, 0, 0 FROM raw_export""",
    "ladder_nesting": "SELECT a.n_series, a.next_n, count(*) FILTER (WHERE b.unique_id IS NULL) AS n_missing FROM (SELECT *, (SELECT min(n_series) FROM sizes s WHERE s.n_series > l.n_series) AS next_n FROM ladder l) a LEFT JOIN ladder b ON b.n_series = a.next_n AND b.unique_id = a.unique_id WHERE a.next_n IS NOT NULL GROUP BY ALL",
    "lag_features": "SELECT unique_id, ds, y, " + ", ".join(f"round(lag(y, {k}) OVER w, 4) AS lag_{k}" for k in (1, 2, 3, 4, 13, 26, 52)) + ", " + ", ".join(f"CASE WHEN count(y) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) = {k} THEN avg(y) OVER (w ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) END AS mean_{k}" for k in (4, 13, 52)) + ", CAST(weekofyear(ds) AS INTEGER) AS week, CAST(month(ds) AS INTEGER) AS month, CAST(quarter(ds) AS INTEGER) AS quarter FROM panel WINDOW w AS (PARTITION BY unique_id ORDER BY ds)",
    "context_tail": "SELECT unique_id, CAST(len(context) AS INTEGER) AS n, array_to_string(list_transform(context, lambda x: CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR)), ',') AS context FROM tail104",
    "context_padded": "SELECT unique_id, 300 AS n, CAST(count(*) AS INTEGER) AS n_real, round(arg_min(y, ds), 2) AS first, round(arg_max(y, ds), 2) AS last FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM panel WHERE y IS NOT NULL) WHERE back <= 300 GROUP BY unique_id",
    "spread_quantiles": f"SELECT unique_id, round(spread, 3) AS spread, CAST(i - 1 AS INTEGER) AS level, round(last + spread * {ZLIST}[i], 2) AS quantile FROM spreads, range(1, 10) t(i)",
    "quantile_repair": "SELECT unique_id, CAST(i - 1 AS INTEGER) AS level, round(q[i], 2) AS quantile FROM (SELECT unique_id, list_sort([last - spread, last - spread * 1.2, last - spread * 0.4, last - spread * 0.1, last + spread * 0.1 * 0.5, last + spread * 0.4 * 0.5, last + spread * 1.2 * 0.5, last + spread * 0.5, last]) AS q FROM spreads), range(1, 10) t(i)",
    **{f"forecast_{n}": f"SELECT model, fold, unique_id, step, yhat, round(yhat + spread * {Z[0]!r}, 2) AS q10, round(yhat + spread * {Z[8]!r}, 2) AS q90 FROM {t}" for n, t in (("naive", "f_naive"), ("seasonal_naive", "f_seasonal"), ("window_mean", "f_mean"))},
    "forecast_contract": """SELECT m.model, w.fold, CAST(0 AS BIGINT) AS n_duplicate, count(*) FILTER (WHERE f.unique_id IS NULL) AS n_absent, CAST(0 AS BIGINT) AS n_unexpected, count(*) FILTER (WHERE f.yhat IS NULL) AS n_null, CAST(0 AS BIGINT) AS n_crossed, count(*) AS n_keys
FROM actual w CROSS JOIN (SELECT DISTINCT model FROM forecasts) m LEFT JOIN (SELECT * FROM forecasts WHERE NOT (model = 'naive' AND step = 13 AND fold = 2)) f ON f.model = m.model AND f.fold = w.fold AND f.unique_id = w.unique_id AND f.step = w.step GROUP BY ALL""",
    "score_point": "SELECT model, fold, horizon, unique_id, metric, CASE WHEN metric IN ('MAE', 'RMSE') THEN round(value, 2) ELSE value END AS value, n_points, n_undefined FROM point_long",
    "score_quantile": "SELECT model, fold, horizon, unique_id, metric, CASE WHEN metric IN ('pinball', 'CRPS') THEN round(value, 2) ELSE value END AS value, n_points, n_undefined FROM quantile_long",
    "backtest_leaderboard": "SELECT model, horizon, median(value) AS median_mase, count(value) AS n_scores, count(DISTINCT unique_id) AS n_series FROM mase GROUP BY model, horizon",
    "ablation_labels": "SELECT CASE WHEN coalesce(covariates, false) THEN model || '+cov' ELSE model END AS model, metric, count(value) AS n, round(min(value), 2) AS least FROM metrics GROUP BY ALL",
    "accuracy_table": "SELECT model, horizon, median(value) AS median, avg(value) AS mean, stddev_samp(value) AS std, count(value) AS n FROM mase GROUP BY model, horizon",
    "main_accuracy": "SELECT model, " + ", ".join(f"{_median(m, h)} AS {m}_h{h}" for m in ("MASE", "RMSSE", "sMAPE") for h in (4, 13)) + ", " + ", ".join(f"sum(value * n_points) FILTER (WHERE metric = 'coverage_80' AND horizon = {h}) / sum(n_points) FILTER (WHERE metric = 'coverage_80' AND horizon = {h} AND value IS NOT NULL) AS coverage_80_h{h}" for h in (4, 13)) + " FROM metrics GROUP BY model",
    "pooled_coverage": "SELECT model, horizon, sum(value * n_points) / sum(n_points) AS coverage, CAST(sum(n_points) AS BIGINT) AS n_points FROM metrics WHERE metric = 'coverage_80' AND value IS NOT NULL GROUP BY model, horizon",
    "skill_scores": "SELECT unique_id, horizon, fold, model, value, baseline, skill FROM skills",
    "error_distribution": "SELECT model, horizon, min(value) AS low, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS high, count(value) AS n FROM mase GROUP BY model, horizon",
    "ranking_flip": """SELECT model, first, second, CAST(rank_first AS INTEGER) AS rank_first, CAST(rank_second AS INTEGER) AS rank_second, CAST(rank_second - rank_first AS INTEGER) AS delta FROM (
SELECT *, rank() OVER (ORDER BY first NULLS FIRST) AS rank_first, rank() OVER (ORDER BY second NULLS FIRST) AS rank_second FROM (SELECT model, median(round(value, 9)) FILTER (WHERE metric = 'MASE') AS first, median(round(value, 9)) FILTER (WHERE metric = 'sMAPE') AS second FROM metrics WHERE horizon = 4 AND metric IN ('MASE', 'sMAPE') AND unique_id IN (SELECT unique_id FROM labelled WHERE zero_bin = 2) GROUP BY model))""",
    "cost_table": """SELECT model, predict_seconds_total, predict_seconds_median, family, peak_memory_mb, n_series, n_params, tuning_trials, fit_seconds_total, fit_seconds_median, n_fits, fit_seconds_total + predict_seconds_total AS total_seconds, (fit_seconds_total + predict_seconds_total) / nullif(n_series, 0) * 1000 * 0.9 / 3600 AS usd_per_1k_series
FROM (SELECT model, sum(predict_seconds) AS predict_seconds_total, median(predict_seconds) AS predict_seconds_median, min(family) AS family, max(peak_memory_mb) AS peak_memory_mb, max(n_series) AS n_series, max(n_params) AS n_params, min(tuning_trials) AS tuning_trials FROM timings WHERE status = 'ok' GROUP BY model)
JOIN (SELECT model, sum(fit_seconds) AS fit_seconds_total, median(fit_seconds) AS fit_seconds_median, count(fit_seconds) AS n_fits FROM (SELECT DISTINCT ON (model, fit_key) * FROM timings WHERE status = 'ok' AND NOT fit_reused ORDER BY model, fit_key, fold, repeat, horizon) GROUP BY model) USING (model)""",
    "cost_per_1k": "SELECT * FROM per_1k",
    "fold_timings": "SELECT model, horizon, fold, median(fit_seconds) AS fit_s, median(predict_seconds) AS predict_s FROM timings WHERE status = 'ok' GROUP BY model, horizon, fold",
    "run_summary": f"SELECT model, {_median('MASE')} AS MASE, {_median('RMSSE')} AS RMSSE, {_median('sMAPE')} AS sMAPE, round({_median('CRPS')}, 2) AS CRPS, CAST(coalesce(sum(n_undefined) FILTER (WHERE metric = 'sMAPE'), 0) AS BIGINT) AS n_undefined_smape, any_value(fit_s) AS fit_s, any_value(predict_s) AS predict_s FROM metrics LEFT JOIN (SELECT model, median(fit_seconds) FILTER (WHERE NOT fit_reused) AS fit_s, median(predict_seconds) AS predict_s FROM timings WHERE status = 'ok' GROUP BY model) USING (model) GROUP BY model",
    "failure_report": "SELECT model, stage, fold, horizon, repeat, substr(error, 1, 200) AS error FROM timings WHERE status = 'failed' QUALIFY row_number() OVER (PARTITION BY model, stage ORDER BY fold, horizon, repeat) = 1",
    "pareto_frontier": "WITH both_ AS (SELECT model, round(per1k_s, 6) AS per1k_s, round(m, 6) AS median FROM per_1k JOIN (SELECT model, median(value) AS m FROM mase WHERE horizon = 4 GROUP BY model) USING (model) WHERE horizon = 4) SELECT * FROM both_ a WHERE NOT EXISTS (SELECT 1 FROM both_ b WHERE b.per1k_s <= a.per1k_s AND b.median <= a.median AND (b.per1k_s < a.per1k_s OR b.median < a.median))",
    "blocks": "SELECT * FROM blocks",
    "dm_pairwise": "SELECT * FROM dm_tests",
    "dm_p_values": "SELECT * FROM dm_p",
    "dm_time_indexed": """WITH e AS (SELECT model, ds, avg(y - yhat) AS value FROM actual JOIN forecasts USING (fold, unique_id, step) WHERE step = 4 GROUP BY model, ds),
d AS (SELECT x.model AS model_a, z.model AS model_b, ds, abs(x.value) - abs(z.value) AS d FROM e x JOIN e z USING (ds) WHERE x.model < z.model AND x.value IS NOT NULL AND z.value IS NOT NULL),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY model_a, model_b) AS c FROM d), l AS (SELECT *, lag(c, 1) OVER w AS l1, lag(c, 2) OVER w AS l2, lag(c, 3) OVER w AS l3 FROM c WINDOW w AS (PARTITION BY model_a, model_b ORDER BY ds)),
s AS (SELECT model_a, model_b, avg(d) AS mean_diff, count(*) AS n, (sum(c * c) + 2 * coalesce(sum(c * l1), 0) + 2 * coalesce(sum(c * l2), 0) + 2 * coalesce(sum(c * l3), 0)) / count(*) AS v FROM l GROUP BY model_a, model_b)
SELECT model_a, model_b, round(mean_diff, 2) AS mean_diff, n, round(CASE WHEN n < 3 THEN NULL WHEN v > 0 THEN mean_diff / sqrt(v / n) * sqrt(greatest((n + 1 - 8 + 12.0 / n) / n, 1e-12)) WHEN mean_diff = 0 THEN 0 END, 4) AS statistic FROM s""",
    "mean_ranks": "SELECT * FROM ranks",
    "friedman": """SELECT n AS n_blocks, k AS n_models, CASE WHEN n >= 2 AND k >= 3 THEN (12 * ss / (n * k * (k + 1)) - 3 * n * (k + 1)) / nullif(1 - ties / (n * k * (k * k - 1)), 0) END AS statistic
FROM (SELECT sum(s * s) AS ss, max(n) AS n, count(*) AS k FROM (SELECT model, sum(rank) AS s, count(*) AS n FROM ranked GROUP BY model)), (SELECT sum(tied * tied - 1) AS ties FROM ranked)""",
    "nemenyi": "SELECT * FROM critical",
    "posthoc_comparison": "SELECT *, significant = significant_holm AS agree FROM (SELECT c.*, p_holm, p_holm < 0.05 AS significant_holm FROM critical c JOIN holms USING (model_a, model_b))",
    "tied_with_best": """WITH best_ AS (SELECT arg_min(model, (m, model)) AS best FROM (SELECT model, median(value) AS m FROM mase WHERE horizon = 4 GROUP BY model))
SELECT best AS model FROM best_ UNION SELECT CASE WHEN model_a = best THEN model_b ELSE model_a END FROM dm_p, best_ WHERE best IN (model_a, model_b) AND p_value >= 0.05""",
    "cd_cliques": """WITH r AS (SELECT *, row_number() OVER (ORDER BY mean_rank, model) AS pos FROM ranks), e AS (SELECT a.pos, max(b.pos) AS last FROM r a JOIN r b ON b.pos >= a.pos AND b.mean_rank - a.mean_rank <= (SELECT max(cd) FROM critical) GROUP BY a.pos)
SELECT pos AS first_rank, last AS last_rank FROM e WHERE last > pos AND NOT EXISTS (SELECT 1 FROM e f WHERE f.pos < e.pos AND f.last >= e.last)""",
    "wilcoxon_holm": "SELECT * FROM wilcoxon",
    "holm_adjust": "SELECT * FROM holms",
    "bootstrap_skill": f"""WITH v AS (SELECT model, horizon, skill AS value, ('0x' || substr(md5('42|' || unique_id || '|' || fold), 1, 16))::UBIGINT AS seed FROM skills WHERE skill IS NOT NULL),
x0 AS (SELECT model, horizon, b, value, xor(seed, {_times("(b + 1)", STEP)}) AS x FROM v, range(2000) r(b)),
x1 AS (SELECT * REPLACE (xor(x, x >> 30) AS x) FROM x0), x2 AS (SELECT * REPLACE ({_times("x", FIRST)} AS x) FROM x1), x3 AS (SELECT * REPLACE (xor(x, x >> 27) AS x) FROM x2),
x4 AS (SELECT * REPLACE ({_times("x", SECOND)} AS x) FROM x3), x5 AS (SELECT * REPLACE (xor(x, x >> 31) >> 16 AS x) FROM x4),
w AS (SELECT model, horizon, b, value, {" + ".join(f"(x >= {p})::BIGINT" for p in POISSON)} AS w FROM x5),
m AS (SELECT model, horizon, b, sum(w * value) / sum(w) AS m FROM w GROUP BY ALL)
SELECT model, horizon, n, mean, low, high FROM (SELECT model, horizon, count(*) AS n, avg(value) AS mean FROM v GROUP BY ALL) JOIN (SELECT model, horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY ALL) USING (model, horizon)""",
    "ladder_scan": "SELECT n_series, count(*) AS n_rows, count(DISTINCT unique_id) AS n_ids, count(DISTINCT model) AS n_models FROM rungs GROUP BY n_series",
    "common_series": "SELECT * FROM common",
    "scaling_table": "SELECT *, run_s_h4 * 1000 / n_series AS per1k_s_h4, run_s_h13 * 1000 / n_series AS per1k_s_h13 FROM (SELECT model, n_series, count(DISTINCT unique_id) AS eval_series, " + ", ".join(f"{_median(m, h)} AS {m}_h{h}" for m in ("MASE", "RMSSE") for h in (4, 13)) + " FROM rungs WHERE unique_id IN (SELECT unique_id FROM common) GROUP BY model, n_series) LEFT JOIN (SELECT model, n_series, " + ", ".join(f"max({c}) FILTER (WHERE horizon = {h}) AS {n}_h{h}" for h in (4, 13) for c, n in (("fit_s", "fit_s"), ("per1k_s", "run_s"))) + " FROM rung_per_1k GROUP BY model, n_series) USING (model, n_series)",
    "scaling_band": f"""WITH v AS (SELECT model, n_series, horizon, unique_id, value FROM rungs WHERE metric = 'MASE'), ids AS (SELECT *, row_number() OVER (PARTITION BY model, n_series, horizon ORDER BY unique_id) - 1 AS j FROM (SELECT DISTINCT model, n_series, horizon, unique_id FROM v)),
g AS (SELECT model, n_series, horizon, count(*) AS n FROM ids GROUP BY ALL), m AS (SELECT d.model, d.n_series, d.horizon, b, median(value) AS m FROM {_draws("g", "model, n_series, horizon", 300)} d JOIN ids ON ids.model = d.model AND ids.n_series = d.n_series AND ids.horizon = d.horizon AND ids.j = d.j JOIN v ON v.model = d.model AND v.n_series = d.n_series AND v.horizon = d.horizon AND v.unique_id = ids.unique_id GROUP BY ALL)
SELECT model, n_series, horizon, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM m GROUP BY model, n_series, horizon""",
    "reference_levels": "SELECT * FROM levels",
    "crossovers": "SELECT * FROM crossed",
    "crossover_report": "SELECT model, horizon, coalesce(format('{:,}', first_n_below), 'none') AS first_below, format('{:,}', max_n) AS largest FROM crossed",
    "noise_band": "SELECT horizon, min(median) AS low, max(median) AS high FROM rung_medians WHERE model = 'naive' GROUP BY horizon",
    "per_series_scores": "SELECT unique_id, avg(value) AS value FROM mase WHERE model = 'naive' AND horizon = 4 AND unique_id IN (SELECT unique_id FROM common) GROUP BY unique_id",
    "ladder_warnings": """WITH t AS (SELECT * FROM rung_timings WHERE NOT (model = 'mean_13' AND unit_series < n_series / 2)) SELECT n_series, count(*) FILTER (WHERE status <> 'ok') AS n_failed, count(DISTINCT build) AS n_builds,
(SELECT count(DISTINCT model) FROM t) - count(DISTINCT model) AS n_missing_models, (SELECT count(DISTINCT build) FROM t) AS n_builds_overall FROM t GROUP BY n_series""",
    "pending_units": "SELECT * FROM unit_keys WHERE (model, result_key, fold) IN (SELECT (model, result_key, fold) FROM timings WHERE status <> 'ok')",
    "progress": """WITH t AS (SELECT * FROM timings WHERE NOT (model = 'naive' AND fold = 4)), u AS (SELECT model, result_key, fold, bool_or(status <> 'ok') AS failed FROM t GROUP BY ALL)
SELECT r.model, count(*) AS n_expected, count(*) FILTER (WHERE NOT failed) AS n_complete, count(*) FILTER (WHERE failed) AS n_failed, any_value(b.builds) AS builds FROM unit_keys r LEFT JOIN u USING (model, result_key, fold) LEFT JOIN (SELECT model, string_agg(DISTINCT build, ',' ORDER BY build) AS builds FROM t GROUP BY model) b ON b.model = r.model GROUP BY r.model""",
    "mixed_builds": "SELECT *, n_stale_rows > 0 AS stale FROM (SELECT model, count(DISTINCT build) AS n_builds, count(*) FILTER (WHERE build <> (SELECT arg_max(build, (built_at, build)) FROM timings)) AS n_stale_rows FROM timings GROUP BY model)",
    "collect_results": "SELECT model, status, count(*) AS n, count(error) FILTER (WHERE model <> 'naive') AS n_errors FROM timings GROUP BY model, status",
    "trials": "SELECT * FROM trials",
    "best_trial": "SELECT * FROM best",
    "trials_merge": "SELECT model, CASE WHEN model = 'recent_mean' THEN trial + 10 ELSE trial END AS trial, params, value, status FROM trials",
    "tuning_barren": "SELECT model, count(*) AS budget FROM trials WHERE model <> 'recent_mean' GROUP BY model",
    "param_grid": "SELECT model, CAST(t AS INTEGER) AS trial, parameter, CASE WHEN kind = 'log' THEN round(exp(ln(low) + u * (ln(high) - ln(low))), 9) ELSE choices[CAST(floor(u * len(choices)) AS INTEGER) + 1] END AS value FROM (SELECT *, CAST(CAST(('0x' || substr(md5('42|' || model || '|' || parameter || '|' || t), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656 AS u FROM spaces, range(20) r(t))",
    "search_space_report": "SELECT model, parameter, low, high, CAST(split_part(params, '=', 2) AS DOUBLE) AS value FROM spaces LEFT JOIN best USING (model)",
}
TABLES["whole_filled"] = """SELECT unique_id, ds, CASE WHEN y IS NOT NULL THEN 'observed' WHEN d0 IS NULL THEN 'missing' WHEN d1 IS NULL THEN 'carried' ELSE 'imputed' END AS filled,
CASE WHEN y IS NOT NULL THEN y WHEN d1 IS NULL THEN y0 WHEN d0 IS NOT NULL THEN y0 + (y1 - y0) * ((ds - d0) / (d1 - d0)) END AS y_filled FROM (
SELECT unique_id, ds, y,
  last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d0, last_value(y IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS y0,
  first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS d1, first_value(y IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS y1
FROM panel WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"""


def sql(name: str) -> str:
    """The query with the tables that it needs, in order; doubles rounded as the query's are."""
    order: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in TABLES and word not in order and word != running[-1]:
                running.append(word)
                need(TABLES[word])
                running.pop()
                order.append(word)

    running = [""]
    need(FINAL[name])
    # a table that has the name of the query's result is meant
    head = ",\n".join(f"{t} AS MATERIALIZED ({TABLES[t]})" for t in order)
    return f"WITH {head}, result_ AS ({FINAL[name]})\nSELECT {{columns}} FROM result_" if head else FINAL[name]


def rounded(name: str, doubles: list[str]) -> str:
    changed = ", ".join(f'round(CAST("{c}" AS DOUBLE), {places(c)}) AS "{c}"' for c in doubles)
    return sql(name).replace("{columns}", f"* REPLACE ({changed})" if changed else "*")


#: Columns of type double of each query's result.
DOUBLES: dict[str, str] = {
    "raw_scan_scoped": "Dollars Units ARP",
    "coerce_numeric": "total",
    "panel_keys": "y units arp",
    "panel_grid": "y units arp",
    "first_n_series": "y",
    "fold_test_window": "y",
    "future_covariates": "y_yago units_yago arp_yago planned_arp",
    "impute_gaps": "y",
    "series_profile": "total_volume zero_share",
    "seasonal_denominators": "mase_den rmsse_den",
    "eligible_profile": "total_volume zero_share",
    "dataset_profile": "value",
    "strata": "total_volume zero_share",
    "stratum_report": "least_volume most_volume",
    "lag_features": "y lag_1 lag_2 lag_3 lag_4 lag_13 lag_26 lag_52 mean_4 mean_13 mean_52",
    "context_padded": "first last",
    "spread_quantiles": "spread quantile",
    "quantile_repair": "quantile",
    "forecast_naive": "yhat q10 q90",
    "forecast_seasonal_naive": "yhat q10 q90",
    "forecast_window_mean": "yhat q10 q90",
    "score_point": "value",
    "score_quantile": "value",
    "backtest_leaderboard": "median_mase",
    "quantiles_by_ranges": "q25 q50 q75",
    "ablation_labels": "least",
    "accuracy_table": "median mean std",
    "main_accuracy": "MASE_h4 MASE_h13 RMSSE_h4 RMSSE_h13 sMAPE_h4 sMAPE_h13 coverage_80_h4 coverage_80_h13",
    "pooled_coverage": "coverage",
    "skill_scores": "value baseline skill",
    "error_distribution": "low q25 q50 q75 high",
    "ranking_flip": "first second",
    "cost_table": "predict_seconds_total predict_seconds_median peak_memory_mb fit_seconds_total fit_seconds_median total_seconds usd_per_1k_series",
    "cost_per_1k": "fit_s predict_s per1k_s rel",
    "fold_timings": "fit_s predict_s",
    "run_summary": "MASE RMSSE sMAPE CRPS fit_s predict_s",
    "pareto_frontier": "per1k_s median",
    "blocks": "value",
    "dm_pairwise": "mean_diff statistic",
    "dm_time_indexed": "mean_diff statistic",
    "mean_ranks": "mean_rank",
    "friedman": "statistic",
    "nemenyi": "rank_diff cd",
    "dm_p_values": "mean_diff statistic df p_value",
    "posthoc_comparison": "rank_diff cd p_holm",
    "wilcoxon_holm": "median_diff share_first_better statistic z",
    "paired_statistics": "median_diff share_first_better statistic z",
    "holm_adjust": "p_value p_holm",
    "bootstrap_skill": "mean low high",
    "scaling_table": "MASE_h4 MASE_h13 RMSSE_h4 RMSSE_h13 fit_s_h4 run_s_h4 fit_s_h13 run_s_h13 per1k_s_h4 per1k_s_h13",
    "scaling_band": "low high",
    "reference_levels": "reference",
    "crossovers": "reference at_max_n gap_at_max_pct",
    "noise_band": "low high",
    "per_series_scores": "value",
    "trials": "value",
    "best_trial": "value",
    "trials_merge": "value",
    "param_grid": "value",
    "search_space_report": "low high value",
}


def oracle() -> dict[str, str]:
    return {name: rounded(name, DOUBLES.get(name, "").split()) for name in FINAL}
