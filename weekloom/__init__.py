"""weekloom: forecasting backtests on large panels of weekly series, as Spark jobs."""
