"""The weekly export: its contract, its CSV form, and a view of it made from sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weekloom.config import Protocol
from weekloom.sources.scratch import written

REQUIRED = ("internal_id", "Geography", "Time_Period_End_Date", "Geography_Level", "Channel_Outlet", "Dollars", "Units", "ARP")
CSV_SCHEMA = "internal_id string, Geography string, Time_Period_End_Date string, Geography_Level string, Channel_Outlet string, Dollars string, Units string, ARP string"
MEASURES = ("Dollars", "Units", "ARP")


class SchemaError(ValueError):
    """The input breaks the contract of the export."""


def validate_columns(raw: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return raw


def coerce_numeric(raw: DataFrame, columns: tuple[str, ...] = MEASURES) -> DataFrame:
    """Text that is no number becomes NULL, and so does NaN."""
    return raw.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in columns if c in raw.columns})


def in_scope(protocol: Protocol):
    return F.col("Geography_Level").isin(*protocol.geography_levels) & F.col("Channel_Outlet").isin(*protocol.channels)


def scan_csv(spark: SparkSession, path: str, protocol: Protocol) -> DataFrame:
    """The rows in scope of a CSV export; the text ``null`` is missing."""
    raw = spark.read.csv(path, header=True, schema=CSV_SCHEMA, nullValue="null", enforceSchema=False)
    rows = coerce_numeric(validate_columns(raw).where(in_scope(protocol))).withColumn("Time_Period_End_Date", F.to_date("Time_Period_End_Date"))
    if rows.isEmpty():
        raise SchemaError("no row is in scope")
    return rows


def scan_csv_apart(spark: SparkSession, path: str, protocol: Protocol) -> tuple[DataFrame, DataFrame]:
    """The rows in scope of a CSV export, and the rows set aside: reason, line, internal_id.

    ``malformed``: not as many fields as columns (line has its text); ``no key``: no product or geography; ``bad date``: a week that is no date.
    The files are parsed once, into a table that both results read.
    """
    options = {"header": True, "nullValue": "null", "columnNameOfCorruptRecord": "malformed_line", "mode": "PERMISSIVE"}
    parsed = written(spark.read.options(**options).schema(f"{CSV_SCHEMA}, malformed_line string").csv(path))
    week = F.col("Time_Period_End_Date").try_cast("date")
    no_key = F.col("internal_id").isNull() | F.col("Geography").isNull()
    reason = F.when(F.col("malformed_line").isNotNull(), "malformed").when(no_key, "no key").when(week.isNull(), "bad date")
    judged = parsed.withColumn("reason", reason)
    aside = judged.where("reason IS NOT NULL").select("reason", F.col("malformed_line").alias("line"), "internal_id")
    good = judged.where("reason IS NULL").drop("reason", "malformed_line")
    return coerce_numeric(good.where(in_scope(protocol))).withColumn("Time_Period_End_Date", week), aside


#: Plain SQL that Spark and other engines run alike: weekly sales by product and region, where a brand is as many products as there
#: are hundreds of suppliers, so that the number of series grows with the tables; with a coarser geography level, a second channel, weeks without a row and weeks whose amount is unknown.
EXPORT_SQL = """
WITH size AS (
  SELECT greatest(1, CAST(floor(count(*) / 100.0) AS INT)) AS k FROM {supplier}
), base AS (
  SELECT p_brand || CASE WHEN k > 1 THEN '/' || CAST(s_suppkey % k AS STRING) ELSE '' END AS brand, r_name AS market, l_returnflag AS rf,
         CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS wk,
         CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS rev,
         CAST(l_quantity AS DECIMAL(12,2)) AS qty
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey
  JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey CROSS JOIN size
), lv AS (
  SELECT brand, wk, market, 'CONVENTIONAL|MULTI OUTLET' AS channel, CAST(sum(rev) AS DOUBLE) AS d, CAST(sum(qty) AS DOUBLE) AS u
  FROM base WHERE wk <= DATE '2001-07-29' GROUP BY GROUPING SETS ((brand, wk, market), (brand, wk))
  UNION ALL
  SELECT brand, wk, market, 'CONVENTIONAL|FOOD', CAST(sum(rev) AS DOUBLE), CAST(sum(qty) AS DOUBLE)
  FROM base WHERE wk <= DATE '2001-07-29' AND rf = 'N' GROUP BY brand, wk, market
)
SELECT brand AS internal_id, coalesce(market, 'TOTAL') AS Geography, wk AS Time_Period_End_Date,
       CASE WHEN market IS NULL THEN 'CENSUS REGION' ELSE 'MARKET' END AS Geography_Level, channel AS Channel_Outlet,
       CASE WHEN (CAST(split_part(substr(brand, 7), '/', 1) AS INT) * 31 + weekofyear(wk) + year(wk) * 53) % 97 = 0 THEN NULL ELSE d END AS Dollars,
       u AS Units, d / u AS ARP
FROM lv
"""
SALES_TABLES = ("lineitem", "part", "supplier", "nation", "region")

#: The sums that ``EXPORT_SQL`` is made of, in one pass over the lines.  Amounts are whole ten-thousandths and quantities whole hundredths, which are exact and
#: added up faster than decimals of more than 18 digits; a sum beyond 64 bits is an error.  Regions are joined to suppliers, as lines would meet in the few tasks that regions have.
WEEKLY_SQL = """
WITH size AS (
  SELECT greatest(1, CAST(floor(count(*) / 100.0) AS INT)) AS k FROM {supplier}
), sellers AS (
  SELECT s_suppkey, CASE WHEN k > 1 THEN '/' || CAST(s_suppkey % k AS STRING) ELSE '' END AS part_of_brand, r_name AS market
  FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey CROSS JOIN size
), lines AS (
  SELECT p_brand || part_of_brand AS brand, market, CAST(date_trunc('week', l_shipdate) AS DATE) + 6 AS wk, l_returnflag = 'N' AS food,
         CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) AS rev,
         CAST(CAST(l_quantity AS DECIMAL(12,2)) * 100 AS BIGINT) AS qty
  FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN sellers ON s_suppkey = l_suppkey
)
SELECT brand, market, wk, sum(rev) AS rev, sum(qty) AS qty, sum(CASE WHEN food THEN rev END) AS food_rev, sum(CASE WHEN food THEN qty END) AS food_qty, count_if(food) AS n_food
FROM lines WHERE wk <= DATE '2001-07-29' GROUP BY brand, market, wk
"""

#: The export over those sums: whoever asks for one level or channel reads no other.
OF_WEEKLY_SQL = """
WITH lv AS (
  SELECT brand, wk, market, 'CONVENTIONAL|MULTI OUTLET' AS channel, rev, qty FROM {weekly}
  UNION ALL
  SELECT brand, wk, CAST(NULL AS STRING), 'CONVENTIONAL|MULTI OUTLET', sum(rev), sum(qty) FROM {weekly} GROUP BY brand, wk
  UNION ALL
  SELECT brand, wk, market, 'CONVENTIONAL|FOOD', food_rev, food_qty FROM {weekly} WHERE n_food > 0
), sold AS (
  SELECT *, CASE WHEN abs(rev) < 9007199254740992 THEN rev / 10000D ELSE CAST(CAST(rev AS DECIMAL(20,0)) * 0.0001BD AS DOUBLE) END AS d,
         CASE WHEN abs(qty) < 9007199254740992 THEN qty / 100D ELSE CAST(CAST(qty AS DECIMAL(20,0)) * 0.01BD AS DOUBLE) END AS u FROM lv
)
SELECT brand AS internal_id, coalesce(market, 'TOTAL') AS Geography, wk AS Time_Period_End_Date,
       CASE WHEN market IS NULL THEN 'CENSUS REGION' ELSE 'MARKET' END AS Geography_Level, channel AS Channel_Outlet,
       CASE WHEN (CAST(split_part(substr(brand, 7), '/', 1) AS INT) * 31 + weekofyear(wk) + year(wk) * 53) % 97 = 0 THEN NULL ELSE d END AS Dollars,
       u AS Units, d / u AS ARP
FROM sold
"""


def weekly_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEEKLY_SQL, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SALES_TABLES})


def raw_export(weekly: DataFrame) -> DataFrame:
    """The rows of ``EXPORT_SQL`` from those of ``weekly_sales``."""
    return weekly.sparkSession.sql(OF_WEEKLY_SQL, weekly=weekly)
