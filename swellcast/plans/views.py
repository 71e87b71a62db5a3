"""Input views over the driver's tables (the same SQL runs in DuckDB).

``obs``   univariate irregular observations, one series per event type.
``met``   buoy-like wide observations with planted sentinels and bad angles.
``daily`` longer daily series with real gaps, one per order priority.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import nans_to_nulls, read_table

OBS_SQL = "SELECT event_type AS series_id, ts, value FROM events"

MET_SQL = """SELECT event_type AS series_id, ts,
 CASE WHEN event_id % 29 = 0 THEN 999.0E0 ELSE CAST((event_id*37) % 380 AS DOUBLE) END AS WDIR,
 CASE WHEN event_id % 17 = 0 THEN 99.0E0 ELSE value/20.0E0 END AS WSPD,
 CASE WHEN event_id % 17 = 0 THEN 99.0E0 ELSE value/15.0E0 END AS GST,
 CASE WHEN event_id % 19 = 0 THEN 99.0E0 ELSE 0.5E0 + value/50.0E0 END AS WVHT,
 99.0E0 AS DPD,
 CASE WHEN event_id % 19 = 0 THEN 99.0E0 ELSE 3.0E0 + CAST(event_id % 7 AS DOUBLE) END AS APD,
 CASE WHEN event_id % 31 = 0 THEN 999.0E0 ELSE CAST((event_id*53) % 361 AS DOUBLE) END AS MWD,
 CASE WHEN event_id % 23 = 0 THEN 9999.0E0 ELSE 1000.0E0 + value/10.0E0 END AS PRES,
 CASE WHEN event_id % 37 = 0 THEN 999.0E0 ELSE 10.0E0 + CAST(event_id % 11 AS DOUBLE) END AS ATMP,
 12.0E0 + CAST(event_id % 5 AS DOUBLE) AS WTMP,
 CASE WHEN event_id % 41 = 0 THEN 999.0E0 ELSE 8.0E0 + CAST(event_id % 3 AS DOUBLE) END AS DEWP,
 99.0E0 AS VIS, 99.0E0 AS TIDE
FROM events"""

DAILY_SQL = """SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS d,
 SUM(o_totalprice) AS value FROM orders GROUP BY 1, 2"""


def _register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return nans_to_nulls(ev.select(F.col("event_type").alias("series_id"), "ts", "value"))


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "events")
    return nans_to_nulls(spark.sql(MET_SQL))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    _register(spark, sf_dir, "orders")
    return spark.sql(DAILY_SQL)
