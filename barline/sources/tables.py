"""Tables, and the bars that are derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table; filters and column lists reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(ts: str) -> Column:
    """Epoch milliseconds of a time without zone, taken as UTC whatever the session's zone."""
    return F.expr(f"unix_millis(to_utc_timestamp(cast({ts} AS timestamp), current_timezone()))")


def ohlcv(ticks: DataFrame, symbol: str, ts: str, value: str, tie: str, width_ms: int = HOUR) -> DataFrame:
    """Bars (symbol, open_ms, open, high, low, close, volume, quote) of fixed width from ticks: one aggregation, no sort.

    Ticks of equal time are ordered by tie. Combined before the shuffle, so a symbol with most ticks costs no task more.
    """
    at = F.struct(F.col(ts), F.col(tie))
    open_ms = (F.floor(F.col("_ms") / width_ms) * width_ms).cast("long")
    return (
        ticks.withColumn("_ms", millis(ts))
        .groupBy(F.col(symbol).alias("symbol"), open_ms.alias("open_ms"))
        .agg(
            F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
            F.count(value).alias("volume"), F.sum(value).alias("quote"),
        )
    )


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of the events, the event type as symbol."""
    return ohlcv(table(spark, folder, "events"), "event_type", "ts", "value", "event_id")


def four_hourly(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of four hours of the events, the event type as symbol."""
    return ohlcv(table(spark, folder, "events"), "event_type", "ts", "value", "event_id", 4 * HOUR)


def daily_prices(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, day, close): the mean order total of each priority and day."""
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("close"))


#: The same bars in SQL, as the first common table expressions of a query.
HOURLY_SQL = """ticks AS (SELECT event_type AS symbol, epoch_us(ts) // 3600000000 * 3600000 AS open_ms, ts, event_id, value FROM events),
bars AS (SELECT symbol, CAST(open_ms AS BIGINT) AS open_ms, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  count(value) AS volume, sum(value) AS quote FROM ticks GROUP BY symbol, open_ms)"""
DAILY_SQL = "daily AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS close FROM orders GROUP BY ALL)"
FOUR_SQL = """b0 AS (SELECT event_type AS symbol, epoch_us(ts) // 14400000000 * 14400000 AS open_ms, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  count(value) AS volume, sum(value) AS quote FROM events GROUP BY 1, 2),
b1 AS (SELECT *, open_ms - lag(open_ms) OVER (PARTITION BY symbol ORDER BY open_ms) AS gap FROM b0),
b2 AS (SELECT *, sum(CASE WHEN gap > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY open_ms ROWS UNBOUNDED PRECEDING) AS segment FROM b1),
bars AS (SELECT symbol || '#' || CAST(segment AS BIGINT) AS symbol, CAST(open_ms AS BIGINT) AS open_ms, open, high, low, close, volume, quote, row_number() OVER (PARTITION BY symbol, segment ORDER BY open_ms) - 1 AS i FROM b2)"""
