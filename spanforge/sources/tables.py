"""The driver's tables as intervals, events and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeops import DAY, HOUR, floordiv, micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, series_id, user_id, t, value)."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("series_id"), "user_id", micros(F.col("ts")).alias("t"), "value")


def day_windows(ev: DataFrame) -> DataFrame:
    """(interval_id, start, stop): 09:00-17:00 of every day that has an event."""
    day = floordiv(F.col("t"), DAY)
    return ev.select(day.alias("interval_id")).distinct().select(
        "interval_id", (F.col("interval_id") * DAY + 9 * HOUR).alias("start"), (F.col("interval_id") * DAY + 17 * HOUR).alias("stop"))


def order_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, start, stop): of each order from its date to its last shipment; a set is a customer."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    last = li.groupBy("l_orderkey").agg(F.max(micros(F.col("l_shipdate"))).alias("stop"))
    return (o.join(last, o.o_orderkey == last.l_orderkey)
            .select(F.col("o_custkey").alias("set_id"), micros(F.col("o_orderdate")).alias("start"), "stop").where("stop >= start"))


def shipping_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(set_id, start, stop): the week after each shipment; a set is a customer."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    start = micros(F.col("l_shipdate"))
    return o.join(li, o.o_orderkey == li.l_orderkey).select(F.col("o_custkey").alias("set_id"), start.alias("start"), (start + 7 * DAY).alias("stop"))
