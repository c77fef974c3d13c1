"""Market records out of the star-schema tables: trades, quotes, hourly and daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timeops import PRICE
from tidemark.operators.bars import build_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k():
    return F.get_json_object("props", "$.k").cast("long")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, ts, seq, price, size: every event is a print of its type."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("seq"), (100 + F.col("value")).cast(PRICE).alias("price"), (1 + _k()).cast(PRICE).alias("size")
    )


def flow_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")).select(
        F.concat(F.lit("I"), F.pmod("user_id", F.lit(5))).alias("instrument"), "ts", F.col("event_id").alias("seq"), (100 + F.col("value")).cast(PRICE).alias("price"), (1 + _k()).cast(PRICE).alias("size")
    )


def flow_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == "view").select(
        F.concat(F.lit("I"), F.pmod("user_id", F.lit(5))).alias("instrument"), "ts", F.col("event_id").alias("seq"), (99.5 + F.col("value")).cast(PRICE).alias("bid"), (100.5 + F.col("value")).cast(PRICE).alias("ask")
    )


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_bars(trades(spark, sf_dir), 3600)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar a day and priority of orders: price is the order total, size one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast(PRICE).alias("price"), F.lit(1).cast(PRICE).alias("size"))
    return build_bars(orders, 86_400)
