"""Structured Streaming: sources, bars, bounded dedupe, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.timeops import PRICE

#: The state store that processors with several states need; Spark's default store has one column family only.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """Prints of the event table as a stream; watermarks need a zoned timestamp, so the edge casts once."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    k = F.get_json_object("props", "$.k").cast("long")
    return raw.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (100 + F.col("value")).cast(PRICE).alias("price"), (1 + k).cast(PRICE).alias("size"))


def bar_stream(trades: DataFrame, seconds: int, lateness: str) -> DataFrame:
    """A bar is final, and in append mode emitted, when the watermark has passed its end; a trade that is later than that is dropped."""
    at = F.struct("ts", "seq")
    return trades.withWatermark("ts", lateness).groupBy("instrument", F.window("ts", f"{seconds} seconds")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").cast(PRICE).alias("volume"), F.count(F.lit(1)).alias("n_trades"),
    ).select("instrument", F.col("window.start").cast("timestamp_ntz").alias("open_ts"), "open", "high", "low", "close", "volume", "n_trades")


def dedupe_stream(rows: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str, mode: str = "append", idle_batches: bool = True, store: str | None = None) -> StreamingQuery:
    """Run over what is there and stop; the finished query is returned.  Without ``idle_batches`` it stops with the last batch that has data, as
    operators in processing time must, which would ask for another batch for ever.  Complete mode rewrites the table each batch; append adds each batch once, under its id,
    so a batch that is tried again replaces itself.  ``store`` is the state store's provider, the session's by default: streams of
    ``state.py`` need ``ROCKS``, whatever the session says."""

    def put(batch: DataFrame, batch_id: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    conf, settings = stream.sparkSession.conf, {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle_batches).lower()}
    if store:
        settings["spark.sql.streaming.stateStore.providerClass"] = store
    before = {name: conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            conf.set(name, value)
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)  # a query keeps the settings that it started with
    query.awaitTermination()
    return query


def drain_in_parts(rows: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, order: str, parts: int, mode: str = "append") -> None:
    """``rows`` in ``parts`` runs by ``order`` (a number): each run writes its rows as files, restarts the query from its checkpoint and drains it.
    The keyed state of such queries is in RocksDB."""
    spark = rows.sparkSession
    shares = [(i + 1) / parts for i in range(parts - 1)]
    cuts = rows.agg(F.percentile_approx(order, shares, 10_000)).first()[0] or [] if shares else []
    part = F.lit(0) + sum((F.col(order) > c).cast("int") for c in cuts)
    for i in range(parts):
        rows.where(part == i).write.mode("overwrite").parquet(f"{path}-in/part={i}")
        drain(build(spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{path}-in")), path, mode, store=ROCKS)


def drain_final_bars(trades: DataFrame, seconds: int, lateness_seconds: int, path: str) -> None:
    """The bars of a bounded stream in append mode.  When it is drained, one closing row far enough after the newest bar ends event time: the
    last watermark passes every open window, and the closing row's own window stays open."""
    spark = trades.sparkSession
    schema = trades.schema
    closing = f"{path}-closing"
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(closing)
    bars = lambda: bar_stream(trades.unionByName(spark.readStream.schema(schema).parquet(closing)), seconds, f"{lateness_seconds} seconds")
    seen = [p["eventTime"]["max"] for p in drain(bars(), path).recentProgress if "max" in p["eventTime"]]
    if seen:
        far = F.to_timestamp(F.lit(max(seen))) + F.make_dt_interval(secs=F.lit(lateness_seconds + 2 * seconds))
        row = spark.range(1).select(*(far.alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))
        row.write.mode("append").parquet(closing)
        drain(bars(), path)
