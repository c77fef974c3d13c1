"""Queries over catalogs, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from tidemark.plans.catalog import BAR, TR, dbl, doubles, query
from tidemark.sources import adapters as S
from tidemark.sources import catalog as C
from tidemark.sources import commits, footers


def shared(spark, name: str) -> str:
    """A fresh folder in the cluster's shared checkpoint folder; a temporary one only where a single machine runs everything."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("tick_catalog_scan", f"WITH {TR} SELECT instrument, ts, seq, price::DOUBLE AS price FROM tr WHERE instrument = 'click' AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'")
def tick_catalog_scan(spark, sf):
    path = shared(spark, "ticks")
    t = S.trades(spark, sf).withColumn("dedupe_key", F.concat_ws("|", "instrument", "seq")).withColumn("ts_init", F.lit(1))
    C.write_ticks(t.unionByName(t.where("seq % 2 = 0").withColumn("ts_init", F.lit(2))), path)
    schema = t.schema.add("day", "date")
    return doubles(C.scan_ticks(spark, path, schema, "click", "2024-01-10", "2024-01-12").select("instrument", "ts", "seq", "price"), "price")


@query("consolidated_bar_catalog", f"WITH {BAR} SELECT instrument, open_ts, close::DOUBLE + CASE WHEN hour(open_ts) BETWEEN 8 AND 15 THEN 1 ELSE 0 END AS close FROM bar")
def consolidated_bar_catalog(spark, sf):
    """Two batches that overlap from 8 to 16 h, the second revised, and their consolidation."""
    path, whole = shared(spark, "bar-batches"), shared(spark, "bar-catalog")
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.col("close").cast("double").alias("close"), F.to_date("open_ts").alias("day"))
    first = bars.where(F.hour("open_ts") < 16).withColumn("batch", F.lit(1))
    again = bars.where(F.hour("open_ts") >= 8).withColumns({"batch": F.lit(2), "close": F.when(F.hour("open_ts") < 16, F.col("close") + 1).otherwise(F.col("close"))})
    for batch in (first, again):
        C.write_batch(batch, path, ["instrument", "open_ts"], 100_000_000)
    C.consolidate(spark.read.schema(first.schema).parquet(path), whole, ["instrument", "open_ts"], "batch")
    return spark.read.schema(first.schema).parquet(whole).select("instrument", "open_ts", "close")


@query("first_arrival_dedupe", f"WITH {TR} SELECT instrument, seq, price::DOUBLE AS price, CASE WHEN seq % 3 = 0 THEN 0 ELSE 1 END AS ts_init FROM tr")
def first_arrival_dedupe(spark, sf):
    t = S.trades(spark, sf).withColumn("ts_init", F.lit(1))
    again = t.where("seq % 3 = 0").withColumn("ts_init", F.lit(0)).unionByName(t.where("seq % 4 = 0").withColumn("ts_init", F.lit(5)))
    return doubles(C.first_arrival(t.unionByName(again), "seq").select("instrument", "seq", "price", "ts_init"), "price")


@query("bar_record_codec", f"WITH {BAR} SELECT instrument, open_ts, {dbl('open', 'high', 'low', 'close', 'volume')}, true AS valid FROM bar")
def bar_record_codec(spark, sf):
    return doubles(C.decode_bars(C.encode_bars(S.hourly_bars(spark, sf))), "open", "high", "low", "close", "volume")


def _features(spark, sf):
    b = S.hourly_bars(spark, sf)
    tf = F.when(F.hour("open_ts") % 4 == 0, "4h").otherwise("1h")
    f = b.select("instrument", tf.alias("timeframe"), F.to_timestamp_ntz(F.date_format("close_ts", "yyyy-MM-dd HH:00:00")).alias("as_of"), F.lit("v1").alias("version"), F.col("close").cast("double").alias("value"))
    f = f.unionByName(f.where(F.hour("as_of") % 2 == 0).withColumn("version", F.lit("v2")))
    return f.withColumn("feature_id", F.concat_ws("|", "instrument", "timeframe", F.date_format("as_of", "yyyy-MM-dd HH"), "version")).withColumn("content_hash", F.sha2(F.col("value").cast("string"), 256))


_FEAT = BAR + ", f1 AS (SELECT instrument, CASE WHEN hour(open_ts) % 4 = 0 THEN '4h' ELSE '1h' END AS timeframe, close_ts AS as_of, close::DOUBLE AS value FROM bar), f AS (SELECT *, 'v1' AS version FROM f1 UNION ALL SELECT *, 'v2' FROM f1 WHERE hour(as_of) % 2 = 0)"


@query("feature_store_history", f"WITH {_FEAT} SELECT as_of, version, value FROM f WHERE instrument = 'view' AND timeframe = '4h'")
def feature_store_history(spark, sf):
    path = shared(spark, "features")
    f = _features(spark, sf)
    C.append_features(f, path)
    stored = spark.read.schema(StructType([*f.schema.fields, StructField("day", DateType())])).parquet(path)
    C.append_features(f, path, stored)  # a second append of the same features writes nothing
    return C.feature_history(stored, "view", "4h").select("as_of", "version", "value")


@query("latest_feature_variants", f"WITH {_FEAT} SELECT instrument, timeframe, as_of, version, value FROM f QUALIFY rank() OVER (PARTITION BY instrument, timeframe ORDER BY as_of DESC) = 1")
def latest_feature_variants(spark, sf):
    return C.latest_variants(_features(spark, sf), ["instrument", "timeframe"]).select("instrument", "timeframe", "as_of", "version", "value")


@query("event_bounds", "SELECT min(ts) AS first, max(ts) AS last FROM events")
def event_bounds(spark, sf):
    """Out of the footers; no column is read where they have bounds."""
    return footers.file_bounds(spark, f"{sf}/events.parquet", "ts").agg(F.min("first").alias("first"), F.max("last").alias("last"))


@query("committed_units", """SELECT 'orders' AS tbl, o_orderstatus AS unit, count(*) AS n, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL
UNION ALL SELECT 'customers', o_orderstatus, count(DISTINCT o_custkey), NULL FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL""")
def committed_units(spark, sf):
    """Two tables in one unit per order status.  The unit of P is written but never committed, that of F is written twice."""
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    customers = orders.groupBy("o_custkey", "o_orderstatus").agg(F.max("ts").alias("ts"))
    ddl = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    log = commits.CommitLog(spark, shared(spark, "units"), {"orders": (ddl(orders), "ts"), "customers": (ddl(customers), "ts")})
    for unit in ("F", "O", "P"):
        mine = F.col("o_orderstatus") == unit
        log.stage(unit, {"orders": orders.where(mine).limit(1), "customers": customers.where(mine)})  # a try that stops here
        if unit != "P":
            log.write(unit, {"orders": orders.where(mine), "customers": customers.where(mine)})
    log.write("F", {"orders": orders, "customers": customers})  # committed already: nothing
    count = F.count(F.lit(1)).alias("n")
    sums = log.read("orders").groupBy(F.lit("orders").alias("tbl"), F.col("o_orderstatus").alias("unit")).agg(count, F.sum(F.col("price").cast("decimal(18,2)")).cast("double").alias("total"))
    return sums.unionByName(log.read("customers").groupBy(F.lit("customers").alias("tbl"), F.col("o_orderstatus").alias("unit")).agg(count, F.lit(None).cast("double").alias("total")))


@query("overlapping_appends", f"WITH {BAR} SELECT instrument, open_ts, close::DOUBLE AS close FROM bar")
def overlapping_appends(spark, sf):
    """Bars in four batches, each of which begins before the one before ends; a row that is stored is not written again."""
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.col("close").cast("double").alias("close"))
    log = commits.CommitLog(spark, shared(spark, "appends"), {"bars": ("instrument string, open_ts timestamp_ntz, close double", "open_ts")})
    day = F.dayofmonth("open_ts")
    for i in range(4):
        log.append_new(str(i), "bars", bars.where((day >= 8 * i - 2) & ((day < 8 * (i + 1)) | F.lit(i == 3))), ["instrument", "open_ts"])
    return log.read("bars")


@query("screenshot_names", """WITH n AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H%M%S') || '_' || upper(event_type) || '_5m_' || CASE WHEN user_id % 2 = 0 THEN 'long' WHEN user_id % 3 = 0 THEN 'flat' ELSE 'short' END || '_break-out.png' AS name, ts, event_type, user_id FROM events),
p AS (SELECT *, user_id % 2 = 0 OR user_id % 3 <> 0 AS ok FROM n)
SELECT event_id, CASE WHEN ok THEN date_trunc('second', ts) END AS taken_ts, CASE WHEN ok THEN upper(event_type) END AS instrument, CASE WHEN ok THEN CASE WHEN user_id % 2 = 0 THEN 'long' ELSE 'short' END END AS direction, CASE WHEN ok THEN 'break-out' END AS setup,
 CASE WHEN NOT ok THEN 'unparsable' WHEN event_type = 'error' THEN 'unknown_instrument' END AS error FROM p""")
def screenshot_names(spark, sf):
    u = F.col("user_id")
    side = F.when(u % 2 == 0, "long").when(u % 3 == 0, "flat").otherwise("short")
    n = S.table(spark, sf, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HHmmss"), F.lit("_"), F.upper("event_type"), F.lit("_5m_"), side, F.lit("_break-out.png")).alias("name"))
    return C.parse_names(n, known=["CLICK", "VIEW", "SIGNUP", "PURCHASE"]).select("event_id", "taken_ts", "instrument", "direction", "setup", "error")


@query("operational_ledger", "SELECT user_id::VARCHAR AS run_id, event_type AS event_id, min(event_id) AS sequence FROM events GROUP BY ALL")
def operational_ledger(spark, sf):
    path = shared(spark, "ledger")
    rows = S.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("event_id"), F.col("event_id").alias("sequence"))
    middle = rows.agg(F.max("sequence")).first()[0] // 2
    C.append_ledger(rows.where(F.col("sequence") <= middle), path, spark)
    C.append_ledger(rows, path, spark)
    return spark.read.schema(rows.schema).parquet(path)
