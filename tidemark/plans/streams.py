"""Queries over streams: bars, ledgers, accumulation, books and seeds.  Bars are replayed in several runs that restart from the checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators.bars import utc_aggregate
from tidemark.plans.catalog import BAR, ORACLES, dbl, doubles, query
from tidemark.plans.intake import bounded_rows
from tidemark.plans.storage import shared
from tidemark.sources import adapters as S
from tidemark.streaming import bars as R
from tidemark.streaming import state as K

OHLCV = ("open", "high", "low", "close", "volume")


@query("stream_hourly_bars", f"WITH {BAR} SELECT instrument, open_ts, {dbl(*OHLCV)}, n_trades FROM bar")
def stream_hourly_bars(spark, sf):
    path = shared(spark, "stream-bars")
    R.drain_final_bars(R.event_stream(spark, f"{sf}/event*.parquet"), 3600, 3600, path)
    return doubles(spark.read.parquet(path).select("instrument", "open_ts", *OHLCV, "n_trades"), *OHLCV)


@query("stream_ledger", """WITH s AS (SELECT event_type || '|' || user_id AS key, event_id AS seq, (event_id % 3)::VARCHAR AS payload FROM events),
f AS (SELECT *, first(payload) OVER (PARTITION BY key ORDER BY seq) AS p, row_number() OVER (PARTITION BY key ORDER BY seq) AS r FROM s)
SELECT key, seq, CASE WHEN r = 1 THEN 'ACCEPTED' WHEN payload = p THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status FROM f""")
def stream_ledger(spark, sf):
    path = shared(spark, "stream-ledger")
    raw = spark.readStream.schema(R.EVENTS).parquet(f"{sf}/event*.parquet")
    key, payload = F.concat_ws("|", "event_type", "user_id").alias("key"), (F.col("event_id") % 3).cast("string").alias("payload")
    R.drain(K.ledger_stream(raw.select(key, F.col("event_id").alias("seq"), payload)), path, idle_batches=False, store=R.ROCKS)
    return spark.read.parquet(path).select("key", "seq", "status")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    path = shared(spark, "stream-dedupe")
    raw = spark.readStream.schema(R.EVENTS).parquet(f"{sf}/event*.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    R.drain(R.dedupe_stream(raw, ["user_id", "event_type"], "ts", "60 days"), path)
    return spark.read.parquet(path).select("user_id", "event_type")


@query("stream_bounded_observations", ORACLES["bounded_observations"])
def stream_bounded_observations(spark, sf):
    path = shared(spark, "stream-store")
    R.drain_in_parts(bounded_rows(spark, sf), lambda rows: K.bounded_stream(rows, 48), path, "arrival", 3)
    return spark.read.parquet(path).select("instrument", "arrival", "open_ts", "status", "evicted_ts")


#: Bars in order of arrival: some 25 hours late, some twice, some again with another close.
_PARTS = BAR + """, ar AS (SELECT instrument, open_ts, open::DOUBLE AS open, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, volume::DOUBLE AS volume,
    epoch(open_ts)::BIGINT // 3600 * 100 + CASE WHEN n_trades % 4 = 0 THEN 2530 ELSE 0 END AS arrival, n_trades FROM bar),
pt AS (SELECT * FROM ar UNION ALL SELECT * REPLACE (arrival + 1 AS arrival) FROM ar WHERE n_trades % 3 = 0
    UNION ALL SELECT * REPLACE (arrival + 2 AS arrival, close + 1 AS close) FROM ar WHERE n_trades % 5 = 0)"""


def _part_rows(spark, sf):
    hour = F.floor(T.micros(F.col("open_ts")) / 3_600_000_000)
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", *OHLCV, "n_trades", (hour * 100 + F.when(F.col("n_trades") % 4 == 0, 2530).otherwise(0)).cast("long").alias("arrival"))
    at = F.col("arrival")
    again = bars.where("n_trades % 3 = 0").withColumn("arrival", at + 1)
    other = bars.where("n_trades % 5 = 0").withColumns({"arrival": at + 2, "close": (F.col("close") + 1).cast(T.PRICE)})
    return bars.unionByName(again).unionByName(other).drop("n_trades")


@query("stream_accumulated_bars", f"""WITH RECURSIVE {_PARTS},
e AS (SELECT *, time_bucket(INTERVAL 4 HOUR, open_ts) AS bucket, row_number() OVER (PARTITION BY instrument ORDER BY arrival) AS i FROM pt),
r AS (
  SELECT instrument, 0::BIGINT AS i, NULL::TIMESTAMP AS open_ts, NULL::BIGINT AS arrival, NULL::VARCHAR AS status, NULL::TIMESTAMP AS bucket, NULL::TIMESTAMP AS expired,
    []::STRUCT(b TIMESTAMP, t TIMESTAMP, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE)[] AS held, []::STRUCT(b TIMESTAMP, t TIMESTAMP, o DOUBLE, h DOUBLE, l DOUBLE, c DOUBLE, v DOUBLE)[] AS made
  FROM e GROUP BY instrument
  UNION ALL
  SELECT instrument, i, open_ts, arrival, status, bucket, expired,
    CASE WHEN status IN ('DUPLICATE', 'CONFLICT') THEN held WHEN status = 'COMPLETED' THEN list_filter(more, lambda x: x.b <> bucket AND (expired IS NULL OR x.b <> expired)) ELSE list_filter(more, lambda x: expired IS NULL OR x.b <> expired) END,
    CASE WHEN status = 'COMPLETED' THEN list_sort(list_filter(more, lambda x: x.b = bucket)) ELSE [] END
  FROM (
    SELECT *, CASE WHEN len(seen) > 0 THEN CASE WHEN seen[1] = part THEN 'DUPLICATE' ELSE 'CONFLICT' END
                   WHEN len(list_filter(more, lambda x: x.b = bucket)) = 4 AND (expired IS NULL OR expired <> bucket) THEN 'COMPLETED' ELSE 'HELD' END AS status
    FROM (
      SELECT *, CASE WHEN len(seen) = 0 AND len(list_distinct(list_transform(more, lambda x: x.b))) > 3 THEN list_min(list_transform(more, lambda x: x.b)) END AS expired
      FROM (SELECT e.instrument, e.i, e.open_ts, e.arrival, e.bucket, r.held, {{'b': e.bucket, 't': e.open_ts, 'o': e.open, 'h': e.high, 'l': e.low, 'c': e.close, 'v': e.volume}} AS part,
              list_filter(r.held, lambda x: x.b = e.bucket AND x.t = e.open_ts) AS seen, list_append(r.held, part) AS more
            FROM r JOIN e ON e.instrument = r.instrument AND e.i = r.i + 1))))
SELECT instrument, arrival, open_ts, status, bucket AS bucket_ts, made[1].o AS open, list_max(list_transform(made, lambda x: x.h)) AS high, list_min(list_transform(made, lambda x: x.l)) AS low,
  made[-1].c AS close, list_sum(list_transform(made, lambda x: x.v)) AS volume, expired AS expired_ts FROM r WHERE i > 0""")
def stream_accumulated_bars(spark, sf):
    """Hourly bars to four hours with three open buckets an instrument, in four runs."""
    path = shared(spark, "stream-parts")
    R.drain_in_parts(_part_rows(spark, sf), lambda rows: K.accumulated_stream(rows, 3600, 14_400, 3), path, "arrival", 4)
    return doubles(spark.read.parquet(path).select("instrument", "arrival", "open_ts", "status", "bucket_ts", *OHLCV, "expired_ts"), *OHLCV)


@query("stream_session_book", f"""WITH {BAR}, b AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, hour(open_ts) AS h, open_ts, {dbl(*OHLCV)} FROM bar),
x AS (SELECT *, 0 AS kind FROM b WHERE h < 16 UNION ALL SELECT * REPLACE (close + 1 AS close, high + 1 AS high), 1 FROM b WHERE h >= 14),
y AS (SELECT * FROM x WHERE kind = 1 OR h < 14 OR NOT EXISTS (SELECT 1 FROM x z WHERE z.kind = 1 AND z.instrument = x.instrument AND z.open_ts = x.open_ts)),
s AS (SELECT instrument, session, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ts) AS close, sum(volume) AS volume, count(*) AS n_bars, max(open_ts) AS last_ts FROM y GROUP BY 1, 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY session DESC) <= 5""")
def stream_session_book(spark, sf):
    """Historical bars until 16 h and live bars from 12 h, of which those from 14 h on count; they arrive in an order that follows no clock."""
    path = shared(spark, "stream-book")
    hour, day = F.hour("open_ts"), F.date_trunc("day", "open_ts").cast("timestamp_ntz")
    bars = S.hourly_bars(spark, sf).select("instrument", day.alias("session"), "open_ts", *OHLCV)
    cutoff = T.from_micros(T.micros(F.col("session")) + 14 * 3_600_000_000)
    past = bars.where(hour < 16).withColumns({"kind": F.lit(0), "cutoff": cutoff})
    live = bars.where(hour >= 12).withColumns({"kind": F.lit(1), "cutoff": F.lit(None).cast("timestamp_ntz"), "close": (F.col("close") + 1).cast(T.PRICE), "high": (F.col("high") + 1).cast(T.PRICE)})
    rows = past.unionByName(live).withColumn("arrival", F.pmod(F.xxhash64("instrument", "open_ts", "kind"), F.lit(1 << 40)))
    R.drain_in_parts(rows, lambda r: K.session_book_stream(r, 5, 48), path, "arrival", 3)
    return doubles(K.latest_versions(spark.read.parquet(path).drop("batch")), *OHLCV)


@query("stream_seeded_bars", f"""WITH {BAR}, u AS (SELECT *, time_bucket(INTERVAL 4 HOUR, open_ts) AS bucket, max(time_bucket(INTERVAL 4 HOUR, open_ts)) OVER (PARTITION BY instrument) AS newest FROM bar)
SELECT instrument, bucket AS bucket_ts, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in [('open', 'arg_min(open, open_ts)'), ('high', 'max(high)'), ('low', 'min(low)'), ('close', 'arg_max(close, open_ts)'), ('volume', 'sum(volume)')])}
FROM u WHERE bucket < newest GROUP BY instrument, bucket HAVING count(*) = 4""")
def stream_seeded_bars(spark, sf):
    """Four-hour bars of a run that stops in the middle of a bucket and of one that is seeded and goes on: those of a run without a stop."""
    path = shared(spark, "stream-seeded")
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", *OHLCV)
    last = S.table(spark, sf, "events").agg((T.anchored_floor(F.max("ts"), 14_400) - F.expr("INTERVAL 238 HOURS")).alias("cut"))
    both = bars.crossJoin(F.broadcast(last))  # one row
    warm, live = both.where("open_ts < cut").drop("cut"), both.where("open_ts >= cut").drop("cut").withColumn("arrival", T.micros(F.col("open_ts")))
    R.drain_in_parts(live, lambda rows: K.forward_stream(rows, 3600, 14_400, warm), path, "arrival", 2)
    before = utc_aggregate(warm.withColumns({"health": F.lit("READY"), "evidence": F.array().cast("array<string>")}), 3600, 14_400).select("instrument", F.col("bucket").alias("bucket_ts"), *OHLCV)
    after = spark.read.parquet(path).where("status = 'COMPLETED'").select("instrument", "bucket_ts", *OHLCV)
    return doubles(before.unionByName(after), *OHLCV)
