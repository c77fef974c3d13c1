"""Queries over bars and order flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.functions.carry import islands
from tidemark.operators import bars as B
from tidemark.operators import flow, normalize
from tidemark.plans.catalog import BAR, SIDE, TR, dbl, doubles, query
from tidemark.sources import adapters as S

OHLCV = ("open", "high", "low", "close", "volume")


@query("tick_bars_hourly", f"WITH {BAR} SELECT instrument, open_ts, close_ts, {dbl(*OHLCV)}, n_trades, open_ts < max(open_ts) OVER (PARTITION BY instrument) AS is_complete FROM bar")
def tick_bars_hourly(spark, sf):
    return doubles(S.hourly_bars(spark, sf), *OHLCV)


@query("order_bars_daily", f"""WITH bar AS (SELECT o_orderpriority AS instrument, date_trunc('day', o_orderdate)::TIMESTAMP AS open_ts, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
 arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume, count(*) AS n_trades FROM orders GROUP BY ALL) SELECT * FROM bar""")
def order_bars_daily(spark, sf):
    return doubles(S.daily_bars(spark, sf), *OHLCV).select("instrument", "open_ts", *OHLCV, "n_trades")


@query("session_bars_4h", f"""WITH {BAR}, b AS (SELECT *, date_trunc('day', open_ts) + INTERVAL 4 HOUR * (hour(open_ts) // 4) AS bucket FROM bar)
SELECT instrument, bucket, arg_min(open, open_ts)::DOUBLE AS open, max(high)::DOUBLE AS high, min(low)::DOUBLE AS low, arg_max(close, open_ts)::DOUBLE AS close, sum(volume)::DOUBLE AS volume FROM b GROUP BY ALL HAVING count(*) = 4""")
def session_bars_4h(spark, sf):
    bars = S.hourly_bars(spark, sf)
    return doubles(B.session_aggregate(bars, 3600, 4 * 3600, F.date_trunc("day", "open_ts")), *OHLCV)


def _with_quality(bars):
    n = F.col("n_trades")
    return bars.withColumn("health", F.when(n >= 3, "READY").when(n == 2, "DEGRADED").otherwise("STALE")).withColumn("evidence", F.array(F.concat(F.lit("n"), F.col("n_trades").cast("string")))).withColumn("volume", F.when(n % 5 != 0, F.col("volume")))


_QUALITY = "CASE WHEN n_trades >= 3 THEN 0 WHEN n_trades = 2 THEN 2 ELSE 3 END"


_UTC_TWO = f"""WITH {BAR}, b AS (SELECT *, CASE WHEN n_trades % 5 <> 0 THEN volume END AS v, {_QUALITY} AS rk, open_ts - INTERVAL 1 HOUR * (hour(open_ts) % 2) AS bucket FROM bar)
SELECT instrument, bucket, arg_min(open, open_ts)::DOUBLE AS open, max(high)::DOUBLE AS high, min(low)::DOUBLE AS low, arg_max(close, open_ts)::DOUBLE AS close,
 CASE WHEN count(v) = count(*) THEN sum(v)::DOUBLE END AS volume, ['READY','WARMING','DEGRADED','STALE'][max(rk) + 1] AS health,
 CASE WHEN count(v) = count(*) THEN 'DERIVED' ELSE 'PARTIAL' END AS fidelity,
 CASE WHEN first(n_trades ORDER BY open_ts) = last(n_trades ORDER BY open_ts) THEN 'n' || first(n_trades ORDER BY open_ts) ELSE 'n' || first(n_trades ORDER BY open_ts) || ',n' || last(n_trades ORDER BY open_ts) END AS evidence
FROM b GROUP BY ALL HAVING count(*) = 2"""


@query("utc_bars_lenient", _UTC_TWO)
def utc_bars_lenient(spark, sf):
    return doubles(B.utc_aggregate(_with_quality(S.hourly_bars(spark, sf)), 3600, 7200), *OHLCV)


@query("utc_bars_strict", _UTC_TWO)
def utc_bars_strict(spark, sf):
    """Only whole buckets go in: an incomplete one would fail the batch."""
    bars = _with_quality(S.hourly_bars(spark, sf)).withColumn("_two", T.anchored_floor(F.col("open_ts"), 7200))
    whole = bars.groupBy("instrument", "_two").agg(F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")
    return doubles(B.utc_aggregate(bars.join(whole, ["instrument", "_two"], "left_semi").drop("_two"), 3600, 7200, strict=True), *OHLCV)


@query("last_bars_per_instrument", f"WITH {BAR} SELECT instrument, open_ts, close::DOUBLE AS close FROM bar QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) <= 5")
def last_bars_per_instrument(spark, sf):
    return doubles(B.keep_last(S.hourly_bars(spark, sf), 5).select("instrument", "open_ts", "close"), "close")


def _revised(spark, sf):
    bars = S.hourly_bars(spark, sf)
    k = F.hour("open_ts")
    rev = bars.where(k % 6 == 0).withColumn("close", (F.col("close") + 1).cast(T.PRICE))
    return bars.withColumn("is_revision", F.lit(False)).withColumn("ts_init", F.lit(1)).unionByName(rev.withColumn("is_revision", F.lit(True)).withColumn("ts_init", F.lit(2))).unionByName(
        bars.where(k % 7 == 0).withColumn("close", (F.col("close") + 2).cast(T.PRICE)).withColumn("is_revision", F.lit(False)).withColumn("ts_init", F.lit(0)))


@query("bar_revisions", f"""WITH {BAR} SELECT instrument, open_ts, {dbl('open', 'high', 'low')}, (close + CASE WHEN hour(open_ts) % 6 = 0 THEN 1 ELSE 0 END)::DOUBLE AS close, volume::DOUBLE AS volume, hour(open_ts) % 7 = 0 AS conflict FROM bar""")
def bar_revisions(spark, sf):
    return doubles(B.resolve_revisions(_revised(spark, sf)), *OHLCV)


@query("ledger_first_accepted", f"""WITH {BAR}, s AS (SELECT instrument, open_ts, 1 AS arrival, close FROM bar UNION ALL SELECT instrument, open_ts, 2, close FROM bar WHERE hour(open_ts) % 3 = 0
 UNION ALL SELECT instrument, open_ts, 3, close + 1 FROM bar WHERE hour(open_ts) % 4 = 0)
SELECT instrument, open_ts, arrival, CASE arrival WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'DUPLICATE' ELSE 'CONFLICT' END AS status FROM s""")
def ledger_first_accepted(spark, sf):
    bars, h = S.hourly_bars(spark, sf), F.hour("open_ts")
    feed = bars.withColumn("arrival", F.lit(1)).unionByName(bars.where(h % 3 == 0).withColumn("arrival", F.lit(2))).unionByName(bars.where(h % 4 == 0).withColumn("close", (F.col("close") + 1).cast(T.PRICE)).withColumn("arrival", F.lit(3)))
    return B.first_accepted(feed).select("instrument", "open_ts", "arrival", "status")


@query("history_live_union", f"""WITH {BAR} SELECT instrument, open_ts, (CASE WHEN open_ts >= c AND hour(open_ts) % 2 = 0 THEN close + 1 ELSE close END)::DOUBLE AS close FROM bar, (SELECT date_trunc('day', max(ts)) - INTERVAL 14 DAY AS c FROM events)""")
def history_live_union(spark, sf):
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", "close").withColumn("arrival", F.lit(1))
    live = bars.where(F.hour("open_ts") % 2 == 0).withColumn("close", (F.col("close") + 1).cast(T.PRICE))
    last = F.broadcast(S.table(spark, sf, "events").agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 14 DAYS")).cast("timestamp_ntz").alias("c")))  # one row
    return doubles(B.history_live_union(bars.crossJoin(last), live.crossJoin(last), F.col("c")).select("instrument", "open_ts", "close"), "close")


@query("trade_normalizer", """SELECT event_id::VARCHAR AS source_trade_id, event_type AS instrument, ts, (value - 5)::DECIMAL(18,6)::DOUBLE AS price, (CAST(json_extract(props, '$.k') AS BIGINT) % 10)::DOUBLE AS size,
 CASE WHEN (value - 5)::DECIMAL(18,6) <= 0 THEN 'price_not_positive' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 10 <= 0 THEN 'size_not_positive' END AS reject_reason FROM events""")
def trade_normalizer(spark, sf):
    raw = S.table(spark, sf, "events").select(F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("trade_id"), (F.col("value") - 5).cast(T.PRICE).alias("price"), (F.get_json_object("props", "$.k").cast("long") % 10).cast(T.PRICE).alias("size"))
    return doubles(normalize.trades(raw), "price", "size")


@query("quote_normalizer", """WITH q AS (SELECT event_id AS seq, event_type AS instrument, ts, (value - 2)::DECIMAL(18,6) AS bid, (value - 1 - CAST(json_extract(props, '$.k') AS BIGINT) % 4)::DECIMAL(18,6) AS ask,
 (CAST(json_extract(props, '$.k') AS BIGINT) % 9 - 1)::DECIMAL(18,6) AS bid_size FROM events)
SELECT seq, instrument, ts, bid::DOUBLE AS bid, ask::DOUBLE AS ask, CASE WHEN bid <= 0 OR ask <= 0 THEN 'price_not_positive' WHEN bid > ask THEN 'crossed' WHEN bid_size < 0 THEN 'negative_size' END AS reject_reason FROM q""")
def quote_normalizer(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    raw = S.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("instrument"), "ts", (F.col("value") - 2).cast(T.PRICE).alias("bid"), (F.col("value") - 1 - k % 4).cast(T.PRICE).alias("ask"), (k % 9 - 1).cast(T.PRICE).alias("bid_size"), F.lit(1).cast(T.PRICE).alias("ask_size"))
    return doubles(normalize.quotes(raw).select("seq", "instrument", "ts", "bid", "ask", "reject_reason"), "bid", "ask")


@query("minute_bar_normalizer", f"""WITH {BAR} SELECT instrument, open_ts, open_ts + INTERVAL 60 SECOND AS close_ts, 0.0::DOUBLE AS buy_volume, 0.0::DOUBLE AS sell_volume, volume::DOUBLE AS unknown_volume, close_ts AS received_ts FROM bar""")
def minute_bar_normalizer(spark, sf):
    out = normalize.minute_bars(S.hourly_bars(spark, sf).withColumnRenamed("open_ts", "ts_event").withColumn("ts_init", F.col("ts_event")), F.col("close_ts"))
    return doubles(out.select("instrument", "open_ts", "close_ts", "buy_volume", "sell_volume", "unknown_volume", "received_ts"), "buy_volume", "sell_volume", "unknown_volume")


@query("bar_invariants", f"""WITH {BAR}, b AS (SELECT instrument, open_ts, open, high - CASE WHEN hour(open_ts) % 5 = 0 THEN 50 ELSE 0 END AS high, low, close FROM bar)
SELECT instrument, open_ts, concat_ws(',', CASE WHEN low > open OR low > close THEN 'low_above_body' END, CASE WHEN high < open OR high < close THEN 'high_below_body' END, CASE WHEN high < low THEN 'high_below_low' END) AS reasons FROM b""")
def bar_invariants(spark, sf):
    bars = S.hourly_bars(spark, sf).withColumn("high", F.when(F.hour("open_ts") % 5 == 0, (F.col("high") - 50).cast(T.PRICE)).otherwise(F.col("high")))
    return normalize.bar_checks(bars).select("instrument", "open_ts", F.array_join("reasons", ",").alias("reasons"))


@query("historical_response_validation", f"""WITH {BAR}, b AS (SELECT instrument, open_ts, lag(open_ts) OVER (PARTITION BY instrument ORDER BY open_ts) AS prev FROM bar)
SELECT instrument, count(*) AS n, count(*) <= 700 AS within_limit, bool_and(open_ts BETWEEN (SELECT date_trunc('day', min(ts)) FROM events) AND (SELECT max(open_ts) FROM bar) - INTERVAL 1 HOUR) AS within_bounds, bool_and(prev IS NULL OR open_ts > prev) AS increasing FROM b GROUP BY 1""")
def historical_response_validation(spark, sf):
    """The request ends an hour before the newest bar, so some responses reach beyond it."""
    bars = S.hourly_bars(spark, sf)
    first, last = bars.agg(F.date_trunc("day", F.min("open_ts")).cast("timestamp_ntz"), F.max("open_ts") - F.expr("INTERVAL 2 HOURS")).first()
    return normalize.response_check(bars, 700, str(first), str(last), 3600)


@query("asof_trade_quote", f"WITH {SIDE} SELECT instrument, ts, seq, price::DOUBLE AS price, bid::DOUBLE AS bid, ask::DOUBLE AS ask, qts AS quote_ts, reason, side FROM cl")
def asof_trade_quote(spark, sf):
    c = flow.classify_trades(S.flow_trades(spark, sf), S.flow_quotes(spark, sf), 7200)
    return doubles(c.select("instrument", "ts", "seq", "price", F.col("quote.bid").alias("bid"), F.col("quote.ask").alias("ask"), F.col("quote.ts").alias("quote_ts"), "reason", "side"), "price", "bid", "ask")


def _classified(spark, sf):
    return flow.classify_trades(S.flow_trades(spark, sf), S.flow_quotes(spark, sf), 7200)


@query("session_pressure", f"""WITH {SIDE}, g AS (SELECT instrument, date_trunc('day', ts)::TIMESTAMP AS session, reason, count(*) AS n, sum(size) FILTER (side = 'BUY') AS b, sum(size) FILTER (side = 'SELL') AS s, sum(size) FILTER (side = 'UNKNOWN') AS u FROM cl GROUP BY ALL),
t AS (SELECT instrument, session, coalesce(sum(b), 0)::DOUBLE AS buy, coalesce(sum(s), 0)::DOUBLE AS sell, coalesce(sum(u), 0)::DOUBLE AS unknown, sum(n)::BIGINT AS n_trades, string_agg(reason || '=' || n, ';' ORDER BY reason) AS reasons FROM g GROUP BY ALL)
SELECT *, buy - sell AS delta, round(CASE WHEN buy + sell + unknown = 0 THEN 0 ELSE (buy + sell) / (buy + sell + unknown) END, 6) AS classified_ratio, round(CASE WHEN buy + sell <> 0 THEN (buy - sell) / (buy + sell) END, 6) AS delta_ratio FROM t""")
def session_pressure(spark, sf):
    c = _classified(spark, sf).withColumn("session", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return doubles(flow.pressure(c, ["instrument", "session"]), "buy", "sell", "unknown")


@query("session_cvd", f"""WITH {SIDE} SELECT instrument, ts, seq, sum(CASE side WHEN 'BUY' THEN size WHEN 'SELL' THEN -size ELSE 0 END) OVER (PARTITION BY instrument, date_trunc('day', ts) ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS cvd FROM cl""")
def session_cvd(spark, sf):
    return flow.cumulative_delta(_classified(spark, sf), F.date_trunc("day", "ts")).select("instrument", "ts", "seq", "cvd")


@query("router_counters", f"""WITH {SIDE} SELECT instrument, count(*) AS n_trades, sum(size)::DOUBLE AS volume, count(*) FILTER (qts IS NULL) AS no_quote, count(*) FILTER (reason = 'quote_stale') AS stale FROM cl GROUP BY 1""")
def router_counters(spark, sf):
    return _classified(spark, sf).groupBy("instrument").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("size").cast("double").alias("volume"), F.count_if(F.col("quote").isNull()).alias("no_quote"), F.count_if(F.col("reason") == "quote_stale").alias("stale"))


@query("sequence_gaps", f"""WITH {TR}, g AS (SELECT instrument, seq, max(seq) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM tr)
SELECT instrument, sum(CASE WHEN seq > top + 1 THEN seq - top - 1 ELSE 0 END)::BIGINT AS missing, count(*) FILTER (seq > top + 1) AS jumps FROM g GROUP BY 1""")
def sequence_gaps(spark, sf):
    return flow.sequence_gaps(S.trades(spark, sf), ["instrument"])


@query("large_trade_clusters", f"""WITH RECURSIVE {SIDE}, n AS (SELECT *, row_number() OVER w AS i, coalesce(lag(side) OVER w = side AND ts - lag(ts) OVER w <= INTERVAL 4 HOUR, false) AS goes_on FROM cl WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq)),
r AS (SELECT instrument, i, seq, side, seq AS first_seq, size::DOUBLE AS total, 1 AS prints, size >= 120 AS out FROM n WHERE i = 1
 UNION ALL SELECT n.instrument, n.i, n.seq, n.side, CASE WHEN n.goes_on AND NOT r.out THEN r.first_seq ELSE n.seq END, CASE WHEN n.goes_on AND NOT r.out THEN r.total ELSE 0 END + n.size::DOUBLE, CASE WHEN n.goes_on AND NOT r.out THEN r.prints ELSE 0 END + 1,
 CASE WHEN n.goes_on AND NOT r.out THEN r.total ELSE 0 END + n.size::DOUBLE >= 120 FROM r JOIN n ON n.instrument = r.instrument AND n.i = r.i + 1)
SELECT instrument, first_seq, seq AS last_seq, side, total AS size, prints::BIGINT AS print_count FROM r WHERE out AND side <> 'UNKNOWN'""")
def large_trade_clusters(spark, sf):
    return flow.large_trade_clusters(_classified(spark, sf), 4 * 3600 * 1000, 120.0)


@query("large_trade_threshold", f"WITH {SIDE} SELECT instrument, seq, side, size::DOUBLE AS size FROM cl WHERE side <> 'UNKNOWN' AND size >= 90")
def large_trade_threshold(spark, sf):
    return doubles(_classified(spark, sf).where("side <> 'UNKNOWN' AND size >= 90").select("instrument", "seq", "side", "size"), "size")


@query("bar_pressure_proxy", f"""WITH {BAR}, i AS (SELECT *, sum(nw) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(close_ts) OVER (PARTITION BY instrument ORDER BY open_ts) = open_ts THEN 0 ELSE 1 END AS nw FROM bar)),
w AS (SELECT instrument, open_ts, close, count(*) FILTER (close > open) OVER l AS up, count(*) FILTER (close < open) OVER l AS down, max(high) OVER l AS h, min(low) OVER l AS lo, count(*) OVER l AS n,
  avg(volume::DOUBLE) OVER l AS v, count(*) OVER b AS nb, median(volume::DOUBLE) OVER b AS m FROM i
  WINDOW l AS (PARTITION BY instrument, island ORDER BY open_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument, island ORDER BY open_ts ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING))
SELECT instrument, open_ts, up, down, CASE WHEN up > down THEN 'UPWARD' WHEN down > up THEN 'DOWNWARD' ELSE 'BALANCED' END AS direction,
 round(CASE WHEN h > lo THEN (close - lo)::DOUBLE / (h - lo)::DOUBLE ELSE 0.5 END, 6) AS close_location, round(CASE WHEN nb = 10 THEN v / m END, 6) AS pace FROM w WHERE n = 3""")
def bar_pressure_proxy(spark, sf):
    return flow.bar_pressure_proxy(islands(S.hourly_bars(spark, sf), ["instrument"], "open_ts", "close_ts"))


@query("latest_contiguous_run", f"""WITH {BAR}, i AS (SELECT *, sum(nw) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(close_ts) OVER (PARTITION BY instrument ORDER BY open_ts) = open_ts THEN 0 ELSE 1 END AS nw FROM bar))
SELECT instrument, min(open_ts) AS first_open, max(close_ts) AS last_close, count(*) AS n FROM i WHERE true GROUP BY instrument, island QUALIFY island = max(island) OVER (PARTITION BY instrument)""")
def latest_contiguous_run(spark, sf):
    runs = islands(S.hourly_bars(spark, sf), ["instrument"], "open_ts", "close_ts").groupBy("instrument", "island").agg(F.min("open_ts").alias("first_open"), F.max("close_ts").alias("last_close"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("_m", F.max("island").over(Window.partitionBy("instrument"))).where("island = _m").drop("_m", "island")
