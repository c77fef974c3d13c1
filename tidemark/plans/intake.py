"""Queries over bar intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import intake as A
from tidemark.plans.catalog import BAR, dbl, doubles, query
from tidemark.plans.schedules import _PC, calendar
from tidemark.sources import adapters as S


def _framed(spark, sf):
    n = F.col("n_trades")
    tf = F.when(n % 7 == 0, "2h").when(n % 3 == 0, "4h").otherwise("1h")
    return S.hourly_bars(spark, sf).withColumns({"timeframe": tf, "source": F.when(n % 2 == 0, "classified_ticks").otherwise("provider"), "is_complete": n % 5 != 0})


_FRAMED = BAR + ", fb AS (SELECT * EXCLUDE (close_ts), CASE WHEN n_trades % 7 = 0 THEN '2h' WHEN n_trades % 3 = 0 THEN '4h' ELSE '1h' END AS timeframe, CASE WHEN n_trades % 2 = 0 THEN 'classified_ticks' ELSE 'provider' END AS source, n_trades % 5 <> 0 AS is_complete FROM bar)," \
    " ab AS (SELECT *, CASE timeframe WHEN '1h' THEN open_ts + INTERVAL 1 HOUR WHEN '4h' THEN open_ts + INTERVAL 4 HOUR END AS close_ts, CASE WHEN source = 'classified_ticks' THEN 'inferred' ELSE 'reported' END AS input_fidelity, CASE WHEN timeframe = '2h' THEN 'unsupported_timeframe' WHEN NOT is_complete THEN 'incomplete' END AS reject_reason FROM fb)"


@query("analysis_bar_adapters", f"WITH {_FRAMED} SELECT instrument, open_ts, close_ts, timeframe, input_fidelity, reject_reason FROM ab")
def analysis_bar_adapters(spark, sf):
    return A.analysis_bars(_framed(spark, sf)).select("instrument", "open_ts", "close_ts", "timeframe", "input_fidelity", "reject_reason")


@query("completed_bar_intake", f"""WITH {_PC}, {BAR}, r AS (SELECT instrument, open_ts AS ts_event, CASE WHEN instrument = 'click' THEN 'interval_end' WHEN instrument = 'error' THEN 'middle' ELSE 'interval_start' END AS policy, volume, n_trades % 4 <> 0 AS vs,
 CASE WHEN n_trades % 3 = 0 THEN 'live' ELSE 'historical' END AS kind, CASE WHEN n_trades % 2 = 0 THEN 'HEALTHY' ELSE 'STALE' END AS ev FROM bar),
i AS (SELECT *, CASE policy WHEN 'interval_start' THEN ts_event WHEN 'interval_end' THEN ts_event - INTERVAL 1 HOUR END AS s FROM r),
w AS (SELECT *, s + INTERVAL 1 HOUR AS e, s + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND AS l FROM i), nx AS (SELECT o AS at, trade_date AS nd FROM pc),
j AS (SELECT w.*, coalesce(p.phase, 'CLOSED') AS phase, p.trade_date AS td FROM w LEFT JOIN pc p ON l >= p.o AND l < p.c),
k AS (SELECT j.*, coalesce(td, nd) AS trade_date FROM j ASOF LEFT JOIN nx ON j.l < nx.at)
SELECT instrument, ts_event, s AS interval_start, e AS interval_end, trade_date, phase, CASE WHEN vs THEN volume::DOUBLE END AS volume, CASE WHEN vs THEN '' ELSE 'volume_unsupported' END AS missing_reasons, CASE WHEN kind = 'historical' OR ev = 'HEALTHY' THEN 'READY' ELSE 'STALE' END AS health,
 CASE WHEN kind = 'historical' OR ev = 'HEALTHY' THEN 'REPORTED' ELSE 'PARTIAL' END AS fidelity, CASE WHEN s IS NULL THEN 'unsupported_timestamp_policy' WHEN trade_date IS NULL THEN 'no_trade_date' END AS reject_reason FROM k""")
def completed_bar_intake(spark, sf):
    n, who = F.col("n_trades"), F.col("instrument")
    raw = S.hourly_bars(spark, sf).select("instrument", F.col("open_ts").alias("ts_event"), F.when(who == "click", "interval_end").when(who == "error", "middle").otherwise("interval_start").alias("policy"), "volume", (n % 4 != 0).alias("volume_supported"),
                                         F.when(n % 3 == 0, "live").otherwise("historical").alias("source_kind"), F.when(n % 2 == 0, "HEALTHY").otherwise("STALE").alias("evidence"), F.col("open_ts").alias("received_ts"))
    out = A.completed_bars(raw, calendar(spark, sf), 3600)
    return doubles(out.select("instrument", "ts_event", "interval_start", "interval_end", "trade_date", "phase", "volume", "missing_reasons", "health", "fidelity", "reject_reason"), "volume")


#: Bars in an order of arrival in which some come after their successors.
_ARR = BAR + ", ar AS (SELECT *, epoch(open_ts)::BIGINT // 3600 * 10 + CASE WHEN n_trades % 4 = 0 THEN 25 ELSE 0 END AS arrival FROM bar)"


def _arrivals(spark, sf):
    hour = F.floor(T.micros(F.col("open_ts")) / 3_600_000_000)
    return S.hourly_bars(spark, sf).withColumn("arrival", (hour * 10 + F.when(F.col("n_trades") % 4 == 0, 25).otherwise(0)).cast("long"))


@query("late_recalculations", f"""WITH {_ARR}, p AS (SELECT a.instrument, a.open_ts, a.arrival, b.open_ts AS po, b.arrival AS pa FROM ar a LEFT JOIN ar b ON a.instrument = b.instrument AND b.close_ts = a.open_ts)
SELECT instrument, arrival, open_ts, CASE WHEN pa < arrival THEN po END AS prior_open_ts FROM p UNION ALL SELECT instrument, pa, open_ts, po FROM p WHERE pa > arrival""")
def late_recalculations(spark, sf):
    return A.recalculations(_arrivals(spark, sf))


@query("seeded_restart_bars", f"""WITH {BAR}, c AS (SELECT time_bucket(INTERVAL 1 HOUR, max(ts) - INTERVAL 10 DAY) AS cut FROM events), u AS (SELECT *, time_bucket(INTERVAL 4 HOUR, open_ts) AS bucket FROM bar)
SELECT instrument, bucket, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in [('open', 'arg_min(open, open_ts)'), ('high', 'max(high)'), ('low', 'min(low)'), ('close', 'arg_max(close, open_ts)'), ('volume', 'sum(volume)')])} FROM u, c GROUP BY instrument, bucket, cut HAVING count(*) = 4 AND max(open_ts) >= cut""")
def seeded_restart_bars(spark, sf):
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", "open", "high", "low", "close", "volume")
    last = S.table(spark, sf, "events").agg(T.anchored_floor(F.max("ts") - F.expr("INTERVAL 10 DAYS"), 3600).alias("cut"))
    cut = bars.crossJoin(F.broadcast(last))  # one row
    return doubles(A.seeded_aggregate(cut.where("open_ts < cut").drop("cut"), cut.where("open_ts >= cut").drop("cut"), 3600, 14_400), "open", "high", "low", "close", "volume")


@query("bounded_observations", f"""WITH {BAR}, a AS (SELECT instrument, open_ts, close::DOUBLE AS v, epoch(open_ts)::BIGINT // 3600 * 10 AS ar, n_trades FROM bar),
x AS (SELECT instrument, open_ts, ar AS arrival, v, 'ACCEPTED' AS status FROM a UNION ALL SELECT instrument, open_ts, ar + 1, v, 'DUPLICATE' FROM a WHERE n_trades % 2 = 0 UNION ALL SELECT instrument, open_ts, ar + 2, v + 1, 'CONFLICT' FROM a WHERE n_trades % 3 = 0)
SELECT x.instrument, arrival, x.open_ts, status, CASE WHEN status = 'ACCEPTED' THEN g END AS evicted_ts FROM x JOIN (SELECT instrument, open_ts, lag(open_ts, 48) OVER (PARTITION BY instrument ORDER BY open_ts) AS g FROM a) USING (instrument, open_ts)""")
def bounded_observations(spark, sf):
    return A.bounded_store(bounded_rows(spark, sf), ["instrument"], 48, "instrument string")


def bounded_rows(spark, sf):
    a = _arrivals(spark, sf).select("instrument", "open_ts", F.col("close").cast("double").alias("v"), (F.floor(T.micros(F.col("open_ts")) / 3_600_000_000) * 10).alias("arrival"), "n_trades")
    at = F.col("arrival")
    rows = a.unionByName(a.where("n_trades % 2 = 0").withColumn("arrival", at + 1)).unionByName(a.where("n_trades % 3 = 0").withColumns({"arrival": at + 2, "v": F.col("v") + 1}))
    return rows.select("instrument", "arrival", "open_ts", F.col("v").cast("string").alias("payload"))


@query("session_book", f"""WITH {BAR}, s AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, {', '.join(f'{e}::DOUBLE AS {n}' for n, e in [('open', 'arg_min(open, open_ts)'), ('high', 'max(high)'), ('low', 'min(low)'), ('close', 'arg_max(close, open_ts)'), ('volume', 'sum(volume)')])}, count(*) AS n_bars, max(close_ts) AS last_ts FROM bar GROUP BY 1, 2)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY session DESC) <= 5""")
def session_book(spark, sf):
    bars = S.hourly_bars(spark, sf).withColumn("session", F.date_trunc("day", "open_ts").cast("timestamp_ntz"))
    return doubles(A.session_book(bars, 5), "open", "high", "low", "close", "volume")


_LIN = _FRAMED + """, li AS (SELECT instrument, timeframe, source, input_fidelity, open_ts, close_ts, sha256(concat_ws('|', strftime(open_ts, '%Y-%m-%d %H:%M:%S'), open::VARCHAR, high::VARCHAR, low::VARCHAR, close::VARCHAR, volume::VARCHAR)) AS h FROM ab WHERE reject_reason IS NULL),
ld AS (SELECT instrument, timeframe, source, input_fidelity, open_ts::DATE AS d, min(open_ts) AS a, max(close_ts) AS z, count(*) AS n, sha256(string_agg(h, ',' ORDER BY open_ts)) AS h FROM li GROUP BY ALL),
ln AS (SELECT instrument, timeframe, source, input_fidelity, min(a) AS start_ts, max(z) AS end_ts, sum(n)::BIGINT AS event_count, sha256(string_agg(h, ',' ORDER BY d)) AS identity_hash FROM ld GROUP BY ALL)"""


def _lineages(spark, sf):
    return A.lineages(A.analysis_bars(_framed(spark, sf)).where("reject_reason IS NULL"))


@query("bar_lineages", f"WITH {_LIN} SELECT * FROM ln")
def bar_lineages(spark, sf):
    return _lineages(spark, sf)


@query("feature_envelopes", f"""WITH {_LIN}, np AS (SELECT instrument, string_agg(i, ',' ORDER BY i) AS inputs, count(*) AS n_inputs FROM (SELECT instrument, concat_ws('~', source, timeframe, strftime(start_ts, '%Y-%m-%d %H:%M:%S'), strftime(end_ts, '%Y-%m-%d %H:%M:%S'), identity_hash, input_fidelity, event_count::VARCHAR) AS i FROM ln) GROUP BY 1),
f AS (SELECT bar.instrument, close_ts AS as_of, n_inputs, sha256(concat_ws('|', 'context', 'v3', 'cfg', bar.instrument, '1h', strftime(close_ts, '%Y-%m-%d %H:%M:%S'), 'market_context', 'mixed', inputs)) AS feature_id, close::VARCHAR AS payload FROM bar JOIN np USING (instrument))
SELECT instrument, as_of, n_inputs, feature_id, sha256(concat_ws('|', feature_id, payload)) AS content_hash FROM f""")
def feature_envelopes(spark, sf):
    snap = S.hourly_bars(spark, sf).select("instrument", F.lit("1h").alias("timeframe"), F.col("close_ts").alias("as_of"), F.lit("market_context").alias("source"), F.lit("mixed").alias("input_fidelity"), F.col("close").cast("string").alias("payload"))
    return A.feature_envelopes(snap, _lineages(spark, sf), "context", "v3", "cfg").select("instrument", "as_of", "n_inputs", "feature_id", "content_hash")
