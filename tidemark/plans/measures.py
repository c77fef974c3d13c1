"""Queries over quotes, completed bars, sessions, windows and rolling measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import measurements as M
from tidemark.operators import normalize
from tidemark.plans.catalog import BAR, FQ, dbl, doubles, query
from tidemark.sources import adapters as S

DAY = 86_400


def _bars(spark, sf):
    return M.with_utc_session(S.hourly_bars(spark, sf))


_EV = "['HEALTHY', 'DEGRADED', 'STALE', 'UNAVAILABLE'][seq % 4 + 1]"
_QM = f"""WITH {FQ}, e AS (SELECT instrument, ts, seq, {_EV} AS evidence, CASE WHEN seq % 7 = 0 THEN NULL ELSE CASE WHEN seq % 11 = 0 THEN ask + 1 ELSE bid END END AS bid, CASE WHEN seq % 13 = 0 THEN -ask ELSE ask END AS ask FROM fq),
u AS (SELECT *, coalesce(bid > 0 AND ask > 0 AND bid <= ask, false) AND evidence IN ('HEALTHY', 'DEGRADED') AS ok FROM e)
"""


@query("quote_metrics", _QM + """SELECT instrument, ts, seq, round(CASE WHEN ok THEN (bid::DOUBLE + ask::DOUBLE) / 2 END, 6) AS midpoint, round(CASE WHEN ok THEN ask::DOUBLE - bid::DOUBLE END, 6) AS spread_absolute,
 round(CASE WHEN ok THEN (ask::DOUBLE - bid::DOUBLE) / ((ask::DOUBLE + bid::DOUBLE) / 2) END, 6) AS spread_relative,
 CASE evidence WHEN 'HEALTHY' THEN CASE WHEN ok THEN 'READY' ELSE 'FAILED' END WHEN 'DEGRADED' THEN CASE WHEN ok THEN 'DEGRADED' ELSE 'FAILED' END WHEN 'STALE' THEN 'STALE' ELSE 'UNAVAILABLE' END AS health,
 concat_ws(',', CASE WHEN evidence <> 'HEALTHY' THEN 'evidence_' || lower(evidence) END, CASE WHEN bid IS NULL OR ask IS NULL THEN 'quote_side_missing' END, CASE WHEN bid <= 0 OR ask <= 0 THEN 'price_not_positive' END, CASE WHEN bid > ask THEN 'crossed_quote' END) AS missing_reasons FROM u""")
def quote_metrics(spark, sf):
    q, s = S.flow_quotes(spark, sf), F.col("seq")
    states = F.array(*map(F.lit, ["HEALTHY", "DEGRADED", "STALE", "UNAVAILABLE"]))
    e = q.withColumn("evidence", F.element_at(states, (s % 4 + 1).cast("int"))).withColumn("bid", F.when(s % 7 == 0, None).when(s % 11 == 0, (F.col("ask") + 1).cast(T.PRICE)).otherwise(F.col("bid"))).withColumn("ask", F.when(s % 13 == 0, (-F.col("ask")).cast(T.PRICE)).otherwise(F.col("ask")))
    return M.quote_metrics(e).drop("bid", "ask", "evidence")


_CBM = BAR + ", c AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY open_ts) AS prev FROM bar)"
_TRUE = "CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END::DOUBLE"


@query("completed_bar_metrics", f"WITH {_CBM} SELECT instrument, open_ts, {dbl('open', 'high', 'low', 'close', 'volume')}, round((close - prev)::DOUBLE / prev::DOUBLE, 6) AS simple_return, {_TRUE} AS true_range, CASE WHEN prev IS NULL THEN 'WARMING' ELSE 'READY' END AS health FROM c")
def completed_bar_metrics(spark, sf):
    out = M.completed_bar_metrics(S.hourly_bars(spark, sf))
    return doubles(out.select("instrument", "open_ts", "open", "high", "low", "close", "volume", "simple_return", "true_range", "health"), "open", "high", "low", "close", "volume")


@query("completed_bar_metric_values", f"""WITH {_CBM}, m AS (SELECT instrument, open_ts, {dbl('open', 'high', 'low', 'close', 'volume')}, round((close - prev)::DOUBLE / prev::DOUBLE, 6) AS simple_return, {_TRUE} AS true_range FROM c)
SELECT instrument, open_ts, unnest(['completed_bar.open', 'completed_bar.high', 'completed_bar.low', 'completed_bar.close', 'completed_bar.volume', 'completed_bar.simple_return', 'completed_bar.true_range']) AS metric_id, unnest([open, high, low, close, volume, simple_return, true_range]) AS value FROM m""")
def completed_bar_metric_values(spark, sf):
    return M.unpivot(M.completed_bar_metrics(S.hourly_bars(spark, sf)), ["instrument", "open_ts"], ["open", "high", "low", "close", "volume", "simple_return", "true_range"], "completed_bar")


for _basis, _sql in (("typical", "(high + low + close)::DOUBLE / 3"), ("close", "close::DOUBLE"), ("ohlc4", "(open + high + low + close)::DOUBLE / 4")):
    @query(f"session_vwap_{_basis}", f"WITH {BAR} SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, round(CASE WHEN sum(volume) <> 0 THEN sum({_sql} * volume::DOUBLE) / sum(volume::DOUBLE) END, 6) AS vwap FROM bar GROUP BY ALL")
    def _session_vwap(spark, sf, basis=_basis):
        return _bars(spark, sf).groupBy("instrument", "session").agg(M.vwap(basis).alias("vwap"))


_SUM = BAR + """, s AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ts) AS close, sum(volume)::DOUBLE AS volume,
 round(CASE WHEN sum(volume) <> 0 THEN sum((high + low + close)::DOUBLE / 3 * volume::DOUBLE) / sum(volume::DOUBLE) END, 6) AS vwap, round(count(*) * 3600 / 86400.0, 6)::DOUBLE AS coverage_ratio, bool_or(hour(open_ts) = 0) AS opening_observed FROM bar GROUP BY ALL)"""


@query("session_summary", f"""WITH {_SUM} SELECT instrument, session, {dbl('open', 'high', 'low', 'close')}, volume, vwap, coverage_ratio, opening_observed, (high - low)::DOUBLE AS range,
 round(CASE WHEN high = low THEN 0.5 ELSE (close - low)::DOUBLE / (high - low)::DOUBLE END, 6) AS location, CASE WHEN coverage_ratio >= 0.95 THEN 'READY' ELSE 'DEGRADED' END AS health,
 concat_ws(',', CASE WHEN coverage_ratio < 0.95 THEN 'coverage_below_minimum' END, CASE WHEN NOT opening_observed THEN 'opening_not_observed' END) AS missing_reasons FROM s""")
def session_summary(spark, sf):
    return doubles(M.session_summary(_bars(spark, sf), DAY, 0.95), "open", "high", "low", "close")


@query("session_gaps", f"""WITH {_SUM}, g AS (SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po FROM s WINDOW w AS (PARTITION BY instrument ORDER BY session))
SELECT instrument, session, pc::DOUBLE AS previous_close, (open - pc)::DOUBLE AS gap_points, round((open - pc)::DOUBLE / pc::DOUBLE, 6) AS gap_ratio, round((pc - po)::DOUBLE / po::DOUBLE, 6) AS previous_return FROM g""")
def session_gaps(spark, sf):
    return doubles(M.session_gaps(M.session_summary(_bars(spark, sf), DAY)).select("instrument", "session", "previous_close", "gap_points", "gap_ratio", "previous_return"), "previous_close")


def _window_sql(begin: int, hours: int) -> str:
    return f"""WITH {BAR}, w AS (SELECT *, date_trunc('day', open_ts)::TIMESTAMP AS session, hour(open_ts) >= {begin} AND hour(open_ts) < {begin + hours} AS i FROM bar),
v AS (SELECT *, CASE WHEN i THEN abs(close - lag(CASE WHEN i THEN close END) OVER (PARTITION BY instrument, session ORDER BY open_ts)) END AS step FROM w),
g AS (SELECT instrument, session, arg_min(open, open_ts) FILTER (i) AS open, max(high) FILTER (i) AS high, min(low) FILTER (i) AS low, arg_max(close, open_ts) FILTER (i) AS close, arg_min(close, open_ts) FILTER (i) AS first,
 arg_max(close, open_ts) AS latest_close, sum(step) AS path, count(*) FILTER (i) AS n, round(count(*) FILTER (i) * 3600 / {hours * 3600}.0, 6)::DOUBLE AS coverage_ratio FROM v GROUP BY ALL)
SELECT instrument, session, {dbl('open', 'high', 'low', 'close', 'latest_close')}, n, coverage_ratio, (high - low)::DOUBLE AS range, greatest(latest_close - high, 0)::DOUBLE AS distance_above_high, greatest(low - latest_close, 0)::DOUBLE AS distance_below_low,
 round(CASE WHEN n > 1 AND path <> 0 THEN abs(close - first)::DOUBLE / path::DOUBLE END, 6) AS directional_efficiency, coverage_ratio >= 1 AS complete FROM g WHERE n > 0"""


@query("opening_range", _window_sql(0, 2))
def opening_range(spark, sf):
    return doubles(M.analytical_window(_bars(spark, sf), 0, 7200, False, DAY), "open", "high", "low", "close", "latest_close")


@query("power_hours", _window_sql(20, 4))
def power_hours(spark, sf):
    return doubles(M.analytical_window(_bars(spark, sf), 0, 4 * 3600, True, DAY), "open", "high", "low", "close", "latest_close")


@query("interval_coverage", f"""WITH {BAR}, x AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, open_ts, close_ts FROM bar UNION ALL SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP, open_ts + INTERVAL 30 MINUTE, close_ts + INTERVAL 30 MINUTE FROM bar WHERE hour(open_ts) % 3 = 0),
g AS (SELECT *, max(close_ts) OVER (PARTITION BY instrument, session ORDER BY open_ts, close_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
h AS (SELECT *, sum(CASE WHEN reach IS NULL OR open_ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, session ORDER BY open_ts, close_ts ROWS UNBOUNDED PRECEDING) AS g FROM g),
m AS (SELECT instrument, session, g, epoch(max(close_ts)) - epoch(min(open_ts)) AS s FROM h GROUP BY ALL) SELECT instrument, session, sum(s)::DOUBLE AS covered_seconds FROM m GROUP BY ALL""")
def interval_coverage(spark, sf):
    bars = _bars(spark, sf).select("instrument", "session", "open_ts", "close_ts")
    half = F.expr("INTERVAL 30 MINUTES")
    more = bars.where(F.hour("open_ts") % 3 == 0).select("instrument", "session", (F.col("open_ts") + half).alias("open_ts"), (F.col("close_ts") + half).alias("close_ts"))
    return M.covered_seconds(bars.unionByName(more), ["instrument", "session"])


_ROLL = BAR + """, r AS (SELECT instrument, close_ts, epoch(close_ts)::BIGINT AS e, max(high) OVER w AS h, min(low) OVER w AS l, list({'h': high::DOUBLE, 'l': low::DOUBLE, 'c': close::DOUBLE}) OVER w AS i, count(*) OVER w AS n FROM bar
 WINDOW w AS (PARTITION BY instrument ORDER BY epoch(close_ts)::BIGINT RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW)),
o AS (SELECT instrument, close_ts, e, (h - l)::DOUBLE AS price_range, n, i, CASE WHEN n > 1 THEN list_sum([pow(ln(i[j].c / i[j - 1].c), 2) for j in range(2, n + 1)]) END AS q,
 coalesce(list_sum([greatest(i[j].h - i[j].l, abs(i[j].h - i[j - 1].c), abs(i[j].l - i[j - 1].c)) for j in range(2, n + 1)]), 0) AS t, list_sum([abs(i[j].c - i[j - 1].c) for j in range(2, n + 1)]) AS p FROM r)"""


@query("rolling_measurements", f"""WITH {_ROLL} SELECT instrument, close_ts, price_range, round(least(1.0, n * 3600 / 21600.0), 6)::DOUBLE AS coverage_ratio, n AS n_bars, round(sqrt(q), 6) AS realized_log_return_magnitude,
 round((i[1].h - i[1].l + t) / n, 6) AS average_true_range, round(CASE WHEN p <> 0 THEN abs(i[n].c - i[1].c) / p END, 6) AS directional_efficiency, n * 3600 >= 0.8 * 21600 AS eligible FROM o""")
def rolling_measurements(spark, sf):
    return M.rolling_windows(S.hourly_bars(spark, sf), 3600, 6 * 3600, 0.8).drop("_end")


_AGAINST = "count(x) AS reference_count, round(CASE WHEN count(x) >= {least} AND median(x) <> 0 THEN price_range / median(x) END, 6) AS expansion_ratio, round(CASE WHEN count(x) >= {least} THEN (count(*) FILTER (x < price_range) + count(*) FILTER (x = price_range) / 2) / count(x) END, 6) AS range_percentile"


@query("rolling_recent_baseline", f"""WITH {_ROLL}, cur AS (SELECT instrument, close_ts, e, price_range FROM o WHERE n * 3600 >= 0.8 * 21600),
k AS (SELECT cur.instrument, cur.e, k, (max(b.high) - min(b.low))::DOUBLE AS x, count(*) AS n FROM cur, range(1, 6) t(k), bar b WHERE b.instrument = cur.instrument AND epoch(b.close_ts) <= cur.e - k * 21600 AND epoch(b.open_ts) >= cur.e - (k + 1) * 21600 GROUP BY ALL HAVING count(*) * 3600 >= 0.8 * 21600)
SELECT cur.instrument, close_ts, price_range, {_AGAINST.format(least=3)} FROM cur LEFT JOIN k ON k.instrument = cur.instrument AND k.e = cur.e GROUP BY cur.instrument, close_ts, price_range""")
def rolling_recent_baseline(spark, sf):
    return M.recent_baseline(S.hourly_bars(spark, sf), 3600, 6 * 3600, 5, 0.8, 3).drop("_end")


@query("rolling_phase_baseline", f"""WITH {BAR}, b AS (SELECT *, date_trunc('day', open_ts)::TIMESTAMP AS session, (epoch(close_ts) - epoch(date_trunc('day', open_ts)::TIMESTAMP))::BIGINT AS o FROM bar),
cur AS (SELECT instrument, session, close_ts, o, (max(high) OVER w - min(low) OVER w)::DOUBLE AS price_range, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY instrument, session ORDER BY o RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) QUALIFY n * 3600 >= 0.9 * 10800),
p AS (SELECT c.instrument, c.session, c.o, b.session AS s, (max(b.high) - min(b.low))::DOUBLE AS x FROM cur c JOIN b ON b.instrument = c.instrument AND b.session < c.session AND b.o BETWEEN c.o - 7200 AND c.o GROUP BY ALL HAVING count(*) * 3600 >= 0.9 * 10800),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY instrument, session, o ORDER BY s DESC) <= 10)
SELECT c.instrument, c.session, c.close_ts, c.o AS "offset", price_range, {_AGAINST.format(least=5)} FROM cur c LEFT JOIN k USING (instrument, session, o) GROUP BY c.instrument, c.session, c.close_ts, c.o, price_range""")
def rolling_phase_baseline(spark, sf):
    return M.phase_baseline(_bars(spark, sf), 3600, 3 * 3600, 10, 0.9, 5)


@query("quote_rate_suppression", f"""WITH RECURSIVE {FQ}, n AS (SELECT instrument, ts, seq, row_number() OVER (PARTITION BY instrument ORDER BY ts, seq) AS i FROM fq),
r AS (SELECT instrument, ts, seq, i, true AS published, ts AS last FROM n WHERE i = 1
 UNION ALL SELECT n.instrument, n.ts, n.seq, n.i, n.ts - r.last >= INTERVAL 2 HOUR, CASE WHEN n.ts - r.last >= INTERVAL 2 HOUR THEN n.ts ELSE r.last END FROM r JOIN n ON n.instrument = r.instrument AND n.i = r.i + 1)
SELECT instrument, ts, seq, published FROM r""")
def quote_rate_suppression(spark, sf):
    return M.rate_suppressed(S.flow_quotes(spark, sf), 7_200_000)


@query("change_suppression", f"""WITH {BAR}, d AS (SELECT instrument, open_ts, CASE WHEN n_trades % 4 = 0 THEN NULL ELSE close > open END AS rising, n_trades >= 3 AS ready FROM bar)
SELECT * FROM d WINDOW w AS (PARTITION BY instrument ORDER BY open_ts) QUALIFY row_number() OVER w = 1 OR rising IS DISTINCT FROM lag(rising) OVER w OR ready <> lag(ready) OVER w""")
def change_suppression(spark, sf):
    d = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.when(F.col("n_trades") % 4 != 0, F.col("close") > F.col("open")).alias("rising"), (F.col("n_trades") >= 3).alias("ready"))
    return M.changed_only(d, "instrument", "open_ts", ["rising", "ready"])


@query("value_contract", """WITH v AS (SELECT event_id, ts AS observed_ts, ts + INTERVAL 1 SECOND * (CAST(json_extract(props, '$.k') AS BIGINT) % 3 - 1) AS received_ts, CASE WHEN user_id % 5 <> 0 THEN value END AS value,
 user_id % 2 = 0 AS reason, CASE WHEN user_id % 7 = 0 THEN 'FAILED' ELSE 'READY' END AS health FROM events)
SELECT event_id, concat_ws(',', CASE WHEN NOT observed_ts <= received_ts THEN 'time_order' END, CASE WHEN value IS NULL AND NOT reason THEN 'null_without_reason' END, CASE WHEN value IS NOT NULL AND health = 'FAILED' THEN 'value_under_bad_health' END) AS violations FROM v""")
def value_contract(spark, sf):
    u = F.col("user_id")
    recv = T.from_micros(T.micros(F.col("ts")) + (F.get_json_object("props", "$.k").cast("long") % 3 - 1) * 1_000_000)
    v = S.table(spark, sf, "events").select("event_id", F.col("ts").alias("observed_ts"), recv.alias("received_ts"), recv.alias("calculated_ts"), recv.alias("published_ts"), F.when(u % 5 != 0, F.col("value")).alias("value"),
                                            F.when(u % 2 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("missing_reasons"), F.when(u % 7 == 0, "FAILED").otherwise("READY").alias("health"))
    return normalize.value_contract(v).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("volume_conservation", f"""WITH {BAR}, v AS (SELECT instrument, open_ts, volume, CASE WHEN n_trades % 2 = 0 THEN volume ELSE 0 END AS b, CASE WHEN n_trades % 3 = 0 THEN 1 ELSE 0 END AS s FROM bar)
SELECT instrument, open_ts, (b - s)::DOUBLE AS delta, round(CASE WHEN volume = 0 THEN 0 ELSE (b + s)::DOUBLE / volume::DOUBLE END, 6) AS classified_ratio, b + s + (volume - b) = volume AS conserved FROM v""")
def volume_conservation(spark, sf):
    n = F.col("n_trades")
    b = S.hourly_bars(spark, sf).withColumn("buy_volume", F.when(n % 2 == 0, F.col("volume")).otherwise(F.lit(0)).cast(T.PRICE)).withColumn("sell_volume", F.when(n % 3 == 0, 1).otherwise(0).cast(T.PRICE)).withColumn("unknown_volume", F.col("volume") - F.col("buy_volume"))
    return doubles(normalize.volume_split(b).select("instrument", "open_ts", "delta", "classified_ratio", "conserved"), "delta")
