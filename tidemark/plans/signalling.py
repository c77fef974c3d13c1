"""Queries over signals, evidence and health."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.functions.carry import islands, previous
from tidemark.operators import indicators as I
from tidemark.operators import measurements as M
from tidemark.operators import signals as G
from tidemark.plans.catalog import BAR, FT, SIDE, TR, query
from tidemark.plans.context import _EMA
from tidemark.sources import adapters as S

_BUNDLE = f"""{BAR}, bd AS (SELECT instrument, open_ts, CASE WHEN n_trades % 9 <> 0 THEN sign(close - open) END AS evaluation, CASE WHEN n_trades % 8 <> 0 THEN sign(close - lag(close, 2) OVER w) END AS primary1, sign(close - lag(close, 1) OVER w) AS primary2,
 sign(high - lag(high) OVER w) AS confirm, sign(low - lag(low, 3) OVER w) AS context FROM bar WINDOW w AS (PARTITION BY instrument ORDER BY open_ts)),
q AS (SELECT *, CASE WHEN evaluation IS NULL THEN 'evaluation_missing' WHEN primary1 IS NULL OR primary2 IS NULL THEN 'primary_missing' WHEN primary1 = 0 OR primary2 = 0 THEN 'neutral' WHEN primary1 <> primary2 THEN 'disagreement'
 WHEN confirm IS NULL OR confirm <> primary1 THEN 'unconfirmed' WHEN context = -primary1 THEN 'context_opposed' ELSE 'qualified' END AS reason FROM bd),
dir AS (SELECT instrument, open_ts, reason, CASE WHEN reason IN ('qualified', 'context_opposed') THEN CASE WHEN primary1 > 0 THEN 'LONG' ELSE 'SHORT' END END AS direction, reason = 'context_opposed' AS degraded FROM q)"""


def _directions(spark, sf):
    w = Window.partitionBy("instrument").orderBy("open_ts")
    n, sg = F.col("n_trades"), lambda a, b: F.signum((a - b).cast("double"))
    b = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.when(n % 9 != 0, sg(F.col("close"), F.col("open"))).alias("evaluation"), F.when(n % 8 != 0, sg(F.col("close"), F.lag("close", 2).over(w))).alias("primary1"), sg(F.col("close"), F.lag("close").over(w)).alias("primary2"), sg(F.col("high"), F.lag("high").over(w)).alias("confirm"), sg(F.col("low"), F.lag("low", 3).over(w)).alias("context"))
    return G.qualify_direction(b)


@query("direction_qualification", f"WITH {_BUNDLE} SELECT * FROM dir")
def direction_qualification(spark, sf):
    return _directions(spark, sf).select("instrument", "open_ts", "reason", "direction", "degraded")


@query("direction_regimes", f"""WITH {_BUNDLE}, r AS (SELECT instrument, open_ts, direction, last(direction IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY open_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, last(direction IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS regime FROM dir)
SELECT instrument, open_ts, regime, direction IS NOT NULL AND direction IS DISTINCT FROM prev AS new_candidate FROM r""")
def direction_regimes(spark, sf):
    return G.regimes(_directions(spark, sf), "instrument", "open_ts").select("instrument", "open_ts", "regime", "new_candidate")


@query("context_transitions", _EMA + """, b AS (SELECT *, lag(ema20, 5) OVER (PARTITION BY instrument ORDER BY open_ts) AS back FROM m),
s AS (SELECT instrument, open_ts, CASE WHEN i < 50 OR ema50 IS NULL THEN 'insufficient' WHEN close > ema20 AND ema20 > ema50 AND ema20 > back THEN 'bullish' WHEN close < ema20 AND ema20 < ema50 AND ema20 < back THEN 'bearish' ELSE 'range' END AS t FROM b),
x AS (SELECT instrument, open_ts, lag(t) OVER (PARTITION BY instrument ORDER BY open_ts) AS from_state, t AS to_state FROM s WHERE t <> 'insufficient') SELECT * FROM x WHERE from_state IS NOT NULL AND from_state <> to_state""")
def context_transitions(spark, sf):
    t = I.trend(I.ema(S.hourly_bars(spark, sf), [20, 50]))
    return G.transitions(t, ["instrument"], "open_ts", "trend", ["insufficient"])


_SPLIT = f"""{BAR}, i AS (SELECT *, sum(nw) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS island, CASE WHEN close >= open THEN volume ELSE 0 END AS b, CASE WHEN close < open AND n_trades % 4 <> 0 THEN volume ELSE 0 END AS s FROM (SELECT *, CASE WHEN lag(close_ts) OVER (PARTITION BY instrument ORDER BY open_ts) = open_ts THEN 0 ELSE 1 END AS nw FROM bar))"""


@query("aggression_confirmation", f"""WITH {_SPLIT}, w AS (SELECT instrument, open_ts, close::DOUBLE AS c, first(open::DOUBLE) OVER w AS o, sum(b::DOUBLE) OVER w AS b, sum(s::DOUBLE) OVER w AS s, sum(volume::DOUBLE) OVER w AS v, avg(high::DOUBLE - low::DOUBLE) OVER w AS u, min(low::DOUBLE) OVER w AS lo, count(*) OVER w AS n FROM i
 WINDOW w AS (PARTITION BY instrument, island ORDER BY open_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT instrument, open_ts, round(CASE WHEN v <> 0 THEN (b + s) / v ELSE 0 END, 6) AS classified_ratio, round(CASE WHEN b + s <> 0 THEN (b - s) / (b + s) ELSE 0 END, 6) AS delta_ratio, round(CASE WHEN u <> 0 THEN (c - o) / u ELSE 0 END, 6) AS follow, round(CASE WHEN u <> 0 THEN greatest(o - lo, 0) / u ELSE 0 END, 6) AS adverse FROM w WHERE n = 3)
SELECT *, concat_ws(',', CASE WHEN classified_ratio < 0.7 THEN 'classified_ratio' END, CASE WHEN delta_ratio < 0.1 THEN 'delta' END, CASE WHEN follow < 0.1 THEN 'follow_through' END, CASE WHEN adverse > 1 THEN 'adverse_move' END) AS failures FROM r""")
def aggression_confirmation(spark, sf):
    bars = islands(S.hourly_bars(spark, sf), ["instrument"], "open_ts", "close_ts")
    up = F.col("close") >= F.col("open")
    bars = bars.withColumn("buy_volume", F.when(up, F.col("volume")).otherwise(F.lit(0))).withColumn("sell_volume", F.when(~up & (F.col("n_trades") % 4 != 0), F.col("volume")).otherwise(F.lit(0)))
    return G.confirmation_window(bars, 3, 0.7, 0.1, 1).select("instrument", "open_ts", "classified_ratio", "delta_ratio", "follow", "adverse", "failures")


@query("pace_ratio", f"""WITH {BAR} SELECT instrument, open_ts, round(CASE WHEN count(*) OVER b = 10 THEN avg(volume::DOUBLE) OVER l / median(volume::DOUBLE) OVER b END, 6) AS pace FROM bar
 WINDOW l AS (PARTITION BY instrument ORDER BY open_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b AS (PARTITION BY instrument ORDER BY open_ts ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING)""")
def pace_ratio(spark, sf):
    return G.pace(S.hourly_bars(spark, sf), 3, 10).select("instrument", "open_ts", "pace")


@query("location_episodes")
def location_episodes(spark, sf):
    bars = I.range_position(M.with_utc_session(S.hourly_bars(spark, sf)))
    rows = bars.select("instrument", "session", F.col("open_ts").alias("ts"), (F.col("range_position") < 0.5).alias("inside"), F.signum((F.col("close") - F.col("open")).cast("double")).cast("int").alias("favourable"))
    return G.episodes(rows, 2)


@query("lifecycle_chain", """WITH s AS (SELECT user_id, event_id, ['candidate', 'armed', 'triggered'][event_id % 3 + 1] AS f, ['armed', 'triggered', 'invalidated', 'expired'][(event_id // 3) % 4 + 1] AS t FROM events),
c AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM s)
SELECT user_id, event_id, coalesce(p = f, f = 'candidate') AS chained, (f = 'candidate' AND t IN ('armed', 'expired')) OR (f = 'armed' AND t IN ('triggered', 'invalidated', 'expired')) OR (f = 'triggered' AND t IN ('invalidated', 'expired')) AS allowed FROM c""")
def lifecycle_chain(spark, sf):
    i = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    s = S.table(spark, sf, "events").select("user_id", "event_id", pick(["candidate", "armed", "triggered"], i % 3).alias("from_status"), pick(["armed", "triggered", "invalidated", "expired"], F.floor(i / 3) % 4).alias("to_status"))
    return G.lifecycle_check(s, "user_id", "event_id").select("user_id", "event_id", "chained", "allowed")


_GAP = f"WITH RECURSIVE {TR}, g AS (SELECT instrument, seq, epoch(ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq))::DOUBLE AS x FROM tr), n AS (SELECT instrument, x, row_number() OVER (PARTITION BY instrument ORDER BY seq) AS i FROM g WHERE x IS NOT NULL)," \
    " r AS (SELECT instrument, i, x AS m, 0.0::DOUBLE AS v FROM n WHERE i = 1 UNION ALL SELECT n.instrument, n.i, r.m + (1 - 0.95::DOUBLE) * (n.x - r.m), 0.95::DOUBLE * (r.v + (1 - 0.95::DOUBLE) * (n.x - r.m) * (n.x - r.m)) FROM r JOIN n ON n.instrument = r.instrument AND n.i = r.i + 1)," \
    " p AS (SELECT instrument, max(i) AS samples, round(arg_max(m, i), 3) AS mean, round(arg_max(v, i), 2) AS variance FROM r GROUP BY 1)"


def _profiles(spark, sf):
    t = previous(S.trades(spark, sf), ["instrument"], ["ts", "seq"], {"before": F.col("ts")})
    g = t.select("instrument", "seq", ((T.micros(F.col("ts")) - T.micros(F.col("before"))) / 1e6).alias("x")).where("x IS NOT NULL")
    return G.recency(g, "instrument", "seq", "x").withColumn("mean", F.round("mean", 3)).withColumn("variance", F.round("variance", 2))


@query("evidence_recency_profile", _GAP + " SELECT instrument, samples, mean, variance FROM p")
def evidence_recency_profile(spark, sf):
    return _profiles(spark, sf)


@query("evidence_thresholds", _GAP + """, t AS (SELECT instrument, greatest(round_even(mean + 2 * sqrt(variance), 0), 1.0) AS d, round_even(mean + 4 * sqrt(variance), 0) AS s0, round_even(mean + 8 * sqrt(variance), 0) AS u0 FROM p)
SELECT instrument, d::DOUBLE AS degraded_after, greatest(s0, d + 1)::DOUBLE AS stale_after, greatest(u0, greatest(s0, d + 1) + 1)::DOUBLE AS unavailable_after FROM t""")
def evidence_thresholds(spark, sf):
    return G.adaptive_thresholds(_profiles(spark, sf)).select("instrument", "degraded_after", "stale_after", "unavailable_after")


@query("evidence_assessment", f"""WITH {TR}, a AS (SELECT instrument, ts, seq, epoch(ts - lag(ts) OVER (PARTITION BY instrument ORDER BY ts, seq)) AS age FROM tr)
SELECT instrument, ts, seq, CASE WHEN hour(ts) < 2 THEN 'DORMANT' WHEN seq % 17 = 0 THEN 'UNAVAILABLE' WHEN age IS NULL THEN 'NOT_EVALUATED' WHEN age <= 600 THEN 'HEALTHY' WHEN age <= 1800 THEN 'DEGRADED' WHEN age <= 5400 THEN 'STALE' ELSE 'UNAVAILABLE' END AS state FROM a""")
def evidence_assessment(spark, sf):
    age = (T.micros(F.col("ts")) - T.micros(F.col("before"))) / 1e6
    a = previous(S.trades(spark, sf), ["instrument"], ["ts", "seq"], {"before": F.col("ts")}).withColumn("age", age)
    return a.select("instrument", "ts", "seq", G.assess_evidence(F.col("age"), F.col("seq") % 17 != 0, F.hour("ts") >= 2, 600, 1800, 5400).alias("state"))


@query("resource_health_hysteresis", f"""WITH {TR}, m AS (SELECT instrument, ts, seq, CASE WHEN price > 180 AND lag(price) OVER w > 180 THEN 'raised' WHEN price < 120 THEN 'cleared' END AS event FROM tr WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq))
SELECT instrument, ts, seq, event FROM m WHERE event IS NOT NULL QUALIFY event <> coalesce(lag(event) OVER (PARTITION BY instrument ORDER BY ts, seq), 'cleared')""")
def resource_health_hysteresis(spark, sf):
    t = S.trades(spark, sf).select("instrument", "ts", "seq", F.col("price").cast("double").alias("price"))
    return G.hysteresis(t, "instrument", ["ts", "seq"], "price", 180.0, 120.0, 2)


@query("aggression_first_hit", f"""WITH {FT}, e AS (SELECT seq AS id, instrument, ts, price, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ft WHERE size >= 60),
h AS (SELECT e.id, ft.ts, ft.seq, CASE WHEN sign * (ft.price - e.price) >= 20 THEN 'with_flow' WHEN sign * (ft.price - e.price) <= -20 THEN 'trapped' END AS h FROM e JOIN ft ON ft.instrument = e.instrument AND ft.ts BETWEEN e.ts AND e.ts + INTERVAL 4 HOUR AND ft.seq > e.id),
g AS (SELECT id, arg_min(h, (ts, seq)) AS outcome FROM h WHERE h IS NOT NULL GROUP BY 1) SELECT e.id, e.instrument, coalesce(outcome, 'unresolved') AS outcome FROM e LEFT JOIN g USING (id)""")
def aggression_first_hit(spark, sf):
    ft = S.flow_trades(spark, sf)
    e = ft.where("size >= 60").select(F.col("seq").alias("id"), "instrument", "ts", "price", F.when(F.col("seq") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return G.first_hit(e, ft, 20.0, 4 * 3600)


@query("analytics_readiness", f"""WITH {BAR}, t AS (SELECT date_trunc('day', max(ts)) - INTERVAL '227:30:00' AS n FROM events), l AS (SELECT instrument, max(close_ts) AS close_ts, count(*) AS depth FROM bar, t WHERE open_ts < n - INTERVAL 1 HOUR * length(instrument) GROUP BY 1)
SELECT l.*, ceil(epoch(n - close_ts) / 3600)::BIGINT AS lag_intervals, CASE WHEN ceil(epoch(n - close_ts) / 3600) <= 5 THEN 'current' ELSE 'lagging' END AS freshness, CASE WHEN depth >= 440 THEN 'full' WHEN depth >= 50 THEN 'partial' ELSE 'insufficient' END AS depth_status FROM l, t""")
def analytics_readiness(spark, sf):
    day = F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")
    now = F.broadcast(S.table(spark, sf, "events").agg(T.from_micros(T.micros(day) - 819_000_000_000).alias("n")))  # one row
    b = S.hourly_bars(spark, sf).crossJoin(now).where(T.micros(F.col("open_ts")) < T.micros(F.col("n")) - 3_600_000_000 * F.length("instrument"))
    latest = b.groupBy("instrument").agg(F.max("close_ts").alias("close_ts"), F.count(F.lit(1)).alias("depth"), F.first("n").alias("n"))
    return G.readiness(latest, F.col("n"), 3600, 5, 440, 50).drop("n")


@query("classified_hourly_split", f"""WITH {SIDE} SELECT instrument, date_trunc('hour', ts) AS open_ts, coalesce(sum(size) FILTER (side = 'BUY'), 0)::DOUBLE AS buy, coalesce(sum(size) FILTER (side = 'SELL'), 0)::DOUBLE AS sell, coalesce(sum(size) FILTER (side = 'UNKNOWN'), 0)::DOUBLE AS unknown FROM cl GROUP BY ALL""")
def classified_hourly_split(spark, sf):
    from tidemark.plans.bars_and_flow import _classified

    v = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(F.lit(0))).cast("double").alias(s.lower())
    return _classified(spark, sf).groupBy("instrument", T.anchored_floor(F.col("ts"), 3600).alias("open_ts")).agg(v("BUY"), v("SELL"), v("UNKNOWN"))
