"""Queries over indicators, profiles and calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import calendars as K
from tidemark.operators import indicators as I
from tidemark.operators import measurements as M
from tidemark.operators import profile as P
from tidemark.plans.catalog import BAR, dbl, doubles, query
from tidemark.sources import adapters as S


def _bars(spark, sf):
    return M.with_utc_session(S.hourly_bars(spark, sf))


_EMA = f"""WITH RECURSIVE {BAR}, n AS (SELECT instrument, open_ts, close::DOUBLE AS close, row_number() OVER (PARTITION BY instrument ORDER BY open_ts) AS i FROM bar),
e AS (SELECT instrument, open_ts, close, i, close AS e20, close AS e50, close AS e200 FROM n WHERE i = 1
 UNION ALL SELECT n.instrument, n.open_ts, n.close, n.i, n.close * (2.0::DOUBLE / 21) + e.e20 * (1 - 2.0::DOUBLE / 21), n.close * (2.0::DOUBLE / 51) + e.e50 * (1 - 2.0::DOUBLE / 51), n.close * (2.0::DOUBLE / 201) + e.e200 * (1 - 2.0::DOUBLE / 201)
 FROM e JOIN n ON n.instrument = e.instrument AND n.i = e.i + 1),
m AS (SELECT instrument, open_ts, close, i, round(CASE WHEN i >= 20 THEN e20 END, 6) AS ema20, round(CASE WHEN i >= 50 THEN e50 END, 6) AS ema50, round(CASE WHEN i >= 200 THEN e200 END, 6) AS ema200 FROM e)"""


@query("ema_stack", _EMA + " SELECT instrument, open_ts, close, ema20, ema50, ema200 FROM m")
def ema_stack(spark, sf):
    return I.ema(S.hourly_bars(spark, sf), [20, 50, 200])


@query("trend_state", _EMA + """, b AS (SELECT *, lag(ema20, 5) OVER (PARTITION BY instrument ORDER BY open_ts) AS back FROM m)
SELECT instrument, open_ts, CASE WHEN i < 50 OR ema50 IS NULL THEN 'insufficient' WHEN close > ema20 AND ema20 > ema50 AND ema20 > back THEN 'bullish' WHEN close < ema20 AND ema20 < ema50 AND ema20 < back THEN 'bearish' ELSE 'range' END AS trend FROM b""")
def trend_state(spark, sf):
    return I.trend(I.ema(S.hourly_bars(spark, sf), [20, 50])).select("instrument", "open_ts", "trend")


_ATR = BAR + """, t AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END::DOUBLE AS tr FROM bar WINDOW w AS (PARTITION BY instrument ORDER BY open_ts)),
atr AS (SELECT *, round(CASE WHEN count(*) OVER l = 14 THEN avg(tr) OVER l END, 6) AS atr FROM t WINDOW l AS (PARTITION BY instrument ORDER BY open_ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""


@query("atr14", f"WITH {_ATR} SELECT instrument, open_ts, atr FROM atr")
def atr14(spark, sf):
    return I.atr(S.hourly_bars(spark, sf)).select("instrument", "open_ts", "atr")


@query("fair_value_gaps", f"""WITH {BAR}, b AS (SELECT * FROM bar QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) <= 500),
g AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, min(low) OVER f AS lo, max(high) OVER f AS hi FROM b WINDOW w AS (PARTITION BY instrument ORDER BY open_ts), f AS (PARTITION BY instrument ORDER BY open_ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
a AS (SELECT instrument, open_ts, CASE WHEN low > h2 THEN 'bullish' ELSE 'bearish' END AS direction, CASE WHEN low > h2 THEN h2 ELSE high END AS lower, CASE WHEN low > h2 THEN low ELSE l2 END AS upper FROM g WHERE (low > h2 AND NOT coalesce(lo <= h2, false)) OR (high < l2 AND NOT coalesce(hi >= l2, false)))
SELECT instrument, open_ts, direction, {dbl('lower', 'upper')} FROM a QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) <= 10""")
def fair_value_gaps(spark, sf):
    return doubles(I.fair_value_gaps(S.hourly_bars(spark, sf)), "lower", "upper")


_SWING = BAR + """, b AS (SELECT * FROM bar QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) <= 500),
x AS (SELECT *, least(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w) AS ll, greatest(lag(low, 1) OVER w, lag(low, 2) OVER w, lead(low, 1) OVER w, lead(low, 2) OVER w) AS lm,
 least(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w) AS hl, greatest(lag(high, 1) OVER w, lag(high, 2) OVER w, lead(high, 1) OVER w, lead(high, 2) OVER w) AS hm,
 lag(low, 2) OVER w IS NOT NULL AND lead(low, 2) OVER w IS NOT NULL AS whole FROM b WINDOW w AS (PARTITION BY instrument ORDER BY open_ts)),
lv AS (SELECT instrument, open_ts, 'support' AS kind, low AS price FROM x WHERE whole AND low <= ll AND low < lm UNION ALL SELECT instrument, open_ts, 'resistance', high FROM x WHERE whole AND high >= hm AND high > hl),
levels AS (SELECT instrument, kind, price, count(*) AS touches, max(open_ts) AS latest_ts FROM lv GROUP BY ALL)"""


@query("swing_levels", f"WITH {_SWING} SELECT instrument, kind, price::DOUBLE AS price, touches, latest_ts FROM levels")
def swing_levels(spark, sf):
    return doubles(I.swing_levels(S.hourly_bars(spark, sf)), "price")


@query("nearest_levels", f"""WITH {_SWING}, c AS (SELECT instrument, arg_max(close, open_ts) AS close FROM bar GROUP BY 1)
SELECT c.instrument, close::DOUBLE AS close, max(price) FILTER (kind = 'support' AND price <= close)::DOUBLE AS support, min(price) FILTER (kind = 'resistance' AND price >= close)::DOUBLE AS resistance FROM c LEFT JOIN levels USING (instrument) GROUP BY c.instrument, close""")
def nearest_levels(spark, sf):
    bars = S.hourly_bars(spark, sf)
    closes = bars.groupBy("instrument").agg(F.max_by("close", "open_ts").alias("close"))
    return doubles(I.nearest_levels(closes, I.swing_levels(bars)), "close", "support", "resistance")


@query("range_position", f"""WITH {BAR}, p AS (SELECT instrument, open_ts, close, max(high) OVER w AS h, min(low) OVER w AS l FROM bar WINDOW w AS (PARTITION BY instrument, date_trunc('day', open_ts) ORDER BY open_ts ROWS UNBOUNDED PRECEDING))
SELECT instrument, open_ts, round(CASE WHEN h = l THEN 0.5 ELSE least(greatest((close - l)::DOUBLE / (h - l)::DOUBLE, 0), 1) END, 6) AS range_position FROM p""")
def range_position(spark, sf):
    return I.range_position(_bars(spark, sf)).select("instrument", "open_ts", "range_position")


_PROF = BAR + """, sp AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, volume AS v, floor(low / 5)::BIGINT AS lo, ceil(high / 5)::BIGINT AS hi FROM bar {where}),
ex AS (SELECT instrument, session, v, hi - lo + 1 AS n, unnest(range(lo, hi + 1)) AS bin, hi FROM sp),
bins AS (SELECT {keys}, bin * 5 AS price, sum(CASE WHEN bin = hi THEN v - CAST(round(v::DOUBLE / n, 6) AS DECIMAL(18,6)) * (n - 1) ELSE CAST(round(v::DOUBLE / n, 6) AS DECIMAL(18,6)) END)::DOUBLE AS volume FROM ex GROUP BY ALL)"""
_AREA = """, pk AS (SELECT {keys}, list(price ORDER BY price) AS ps, list(volume ORDER BY price) AS vs, sum(volume::DECIMAL(18,6))::DOUBLE AS total, arg_max(price, (volume, price)) AS poc FROM bins GROUP BY ALL),
g AS (SELECT {keys}, ps, vs, total, poc, list_position(ps, poc)::BIGINT AS l, list_position(ps, poc)::BIGINT AS r, vs[list_position(ps, poc)] AS inc FROM pk
 UNION ALL SELECT {keys}, ps, vs, total, poc, CASE WHEN l > 1 AND (r >= len(ps) OR vs[l - 1] >= vs[r + 1]) THEN l - 1 ELSE l END, CASE WHEN l > 1 AND (r >= len(ps) OR vs[l - 1] >= vs[r + 1]) THEN r ELSE r + 1 END,
  inc + CASE WHEN l > 1 AND (r >= len(ps) OR vs[l - 1] >= vs[r + 1]) THEN vs[l - 1] ELSE vs[r + 1] END FROM g WHERE inc < 0.7 * total AND (l > 1 OR r < len(ps))),
area AS (SELECT {keys}, arg_max(poc, r - l) AS poc, arg_max(ps[l], r - l) AS value_area_low, arg_max(ps[r], r - l) AS value_area_high, max(total) AS total_volume, max(len(ps))::BIGINT AS n_bins FROM g GROUP BY ALL)"""


@query("volume_profile_bins", f"WITH {_PROF.format(keys='instrument, session', where='')} SELECT * FROM bins")
def volume_profile_bins(spark, sf):
    return P.profile_bins(_bars(spark, sf), ["instrument", "session"], 5)


@query("session_value_area", f"WITH RECURSIVE {_PROF.format(keys='instrument, session', where='')}{_AREA.format(keys='instrument, session')} SELECT * FROM area")
def session_value_area(spark, sf):
    return P.value_area(P.profile_bins(_bars(spark, sf), ["instrument", "session"], 5), ["instrument", "session"])


@query("composite_value_area", f"WITH RECURSIVE {_PROF.format(keys='instrument', where='QUALIFY dense_rank() OVER (PARTITION BY instrument ORDER BY date_trunc(chr(100) || chr(97) || chr(121), open_ts) DESC) <= 5')}{_AREA.format(keys='instrument')} SELECT * FROM area")
def composite_value_area(spark, sf):
    bars = _bars(spark, sf).withColumn("_r", F.dense_rank().over(Window.partitionBy("instrument").orderBy(F.desc("session")))).where("_r <= 5")
    return P.value_area(P.profile_bins(bars, ["instrument"], 5), ["instrument"])


@query("profile_location", f"""WITH RECURSIVE {_PROF.format(keys='instrument, session', where='')}{_AREA.format(keys='instrument, session')}, c AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, arg_max(close, open_ts)::DOUBLE AS close FROM bar GROUP BY ALL),
r AS (SELECT instrument, session, close, CASE WHEN close < value_area_low THEN 'below_value' WHEN close > value_area_high THEN 'above_value' WHEN abs(close - poc) <= 2.5 THEN 'at_poc' WHEN close < poc THEN 'lower_value' ELSE 'upper_value' END AS region FROM c JOIN area USING (instrument, session))
SELECT *, CASE region WHEN 'above_value' THEN 2 WHEN 'upper_value' THEN 1 WHEN 'at_poc' THEN 0 WHEN 'lower_value' THEN -1 ELSE -2 END AS score FROM r""")
def profile_location(spark, sf):
    bars, keys = _bars(spark, sf), ["instrument", "session"]
    closes = bars.groupBy(*keys).agg(F.max_by("close", "open_ts").cast("double").alias("close"))
    return P.profile_location(closes.join(P.value_area(P.profile_bins(bars, keys, 5), keys), keys), 5).select("instrument", "session", "close", "region", "score")


_CAL = """d AS (SELECT unnest(range((SELECT min(ts) FROM events)::DATE::TIMESTAMP, (SELECT max(ts) FROM events)::DATE::TIMESTAMP + INTERVAL 8 DAY, INTERVAL 1 DAY)) AS trade_date),
cal AS (SELECT trade_date, 'PRE' AS phase, trade_date + INTERVAL 8 HOUR AS o, trade_date + INTERVAL '13:30:00' AS c FROM d WHERE isodow(trade_date) <= 5 UNION ALL SELECT trade_date, 'REGULAR', trade_date + INTERVAL '13:30:00', trade_date + INTERVAL 20 HOUR FROM d WHERE isodow(trade_date) <= 5
 UNION ALL SELECT trade_date, 'POST', trade_date + INTERVAL 20 HOUR, trade_date + INTERVAL '23:59:59' FROM d WHERE isodow(trade_date) <= 5)"""


def _calendar(spark, sf):
    """Phases of the days that the events cover and of the week after."""
    first, last = S.table(spark, sf, "events").agg(F.to_date(F.min("ts")), F.date_add(F.to_date(F.max("ts")), 7)).first()
    return K.phases(spark, str(first), str(last))


@query("session_calendar", f"WITH {_CAL} SELECT trade_date, phase, o AS open_ts, c AS close_ts FROM cal")
def session_calendar(spark, sf):
    return _calendar(spark, sf)


@query("session_phase_of_events", f"WITH {_CAL} SELECT event_id, ts, trade_date, coalesce(phase, 'CLOSED') AS phase FROM events LEFT JOIN cal ON ts >= o AND ts < c")
def session_phase_of_events(spark, sf):
    return K.session_of(S.table(spark, sf, "events").select("event_id", "ts"), "ts", _calendar(spark, sf))


@query("next_session_transition", f"WITH {_CAL}, m AS (SELECT DISTINCT unnest([o, c]) AS m FROM cal), e AS (SELECT event_id, ts FROM events) SELECT event_id, ts, m AS next_transition FROM e ASOF LEFT JOIN m ON e.ts < m.m")
def next_session_transition(spark, sf):
    return K.next_transition(S.table(spark, sf, "events").select("event_id", "ts"), "ts", _calendar(spark, sf))


@query("expected_opens", f"WITH {_CAL}, x AS (SELECT trade_date, unnest(range(o, c, INTERVAL 30 MINUTE)) AS open_ts FROM cal WHERE phase = 'REGULAR') SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY open_ts) AS ordinal FROM x")
def expected_opens(spark, sf):
    return K.expected_opens(_calendar(spark, sf), 1800)


@query("retention_cutoff", f"WITH {_CAL} SELECT o AS cutoff FROM cal, (SELECT max(ts) - INTERVAL 5 DAY AS t FROM events) WHERE phase = 'REGULAR' AND c <= t ORDER BY o DESC LIMIT 1 OFFSET 4")
def retention_cutoff(spark, sf):
    last = S.table(spark, sf, "events").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("t"))  # one row
    return K.retention_cutoff(_calendar(spark, sf).crossJoin(F.broadcast(last)), F.col("t"), 5)


@query("session_minus_breaks", f"""WITH {_CAL}, w AS (SELECT trade_date AS id, o, c FROM cal WHERE phase = 'REGULAR')
SELECT id, o AS open_ts, id + INTERVAL 16 HOUR AS close_ts FROM w WHERE day(id) % 2 = 0 UNION ALL SELECT id, id + INTERVAL 17 HOUR, c FROM w WHERE day(id) % 2 = 0 UNION ALL SELECT id, o, c FROM w WHERE day(id) % 2 = 1""")
def session_minus_breaks(spark, sf):
    w = _calendar(spark, sf).where("phase = 'REGULAR'").select(F.col("trade_date").alias("id"), "open_ts", "close_ts")
    b = w.where(F.dayofmonth("id") % 2 == 0).select("id", (F.col("id") + F.expr("INTERVAL 16 HOURS")).alias("open_ts"), (F.col("id") + F.expr("INTERVAL 17 HOURS")).alias("close_ts"))
    return K.subtract(w, b)


@query("historical_windows", f"""WITH {_CAL}, a AS (SELECT trade_date, o, c, trade_date + INTERVAL '18:07:00' AS f FROM cal WHERE phase = 'REGULAR'), u AS (SELECT trade_date, o, c, date_trunc('hour', f) + INTERVAL 5 MINUTE AS f FROM a),
k AS (SELECT trade_date, 'current_session' AS kind, o AS b, least(c, f) AS e FROM u UNION ALL SELECT trade_date, 'whole_session', o, c FROM u UNION ALL SELECT trade_date, 'from_open', o, least(o + INTERVAL 15 MINUTE, c, f) FROM u
 UNION ALL SELECT trade_date, 'to_close', c - INTERVAL 1 HOUR, least(c, f) FROM u UNION ALL SELECT trade_date, 'trailing', f - INTERVAL 1 HOUR, f FROM u)
SELECT trade_date, kind, CASE WHEN e > b THEN b END AS start_ts, CASE WHEN e > b THEN e - INTERVAL 1 MICROSECOND END AS end_ts FROM k""")
def historical_windows(spark, sf):
    c = _calendar(spark, sf).where("phase = 'REGULAR'")
    as_of = F.col("trade_date") + F.expr("INTERVAL '18:07' HOUR TO MINUTE")
    args = {"current_session": (0, 0), "whole_session": (0, 0), "from_open": (0, 900), "to_close": (0, 3600), "trailing": (0, 3600)}
    out = []
    for kind, (off, dur) in args.items():
        lo, hi = K.resolve_window(kind, F.col("open_ts"), F.col("close_ts"), as_of, 300, off, dur)
        out.append(F.struct(F.lit(kind).alias("kind"), lo.alias("start_ts"), hi.alias("end_ts")))
    return c.select("trade_date", F.explode(F.array(*out)).alias("w")).select("trade_date", "w.*")
