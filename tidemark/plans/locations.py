"""Queries over market context and locations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import location as L
from tidemark.operators import measurements as M
from tidemark.operators.bars import utc_aggregate
from tidemark.plans.catalog import BAR, query
from tidemark.sources import adapters as S

BIN = 25
POLICY = [
    L.Source("structural_level", ("4h", "1h"), 0.15),
    L.Source("fair_value_gap", ("4h", "1h"), 0.0),
    L.Source("value_area_edge", ("1h",), 0.10),
    L.Source("session_vwap", ("1h",), 0.10),
]

_F = BAR + """, b4 AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_ts) AS o, max(high) AS high, min(low) AS low, arg_max(close, open_ts) AS close, sum(volume)::DECIMAL(18,6) AS volume FROM bar GROUP BY ALL HAVING count(*) = 4),
f0 AS (SELECT '1h' AS tf, instrument, open_ts, close_ts, high, low, close, volume FROM bar UNION ALL SELECT '4h', instrument, o, o + INTERVAL 4 HOUR, high, low, close, volume FROM b4),
f1 AS (SELECT *, date_trunc('day', open_ts)::TIMESTAMP AS session FROM f0),
f AS (SELECT *, row_number() OVER w AS i, max(high) OVER s AS sh, min(low) OVER s AS sl, lag(close) OVER w AS pc,
        round(sum((high + low + close) * volume) OVER s::DOUBLE / 3 / sum(volume) OVER s::DOUBLE, 6) AS vwap
      FROM f1 WINDOW w AS (PARTITION BY tf, instrument ORDER BY open_ts), s AS (PARTITION BY tf, instrument, session ORDER BY open_ts ROWS UNBOUNDED PRECEDING)),
tv AS (SELECT tf, instrument, i, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END::DOUBLE AS tr FROM f),
av AS (SELECT tf, instrument, i, round(CASE WHEN count(*) OVER l = 14 THEN avg(tr) OVER l END, 6) AS atr FROM tv WINDOW l AS (PARTITION BY tf, instrument ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
nb AS (SELECT *, lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2, lead(low, 1) OVER w AS l3, lead(low, 2) OVER w AS l4, lag(high, 1) OVER w AS h1, lag(high, 2) OVER w AS h2, lead(high, 1) OVER w AS h3, lead(high, 2) OVER w AS h4
       FROM f WINDOW w AS (PARTITION BY tf, instrument ORDER BY open_ts)),
sw AS (SELECT tf, instrument, i, close_ts, 'S' AS kind, low AS price FROM nb WHERE l2 IS NOT NULL AND l4 IS NOT NULL AND low <= least(l1, l2, l3, l4) AND low < greatest(l1, l2, l3, l4)
       UNION ALL SELECT tf, instrument, i, close_ts, 'R', high FROM nb WHERE h2 IS NOT NULL AND h4 IS NOT NULL AND high >= greatest(h1, h2, h3, h4) AND high > least(h1, h2, h3, h4)),
ns AS (SELECT f.tf, f.instrument, f.i, arg_max(sw.price, (sw.price, sw.i)) FILTER (kind = 'S' AND price <= close) AS s, arg_max(sw.close_ts, (sw.price, sw.i)) FILTER (kind = 'S' AND price <= close) AS sts,
         arg_min(sw.price, (sw.price, -sw.i)) FILTER (kind = 'R' AND price >= close) AS r, arg_min(sw.close_ts, (sw.price, -sw.i)) FILTER (kind = 'R' AND price >= close) AS rts
       FROM f JOIN sw ON sw.tf = f.tf AND sw.instrument = f.instrument AND sw.i BETWEEN f.i - 497 AND f.i - 2 GROUP BY ALL),
nl AS (SELECT f.tf, f.instrument, f.i, CASE WHEN s IS NULL OR sl >= s THEN sl ELSE s END::DOUBLE AS support, CASE WHEN s IS NULL OR sl >= s THEN f.close_ts ELSE sts END AS support_ts,
         CASE WHEN r IS NULL OR sh <= r THEN sh ELSE r END::DOUBLE AS resistance, CASE WHEN r IS NULL OR sh <= r THEN f.close_ts ELSE rts END AS resistance_ts FROM f LEFT JOIN ns USING (tf, instrument, i)),
g0 AS (SELECT tf, instrument, i, close_ts, low > h2 AS bullish, CASE WHEN low > h2 THEN h2 ELSE high END AS lower, CASE WHEN low > h2 THEN low ELSE l2 END AS upper FROM nb WHERE low > h2 OR high < l2),
g AS (SELECT g0.*, (SELECT min(j.i) FROM f j WHERE j.tf = g0.tf AND j.instrument = g0.instrument AND j.i > g0.i AND CASE WHEN bullish THEN j.low <= g0.lower ELSE j.high >= g0.upper END) AS gone FROM g0),
ag AS (SELECT f.tf, f.instrument, f.i, g.bullish, g.close_ts AS detected_ts, g.lower::DOUBLE AS lower, g.upper::DOUBLE AS upper FROM f JOIN g ON g.tf = f.tf AND g.instrument = f.instrument AND g.i BETWEEN f.i - 497 AND f.i AND coalesce(g.gone > f.i, true)
       QUALIFY row_number() OVER (PARTITION BY f.tf, f.instrument, f.i ORDER BY g.i DESC) <= 10),
bn AS (SELECT tf, instrument, session, open_ts, floor(low / 25)::BIGINT AS lo, ceil(high / 25)::BIGINT AS hi, (volume * 1000000)::BIGINT AS v FROM f WHERE volume > 0),
bx AS (SELECT *, unnest(range(lo, hi + 1)) AS bin FROM bn),
bv AS (SELECT b.tf, b.instrument, b.open_ts, x.bin, sum(CASE WHEN x.bin < x.hi THEN x.v // (x.hi - x.lo + 1) ELSE x.v - x.v // (x.hi - x.lo + 1) * (x.hi - x.lo) END)::BIGINT AS v
       FROM bn b JOIN bx x ON x.tf = b.tf AND x.instrument = b.instrument AND x.session = b.session AND x.open_ts <= b.open_ts GROUP BY ALL),
pk AS (SELECT tf, instrument, open_ts, list(bin ORDER BY bin) AS ps, list(v ORDER BY bin) AS vs, sum(v)::BIGINT AS total, arg_max(bin, (v, bin)) AS poc FROM bv GROUP BY ALL),
gr AS (SELECT *, list_position(ps, poc)::BIGINT AS l, list_position(ps, poc)::BIGINT AS r, vs[list_position(ps, poc)]::BIGINT AS held FROM pk
       UNION ALL SELECT tf, instrument, open_ts, ps, vs, total, poc, CASE WHEN up THEN l ELSE l - 1 END, CASE WHEN up THEN r + 1 ELSE r END, held + CASE WHEN up THEN vs[r + 1] ELSE vs[l - 1] END
       FROM (SELECT *, coalesce(vs[r + 1], -1) > CASE WHEN l > 1 THEN vs[l - 1] ELSE -1 END AS up FROM gr WHERE 10 * held < 7 * total)),
va AS (SELECT tf, instrument, open_ts, arg_max(poc, r - l) * 25.0::DOUBLE AS poc, arg_max(ps[l], r - l) * 25.0::DOUBLE AS value_area_low, arg_max(ps[r], r - l) * 25.0::DOUBLE AS value_area_high FROM gr GROUP BY ALL),
ft AS (SELECT f.tf, f.instrument, f.i, f.session, f.open_ts, f.close_ts AS as_of, f.close::DOUBLE AS close, f.high::DOUBLE AS high, f.low::DOUBLE AS low, sh::DOUBLE AS session_high, sl::DOUBLE AS session_low, vwap, atr,
         support, support_ts, resistance, resistance_ts, poc, value_area_low, value_area_high
       FROM f JOIN av USING (tf, instrument, i) JOIN nl USING (tf, instrument, i) LEFT JOIN va USING (tf, instrument, open_ts))"""


def _frames(spark, sf):
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", "close_ts", "open", "high", "low", "close", "volume")
    four = utc_aggregate(bars.withColumns({"health": F.lit("READY"), "evidence": F.array().cast("array<string>")}), 3600, 14_400).drop("health", "fidelity", "evidence")
    four = four.withColumnRenamed("bucket", "open_ts").withColumn("close_ts", F.col("open_ts") + F.expr("INTERVAL 4 HOURS"))
    return {"1h": bars, "4h": four}


def context(spark, sf):
    return {tf: L.context_features(M.with_utc_session(b), BIN) for tf, b in _frames(spark, sf).items()}


@query("market_context_features", f"""WITH RECURSIVE {_F}, n AS (SELECT tf, instrument, i, count(*) AS n_gaps, count(*) FILTER (bullish) AS n_bullish, min(lower) AS lowest_gap, max(upper) AS highest_gap FROM ag GROUP BY ALL)
SELECT tf, instrument, open_ts, as_of, close, session_high, session_low, vwap, atr, support, support_ts, resistance, resistance_ts, poc, value_area_low, value_area_high,
  coalesce(n_gaps, 0) AS n_gaps, coalesce(n_bullish, 0) AS n_bullish, lowest_gap, highest_gap FROM ft LEFT JOIN n USING (tf, instrument, i)""")
def market_context_features(spark, sf):
    """The context of every hourly and four-hour bar at its close, gaps by number and bounds."""
    out = None
    for tf, f in context(spark, sf).items():
        ends = lambda field, pick: pick(F.transform("gaps", lambda g: g[field]))
        rows = f.withColumns({
            "tf": F.lit(tf), "n_gaps": F.size("gaps").cast("long"), "n_bullish": F.size(F.filter("gaps", lambda g: g["bullish"])).cast("long"),
            "lowest_gap": ends("lower", F.array_min), "highest_gap": ends("upper", F.array_max)}).drop("gaps", "session")
        out = rows if out is None else out.unionByName(rows)
    return out


def evaluations(spark, sf):
    """Both directions at every hourly close."""
    bars = S.hourly_bars(spark, sf).select("instrument", F.col("close_ts").alias("ts"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.col("close").cast("double").alias("close"))
    return bars.withColumn("direction", F.explode(F.array(F.lit("LONG"), F.lit("SHORT"))))


def qualifications(spark, sf, minimum_sources: int = 2):
    return L.qualify_locations(evaluations(spark, sf).drop("close"), context(spark, sf), POLICY, minimum_sources)


_Q = _F + """,
ev AS (SELECT instrument, as_of AS ts, low, high, i, d.direction FROM ft, (VALUES ('LONG'), ('SHORT')) d(direction) WHERE tf = '1h'),
bu AS (SELECT ev.instrument, ev.ts, ev.direction, ev.low, ev.high, '1h' AS tf, ev.i AS fi FROM ev
       UNION ALL SELECT ev.instrument, ev.ts, ev.direction, ev.low, ev.high, '4h', x.i FROM ev ASOF LEFT JOIN (SELECT instrument, as_of, i FROM ft WHERE tf = '4h') x ON x.instrument = ev.instrument AND ev.ts >= x.as_of),
bf AS (SELECT bu.*, ft.* EXCLUDE (tf, instrument, i, low, high) FROM bu LEFT JOIN ft ON ft.tf = bu.tf AND ft.instrument = bu.instrument AND ft.i = bu.fi),
z0 AS (
  SELECT instrument, ts, direction, low, high, tf, 'structural_level' AS source, 'level' AS name, CASE direction WHEN 'LONG' THEN support_ts ELSE resistance_ts END AS seen_at, CASE direction WHEN 'LONG' THEN support ELSE resistance END AS lower, CASE direction WHEN 'LONG' THEN support ELSE resistance END AS upper, 0.15 AS frac, atr FROM bf
  UNION ALL SELECT bf.instrument, ts, direction, low, high, bf.tf, 'fair_value_gap', 'gap', ag.detected_ts, ag.lower, ag.upper, 0, atr FROM bf JOIN ag ON ag.tf = bf.tf AND ag.instrument = bf.instrument AND ag.i = bf.fi AND ag.bullish = (direction = 'LONG')
  UNION ALL SELECT instrument, ts, direction, low, high, tf, 'value_area_edge', 'value_area_edge', session, CASE direction WHEN 'LONG' THEN value_area_low ELSE value_area_high END, CASE direction WHEN 'LONG' THEN value_area_low ELSE value_area_high END, 0.10, atr FROM bf WHERE tf = '1h'
  UNION ALL SELECT instrument, ts, direction, low, high, tf, 'session_vwap', 'session_vwap', session, vwap, vwap, 0.10, atr FROM bf WHERE tf = '1h'),
z AS (SELECT *, CASE WHEN frac = 0 THEN 0 WHEN atr > 0 THEN round(atr * frac::DOUBLE, 6) END AS tol, CASE WHEN high < lower THEN lower - high WHEN low > upper THEN low - upper ELSE 0 END AS distance,
        concat_ws('|', tf, name, strftime(seen_at, '%Y-%m-%d %H:%M:%S'), lower::DECIMAL(18,6)::VARCHAR, upper::DECIMAL(18,6)::VARCHAR) AS zone_id FROM z0 WHERE lower IS NOT NULL),
dg AS (SELECT instrument, ts, direction, bool_or(fi IS NULL) OR bool_or(tf = '1h' AND (value_area_low IS NULL OR vwap IS NULL)) AS missing FROM bf GROUP BY ALL),
bl AS (SELECT instrument, ts, direction, bool_or(tol IS NULL AND distance > 0) AS blind FROM z GROUP BY ALL),
m AS (SELECT *, lower - coalesce(tol, 0) AS lo, upper + coalesce(tol, 0) AS hi, max(upper + coalesce(tol, 0)) OVER (PARTITION BY instrument, ts, direction ORDER BY lower - coalesce(tol, 0), upper + coalesce(tol, 0), zone_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM z WHERE distance <= coalesce(tol, 0)),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY instrument, ts, direction ORDER BY lo, hi, zone_id ROWS UNBOUNDED PRECEDING) AS c FROM m),
k AS (SELECT instrument, ts, direction, c, count(*) AS n_matches, count(DISTINCT source) AS sources, count(DISTINCT tf) AS timeframes, count(*) FILTER (distance = 0) AS touches, count(*) FILTER (source <> 'value_area_edge') AS reported,
        round(avg(CASE WHEN coalesce(tol, 0) = 0 THEN 0 ELSE distance / tol END), 6) AS mean_distance, min(lo) AS lower, max(hi) AS upper, string_agg(zone_id, ',' ORDER BY zone_id) AS zone_ids FROM c GROUP BY ALL),
b AS (SELECT *, count(*) OVER (PARTITION BY instrument, ts, direction) AS n_clusters FROM k
      QUALIFY row_number() OVER (PARTITION BY instrument, ts, direction ORDER BY sources DESC, timeframes DESC, touches DESC, reported DESC, mean_distance, round(upper - lower, 6), zone_ids) = 1)"""


@query("location_qualification", f"""WITH RECURSIVE {_Q}
SELECT ev.instrument, ev.ts, ev.direction, CASE WHEN sources >= 2 THEN 'qualified' WHEN n_matches > 0 THEN 'insufficient_confluence' ELSE 'not_at_location' END AS status, missing OR coalesce(blind, false) AS is_degraded,
  coalesce(n_clusters, 0) AS n_clusters, coalesce(n_matches, 0) AS n_matches, coalesce(sources, 0) AS sources, coalesce(timeframes, 0) AS timeframes, coalesce(touches, 0) AS touches, coalesce(reported, 0) AS reported,
  mean_distance, round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(zone_ids, '') AS zone_ids
FROM ev JOIN dg USING (instrument, ts, direction) LEFT JOIN bl USING (instrument, ts, direction) LEFT JOIN b USING (instrument, ts, direction)""")
def location_qualification(spark, sf):
    q = qualifications(spark, sf)
    mean = F.when(F.col("n_matches") > 0, F.col("mean_distance")).alias("mean_distance")
    return q.select(*(c for c in q.columns if c not in ("zones", "mean_distance", "lower", "upper")), mean, F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), F.array_join(F.transform("zones", lambda z: z["zone_id"]), ",").alias("zone_ids"))
