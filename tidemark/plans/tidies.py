"""Queries over tidy metric values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import measurements as M
from tidemark.operators import tidy as Y
from tidemark.plans.catalog import BAR, query
from tidemark.plans.schedules import _PC, calendar
from tidemark.sources import adapters as S

_SUMS = _PC + ", " + BAR + """, b AS (SELECT instrument, open_ts, close_ts, open, high, low, close, CASE WHEN n_trades % 6 <> 0 THEN volume END AS volume, CASE WHEN n_trades % 9 = 0 THEN 'STALE' ELSE 'READY' END AS h FROM bar),
j AS (SELECT b.*, p.trade_date, p.phase, p.o AS po, p.c AS pc FROM b JOIN pc p ON b.close_ts - INTERVAL 1 MICROSECOND >= p.o AND b.close_ts - INTERVAL 1 MICROSECOND < p.c),
g AS (SELECT instrument, trade_date, phase, po, pc, arg_min(open, open_ts)::DOUBLE AS open, max(high)::DOUBLE AS high, min(low)::DOUBLE AS low, arg_max(close, open_ts)::DOUBLE AS close, sum(volume::DOUBLE) AS v, sum((high + low + close)::DOUBLE / 3 * volume::DOUBLE) AS pv, count(volume) = count(*) AS al, count(volume) = 0 AS no,
 round(sum(epoch(least(close_ts, pc)) - epoch(greatest(open_ts, po))) / (epoch(pc) - epoch(po)), 6) AS cov, bool_or(h = 'STALE') AS st, min(open_ts) = po AS oo, max(close_ts) = pc AS co FROM j GROUP BY instrument, trade_date, phase, po, pc),
s AS (SELECT instrument, trade_date, phase, open, high, low, close, CASE WHEN al THEN v END AS volume, CASE WHEN al AND v > 0 THEN pv / v END AS vwap, cov, oo, co, CASE WHEN cov < 0.9 THEN 'DEGRADED' WHEN st THEN 'STALE' ELSE 'READY' END AS health, CASE WHEN cov >= 0.9 AND NOT st THEN 'DERIVED' ELSE 'PARTIAL' END AS fidelity,
 concat_ws(',', CASE WHEN NOT oo THEN 'session_open_not_observed' END, CASE WHEN NOT co THEN 'session_close_not_observed' END, CASE WHEN cov < 0.9 THEN 'session_coverage_below_threshold' END, CASE WHEN no THEN 'volume_unsupported' WHEN NOT al THEN 'volume_partial' WHEN v = 0 THEN 'zero_session_volume' END) AS reasons FROM g)"""


def _summaries(spark, sf):
    n = F.col("n_trades")
    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", "close_ts", "open", "high", "low", "close", F.when(n % 6 != 0, F.col("volume")).alias("volume"), F.when(n % 9 == 0, "STALE").otherwise("READY").alias("health"))
    return Y.summaries(bars, calendar(spark, sf), 0.9)


@query("session_reference_summaries", f"WITH {_SUMS} SELECT instrument, trade_date, phase, open, high, low, close, volume, round(vwap, 6) AS vwap, cov AS coverage_ratio, oo AS opening_observed, co AS closing_observed, health, fidelity, reasons FROM s")
def session_reference_summaries(spark, sf):
    return _summaries(spark, sf).drop("phase_open_ts", "phase_close_ts")


def _tidy(alias: str, absent: str, metrics: list[tuple[str, str]]) -> str:
    one = "SELECT instrument, trade_date, '{m}' AS metric_id, {x}::DOUBLE AS v, {a}.health AS h, {a}.fidelity AS f, {a}.reasons AS r, {a}.health IS NULL AS gone, '{absent}' AS absent FROM z"
    return " UNION ALL ".join(one.format(m=m, x=x, a=alias, absent=absent) for m, x in metrics)


_A = [("open", "a.open"), ("high", "a.high"), ("low", "a.low"), ("latest_close", "a.close"), ("range", "a.high - a.low"), ("location", "CASE WHEN a.high = a.low THEN 0.5 ELSE (a.close - a.low) / (a.high - a.low) END"), ("volume", "a.volume"), ("bar_vwap_estimate", "a.vwap"), ("coverage_ratio", "a.cov")]
_P = [("open", "p.open"), ("high", "p.high"), ("low", "p.low"), ("close", "p.close"), ("range", "p.high - p.low"), ("simple_return", "(p.close - p.open) / nullif(p.open, 0)"), ("volume", "p.volume"), ("bar_vwap_estimate", "p.vwap"), ("coverage_ratio", "p.cov")]
_O = [("open", "o.open"), ("high", "o.high"), ("low", "o.low"), ("latest_close", "o.close"), ("range", "o.high - o.low")]
_C = "CASE WHEN p.co THEN p.close END"
_V = " UNION ALL ".join([
    _tidy("a", "active_session_missing", [(f"active_session.{m}", x) for m, x in _A]), _tidy("p", "previous_session_missing", [(f"previous_session.{m}", x) for m, x in _P]), _tidy("o", "overnight_missing", [(f"overnight.{m}", x) for m, x in _O]),
    _tidy("o", "overnight_missing", [("gap.indicative.points", f"o.close - {_C}"), ("gap.indicative.ratio", f"(o.close - {_C}) / nullif({_C}, 0)")]),
    _tidy("a", "active_session_missing", [("gap.opening.points", f"CASE WHEN a.oo THEN a.open END - {_C}"), ("gap.opening.ratio", f"(CASE WHEN a.oo THEN a.open END - {_C}) / nullif({_C}, 0)")])])


@query("session_reference_values", f"""WITH {_SUMS}, d AS (SELECT instrument, trade_date, s AS a, lag(s) OVER (PARTITION BY instrument ORDER BY trade_date) AS p FROM s WHERE phase = 'RTH'), n AS (SELECT instrument, trade_date, s AS o FROM s WHERE phase = 'GTH'),
z AS (SELECT * FROM d FULL JOIN n USING (instrument, trade_date)), v AS ({_V})
SELECT instrument, trade_date, metric_id, round(v, 6) AS value, CASE WHEN v IS NULL THEN 'UNAVAILABLE' ELSE h END AS health, CASE WHEN v IS NULL THEN 'UNAVAILABLE' ELSE f END AS fidelity, CASE WHEN gone THEN absent ELSE r END AS missing_reasons FROM v""")
def session_reference_values(spark, sf):
    return Y.session_references(_summaries(spark, sf))


def _utc(spark, sf):
    return M.with_utc_session(S.hourly_bars(spark, sf))


def _opening_metrics():
    ratio = lambda c: F.when(F.col("range") != 0, F.col(c) / F.col("range"))
    return {
        "complete": F.col("complete").cast("int"), "high": F.col("high"), "low": F.col("low"), "range": F.col("range"), "distance_above_high_points": F.col("distance_above_high"), "distance_above_high_ratio": ratio("distance_above_high"),
        "distance_below_low_points": F.col("distance_below_low"), "distance_below_low_ratio": ratio("distance_below_low"), "coverage_ratio": F.col("coverage_ratio")}


_OR_SQL = """w AS (SELECT *, date_trunc('day', open_ts)::TIMESTAMP AS session, hour(open_ts) < 2 AS i FROM bar),
g AS (SELECT instrument, session, max(high) FILTER (i) AS high, min(low) FILTER (i) AS low, arg_max(close, open_ts) AS lc, count(*) FILTER (i) AS n FROM w GROUP BY ALL),
k AS (SELECT instrument, session, high::DOUBLE AS high, low::DOUBLE AS low, (high - low)::DOUBLE AS range, greatest(lc - high, 0)::DOUBLE AS up, greatest(low - lc, 0)::DOUBLE AS down, round(n * 3600 / 7200.0, 6)::DOUBLE AS cov FROM g WHERE n > 0)"""
_OR_M = [("complete", "(cov >= 1)::INT"), ("high", "high"), ("low", "low"), ("range", "range"), ("distance_above_high_points", "up"), ("distance_above_high_ratio", "up / nullif(range, 0)"), ("distance_below_low_points", "down"), ("distance_below_low_ratio", "down / nullif(range, 0)"), ("coverage_ratio", "cov")]


@query("opening_range_values", f"WITH {BAR}, {_OR_SQL}, v AS (" + " UNION ALL ".join(f"SELECT instrument, session, cov, 'opening_range.regular.first120.{m}' AS metric_id, ({x})::DOUBLE AS v FROM k" for m, x in _OR_M) + """)
SELECT instrument, session, metric_id, round(v, 6) AS value, CASE WHEN v IS NULL THEN 'UNAVAILABLE' WHEN cov < 0.9 THEN 'DEGRADED' ELSE 'READY' END AS health, CASE WHEN v IS NULL THEN 'UNAVAILABLE' WHEN cov < 0.9 THEN 'PARTIAL' ELSE 'DERIVED' END AS fidelity, CASE WHEN cov < 0.9 THEN 'window_coverage_below_threshold' ELSE '' END AS missing_reasons FROM v""")
def opening_range_values(spark, sf):
    return Y.window_values(M.analytical_window(_utc(spark, sf), 0, 7200, False, 86_400), "opening_range.regular.first120", _opening_metrics(), 0.9)


@query("rolling_values")
def rolling_values(spark, sf):
    bars = _utc(spark, sf)
    now = M.rolling_windows(bars, 3600, 6 * 3600, 0.8)
    return Y.rolling_values(now, M.recent_baseline(bars, 3600, 6 * 3600, 5, 0.8, 3), M.phase_baseline(bars, 3600, 6 * 3600, 10, 0.8, 5), "rolling.structural.21600")
