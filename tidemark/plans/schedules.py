"""Queries over provider calendars, session states and historical windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import schedule as H
from tidemark.plans.catalog import query
from tidemark.sources import adapters as S

PHASES = [H.Phase("GTH", "21:00", "13:25", -1), H.Phase("RTH", "13:30", "20:00"), H.Phase("CURB", "20:15", "21:00")]

#: Listed days are the week days with events; every fifth closes early; every seventh has an override of RTH, also on week ends.
_PC = """sd AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events),
sc AS (SELECT d AS trade_date, d + INTERVAL '13:30:00' AS mo, d + CASE WHEN day(d) % 5 = 0 THEN INTERVAL 17 HOUR ELSE INTERVAL 20 HOUR END AS mc FROM sd WHERE isodow(d) <= 5),
ov AS (SELECT d AS trade_date FROM sd WHERE day(d) % 7 = 0),
pc AS (SELECT trade_date, 'GTH' AS phase, trade_date - INTERVAL 3 HOUR AS o, trade_date + INTERVAL '13:25:00' AS c FROM sc
 UNION ALL SELECT trade_date, 'RTH', greatest(trade_date + CASE WHEN trade_date IN (FROM ov) THEN INTERVAL 15 HOUR ELSE INTERVAL '13:30:00' END, mo), least(trade_date + CASE WHEN trade_date IN (FROM ov) THEN INTERVAL 19 HOUR ELSE INTERVAL 20 HOUR END, mc) FROM sc
 UNION ALL SELECT trade_date, 'RTH', trade_date + INTERVAL 15 HOUR, trade_date + INTERVAL 19 HOUR FROM ov WHERE isodow(trade_date) > 5
 UNION ALL SELECT trade_date, 'CURB', trade_date + INTERVAL '20:15:00', trade_date + INTERVAL 21 HOUR FROM sc WHERE day(trade_date) % 5 <> 0)"""
_SNAP = _PC + """, nx AS (SELECT o AS at, trade_date FROM pc),
mk AS (SELECT DISTINCT unnest([o, c]) AS m FROM pc), ex AS (SELECT min(o) AS a, max(c) AS z FROM pc)"""


def calendar(spark, sf):
    days = S.table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("trade_date")).distinct()
    n, at = F.dayofmonth("trade_date"), lambda hours: T.from_micros(T.micros(F.col("trade_date")) + hours * 3_600_000_000)
    listed = days.where("dayofweek(trade_date) BETWEEN 2 AND 6")
    schedule = listed.select("trade_date", T.from_micros(T.micros(F.col("trade_date")) + 48_600_000_000).alias("market_open"), at(F.when(n % 5 == 0, 17).otherwise(20)).alias("market_close"))
    overrides = days.where(n % 7 == 0).select("trade_date", F.lit("RTH").alias("phase"), F.lit("15:00").alias("start"), F.lit("19:00").alias("end"), F.lit(0).alias("start_day_offset"))
    return H.provider_calendar(schedule, PHASES, overrides)


@query("provider_calendar", f"WITH {_PC} SELECT trade_date, phase, o AS open_ts, c AS close_ts FROM pc WHERE c > o")
def provider_calendar(spark, sf):
    return calendar(spark, sf)


@query("provider_hours", "SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS trade_date, 'OPEN' AS phase, date_trunc('day', ts)::TIMESTAMP + INTERVAL 9 HOUR AS open_ts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 16 HOUR AS close_ts FROM events")
def provider_hours(spark, sf):
    days = S.table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("trade_date")).distinct()
    hours = lambda h: T.from_micros(T.micros(F.col("trade_date")) + h * 3_600_000_000)
    return H.provider_calendar(days.select("trade_date", hours(9).alias("market_open"), hours(16).alias("market_close")), [])


_EVAL = _SNAP + """, ev AS (SELECT e.event_id, e.ts, p.phase AS p, p.trade_date AS td, p.o, p.c, (SELECT min(m) FROM mk WHERE m > e.ts) AS nt FROM events e LEFT JOIN pc p ON e.ts >= p.o AND e.ts < p.c),
st AS (SELECT ev.*, nx.trade_date AS nd FROM ev ASOF LEFT JOIN nx ON ev.ts < nx.at),
sn AS (SELECT event_id, ts, coalesce(p, 'CLOSED') AS phase, coalesce(td, nd) AS trade_date, o AS phase_open_ts, c AS phase_close_ts, nt AS next_transition FROM st)"""


@query("session_snapshots", f"WITH {_EVAL} SELECT * FROM sn")
def session_snapshots(spark, sf):
    return H.evaluate(S.table(spark, sf, "events").select("event_id", "ts"), "ts", calendar(spark, sf))


@query("session_state_changes", f"WITH {_EVAL}, g AS (SELECT trade_date, phase, next_transition, min(ts) AS ts FROM sn GROUP BY ALL) SELECT ts, trade_date, phase, next_transition FROM g WINDOW w AS (ORDER BY ts) QUALIFY row_number() OVER w = 1 OR trade_date IS DISTINCT FROM lag(trade_date) OVER w OR phase <> lag(phase) OVER w")
def session_state_changes(spark, sf):
    return H.state_changes(S.table(spark, sf, "events").select("ts"), "ts", calendar(spark, sf))


@query("continuous_sessions", "SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS open_ts, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS close_ts FROM events")
def continuous_sessions(spark, sf):
    lo, hi = H.continuous_window(F.col("ts"))
    return S.table(spark, sf, "events").select("event_id", lo.alias("open_ts"), hi.alias("close_ts"))


@query("active_reference_attempts", f"""WITH {_EVAL} SELECT event_id, CASE WHEN phase = 'RTH' THEN CASE WHEN phase_open_ts < time_bucket(INTERVAL 30 MINUTE, ts) THEN ts ELSE time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 30 MINUTE + INTERVAL 1 SECOND END END AS attempt_ts FROM sn""")
def active_reference_attempts(spark, sf):
    e = session_snapshots(spark, sf)
    return e.select("event_id", H.attempt_time(F.col("phase"), "RTH", F.col("phase_open_ts"), F.col("ts"), 1800, 1_000_000).alias("attempt_ts"))


_POLICIES = [("opening", "start", 0, 1800), ("power", "end", -3600, 3600), ("late", "start", 6 * 3600, 7200)]


@query("analytical_windows", f"""WITH {_PC}, w AS (SELECT trade_date, name, o, c, CASE WHEN b = 'start' THEN o ELSE c END + f * INTERVAL 1 SECOND AS s, n FROM pc, (VALUES ('opening', 'start', 0, 1800), ('power', 'end', -3600, 3600), ('late', 'start', 21600, 7200)) t(name, b, f, n) WHERE phase = 'RTH' AND c > o)
SELECT trade_date, name, greatest(o, s) AS start_ts, least(c, s + n * INTERVAL 1 SECOND) AS end_ts FROM w WHERE least(c, s + n * INTERVAL 1 SECOND) > greatest(o, s)""")
def analytical_windows(spark, sf):
    plan = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(b).alias("b"), F.lit(f).alias("f"), F.lit(d).alias("d")) for n, b, f, d in _POLICIES)))
    rows = calendar(spark, sf).where("phase = 'RTH'").select("trade_date", "open_ts", "close_ts", plan.alias("p"))
    lo, hi = H.anchored(F.col("open_ts"), F.col("close_ts"), F.col("p.b"), F.col("p.f"), F.col("p.d"))
    return rows.select("trade_date", "p.name", T.from_micros(lo).alias("start_ts"), T.from_micros(hi).alias("end_ts")).where("end_ts > start_ts")


#: kind, phase, and the parameters that the kind takes.
_ASKED = [
    ("previous_rth", "RTH", {}), ("previous_gth_overnight", "GTH", {}), ("current_overnight", "GTH", {}), ("current_rth", "RTH", {}), ("current_gth", "GTH", {}), ("curb", "CURB", {}),
    ("premarket", "GTH", {}), ("overnight", "GTH", {}), ("session_to_date", "RTH", {}), ("opening_range", "RTH", {"duration_minutes": 30}), ("power_hour", "RTH", {"duration_minutes": 60}),
    ("power_hour", "RTH", {"anchor_boundary": "end", "offset_seconds": -3600, "duration_seconds": 3600, "fallback": True}), ("named_phase_slice", "RTH", {"start_offset_minutes": 60, "end_offset_minutes": 90}),
    ("previous_sessions", "RTH", {"session_count": 3}), ("recent_completed", None, {"observation_count": 12}), ("anchored_interval", None, {"fixed": True}), ("synchronized_interval", None, {"fixed": True}),
]
_FIELDS = {"observation_count": "int", "duration_minutes": "int", "offset_seconds": "int", "duration_seconds": "int", "anchor_boundary": "string", "start_offset_minutes": "int", "end_offset_minutes": "int", "session_count": "int", "fallback": "boolean", "fixed": "boolean"}


def _literal(v):
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()


_RQ = "rq(i, kind, phase, " + ", ".join(_FIELDS) + ") AS (VALUES " + ", ".join(f"({i}, '{k}', {_literal(p)}, {', '.join(_literal(a.get(f)) for f in _FIELDS)})" for i, (k, p, a) in enumerate(_ASKED)) + ")"


@query("resolved_historical_windows", f"""WITH {_EVAL}, {_RQ}, ao AS (SELECT event_id, ts AS as_of, trade_date AS nd, time_bucket(INTERVAL 5 MINUTE, ts) AS done FROM sn WHERE event_id IN (SELECT min(event_id) FROM events GROUP BY date_trunc('hour', ts))),
q AS (SELECT event_id, i, kind, phase AS ph, as_of, nd, done, rq.* EXCLUDE (i, kind, phase) FROM ao, rq),
m0 AS (SELECT q.*, o, c, trade_date = nd AS now, CASE WHEN duration_seconds IS NOT NULL THEN greatest(o, CASE WHEN anchor_boundary = 'start' THEN o ELSE c END + offset_seconds * INTERVAL 1 SECOND) WHEN kind = 'power_hour' THEN greatest(o, c - duration_minutes * INTERVAL 1 MINUTE) WHEN kind = 'named_phase_slice' THEN o + start_offset_minutes * INTERVAL 1 MINUTE ELSE o END AS lo,
 CASE WHEN duration_seconds IS NOT NULL THEN least(c, CASE WHEN anchor_boundary = 'start' THEN o ELSE c END + (offset_seconds + duration_seconds) * INTERVAL 1 SECOND) WHEN kind = 'opening_range' THEN least(c, o + duration_minutes * INTERVAL 1 MINUTE) WHEN kind = 'named_phase_slice' THEN o + end_offset_minutes * INTERVAL 1 MINUTE ELSE c END AS hi
 FROM q LEFT JOIN (SELECT * FROM pc WHERE c > o) p ON p.phase = q.ph),
g AS (SELECT event_id, i, kind, any_value(as_of) AS as_of, any_value(done) AS done, any_value(fallback) AS fallback, any_value(observation_count) AS oc, max(c) FILTER (c <= done) AS bh, arg_max(o, c) FILTER (c <= done) AS bl, list(o ORDER BY c DESC) FILTER (c <= done) AS os,
 max(lo) FILTER (lo < done) AS sl, arg_max(hi, lo) FILTER (lo < done) AS sh, max(lo) FILTER (now) AS cl, max(hi) FILTER (now) AS ch FROM m0 GROUP BY ALL),
h AS (SELECT *, CASE WHEN kind = 'recent_completed' THEN done - oc * INTERVAL 5 MINUTE WHEN kind LIKE '%_interval' THEN done - INTERVAL 2 HOUR WHEN kind IN ('previous_rth', 'previous_gth_overnight') THEN bl WHEN kind = 'previous_sessions' THEN CASE WHEN len(os) >= 3 THEN os[3] END WHEN kind = 'power_hour' AND fallback THEN sl ELSE cl END AS lo,
 CASE WHEN kind = 'recent_completed' THEN done WHEN kind LIKE '%_interval' THEN done + INTERVAL 1 HOUR WHEN kind IN ('previous_rth', 'previous_gth_overnight') THEN bh WHEN kind = 'previous_sessions' THEN CASE WHEN len(os) >= 3 THEN bh END WHEN kind = 'power_hour' AND fallback THEN sh ELSE ch END AS hi FROM g),
k AS (SELECT *, coalesce(kind NOT LIKE '%_interval' AND kind <> 'recent_completed' AND hi > lo AND lo >= done, false) AS late, coalesce(least(hi, done) > lo, false) AS ok FROM h)
SELECT event_id * 100 + i AS request_id, kind, CASE WHEN ok AND NOT late THEN 'resolved' WHEN late THEN 'unavailable' ELSE 'failed' END AS status, CASE WHEN ok AND NOT late THEN lo END AS start_ts, CASE WHEN ok AND NOT late THEN least(hi, done) - INTERVAL 1 MICROSECOND END AS end_ts, CASE WHEN late THEN time_bucket(INTERVAL 5 MINUTE, lo) + INTERVAL 5 MINUTE END AS retry_at FROM k""")
def resolved_historical_windows(spark, sf):
    fields = [F.struct(F.lit(i).alias("i"), F.lit(k).alias("kind"), F.lit(p).cast("string").alias("phase"), *(F.lit(a.get(f)).cast(t).alias(f) for f, t in _FIELDS.items())) for i, (k, p, a) in enumerate(_ASKED)]
    events = S.table(spark, sf, "events")
    as_of = events.groupBy(F.date_trunc("hour", "ts")).agg(F.min_by(F.struct("event_id", "ts"), "event_id").alias("e")).select("e.*")
    rows = as_of.select("event_id", F.col("ts").alias("as_of"), F.explode(F.array(*fields)).alias("q")).select((F.col("event_id") * 100 + F.col("q.i")).alias("request_id"), "as_of", "q.*").withColumn("interval_seconds", F.lit(300))
    done = F.floor(T.micros(F.col("as_of")) / 300_000_000) * 300_000_000
    rows = rows.withColumns({"start_ts": F.when(F.col("fixed"), T.from_micros(done - 7_200_000_000)), "end_ts": F.when(F.col("fixed"), T.from_micros(done + 3_600_000_000))})
    return H.resolve_windows(rows.drop("i", "fixed"), calendar(spark, sf))
