"""Trading schedules: phase windows from a provider's schedule, point lookups, window resolution.

A calendar is a small dimension (a few rows a trade date: trade_date, phase, open_ts, close_ts).  Lookups spread its segments over
the days they touch, so that rows meet it in an equi-join on the day and never in a range join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import from_micros, micros


@dataclass(frozen=True)
class Phase:
    name: str
    start: str
    end: str
    start_day_offset: int = 0


def _at(day: Column, clock: Column, zone: str) -> Column:
    local = F.to_timestamp(F.concat_ws(" ", day.cast("date").cast("string"), clock))
    return F.to_utc_timestamp(local, zone).cast("timestamp_ntz")


def provider_calendar(schedule: DataFrame, phases: Sequence[Phase], overrides: DataFrame | None = None, zone: str = "UTC") -> DataFrame:
    """``schedule(trade_date, market_open, market_close)`` and ``overrides(trade_date, phase, start, end, start_day_offset)`` ->
    trade_date, phase, open_ts, close_ts.

    Without phases a day is OPEN for the provider's hours.  RTH is clipped to them; CURB is left out on a day that closes before
    RTH usually ends; an override replaces a phase's clock times and opens dates that the provider does not list."""
    if not phases:
        return schedule.select("trade_date", F.lit("OPEN").alias("phase"), F.col("market_open").alias("open_ts"), F.col("market_close").alias("close_ts"))
    plan = F.array(*(F.struct(F.lit(p.name).alias("phase"), F.lit(p.start).alias("s"), F.lit(p.end).alias("e"), F.lit(p.start_day_offset).alias("d")) for p in phases))
    days = schedule.select("trade_date", "market_open", "market_close", F.lit(True).alias("listed"))
    if overrides is None:
        rows = days.select("*", F.explode(plan).alias("p")).select(*days.columns, "p.*", F.lit(False).alias("replaced"))
    else:
        dates = overrides.select("trade_date").distinct().join(days, "trade_date", "left_anti")
        days = days.unionByName(dates, allowMissingColumns=True)
        other = overrides.select("trade_date", "phase", F.col("start").alias("s1"), F.col("end").alias("e1"), F.col("start_day_offset").alias("d1"))
        rows = days.select("*", F.explode(plan).alias("p")).select(*days.columns, "p.*").join(other, ["trade_date", "phase"], "left")
        rows = rows.withColumns({"replaced": F.col("s1").isNotNull(), "s": F.coalesce("s1", "s"), "e": F.coalesce("e1", "e"), "d": F.coalesce("d1", "d")})
    rows = rows.where("listed OR replaced")
    start, end = _at(F.date_add(F.col("trade_date").cast("date"), F.col("d")), F.col("s"), zone), _at(F.col("trade_date"), F.col("e"), zone)
    regular = F.col("listed") & (F.col("phase") == "RTH")
    rows = rows.withColumns({
        "open_ts": F.when(regular, F.greatest(start, F.col("market_open"))).otherwise(start),
        "close_ts": F.when(regular, F.least(end, F.col("market_close"))).otherwise(end),
    })
    usual = next((p.end for p in phases if p.name == "RTH"), None)
    if usual:
        early = F.col("listed") & (F.col("market_close") < _at(F.col("trade_date"), F.lit(usual), zone))
        rows = rows.where(~((F.col("phase") == "CURB") & F.coalesce(early, F.lit(False))))
    return rows.where("close_ts > open_ts").select("trade_date", "phase", "open_ts", "close_ts")


def timeline(calendar: DataFrame) -> DataFrame:
    """The calendar's windows and the CLOSED stretches between them, which take the next window's trade date, by day touched."""
    w = Window.orderBy("open_ts", "close_ts", "phase")  # a few rows a trade date
    marked = calendar.withColumns({"_no": F.lead("open_ts").over(w), "_nd": F.lead("trade_date").over(w), "_first": F.row_number().over(w) == 1})
    window = marked.select("trade_date", "phase", "open_ts", "close_ts", F.col("open_ts").alias("from_ts"), F.least("close_ts", F.coalesce("_no", "close_ts")).alias("to_ts"))
    none = F.lit(None).cast("timestamp_ntz")
    closed = lambda day, a, b: (day.alias("trade_date"), F.lit("CLOSED").alias("phase"), none.alias("open_ts"), none.alias("close_ts"), a.alias("from_ts"), b.alias("to_ts"))
    between = marked.where("_no > close_ts").select(*closed(F.col("_nd"), F.col("close_ts"), F.col("_no")))
    lead_in = marked.where("_first").select(*closed(F.col("trade_date"), F.col("open_ts") - F.expr("INTERVAL 7 DAYS"), F.col("open_ts")))
    day = lambda c: F.to_date(c)
    last = from_micros(micros(F.col("to_ts")) - 1)
    return window.unionByName(between).unionByName(lead_in).withColumn("day", F.explode(F.sequence(day(F.col("from_ts")), day(last))))


def evaluate(rows: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """Adds phase, trade_date, phase_open_ts, phase_close_ts and next_transition; beyond the calendar: CLOSED without a date."""
    t = timeline(calendar).select(
        F.col("day").alias("_day"), "from_ts", "to_ts", F.col("phase").alias("_phase"), "trade_date", F.col("open_ts").alias("phase_open_ts"), F.col("close_ts").alias("phase_close_ts"))
    found = rows.join(t, (F.to_date(ts) == F.col("_day")) & (F.col(ts) >= F.col("from_ts")) & (F.col(ts) < F.col("to_ts")), "left")
    return found.withColumns({"phase": F.coalesce("_phase", F.lit("CLOSED")), "next_transition": F.col("to_ts")}).drop("_day", "_phase", "from_ts", "to_ts")


def state_changes(rows: DataFrame, ts: str, calendar: DataFrame) -> DataFrame:
    """The first row, and every row whose (trade_date, phase) differs from the row before: what a session state publishes."""
    w = Window.orderBy(ts)
    seen = evaluate(rows, ts, calendar)
    # a state's first row is the least row of its stretch, so the rows are reduced per stretch before they are ordered
    first = seen.groupBy("trade_date", "phase", "next_transition").agg(F.min(ts).alias(ts))
    state = F.struct("trade_date", "phase")
    return first.withColumn("_p", F.lag(state).over(w)).where(~state.eqNullSafe(F.col("_p"))).drop("_p")


def continuous_window(ts: Column) -> tuple[Column, Column]:
    """The session of a market that never closes: the UTC day."""
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    return day, day + F.expr("INTERVAL 1 DAY")


def attempt_time(phase: Column, wanted: str, phase_open: Column, ts: Column, interval_seconds: int, delay_us: int) -> Column:
    """When an active-session reference can be asked for: now, if an interval has completed since the open; else just after the next."""
    step = interval_seconds * 1_000_000
    done = F.floor(micros(ts) / step) * step
    later = from_micros(done + step + delay_us)
    return F.when((phase == wanted) & phase_open.isNotNull(), F.when(micros(phase_open) < done, ts).otherwise(later))


def anchored(open_ts: Column, close_ts: Column, boundary: Column, offset_seconds: Column, duration_seconds: Column) -> tuple[Column, Column]:
    """A window counted from a session's start or end, clipped to the session (microseconds)."""
    o, c = micros(open_ts), micros(close_ts)
    begin = F.when(boundary == "start", o).otherwise(c) + offset_seconds.cast("long") * 1_000_000
    return F.greatest(o, begin), F.least(c, begin + duration_seconds.cast("long") * 1_000_000)


#: The kinds of historical windows.
WHOLE = ("current_overnight", "current_rth", "current_gth", "curb", "premarket", "overnight", "session_to_date")
PREVIOUS = ("previous_rth", "previous_gth_overnight")
FIXED = ("anchored_interval", "synchronized_interval")
KINDS = (*PREVIOUS, *WHOLE, "power_hour", "opening_range", "named_phase_slice", "previous_sessions", "recent_completed", *FIXED)


def resolve_windows(requests: DataFrame, calendar: DataFrame) -> DataFrame:
    """``requests(request_id, kind, phase, as_of, interval_seconds, observation_count, duration_minutes, offset_seconds,
    duration_seconds, anchor_boundary, start_offset_minutes, end_offset_minutes, session_count, start_ts, end_ts, fallback)`` ->
    request_id, kind, status, start_ts, end_ts (inclusive), retry_at.

    The end is cut at the last completed interval.  ``unavailable`` with a time to retry: the window has not begun;
    ``failed``: no such window.  A request meets only the windows of its phase within the days its kind can reach."""
    step = F.col("interval_seconds").cast("long") * 1_000_000
    done = F.floor(micros(F.col("as_of")) / step) * step
    dated = evaluate(requests.select("request_id", "as_of"), "as_of", calendar).select("request_id", F.col("trade_date").alias("now_date"))
    asked = requests.join(dated, "request_id").withColumn("done", done)
    reach = F.greatest(F.lit(10), 2 * F.coalesce("session_count", F.lit(0)) + 10)
    day = F.to_date("as_of")
    near = asked.withColumn("_day", F.explode(F.sequence(F.date_sub(day, reach), F.date_add(day, F.lit(4)))))
    c = calendar.select(F.col("phase").alias("_phase"), F.to_date("trade_date").alias("_on"), F.col("trade_date").alias("_date"), F.col("open_ts").alias("o"), F.col("close_ts").alias("c"))
    met = near.join(c, (F.col("phase") == F.col("_phase")) & (F.col("_day") == F.col("_on")), "left")
    lo, hi = _shape(F.col("kind"), F.col("o"), F.col("c"))
    end = micros(F.col("c"))
    pick = F.struct(lo.alias("lo"), hi.alias("hi"))
    whole = F.struct(micros(F.col("o")).alias("lo"), end.alias("hi"))
    got = met.groupBy("request_id").agg(
        F.max_by(F.when(end <= F.col("done"), whole), F.when(end <= F.col("done"), end)).alias("before"),
        F.reverse(F.sort_array(F.collect_list(F.when(end <= F.col("done"), F.struct(end.alias("hi"), micros(F.col("o")).alias("lo")))))).alias("completed"),
        F.max_by(F.when(lo < F.col("done"), pick), F.when(lo < F.col("done"), lo)).alias("started"),
        F.max(F.when(F.col("_date") == F.col("now_date"), pick)).alias("current"),
    )
    kind, n = F.col("kind"), F.col("session_count")
    enough = F.size("completed") >= n
    many = F.when(enough, F.struct(F.get("completed", n - 1)["lo"].alias("lo"), F.get("completed", F.lit(0))["hi"].alias("hi")))
    length = F.coalesce(F.col("observation_count") * step, F.col("duration_minutes").cast("long") * 60_000_000)
    recent = F.struct((F.col("done") - length).alias("lo"), F.col("done").alias("hi"))
    fixed = F.struct(micros(F.col("start_ts")).alias("lo"), micros(F.col("end_ts")).alias("hi"))
    chosen = (
        F.when(kind == "recent_completed", recent).when(kind.isin(*FIXED), fixed).when(kind.isin(*PREVIOUS), F.col("before")).when(kind == "previous_sessions", many)
        .when((kind == "power_hour") & F.col("fallback"), F.col("started")).otherwise(F.col("current"))
    )
    rows = asked.join(got, "request_id").withColumn("_w", chosen).withColumns({"_lo": F.col("_w.lo"), "_hi": F.least("_w.hi", "done")})
    late = ~kind.isin("recent_completed", *FIXED) & (F.col("_w.hi") > F.col("_lo")) & (F.col("_lo") >= F.col("done"))
    good = (F.col("_hi") > F.col("_lo")) & ~late & kind.isin(*KINDS)
    retry = F.when(late, from_micros((F.floor(F.col("_lo") / step) + 1) * step))
    return rows.select(
        "request_id", "kind", F.when(good, "resolved").when(late, "unavailable").otherwise("failed").alias("status"),
        F.when(good, from_micros(F.col("_lo"))).alias("start_ts"), F.when(good, from_micros(F.col("_hi") - 1)).alias("end_ts"), retry.alias("retry_at"))


def _shape(kind: Column, open_ts: Column, close_ts: Column) -> tuple[Column, Column]:
    """Bounds inside one session, in microseconds."""
    o, c = micros(open_ts), micros(close_ts)
    lo, hi = anchored(open_ts, close_ts, F.col("anchor_boundary"), F.coalesce("offset_seconds", F.lit(0)), F.col("duration_seconds"))
    by_anchor, minutes = F.col("duration_seconds").isNotNull(), F.col("duration_minutes").cast("long") * 60_000_000
    begin = F.when(by_anchor, lo).when(kind == "power_hour", F.greatest(o, c - minutes)).when(kind == "named_phase_slice", o + F.col("start_offset_minutes").cast("long") * 60_000_000).otherwise(o)
    end = F.when(by_anchor, hi).when(kind == "opening_range", F.least(o + minutes, c)).when(kind == "named_phase_slice", o + F.col("end_offset_minutes").cast("long") * 60_000_000).otherwise(c)
    return begin, end
