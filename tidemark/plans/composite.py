"""Queries that combine operators: context snapshots, chart data, notices, machines, control tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.functions.carry import islands, peak_before, previous, running, with_halo, without_halo
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import machines as Z
from tidemark.operators import measurements as M
from tidemark.operators import normalize
from tidemark.operators import profile as P
from tidemark.plans.bars_and_flow import _classified
from tidemark.plans.catalog import BAR, SIDE, TR, dbl, doubles, query
from tidemark.plans.context import _AREA, _ATR, _EMA, _PROF, _SWING
from tidemark.sources import adapters as S
from tidemark.sources.config import default_registry


@query("market_context_snapshot", f"""{_EMA}, tt AS (SELECT *, lag(ema20, 5) OVER (PARTITION BY instrument ORDER BY open_ts) AS back FROM m), last AS (SELECT * FROM tt QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) = 1),
{_ATR.split(', ', 1)[1].replace(BAR.split(', ', 1)[1] + ', ', '')},
v AS (SELECT instrument, round(sum((high + low + close)::DOUBLE / 3 * volume::DOUBLE) / sum(volume::DOUBLE), 6) AS vwap, max(high) AS h, min(low) AS l FROM bar WHERE date_trunc('day', open_ts) = (SELECT max(date_trunc('day', open_ts)) FROM bar) GROUP BY 1)
SELECT last.instrument, last.open_ts, last.close, ema20, ema50, ema200, CASE WHEN i < 50 THEN 'insufficient' WHEN last.close > ema20 AND ema20 > ema50 AND ema20 > back THEN 'bullish' WHEN last.close < ema20 AND ema20 < ema50 AND ema20 < back THEN 'bearish' ELSE 'range' END AS trend,
 atr.atr, v.vwap, CASE WHEN last.close > v.vwap THEN 'above' WHEN last.close < v.vwap THEN 'below' ELSE 'at' END AS vwap_side FROM last JOIN atr USING (instrument, open_ts) LEFT JOIN v USING (instrument)""")
def market_context_snapshot(spark, sf):
    bars = M.with_utc_session(S.hourly_bars(spark, sf))
    newest = Window.partitionBy("instrument").orderBy(F.desc("open_ts"))
    last = I.trend(I.ema(bars, [20, 50, 200])).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    day = bars.agg(F.max("session").alias("_d"))
    v = bars.join(F.broadcast(day), F.col("session") == F.col("_d")).groupBy("instrument").agg(M.vwap().alias("vwap"))
    out = last.join(I.atr(bars).select("instrument", "open_ts", "atr"), ["instrument", "open_ts"]).join(v, "instrument", "left")
    side = F.when(F.col("close") > F.col("vwap"), "above").when(F.col("close") < F.col("vwap"), "below").otherwise("at")
    return out.select("instrument", "open_ts", "close", "ema20", "ema50", "ema200", "trend", "atr", "vwap", side.alias("vwap_side"))


@query("prior_session_profile", f"""WITH RECURSIVE {_PROF.format(keys='instrument, session', where='')}{_AREA.format(keys='instrument, session')}, l AS (SELECT *, lead(session) OVER (PARTITION BY instrument ORDER BY session) AS nxt FROM area)
SELECT instrument, nxt AS session, poc, value_area_low, value_area_high FROM l WHERE nxt IS NOT NULL""")
def prior_session_profile(spark, sf):
    keys = ["instrument", "session"]
    area = P.value_area(P.profile_bins(M.with_utc_session(S.hourly_bars(spark, sf)), keys, 5), keys)
    nxt = F.lead("session").over(Window.partitionBy("instrument").orderBy("session"))
    return area.withColumn("_n", nxt).where("_n IS NOT NULL").select("instrument", F.col("_n").alias("session"), "poc", "value_area_low", "value_area_high")


@query("named_session_ranges", f"""WITH {BAR}, z AS (SELECT *, timezone('Europe/London', timezone('UTC', open_ts)) AS ldn, timezone('America/New_York', timezone('UTC', open_ts)) AS ny FROM bar),
r AS (SELECT instrument, date_trunc('day', ldn)::TIMESTAMP AS day, 'london' AS name, high, low FROM z WHERE strftime(ldn, '%H:%M') >= '08:00' AND strftime(ldn, '%H:%M') < '11:30' UNION ALL SELECT instrument, date_trunc('day', ny)::TIMESTAMP, 'new_york', high, low FROM z WHERE strftime(ny, '%H:%M') >= '09:30' AND strftime(ny, '%H:%M') < '16:00')
SELECT instrument, day, name, max(high)::DOUBLE AS high, min(low)::DOUBLE AS low FROM r GROUP BY ALL""")
def named_session_ranges(spark, sf):
    bars, out = S.hourly_bars(spark, sf), None
    for name, zone, a, b in (("london", "Europe/London", "08:00", "11:30"), ("new_york", "America/New_York", "09:30", "16:00")):
        local = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("open_ts"))
        clock = F.date_format(local, "HH:mm")
        part = bars.where((clock >= a) & (clock < b)).groupBy("instrument", F.date_trunc("day", local).cast("timestamp_ntz").alias("day"), F.lit(name).alias("name")).agg(F.max("high").cast("double").alias("high"), F.min("low").cast("double").alias("low"))
        out = part if out is None else out.unionByName(part)
    return out


@query("closed_hours", "WITH d AS (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS d FROM events), a AS (SELECT unnest(range(d, d + INTERVAL 1 DAY, INTERVAL 1 HOUR)) AS open_ts FROM d) SELECT open_ts FROM a WHERE hour(open_ts) NOT BETWEEN 8 AND 20")
def closed_hours(spark, sf):
    day = S.table(spark, sf, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("d")).distinct()
    every = day.select(F.explode(F.sequence(F.col("d"), F.col("d") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR"))).alias("open_ts"))
    return every.join(every.where(F.hour("open_ts").between(8, 20)), "open_ts", "left_anti")


@query("chart_dataset", f"""WITH {_ATR}, top AS (SELECT instrument FROM bar GROUP BY 1 ORDER BY count(*) DESC, instrument LIMIT 1) SELECT instrument, open_ts, {dbl('open', 'high', 'low', 'close')}, atr FROM atr WHERE instrument IN (SELECT instrument FROM top) QUALIFY row_number() OVER (ORDER BY open_ts DESC) <= 120""")
def chart_dataset(spark, sf):
    bars = S.hourly_bars(spark, sf)
    best = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "instrument").limit(1).select("instrument")
    return doubles(I.atr(bars).join(F.broadcast(best), "instrument", "left_semi").orderBy(F.desc("open_ts")).limit(120).select("instrument", "open_ts", "open", "high", "low", "close", "atr"), "open", "high", "low", "close")


@query("eligible_bars", f"""WITH {BAR}, l AS (SELECT date_trunc('day', max(ts))::TIMESTAMP AS day FROM events)
SELECT instrument, open_ts, close::DOUBLE AS close FROM bar, l WHERE n_trades > 1 AND open_ts >= day - INTERVAL 2 DAY AND close_ts <= day""")
def eligible_bars(spark, sf):
    """Bars of more than one trade in the two whole days before the last one."""
    last = S.table(spark, sf, "events").agg(F.date_trunc("day", F.max("ts")).cast("timestamp_ntz").alias("day"))  # one row
    inside = (F.col("open_ts") >= F.col("day") - F.expr("INTERVAL 2 DAYS")) & (F.col("close_ts") <= F.col("day"))
    b = S.hourly_bars(spark, sf).where("n_trades > 1").crossJoin(F.broadcast(last)).where(inside)
    return doubles(b.select("instrument", "open_ts", "close"), "close")


@query("active_source_rule", f"WITH {BAR}, s AS (SELECT instrument, open_ts, CASE WHEN n_trades % 2 = 0 THEN 'classified_ticks' ELSE 'provider' END AS source FROM bar) SELECT * FROM s WHERE instrument <> 'click' OR source = 'classified_ticks'")
def active_source_rule(spark, sf):
    s = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.when(F.col("n_trades") % 2 == 0, "classified_ticks").otherwise("provider").alias("source"))
    return s.where((F.col("instrument") != "click") | (F.col("source") == "classified_ticks"))


@query("source_quality_map", """SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'READY' ELSE ['READY', 'DEGRADED', 'STALE', 'UNAVAILABLE'][user_id % 4 + 1] END AS health, CASE WHEN user_id % 4 = 0 OR user_id % 4 = 4 THEN 'REPORTED' ELSE 'PARTIAL' END AS fidelity FROM events""")
def source_quality_map(spark, sf):
    k = F.col("user_id") % 4
    health, fidelity = normalize.source_quality(F.when(k == 0, "historical").otherwise("live"), F.element_at(F.array(*map(F.lit, ["HEALTHY", "DEGRADED", "STALE", "GONE"])), (k + 1).cast("int")))
    return S.table(spark, sf, "events").select("event_id", health.alias("health"), fidelity.alias("fidelity"))


@query("approach_alerts", f"""WITH {_SWING}, s AS (SELECT instrument, max(price) AS level FROM levels WHERE kind = 'support' GROUP BY 1), d AS (SELECT instrument, open_ts AS ts, abs(close - level)::DOUBLE AS distance FROM bar JOIN s USING (instrument)),
m AS (SELECT *, last(CASE WHEN distance <= 10 THEN 1 WHEN distance > 40 THEN 0 END IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM d)
SELECT instrument, ts, distance, distance <= 10 AND coalesce(p, 0) = 0 AS fired FROM m""")
def approach_alerts(spark, sf):
    bars = S.hourly_bars(spark, sf)
    level = I.swing_levels(bars).where("kind = 'support'").groupBy("instrument").agg(F.max("price").alias("level"))
    return Z.approach_alerts(bars.join(level, "instrument").select("instrument", F.col("open_ts").alias("ts"), F.abs(F.col("close") - F.col("level")).cast("double").alias("distance")), 10.0, 40.0)


@query("narrative_suppression", "WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) SELECT user_id, event_id, event_type FROM p WHERE NOT (event_type IN ('click', 'view') AND event_type IS NOT DISTINCT FROM prev)")
def narrative_suppression(spark, sf):
    return Z.suppress_repeats(S.table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type", ["click", "view"])


@query("bias_change", f"WITH {BAR}, s AS (SELECT instrument, open_ts, sign(close - open)::INTEGER AS score, lag(sign(close - open)::INTEGER) OVER (PARTITION BY instrument ORDER BY open_ts) AS prev FROM bar) SELECT instrument, open_ts, prev AS from_score, score AS to_score FROM s WHERE prev IS NOT NULL AND prev <> score")
def bias_change(spark, sf):
    w = Window.partitionBy("instrument").orderBy("open_ts")
    s = S.hourly_bars(spark, sf).select("instrument", "open_ts", F.signum((F.col("close") - F.col("open")).cast("double")).cast("int").alias("to_score"))
    return s.withColumn("from_score", F.lag("to_score").over(w)).where("from_score IS NOT NULL AND from_score <> to_score")


@query("session_percent_change", f"""WITH {BAR}, s AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, arg_max(close, open_ts)::DOUBLE AS close FROM bar GROUP BY ALL), p AS (SELECT *, lag(close) OVER (PARTITION BY instrument ORDER BY session) AS prev FROM s) SELECT instrument, session, round(CASE WHEN prev <> 0 THEN 100 * (close - prev) / abs(prev) END, 6) AS change FROM p""")
def session_percent_change(spark, sf):
    s = M.with_utc_session(S.hourly_bars(spark, sf)).groupBy("instrument", "session").agg(F.max_by("close", "open_ts").cast("double").alias("close"))
    return s.select("instrument", "session", Z.percent_change(F.col("close"), F.lag("close").over(Window.partitionBy("instrument").orderBy("session"))).alias("change"))


@query("location_zones", f"""WITH {_SWING}, a AS (SELECT instrument, avg(high - low)::DOUBLE AS unit FROM b GROUP BY 1), z AS (SELECT instrument, kind AS source, price::DOUBLE - 0.15 * unit AS lower, price::DOUBLE + 0.15 * unit AS upper, touches FROM levels JOIN a USING (instrument)),
c AS (SELECT instrument, arg_max(close, open_ts)::DOUBLE AS close FROM bar GROUP BY 1)
SELECT instrument, source, round(lower, 4) AS lower, round(upper, 4) AS upper, touches, round(CASE WHEN close < lower THEN lower - close WHEN close > upper THEN close - upper ELSE 0 END, 4) AS distance FROM z JOIN c USING (instrument)""")
def location_zones(spark, sf):
    bars = S.hourly_bars(spark, sf)
    recent = bars.withColumn("_r", F.row_number().over(Window.partitionBy("instrument").orderBy(F.desc("open_ts")))).where("_r <= 500")
    unit = recent.groupBy("instrument").agg(F.avg(F.col("high") - F.col("low")).cast("double").alias("unit"))
    close = bars.groupBy("instrument").agg(F.max_by("close", "open_ts").cast("double").alias("close"))
    p, tol = F.col("price").cast("double"), 0.15 * F.col("unit")
    z = I.swing_levels(bars).join(unit, "instrument").join(close, "instrument").select("instrument", F.col("kind").alias("source"), (p - tol).alias("lower"), (p + tol).alias("upper"), "touches", "close")
    gap = F.when(F.col("close") < F.col("lower"), F.col("lower") - F.col("close")).when(F.col("close") > F.col("upper"), F.col("close") - F.col("upper")).otherwise(F.lit(0.0))
    return z.select("instrument", "source", F.round("lower", 4).alias("lower"), F.round("upper", 4).alias("upper"), "touches", F.round(gap, 4).alias("distance"))


@query("nearest_aggression_location", f"""WITH {_SWING}, l AS (SELECT instrument, kind || '@' || price::VARCHAR AS name, price FROM levels), t AS (SELECT instrument, seq, price FROM tr WHERE size >= 98)
SELECT t.instrument, t.seq, arg_min(l.name, (abs(l.price - t.price), l.name)) AS location FROM t JOIN l USING (instrument) GROUP BY ALL""")
def nearest_aggression_location(spark, sf):
    levels = I.swing_levels(S.hourly_bars(spark, sf)).select("instrument", F.concat_ws("@", "kind", F.col("price").cast("string")).alias("name"), F.col("price").alias("level"))
    t = S.trades(spark, sf).where("size >= 98").select("instrument", "seq", "price")
    # one sorted array of levels per instrument, not a row per (trade, level)
    packed = levels.groupBy("instrument").agg(F.collect_list(F.struct("level", "name")).alias("ls"))
    best = F.array_min(F.transform("ls", lambda x: F.struct(F.abs(x["level"] - F.col("price")).alias("d"), x["name"].alias("name"))))
    return t.join(packed, "instrument").select("instrument", "seq", best["name"].alias("location"))


@query("bar_impulse_confirmation", f"""WITH {BAR}, i AS (SELECT *, sum(nw) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN lag(close_ts) OVER (PARTITION BY instrument ORDER BY open_ts) = open_ts THEN 0 ELSE 1 END AS nw FROM bar)),
w AS (SELECT instrument, open_ts, count(*) FILTER (close > open) OVER w AS up, count(*) OVER w AS n, close, max(high) OVER w AS h, min(low) OVER w AS l FROM i WINDOW w AS (PARTITION BY instrument, island ORDER BY open_ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
r AS (SELECT instrument, open_ts, round(up / n, 6)::DOUBLE AS directional_ratio, round(CASE WHEN h > l THEN (close - l)::DOUBLE / (h - l)::DOUBLE ELSE 0.5 END, 6) AS close_location FROM w WHERE n = 3)
SELECT *, concat_ws(',', CASE WHEN directional_ratio < 0.66 THEN 'directional_bars' END, CASE WHEN close_location < 0.65 THEN 'close_location' END) AS failures FROM r""")
def bar_impulse_confirmation(spark, sf):
    b = islands(S.hourly_bars(spark, sf), ["instrument"], "open_ts", "close_ts")
    w = Window.partitionBy("instrument", "island").orderBy("open_ts").rowsBetween(-2, 0)
    h, lo = F.max("high").over(w), F.min("low").over(w)
    r = b.select("instrument", "open_ts", F.count(F.lit(1)).over(w).alias("n"), F.round(F.sum((F.col("close") > F.col("open")).cast("int")).over(w) / F.count(F.lit(1)).over(w), 6).alias("directional_ratio"), F.round(F.when(h > lo, (F.col("close") - lo).cast("double") / (h - lo).cast("double")).otherwise(F.lit(0.5)), 6).alias("close_location")).where("n = 3").drop("n")
    return r.withColumn("failures", F.array_join(F.array_compact(F.array(F.when(F.col("directional_ratio") < 0.66, "directional_bars"), F.when(F.col("close_location") < 0.65, "close_location"))), ","))


@query("resource_cpu_percent", f"WITH {TR}, c AS (SELECT instrument, ts, sum(size::DOUBLE) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS cpu, seq FROM tr), p AS (SELECT *, lag(cpu) OVER w AS pc, lag(ts) OVER w AS pt FROM c WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq)) SELECT instrument, seq, round(CASE WHEN pt IS NOT NULL AND ts > pt THEN 100 * (cpu - pc) / (epoch_us(ts) - epoch_us(pt)) * 1e6 END, 4) AS cpu_percent FROM p")
def resource_cpu_percent(spark, sf):
    key, order = ["instrument"], ["ts", "seq"]
    c = running(S.trades(spark, sf), key, order, {"cpu": F.col("size")}).withColumn("cpu", F.col("cpu").cast("double"))
    c = previous(c, key, order, {"cpu_before": F.col("cpu"), "before": F.col("ts")})
    dt = T.micros(F.col("ts")) - T.micros(F.col("before"))
    return c.select("instrument", "seq", F.round(F.when(dt > 0, 100 * (F.col("cpu") - F.col("cpu_before")) / dt * 1e6), 4).alias("cpu_percent"))


@query("rss_growth_window", f"WITH {TR} SELECT instrument, seq, (price - first(price) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))::DOUBLE AS growth, max(price) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::DOUBLE AS peak FROM tr")
def rss_growth_window(spark, sf):
    key, order = ["instrument"], ["ts", "seq"]
    t = peak_before(S.trades(spark, sf).select("instrument", "ts", "seq", "price"), key, order, "top", F.col("price"))
    w = Window.partitionBy("instrument", "_b").orderBy("ts", "seq")
    t = without_halo(with_halo(t, key, order, 4).withColumn("oldest", F.first("price").over(w.rowsBetween(-4, 0))))
    return t.select("instrument", "seq", (F.col("price") - F.col("oldest")).cast("double").alias("growth"), F.greatest("price", "top").cast("double").alias("peak"))


_HEALTH = {("starting", "click"): "ready", ("ready", "error"): "degraded", ("degraded", "error"): "failed", ("degraded", "view"): "ready", ("failed", "signup"): "starting"}
_MOVES = "CASE " + " ".join(f"WHEN r.s = '{a}' AND n.e = '{b}' THEN '{c}'" for (a, b), c in _HEALTH.items()) + " ELSE r.s END"


@query("system_health_machine", f"""WITH RECURSIVE n AS (SELECT user_id, event_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS e, '' AS f, 'starting' AS s FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, n.e, r.s, {_MOVES} FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT user_id, event_id, e AS event_type, f AS from_state, s AS to_state FROM r WHERE i > 0""")
def system_health_machine(spark, sf):
    return Z.table_machine(S.table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "starting", _HEALTH)


@query("instrument_switch_machine")
def instrument_switch_machine(spark, sf):
    """A switch (signup) needs a view and a click within two days, else it rolls back."""

    def make():
        state = {}

        def step(r):
            out = []
            if state and (r.ts - state["at"]).total_seconds() > 172_800:
                out.append((r.user_id, state["id"], "rolled_back"))
                state.clear()
            if r.event_type == "signup" and not state:
                state.update(at=r.ts, id=r.event_id, seen=set())
            elif state and r.event_type in ("view", "click"):
                state["seen"].add(r.event_type)
                if len(state["seen"]) == 2:
                    out.append((r.user_id, state["id"], "switched"))
                    state.clear()
            return out

        return step

    return Z.fold(S.table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "event_id", "user_id bigint, event_id bigint, outcome string", make)


@query("watchlist_state", "WITH a AS (SELECT user_id, ts, (event_id * 7919) % 10007 AS arrival FROM events), l AS (SELECT *, ts < max(ts) OVER (PARTITION BY user_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM a) SELECT user_id, max(ts) AS latest_ts, count(*) FILTER (late) AS out_of_order, count(*) AS observations FROM l GROUP BY 1")
def watchlist_state(spark, sf):
    """Beyond 10,007 events numbers of arrival repeat, which the SQL leaves open; here the event's id decides."""
    return Z.monotone_latest(S.table(spark, sf, "events").select("user_id", "ts", "event_id", ((F.col("event_id") * 7919) % 10007).alias("arrival")), "user_id", "ts", "arrival", "event_id")


@query("market_data_plan", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'active' WHEN c_nationkey < 5 THEN 'context' ELSE 'watch' END AS role, unnest(CASE WHEN c_custkey = 1 THEN ['trades', 'quotes', 'bars'] WHEN c_nationkey < 5 THEN ['bars'] ELSE ['quotes'] END) AS feed FROM customer")
def market_data_plan(spark, sf):
    role = F.when(F.col("c_custkey") == 1, "active").when(F.col("c_nationkey") < 5, "context").otherwise("watch")
    feeds = F.when(F.col("role") == "active", F.array(*map(F.lit, ["trades", "quotes", "bars"]))).when(F.col("role") == "context", F.array(F.lit("bars"))).otherwise(F.array(F.lit("quotes")))
    return S.table(spark, sf, "customer").select("c_custkey", role.alias("role")).select("c_custkey", "role", F.explode(feeds).alias("feed"))


@query("instrument_registry_check", "SELECT c_mktsegment AS venue, count(*) AS n, count(DISTINCT c_custkey) = count(*) AS unique_ids, count(*) FILTER (c_acctbal < -900) AS active, count(*) FILTER (c_acctbal < -900) = 1 AS one_active FROM customer GROUP BY 1")
def instrument_registry_check(spark, sf):
    n, a = F.count(F.lit(1)), F.count_if(F.col("c_acctbal") < -900)
    return S.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("venue")).agg(n.alias("n"), (F.countDistinct("c_custkey") == n).alias("unique_ids"), a.alias("active"), (a == 1).alias("one_active"))


@query("instrument_definitions_missing", "SELECT DISTINCT o_custkey AS instrument FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def instrument_definitions_missing(spark, sf):
    have = S.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("instrument"))
    return S.table(spark, sf, "orders").select(F.col("o_custkey").alias("instrument")).distinct().join(have, "instrument", "left_anti")


@query("merged_dependencies", "WITH d AS (SELECT o_custkey, o_orderpriority AS d FROM orders) SELECT o_custkey, string_agg(DISTINCT d, ',' ORDER BY d) AS dependencies FROM d GROUP BY 1")
def merged_dependencies(spark, sf):
    o = S.table(spark, sf, "orders")
    side = lambda c: o.where(c).groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("d"))
    a, b = side("o_orderkey % 2 = 0"), side("o_orderkey % 2 = 1").withColumnRenamed("d", "e")
    none = F.array().cast("array<string>")
    return a.join(b, "o_custkey", "full_outer").select("o_custkey", F.array_join(F.sort_array(F.array_union(F.coalesce("d", none), F.coalesce("e", none))), ",").alias("dependencies"))


@query("acceptance_report", f"WITH {TR}, c AS (SELECT 'trades_present' AS name, count(*) > 0 AS ok FROM tr UNION ALL SELECT 'prices_positive', bool_and(price > 0) FROM tr UNION ALL SELECT 'every_instrument_seen', count(DISTINCT instrument) = 5 FROM tr UNION ALL SELECT 'no_large_print', bool_and(size < 99) FROM tr) SELECT * FROM c UNION ALL SELECT 'verdict', bool_and(ok) FROM c")
def acceptance_report(spark, sf):
    t = S.trades(spark, sf).agg((F.count(F.lit(1)) > 0).alias("trades_present"), F.bool_and(F.col("price") > 0).alias("prices_positive"), (F.countDistinct("instrument") == 5).alias("every_instrument_seen"), F.bool_and(F.col("size") < 99).alias("no_large_print"))
    return Z.acceptance(t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("ok")) for c in t.columns))).alias("x")).select("x.*"))


@query("market_brief_cadence", f"WITH {BAR} SELECT DISTINCT instrument, close_ts AS as_of FROM bar WHERE hour(close_ts) % 4 = 0")
def market_brief_cadence(spark, sf):
    b = S.hourly_bars(spark, sf).where(F.hour("close_ts") % 4 == 0)
    return b.select("instrument", F.col("close_ts").alias("as_of")).dropDuplicates()


@query("feature_notices", f"WITH {BAR} SELECT 'feature|' || instrument || '|' || strftime(close_ts, '%Y-%m-%d %H:%M:%S') AS dedupe_key, instrument, close_ts AS as_of, close::DOUBLE AS value FROM bar")
def feature_notices(spark, sf):
    return S.hourly_bars(spark, sf).select(F.concat_ws("|", F.lit("feature"), "instrument", F.date_format("close_ts", "yyyy-MM-dd HH:mm:ss")).alias("dedupe_key"), "instrument", F.col("close_ts").alias("as_of"), F.col("close").cast("double").alias("value"))


@query("reference_sync", """WITH f AS (SELECT p_partkey AS path, p_name AS hash FROM part WHERE p_partkey % 5 <> 0), k AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN 'changed' ELSE p_name END AS hash FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(f.path, k.path) AS path, CASE WHEN k.path IS NULL THEN 'new' WHEN f.path IS NULL THEN 'missing' WHEN f.hash <> k.hash THEN 'changed_content' ELSE 'same' END AS status FROM f FULL JOIN k ON f.path = k.path""")
def reference_sync(spark, sf):
    p, i = S.table(spark, sf, "part"), F.col("p_partkey")
    f = p.where(i % 5 != 0).select(i.alias("path"), F.col("p_name").alias("h"))
    k = p.where(i % 3 != 0).select(i.alias("path"), F.when(i % 7 == 0, "changed").otherwise(F.col("p_name")).alias("g"))
    return f.join(k, "path", "full_outer").select("path", F.when(F.col("g").isNull(), "new").when(F.col("h").isNull(), "missing").when(F.col("h") != F.col("g"), "changed_content").otherwise("same").alias("status"))


@query("json_messages", """WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"k": 1, "z": 2}' WHEN event_id % 5 = 0 THEN '{"x": 1}' WHEN event_id % 11 = 0 THEN '{"k": null}' ELSE props END AS msg FROM events)
SELECT event_id, CAST(json_extract(msg, '$.k') AS BIGINT) AS k, json_keys(msg) = ['k'] AND json_extract_string(msg, '$.k') IS NOT NULL AS valid FROM m""")
def json_messages(spark, sf):
    from pyspark.sql.types import StructType

    i = F.col("event_id")
    message = F.when(i % 7 == 0, '{"k": 1, "z": 2}').when(i % 5 == 0, '{"x": 1}').when(i % 11 == 0, '{"k": null}').otherwise(F.col("props"))
    parsed = F.from_json("msg", StructType.fromDDL("k BIGINT"), {"mode": "PERMISSIVE"})
    exact = F.json_object_keys("msg") == F.array(F.lit("k"))
    return S.table(spark, sf, "events").select("event_id", message.alias("msg")).select("event_id", parsed["k"].alias("k"), (exact & parsed["k"].isNotNull()).alias("valid"))


@query("late_trade_counts", f"WITH {SIDE}, a AS (SELECT instrument, ts, (seq * 7919) % 10007 AS arrival FROM cl), l AS (SELECT instrument, date_trunc('hour', ts) < max(date_trunc('hour', ts)) OVER (PARTITION BY instrument ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS late FROM a) SELECT instrument, count(*) AS n, count(*) FILTER (late) AS late FROM l GROUP BY 1")
def late_trade_counts(spark, sf):
    """Numbers of arrival repeat as in ``watchlist_state``; the sequence number decides."""
    a = _classified(spark, sf).select("instrument", "seq", F.date_trunc("hour", "ts").alias("h"), ((F.col("seq") * 7919) % 10007).alias("arrival"))
    a = peak_before(a, ["instrument"], ["arrival", "seq"], "top", F.col("h"), F.floor(F.col("arrival") / 512))
    return a.withColumn("l", F.col("h") < F.col("top")).groupBy("instrument").agg(F.count(F.lit(1)).alias("n"), F.count_if("l").alias("late"))


@query("transition_notices", f"WITH {BAR}, d AS (SELECT instrument, close_ts AS ts, CASE WHEN close > open THEN 'up' ELSE 'down' END AS s FROM bar), x AS (SELECT *, lag(s) OVER (PARTITION BY instrument ORDER BY ts) AS p FROM d), t AS (SELECT * FROM x WHERE p <> s AND hour(ts) % 4 = 0) SELECT t.instrument, t.ts, t.p AS from_state, t.s AS to_state, b.close::DOUBLE AS context_close FROM t ASOF LEFT JOIN (SELECT * FROM bar WHERE hour(close_ts) % 6 = 0) b ON b.instrument = t.instrument AND t.ts >= b.close_ts")
def transition_notices(spark, sf):
    from tidemark.operators.signals import transitions

    bars = S.hourly_bars(spark, sf)
    d = bars.select("instrument", F.col("close_ts").alias("ts"), F.when(F.col("close") > F.col("open"), "up").otherwise("down").alias("s"))
    t = transitions(d, ["instrument"], "ts", "s", []).where(F.hour("ts") % 4 == 0).withColumn("seq", F.lit(0).cast("long"))
    ctx = bars.where(F.hour("close_ts") % 6 == 0).select("instrument", F.col("close_ts").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("close").cast("double").alias("value"))
    return J.point_in_time(t, {"c": ctx}).select("instrument", "ts", "from_state", "to_state", F.col("c_value").alias("context_close"))


_METRICS = sorted((m.metric_id, m.version, m.unit) for m in default_registry().metrics.values())


@query("metric_catalog", f"SELECT instrument, metric_id, version::BIGINT AS version, unit FROM (SELECT DISTINCT event_type AS instrument FROM events), (VALUES {', '.join(map(str, _METRICS))}) m(metric_id, version, unit)")
def metric_catalog(spark, sf):
    """The metrics that each instrument of the table is measured by."""
    metric = F.explode(F.array(*(F.struct(F.lit(i).alias("metric_id"), F.lit(v).cast("long").alias("version"), F.lit(u).alias("unit")) for i, v, u in _METRICS)))
    return S.trades(spark, sf).select("instrument").distinct().select("instrument", metric.alias("m")).select("instrument", "m.*")

