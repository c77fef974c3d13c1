"""Queries over reports and guards."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import joins as J
from tidemark.operators import reports as R
from tidemark.plans.catalog import BAR, TR, query
from tidemark.plans.joining import _OUT, _outcomes
from tidemark.plans.storage import shared
from tidemark.sources import adapters as S
from tidemark.sources import catalog as C


@query("context_detections", """WITH r AS (SELECT user_id AS key, event_id AS commit_sequence, date_trunc('hour', ts) AS as_of, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN value > 50 THEN 'up' ELSE 'down' END AS state FROM events),
a AS (SELECT *, max(as_of) OVER (PARTITION BY key ORDER BY commit_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r), b AS (SELECT *, coalesce(as_of < top, false) AS stale FROM a),
c AS (SELECT *, last_value(CASE WHEN NOT stale THEN {'t': as_of, 's': state} END IGNORE NULLS) OVER (PARTITION BY key ORDER BY commit_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM b),
d AS (SELECT *, CASE WHEN l IS NULL THEN 'SEEDED' WHEN stale THEN 'STALE' WHEN as_of = l.t THEN 'CORRECTION' WHEN state <> 'unavailable' AND l.s <> 'unavailable' AND state <> l.s THEN 'TRANSITION' ELSE 'UNCHANGED' END AS status FROM c)
SELECT key, commit_sequence, as_of::TIMESTAMP AS as_of, state, status, CASE WHEN status = 'TRANSITION' THEN l.s END AS from_state FROM d""")
def context_detections(spark, sf):
    state = F.when(F.col("event_type") == "error", "unavailable").when(F.col("value") > 50, "up").otherwise("down")
    rows = S.table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("commit_sequence"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("as_of"), state.alias("state"))
    return R.detections(rows, ["key"], ["unavailable"])


@query("recent_identity_window")
def recent_identity_window(spark, sf):
    e = S.table(spark, sf, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("identity"))
    return R.recent_identities(e, "stream", "seq", "identity", 16, "stream string, seq bigint, identity bigint")


_NEAR = BAR + """, l AS (SELECT instrument, arg_max(close, open_ts)::DOUBLE AS last FROM bar GROUP BY 1), g AS (SELECT instrument, open_ts, low::DOUBLE AS lower, high::DOUBLE AS upper FROM bar QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY open_ts DESC) <= 50),
d AS (SELECT g.*, round(CASE WHEN last < lower THEN lower - last WHEN last > upper THEN last - upper ELSE 0 END, 6) AS distance FROM g JOIN l USING (instrument))"""


@query("visible_locations", f"WITH {_NEAR} SELECT instrument, open_ts, lower, upper, distance, row_number() OVER (PARTITION BY instrument ORDER BY distance, open_ts, lower, upper) AS rank FROM d QUALIFY rank <= 3")
def visible_locations(spark, sf):
    from tidemark.operators.bars import keep_last

    bars = S.hourly_bars(spark, sf)
    last = bars.groupBy("instrument").agg(F.max_by("close", "open_ts").cast("double").alias("last"))
    gaps = keep_last(bars, 50).select("instrument", "open_ts", F.col("low").cast("double").alias("lower"), F.col("high").cast("double").alias("upper")).join(last, "instrument")
    away = F.when(F.col("last") < F.col("lower"), F.col("lower") - F.col("last")).when(F.col("last") > F.col("upper"), F.col("last") - F.col("upper")).otherwise(F.lit(0.0))
    return R.nearest(gaps, ["instrument"], F.round(away, 6), 3, "open_ts", "lower", "upper")


@query("dispatch_within_slots", """WITH q AS (SELECT o_orderpriority AS provider, o_orderkey AS id, o_custkey % 13 AS priority, CASE WHEN o_orderkey % 97 = 0 THEN 'running' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'done' END AS status FROM orders),
b AS (SELECT provider, count(*) FILTER (status = 'running') AS in_flight FROM q GROUP BY 1), w AS (SELECT provider, id, priority, row_number() OVER (PARTITION BY provider ORDER BY priority DESC, id) AS place FROM q WHERE status = 'queued')
SELECT w.*, in_flight FROM w JOIN b USING (provider) WHERE place <= 60 - in_flight""")
def dispatch_within_slots(spark, sf):
    k = F.col("o_orderkey")
    q = S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("provider"), k.alias("id"), (F.col("o_custkey") % 13).alias("priority"), F.when(k % 97 == 0, "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"))
    return R.dispatch_within(q, 60)


@query("reference_report", "SELECT o_orderpriority AS instrument, CASE o_orderstatus WHEN 'F' THEN 'matched' WHEN 'O' THEN 'missing' ELSE 'ambiguous' END AS joined, count(*) AS annotations, count(*) FILTER (o_custkey % 3 = 0) AS complete, count(*) FILTER (o_custkey % 3 <> 0) AS draft, sum(o_custkey % 3)::BIGINT AS missing_fields FROM orders GROUP BY 1, 2")
def reference_report(spark, sf):
    c = F.col("o_custkey") % 3
    joined = F.when(F.col("o_orderstatus") == "F", "matched").when(F.col("o_orderstatus") == "O", "missing").otherwise("ambiguous")
    return R.reference_report(S.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("instrument"), joined.alias("joined"), (c == 0).alias("complete"), c.alias("missing")))


_OUT_BY = "SELECT '{d}' AS dimension, {x} AS value, horizon, count(*) AS n, count(ret) AS available, round(100.0 * count(*) FILTER (ret > 0) / nullif(count(ret), 0), 4)::DOUBLE AS favourable_pct, round(median(ret), 6) AS median_return, round(median(mfe), 6) AS median_mfe, round(median(mae), 6) AS median_mae FROM oe GROUP BY 2, 3"


@query("outcome_report_by", f"WITH {_OUT}, oe AS (SELECT *, CASE WHEN hour(strptime(event_id[-19:], '%Y-%m-%d %H:%M:%S')) < 12 THEN 'early' ELSE 'late' END AS kind, split_part(event_id, '|', 1) AS role FROM outcome) " + " UNION ALL ".join(_OUT_BY.format(d=d, x=d) for d in ("kind", "role", "reason")))
def outcome_report_by(spark, sf):
    hour = F.hour(F.to_timestamp(F.substring("event_id", -19, 19)))
    o = _outcomes(spark, sf).withColumns({"kind": F.when(hour < 12, "early").otherwise("late"), "role": F.split_part("event_id", F.lit("|"), F.lit(1))})
    return R.outcome_by(o, "kind").unionByName(R.outcome_by(o, "role")).unionByName(R.outcome_by(o, "reason"))


@query("option_coverage_report", """WITH c AS (SELECT p_brand, CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS bid, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS ask, CASE WHEN p_size % 5 <> 0 THEN 1 END AS d, CASE WHEN p_size % 7 <> 0 THEN 1 END AS g, CASE WHEN p_partkey % 4 <> 0 THEN 1 END AS v, CASE WHEN p_partkey % 9 <> 0 THEN 1 END AS t FROM part)
SELECT p_brand, count(*) AS contracts, count(*) FILTER (bid IS NOT NULL AND ask IS NOT NULL) AS quoted, round(100.0 * count(*) FILTER (bid IS NOT NULL AND ask IS NOT NULL) / count(*), 4)::DOUBLE AS quoted_pct, count(d) AS with_delta, count(g) AS with_gamma, count(v) AS with_vega, count(t) AS with_theta,
 round(100.0 * count(*) FILTER (d + g + v + t IS NOT NULL) / count(*), 4)::DOUBLE AS greeks_pct FROM c GROUP BY 1""")
def option_coverage_report(spark, sf):
    size, part = F.col("p_size"), F.col("p_partkey")
    nan = F.lit(float("nan"))
    c = S.table(spark, sf, "part").select(
        "p_brand", F.when(size % 2 == 0, F.col("p_retailprice")).alias("bid"), F.when(size % 3 != 0, F.col("p_retailprice")).alias("ask"), F.when(size % 5 != 0, 0.5).otherwise(nan).alias("delta"), F.when(size % 7 != 0, 0.1).alias("gamma"),
        F.when(part % 4 != 0, 0.2).alias("vega"), F.when(part % 9 != 0, 0.3).otherwise(nan).alias("theta"))
    return R.contract_coverage(c, ["p_brand"])


@query("parameter_envelope", """SELECT p_partkey, concat_ws(',', CASE WHEN v IS NULL THEN 'missing' END, CASE WHEN v < 5 THEN 'below_minimum' END, CASE WHEN v > 40 THEN 'above_maximum' END, CASE WHEN (v - 5) % 2.5 <> 0 THEN 'off_grid' END) AS faults,
 CASE WHEN p_brand NOT IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 'not_allowed' ELSE '' END AS brand_faults FROM (SELECT *, CASE WHEN p_partkey % 11 <> 0 THEN p_size::DECIMAL(10,2) END AS v FROM part)""")
def parameter_envelope(spark, sf):
    v = F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("decimal(10,2)"))
    faults = R.parameter_faults(v, Decimal("5"), Decimal("40"), Decimal("2.5"))
    return S.table(spark, sf, "part").select("p_partkey", faults.alias("faults"), R.parameter_faults(F.col("p_brand"), allowed=("Brand#11", "Brand#22", "Brand#33")).alias("brand_faults"))


@query("resource_peaks", f"WITH {TR} SELECT instrument, ts, seq, round(max(price) OVER (PARTITION BY instrument ORDER BY ts, seq ROWS UNBOUNDED PRECEDING), 6)::DOUBLE AS peak, (price - lag(price, 15) OVER (PARTITION BY instrument ORDER BY ts, seq))::DOUBLE AS growth FROM tr")
def resource_peaks(spark, sf):
    out = R.running_peak(S.trades(spark, sf).select("instrument", "ts", "seq", "price"), "instrument", ["ts", "seq"], "price", 15)
    return out.select("instrument", "ts", "seq", F.col("peak").cast("double").alias("peak"), F.col("growth").cast("double").alias("growth"))


@query("print_counts", "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN user_id % 9 END AS prints FROM events")
def print_counts(spark, sf):
    u = F.col("user_id")
    text = F.when(u % 3 != 0, F.concat((u % 9).cast("string"), F.lit(" prints in 250ms"))).otherwise("single large print of 12 lots")
    return S.table(spark, sf, "events").select("event_id", R.print_count(text).alias("prints"))


@query("committed_context_join", """WITH f AS (SELECT user_id % 20 AS key, CASE WHEN value > 50 THEN '1h' ELSE '5m' END AS tf, date_trunc('minute', ts) AS as_of, event_id AS id FROM events WHERE event_type IN ('view', 'click') AND event_id NOT IN (SELECT event_id FROM events WHERE value < 5)),
k AS (SELECT key, tf, as_of, count(*) AS n FROM f GROUP BY ALL), e AS (SELECT event_id, user_id % 20 AS key, ts, unnest(['1h', '5m']) AS tf FROM events WHERE event_type = 'purchase')
SELECT e.event_id, e.tf, CASE WHEN k.as_of IS NULL THEN 'missing' WHEN e.ts - k.as_of > CASE e.tf WHEN '1h' THEN INTERVAL 2 HOUR ELSE INTERVAL 10 MINUTE END THEN 'stale' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM e ASOF LEFT JOIN k ON e.key = k.key AND e.tf = k.tf AND e.ts >= k.as_of""")
def committed_context_join(spark, sf):
    events = S.table(spark, sf, "events")
    committed = events.where("value >= 5").select("event_id")
    tf = F.when(F.col("value") > 50, "1h").otherwise("5m")
    f = events.where("event_type IN ('view', 'click')").join(committed, "event_id", "left_semi").select(F.concat_ws("|", (F.col("user_id") % 20).cast("string"), tf).alias("key"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("as_of"), F.col("event_id").alias("id"))
    e = events.where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 20).cast("string").alias("k"), "ts", F.explode(F.array(F.lit("1h"), F.lit("5m"))).alias("tf")).withColumn("key", F.concat_ws("|", "k", "tf")).drop("k")
    limit = lambda name, seconds: J.asof_with_ties(e.where(F.col("tf") == name), f.where(F.col("key").endswith("|" + name)), "key", max(2 * seconds, 120))
    return limit("1h", 3600).unionByName(limit("5m", 300)).select("event_id", "tf", "status")


@query("reference_csv", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority FROM orders")
def reference_csv(spark, sf):
    path = shared(spark, "reference-csv")
    rows = S.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderpriority")
    rows.write.option("header", True).csv(path)
    return C.read_reference(spark, path, rows.schema)


@query("sorted_jsonl", "SELECT c_custkey, c_mktsegment FROM customer")
def sorted_jsonl(spark, sf):
    path = shared(spark, "jsonl")
    rows = S.table(spark, sf, "customer").select("c_mktsegment", "c_custkey")
    C.write_jsonl(rows, path, ["c_custkey"])
    return spark.read.schema("c_custkey bigint, c_mktsegment string").json(path)


@query("markdown_report", "SELECT '| ' || o_orderpriority || ' | ' || count(*) || ' |' AS value FROM orders GROUP BY o_orderpriority")
def markdown_report(spark, sf):
    path = shared(spark, "report")
    C.write_report(S.table(spark, sf, "orders").groupBy("o_orderpriority").count(), path, "Orders", ["o_orderpriority", "count"])
    return spark.read.text(path).where("value RLIKE '^[|] [0-9]-'")


@query("record_ids", f"WITH {BAR} SELECT instrument, open_ts, sha256(concat_ws('|', 'location', 'd1', instrument, CASE WHEN close > open THEN 'LONG' ELSE 'SHORT' END, strftime(open_ts, '%Y-%m-%d %H:%M:%S'))) AS signal_id, sha256(concat_ws('|', instrument, '1h', 'support', low::VARCHAR, high::VARCHAR)) AS zone_id FROM bar")
def record_ids(spark, sf):
    side = F.when(F.col("close") > F.col("open"), "LONG").otherwise("SHORT")
    return S.hourly_bars(spark, sf).select("instrument", "open_ts", C.identity("location", "d1", F.col("instrument"), side, F.date_format("open_ts", "yyyy-MM-dd HH:mm:ss")).alias("signal_id"), C.identity(F.col("instrument"), "1h", "support", F.col("low").cast("string"), F.col("high").cast("string")).alias("zone_id"))

