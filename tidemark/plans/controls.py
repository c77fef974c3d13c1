"""Queries over control tables; orders and events stand for their records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import control as C
from tidemark.plans.catalog import BAR, query
from tidemark.sources import adapters as S

_WHEN = "(SELECT time_bucket(INTERVAL 1 DAY, max(ts)) - INTERVAL 3 DAY AS now FROM events)"


def _events(spark, sf):
    return S.table(spark, sf, "events")


def _now(spark, sf):
    """Three days before the last event's day: one row."""
    return F.broadcast(_events(spark, sf).agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz").alias("now")))


@query("warmup_lookback", "SELECT p_partkey AS request, p_size::BIGINT AS sessions, greatest(2 * p_size, p_size + 4)::BIGINT AS days FROM part")
def warmup_lookback(spark, sf):
    n = F.col("p_size").cast("long")
    return S.table(spark, sf, "part").select(F.col("p_partkey").alias("request"), n.alias("sessions"), C.lookback_days(n).alias("days"))


@query("warmup_uncovered", "SELECT DISTINCT c_custkey AS instrument, o_orderpriority AS bar_type FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) WHERE (c_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders)")
def warmup_uncovered(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("instrument"), F.col("o_orderpriority").alias("bar_type"))
    kinds = orders.groupBy().agg(F.collect_set("bar_type").alias("k"))  # five priorities
    asked = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("instrument")).crossJoin(F.broadcast(kinds)).select("instrument", F.explode("k").alias("bar_type"))
    return C.uncovered(asked, orders, ["instrument", "bar_type"])


@query("system_control_state", """WITH p AS (SELECT user_id, event_type, count(*) % 7 <> 0 AS pr, max(value) > 40 AS av, bool_or(event_type = 'error' AND value > 90) AS fa FROM events GROUP BY 1, 2),
s AS (SELECT user_id AS system, count(*) AS instruments, concat_ws(',', CASE WHEN NOT bool_and(pr) THEN 'persistence_not_ready' END, CASE WHEN NOT bool_and(av) THEN 'instruments_missing' END, CASE WHEN bool_or(fa) THEN 'unresolved_failure' END) AS reasons FROM p GROUP BY 1)
SELECT system, instruments, CASE WHEN reasons = '' THEN 'READY' ELSE 'NOT_READY' END AS state, reasons FROM s""")
def system_control_state(spark, sf):
    e = _events(spark, sf).groupBy(F.col("user_id").alias("system"), "event_type").agg((F.count(F.lit(1)) % 7 != 0).alias("persistence_ready"), (F.max("value") > 40).alias("available"), F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("failed"))
    return C.control_state(e)


@query("plan_actions", """WITH p AS (SELECT o_custkey % 40 AS instrument, CASE WHEN o_orderkey % 2 = 0 THEN 'warmup' ELSE 'live' END AS role, CASE o_orderkey % 3 WHEN 0 THEN 'tick' WHEN 1 THEN '1m' ELSE '1h' END AS timeframe, 'u' || (o_orderkey % 23 % 2) || (o_custkey % 2) AS owner FROM orders),
i AS (SELECT instrument, owner, unnest(CASE WHEN role = 'warmup' THEN ['request_bars'] WHEN timeframe = 'tick' THEN ['subscribe_trades', 'subscribe_quotes'] ELSE ['subscribe_bars'] END) AS kind, CASE WHEN timeframe <> 'tick' THEN instrument || '-' || timeframe END AS bar_type FROM p WHERE NOT (role = 'warmup' AND timeframe = 'tick'))
SELECT instrument, kind, bar_type, count(DISTINCT owner) AS owners, min(owner) AS owner, CASE kind WHEN 'request_bars' THEN 1 WHEN 'subscribe_bars' THEN 2 WHEN 'subscribe_quotes' THEN 3 ELSE 4 END AS step, count(DISTINCT owner) = 1 AS accepted FROM i GROUP BY instrument, kind, bar_type""")
def plan_actions(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    plan = S.table(spark, sf, "orders").select(
        (c % 40).alias("instrument"), F.when(k % 2 == 0, "warmup").otherwise("live").alias("role"), F.when(k % 3 == 0, "tick").when(k % 3 == 1, "1m").otherwise("1h").alias("timeframe"),
        F.concat(F.lit("u"), (k % 23 % 2).cast("string"), (c % 2).cast("string")).alias("owner"))
    return C.lower_plan(plan)


@query("deferred_demands", f"""WITH e AS (SELECT user_id AS demand_id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'discard' ELSE 'retain' END AS action, ts + INTERVAL 2 DAY AS retry_at FROM events),
l AS (SELECT demand_id, arg_max(action, seq) AS action, arg_max(retry_at, seq) AS retry_at FROM e GROUP BY 1), h AS (SELECT demand_id, retry_at, retry_at <= now AS due FROM l, {_WHEN} WHERE action = 'retain')
SELECT *, (SELECT min(retry_at) FROM h) AS next_retry FROM h""")
def deferred_demands(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("demand_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "discard").otherwise("retain").alias("action"), (F.col("ts") + F.expr("INTERVAL 2 DAYS")).alias("retry_at"))
    now = _events(spark, sf).agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz")).first()[0]
    return C.deferred_demands(e, F.lit(now).cast("timestamp_ntz"))


def _machine_sql(moves, start, names, tail=""):
    move = "CASE " + " ".join(f"WHEN r.s = '{a}' AND n.e = '{b}' THEN '{c}'" for (a, b), c in moves.items()) + " ELSE r.s END"
    legal = "concat_ws('|', f, e) IN (" + ", ".join(f"'{a}|{b}'" for a, b in moves) + ")"
    return f"""WITH RECURSIVE n AS (SELECT user_id, event_id, CASE event_type {names} END AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
r AS (SELECT user_id, 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS e, '' AS f, '{start}' AS s FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.i, n.event_id, n.e, r.s, {move} FROM r JOIN n ON n.user_id = r.user_id AND n.i = r.i + 1)
SELECT user_id AS key, event_id AS seq, e AS event, f AS from_state, s AS to_state, {legal} AS legal{tail} FROM r WHERE i > 0"""


def _named_events(spark, sf, key, names):
    e = F.coalesce(*(F.when(F.col("event_type") == a, F.lit(b)) for a, b in names.items()))
    return _events(spark, sf).select(F.col("user_id").alias(key), F.col("event_id").alias("seq"), e.alias("event"))


_REC = {"view": "start", "click": "filled", "purchase": "remaining", "signup": "start", "error": "remaining"}
_EXE = {"view": "demand", "click": "submit", "purchase": "complete", "signup": "demand", "error": "fail"}
_cases = lambda names: " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items())


@query("recovery_lifecycle", _machine_sql(C.RECOVERY, "pending", _cases(_REC)))
def recovery_lifecycle(spark, sf):
    return C.recovery_lifecycle(_named_events(spark, sf, "recovery_id", _REC)).withColumnRenamed("recovery_id", "key")


@query("historical_execution", _machine_sql(C.EXECUTION, "idle", _cases(_EXE), ", e = 'demand' AND f NOT IN ('idle', 'done', 'failed') AS shared"))
def historical_execution(spark, sf):
    return C.execution(_named_events(spark, sf, "request_key", _EXE)).withColumnRenamed("request_key", "key")


_BAT = {"view": "prepare", "click": "write", "purchase": "acknowledge", "signup": "commit", "error": "prepare"}


@query("batch_commit_order", _machine_sql(C.BATCH, "new", _cases(_BAT)))
def batch_commit_order(spark, sf):
    return C.batch_commits(_named_events(spark, sf, "batch", _BAT)).withColumnRenamed("batch", "key")


@query("required_keys_present", "SELECT DISTINCT n_regionkey AS key FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def required_keys_present(spark, sf):
    """No row, or the batch fails: every nation has its region."""
    asked = S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("key"))
    return C.require_none(C.uncovered(asked, S.table(spark, sf, "region").select(F.col("r_regionkey").alias("key")), ["key"]), "missing: ")


@query("empty_recovery_confirmations", """WITH a AS (SELECT user_id AS key, ts, event_id AS seq, event_type IN ('view', 'click') AS empty FROM events), r AS (SELECT *, sum(CASE WHEN empty THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM a)
SELECT key, run, count(*) AS attempts, min(ts) AS first_ts, max(ts) AS last_ts, count(*) >= 3 AS confirmed FROM r WHERE empty GROUP BY 1, 2""")
def empty_recovery_confirmations(spark, sf):
    return C.empty_confirmations(_events(spark, sf).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_type").isin("view", "click").alias("empty")), 3)


_BOX = """ob AS (SELECT event_id AS outbox_id, CASE event_id % 4 WHEN 0 THEN 'delivered' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'leased' END AS status, ts AS created_ts, ts + INTERVAL 6 HOUR AS available_ts, CASE WHEN event_id % 4 = 3 THEN ts + INTERVAL 8 HOUR END AS lease_expires_ts, event_id % 6 AS attempts FROM events),
le AS (SELECT ob.*, now FROM ob, (SELECT time_bucket(INTERVAL 1 DAY, max(ts)) - INTERVAL 3 DAY AS now FROM events) WHERE attempts < 5 AND ((status IN ('pending', 'failed') AND available_ts <= now) OR (status = 'leased' AND lease_expires_ts <= now)) ORDER BY created_ts, outbox_id LIMIT 50)"""


def _outbox(spark, sf):
    i, t = F.col("event_id"), F.col("ts")
    return _events(spark, sf).select(
        i.alias("outbox_id"), F.when(i % 4 == 0, "delivered").when(i % 4 == 1, "pending").when(i % 4 == 2, "failed").otherwise("leased").alias("status"), t.alias("created_ts"),
        (t + F.expr("INTERVAL 6 HOURS")).alias("available_ts"), F.when(i % 4 == 3, t + F.expr("INTERVAL 8 HOURS")).alias("lease_expires_ts"), (i % 6).alias("attempts")).crossJoin(_now(spark, sf))


@query("outbox_lease", f"WITH {_BOX} SELECT outbox_id, created_ts, now + INTERVAL 60 SECOND AS lease_expires_ts, attempts + 1 AS attempts, 'leased' AS status, 'worker' AS lease_owner FROM le")
def outbox_lease(spark, sf):
    return C.lease(_outbox(spark, sf), F.col("now"), 50, 5, 60, "worker").select("outbox_id", "created_ts", "lease_expires_ts", "attempts", "status", "lease_owner")


@query("outbox_backoff", f"WITH {_BOX}, s AS (SELECT outbox_id, attempts + 1 AS attempts, now, CASE WHEN outbox_id % 3 = 0 THEN 'delivered' WHEN attempts + 1 >= 5 THEN 'dead' ELSE 'failed' END AS status FROM le) SELECT outbox_id, attempts, status, CASE WHEN status = 'failed' THEN now + least(power(2, attempts), 300)::BIGINT * INTERVAL 1 SECOND END AS available_ts FROM s")
def outbox_backoff(spark, sf):
    leased = C.lease(_outbox(spark, sf), F.col("now"), 50, 5, 60, "worker")
    return C.settle(leased, F.col("outbox_id") % 3 == 0, F.col("now"), 5).select("outbox_id", "attempts", "status", "available_ts")


@query("flush_chunks", """WITH RECURSIVE g AS (SELECT event_type AS stream, date_trunc('hour', ts) AS init_ts, count(*) AS n FROM events GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY init_ts) AS i FROM g),
r AS (SELECT stream, init_ts, n, i, 0::BIGINT AS chunk, n AS held FROM o WHERE i = 1 UNION ALL SELECT o.stream, o.init_ts, o.n, o.i, r.chunk + CASE WHEN r.held + o.n > 20 THEN 1 ELSE 0 END, CASE WHEN r.held + o.n > 20 THEN o.n ELSE r.held + o.n END FROM r JOIN o ON o.stream = r.stream AND o.i = r.i + 1)
SELECT stream, init_ts, n, chunk FROM r""")
def flush_chunks(spark, sf):
    e = _events(spark, sf).select(F.col("event_type").alias("stream"), T.anchored_floor(F.col("ts"), 3600).alias("init_ts"))
    return C.flush_chunks(e, ["stream"], "init_ts", 20, "stream string, init_ts timestamp_ntz")


@query("startup_suppression", f"SELECT event_id, ts AS evaluation_ts, ts <= now AS stale FROM events, {_WHEN}")
def startup_suppression(spark, sf):
    e = _events(spark, sf).select("event_id", F.col("ts").alias("evaluation_ts")).crossJoin(_now(spark, sf))
    return C.startup_suppressed(e, F.col("now")).drop("now")


@query("flush_ready_buckets", f"WITH b AS (SELECT epoch(ts)::BIGINT // 3600 AS bucket, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 SECOND, ts) AS ts FROM events) GROUP BY 1) SELECT bucket, n, (bucket + 1) * 3600 <= epoch(now) AS ready FROM b, {_WHEN}")
def flush_ready_buckets(spark, sf):
    now = _events(spark, sf).agg((F.date_trunc("day", F.max("ts")) - F.expr("INTERVAL 3 DAYS")).cast("timestamp_ntz")).first()[0]
    return C.ready_buckets(_events(spark, sf), "ts", 3600, F.lit(now).cast("timestamp_ntz"))


@query("evidence_publications", """WITH s AS (SELECT event_type AS instrument, ts, event_id AS seq, CASE WHEN value < 30 THEN 'STALE' ELSE 'HEALTHY' END AS state FROM events), p AS (SELECT *, lag(state) OVER w AS previous, row_number() OVER w % 10 = 0 AS checkpoint FROM s WINDOW w AS (PARTITION BY instrument ORDER BY ts, seq))
SELECT instrument, ts, seq, state, previous, state IS DISTINCT FROM previous AS publish, checkpoint FROM p WHERE state IS DISTINCT FROM previous OR checkpoint""")
def evidence_publications(spark, sf):
    s = _events(spark, sf).select(F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("seq"), F.when(F.col("value") < 30, "STALE").otherwise("HEALTHY").alias("state"))
    return C.publications(s, "instrument", ["ts", "seq"], "state", 10)


@query("stream_health_states", """WITH e AS (SELECT 'I' || (user_id % 5) AS instrument, ts, event_id AS seq, event_type = 'view' AS ck FROM events), c AS (SELECT * FROM e WHERE ck), q AS (SELECT * FROM e WHERE NOT ck),
j AS (SELECT c.instrument, c.ts, c.seq, q.ts AS last_ts FROM c ASOF LEFT JOIN q ON c.instrument = q.instrument AND c.ts >= q.ts)
SELECT *, CASE WHEN hour(ts) < 3 THEN 'paused' WHEN last_ts IS NULL THEN 'waiting' WHEN ts - last_ts > INTERVAL 90 MINUTE THEN 'stale' ELSE 'healthy' END AS state FROM j""")
def stream_health_states(spark, sf):
    e = _events(spark, sf).select(F.concat(F.lit("I"), F.pmod("user_id", F.lit(5))).alias("instrument"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "view").alias("check"))
    return C.stream_states(e.where("check").drop("check"), e.where("NOT check").drop("check"), F.hour("ts") >= 3, 5400)


@query("transactional_units", "SELECT l_orderkey AS unit, l_linenumber AS part, count(*) OVER (PARTITION BY l_orderkey) AS unit_rows FROM lineitem QUALIFY bool_and(l_quantity > 2) OVER (PARTITION BY l_orderkey)")
def transactional_units(spark, sf):
    parts = S.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("part"), "l_quantity")
    return C.accepted_units(parts, "unit", F.col("l_quantity") > 2).select("unit", "part", "unit_rows")


@query("checkpoint_continuity", """WITH e AS (SELECT o_custkey AS key, o_orderkey AS sequence, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prior, o_orderkey % 3 AS n_events FROM orders)
SELECT key, sequence, CASE WHEN prior IS NULL AND n_events > 0 THEN 'initial_cannot_emit' WHEN prior IS NOT NULL AND n_events > 0 AND sequence % 5 = 0 THEN 'discontinuous' ELSE 'committed' END AS verdict FROM e""")
def checkpoint_continuity(spark, sf):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    prior = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    e = S.table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), k.alias("sequence"), F.when(k % 5 == 0, prior - 1).otherwise(prior).alias("previous_sequence"), (k % 3).alias("n_events"))
    return C.checkpoint_continuity(e, "key").select("key", "sequence", "verdict")


@query("pruned_batches", "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def pruned_batches(spark, sf):
    b = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "committed").otherwise("open").alias("status"))
    return C.prune_batches(b, S.table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("batch_id"))).select("batch_id")


@query("dense_sequence", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS sequence FROM events")
def dense_sequence(spark, sf):
    return C.dense_sequence(_events(spark, sf).select("event_id", "ts"), "ts", "event_id").select("event_id", "sequence")


@query("forming_hours", f"WITH {BAR} SELECT instrument, max(open_ts) AS open_ts FROM bar GROUP BY 1")
def forming_hours(spark, sf):
    return S.hourly_bars(spark, sf).where("NOT is_complete").select("instrument", "open_ts")
