"""Queries over joins, sets, top-k, maintenance and control tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import bars as B
from tidemark.operators import indicators as I
from tidemark.operators import joins as J
from tidemark.operators import maintenance as X
from tidemark.operators import measurements as M
from tidemark.plans.catalog import BAR, TR, dbl, doubles, query
from tidemark.plans.context import _ATR, _SWING
from tidemark.sources import adapters as S

_B4 = "b4 AS (SELECT instrument, bucket, arg_max(close, open_ts)::DOUBLE AS close, bucket + INTERVAL 4 HOUR AS as_of FROM (SELECT *, date_trunc('day', open_ts) + INTERVAL 4 HOUR * (hour(open_ts) // 4) AS bucket FROM bar) GROUP BY ALL HAVING count(*) = 4)"


@query("multi_timeframe_bundle", f"""WITH {BAR}, {_B4}, e AS (SELECT instrument, ts, seq FROM tr)
SELECT e.instrument, e.ts, e.seq, h.close_ts AS h1_as_of, h.close::DOUBLE AS h1_value, f.as_of AS h4_as_of, f.close AS h4_value
FROM e ASOF LEFT JOIN bar h ON h.instrument = e.instrument AND e.ts >= h.close_ts ASOF LEFT JOIN b4 f ON f.instrument = e.instrument AND e.ts >= f.as_of""")
def multi_timeframe_bundle(spark, sf):
    bars = S.hourly_bars(spark, sf)
    long_ = B.session_aggregate(bars, 3600, 4 * 3600, F.date_trunc("day", "open_ts"))
    zero = F.lit(0).cast("long").alias("seq")
    feats = {"h1": bars.select("instrument", F.col("close_ts").alias("ts"), zero, F.col("close").cast("double").alias("value")),
             "h4": long_.select("instrument", (F.col("bucket") + F.expr("INTERVAL 4 HOURS")).alias("ts"), zero, F.col("close").cast("double").alias("value"))}
    return J.point_in_time(S.trades(spark, sf).select("instrument", "ts", "seq"), feats)


@query("context_join_with_ties", f"""WITH {BAR}, f AS (SELECT instrument, close_ts AS as_of, count(*) AS n FROM (SELECT instrument, close_ts FROM bar WHERE hour(close_ts) % 3 = 0 UNION ALL SELECT instrument, close_ts FROM bar WHERE hour(close_ts) % 6 = 0) GROUP BY ALL),
e AS (SELECT instrument, ts, seq FROM tr)
SELECT e.instrument, e.ts, e.seq, f.as_of, coalesce(f.n, 0) AS n_matches, CASE WHEN f.as_of IS NULL THEN 'missing' WHEN e.ts - f.as_of > INTERVAL 3 HOUR THEN 'stale' WHEN f.n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM e ASOF LEFT JOIN f ON f.instrument = e.instrument AND e.ts >= f.as_of""")
def context_join_with_ties(spark, sf):
    bars = S.hourly_bars(spark, sf)
    f = bars.where(F.hour("close_ts") % 3 == 0).select("instrument", F.col("close_ts").alias("as_of"), F.lit("a").alias("id")).unionByName(bars.where(F.hour("close_ts") % 6 == 0).select("instrument", F.col("close_ts").alias("as_of"), F.lit("b").alias("id")))
    return J.asof_with_ties(S.trades(spark, sf).select("instrument", "ts", "seq"), f, "instrument", 3 * 3600)


@query("annotation_interval_join", """SELECT a.event_id, b.event_id AS other_id, a.user_id, epoch(b.ts - a.ts)::DOUBLE AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'view' AND b.ts BETWEEN a.ts - INTERVAL 2 HOUR AND a.ts + INTERVAL 6 HOUR""")
def annotation_interval_join(spark, sf):
    e = S.table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other_id"), F.col("ts").alias("rts"))
    return J.interval_join(left, right, "user_id", 7200, 21600).select("event_id", "other_id", "user_id", ((T.micros(F.col("rts")) - T.micros(F.col("ts"))) / 1e6).alias("seconds"))


@query("zone_overlap_join", f"""WITH {_SWING}, z AS (SELECT instrument, price - 60 AS lower, price + 60 AS upper, price FROM levels WHERE kind = 'support'), y AS (SELECT instrument, price - 2 AS rl, price AS ru, price AS rprice FROM levels WHERE kind = 'resistance')
SELECT instrument, price::DOUBLE AS price, rprice::DOUBLE AS rprice FROM z JOIN y USING (instrument) WHERE lower <= ru AND upper >= rl""")
def zone_overlap_join(spark, sf):
    levels = I.swing_levels(S.hourly_bars(spark, sf))
    z = levels.where("kind = 'support'").select("instrument", "price", (F.col("price") - 60).alias("lower"), (F.col("price") + 60).alias("upper"))
    y = levels.where("kind = 'resistance'").select("instrument", F.col("price").alias("rprice"), (F.col("price") - 2).alias("rlower"), F.col("price").alias("rupper"))
    return doubles(J.overlap_join(z, y, "instrument", 4.0).select("instrument", "price", "rprice"), "price", "rprice")


@query("missing_feature_evidence", "SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def missing_feature_evidence(spark, sf):
    return J.missing_required(S.table(spark, sf, "customer").select(F.col("c_custkey").alias("key")), S.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key")), "key")


@query("replacement_lookup", """WITH r AS (SELECT o_custkey, o_orderpriority, count(*) AS candidates, min(o_orderkey) AS replacement FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)
SELECT o_orderkey, o_custkey, o_orderpriority, candidates, replacement, candidates > 1 AS ambiguous FROM orders JOIN r USING (o_custkey, o_orderpriority) WHERE o_orderstatus = 'F'""")
def replacement_lookup(spark, sf):
    o, keys = S.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"]
    return J.unique_lookup(o.where("o_orderstatus = 'F'").select("o_orderkey", *keys), o.where("o_orderstatus = 'P'").select(*keys, F.col("o_orderkey").alias("replacement")), keys)


@query("committed_key_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0)")
def committed_key_lookup(spark, sf):
    keys = S.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.table(spark, sf, "orders").join(keys, "o_custkey", "left_semi").select("o_orderkey", "o_totalprice")


_CLUSTER = _ATR + """, lv AS (SELECT instrument, low - 0.25 AS lower, low + 0.25 AS upper, CASE WHEN n_trades % 3 = 0 THEN 'level' WHEN n_trades % 3 = 1 THEN 'gap' ELSE 'value' END AS source, n_trades AS touches, (high - low)::DOUBLE AS distance FROM bar),
r AS (SELECT *, max(upper) OVER (PARTITION BY instrument ORDER BY lower, upper ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM lv),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR lower > reach THEN 1 ELSE 0 END) OVER (PARTITION BY instrument ORDER BY lower, upper ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM r),
cl AS (SELECT instrument, cluster, min(lower) AS lower, max(upper) AS upper, count(*) AS n_matches, count(DISTINCT source) AS n_sources, sum(touches)::BIGINT AS touches, round(avg(distance), 6) AS mean_distance FROM c GROUP BY ALL)"""


def _matches(spark, sf):
    n = F.col("n_trades")
    return S.hourly_bars(spark, sf).select("instrument", (F.col("low") - F.lit("0.25").cast("decimal(3,2)")).cast(T.PRICE).alias("lower"), (F.col("low") + F.lit("0.25").cast("decimal(3,2)")).cast(T.PRICE).alias("upper"), F.when(n % 3 == 0, "level").when(n % 3 == 1, "gap").otherwise("value").alias("source"), n.alias("touches"), (F.col("high") - F.col("low")).cast("double").alias("distance"))


@query("confluence_clusters", f"WITH {_CLUSTER} SELECT instrument, cluster, {dbl('lower', 'upper')}, n_matches, n_sources, touches, mean_distance FROM cl")
def confluence_clusters(spark, sf):
    return doubles(J.clusters(_matches(spark, sf), ["instrument"]), "lower", "upper")


@query("best_confluence_cluster", f"WITH {_CLUSTER} SELECT instrument, cluster, {dbl('lower', 'upper')}, n_sources, n_matches FROM cl QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY n_sources DESC, n_matches DESC, touches DESC, mean_distance, (upper - lower)::DOUBLE, lower, cluster) = 1")
def best_confluence_cluster(spark, sf):
    return doubles(J.best_cluster(J.clusters(_matches(spark, sf), ["instrument"]), ["instrument"]), "lower", "upper")


_OUT = BAR + """, o AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS session, open_ts, high::DOUBLE AS high, low::DOUBLE AS low, close::DOUBLE AS close, row_number() OVER (PARTITION BY instrument, date_trunc('day', open_ts) ORDER BY open_ts) AS ordinal FROM bar),
ev AS (SELECT instrument || '|' || strftime(open_ts, '%Y-%m-%d %H:%M:%S') AS event_id, instrument, session, ordinal, close AS reference, CASE WHEN ordinal % 2 = 0 THEN 1 ELSE -1 END AS sign FROM o),
h AS (SELECT ev.*, unnest([1, 3, 5]) AS horizon FROM ev),
j AS (SELECT h.event_id, h.horizon, count(o.close) AS n, arg_max(h.sign * (o.close - h.reference), o.ordinal) AS ret, max(CASE WHEN h.sign > 0 THEN o.high - h.reference ELSE h.reference - o.low END) AS mfe, max(CASE WHEN h.sign > 0 THEN h.reference - o.low ELSE o.high - h.reference END) AS mae
 FROM h LEFT JOIN o ON o.instrument = h.instrument AND o.session = h.session AND o.ordinal > h.ordinal AND o.ordinal <= h.ordinal + h.horizon GROUP BY ALL),
outcome AS (SELECT event_id, horizon::BIGINT AS horizon, round(CASE WHEN n = horizon THEN ret END, 6) AS ret, round(CASE WHEN n = horizon THEN greatest(mfe, 0) END, 6) AS mfe, round(CASE WHEN n = horizon THEN greatest(mae, 0) END, 6) AS mae, CASE WHEN n <> horizon THEN 'bars_missing' END AS reason FROM j)"""


def _outcomes(spark, sf):
    bars = M.with_utc_session(S.hourly_bars(spark, sf)).withColumn("ordinal", F.row_number().over(Window.partitionBy("instrument", "session").orderBy("open_ts")))
    events = bars.select(F.concat_ws("|", "instrument", F.date_format("open_ts", "yyyy-MM-dd HH:mm:ss")).alias("event_id"), "instrument", "session", "ordinal", F.col("close").cast("double").alias("reference"), F.when(F.col("ordinal") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return J.forward_outcome(events, bars, [1, 3, 5])


@query("forward_outcomes", f"WITH {_OUT} SELECT * FROM outcome")
def forward_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query("outcome_report", f"WITH {_OUT} SELECT horizon, count(*) AS n, count(ret) AS available, round(100.0 * count(*) FILTER (ret > 0) / nullif(count(ret), 0), 4)::DOUBLE AS favourable_pct, round(median(ret), 6) AS median_return, round(median(mfe), 6) AS median_mfe, round(median(mae), 6) AS median_mae FROM outcome GROUP BY 1")
def outcome_report(spark, sf):
    med = lambda c: F.round(F.median(c), 6)
    return _outcomes(spark, sf).groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.count("ret").alias("available"), F.round(100.0 * F.count_if(F.col("ret") > 0) / F.nullif(F.count("ret"), F.lit(0)), 4).alias("favourable_pct"), med("ret").alias("median_return"), med("mfe").alias("median_mfe"), med("mae").alias("median_mae"))


@query("event_reference_price", f"""WITH {BAR}, e AS (SELECT instrument, ts, seq FROM tr) SELECT e.instrument, e.ts, e.seq, CASE WHEN e.ts - b.close_ts <= INTERVAL 1 HOUR THEN b.close::DOUBLE END AS reference,
 CASE WHEN b.close_ts IS NULL THEN 'no_bar' WHEN e.ts - b.close_ts > INTERVAL 1 HOUR THEN 'stale_bar' END AS reason FROM e ASOF LEFT JOIN bar b ON b.instrument = e.instrument AND e.ts >= b.close_ts""")
def event_reference_price(spark, sf):
    bars = S.hourly_bars(spark, sf).select("instrument", F.col("close_ts").alias("ts"), F.lit(0).cast("long").alias("seq"), F.col("close").cast("double").alias("close"))
    out = T.last_before(S.trades(spark, sf).select("instrument", "ts", "seq"), bars, "instrument", "ts", "seq", "b")
    fresh = T.micros(F.col("ts")) - T.micros(F.col("b.ts")) <= 3_600_000_000
    return out.select("instrument", "ts", "seq", F.when(fresh, F.col("b.close")).alias("reference"), F.when(F.col("b").isNull(), "no_bar").when(~fresh, "stale_bar").alias("reason"))


_EXP = "ex AS (SELECT instrument, unnest(range((SELECT min(open_ts) FROM bar), (SELECT max(open_ts) FROM bar) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS open_ts FROM (SELECT DISTINCT instrument FROM bar))"


def _expected(spark, sf):
    """Every hour of every instrument between the first and the last bar of any."""
    bars = S.hourly_bars(spark, sf)
    bounds = F.broadcast(bars.agg(F.min("open_ts").alias("_lo"), F.max("open_ts").alias("_hi")))  # one row
    hours = F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 HOUR")))
    return bars.select("instrument").distinct().crossJoin(bounds).select("instrument", hours.alias("open_ts"))


_GAPS = BAR + ", " + _EXP + """, ms AS (SELECT ex.* FROM ex ANTI JOIN bar USING (instrument, open_ts)), r AS (SELECT *, CASE WHEN open_ts - lag(open_ts) OVER (PARTITION BY instrument ORDER BY open_ts) = INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM ms),
s AS (SELECT *, sum(n) OVER (PARTITION BY instrument ORDER BY open_ts ROWS UNBOUNDED PRECEDING) AS run FROM r), c AS (SELECT *, (row_number() OVER (PARTITION BY instrument, run ORDER BY open_ts) - 1) // 2 AS chunk FROM s),
plan AS (SELECT instrument, min(open_ts) AS start_ts, max(open_ts) + INTERVAL 1 HOUR AS end_ts, count(*) AS n FROM c GROUP BY instrument, run, chunk)"""


@query("gap_plan", f"WITH {_GAPS} SELECT * FROM plan")
def gap_plan(spark, sf):
    return X.gap_plan(_expected(spark, sf), S.hourly_bars(spark, sf), 3600, 2)


@query("gap_requests_round_robin", f"WITH {_GAPS} SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY start_ts) AS turn FROM plan")
def gap_requests_round_robin(spark, sf):
    return X.round_robin(X.gap_plan(_expected(spark, sf), S.hourly_bars(spark, sf), 3600, 2), "instrument", "start_ts")


@query("observed_of_expected", f"WITH {BAR}, {_EXP} SELECT ex.* FROM ex SEMI JOIN bar USING (instrument, open_ts)")
def observed_of_expected(spark, sf):
    return _expected(spark, sf).join(S.hourly_bars(spark, sf).select("instrument", "open_ts"), ["instrument", "open_ts"], "left_semi")


@query("stream_gap_severity", f"WITH {_GAPS}, d AS (SELECT instrument, date_trunc('day', open_ts)::TIMESTAMP AS day, count(*) AS missing FROM ms GROUP BY ALL) SELECT *, CASE WHEN missing >= 5 THEN 'critical' WHEN missing >= 2 THEN 'degraded' ELSE 'warning' END AS severity FROM d")
def stream_gap_severity(spark, sf):
    ms = _expected(spark, sf).join(S.hourly_bars(spark, sf).select("instrument", "open_ts"), ["instrument", "open_ts"], "left_anti")
    n = F.col("missing")
    return ms.groupBy("instrument", F.date_trunc("day", "open_ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("missing")).withColumn("severity", F.when(n >= 5, "critical").when(n >= 2, "degraded").otherwise("warning"))


@query("retention_plan", f"WITH {TR}, f AS (SELECT instrument, date_trunc('day', ts)::TIMESTAMP AS path, max(ts) AS max_ts FROM tr GROUP BY ALL), c AS (SELECT instrument, max(ts) - INTERVAL 5 DAY AS cutoff FROM tr GROUP BY 1) SELECT *, max_ts < cutoff AS \"drop\" FROM f JOIN c USING (instrument)")
def retention_plan(spark, sf):
    t = S.trades(spark, sf)
    files = t.groupBy("instrument", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("path")).agg(F.max("ts").alias("max_ts"))
    return X.retention_plan(files, t.groupBy("instrument").agg((F.max("ts") - F.expr("INTERVAL 5 DAYS")).alias("cutoff")), "instrument")


@query("subscription_reconcile", """WITH d AS (SELECT c_custkey AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 3 <> 0), c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(d.k, c.k) AS k, CASE WHEN c.k IS NULL THEN 'start' WHEN d.k IS NULL THEN 'stop' WHEN d.v IS DISTINCT FROM c.v THEN 'change' ELSE 'keep' END AS action FROM d FULL JOIN c ON d.k = c.k""")
def subscription_reconcile(spark, sf):
    c = S.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"))
    return X.reconcile(c.where("k % 3 <> 0"), c.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 10 == 0, "OTHER").otherwise(F.col("v"))), "k", "v")


@query("identity_conflicts", "SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_partkey, l_quantity)) AS fingerprints, count(DISTINCT (l_partkey, l_quantity)) > 1 AS conflict FROM lineitem GROUP BY 1")
def identity_conflicts(spark, sf):
    return X.identity_conflicts(S.table(spark, sf, "lineitem"), "l_orderkey", ["l_partkey", "l_quantity"])


@query("idempotent_batch", "WITH s AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) SELECT * FROM s WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def idempotent_batch(spark, sf):
    batch = S.table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return X.new_only(batch, S.table(spark, sf, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "o_orderkey")


@query("monotonic_upsert", "WITH s AS (SELECT o_custkey, o_orderkey AS version, o_totalprice, 1 AS o FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_totalprice, 0 FROM orders WHERE o_orderkey % 2 = 1) SELECT o_custkey, max(version) AS version, arg_max(o_totalprice, version) AS o_totalprice FROM s GROUP BY 1")
def monotonic_upsert(spark, sf):
    o = S.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice")
    return X.monotonic_upsert(o.where("version % 2 = 0"), o.where("version % 2 = 1"), "o_custkey", "version")


_DEM = "d AS (SELECT o_custkey % 100 AS stream_key, o_orderpriority AS requirement, o_orderkey % 7 AS priority, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS expires, o_orderstatus AS consumer FROM orders)"


@query("demand_reconciliation", f"WITH {_DEM} SELECT stream_key, max(priority) AS priority, CASE WHEN count(expires) = count(*) THEN max(expires) END AS expires, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS consumers, count(DISTINCT requirement) > 1 AS disagree, min(requirement) AS requirement FROM d GROUP BY 1")
def demand_reconciliation(spark, sf):
    k = F.col("o_orderkey")
    return X.reconcile_demands(S.table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("stream_key"), F.col("o_orderpriority").alias("requirement"), (k % 7).alias("priority"), F.when(k % 50 != 0, F.col("o_orderdate")).alias("expires"), F.col("o_orderstatus").alias("consumer")))


@query("historical_dependencies", "WITH g AS (SELECT o_custkey % 50 AS request_key, max(o_orderkey % 9) AS priority, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS dependencies, max(o_orderkey % 1000) AS observations FROM orders GROUP BY 1) SELECT *, observations <= 990 AS within_request, sum(observations) OVER () <= 1000000 AS within_total FROM g")
def historical_dependencies(spark, sf):
    k = F.col("o_orderkey")
    return X.compile_dependencies(S.table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("request_key"), (k % 9).alias("priority"), F.col("o_orderpriority").alias("dependency"), (k % 1000).alias("observations")), 990, 1_000_000)


@query("priority_dispatch", "SELECT o_orderkey AS id, o_orderkey % 13 AS priority FROM orders WHERE o_orderstatus = 'P' ORDER BY priority DESC, id LIMIT 25")
def priority_dispatch(spark, sf):
    return X.dispatch(S.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 13).alias("priority")), 25)


@query("tick_gap_plan", f"""WITH {BAR}, g AS (SELECT instrument, lag(close_ts) OVER (PARTITION BY instrument ORDER BY open_ts) AS s, open_ts AS e FROM bar), h AS (SELECT date_trunc('day', max(ts)) - INTERVAL 20 DAY AS b, date_trunc('day', max(ts)) - INTERVAL 5 DAY AS j FROM events),
x AS (SELECT instrument, unnest([{{'a': s, 'z': least(e, b), 'w': 'unrecoverable'}}, {{'a': greatest(s, b), 'z': least(e, j), 'w': 'best_effort_backfill'}}, {{'a': greatest(s, j), 'z': e, 'w': 'replay_journal'}}]) AS p FROM g, h WHERE s < e)
SELECT instrument, p.a::TIMESTAMP AS from_ts, p.z::TIMESTAMP AS to_ts, p.w AS action FROM x WHERE p.a < p.z""")
def tick_gap_plan(spark, sf):
    from tidemark.functions.carry import with_halo, without_halo

    bars = S.hourly_bars(spark, sf).select("instrument", "open_ts", "close_ts")
    before = F.lag("close_ts").over(Window.partitionBy("instrument", "_b").orderBy("open_ts"))
    gaps = without_halo(with_halo(bars, ["instrument"], ["open_ts"], 1).withColumn("start_ts", before)).where("start_ts < open_ts")
    day = F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")
    ends = S.table(spark, sf, "events").agg((day - F.expr("INTERVAL 20 DAYS")).alias("b"), (day - F.expr("INTERVAL 5 DAYS")).alias("j"))  # one row
    return X.tick_gap_plan(gaps.withColumnRenamed("open_ts", "end_ts").crossJoin(F.broadcast(ends)), F.col("b"), F.col("j"))


@query("option_strike_window", "WITH k AS (SELECT p_brand, p_retailprice AS strike, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM part), s AS (SELECT p_brand, arg_min(i, (abs(strike - 1000), strike)) AS a, max(n) AS n FROM k GROUP BY 1), w AS (SELECT p_brand, greatest(1, least(a - 2, n - 4)) AS lo FROM s) SELECT p_brand, strike, i::BIGINT AS i FROM k JOIN w USING (p_brand) WHERE i BETWEEN lo AND lo + 4")
def option_strike_window(spark, sf):
    from tidemark.operators.options import strike_window

    return strike_window(S.table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("strike"), "p_partkey"), "p_brand", 1000.0, 2).select("p_brand", "strike", "i")


@query("option_chain_pick", "WITH c AS (SELECT p_type, p_brand, count(*) AS strikes FROM part GROUP BY ALL) SELECT p_type, arg_max(p_brand, (strikes, p_brand)) AS p_brand, max(strikes) AS strikes FROM c GROUP BY 1")
def option_chain_pick(spark, sf):
    c = S.table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("strikes"))
    return c.groupBy("p_type").agg(F.max_by("p_brand", F.struct("strikes", "p_brand")).alias("p_brand"), F.max("strikes").alias("strikes"))


@query("input_lineage", f"WITH {BAR} SELECT instrument, min(open_ts) AS first_open, max(open_ts) AS last_open, count(*) AS n, sha256(string_agg(strftime(open_ts, '%Y-%m-%d %H') || '=' || close::VARCHAR, ';' ORDER BY open_ts)) AS content_hash FROM bar GROUP BY 1")
def input_lineage(spark, sf):
    item = F.struct("open_ts", F.concat_ws("=", F.date_format("open_ts", "yyyy-MM-dd HH"), F.col("close").cast("string")).alias("t"))
    return S.hourly_bars(spark, sf).groupBy("instrument").agg(F.min("open_ts").alias("first_open"), F.max("open_ts").alias("last_open"), F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), ";"), 256).alias("content_hash"))
