"""Queries over research joins and the execution of history requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.functions.carry import running
from tidemark.operators import acquisition as Q
from tidemark.operators import direction as D
from tidemark.operators import joins as J
from tidemark.operators import research as R
from tidemark.plans.catalog import BAR, FT, query
from tidemark.sources import adapters as S

_WINDOW, _MOST = 6 * 3600, 8


@query("aggression_outcomes", f"""WITH RECURSIVE {FT},
t AS (SELECT *, sum(CASE WHEN seq % 2 = 0 THEN size ELSE -size END) OVER (PARTITION BY instrument ORDER BY ts, seq)::DOUBLE AS cvd FROM ft),
e AS (SELECT seq AS id, instrument, ts, seq, price, cvd AS base, CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS side FROM t WHERE size >= 60),
f AS (SELECT instrument, ts, min(seq) AS seq, arg_min(price, seq) AS price, arg_min(cvd, seq) AS cvd FROM t GROUP BY ALL),
j AS (SELECT e.id, f.ts, f.seq, (side * (f.price - e.price))::DOUBLE AS move, side * (f.cvd - base) AS flow FROM e JOIN f ON f.instrument = e.instrument AND f.ts > e.ts AND f.ts <= e.ts + INTERVAL 6 HOUR),
d AS (SELECT id, min(ts) AS ts FROM j WHERE (move >= 20 AND flow > 0) OR (move <= -20 AND flow < 0) GROUP BY 1),
x AS (SELECT j.id, greatest(max(move), 0) AS favourable, greatest(max(-move), 0) AS adverse, count(*) AS n_trades, max(CASE WHEN j.ts = d.ts THEN CASE WHEN move > 0 THEN 'with_flow' ELSE 'trapped' END END) AS terminal, max(d.ts) AS ended, max(CASE WHEN j.ts = d.ts THEN seq END) AS ended_seq
      FROM j LEFT JOIN d USING (id) WHERE d.ts IS NULL OR j.ts <= d.ts GROUP BY j.id),
n AS (SELECT instrument, max(ts) AS newest FROM ft GROUP BY 1),
o AS (SELECT e.id, e.instrument, e.ts, e.seq, coalesce(terminal, CASE WHEN newest < e.ts + INTERVAL 6 HOUR THEN 'pending' WHEN coalesce(favourable, 0) <= 10 AND coalesce(adverse, 0) <= 10 THEN 'absorbed' ELSE 'unresolved' END) AS natural_end,
        coalesce(ended, e.ts + INTERVAL 6 HOUR) AS end_ts, coalesce(ended_seq, -1) AS end_seq, coalesce(favourable, 0) AS favourable, coalesce(adverse, 0) AS adverse, coalesce(n_trades, 0) AS n_trades,
        row_number() OVER (PARTITION BY e.instrument ORDER BY e.ts, e.seq) AS i FROM e JOIN n USING (instrument) LEFT JOIN x USING (id)),
q AS (SELECT instrument, 0::BIGINT AS i, NULL::TIMESTAMP AS gone_at, []::STRUCT(id BIGINT, t TIMESTAMP, s BIGINT)[] AS held, []::BIGINT[] AS gone FROM o GROUP BY 1
      UNION ALL SELECT instrument, i, ts, list_append(live[greatest(len(live) - 6, 1):], {{'id': id, 't': end_ts, 's': end_seq}}), list_transform(live[1:greatest(len(live) - 7, 0)], lambda x: x.id)
      FROM (SELECT o.*, list_filter(q.held, lambda x: x.t > o.ts OR (x.t = o.ts AND x.s > o.seq)) AS live FROM q JOIN o ON o.instrument = q.instrument AND o.i = q.i + 1)),
v AS (SELECT gone_at, unnest(gone) AS id FROM q)
SELECT o.id, o.instrument, CASE WHEN gone_at IS NOT NULL THEN 'evicted' ELSE natural_end END AS outcome, CASE WHEN gone_at IS NOT NULL THEN gone_at WHEN natural_end <> 'pending' THEN end_ts END AS ended_ts,
  CASE WHEN gone_at IS NULL THEN round(favourable, 6) END AS favourable, CASE WHEN gone_at IS NULL THEN round(adverse, 6) END AS adverse, CASE WHEN gone_at IS NULL THEN n_trades END AS n_trades FROM o LEFT JOIN v USING (id)""")
def aggression_outcomes(spark, sf):
    """Trades of 60 and more open episodes of six hours; follow-through and reversal are 20 points, absorption 10, eight are open at most."""
    side = F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)
    t = running(S.flow_trades(spark, sf), ["instrument"], ["ts", "seq"], {"cvd": F.col("size") * side})
    opened = t.where("size >= 60").select(F.col("seq").alias("id"), "instrument", "ts", "seq", "price", side.alias("side"))
    return R.aggression_outcomes(opened, t.select("instrument", "ts", "seq", "price", "cvd"), _WINDOW, 20.0, 20.0, 10.0, _MOST)


@query("reference_renames", """WITH p AS (SELECT p_partkey AS k, 'shot/' || p_partkey AS path, md5(p_name || CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_partkey::VARCHAR END) AS sha, p_brand AS note FROM part),
r AS (SELECT path, CASE WHEN k % 13 = 0 THEN '' ELSE sha END AS sha, note FROM p WHERE k % 4 <> 0 UNION ALL SELECT path, sha, note FROM p WHERE k % 29 = 0),
f AS (SELECT CASE WHEN k % 5 = 0 THEN 'moved/' || k ELSE path END AS path, CASE WHEN k % 17 = 0 THEN md5(k::VARCHAR) ELSE sha END AS sha FROM p WHERE k % 9 <> 0),
rp AS (SELECT path, count(*) AS n, min((path, sha, note)) AS own FROM r GROUP BY 1), rh AS (SELECT sha, count(*) AS m, min((path, sha, note)) AS same FROM r WHERE sha <> '' GROUP BY 1),
b AS (SELECT f.path, f.sha, n, own, m, same, CASE WHEN n > 1 THEN 'duplicate' WHEN n = 1 THEN CASE WHEN own[2] IN ('', f.sha) THEN 'kept' ELSE 'changed' END WHEN m > 1 THEN 'ambiguous' WHEN m = 1 THEN 'renamed' ELSE 'new' END AS status FROM f LEFT JOIN rp USING (path) LEFT JOIN rh ON rh.sha = f.sha),
o AS (SELECT path, status, CASE WHEN status = 'renamed' THEN same[1] END AS previous_path, CASE status WHEN 'kept' THEN own[3] WHEN 'renamed' THEN same[3] END AS note FROM b)
SELECT * FROM o UNION ALL SELECT path, CASE WHEN n > 1 THEN 'duplicate' ELSE 'missing' END, NULL, own[3] FROM rp WHERE path NOT IN (SELECT path FROM f) AND path NOT IN (SELECT previous_path FROM o WHERE previous_path IS NOT NULL)""")
def reference_renames(spark, sf):
    """Parts as reference files of which some moved, changed, are new or gone; some share their content and some have two records."""
    k = F.col("p_partkey")
    p = S.table(spark, sf, "part").select(k, F.concat(F.lit("shot/"), k.cast("string")).alias("path"), F.md5(F.concat("p_name", F.when(k % 11 == 0, "").otherwise(k.cast("string")))).alias("sha"), F.col("p_brand").alias("note"))
    records = p.where(k % 4 != 0).select("path", F.when(k % 13 == 0, "").otherwise(F.col("sha")).alias("sha"), "note").unionByName(p.where(k % 29 == 0).select("path", "sha", "note"))
    files = p.where(k % 9 != 0).select(F.when(k % 5 == 0, F.concat(F.lit("moved/"), k.cast("string"))).otherwise(F.col("path")).alias("path"), F.when(k % 17 == 0, F.md5(k.cast("string"))).otherwise(F.col("sha")).alias("sha"))
    return R.synced_references(records, files, ["note"])


_KINDS = "['click', 'view', 'purchase', 'signup', 'error']"


@query("annotation_enrichment", f"""WITH {BAR}, a AS (SELECT c_custkey AS annotation_id, {_KINDS}[c_custkey % 5 + 1] AS instrument, CASE WHEN c_custkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
  TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 17 MINUTE AS ts, CASE WHEN c_custkey % 4 > 0 THEN 100.0 + c_custkey % 400 END::DOUBLE AS lo, [NULL, 'ignore', 'warn', 'candidate', 'armed', 'triggered'][c_custkey % 6 + 1] AS expected, CASE WHEN c_custkey % 3 = 0 THEN 'setup_missing' END AS missing FROM customer),
b4 AS (SELECT instrument, time_bucket(INTERVAL 4 HOUR, open_ts) + INTERVAL 4 HOUR AS as_of, count(*) AS n FROM bar GROUP BY ALL),
f AS (SELECT '1h' AS tf, instrument, close_ts AS as_of, CASE WHEN n_trades % 3 = 0 THEN 2 ELSE 1 END AS n FROM bar UNION ALL SELECT '4h', instrument, as_of, CASE WHEN n = 4 THEN 1 ELSE 2 END FROM b4),
s AS (SELECT a.annotation_id, v.tf, f.as_of, f.n, CASE WHEN f.n IS NULL THEN 'unavailable' WHEN f.n > 1 THEN 'ambiguous' WHEN a.ts - f.as_of > CASE v.tf WHEN '1h' THEN INTERVAL 2 HOUR ELSE INTERVAL 8 HOUR END THEN 'stale' ELSE 'matched' END AS status
      FROM (SELECT a.*, unnest(['1h', '4h']) AS tf FROM a) v JOIN a USING (annotation_id) ASOF LEFT JOIN f ON f.tf = v.tf AND f.instrument = v.instrument AND v.ts >= f.as_of),
c AS (SELECT annotation_id, string_agg(tf || ':' || status, ',' ORDER BY tf) AS context, string_agg('context_' || tf || '_' || status, ',' ORDER BY tf) FILTER (status <> 'matched') AS off FROM s GROUP BY 1),
m AS (SELECT user_id AS signal_id, event_type AS instrument, CASE WHEN user_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction, ts, ['candidate', 'armed', 'triggered', 'invalidated'][event_id % 4 + 1] AS to_status, 90 + value AS zl, 110 + value AS zu FROM events),
g AS (SELECT a.annotation_id, m.signal_id, bool_or(lo IS NULL OR (zl <= lo + 30 AND lo <= zu)) AS touch, max(CASE to_status WHEN 'triggered' THEN 4 WHEN 'armed' THEN 3 END) AS reached
      FROM a JOIN m ON m.instrument = a.instrument AND m.direction = a.direction AND m.ts BETWEEN a.ts - INTERVAL 15 MINUTE AND a.ts + INTERVAL 45 MINUTE GROUP BY ALL HAVING touch),
h AS (SELECT annotation_id, count(*) AS n, max(reached) AS reached FROM g GROUP BY 1),
r AS (SELECT a.*, context, off, coalesce(n, 0) AS n_candidates, reached, list_position(['ignore', 'warn', 'candidate', 'armed', 'triggered'], expected) - 1 AS want,
        CASE WHEN n IS NULL THEN 'unmatched' WHEN lo IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS signal_status FROM a JOIN c USING (annotation_id) LEFT JOIN h USING (annotation_id))
SELECT annotation_id, context, signal_status, n_candidates,
  CASE WHEN expected IS NULL THEN 'human_expected_lifecycle_pending' WHEN signal_status = 'unmatched' THEN 'not_observed_before_durable_lifecycle' WHEN signal_status <> 'matched' THEN 'signal_candidate_join_' || signal_status WHEN reached IS NULL THEN 'not_observed_before_durable_lifecycle'
    WHEN reached < want THEN 'system_stopped_at_' || CASE reached WHEN 4 THEN 'triggered' ELSE 'armed' END WHEN reached > want THEN 'system_advanced_to_' || CASE reached WHEN 4 THEN 'triggered' ELSE 'armed' END ELSE 'human_and_system_lifecycle_match' END AS first_divergence,
  coalesce(nullif(concat_ws(',', missing, off, CASE WHEN signal_status = 'unmatched' THEN 'no_durable_signal_transition_near_annotation' WHEN signal_status <> 'matched' THEN 'signal_candidate_join_' || signal_status END), ''), 'fully_enriched') AS reasons FROM r""")
def annotation_enrichment(spark, sf):
    """Customers as annotations, events as transitions of signals, bars as features, of which some exist in two variants."""
    k = F.col("c_custkey")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    low = F.when(k % 4 > 0, (100 + k % 400).cast("double"))
    a = S.table(spark, sf, "customer").select(
        k.alias("annotation_id"), pick(["click", "view", "purchase", "signup", "error"], k % 5).alias("instrument"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), T.from_micros(T.micros(start) + k * 17 * 60_000_000).alias("ts"),
        low.alias("zone_lower"), (low + 30).alias("zone_upper"), pick([None, "ignore", "warn", "candidate", "armed", "triggered"], k % 6).alias("expected"), F.when(k % 3 == 0, "setup_missing").alias("missing"))
    bars = S.hourly_bars(spark, sf)
    variants = lambda n: F.explode(F.sequence(F.lit(1), n)).alias("id")
    one = bars.select("instrument", F.col("close_ts").alias("as_of"), variants(F.when(F.col("n_trades") % 3 == 0, 2).otherwise(1)))
    four = bars.groupBy("instrument", T.from_micros(T.micros(T.anchored_floor(F.col("open_ts"), 14_400)) + 14_400_000_000).alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    four = four.select("instrument", "as_of", variants(F.when(F.col("n") == 4, 1).otherwise(2)))
    price = F.col("value")
    moves = S.table(spark, sf, "events").select(
        F.col("user_id").alias("signal_id"), F.col("event_id").alias("transition_id"), F.col("event_type").alias("instrument"), F.when(F.col("user_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), "ts",
        pick(["candidate", "armed", "triggered", "invalidated"], F.col("event_id") % 4).alias("to_status"), F.array(F.struct((90 + price).alias("lower"), (110 + price).alias("upper"))).alias("zones"))
    return R.enriched_annotations(a, {"1h": (one, 7200), "4h": (four, 28_800)}, moves, 15 * 60, 45 * 60)


@query("timed_historical_execution")
def timed_historical_execution(spark, sf):
    """Events as commands of 50 lanes, in seconds: requests, completions, failures, cancellations and the clock."""
    i, user = F.col("event_id"), F.col("user_id")
    command = F.when(F.col("event_type") == "view", "enqueue").when(F.col("event_type") == "click", "complete").when(F.col("event_type") == "purchase", "fail").when(F.col("event_type") == "signup", "cancel").otherwise("advance")
    rows = S.table(spark, sf, "events").select(
        F.concat(F.lit("lane"), (user % 50).cast("string")).alias("lane"), F.floor(T.micros(F.col("ts")) / 1_000_000).alias("at"), i.alias("seq"), command.alias("command"), F.concat_ws(":", user.cast("string"), (i % 3).cast("string")).alias("request_id"),
        (i % 100).cast("int").alias("priority"), F.concat(F.lit("metric:"), (i % 4).cast("string")).alias("consumer"), (i % 5).alias("minimum"), F.when(i % 7 == 0, 1).otherwise(0).alias("refused"), (i % 6).alias("observed"), (i % 2 == 0).alias("retry"), F.lit(True).alias("last"))
    return Q.execute_requests(rows, Q.Policy(capacity=32, in_flight=2, attempts=3, timeout=4 * 3600, backoff=1800))


#: definition, minimum score, minimum confirmations, what an opposing context does; and the roles of the timeframes.
_DEFINITIONS = [("trend", 1, 1, "degrade"), ("strict", 2, 0, "veto"), ("loose", 1, 0, "ignore")]
_ROLES = [("trend", "1h", "evaluation"), ("trend", "4h", "primary"), ("trend", "1h", "confirmation"), ("trend", "1d", "context"), ("strict", "1h", "evaluation"), ("strict", "1h", "primary"), ("strict", "4h", "primary"),
          ("strict", "1d", "context"), ("loose", "1h", "evaluation"), ("loose", "1d", "primary"), ("loose", "4h", "context"), ("loose", "1h", "context")]


@query("policy_directions", f"""WITH {BAR}, sc AS (SELECT '1h' AS tf, instrument, close_ts AS as_of, (sign(close - open) * (n_trades % 3))::INT AS score FROM bar
  UNION ALL SELECT '4h', instrument, time_bucket(INTERVAL 4 HOUR, open_ts) + INTERVAL 4 HOUR, (2 * sign(arg_max(close, open_ts) - arg_min(open, open_ts)))::INT FROM bar GROUP BY instrument, time_bucket(INTERVAL 4 HOUR, open_ts)
  UNION ALL SELECT '1d', instrument, date_trunc('day', open_ts) + INTERVAL 1 DAY, (2 * sign(arg_max(close, open_ts) - arg_min(open, open_ts)))::INT FROM bar GROUP BY instrument, date_trunc('day', open_ts)),
ev AS (SELECT instrument, close_ts AS ts, unnest(['1h', '4h', '1d']) AS tf FROM bar),
en AS (SELECT ev.instrument, ev.ts, ev.tf, sc.score FROM ev ASOF JOIN sc ON sc.tf = ev.tf AND sc.instrument = ev.instrument AND ev.ts >= sc.as_of),
df(definition, least_score, least_confirmed, opposing) AS (VALUES {', '.join(map(str, _DEFINITIONS))}), ro(definition, tf, role) AS (VALUES {', '.join(map(str, _ROLES))}),
g AS (SELECT bar.instrument, close_ts AS ts, df.*, ro.role, ro.tf, score, CASE WHEN abs(score) >= least_score THEN sign(score) WHEN score IS NOT NULL THEN 0 END AS side FROM bar, df JOIN ro USING (definition) LEFT JOIN en ON en.instrument = bar.instrument AND en.ts = bar.close_ts AND en.tf = ro.tf),
h AS (SELECT instrument, ts, definition, least_confirmed, opposing, bool_or(role = 'primary' AND side IS NULL) AS lost, bool_or(role = 'primary' AND side = 0) AS flat, max(side) FILTER (role = 'primary') AS d, min(side) FILTER (role = 'primary') AS e,
        list(side) FILTER (role = 'confirmation') AS cs, list(coalesce(side, 9)) FILTER (role = 'context') AS xs FROM g GROUP BY ALL),
s AS (SELECT *, CASE WHEN lost THEN 'missing_evidence' WHEN flat THEN 'neutral' WHEN d <> e THEN 'conflicted'
    WHEN coalesce(len(list_filter(cs, lambda c: c = d)), 0) < least_confirmed THEN CASE WHEN list_contains(cs, -d) THEN 'conflicted' WHEN list_contains(cs, 0) THEN 'neutral' ELSE 'missing_evidence' END
    WHEN opposing = 'veto' AND list_contains(xs, -d) THEN 'vetoed' ELSE 'qualified' END AS status FROM h)
SELECT instrument, ts, definition, status, CASE WHEN status = 'qualified' THEN CASE WHEN d > 0 THEN 'LONG' ELSE 'SHORT' END END AS direction,
  status = 'qualified' AND (coalesce(list_contains(xs, 9), false) OR (opposing = 'degrade' AND coalesce(list_contains(xs, -d), false))) AS is_degraded FROM s""")
def policy_directions(spark, sf):
    """Three definitions judge the same evidence at every hourly close."""
    bars = S.hourly_bars(spark, sf)
    sign = lambda c: F.signum(c.cast("double"))

    def longer(start, seconds):
        g = bars.groupBy("instrument", start.alias("o")).agg((2 * sign(F.max_by("close", "open_ts") - F.min_by("open", "open_ts"))).cast("int").alias("value"))
        return g.select("instrument", T.from_micros(T.micros(F.col("o")) + seconds * 1_000_000).alias("ts"), F.lit(0).cast("long").alias("seq"), "value")

    at = bars.select("instrument", F.col("close_ts").alias("ts"), F.lit(0).cast("long").alias("seq"))
    one = bars.select("instrument", F.col("close_ts").alias("ts"), F.lit(0).cast("long").alias("seq"), (sign(F.col("close") - F.col("open")) * (F.col("n_trades") % 3)).cast("int").alias("value"))
    known = J.point_in_time(at, {"1h": one, "4h": longer(T.anchored_floor(F.col("open_ts"), 14_400), 14_400), "1d": longer(T.anchored_floor(F.col("open_ts"), 86_400), 86_400)})
    item = F.explode(F.array(*(F.struct(F.lit(tf).alias("timeframe"), F.col(f"{tf}_value").alias("score")) for tf in ("1h", "4h", "1d"))))
    evidence = known.select("instrument", "ts", item.alias("e")).select("instrument", "ts", "e.*")
    definitions = spark.createDataFrame(_DEFINITIONS, "definition string, minimum_score int, minimum_confirmations int, opposing string")
    return D.qualify_by_policy(evidence, definitions, spark.createDataFrame(_ROLES, "definition string, timeframe string, role string"))


@query("coherent_chart_snapshot", f"""WITH {BAR}, f AS (
  SELECT instrument, '1h' AS timeframe, close_ts AS as_of, CASE WHEN n_trades % 2 = 0 THEN 'v2' ELSE 'v1' END AS version, CASE WHEN n_trades % 3 = 0 THEN 'live' ELSE 'history' END AS source FROM bar
  UNION ALL SELECT instrument, '4h', o + INTERVAL 4 HOUR, CASE WHEN hour(o) % 8 = 0 THEN 'v2' ELSE 'v1' END, 'history' FROM (SELECT DISTINCT instrument, time_bucket(INTERVAL 4 HOUR, open_ts) AS o FROM bar)),
i AS (SELECT *, concat_ws('|', instrument, timeframe, strftime(as_of, '%Y-%m-%d %H:%M:%S'), version) AS feature_id FROM f),
a AS (SELECT * FROM i WHERE timeframe = '1h' QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY as_of DESC, feature_id DESC) = 1),
s AS (SELECT i.*, a.as_of AS anchor_ts FROM i JOIN a ON a.instrument = i.instrument AND a.version = i.version AND i.as_of <= a.as_of),
l AS (SELECT instrument, timeframe, max(as_of) AS as_of, arg_max(feature_id, (as_of, feature_id)) AS feature_id, max(anchor_ts) AS anchor_ts, max(version) AS version FROM s GROUP BY 1, 2),
h AS (SELECT instrument, least(count(*), 60) AS n_history FROM s WHERE timeframe = '1h' AND as_of > anchor_ts - INTERVAL 120 HOUR GROUP BY 1),
b AS (SELECT bar.instrument, CASE WHEN n_trades % 3 = 0 THEN 'live' ELSE 'history' END AS bar_source, count(*) AS n, max(a.source) AS own FROM bar JOIN a ON a.instrument = bar.instrument AND bar.close_ts > a.as_of - INTERVAL 120 HOUR AND bar.close_ts <= a.as_of GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY bar.instrument ORDER BY count(*) DESC, (bar_source = max(a.source)) DESC, bar_source DESC) = 1)
SELECT l.*, bar_source, least(n, 60) AS n_bars, n_history FROM l JOIN h USING (instrument) JOIN b USING (instrument)""")
def coherent_chart_snapshot(spark, sf):
    """Features in two versions, so the newest of the longer timeframe is not always the one that fits the anchor."""
    bars = S.hourly_bars(spark, sf).withColumn("source", F.when(F.col("n_trades") % 3 == 0, "live").otherwise("history"))
    one = bars.select("instrument", F.lit("1h").alias("timeframe"), F.col("close_ts").alias("as_of"), F.when(F.col("n_trades") % 2 == 0, "v2").otherwise("v1").alias("version"), "source")
    start = T.anchored_floor(F.col("open_ts"), 14_400)
    four = bars.select("instrument", start.alias("o")).distinct().select("instrument", F.lit("4h").alias("timeframe"), T.from_micros(T.micros(F.col("o")) + 14_400_000_000).alias("as_of"), F.when(F.hour("o") % 8 == 0, "v2").otherwise("v1").alias("version"), F.lit("history").alias("source"))
    f = one.unionByName(four).withColumns({"configuration": F.lit("c"), "feature_id": F.concat_ws("|", "instrument", "timeframe", F.date_format("as_of", "yyyy-MM-dd HH:mm:ss"), "version")})
    return D.coherent_snapshot(f, bars.select("instrument", "source", "close_ts"), "1h", 120 * 3600, 60)
