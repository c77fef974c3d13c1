"""Queries over signal lifecycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import lifecycle as L
from tidemark.operators import location
from tidemark.plans.catalog import query
from tidemark.plans.locations import _Q, POLICY, context
from tidemark.sources import adapters as S

#: Observations at hourly closes: the selected locations of one side, which is the parity of the day and the instrument; the regime is the day.
_OBS = _Q + """,
dr AS (SELECT bar.instrument, close_ts AS ts, CASE WHEN (day(close_ts) + length(bar.instrument)) % 3 = 0 THEN 'SHORT' ELSE 'LONG' END AS direction, strftime(close_ts, '%Y-%m-%d') AS regime, close::DOUBLE AS price, n_trades FROM bar),
zs AS (SELECT c.instrument, c.ts, c.direction, list(c.zone_id) AS zones, min(CASE c.direction WHEN 'LONG' THEN c.lower - coalesce(tol, 0) ELSE -c.upper - coalesce(tol, 0) END) AS lo, max(CASE c.direction WHEN 'LONG' THEN c.upper + coalesce(tol, 0) ELSE -c.lower + coalesce(tol, 0) END) AS hi, max(b.sources) AS sources
       FROM c JOIN b ON b.instrument = c.instrument AND b.ts = c.ts AND b.direction = c.direction AND b.c = c.c GROUP BY ALL),
ob AS MATERIALIZED (
  SELECT dr.instrument, ts, dr.direction, regime, concat_ws('|', dr.instrument, dr.direction, regime, strftime(ts, '%Y-%m-%d %H:%M:%S.%f')) AS name, dr.direction || '|' || regime AS setting,
    CASE WHEN n_trades % 11 = 0 THEN 'missing_evidence' WHEN sources >= 1 THEN 'qualified' ELSE 'not_at_location' END AS status, CASE dr.direction WHEN 'LONG' THEN price ELSE -price END AS price,
    coalesce(zones, []) AS zones, lo, hi, row_number() OVER (PARTITION BY dr.instrument ORDER BY ts) AS i FROM dr LEFT JOIN zs USING (instrument, ts, direction)),
ep AS (
  SELECT instrument, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, NULL::VARCHAR AS event, NULL::VARCHAR AS episode_id, NULL::VARCHAR AS ended, 0 AS run, 0 AS beyond, 0 AS against,
    NULL::VARCHAR AS held, NULL::VARCHAR AS held_setting, []::VARCHAR[] AS held_zones, NULL::DOUBLE AS held_lo, NULL::DOUBLE AS held_hi FROM ob GROUP BY 1
  UNION ALL
  SELECT instrument, i, ts, act, CASE WHEN act IN ('entered', 'replaced') THEN name WHEN act = 'no_episode' THEN NULL ELSE held END, CASE WHEN act IN ('replaced', 'exited') THEN held END,
    CASE WHEN NOT tracked THEN 0 WHEN act IN ('exit_pending', 'exited') THEN against + 1 ELSE 0 END, CASE WHEN act IN ('favorable_departure', 'rejected') THEN least(beyond + 1, 3) ELSE 0 END, CASE WHEN act = 'exit_pending' THEN against + 1 ELSE 0 END,
    CASE WHEN act IN ('entered', 'replaced') THEN name WHEN act <> 'exited' THEN held END, CASE WHEN act IN ('entered', 'replaced') THEN setting ELSE held_setting END, CASE WHEN act IN ('entered', 'replaced') THEN zones ELSE held_zones END,
    CASE WHEN act IN ('entered', 'replaced') THEN lo ELSE held_lo END, CASE WHEN act IN ('entered', 'replaced') THEN hi ELSE held_hi END
  FROM (SELECT *, CASE
      WHEN held IS NOT NULL AND held_setting <> setting THEN CASE WHEN status = 'qualified' THEN 'replaced' ELSE 'exited' END
      WHEN status = 'missing_evidence' THEN 'evidence_gap'
      WHEN held IS NULL THEN CASE WHEN status = 'qualified' THEN 'entered' ELSE 'no_episode' END
      WHEN NOT tracked THEN 'replaced'
      WHEN price > held_hi THEN CASE WHEN beyond + 1 >= 3 THEN 'rejected' ELSE 'favorable_departure' END
      WHEN price < held_lo THEN CASE WHEN against + 1 >= 2 THEN 'exited' ELSE 'exit_pending' END
      WHEN status = 'qualified' THEN 'active' ELSE 'departure_unresolved' END AS act
    FROM (SELECT ob.*, ep.run, ep.beyond, ep.against, ep.held, ep.held_setting, ep.held_zones, ep.held_lo, ep.held_hi,
            ep.held IS NOT NULL AND ep.held_setting = ob.setting AND ob.status <> 'missing_evidence' AND (ob.status <> 'qualified' OR list_has_any(ep.held_zones, ob.zones)) AS tracked
          FROM ep JOIN ob ON ob.instrument = ep.instrument AND ob.i = ep.i + 1))),
de AS (SELECT instrument, i, ts, event, episode_id, ended AS ended_episode_id, run AS adverse, beyond AS favourable, event IS DISTINCT FROM lag(event) OVER (PARTITION BY instrument ORDER BY i) AS changed FROM ep WHERE i > 0)"""


def observations(spark, sf):
    b = S.hourly_bars(spark, sf)
    price, ts = F.col("close").cast("double"), F.col("close_ts")
    direction = F.when((F.dayofmonth(ts) + F.length("instrument")) % 3 == 0, "SHORT").otherwise("LONG")
    rows = b.select("instrument", ts.alias("ts"), direction.alias("direction"), F.date_format(ts, "yyyy-MM-dd").alias("regime"), price.alias("price"), F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), "n_trades")
    found = location.qualify_locations(rows.select("instrument", "ts", "direction", "low", "high"), context(spark, sf), POLICY, 1)
    status = F.when(F.col("n_trades") % 11 == 0, "missing_evidence").otherwise(F.col("status"))
    return rows.drop("low", "high").join(found.select("instrument", "ts", "direction", "status", "zones"), ["instrument", "ts", "direction"]).withColumn("status", status).drop("n_trades")


@query("location_episode_machine", f"WITH RECURSIVE {_OBS} SELECT instrument, ts, event, episode_id, ended_episode_id, adverse, favourable, changed FROM de")
def location_episode_machine(spark, sf):
    return L.episodes(observations(spark, sf), 2, 3)


@query("signal_runtime_actions", f"""WITH RECURSIVE {_OBS}, mk AS (SELECT min(ts) + INTERVAL 2 DAY AS mark FROM ob), dm AS MATERIALIZED (SELECT de.*, ts <= mark AS stale FROM de, mk),
ru AS (
  SELECT instrument, 0::BIGINT AS i, NULL::TIMESTAMP AS ts, []::STRUCT(action VARCHAR, episode_id VARCHAR)[] AS made, NULL::VARCHAR AS signal, NULL::TIMESTAMP AS since, NULL::VARCHAR AS muted FROM dm GROUP BY 1
  UNION ALL
  SELECT instrument, i, ts, CASE WHEN stale THEN [{{'action': 'stale', 'episode_id': NULL::VARCHAR}}] ELSE list_filter([
      CASE WHEN late THEN {{'action': 'expired', 'episode_id': signal}} END, CASE WHEN ended_episode_id = s1 THEN {{'action': 'invalidated', 'episode_id': s1}} WHEN ended_episode_id = m1 THEN {{'action': 'released', 'episode_id': m1}} END,
      CASE WHEN event IN ('entered', 'replaced') THEN {{'action': 'armed', 'episode_id': episode_id}} WHEN m2 = episode_id THEN {{'action': 'suppressed', 'episode_id': m2}} END], lambda x: x IS NOT NULL) END,
    CASE WHEN stale THEN signal WHEN event IN ('entered', 'replaced') THEN episode_id WHEN ended_episode_id = s1 THEN NULL ELSE s1 END, CASE WHEN NOT stale AND event IN ('entered', 'replaced') THEN ts ELSE since END, CASE WHEN stale THEN muted ELSE m2 END
  FROM (SELECT *, CASE WHEN coalesce(ended_episode_id = s1, false) THEN m1 WHEN ended_episode_id = m1 THEN NULL ELSE m1 END AS m2
        FROM (SELECT *, CASE WHEN late THEN NULL ELSE signal END AS s1, CASE WHEN late THEN signal ELSE muted END AS m1
              FROM (SELECT dm.*, ru.signal, ru.since, ru.muted, coalesce(NOT stale AND ru.signal IS NOT NULL AND dm.ts - ru.since > INTERVAL 6 HOUR, false) AS late FROM ru JOIN dm ON dm.instrument = ru.instrument AND dm.i = ru.i + 1)))),
ua AS (SELECT instrument, ts, unnest(made) AS u FROM ru WHERE i > 0) SELECT instrument, ts, u.action AS action, u.episode_id AS episode_id FROM ua""")
def signal_runtime_actions(spark, sf):
    rows = observations(spark, sf)
    first = rows.agg((F.min("ts") + F.expr("INTERVAL 2 DAYS")).alias("mark"))  # one row
    decided = L.episodes(rows, 2, 3).crossJoin(F.broadcast(first))
    return L.runtime(decided, F.col("mark"), 6 * 3600)


@query("location_interactions", f"""WITH RECURSIVE {_OBS} SELECT de.instrument, de.ts, event, episode_id, ended_episode_id, adverse, favourable, changed, ob.direction, de.instrument || '|own' AS cluster_ids,
  CASE WHEN hour(de.ts) % 2 = 0 THEN de.instrument || '|own' END AS selected_cluster, 'location_' || event AS reason FROM de JOIN ob USING (instrument, ts) WHERE episode_id IS NOT NULL""")
def location_interactions(spark, sf):
    rows = observations(spark, sf)
    other = F.when(F.col("direction") == "LONG", "SHORT").otherwise("LONG")
    cluster = lambda name, d: F.struct(F.concat_ws("|", "instrument", F.lit(name)).alias("cluster_id"), d.alias("direction"))
    q = rows.select("instrument", "ts", "direction", F.concat_ws("|", "instrument", F.when(F.hour("ts") % 2 == 0, "own").otherwise("other")).alias("selected"), F.array(cluster("own", F.col("direction")), cluster("other", other)).alias("clusters"))
    return L.interactions(L.episodes(rows, 2, 3), q)


_STEPS = """s AS (SELECT user_id AS signal_id, event_id AS seq, ['candidate', 'armed', 'triggered'][event_id % 3 + 1] AS from_status, ['armed', 'triggered', 'invalidated', 'expired'][(event_id // 3) % 4 + 1] AS to_status, ts, CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS reasons FROM events),
h AS (SELECT *, sha256(concat_ws('|', signal_id::VARCHAR, to_status, strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), reasons)) AS content_hash FROM s),
c AS (SELECT *, lag(content_hash) OVER w AS true_previous, lag(to_status) OVER w AS pt, lag(ts) OVER w AS pts FROM h WINDOW w AS (PARTITION BY signal_id ORDER BY seq)),
d AS (SELECT *, CASE WHEN seq % 17 = 0 THEN 'broken' ELSE true_previous END AS previous_hash FROM c)"""


@query("signal_hash_chain", f"""WITH {_STEPS} SELECT signal_id, seq, content_hash, previous_hash, concat_ws(',', CASE WHEN NOT ((from_status = 'candidate' AND to_status IN ('armed', 'invalidated', 'expired')) OR (from_status = 'armed' AND to_status IN ('triggered', 'invalidated', 'expired')) OR (from_status = 'triggered' AND to_status IN ('invalidated', 'expired'))) THEN 'move_not_allowed' END,
 CASE WHEN pt IS NULL AND from_status <> 'candidate' THEN 'does_not_start_as_candidate' END, CASE WHEN pt <> from_status THEN 'status_broken' END, CASE WHEN pt IS NOT NULL AND true_previous IS DISTINCT FROM previous_hash THEN 'hash_broken' END, CASE WHEN ts < pts THEN 'time_backward' END, CASE WHEN reasons = '' THEN 'reasons_missing' END) AS faults FROM d""")
def signal_hash_chain(spark, sf):
    i = F.col("event_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    steps = S.table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), i.alias("seq"), pick(["candidate", "armed", "triggered"], i % 3).alias("from_status"), pick(["armed", "triggered", "invalidated", "expired"], F.floor(i / 3) % 4).alias("to_status"), "ts", F.when(i % 13 == 0, "").otherwise(F.col("event_type")).alias("reasons"))
    chain = L.chained(steps, "signal_id", "ts").withColumn("previous_hash", F.when(F.col("seq") % 17 == 0, "broken").otherwise(F.col("previous_hash")))
    return L.chain_faults(chain, "signal_id", "ts").select("signal_id", "seq", "content_hash", "previous_hash", "faults")


_MATCH = """m AS (SELECT o_custkey AS episode_id, 'f' || (o_orderkey % 5) AS source_feature, ['reported', 'inferred', 'partial', 'unavailable'][o_orderkey % 4 + 1] AS source_fidelity, o_orderdate AS source_ts, 'e' || (o_orderkey % 3) AS evaluation_feature, ['reported', 'inferred'][o_orderkey % 2 + 1] AS fidelity, o_orderdate + INTERVAL 1 HOUR AS observed_ts, ['5m', '1h'][o_orderkey % 2 + 1] AS timeframe, lower(o_orderstatus) AS zone_kind FROM orders),
ev AS (SELECT episode_id, source_feature AS feature_id, source_fidelity AS fidelity, source_ts AS seen, timeframe || '_' || zone_kind || '_zone' AS reason FROM m UNION ALL SELECT episode_id, evaluation_feature, fidelity, observed_ts, timeframe || '_' || zone_kind || '_match' FROM m),
le AS (SELECT episode_id, feature_id, max(seen)::TIMESTAMP AS observed_ts, ['reported', 'inferred', 'partial', 'unavailable'][max(CASE fidelity WHEN 'reported' THEN 1 WHEN 'inferred' THEN 2 WHEN 'partial' THEN 3 ELSE 4 END)] AS fidelity, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM ev GROUP BY 1, 2)"""


def _evidence(spark, sf):
    k = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    at = F.col("o_orderdate").cast("timestamp_ntz")
    m = S.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("episode_id"), F.concat(F.lit("f"), (k % 5).cast("string")).alias("source_feature"), pick(["reported", "inferred", "partial", "unavailable"]).alias("source_fidelity"), at.alias("source_ts"),
        F.concat(F.lit("e"), (k % 3).cast("string")).alias("evaluation_feature"), pick(["reported", "inferred"]).alias("fidelity"), T.from_micros(T.micros(at) + 3_600_000_000).alias("observed_ts"), pick(["5m", "1h"]).alias("timeframe"), F.lower("o_orderstatus").alias("zone_kind"))
    return L.location_evidence(m)


@query("location_evidence", f"WITH {_MATCH} SELECT * FROM le")
def location_evidence(spark, sf):
    return _evidence(spark, sf)


@query("armed_location_signals", f"""WITH {_MATCH}, en AS (SELECT c_custkey AS episode_id, 'I' || (c_custkey % 7) AS instrument, CASE WHEN c_acctbal > 3000 THEN 'LONG' ELSE 'SHORT' END AS direction, TIMESTAMP '2024-01-01' + c_custkey * INTERVAL 1 MINUTE AS entry_ts FROM customer),
di AS (SELECT instrument, entry_ts, CASE WHEN episode_id % 4 = 0 THEN 'SHORT' ELSE 'LONG' END AS direction FROM en WHERE episode_id % 5 <> 0), n AS (SELECT episode_id, count(*) AS n_evidence FROM le GROUP BY 1),
k AS (SELECT en.*, coalesce(n_evidence, 0) AS n_evidence, concat_ws('|', 'location', 'd1', instrument, direction, 'location_episode:' || episode_id) AS setup_key FROM en JOIN di USING (instrument, entry_ts, direction) LEFT JOIN n USING (episode_id)),
i AS (SELECT *, sha256(setup_key || '|' || strftime(entry_ts, '%Y-%m-%d %H:%M:%S.%f')) AS signal_id FROM k)
SELECT episode_id, n_evidence, setup_key, signal_id, sha256(concat_ws('|', signal_id, 'armed', strftime(entry_ts, '%Y-%m-%d %H:%M:%S.%f'), 'location_episode_armed')) AS armed_hash FROM i""")
def armed_location_signals(spark, sf):
    c = F.col("c_custkey")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    en = S.table(spark, sf, "customer").select(c.alias("episode_id"), F.concat(F.lit("I"), (c % 7).cast("string")).alias("instrument"), F.when(F.col("c_acctbal") > 3000, "LONG").otherwise("SHORT").alias("direction"), T.from_micros(T.micros(start) + c * 60_000_000).alias("entry_ts"))
    e = F.col("episode_id")
    di = en.select("instrument", F.col("entry_ts").alias("ts"), F.when(e % 4 == 0, "SHORT").otherwise("LONG").alias("direction"), F.when(e % 5 != 0, "qualified").otherwise("neutral").alias("status"))
    return L.armed_signals(en, di, _evidence(spark, sf), "location", "d1").select("episode_id", "n_evidence", "setup_key", "signal_id", "armed_hash")
