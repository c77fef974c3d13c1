"""Signal lifecycle: location episodes, hash-chained transitions, arming, the runtime's order rules, interaction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import sorted_fold

#: Status -> statuses that may follow it.
ALLOWED = {"candidate": ("armed", "invalidated", "expired"), "armed": ("triggered", "invalidated", "expired"), "triggered": ("invalidated", "expired")}
FIDELITY = ("reported", "inferred", "partial", "unavailable")


#: (an episode is open, it is of this side and regime, the observation is qualified, it shares a zone) -> what happens.
MOVES = {
    (False, False, True, False): "entered", (False, False, False, False): "no_episode",
    (True, False, True, False): "replaced", (True, False, True, True): "replaced", (True, False, False, False): "exited", (True, False, False, True): "exited",
    (True, True, True, False): "replaced", (True, True, True, True): "engaged", (True, True, False, False): "apart", (True, True, False, True): "apart",
}


def episodes(observations: DataFrame, exit_bars: int, rejection_bars: int) -> DataFrame:
    """Location episodes of ``observations(instrument, ts, direction, regime, status, price, zones array<struct<zone_id, lower, upper,
    tolerance>>)``, one decision per observation: instrument, ts, event, episode_id, ended_episode_id, adverse, favourable, changed.

    Events: no_episode, evidence_gap, entered, active, departure_unresolved, favorable_departure, rejected, exit_pending, exited,
    replaced.  An observation that is repeated as it was gets the same decision; another one at the same time fails.

    Prices and edges are multiplied by the sign of the side, so that there is one case: price lies beyond the zones, inside, or
    against them.  ``exit_bars`` observations in a row against the zones end an episode, ``rejection_bars`` beyond them reject it.  What is
    remembered of an instrument is its episode's edges and zone names and the two counts."""
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    near = lambda z: F.when(sign > 0, z["lower"] - z["tolerance"]).otherwise(-z["upper"] - z["tolerance"])
    far = lambda z: F.when(sign > 0, z["upper"] + z["tolerance"]).otherwise(-z["lower"] + z["tolerance"])
    names = F.array_sort(F.transform("zones", lambda z: z["zone_id"]))
    start = F.concat_ws("|", "instrument", "direction", "regime", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    setting = F.concat_ws("|", "direction", "regime")
    rows = observations.select("instrument", "ts", F.struct(setting.alias("setting"), start.alias("name"), F.col("status"), (sign * F.col("price")).alias("price"), F.array_min(F.transform("zones", near)).alias("against"), F.array_max(F.transform("zones", far)).alias("along"), names.alias("zones")).alias("o"))
    once = rows.groupBy("instrument", "ts").agg(F.min("o").alias("o"), F.max("o").alias("_o"), F.count(F.lit(1)).alias("n"))
    stop = F.raise_error(F.concat_ws(" ", F.lit("conflicting observations of"), "instrument", F.lit("at"), F.col("ts").cast("string"))).cast("boolean")
    once = once.where(F.when(~F.col("o").eqNullSafe(F.col("_o")), stop).otherwise(F.lit(True))).select("instrument", "ts", "o.*", "n")

    def make():
        held, against, beyond, before = None, 0, 0, None  # held: (setting, name, zones, edge against, edge along)

        def step(r):
            nonlocal held, against, beyond, before
            same = held is not None and held[0] == r.setting
            shares = held is not None and not held[2].isdisjoint(r.zones)
            gap = r.status == "missing_evidence" and (same or held is None)
            event = "evidence_gap" if gap else MOVES[held is not None, same, r.status == "qualified", shares]
            ended, run = None, 0
            if event in ("engaged", "apart"):
                where = (r.price > held[4]) - (r.price < held[3])
                beyond = min(beyond + 1, rejection_bars) if where > 0 else 0
                against = against + 1 if where < 0 else 0
                run = against
                if where > 0:
                    event = "rejected" if beyond == rejection_bars else "favorable_departure"
                elif where < 0:
                    event = "exited" if against == exit_bars else "exit_pending"
                else:
                    event = "active" if event == "engaged" else "departure_unresolved"
            else:
                against = beyond = 0
            name = held and held[1]
            if event in ("exited", "replaced"):
                ended, against = name, 0
                held = None
            if event in ("entered", "replaced"):
                held = (r.setting, r.name, frozenset(r.zones), r.against, r.along)
                name = r.name
            changed, before = event != before, event
            return [(r.instrument, r.ts, event, name, ended, run, beyond, changed)] * r.n

        return step

    return sorted_fold(once, ["instrument"], ["ts"], "instrument string, ts timestamp_ntz, event string, episode_id string, ended_episode_id string, adverse int, favourable int, changed boolean", make)


def content(signal: str, status: str, at: str, reasons: str) -> Column:
    return F.sha2(F.concat_ws("|", F.col(signal).cast("string"), status, F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), reasons), 256)


def chained(transitions: DataFrame, signal: str, at: str) -> DataFrame:
    """``transitions(signal, seq, from_status, to_status, at, reasons)`` with the hash of the state each reaches and of the one it leaves,
    as a writer makes them."""
    w = Window.partitionBy(signal).orderBy("seq")
    rows = transitions.withColumn("content_hash", content(signal, "to_status", at, "reasons"))
    return rows.withColumn("previous_hash", F.lag("content_hash").over(w))


def chain_faults(chain: DataFrame, signal: str, at: str) -> DataFrame:
    """``chain(.., content_hash, previous_hash)`` with ``faults``: every rule that a transition breaks."""
    w = Window.partitionBy(signal).orderBy("seq")
    lag = lambda c: F.lag(c).over(w)
    legal = F.concat_ws("|", "from_status", "to_status").isin(*(f"{a}|{b}" for a, bs in ALLOWED.items() for b in bs))
    first = F.row_number().over(w) == 1
    return chain.withColumn("faults", F.array_join(F.array_compact(F.array(
        F.when(~legal, "move_not_allowed"),
        F.when(first & (F.col("from_status") != "candidate"), "does_not_start_as_candidate"),
        F.when(lag("to_status") != F.col("from_status"), "status_broken"),
        F.when(~first & ~lag("content_hash").eqNullSafe(F.col("previous_hash")), "hash_broken"),
        F.when(F.col(at) < lag(at), "time_backward"),
        F.when(F.col("reasons") == "", "reasons_missing"))), ","))


def location_evidence(matches: DataFrame) -> DataFrame:
    """``matches(episode_id, source_feature, source_fidelity, source_ts, evaluation_feature, fidelity, observed_ts, timeframe, zone_kind)`` ->
    one evidence row per (episode, feature): latest time, worst fidelity, sorted reasons."""
    label = lambda kind: F.concat_ws("_", "timeframe", "zone_kind", F.lit(kind))
    side = lambda f, q, t, kind: F.struct(F.col(f).alias("feature_id"), F.col(q).alias("fidelity"), F.col(t).alias("at"), label(kind).alias("reason"))
    both = matches.select("episode_id", F.explode(F.array(side("source_feature", "source_fidelity", "source_ts", "zone"), side("evaluation_feature", "fidelity", "observed_ts", "match"))).alias("e")).select("episode_id", "e.*")
    rank = F.coalesce(*(F.when(F.col("fidelity") == f, F.lit(i)) for i, f in enumerate(FIDELITY)))
    out = both.groupBy("episode_id", "feature_id").agg(F.max("at").alias("observed_ts"), F.max(rank).alias("_q"), F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    return out.select("episode_id", "feature_id", "observed_ts", F.element_at(F.array(*map(F.lit, FIDELITY)), F.col("_q") + 1).alias("fidelity"), "reasons")


def armed_signals(entered: DataFrame, directions: DataFrame, evidence: DataFrame, family: str, definition: str) -> DataFrame:
    """``entered(episode_id, instrument, direction, entry_ts)`` with ``directions(instrument, ts, direction, status)`` -> one armed signal per
    episode whose direction is qualified and agrees; candidate and armed states are chained by hash."""
    q = directions.where("status = 'qualified'").select("instrument", F.col("ts").alias("entry_ts"), "direction")
    agreed = entered.join(q, ["instrument", "entry_ts", "direction"])
    found = evidence.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    rows = agreed.join(found, "episode_id", "left").withColumn("n_evidence", F.coalesce("n_evidence", F.lit(0)))
    key = F.concat_ws("|", F.lit(family), F.lit(definition), "instrument", "direction", F.concat(F.lit("location_episode:"), "episode_id"))
    rows = rows.withColumns({"setup_key": key, "signal_id": F.sha2(F.concat_ws("|", key, F.date_format("entry_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), 256)})
    state = lambda status, reason: F.sha2(F.concat_ws("|", "signal_id", F.lit(status), F.date_format("entry_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(reason)), 256)
    return rows.withColumns({"candidate_hash": state("candidate", "location_episode_entered"), "armed_hash": state("armed", "location_episode_armed")})


def runtime(decisions: DataFrame, watermark: Column, ttl_seconds: int) -> DataFrame:
    """Live order rules over ``decisions(instrument, ts, event, episode_id, ended_episode_id)``: what happens to the signal of each.

    At or before the startup watermark a decision is stale.  An entered episode arms a signal, an ended one invalidates it; an
    armed signal expires after ``ttl_seconds`` and its episode is suppressed until it ends or is replaced; a replacement
    invalidates and arms again."""

    def make():
        signal, since, suppressed = None, None, None

        def step(r):
            nonlocal signal, since, suppressed
            out = []
            if r.stale:
                return [(r.instrument, r.ts, "stale", None)]
            if signal and (r.ts - since).total_seconds() > ttl_seconds:
                out.append((r.instrument, r.ts, "expired", signal))
                suppressed, signal = signal, None
            if r.ended_episode_id is not None:
                if signal == r.ended_episode_id:
                    out.append((r.instrument, r.ts, "invalidated", signal))
                    signal = None
                elif suppressed == r.ended_episode_id:
                    out.append((r.instrument, r.ts, "released", suppressed))
                    suppressed = None
            if r.event in ("entered", "replaced"):
                signal, since = r.episode_id, r.ts
                out.append((r.instrument, r.ts, "armed", signal))
            elif suppressed is not None and r.episode_id == suppressed:
                out.append((r.instrument, r.ts, "suppressed", suppressed))
            return out

        return step

    rows = decisions.select("instrument", "ts", "event", "episode_id", "ended_episode_id", (F.col("ts") <= watermark).alias("stale"))
    return sorted_fold(rows, ["instrument"], ["ts"], "instrument string, ts timestamp_ntz, action string, episode_id string", make)


def interactions(decisions: DataFrame, qualifications: DataFrame) -> DataFrame:
    """An audit row per decision about an episode: the episode, the counts and the clusters of the same direction; a selected cluster of
    another direction is dropped.  ``qualifications(instrument, ts, direction, selected, clusters array<struct<cluster_id, direction>>)``."""
    rows = decisions.where("episode_id IS NOT NULL").join(qualifications, ["instrument", "ts"])
    same = F.filter("clusters", lambda c: c["direction"] == F.col("direction"))
    ids = F.transform(same, lambda c: c["cluster_id"])
    reason = F.concat(F.lit("location_"), F.col("event"))
    return rows.withColumns({"cluster_ids": F.array_join(F.sort_array(ids), ","), "selected_cluster": F.when(F.array_contains(ids, F.col("selected")), F.col("selected")), "reason": reason}).drop("clusters", "selected")
