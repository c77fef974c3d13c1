"""Control tables: demand, recovery, execution, delivery, publication and health as relational rules over event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import running, sorted_fold, with_halo, without_halo
from tidemark.functions.timeops import from_micros, last_before, micros
from tidemark.operators.machines import table_machine


def lookback_days(sessions: Column) -> Column:
    """Calendar days that surely hold so many sessions."""
    return F.greatest(2 * sessions, sessions + 4)


def uncovered(requests: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """Requested bar types without a single row; warmup is covered when there is none."""
    return requests.select(*keys).distinct().join(received.select(*keys).distinct(), keys, "left_anti")


def require_none(missing: DataFrame, message: str) -> DataFrame:
    """Fails when ``missing`` has a row; else an empty table of its columns.

    The condition is made indeterminate so that the optimizer does not move it below the join that found the rows."""
    stop = F.raise_error(F.concat(F.lit(message), F.to_json(F.struct(*missing.columns)))).cast("boolean")
    return missing.where(F.when(F.monotonically_increasing_id() >= 0, stop).otherwise(F.lit(False)))


def control_state(parts: DataFrame) -> DataFrame:
    """``parts(system, persistence_ready, available, failed)``, one row per instrument -> state and its reasons per system."""
    ready, all_there, failed = F.bool_and("persistence_ready"), F.bool_and("available"), F.bool_or("failed")
    reasons = F.array_compact(F.array(F.when(~ready, "persistence_not_ready"), F.when(~all_there, "instruments_missing"), F.when(failed, "unresolved_failure")))
    out = parts.groupBy("system").agg(reasons.alias("_r"), F.count(F.lit(1)).alias("instruments"))
    return out.select("system", "instruments", F.when(F.size("_r") == 0, "READY").otherwise("NOT_READY").alias("state"), F.array_join("_r", ",").alias("reasons"))


def lower_plan(plan: DataFrame) -> DataFrame:
    """``plan(instrument, role, timeframe, owner)`` -> one action per (instrument, kind, bar type) in three steps: roles become
    intents, intents become actions, and an action with two owners is rejected."""
    tick = F.col("timeframe") == "tick"
    kinds = F.when(F.col("role") == "warmup", F.array(F.lit("request_bars"))).when(tick, F.array(F.lit("subscribe_trades"), F.lit("subscribe_quotes"))).otherwise(F.array(F.lit("subscribe_bars")))
    intents = plan.where(~((F.col("role") == "warmup") & tick)).select("instrument", "owner", F.explode(kinds).alias("kind"), F.when(~tick, F.concat_ws("-", "instrument", "timeframe")).alias("bar_type"))
    order = {"request_bars": 1, "subscribe_bars": 2, "subscribe_quotes": 3, "subscribe_trades": 4}
    step = F.coalesce(*(F.when(F.col("kind") == k, F.lit(n)) for k, n in order.items()))
    actions = intents.groupBy("instrument", "kind", "bar_type").agg(F.count_distinct("owner").alias("owners"), F.min("owner").alias("owner"))
    return actions.withColumns({"step": step, "accepted": F.col("owners") == 1})


def deferred_demands(events: DataFrame, now: Column) -> DataFrame:
    """``events(demand_id, seq, action, retry_at)`` (retain or discard) -> what the book holds, whether it is due, and the next retry."""
    last = events.groupBy("demand_id").agg(F.max_by(F.struct("action", "retry_at"), "seq").alias("e")).where("e.action = 'retain'")
    held = last.select("demand_id", "e.retry_at").withColumn("due", F.col("retry_at") <= now)
    return held.crossJoin(F.broadcast(held.agg(F.min("retry_at").alias("next_retry"))))  # one row


RECOVERY = {("pending", "start"): "recovering", ("recovering", "filled"): "complete", ("recovering", "remaining"): "degraded"}
EXECUTION = {
    ("idle", "demand"): "queued", ("queued", "submit"): "running", ("running", "complete"): "done", ("running", "fail"): "retry", ("retry", "submit"): "running again",
    ("running again", "complete"): "done", ("running again", "fail"): "failed", ("failed", "demand"): "queued", ("done", "demand"): "queued",
}


def recovery_lifecycle(events: DataFrame) -> DataFrame:
    """``events(recovery_id, seq, event)``: from pending; an event that the state does not allow changes nothing and is not legal."""
    return _judged(events, "recovery_id", "pending", RECOVERY)


def execution(events: DataFrame) -> DataFrame:
    """``events(request_key, seq, event)``: demands queue a request or share the one under way; a failed one is tried once more."""
    out = _judged(events, "request_key", "idle", EXECUTION)
    shared = (F.col("event") == "demand") & ~F.col("from_state").isin("idle", "done", "failed")
    return out.withColumn("shared", shared)


BATCH = {("new", "prepare"): "prepared", ("prepared", "write"): "written", ("written", "acknowledge"): "acknowledged", ("acknowledged", "commit"): "committed", ("committed", "prepare"): "prepared"}


def batch_commits(events: DataFrame) -> DataFrame:
    """``events(batch, seq, event)``: a batch is prepared, written, acknowledged and committed in this order; a step that is tried again or
    comes out of turn changes nothing and is not legal, so a retried batch is written once."""
    return _judged(events, "batch", "new", BATCH)


def _judged(events: DataFrame, key: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    legal = F.concat_ws("|", "from_state", "event").isin(*(f"{s}|{e}" for s, e in moves))
    return table_machine(events, key, "seq", "event", start, moves).withColumn("legal", legal)


def empty_confirmations(answers: DataFrame, needed: int) -> DataFrame:
    """``answers(key, ts, seq, empty)``: a provider's empty answer counts once ``needed`` of them follow each other."""
    rows = running(answers, ["key"], ["ts", "seq"], {"run": F.when(F.col("empty"), F.lit(0)).otherwise(F.lit(1)).cast("long")})
    return rows.where("empty").groupBy("key", "run").agg(F.count(F.lit(1)).alias("attempts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("confirmed", F.col("attempts") >= needed)


def lease(outbox: DataFrame, now: Column, most: int, max_attempts: int, seconds: int, owner: str) -> DataFrame:
    """``outbox(outbox_id, status, available_ts, lease_expires_ts, attempts, created_ts, ..)``: the oldest eligible rows, leased."""
    waiting = F.col("status").isin("pending", "failed") & (F.col("available_ts") <= now)
    lapsed = (F.col("status") == "leased") & (F.col("lease_expires_ts") <= now)
    rows = outbox.where((F.col("attempts") < max_attempts) & (waiting | lapsed)).orderBy("created_ts", "outbox_id").limit(most)
    return rows.withColumns({"status": F.lit("leased"), "lease_owner": F.lit(owner), "lease_expires_ts": from_micros(micros(now) + seconds * 1_000_000), "attempts": F.col("attempts") + 1})


def settle(leased: DataFrame, delivered: Column, now: Column, max_attempts: int, most_seconds: int = 300) -> DataFrame:
    """The end of a lease: delivered, failed with an exponential wait, or dead after the last attempt."""
    wait = F.least(F.pow(F.lit(2.0), F.col("attempts")), F.lit(float(most_seconds))).cast("long")
    status = F.when(delivered, "delivered").when(F.col("attempts") >= max_attempts, "dead").otherwise("failed")
    return leased.withColumns({"status": status, "available_ts": F.when(status == "failed", from_micros(micros(now) + wait * 1_000_000))})


def flush_chunks(rows: DataFrame, keys: list[str], init: str, size: int, schema: str) -> DataFrame:
    """Chunks of about ``size`` rows of each bucket, never parting rows with one init time: keys, init, n, chunk.

    The fold sees one row per init time."""

    def make():
        chunk, held = 0, 0

        def step(r):
            nonlocal chunk, held
            if held and held + r.n > size:
                chunk, held = chunk + 1, 0
            held += r.n
            return [(*r[: len(keys) + 1], r.n, chunk)]

        return step

    sizes = rows.groupBy(*keys, init).agg(F.count(F.lit(1)).alias("n"))
    return sorted_fold(sizes, keys, [init], f"{schema}, n bigint, chunk bigint", make)


def startup_suppressed(evaluations: DataFrame, watermark: Column) -> DataFrame:
    """Evaluations at or before the time up to which an earlier run had evaluated are stale."""
    return evaluations.withColumn("stale", F.col("evaluation_ts") <= watermark)


def ready_buckets(rows: DataFrame, ts: str, seconds: int, now: Column) -> DataFrame:
    """Which time buckets are closed by the clock and can be flushed."""
    bucket = F.floor(micros(F.col(ts)) / (seconds * 1_000_000))
    out = rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("ready", (F.col("bucket") + 1) * seconds * 1_000_000 <= micros(now))


def publications(samples: DataFrame, key: str, order: list[str], state: str, every: int) -> DataFrame:
    """State changes to publish and the checkpoints of every ``every``-th sample of a key."""
    w = Window.partitionBy(key, "_b").orderBy(*order)
    rows = with_halo(samples, [key], order, 1).withColumn("_p", F.lag(state).over(w)).withColumn("_n", F.col("_before") + F.count_if(~F.col("_halo")).over(w))
    rows = rows.withColumns({"previous": F.col("_p"), "publish": ~F.col(state).eqNullSafe(F.col("_p")), "checkpoint": F.col("_n") % every == 0})
    return without_halo(rows).where("publish OR checkpoint").drop("_p", "_n")


def stream_states(checks: DataFrame, received: DataFrame, open_: Column, stale_seconds: int) -> DataFrame:
    """``checks(instrument, ts, seq)`` against the last receipt ``received(instrument, ts, seq)`` at or before them."""
    found = last_before(checks, received, "instrument", "ts", "seq", "last")
    age = micros(F.col("ts")) - micros(F.col("last.ts"))
    state = F.when(~open_, "paused").when(F.col("last").isNull(), "waiting").when(age > stale_seconds * 1_000_000, "stale").otherwise("healthy")
    return found.select("instrument", "ts", "seq", F.col("last.ts").alias("last_ts"), state.alias("state"))


def accepted_units(parts: DataFrame, unit: str, valid: Column) -> DataFrame:
    """Rows of units whose every row is valid: a candidate, its transition and its interaction are written together or not at all."""
    good = parts.groupBy(unit).agg(F.bool_and(valid).alias("_ok"), F.count(F.lit(1)).alias("unit_rows")).where("_ok").drop("_ok")
    return parts.join(good, unit)


def checkpoint_continuity(events: DataFrame, key: str) -> DataFrame:
    """``events(key, sequence, previous_sequence, n_events)``: a commit must advance, continue the stored one, and the first emits nothing."""
    w = Window.partitionBy(key).orderBy("sequence")
    prior = F.lag("sequence").over(w)
    verdict = F.when(prior.isNull() & (F.col("n_events") > 0), "initial_cannot_emit").when(prior.isNotNull() & (F.col("n_events") > 0) & (F.col("previous_sequence") != prior), "discontinuous").otherwise("committed")
    return events.withColumn("verdict", verdict)


def prune_batches(batches: DataFrame, identities: DataFrame) -> DataFrame:
    """Committed batches without a remaining identity."""
    return batches.where("status = 'committed'").join(identities.select("batch_id"), "batch_id", "left_anti")


def dense_sequence(rows: DataFrame, ts: str, tie: str) -> DataFrame:
    """1, 2, 3 .. in order of (ts, tie): counts per time bucket are carried, so no task orders all rows."""
    return running(rows, [], [ts, tie], {"sequence": F.lit(1).cast("long")})
