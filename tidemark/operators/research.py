"""Research joins: what became of aggression, reference files against their records, annotations against what was observed."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ahead import first_ahead, millionths, points_up
from tidemark.functions.carry import sorted_fold
from tidemark.functions.timeops import from_micros, micros
from tidemark.operators.joins import asof_with_ties, interval_join

#: How far a lifecycle got, in order.
PROGRESS = ("ignore", "warn", "candidate", "armed", "triggered")


def aggression_outcomes(openings: DataFrame, trades: DataFrame, window_seconds: int, follow: float, trapped: float, absorption: float, most_open: int) -> DataFrame:
    """``openings(id, instrument, ts, seq, price, side 1 or -1)``, some of ``trades(instrument, ts, seq, price, cvd)`` -> id, instrument, outcome, ended_ts,
    favourable, adverse, n_trades.

    An episode looks at the first trade of every later time in its window.  It ends with_flow when price went ``follow`` its way and the signed
    volume since grew its way, trapped when both went against it; when the window is over it was absorbed if price never left ``absorption`` either
    way, else unresolved.  At most ``most_open`` episodes of an instrument are open: the oldest is evicted by a new one.  Pending: data ended first.

    What an episode would come to depends on no other one and is searched for in its window (``first_ahead``); the queue is a fold over openings only."""
    first = trades.groupBy("instrument", "ts").agg(F.min_by(F.struct("seq", "price", "cvd"), "seq").alias("t"))
    at_open = trades.select("instrument", "ts", "seq", F.col("cvd").cast("double").alias("level"))
    price, rises = F.col("_price"), F.col("side") > 0
    ep = openings.join(at_open, ["instrument", "ts", "seq"]).withColumn("_price", millionths("price"))
    ep = ep.withColumns({"up": price + F.when(rises, points_up(follow)).otherwise(points_up(trapped)), "down": price - F.when(rises, points_up(trapped)).otherwise(points_up(follow))})
    seen = first.select("instrument", F.col("ts").alias("rts"), F.col("t.seq").alias("rseq"), millionths("t.price").alias("price"), F.col("t.cvd").cast("double").alias("rlevel"))
    out = first_ahead(ep.select("id", "instrument", "ts", "seq", "side", "_price", "up", "down", "level"), seen, window_seconds, after=True, mirrored=True)
    above, below = (F.col("highest") - price) / 1e6, (price - F.col("lowest")) / 1e6
    most = lambda c: F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))
    out = out.withColumns({"favourable": most(F.when(rises, above).otherwise(below)), "adverse": most(F.when(rises, below).otherwise(above))})
    newest = trades.groupBy("instrument").agg(F.max("ts").alias("_newest"))
    out = out.join(F.broadcast(newest), "instrument")  # one row an instrument
    expires = from_micros(micros(F.col("ts")) + window_seconds * 1_000_000)
    calm = (F.col("favourable") <= absorption) & (F.col("adverse") <= absorption)
    over = F.when(F.col("_newest") >= expires, F.when(calm, "absorbed").otherwise("unresolved")).otherwise("pending")
    end = F.when(F.col("rose") == rises, "with_flow").when(F.col("rose").isNotNull(), "trapped")
    out = out.withColumns({"_end_ts": F.coalesce(from_micros(F.col("end_at")), expires), "_natural": F.coalesce(end, over)})
    # an episode that only its window ends is gone for every opening at that time, hence the -1
    queue = out.select("instrument", micros(F.col("ts")).alias("at"), "seq", "id", micros(F.col("_end_ts")).alias("end_at"), F.coalesce("end_seq", F.lit(-1)).cast("long").alias("end_seq"))

    def make():
        held: deque = deque()  # (id, end), oldest first

        def step(r):
            for _ in range(len(held)):
                x = held.popleft()
                if x[1] > (r.at, r.seq):
                    held.append(x)
            gone = [(r.instrument, held.popleft()[0], r.at) for _ in range(len(held) - most_open + 1)]
            held.append((r.id, (r.end_at, r.end_seq)))
            return gone

        return step

    gone = sorted_fold(queue, ["instrument"], ["at", "seq"], "instrument string, id bigint, evicted_at bigint", make).drop("instrument")
    out = out.join(gone, "id", "left")
    ended = F.when(F.col("evicted_at").isNotNull(), from_micros(F.col("evicted_at"))).when(F.col("_natural") != "pending", F.col("_end_ts"))
    kept = lambda c: F.when(F.col("evicted_at").isNull(), F.col(c))
    outcome = F.when(F.col("evicted_at").isNotNull(), "evicted").otherwise(F.col("_natural"))
    return out.select("id", "instrument", outcome.alias("outcome"), ended.alias("ended_ts"), F.round(kept("favourable"), 6).alias("favourable"), F.round(kept("adverse"), 6).alias("adverse"), kept("n_seen").alias("n_trades"))


def synced_references(records: DataFrame, found: DataFrame, human: list[str]) -> DataFrame:
    """``records(path, sha, human columns)`` against the files ``found(path, sha)`` -> path, status, previous_path, human columns.

    A file keeps the record of its path; one without takes the record of its content, if only one record has it: renamed.  Faults are rows
    too: changed (another content under the path), ambiguous (several records of the content), duplicate (two records of a path), missing (a
    record whose file is gone and was not renamed)."""
    row = F.struct("path", "sha", *human)
    paths = records.groupBy("path").agg(F.count(F.lit(1)).alias("_n"), F.min(row).alias("_own"))
    contents = records.where("sha <> ''").groupBy("sha").agg(F.count(F.lit(1)).alias("_m"), F.min(row).alias("_same"))
    both = found.select("path", "sha").join(paths, "path", "left").join(contents, "sha", "left")
    status = (
        F.when(F.col("_n") > 1, "duplicate")
        .when(F.col("_own").isNotNull(), F.when((F.coalesce(F.col("_own.sha"), F.lit("")) == "") | (F.col("_own.sha") == F.col("sha")), "kept").otherwise("changed"))
        .when(F.col("_m") > 1, "ambiguous").when(F.col("_m") == 1, "renamed").otherwise("new"))
    both = both.withColumn("status", status)
    source = F.when(F.col("status") == "kept", F.col("_own")).when(F.col("status") == "renamed", F.col("_same"))
    out = both.select("path", "status", F.when(F.col("status") == "renamed", F.col("_same.path")).alias("previous_path"), *(source[h].alias(h) for h in human))
    moved = out.where("previous_path IS NOT NULL").select(F.col("previous_path").alias("path")).distinct()
    gone = paths.join(found.select("path").distinct(), "path", "left_anti").join(moved, "path", "left_anti")
    none = F.lit(None).cast("string")
    return out.unionByName(gone.select("path", F.when(F.col("_n") > 1, "duplicate").otherwise("missing").alias("status"), none.alias("previous_path"), *(F.col(f"_own.{h}").alias(h) for h in human)))


def enriched_annotations(annotations: DataFrame, features: dict[str, tuple[DataFrame, int]], transitions: DataFrame, before_seconds: int, after_seconds: int) -> DataFrame:
    """``annotations(annotation_id, instrument, direction, ts, zone_lower, zone_upper, expected, missing)`` with the context of every timeframe and the
    transitions of signals near it -> one row each: context, signal_status, n_candidates, first_divergence, reasons.

    ``features[tf]`` is (instrument, as_of, id) of committed features and the age in seconds from which they are stale; ``transitions`` are (signal_id,
    transition_id, instrument, direction, ts, to_status, zones array<struct<lower, upper>>).  A signal is a candidate if it moved from
    ``before_seconds`` before to ``after_seconds`` after, and, where the annotation names a zone, if one of these moves touches it.  The first
    divergence is where the furthest state that was seen parts from the expected one."""
    seen, context = annotations, []
    for tf, (f, fresh) in features.items():
        at = asof_with_ties(annotations.select("annotation_id", "instrument", "ts"), f, "instrument", fresh, "_status")
        stale = micros(F.col("ts")) - micros(F.col("as_of")) > fresh * 1_000_000
        status = F.when(F.col("n_matches") == 0, "unavailable").when(F.col("n_matches") > 1, "ambiguous").when(stale, "stale").otherwise("matched")
        seen = seen.join(at.select("annotation_id", status.alias(f"_{tf}")), "annotation_id")
        context.append(tf)
    key = lambda df: df.withColumn("_k", F.concat_ws("|", "instrument", "direction"))
    left = key(annotations).select("_k", "ts", "annotation_id", "zone_lower", "zone_upper")
    right = key(transitions).select("_k", F.col("ts").alias("rts"), "signal_id", "to_status", "zones")
    near = interval_join(left, right, "_k", before_seconds, after_seconds)
    open_zone = F.col("zone_lower").isNull() | F.col("zone_upper").isNull()
    touch = open_zone | F.exists("zones", lambda z: (z["lower"] <= F.col("zone_upper")) & (F.col("zone_lower") <= z["upper"]))
    rank = F.max(F.when(F.col("to_status") == "triggered", 4).when(F.col("to_status") == "armed", 3))
    signals = near.withColumn("_touch", touch).groupBy("annotation_id", "signal_id").agg(F.bool_or("_touch").alias("_touch"), rank.alias("_reached")).where("_touch")
    found = signals.groupBy("annotation_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_reached").alias("_reached"))
    rows = seen.join(found, "annotation_id", "left").withColumn("n_candidates", F.coalesce("_n", F.lit(0)).cast("long"))
    status = F.when(F.col("n_candidates") == 0, "unmatched").when(open_zone, "unresolved").when(F.col("n_candidates") == 1, "matched").otherwise("ambiguous")
    rows = rows.withColumn("signal_status", status)
    name = lambda i: F.element_at(F.array(*map(F.lit, PROGRESS)), i + 1)
    want = F.array_position(F.array(*map(F.lit, PROGRESS)), F.col("expected")) - 1
    got = F.col("_reached").cast("int")
    divergence = (
        F.when(F.col("expected").isNull(), "human_expected_lifecycle_pending")
        .when(F.col("signal_status") == "unmatched", "not_observed_before_durable_lifecycle")
        .when(F.col("signal_status") != "matched", F.concat(F.lit("signal_candidate_join_"), "signal_status"))
        .when(got.isNull(), "not_observed_before_durable_lifecycle")
        .when(got < want, F.concat(F.lit("system_stopped_at_"), name(got)))
        .when(got > want, F.concat(F.lit("system_advanced_to_"), name(got)))
        .otherwise("human_and_system_lifecycle_match"))
    off: list[Column] = [F.when(F.col(f"_{tf}") != "matched", F.concat(F.lit(f"context_{tf}_"), F.col(f"_{tf}"))) for tf in context]
    signal = F.when(F.col("signal_status") == "unmatched", "no_durable_signal_transition_near_annotation").when(F.col("signal_status") != "matched", F.concat(F.lit("signal_candidate_join_"), "signal_status"))
    reasons = F.array_join(F.array_compact(F.array(F.nullif(F.coalesce("missing", F.lit("")), F.lit("")), *off, signal)), ",")
    return rows.select(
        "annotation_id", F.concat_ws(",", *(F.concat(F.lit(f"{tf}:"), F.col(f"_{tf}")) for tf in context)).alias("context"), "signal_status", "n_candidates", divergence.alias("first_divergence"),
        F.when(reasons == "", "fully_enriched").otherwise(reasons).alias("reasons"))
