"""Direction by policy: which timeframes must agree, which confirm, and what an opposing context does, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def qualify_by_policy(evidence: DataFrame, definitions: DataFrame, rules: DataFrame) -> DataFrame:
    """``evidence(instrument, ts, timeframe, score)``, the scores known at an evaluation, against ``definitions(definition, minimum_score,
    minimum_confirmations, opposing)`` and ``rules(definition, timeframe, role)`` -> instrument, ts, definition, status, direction, is_degraded.

    Roles: evaluation (its absence means that there is nothing to judge), primary (all must be there, take a side, and the same), confirmation (so
    many must take it too) and context, where an opposing side is a veto, degrades or is ignored.  The gates are judged in this order; a missing
    context degrades.  A timeframe may have several roles; what the evidence lacks is seen from the counts of the rules, so no pair is made for it."""
    wanted = rules.groupBy("definition").pivot("role", ["primary", "confirmation", "context"]).count().na.fill(0)
    wanted = wanted.select("definition", *(F.col(r).alias(f"_{r}") for r in ("primary", "confirmation", "context")))
    known = evidence.where("score IS NOT NULL").join(rules, "timeframe").join(definitions.join(wanted, "definition"), "definition")
    side = F.when(F.abs("score") >= F.col("minimum_score"), F.signum(F.col("score").cast("double")).cast("int")).otherwise(F.lit(0))
    known = known.withColumn("_side", side)
    n = lambda role, s=None: F.count_if((F.col("role") == role) & (F.lit(True) if s is None else F.col("_side") == s))
    keys = ["instrument", "ts", "definition", "minimum_confirmations", "opposing", "_primary", "_confirmation", "_context"]
    sums = known.groupBy(*keys).agg(
        n("evaluation").alias("_now"), *(n(role, s).alias(f"_{role}_{name}") for role in ("primary", "confirmation", "context") for s, name in ((1, "up"), (-1, "down"), (0, "none"))))
    up = F.col("_primary_up") > 0
    same = lambda role: F.when(up, F.col(f"_{role}_up")).otherwise(F.col(f"_{role}_down"))
    against = lambda role: F.when(up, F.col(f"_{role}_down")).otherwise(F.col(f"_{role}_up"))
    seen = lambda role: F.col(f"_{role}_up") + F.col(f"_{role}_down") + F.col(f"_{role}_none")
    short = same("confirmation") < F.col("minimum_confirmations")
    status = (
        F.when((F.col("_now") == 0) | (seen("primary") < F.col("_primary")), "missing_evidence")
        .when(F.col("_primary_none") > 0, "neutral")
        .when((F.col("_primary_up") > 0) & (F.col("_primary_down") > 0), "conflicted")
        .when(short, F.when(against("confirmation") > 0, "conflicted").when(F.col("_confirmation_none") > 0, "neutral").otherwise("missing_evidence"))
        .when((against("context") > 0) & (F.col("opposing") == "veto"), "vetoed").otherwise("qualified"))
    out = sums.withColumn("status", status)
    good = F.col("status") == "qualified"
    degraded = good & ((seen("context") < F.col("_context")) | ((against("context") > 0) & (F.col("opposing") == "degrade")))
    return out.select("instrument", "ts", "definition", "status", F.when(good, F.when(up, "LONG").otherwise("SHORT")).alias("direction"), degraded.alias("is_degraded"))


def coherent_snapshot(features: DataFrame, bars: DataFrame, base: str, window_seconds: int, most: int) -> DataFrame:
    """The newest consistent view of every instrument: ``features(instrument, timeframe, as_of, feature_id, version, configuration, source)`` and
    ``bars(instrument, source, close_ts)`` -> a row per timeframe.

    The anchor is the newest feature of the ``base`` timeframe.  Only features of its version and configuration, up to its time, are looked at: the
    newest of each timeframe, and the base timeframe's history in the window, at most ``most``.  Bars are those of the source with
    most of them in the window, the anchor's own and then the later name on ties."""
    newest = F.max(F.struct("as_of", "feature_id", "version", "configuration", "source")).alias("a")
    anchor = features.where(F.col("timeframe") == base).groupBy("instrument").agg(newest)
    start = F.col("a.as_of") - F.make_dt_interval(secs=F.lit(window_seconds))
    same = features.join(anchor, "instrument").where((F.col("version") == F.col("a.version")) & (F.col("configuration") == F.col("a.configuration")) & (F.col("as_of") <= F.col("a.as_of")))
    latest = same.groupBy("instrument", "timeframe", "a").agg(F.max(F.struct("as_of", "feature_id")).alias("l"), F.count_if(F.col("as_of") > start).alias("_h"))
    history = latest.where(F.col("timeframe") == base).select("instrument", F.least(F.col("_h"), F.lit(most)).cast("long").alias("n_history"))
    inside = bars.join(anchor, "instrument").where((F.col("close_ts") > start) & (F.col("close_ts") <= F.col("a.as_of")))
    sources = inside.groupBy("instrument", "source", "a").agg(F.count(F.lit(1)).alias("n"))
    best = sources.groupBy("instrument").agg(F.max(F.struct("n", (F.col("source") == F.col("a.source")).alias("own"), "source")).alias("b"))
    out = latest.join(history, "instrument").join(best, "instrument")
    return out.select(
        "instrument", "timeframe", F.col("l.as_of").alias("as_of"), F.col("l.feature_id").alias("feature_id"), F.col("a.as_of").alias("anchor_ts"), F.col("a.version").alias("version"),
        F.col("b.source").alias("bar_source"), F.least(F.col("b.n"), F.lit(most)).cast("long").alias("n_bars"), "n_history")
