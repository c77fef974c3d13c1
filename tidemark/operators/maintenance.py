"""Gap plans, retention, reconciliation, idempotent identities, acquisition control tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timeops import from_micros, micros


def gap_plan(expected: DataFrame, observed: DataFrame, interval_seconds: int, most: int) -> DataFrame:
    """Expected less observed opens as contiguous runs, cut into requests of at most ``most`` intervals."""
    missing = expected.join(observed.select("instrument", "open_ts").distinct(), ["instrument", "open_ts"], "left_anti")
    w = Window.partitionBy("instrument").orderBy("open_ts")
    step = interval_seconds * 1_000_000
    rows = missing.withColumn("_n", F.when(micros(F.col("open_ts")) - micros(F.lag("open_ts").over(w)) == step, 0).otherwise(1)).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("instrument", "run").orderBy("open_ts")) - 1) / most))
    return rows.groupBy("instrument", "run", "chunk").agg(F.min("open_ts").alias("start_ts"), from_micros(F.max(micros(F.col("open_ts"))) + step).alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("run", "chunk")


def round_robin(requests: DataFrame, key: str, order: str) -> DataFrame:
    """Requests interleaved over their owners: first of each, then second of each."""
    return requests.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def retention_plan(files: DataFrame, cutoffs: DataFrame, key: str) -> DataFrame:
    """Whole files ``files(key, path, max_ts)`` older than their stream's cutoff are to be dropped."""
    return files.join(cutoffs, key).withColumn("drop", F.col("max_ts") < F.col("cutoff"))


def reconcile(desired: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """start, stop, change or keep for every key of either side."""
    d, c = desired.select(key, F.col(value).alias("_d"), F.lit(True).alias("_hd")), current.select(key, F.col(value).alias("_c"), F.lit(True).alias("_hc"))
    j = d.join(c, key, "full_outer")
    return j.select(key, F.when(F.col("_hc").isNull(), "start").when(F.col("_hd").isNull(), "stop").when(~F.col("_d").eqNullSafe(F.col("_c")), "change").otherwise("keep").alias("action"))


def identity_conflicts(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Rows per logical identity, distinct fingerprints, and whether the identity is in conflict."""
    fp = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in payload)), 256)
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(fp).alias("fingerprints"), (F.countDistinct(fp) > 1).alias("conflict"))


def new_only(batch: DataFrame, stored: DataFrame, key: str, order: str) -> DataFrame:
    """An idempotent batch: the first row of each identity that is not stored yet."""
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def monotonic_upsert(stored: DataFrame, incoming: DataFrame, key: str, guard: str) -> DataFrame:
    """Latest row of each key by ``guard``; what is stored wins a tie."""
    both = stored.withColumn("_o", F.lit(1)).unionByName(incoming.withColumn("_o", F.lit(0)))
    cols = [c for c in stored.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(guard, "_o")).alias("v")).select(key, "v.*")


def reconcile_demands(demands: DataFrame) -> DataFrame:
    """``demands(stream_key, requirement, priority, expires, consumer)`` -> one row per stream: top priority, latest expiry (null
    if any is open), sorted consumers, and whether the requirements disagree."""
    return demands.groupBy("stream_key").agg(
        F.max("priority").alias("priority"), F.when(F.count("expires") == F.count(F.lit(1)), F.max("expires")).alias("expires"),
        F.array_join(F.sort_array(F.collect_set("consumer")), ",").alias("consumers"), (F.countDistinct("requirement") > 1).alias("disagree"), F.min("requirement").alias("requirement"),
    )


def compile_dependencies(requests: DataFrame, most_per_request: int, most_total: int) -> DataFrame:
    """Shared historical requests with their budget checks."""
    out = requests.groupBy("request_key").agg(F.max("priority").alias("priority"), F.array_join(F.sort_array(F.collect_set("dependency")), ",").alias("dependencies"), F.max("observations").alias("observations"))
    total = out.agg((F.sum("observations") <= most_total).alias("within_total"))  # one row
    return out.withColumn("within_request", F.col("observations") <= most_per_request).crossJoin(F.broadcast(total))


def dispatch(queue: DataFrame, slots: int) -> DataFrame:
    """Highest priority first, then id; only as many as there are slots."""
    return queue.orderBy(F.desc("priority"), "id").limit(slots)


def backoff_seconds(attempt: Column, base: float = 2.0, most: float = 300.0) -> Column:
    return F.least(F.pow(F.lit(base), attempt), F.lit(most))


def tick_gap_plan(gaps: DataFrame, backfill_from: Column, journal_from: Column) -> DataFrame:
    """``gaps(instrument, start_ts, end_ts)`` cut at the two horizons: what the journal holds is replayed, what a provider still
    serves is backfilled as well as it can be, and the rest cannot be recovered."""
    part = lambda lo, hi, action: F.struct(lo.alias("from_ts"), hi.alias("to_ts"), F.lit(action).alias("action"))
    s, e = F.col("start_ts"), F.col("end_ts")
    parts = F.array(
        part(s, F.least(e, backfill_from), "unrecoverable"), part(F.greatest(s, backfill_from), F.least(e, journal_from), "best_effort_backfill"), part(F.greatest(s, journal_from), e, "replay_journal"))
    return gaps.select("instrument", F.explode(parts).alias("p")).select("instrument", "p.*").where("from_ts < to_ts")
