"""How filters interact: what each removes at every place of every order, and its Shapley share.

1. Rows are range-sorted by (fingerprint of the text, doc_id) between partitions and by (fingerprint, full text, doc_id)
   inside them.  The text is no key of the exchange, so the bounds that the driver samples stay 16 bytes each, and a text that
   a third of all rows share is cut by doc_id into as many partitions as it needs.
2. A row is a duplicate if the group of its text holds a smaller id; that is seen from its predecessors.  A partition also
   reports the texts of its first and its last fingerprint with their smallest ids.  Grouped by text, these few rows tell the
   rows at the beginning of a partition what stands before it, over however many partitions a group reaches.
3. The failures of a row are one bit mask.  Masks are counted per part with the labels: 2**n counters that add up, so
   copies and large parts are combined before the shuffle.
4. Every number of the report is a sum of counters: kept after a step are the masks without any bit so far, removed those with
   the step's bit and none before, and so on.  The orders of a mask in which a filter comes first among the k that fail are
   n! / k, which gives the Shapley numerator without going through orders.

Edge cases: null texts are empty (no words, no characters), null parts are the empty part; a row with a null id is
no duplicate and makes none, as no id is smaller; repeated rows with the smallest id are no duplicates either; an id with
several label rows counts as good or toxic if any of them says so; an empty table gives an empty report; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, documents, maybe_broadcast

NONE = np.iinfo(np.int64).max


def standard_filters(text: str = "text") -> dict[str, Column]:
    """Conditions on which a text fails, by letter."""
    t = F.col(text)
    words = F.regexp_extract_all(t, F.lit(r"([^\x20\x09-\x0D]+)"))
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long")
    return {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length(t), "D": t.rlike(r"[#$%&*|]")}


_ROWS = "part string, doc_id bigint, mask int, again boolean, place int, edge int, text string, fp bigint, least bigint"


class _Run:
    """Texts of one fingerprint in the order met, each with its smallest id."""

    def __init__(self, fp: int):
        self.fp, self.least = fp, {}

    def add(self, text: str, least: int) -> None:
        self.least[text] = min(least, self.least.get(text, NONE))


def _neighbours(batches):
    """Sorted rows (place, part, doc_id, mask, fp, text) -> rows with ``again``, then the texts at the partition's ends.

    Of the rows only those of the first fingerprint name the text they have (``edge``), for what stands in partitions before."""
    first = run = before = None
    place = 0
    for b in batches:
        if not b.num_rows:
            continue
        place = b.column("place")[0].as_py()
        fp, text, n = b.column("fp").to_numpy(), b.column("text"), b.num_rows
        known = pc.is_valid(b.column("doc_id")).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(b.column("doc_id"), NONE).to_numpy()
        starts = np.ones(n, bool)
        starts[1:] = (fp[1:] != fp[:-1]) | ~pc.equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(starts)
        least = np.minimum.reduceat(ids, at)
        if before is not None and before[0] == fp[0] and before[1] == text[0].as_py():
            least[0] = min(least[0], before[2])
        group = np.cumsum(starts) - 1
        again = known & (ids > least[group])
        if first is None:
            first = run = _Run(int(fp[0]))
        ends = fp[at]
        for g in np.flatnonzero(ends == run.fp):
            run.add(text[int(at[g])].as_py(), int(least[g]))
        edge = np.full(n, -1, np.int32)
        if run is first:
            order = {t: i for i, t in enumerate(first.least)}
            for g in np.flatnonzero(ends == first.fp):
                edge[group == g] = order[text[int(at[g])].as_py()]
        if ends[-1] != run.fp:
            run = _Run(int(ends[-1]))
            for g in np.flatnonzero(ends == run.fp):
                run.add(text[int(at[g])].as_py(), int(least[g]))
        before = int(fp[-1]), text[n - 1].as_py(), int(least[-1])
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), b.column("doc_id"), b.column("mask"), pa.array(again), b.column("place"), pa.array(edge, mask=edge < 0), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=[f.split()[0] for f in _ROWS.split(", ")])
    entries = [] if first is None else [(r, i, t, m) for r in ([first] if run is first else [first, run]) for i, (t, m) in enumerate(r.least.items())]
    if entries:
        n = len(entries)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.bool_()), pa.array([place] * n, pa.int32()), pa.array([i if r is first else None for r, i, _, _ in entries], pa.int32()),
             pa.array([t for _, _, t, _ in entries], pa.string()), pa.array([r.fp for r, _, _, _ in entries], pa.int64()), pa.array([m for *_, m in entries], pa.int64())],
            names=[f.split()[0] for f in _ROWS.split(", ")])


def failure_masks(docs: DataFrame, filters: dict[str, Column], work: Workspace) -> DataFrame:
    """``docs(doc_id, text, part)`` -> doc_id, part, mask: bit i for the i-th filter, the last bit for a duplicate text.

    ``filters`` are conditions over a column ``text`` without nulls."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("part", F.lit("")).alias("part"))
    rows = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    bits = [F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)) for i, failed in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    seen = work.save(rows.select(F.spark_partition_id().alias("place"), "part", "doc_id", mask.cast("int").alias("mask"), "fp", "text").mapInArrow(_neighbours, _ROWS), "sorted")
    ends = seen.where("text IS NOT NULL").select("place", "edge", "fp", "text", "least")
    least = ends.groupBy("fp", "text").agg(F.min("least").alias("least"))
    told = work.save(ends.where("edge IS NOT NULL").select("place", "edge", "fp", "text").join(least, ["fp", "text"]).select("place", "edge", "least"), "ends")
    told = maybe_broadcast(told, told.count(), 32)
    again = F.col("again") | F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    kept = seen.where("text IS NULL").select("doc_id", "part", "mask", "again", "place", "edge").join(told, ["place", "edge"], "left")
    return kept.select("doc_id", "part", (F.col("mask") + F.when(again, F.lit(1 << len(filters))).otherwise(F.lit(0))).alias("mask"))


def _report(letters: str):
    n, masks = len(letters), np.arange(1 << len(letters))
    orders = ["".join(p) for p in permutations(letters)]
    removed, redundant, kept, own, share = [], [], [], [], []
    fails = np.array([bin(m).count("1") for m in masks])
    for order in orders:
        before = 0
        for letter in order:
            bit = 1 << letters.index(letter)
            has = masks & bit != 0
            removed.append(has & (masks & before == 0))
            redundant.append(has & (masks & before != 0))
            before |= bit
            kept.append(masks & before == 0)
            own.append(masks == bit)
            share.append(np.where(has, factorial(n) // np.maximum(fails, 1), 0))
    removed, redundant, kept, own, share = (np.array(x).astype(np.int64) for x in (removed, redundant, kept, own, share))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = np.zeros((len(masks), 3), np.int64)
                for c in row["counters"]:
                    count[c["mask"]] = c["n"], c["good"], c["toxic"]
                lost = removed @ count
                yield pa.record_batch({
                    "part": pa.array([row["part"]] * len(removed), pa.string()), "filter_order": pa.array([o for o in orders for _ in range(n)]), "step": pa.array(list(range(1, n + 1)) * len(orders), pa.int32()),
                    "kept": kept @ count[:, 0], "removed": lost[:, 0], "redundant": redundant @ count[:, 0], "unique_fails": own @ count[:, 0],
                    "good_lost": lost[:, 1], "toxic_lost": lost[:, 2], "shapley": share @ count[:, 0]})

    return run


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], duplicates: str, work: Workspace) -> DataFrame:
    """``docs(doc_id, text, part)``, ``labels(doc_id, quality, toxic)`` -> one row per part, order and step.

    ``filters`` maps one-letter names to failure conditions, ``duplicates`` names the filter of repeated texts; n
    filters make n! orders, so six are a sensible most."""
    letters = "".join(filters) + duplicates
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marks = work.save(marks.where("good OR toxic"), "marks")
    judged = failure_masks(docs, filters, work).join(maybe_broadcast(marks, marks.count(), 24), "doc_id", "left")
    tally = lambda c: F.count(F.when(F.col(c), 1))
    counters = judged.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), tally("good").alias("good"), tally("toxic").alias("toxic"))
    parts = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counters"))
    return parts.mapInArrow(_report(letters), "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source").withColumnRenamed("source", "part")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return filter_audit(docs, labels, standard_filters(), "E", Workspace(spark, "audit"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT doc_id, part,
        (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
        + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(letter, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT v.letter || w.letter || x.letter || y.letter || z.letter AS filter_order
      FROM f v, f w, f x, f y, f z WHERE v.b + w.b + x.b + y.b + z.b = 31 AND (v.b | w.b | x.b | y.b | z.b) = 31),
s AS (SELECT filter_order, step, f.b, coalesce((SELECT sum(g.b) FROM f g WHERE instr(filter_order, g.letter) < step), 0)::INT AS earlier
      FROM o, range(1, 6) r(step) JOIN f ON f.letter = substr(filter_order, step, 1))
SELECT part, filter_order, step::INT AS step,
  sum(CASE WHEN (mask & (earlier + b)) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN (mask & b) <> 0 AND (mask & earlier) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN (mask & b) <> 0 AND (mask & earlier) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN mask = b THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN (mask & b) <> 0 AND (mask & earlier) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN (mask & b) <> 0 AND (mask & earlier) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost,
  sum(CASE WHEN (mask & b) <> 0 THEN n * (120 // bit_count(mask::UTINYINT)) ELSE 0 END)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, b, earlier
"""
