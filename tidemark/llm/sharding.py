"""Histogram sort: splitters by exact counts, then one exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts are neighbours.  Splitters are found by iterative
probing: every round counts, over all rows, the exact bytes at or below each candidate boundary and replaces each open
interval by the probe step that holds its target, until every splitter is within the tolerance or its interval is one
key.  A key that alone is heavier than the tolerance (one group of copies may hold a third of all bytes) stays whole if one of its
ends is within twice the tolerance, and is probed further by doc_id inside the group otherwise.  Only probe counts, at most MOST_PROBES a round, reach the driver.

The exchange has several partitions per shard, sized by bytes (at most MOST_PARTS, beyond which they grow and their sorts spill), so a large shard is never one task; a slot is the exact count
of rows in the shard's earlier partitions plus the place in its own.

Edge cases: null and empty texts have size 1 and one common hash; repeated rows, ids included, each keep a slot, but nothing tells them
apart, so one (text, id) pair that is repeated stays in one partition however often;
null ids sort as the smallest; fewer rows than shards leave shards empty; an empty table gives an empty result; other
columns travel along unless they have the name of one that is made here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bounds of what the driver holds, whatever the size of the input: partitions of a shard, and boundaries probed in one round.
MOST_PARTS, MOST_PROBES = 256, 1 << 14


def _counts(keys: DataFrame, key: str, probes: list[int], weight: str) -> list[int]:
    """Exact weight of the rows with key <= probe, for each sorted probe; partial sums leave each task."""
    bounds = np.array(probes, np.int64)

    def count(batches):
        total = np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            cell = np.searchsorted(bounds, b.column(0).to_numpy(), "left")
            np.add.at(total, cell, b.column(1).to_numpy())
        some = np.flatnonzero(total)
        yield pa.record_batch({"cell": pa.array(some.astype(np.int32)), "w": pa.array(total[some])})

    cells = keys.select(key, weight).mapInArrow(count, "cell int, w bigint").groupBy("cell").agg(F.sum("w").alias("w")).collect()
    total = [0] * (len(bounds) + 1)
    for row in cells:
        total[row["cell"]] = int(row["w"])
    return [int(x) for x in np.cumsum(total)[: len(bounds)]]


def find_splitters(keys: DataFrame, key: str, weight: str, targets: list[int], tolerance: int, probes: int = 128, low: int = LOW, high: int = HIGH) -> list[tuple[int, int, int]]:
    """For each target the key s, the weight at or below it, and the weight strictly below: |at(s) - target| <= tolerance,
    or s is the first key that passes the target (then the target falls inside that one key)."""
    open_ = {i: (low, high) for i in range(len(targets))}  # the answer lies in (lo, hi]
    found: dict[int, tuple[int, int]] = {}
    at: dict[int, int] = {low: 0}
    while open_:
        asked, between = set(), set(open_.values())
        steps = max(2, min(probes, MOST_PROBES // len(between)))
        for lo, hi in between:
            asked |= {lo + (hi - lo) * (j + 1) // steps for j in range(steps)} - {lo}
        asked = sorted(asked)
        at |= dict(zip(asked, _counts(keys, key, asked, weight), strict=True))
        for i, (lo, hi) in list(open_.items()):
            inside = [p for p in asked if lo < p <= hi]
            near = min(inside, key=lambda p: abs(at[p] - targets[i]))
            if abs(at[near] - targets[i]) <= tolerance:
                found[i] = (near, near)
                del open_[i]
                continue
            hi2 = next((p for p in inside if at[p] >= targets[i]), hi)
            lo2 = max([lo, *(p for p in inside if p < hi2)])
            if hi2 - lo2 <= 1:
                found[i] = (hi2, lo2)
                del open_[i]
            else:
                open_[i] = (lo2, hi2)
    return [(s, at[s], at.get(b, at[s]) if b != s else at[s]) for s, b in (found[i] for i in range(len(targets)))]


def splitters(keys: DataFrame, cuts: list[int], tolerance: int) -> list[tuple[int, int]]:
    """Boundaries (h, id): a row belongs below the cut if (h, id) <= boundary."""
    out = []
    heavy: dict[int, list[tuple[int, int]]] = {}
    for i, (s, upto, below) in enumerate(find_splitters(keys, "h", "size", cuts, tolerance)):
        out.append((s, HIGH))
        near = min((upto, below), key=lambda x: abs(x - cuts[i]))
        if abs(near - cuts[i]) <= 2 * tolerance:  # keep the copies of a text together while that costs little
            out[i] = (s, HIGH) if near == upto else (s, LOW)
        elif abs(upto - cuts[i]) > tolerance:
            heavy.setdefault(s, []).append((i, cuts[i] - below))
    for h, wanted in heavy.items():
        group = keys.where(F.col("h") == h)
        first, last = group.agg(F.min("id"), F.max("id")).first()
        if first == last:  # one row, or rows that no order tells apart
            continue
        for (i, _), (d, _, _) in zip(wanted, find_splitters(group, "id", "size", [t for _, t in wanted], tolerance, low=max(LOW, first - 1), high=last), strict=True):
            out[i] = (h, d)
    return out


def shard_documents(docs: DataFrame, shards: int = 16, tolerance: float = 0.005, part_bytes: int = 64 << 20, work: Workspace | None = None) -> DataFrame:
    """Adds ``size``, ``shard`` and ``slot`` to ``docs(doc_id, text, ...)``; rows come sorted inside their shard.

    ``tolerance`` is the share of a shard's bytes by which a splitter may miss its target."""
    spark = docs.sparkSession
    docs = docs.drop("size", "shard", "slot", "__h", "__id", "__part")
    work = work or Workspace(spark, "shards")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW).cast("long"))
    keys = work.save(docs.select(h.alias("h"), ident.alias("id"), size.alias("size")), "keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    per = min(MOST_PARTS, max(1, -(-total // (shards * part_bytes))))
    parts = shards * per
    cuts = [total * (j + 1) // parts for j in range(parts - 1)]
    bounds = splitters(keys, cuts, max(1, int(total / shards * tolerance))) if total else []
    table = spark.sparkContext.broadcast((np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)))

    def parted(batches):
        hs, ids = table.value
        for b in batches:
            x, d = b.column("__h").to_numpy(), b.column("__id").to_numpy()
            at = np.searchsorted(hs, x, "left")
            for key in np.unique(x[np.isin(x, hs)]):  # rows of a key that is a boundary: its cuts go by id
                mine, (lo, hi) = x == key, np.searchsorted(hs, key, "left") + np.array([0, np.count_nonzero(hs == key)])
                at[mine] = lo + np.searchsorted(ids[lo:hi], d[mine], "left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "__part"])

    tagged = docs.select("*", size.alias("size"), h.alias("__h"), ident.alias("__id"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema.fields)
    sent = tagged.mapInArrow(parted, f"{fields}, `__part` int").repartitionById(parts, F.col("__part")).sortWithinPartitions("__part", "__h", "__id")
    counts = {r["p"]: r["n"] for r in work.save(keys.select(F.col("h").alias("__h"), F.col("id").alias("__id")).mapInArrow(parted, "`__h` bigint, `__id` bigint, `__part` int").groupBy(F.col("__part").alias("p")).agg(F.count(F.lit(1)).alias("n")), "counts").collect()}
    work.keep_only()
    base, run = [], 0
    for p in range(parts):
        run = 0 if p % per == 0 else run
        base.append(run)
        run += counts.get(p, 0)

    def slotted(batches):
        seen: dict[int, int] = {}
        for b in batches:
            p = b.column("__part").to_numpy()
            slot = np.empty(len(p), np.int64)
            for q in np.unique(p):
                mine = p == q
                start = seen.get(int(q), base[int(q)])
                slot[mine] = start + np.arange(mine.sum())
                seen[int(q)] = start + int(mine.sum())
            names = [n for n in b.schema.names if not n.startswith("__")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array((p // per).astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.schema.fields if not f.name.startswith("__"))
    return sent.mapInArrow(slotted, f"{kept}, shard int, slot bigint")


def op7_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard_documents(docs).select(
        "doc_id", "size", F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
