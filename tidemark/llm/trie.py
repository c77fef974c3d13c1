"""A prefix trie of conversations by distributed most-significant-digit radix partitioning.

1. Every distinct turn gets a dictionary id, told by the SHA-256 of its role and text; texts are never shuffled.
2. A conversation is the array of its turn ids with the turns' lengths.  Equal conversations are combined into one string with
   a count before anything is partitioned.
3. A bucket is a node with the strings below it.  Each round deals the strings of every open bucket by their next
   turn id.  Buckets of at most LOCAL turns, or of one string, are finished in one task; the few larger ones, at most (all turns) / LOCAL of
   them a round, skip the turns that their least and greatest string share and are dealt again.
4. A task finishes its small buckets by multikey quicksort: strings are split by a pivot turn into less, equal and greater, the
   equal ones go on with the next turn, and every step to a next turn emits a node.  Totals over subtrees are summed on the way
   back, then up through the nodes of the large buckets.
5. Ids of the conversations that end at one node are range-sorted in pieces, so that one task only hashes finished pieces.

Edge cases: rows without conv_id are left out; null role and text are empty; turns are ordered by (turn, null first, SHA-256 of
role and text), so ties and repeated rows have one order and each is a turn; an empty table gives an empty result; extra columns are ignored.
The codes of one conversation (16 bytes a turn) are one row; a task holds one at a time beside its small buckets.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, maybe_broadcast

#: Turns and strings of a bucket that one task finishes.
LOCAL = 200_000
#: Ids in one piece of a list that is hashed.
PIECE = 4096


def dictionary_encode(turns: DataFrame, work: Workspace) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id and its turns in order, array of (code, chars)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    keyed = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.length(text).cast("long").alias("chars"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("key"))
    keyed = work.save(keyed, "turns")
    codes = keyed.groupBy("key").agg(F.max("chars").alias("chars")).select("key", "chars", F.monotonically_increasing_id().alias("code"))
    codes = work.save(codes, "codes")
    item = F.struct("turn", "key", "code", "chars")
    convs = keyed.select("conv_id", "turn", "key").join(codes, "key").groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("t"))
    return work.save(convs.select("conv_id", F.transform("t", lambda x: F.struct(x["code"].alias("code"), x["chars"].alias("chars"))).alias("turns")), "strings")


_NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, end_id bigint"
_NAMES = [f.split()[0] for f in _NODE.split(", ")]


class _Nodes:
    """Nodes with at least two strings below them, parents before children."""

    def __init__(self):
        self.depth, self.parent, self.conv, self.convs, self.leaves, self.saved, self.kids, self.end, self.string = ([] for _ in range(9))

    def add(self, depth: int, parent: int, conv: int, convs: int, saved: int, string: int) -> int:
        for column, value in ((self.depth, depth), (self.parent, parent), (self.conv, conv), (self.convs, convs), (self.saved, saved), (self.string, string), (self.leaves, 0), (self.kids, 0), (self.end, None)):
            column.append(value)
        return len(self.depth) - 1

    def close(self) -> None:
        """Totals of subtrees; a chain below a node has added its own already."""
        for i in range(len(self.depth) - 1, -1, -1):
            self.leaves[i] = self.leaves[i] or 1
            if self.parent[i] >= 0:
                self.leaves[self.parent[i]] += self.leaves[i]
                self.saved[self.parent[i]] += self.saved[i]


def _split(rows: np.ndarray, symbol: np.ndarray):
    """Three-way partition by a pivot symbol until every part holds one symbol."""
    parts = [(rows, symbol)]
    while parts:
        rows, symbol = parts.pop()
        pivot = symbol[len(symbol) // 2]
        for other in (symbol < pivot, symbol > pivot):
            if other.any():
                parts.append((rows[other], symbol[other]))
        yield rows[symbol == pivot]


def _quicksort(codes: np.ndarray, chars: np.ndarray, first: np.ndarray, starts: np.ndarray, sid: np.ndarray, weight: np.ndarray):
    """Nodes of whole buckets of distinct strings, the bucket at ``starts[i]`` sharing its first turn.

    String i is codes[first[i]:first[i + 1]], at least one turn.  Gives the nodes with several strings below, and for the rest chains: (string,
    depth at which it is alone, node above or -1)."""
    length, nodes, chains, todo = np.diff(first), _Nodes(), [], []

    def child(rows: np.ndarray, d: int, above: int) -> None:
        if len(rows) == 1:
            chains.append((int(rows[0]), d, above))
        else:
            n = int(weight[rows].sum())
            todo.append((rows, d, nodes.add(d, above, int(sid[rows].min()), n, (n - 1) * int(chars[first[rows[0]] + d - 1]), int(rows[0]))))
        if above >= 0:
            nodes.kids[above] += 1

    for begin, stop in zip(starts, np.append(starts[1:], len(sid)), strict=True):
        child(np.arange(begin, stop), 1, -1)
    while todo:
        rows, d, node = todo.pop()
        ended = length[rows] == d
        if ended.any():
            nodes.end[node] = int(sid[rows[ended][0]])
            rows = rows[~ended]
        if len(rows):
            for part in _split(rows, codes[first[rows] + d]):
                child(part, d + 1, node)
    return nodes, np.array(chains, np.int64).reshape(-1, 3)


def _bucket_nodes(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    tail = rows["turns"].combine_chunks()
    first = tail.offsets.to_numpy().astype(np.int64)
    flat = tail.values.slice(first[0], first[-1] - first[0])
    first = first - first[0]
    code, chars = flat.field("code").to_numpy(), flat.field("chars").to_numpy()
    node, up, depth, sid, weight = (rows[c].to_numpy() for c in ("node", "up", "depth", "sid", "n"))
    found, chains = _quicksort(code, chars, first, starts, sid, weight)
    # chains: one node per turn, totals by running sums
    s, d0, above = chains.T
    n = first[s + 1] - first[s] - d0 + 1
    base = np.cumsum(n) - n
    at = np.repeat(np.arange(len(s)), n)
    step = np.arange(len(at)) - base[at]
    cost = (weight[s[at]] - 1) * chars[first[s[at]] + d0[at] - 1 + step]
    run = np.cumsum(cost)
    below = run[base[at] + n[at] - 1] - run + cost
    for i in np.flatnonzero(above >= 0).tolist():
        found.leaves[above[i]] += 1
        found.saved[above[i]] += int(below[base[i]])
    found.close()
    string = np.concatenate((np.array(found.string, np.int64), s[at]))
    name, link = np.array(found.conv, np.int64), np.array(found.parent, np.int64)
    above_chain = name[above[at]] if len(name) else np.zeros(len(at), np.int64)
    top = np.concatenate((link < 0, (step == 0) & (above[at] < 0)))
    parent = np.concatenate((name[link] if len(name) else name, np.where(step > 0, sid[s[at]], above_chain)))
    last = step == n[at] - 1
    columns = [
        np.concatenate((name, sid[s[at]])), np.concatenate((np.array(found.depth, np.int64), d0[at] + step)) + depth[string], np.where(top, up[string], parent), np.concatenate((np.array(found.convs, np.int64), weight[s[at]])),
        np.concatenate((np.array(found.kids, np.int64), (~last).astype(np.int64))), np.concatenate((np.array(found.leaves, np.int64), np.ones(len(at), np.int64))), np.concatenate((np.array(found.saved, np.int64), below))]
    end = pa.concat_arrays([pa.array(found.end, pa.int64()), pa.array(sid[s[at]], mask=~last)])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), end, pa.array(node[string], mask=~top)], names=[*_NAMES, "top"])


def _finish(enough: int):
    """Rows (node, next, up, depth, sid, n, turns from the bucket's own turn on), sorted by (node, next) -> the nodes of these buckets.

    Buckets are finished together when ``enough`` turns are held; none is cut.  ``top`` is the large node above a bucket."""

    def run(batches):
        held, marks, rows, turns, last = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            node, key = batch.column("node").to_numpy(), batch.column("next").to_numpy()
            new = np.ones(len(node), bool)
            new[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
            new[0] = last != (node[0], key[0])
            last = node[-1], key[-1]
            sizes = np.diff(batch.column("turns").offsets.to_numpy()) + 1
            at = 0
            for start in np.flatnonzero(new).tolist():
                turns += int(sizes[at:start].sum())
                if start > at:
                    held.append(batch.slice(at, start - at))
                    rows += start - at
                    at = start
                if turns >= enough:
                    yield _bucket_nodes(pa.Table.from_batches(held), np.array(marks))
                    held, marks, rows, turns = [], [], 0, 0
                marks.append(rows)
            held.append(batch.slice(at))
            rows += batch.num_rows - at
            turns += int(sizes[at:].sum())
        if held:
            yield _bucket_nodes(pa.Table.from_batches(held), np.array(marks))

    return run


def _paths(batches):
    """Large nodes with the turns that they skipped -> one node per turn; ``below`` is the total under the last one."""
    for batch in batches:
        for r in batch.to_pylist():
            m, cost = max(1, len(r["chars"])), (r["n"] - 1) * np.array(r["chars"] or [0], np.int64)
            depth = r["depth"] - m + 1 + np.arange(m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["sid"]] * m), pa.array(depth), pa.array([r["up"], *[r["sid"]] * (m - 1)], pa.int64()), pa.array([r["n"]] * m), pa.array([1] * (m - 1) + [r["kids"]]), pa.array([r["leaves"]] * m),
                 pa.array(np.cumsum(cost[::-1])[::-1] + r["below"]), pa.array([None] * (m - 1) + [r["end_id"]], pa.int64())], names=_NAMES)


def _pieces(batches):
    """Rows (x, y, conv_id), sorted: the decimal ids of one (x, y) joined by commas, at most PIECE in one row."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y, c = (b.column(i).to_numpy() for i in range(3))
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
        at = np.flatnonzero((np.arange(len(x)) - start) % PIECE == 0)
        text = [",".join(map(str, c[i:j].tolist())) for i, j in zip(at, np.append(at[1:], len(x)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[at]), pa.array(y[at]), pa.array(c[at]), pa.array(text)], names=["x", "y", "first", "ids"])


def _digests(batches):
    """Sorted pieces -> the smallest id of every list and the SHA-256 of the whole list."""
    key, low, sha = None, None, None
    for b in batches:
        ids, digests = [], []
        for x, y, first, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if key == (x, y):
                sha.update(b"," + text.encode())
                continue
            if key is not None:
                ids.append(low)
                digests.append(sha.hexdigest())
            key, low, sha = (x, y), first, hashlib.sha256(text.encode())
        yield pa.record_batch({"end_id": pa.array(ids, pa.int64()), "ends_sha256": pa.array(digests, pa.string())})
    if key is not None:
        yield pa.record_batch({"end_id": [low], "ends_sha256": [sha.hexdigest()]})


def list_digests(members: DataFrame) -> DataFrame:
    """``members(x, y, conv_id)`` -> end_id (the smallest id of a list (x, y)), ends_sha256."""
    pieces = members.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_pieces, "x bigint, y bigint, first bigint, ids string")
    return pieces.repartition("x", "y").sortWithinPartitions("x", "y", "first").mapInArrow(_digests, "end_id bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, work: Workspace, local: int = LOCAL) -> DataFrame:
    """``convs(conv_id, turns array<struct<code bigint, chars bigint>>)``, ids distinct and not null -> one row per node.

    A node is identified by (conv_id, depth); ``end_id`` is the smallest id of the conversations that end there.  ``local`` is the
    most turns of a bucket that one task finishes."""
    strings = work.save(convs.groupBy("turns").agg(F.min("conv_id").alias("sid"), F.count(F.lit(1)).alias("n")), "distinct")
    root = strings.agg(F.min("sid").alias("sid"), F.sum("n").alias("n")).first()
    spark = convs.sparkSession
    if root["sid"] is None:
        return spark.createDataFrame([], _NODE)
    empty = F.array().cast("array<bigint>")
    larges = [work.save(spark.range(1).select(F.col("id").alias("node"), F.lit(None).cast("bigint").alias("above"), F.lit(None).cast("bigint").alias("up"), F.lit(0).cast("bigint").alias("depth"), F.lit(root["sid"]).cast("bigint").alias("sid"), F.lit(root["n"]).cast("bigint").alias("n"), empty.alias("chars")), "large-0")]
    open_ = strings.select(F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("depth"), F.lit(root["sid"]).cast("bigint").alias("up"), "sid", "n", "turns")
    stops, finished = [], []
    for step in itertools.count(1):
        stops.append(open_.where("size(turns) = depth").select("node", F.col("sid").alias("end_id")))
        more = open_.where("size(turns) > depth").withColumn("next", F.expr("get(turns, cast(depth as int)).code"))
        sizes = more.groupBy("node", "next").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("turns") - F.col("depth") + 1).alias("w"))
        big = work.save(sizes.where(f"c > 1 AND w > {int(local)}").select("node", "next", F.monotonically_increasing_id().alias("id")), f"big-{step}")
        count = big.count()
        hint = maybe_broadcast(big, count, 40)
        small = more.join(hint, ["node", "next"], "left_anti") if count else more
        small = small.select("node", "next", "up", "depth", "sid", "n", F.expr("slice(turns, cast(depth as int) + 1, size(turns) - cast(depth as int))").alias("turns"))
        small = small.repartition("node", "next").sortWithinPartitions("node", "next")
        finished.append(work.save(small.mapInArrow(_finish(local), f"{_NODE}, top bigint"), f"nodes-{step}"))
        if not count:
            break
        inside = work.save(more.join(hint, ["node", "next"]).select("id", F.col("node").alias("above"), "up", "depth", "sid", "n", "turns"), f"open-{step}")
        ends = inside.groupBy("id", "above", "up", "depth").agg(F.min("turns").alias("lo"), F.max("turns").alias("hi"), F.min("sid").alias("sid"), F.sum("n").alias("n"))
        parts = F.expr("array_position(zip_with(slice(lo, 1, least(size(lo), size(hi))), slice(hi, 1, least(size(lo), size(hi))), (a, b) -> a.code = b.code), false)")
        ends = ends.withColumn("to", F.when(parts > 0, parts - 1).otherwise(F.least(F.size("lo"), F.size("hi"))).cast("bigint"))
        skipped = F.expr("transform(slice(lo, cast(depth as int) + 1, cast(to - depth as int)), x -> x.chars)")
        larges.append(work.save(ends.select(F.col("id").alias("node"), "above", "up", F.col("to").alias("depth"), "sid", "n", skipped.alias("chars")), f"large-{step}"))
        at = larges[-1].select(F.col("node").alias("id"), F.col("depth").alias("to"), F.col("sid").alias("top_sid"))
        open_ = inside.select("id", "sid", "n", "turns").join(maybe_broadcast(at, count, 32), "id").select(F.col("id").alias("node"), F.col("to").alias("depth"), F.col("top_sid").alias("up"), "sid", "n", "turns")
    # totals of the large nodes, from the deepest round up
    nodes, under = finished[0].drop("top"), None
    for extra in finished[1:]:
        nodes = nodes.unionByName(extra.drop("top"))
    for i in range(len(larges) - 1, -1, -1):
        tops = finished[i].where("top IS NOT NULL").select(F.col("top").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        sums = (tops if under is None else tops.unionByName(under)).groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"), F.count(F.lit(1)).alias("kids"))
        full = larges[i].join(sums, "node", "left").join(stops[i].groupBy("node").agg(F.min("end_id").alias("end_id")), "node", "left")
        full = work.save(full.select("node", "above", "up", "depth", "sid", "n", "chars", F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("below", F.lit(0)).alias("below"), F.coalesce("kids", F.lit(0)).alias("kids"), "end_id"), f"total-{i}")
        nodes = nodes.unionByName(full.mapInArrow(_paths, _NODE))
        cost = F.col("below") + (F.col("n") - 1) * F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
        under = full.select(F.col("above").alias("node"), "leaves", cost.alias("saved"))
    return nodes


def shared_openings(convs: DataFrame, work: Workspace) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 100 in place of its own first h, h = crc32(c) % 6."""
    kind = convs.schema["turns"].dataType
    heads = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    both = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h.cast("int")).join(heads, "base", "left")
    head = F.coalesce("head", F.array().cast(kind))
    return work.save(both.select("conv_id", F.concat(F.slice(head, 1, F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns")), "rebuilt")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "trie")
    convs = shared_openings(dictionary_encode(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), work), work)
    nodes = work.save(prefix_trie(convs, work), "nodes")
    digests = work.save(list_digests(convs.select(F.xxhash64("turns").alias("x"), F.xxhash64(F.lit(1), "turns").alias("y"), "conv_id")), "digests")
    if digests.count() != nodes.where("end_id IS NOT NULL").count():
        raise ValueError("two different conversations share 128 bits of hash")
    work.keep_only("nodes", "digests")
    columns = [c for c in nodes.columns if c != "end_id"]
    none = F.sha2(F.lit("").cast("binary"), 256).alias("ends_sha256")
    return nodes.where("end_id IS NULL").select(*columns, none).unionByName(nodes.where("end_id IS NOT NULL").join(digests, "end_id").select(*columns, "ends_sha256"))


ORACLE = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY i) AS turns FROM t GROUP BY conv_id),
bits AS (SELECT CAST(range AS UBIGINT) AS v FROM range(256)),
crc AS (SELECT v, v AS x, 0 AS k FROM bits UNION ALL
        SELECT v, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END, k + 1 FROM crc WHERE k < 8),
tab AS (SELECT list(x ORDER BY v) AS tab FROM crc WHERE k = 8),
h AS (SELECT conv_id, 0 AS k, 4294967295::UBIGINT AS x FROM c UNION ALL
      SELECT conv_id, k + 1, xor(x >> 8, tab[(xor(x, ascii(substr(conv_id::VARCHAR, k + 1, 1))::UBIGINT) & 255)::INT + 1]) FROM h, tab WHERE k < length(conv_id::VARCHAR)),
n AS (SELECT conv_id, (xor(x, 4294967295::UBIGINT) % 6)::INT AS h FROM h WHERE k = length(conv_id::VARCHAR)),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:n.h], []), c.turns[n.h + 1:len(c.turns)]) AS turns
      FROM c JOIN n USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
p AS (SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
node AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].text) END AS own
  FROM p GROUP BY path, d),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (path, depth)),
total AS (SELECT path[1:u] AS path, u AS depth, sum(own) AS saved, count(*) FILTER (k = 0) AS leaves
          FROM full_node, LATERAL (SELECT unnest(range(depth + 1)) AS u) GROUP BY 1, 2)
SELECT f.conv_id, f.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, f.n_convs, f.k::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN total USING (path, depth) LEFT JOIN node up ON up.depth = f.depth - 1 AND up.path = f.path[1:f.depth - 1]
"""
