"""N-gram Jaccard join by grouped prefixes.

1. Documents with equal shingle sets are one class (its smallest id stands for it).
2. Two linked sets share at least L shingles within their prefixes of ``n - ceil(t n) + L`` shingles in any common order.  In
   hash order, with L a small share of n, this keeps the classes of whose prefix enough shingles occur elsewhere; a few
   common passages in a text do not make it a candidate, and only about a fifth of all shingles are shuffled.
3. For those, shingles are ordered by (document frequency, hash).  Frequency-1 shingles come first and link nothing, so
   only the rest of each prefix is indexed: a passage in thousands of otherwise different documents never becomes a
   posting list, and neither do strongly edited copies.
4. Classes with identical prefix and size are one group.  Every posting first links its groups to one pivot (the class
   with the fewest unshared shingles), which joins true copy groups in a linear number of checks; then the remaining group
   pairs, filtered by size, position and component, are expanded to members and verified.

A pair is never made when both sides are already in one component.  All checks are exact; nothing is capped or sampled.

Edge cases: null or empty texts have no shingles and link with nothing; fewer words than the shingle width are one
shingle; repeated rows are one class; an id used for several texts is one document; null ids form no links; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.components import connected_components
from tidemark.llm.workspace import Workspace, maybe_broadcast


#: Stands for "no key of its own" in the key of a group (ids are never so small in practice, and the prefix decides anyway).
NO_KEY = -(1 << 63)


def _sets(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, concatenated, and where each text begins."""
    h, at = X.grams(hashes, first, width)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for t in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width)):
        n = int(first[t + 1] - first[t])
        h = np.append(h, X.mix(np.array([X.whole(hashes, first[t], first[t + 1])]) + np.uint64(n)))
        doc = np.append(doc, t)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(first)))


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return X.signed(run[first[1:]] - run[first[:-1]])


def _ell(n: int | np.ndarray) -> np.ndarray:
    """How many common shingles the long prefix of a set of n must hold for a partner of the same size."""
    return np.maximum(1, -(-6 * n // 100))


def _signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, (s1, s2) set hash, the long prefix of the set in hash order, and how many of it must occur elsewhere."""

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            h, at = _sets(*X.words(data, offs, X.SPACED), width)
            n = np.diff(at)
            take = np.where(n > 0, np.minimum(n, n - -(-percent * n // 100) + _ell(n)), 0)
            first = np.concatenate(([0], np.cumsum(take)))
            picked = np.repeat(at[:-1] - first[:-1], take) + np.arange(first[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(_sum(X.mix(h), at)), pa.array(_sum(X.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)), X.lists(X.signed(h[picked]), first, pa.int64()), pa.array(_ell(-(-percent * n // 100)))], names=["doc_id", "n", "s1", "s2", "prefix", "need"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, s1 bigint, s2 bigint, prefix array<bigint>, need bigint")


def _full_sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            h, at = _sets(*X.words(data, offs, X.SPACED), width)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), X.lists(X.signed(h), at, pa.int64())], names=["rep", "n", "set"])

    return docs.mapInArrow(run, "rep bigint, n bigint, set array<bigint>")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(u, v)`` that reach the similarity; ``sets(rep, n, hs)`` lacks only shingles that no other document has."""
    left, right = sets.select(F.col("rep").alias("u"), F.col("n").alias("n1"), F.col("hs").alias("h1")), sets.select(F.col("rep").alias("v"), F.col("n").alias("n2"), F.col("hs").alias("h2"))
    both = F.size(F.array_intersect("h1", "h2"))
    return pairs.join(left, "u").join(right, "v").where(100 * both >= percent * (F.col("n1") + F.col("n2") - both)).select("u", "v")


def jaccard_components(docs: DataFrame, work: Workspace, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_shingles, component_id, one row per input row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_docs = work.save(_signatures(docs, width, percent), "signatures")
    classes = all_docs.where("n > 0 AND doc_id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("need").alias("need"))
    tokens = classes.select("rep", F.col("need").cast("int").alias("need"), F.explode("prefix").alias("tok"))
    seen = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("tok")
    maybe = work.save(tokens.join(seen, "tok", "left_semi").groupBy("rep").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need")).where("met >= need").select("rep"), "candidates")
    n_maybe = maybe.count()
    # full sets of the candidates, in frequency order
    chosen = docs.join(maybe_broadcast(maybe, n_maybe, 24), docs["doc_id"] == maybe["rep"], "left_semi")
    full = work.save(_full_sets(chosen, width).groupBy("rep", "set").agg(F.max("n").alias("n")), "sets")
    occurs = full.select("rep", F.explode("set").alias("h"))
    df = occurs.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = occurs.join(df, "h").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))
    sizes = full.groupBy("rep").agg(F.max("n").alias("n"))
    index = work.save(
        shared.join(sizes, "rep").select("rep", "n", (F.col("n") - F.size("s")).alias("alone"), F.transform("s", lambda x: x["h"]).alias("hs"))
        .withColumn("most", F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1), "index")
    sets = index.select("rep", "n", "hs")
    prefix = F.expr("slice(hs, 1, cast(most - alone as int))")
    live = index.where("most > alone").select("rep", "n", "alone", prefix.alias("prefix"), F.coalesce(F.when(F.col("alone") > 0, F.col("rep")), F.lit(NO_KEY)).alias("gkey"))
    live = live.withColumns({"p1": F.xxhash64("prefix"), "p2": F.xxhash64(F.lit(1), "prefix")})
    same_key = ["n", "gkey", "p1", "p2"]
    groups = work.save(live.groupBy(*same_key).agg(F.min("rep").alias("gid"), F.min("alone").alias("alone"), F.first("prefix").alias("prefix"), F.count(F.lit(1)).alias("size")), "groups")
    # membership is a table of its own: a group of any size is rows, never one row
    several = groups.where("size > 1").select(*same_key, "gid")
    in_many = live.select("rep", *same_key).join(several, same_key).select("gid", "rep")
    member = work.save(in_many.unionByName(groups.where("size = 1").select("gid", F.col("gid").alias("rep"))), "members")
    # pivots: a linear number of pairs
    posting = groups.select("gid", "n", "alone", F.posexplode("prefix").alias("pos", "tok"))
    scale = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    cells = posting.select("gid", "n", "alone", "tok", F.explode(F.array(scale, scale + 1)).alias("cell"))
    pivot = cells.groupBy("tok", "cell").agg(F.min_by("gid", F.struct("alone", "gid")).alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    star = cells.join(pivot, ["tok", "cell"]).where("gid <> pivot").select(F.col("gid").alias("u"), F.col("pivot").alias("v")).distinct()
    inside = member.where("rep <> gid").select(F.col("rep").alias("u"), F.col("gid").alias("v"))
    first_links = work.save(_verify(star.union(inside), sets, percent), "links1")
    part = connected_components(first_links, work, "cc1")
    comp = lambda col: F.coalesce(col, F.col("rep"))
    known = work.save(live.select("rep").join(part.withColumnRenamed("node", "rep"), "rep", "left").select("rep", comp(F.col("component")).alias("component")), "parts1")
    # what the pivots left open, group against group
    spread = member.join(known, "rep").groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_ = work.save(posting.join(spread, "gid"), "postings")
    lone = open_.groupBy("tok").agg(F.min("lo").alias("tlo"), F.max("hi").alias("thi")).where("tlo < thi").select("tok")
    open_ = open_.join(lone, "tok", "left_semi").join(groups.select("gid", "prefix"), "gid")
    # a pair meets once, at the first shingle that both prefixes hold
    once = F.element_at(F.array_intersect("a.prefix", "b.prefix"), 1) == F.col("a.tok")
    a, b = open_.alias("a"), open_.alias("b")
    need = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    room = lambda x: F.col(f"{x}.n") - F.col(f"{x}.alone") - F.col(f"{x}.pos")  # noqa: E731  shared shingles from here on
    pairs = (
        a.join(b, (F.col("a.tok") == F.col("b.tok")) & (F.col("a.gid") < F.col("b.gid"))
               & (100 * F.col("a.n") >= percent * F.col("b.n")) & (100 * F.col("b.n") >= percent * F.col("a.n"))
               & ~((F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo"))) & once)
        .where(F.least(F.col("a.n") - F.col("a.alone"), F.col("b.n") - F.col("b.alone")) >= need)
        .select(F.col("a.gid").alias("g1"), F.col("b.gid").alias("g2"), (F.least(room("a"), room("b")) + F.least("a.pos", "b.pos")).alias("most"), need.alias("need"))
        .where("most >= need").select("g1", "g2").distinct()
    )
    same = spread.where("lo < hi").select(F.col("gid").alias("g1"), F.col("gid").alias("g2"))
    grown = member.join(known, "rep")
    one, two = grown.select(F.col("gid").alias("g1"), F.col("rep").alias("u"), F.col("component").alias("c1")), grown.select(F.col("gid").alias("g2"), F.col("rep").alias("v"), F.col("component").alias("c2"))
    expanded = pairs.union(same).join(one, "g1").join(two, "g2").where("c1 <> c2").where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    second_links = work.save(_verify(expanded, sets, percent), "links2")
    final = connected_components(first_links.union(second_links), work, "cc2")
    work.keep_only("signatures", "cc2")
    named = classes.select("n", "s1", "s2", "rep").join(final, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    return all_docs.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op6_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Workspace(spark, "jaccard"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') || CASE WHEN len(w) < 4 THEN ' |' || len(w) ELSE '' END AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u AS doc_id, min(v) AS c FROM r GROUP BY u) m USING (doc_id)
"""
