"""Benchmark decontamination by winnowing.

Of every window of consecutive k-gram hashes the smallest (rightmost on ties) is kept as a fingerprint, so any span of
``span`` words that a document shares with a benchmark item holds a common fingerprint.  Fingerprints are joined;
each hit is extended over its diagonal, word by word, and every shared run of at least ``span`` words counts.
An item shorter than ``span`` is one window: its only fingerprint is the hash of all its words, and documents keep, beside
their winnowed ones, every gram of that length (the lengths, below ``span``, are looked up once).

Benchmark fingerprints are broadcast while their counted size is within the bound, so documents are not
shuffled; beyond it both sides shuffle by fingerprint.  Only hit lists reach the documents' second pass.  Words
are compared by 64-bit hashes.

Edge cases: null or empty texts have no words and are clean; benchmark items without words or without id match nothing;
repeated document rows, ids included, each get their own row; repeated items count once per id; an empty benchmark
leaves all clean; an empty document table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.workspace import Workspace, maybe_broadcast

SPAN, GRAM = 10, 5
_FP = "doc_id bigint, tkey bigint, pos int, fp bigint"


def _fingerprints(rows: DataFrame, span: int, gram: int, short: list[int]) -> DataFrame:
    """``rows(id, tkey, text)`` -> (doc_id, tkey, pos, fp): winnowed k-grams, and every gram of the lengths in ``short``."""

    def emit(batches):
        for part, data, offs in X.chunks(batches, "text"):
            hashes, first = X.words(data, offs, X.ALNUM)
            found = []
            h, at = X.grams(hashes, first, gram)
            full = np.diff(first) >= span  # shorter texts share no full window
            keep = X.winnow(h, at, span - gram + 1)
            doc = np.searchsorted(at, keep, "right") - 1
            keep, doc = keep[full[doc]], doc[full[doc]]
            found.append((doc, keep - at[doc], h[keep]))
            for m in short:
                h, at = X.grams(hashes, first, m)
                doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
                found.append((doc, np.arange(len(h)) - at[doc], X.mix(h + np.uint64(m))))
            doc, pos, fp = (np.concatenate(x) for x in zip(*found, strict=True))
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(X.signed(fp.astype(np.uint64)))], names=["doc_id", "tkey", "pos", "fp"])

    return rows.mapInArrow(emit, _FP)


def _item_words(items: DataFrame, span: int, gram: int) -> DataFrame:
    """(item_id, tkey, words, fps array<struct<pos, fp>>) of every item with words."""

    def emit(batches):
        for part, data, offs in X.chunks(batches, "text"):
            hashes, first = X.words(data, offs, X.ALNUM)
            rows = []
            for t, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
                n = int(hi - lo)
                if not n:
                    continue
                if n < span:
                    fps = [(0, int(X.signed(X.mix(np.array([X.whole(hashes, lo, hi)]) + np.uint64(n)))[0]))]
                else:
                    h, at = X.grams(hashes[lo:hi], np.array([0, n]), gram)
                    fps = [(int(p), int(X.signed(h[p : p + 1])[0])) for p in X.winnow(h, at, span - gram + 1)]
                rows.append({"item_id": part.column(0)[t].as_py(), "tkey": part.column(1)[t].as_py(), "words": X.signed(hashes[lo:hi]).tolist(), "fps": [{"pos": p, "fp": f} for p, f in fps]})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.string()), ("tkey", pa.int64()), ("words", pa.list_(pa.int64())), ("fps", pa.list_(pa.struct([("pos", pa.int32()), ("fp", pa.int64())])))]))

    return items.mapInArrow(emit, "item_id string, tkey bigint, words array<bigint>, fps array<struct<pos:int,fp:bigint>>")


def _extend(words: np.ndarray, hits: list[dict], span: int) -> tuple[np.ndarray, set]:
    """Mark the document words in shared runs on the hit diagonals; the ids of the items that occur."""
    mark, occurs = np.zeros(len(words) + 1, np.int64), set()
    for hit in hits:
        item = np.array(hit["words"], np.int64)
        need = min(span, len(item))
        for diag in set(hit["diagonals"]):
            lo, hi = max(0, -diag), min(len(item), len(words) - diag)
            if hi - lo < need:
                continue
            same = np.concatenate(([False], words[diag + lo : diag + hi] == item[lo:hi], [False]))
            turn = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(turn[::2], turn[1::2], strict=True):
                if b - a >= need:
                    mark[diag + lo + a] += 1
                    mark[diag + lo + b] -= 1
                    occurs.add(hit["item_id"])
    return np.cumsum(mark)[:-1] > 0, occurs


def decontaminate(docs: DataFrame, benchmark: DataFrame, work: Workspace, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs(doc_id, text)`` against ``benchmark(item_id, text)`` -> doc_id, tkey (hash of the text), n_words, n_hit,
    n_items, items_sha256, contaminated and spans (the hit runs, ``first:end`` by word)."""
    tkey = F.xxhash64(F.coalesce("text", F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tkey.alias("tkey"), "text")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), tkey.alias("tkey"), "text").distinct()
    known = work.save(_item_words(items, span, gram), "items")
    short = [r[0] for r in known.where(F.size("words") < span).select(F.size("words")).distinct().collect()]
    known = known.withColumnRenamed("tkey", "ikey")
    item_fp = known.select("item_id", "ikey", F.explode("fps").alias("f")).select("item_id", "ikey", F.col("f.pos").alias("ipos"), F.col("f.fp").alias("fp"))
    size = known.agg(F.coalesce(F.sum(F.size("fps")), F.lit(0)), F.coalesce(F.sum(F.size("words") + 8), F.lit(0))).first()
    hits = (
        _fingerprints(docs, span, gram, sorted(short)).join(maybe_broadcast(item_fp, size[0], 60), "fp")
        .groupBy("doc_id", "tkey", "item_id", "ikey").agg(F.collect_set(F.col("pos") - F.col("ipos")).alias("diagonals"))
        .join(maybe_broadcast(known.select("item_id", "ikey", "words"), size[1], 8), ["item_id", "ikey"])
        .groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("item_id", "words", "diagonals")).alias("hits"))
    )
    hits = work.save(hits, "hits")
    work.keep_only("hits")
    weight = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.aggregate("hits", F.lit(0), lambda a, x: a + F.size(x["words"]) + F.size(x["diagonals"]))), F.lit(0))).first()
    joined = docs.join(maybe_broadcast(hits, weight[0] * 8 + weight[1], 8), docs["doc_id"].eqNullSafe(hits["doc_id"]) & (docs["tkey"] == hits["tkey"]), "left").select(docs["doc_id"], docs["tkey"], "text", "hits")

    def judge(batches):
        none = hashlib.sha256(b"").hexdigest()
        for part, data, offs in X.chunks(batches, "text"):
            hashes, first = X.words(data, offs, X.ALNUM)
            hashes = X.signed(hashes)
            rows: dict[str, list] = {k: [] for k in ("n_hit", "n_items", "items_sha256", "spans")}
            for t, hit in enumerate(part.column(3).to_pylist()):
                if not hit:
                    made = (0, 0, none, "")
                else:
                    mark, occurs = _extend(hashes[first[t] : first[t + 1]], hit, span)
                    turn = np.flatnonzero(np.diff(np.concatenate(([False], mark, [False])).astype(np.int8)))
                    made = (int(mark.sum()), len(occurs), hashlib.sha256(",".join(sorted(occurs)).encode()).hexdigest(), ",".join(f"{a}:{b}" for a, b in zip(turn[::2], turn[1::2], strict=True)))
                for k, v in zip(rows, made, strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), pa.array(rows["n_hit"], pa.int64()), pa.array(rows["n_items"], pa.int64()), pa.array(rows["items_sha256"], pa.string()), pa.array(rows["spans"], pa.string())], names=["doc_id", "tkey", "n_words", "n_hit", "n_items", "items_sha256", "spans"])

    return joined.mapInArrow(judge, "doc_id bigint, tkey bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, spans string").withColumn("contaminated", F.col("n_hit") > 0)


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, bench, Workspace(spark, "winnow")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS g
       FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hit AS (SELECT rid, i, m, item_id FROM dw JOIN bw USING (m, g)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hit)) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""
