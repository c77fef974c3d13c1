"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Rows are dealt into blocks of at most BLOCK rows as they are scanned.  A block sorts the distinct fingerprints of its
   normalised texts, cuts the sorted list at the owners' bounds and sends every owner its stretch as Golomb-coded gaps (the
   parameter is a power of two).  Fingerprints are as long as the number of rows asks for, so a code has some ten bits.
2. An owner decodes its stretches, looks for values that came from two blocks and answers every block with a bit per value.
   A value travels once per block whatever its number of copies there, so a text that a third of all rows share is no skew.
3. Rows whose bit is set, or whose value occurs twice in their own block, are suspects.  Only texts that can be suspects
   are shuffled: they are grouped by fingerprint and by all their bytes, copies being combined before the shuffle.
4. Every group of two or more rows names the row that stays and its size; suspects learn it over the SHA-256 of their
   text.  Groups that hold 1/HOT of all rows or more, at most HOT of them, are broadcast; the others are too small to skew.

A fingerprint alone never decides: a suspect whose bytes nobody shares is a group of one.

Edge cases: a null text equals the empty text; only A-Z are lower-cased; among equal texts null ids sort lowest, and of
rows that agree in text and largest id exactly one stays; an empty table gives an empty result; columns other than
doc_id and text are ignored, whatever their names; two texts with one SHA-256 would be an error, not a wrong group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.workspace import BROADCAST_BYTES, Workspace, documents, flagged

#: Rows of one block; its fingerprints are sorted in memory.
BLOCK = 1 << 16
#: A fingerprint has this many bits more than the number of rows, so about one row in 2**SPARE is a suspect for nothing.
SPARE = 8
#: Groups with at least 1/HOT of all rows are broadcast.
HOT = 4096

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), A_TO_Z, A_TO_Z.lower())


def golomb_encode(values: np.ndarray, low: int) -> tuple[int, bytes, bytes]:
    """Sorted distinct uint64 values from ``low`` on -> exponent of the parameter, unary quotients, remainders."""
    gaps = np.diff(values, prepend=np.uint64(low))
    mean = int(gaps.sum()) // len(gaps)
    k = max(0, (mean * 7 // 10).bit_length() - 1)
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest.ravel()).tobytes()


def golomb_decode(n: int, low: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * k).reshape(n, k).astype(np.uint64)
        gaps += (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.uint64(low)


_SENT = "block bigint, owner int, place int, alone boolean, row bigint, doc_id bigint, fp bigint, sha binary, n int, k int, unary binary, rest binary"
_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _blocks(batches):
    """Row groups of at most BLOCK rows of (part, doc_id, fp, sha), each with its number."""
    held, size, number = [], 0, 0
    for batch in batches:
        while batch.num_rows:
            take = batch.slice(0, BLOCK - size)
            held.append(take)
            size += take.num_rows
            batch = batch.slice(take.num_rows)
            if size == BLOCK:
                yield number, pa.Table.from_batches(held).combine_chunks()
                held, size, number = [], 0, number + 1
    if size:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _send(bits: int, owner_bits: int):
    """One record per row and one per coded stretch, told apart by ``unary``."""

    def run(batches):
        names = [f.split()[0] for f in _SENT.split(", ")]
        for number, rows in _blocks(batches):
            fp = rows["fp"].to_numpy()
            block = int(rows["part"][0].as_py()) << 20 | number
            values, at, copies = np.unique(fp.view(np.uint64) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
            owner = (values >> np.uint64(bits - owner_bits)).astype(np.int64)
            first = np.searchsorted(owner, owner)
            n = len(fp)
            made = [np.full(n, block), owner[at].astype(np.int32), (at - first[at]).astype(np.int32), copies[at] == 1, block << 16 | np.arange(n), rows["doc_id"].combine_chunks(), fp, rows["sha"].combine_chunks()]
            made = [m if isinstance(m, pa.Array) else pa.array(m) for m in made]
            yield pa.RecordBatch.from_arrays(made + [pa.nulls(n, t) for t in _TYPES[8:]], names=names)
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            coded = [golomb_encode(values[i:j], int(owner[i]) << (bits - owner_bits)) for i, j in zip(starts, np.append(starts[1:], len(values)), strict=True)]
            sent = [np.full(len(starts), block), owner[starts].astype(np.int32)]
            tail = [pa.array(np.diff(starts, append=len(values)).astype(np.int32)), pa.array([c[0] for c in coded], pa.int32()), pa.array([c[1] for c in coded], pa.binary()), pa.array([c[2] for c in coded], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(m) for m in sent] + [pa.nulls(len(starts), t) for t in _TYPES[2:8]] + tail, names=names)

    return run


def _answer(bits: int, owner_bits: int):
    """The stretches that one owner has received -> a bit per value for each block that sent one found elsewhere too."""

    def run(table: pa.Table) -> pa.Table:
        low = int(table["owner"][0].as_py()) << (bits - owner_bits)
        sizes = table["n"].to_numpy()
        parts = [golomb_decode(*x) for x in zip(sizes.tolist(), [low] * len(sizes), *(table[c].to_pylist() for c in ("k", "unary", "rest")), strict=True)]
        values = np.concatenate(parts)
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        first = np.concatenate(([0], np.cumsum(sizes)))
        blocks, maps = [], []
        for i, block in enumerate(table["block"].to_pylist()):
            mine = twice[first[i] : first[i + 1]]
            if mine.any():
                padded = np.zeros(-(-len(mine) // 64) * 64, np.uint8)
                padded[: len(mine)] = mine
                blocks.append(block)
                maps.append(np.packbits(padded, bitorder="little").view("<i8").tolist())
        return pa.table({"block": pa.array(blocks, pa.int64()), "owner": pa.array([table["owner"][0].as_py()] * len(blocks), pa.int32()), "bits": pa.array(maps, pa.list_(pa.int64()))})

    return run


def exact_duplicates(docs: DataFrame, work: Workspace, bits: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, keep_id, group_size, kept, text_sha256, one row per input row.

    ``bits`` is the length of an exchanged fingerprint; left out, it follows from the number of rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"))
    docs = docs.withColumn("fp", F.xxhash64("norm"))
    total = docs.count()
    bits = bits or min(64, total.bit_length() + SPARE)
    owner_bits = min(bits, 12, max(6, (total >> 20).bit_length()))
    narrow = docs.select(F.spark_partition_id().alias("part"), "doc_id", "fp", F.unhex(F.sha2("norm", 256)).alias("sha"))
    sent = work.save(narrow.mapInArrow(_send(bits, owner_bits), _SENT), "sent")
    stretches = sent.where("unary IS NOT NULL").select("block", "owner", "n", "k", "unary", "rest")
    answers = work.save(stretches.groupBy("owner").applyInArrow(_answer(bits, owner_bits), "block bigint, owner int, bits array<bigint>"), "answers")
    held = answers.agg(F.sum(F.size("bits") * 8 + 64)).first()[0] or 0
    rows = sent.where("unary IS NULL").select("row", "doc_id", "fp", "sha", "block", "owner", "place", "alone")
    told = rows.join(F.broadcast(answers) if held <= BROADCAST_BYTES else answers, ["block", "owner"], "left")
    bit = F.expr("coalesce(getbit(element_at(bits, cast(place div 64 + 1 as int)), place % 64), 0) = 1")
    judged = work.save(told.select("row", "doc_id", "fp", "sha", (~F.col("alone") | bit).alias("suspect")), "judged")
    work.drop("sent")
    suspects = judged.where("suspect")
    # bytes decide: the texts of suspects, copies combined before they are shuffled
    asked = work.save(suspects.select("fp").distinct(), "asked")
    texts = flagged(docs, asked, "fp").where("maybe").groupBy("fp", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = texts.where("group_size > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    stays = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row")).alias("best")).select("sha", F.col("best.row").alias("stays"))
    groups = work.save(groups.join(stays, "sha"), "groups")
    if groups.groupBy("sha").count().where("count > 1").head(1):
        raise ValueError("two texts share a SHA-256")
    large = F.col("group_size") * HOT >= total
    first = suspects.join(F.broadcast(groups.where(large)), "sha", "left")
    rest = first.where("group_size IS NULL").select("row", "doc_id", "sha").join(groups.where(~large), "sha", "left")
    columns = ["row", "doc_id", "sha", "keep_id", "group_size", "stays"]
    found = first.where("group_size IS NOT NULL").select(*columns).unionByName(rest.select(*columns))
    one = F.col("group_size").isNull()
    found = found.select(
        "doc_id", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("stays"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    lone = judged.where("NOT suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    return lone.unionByName(found)


def op13_golomb_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir, "doc_id", "text"), Workspace(spark, "exact"))


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""
