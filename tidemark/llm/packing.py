"""Mixture-controlled packing by deficit round-robin, in closed form.

Every source is a queue of its documents' tokens, cut into packets of ``packet`` tokens.  A round serves one window
of ``window`` tokens: queue s earns a quantum of ``window * weight(s)`` tokens and sends as many whole packets as its
deficit allows; what is left is carried to the next round, so over any number of rounds a queue is within one packet of its
target share.  Queues that run dry drop out.  The sent packets, round by round, fill sequences of
``length`` tokens without gaps; only the last sequence is padded.

After r rounds queue s has sent ``packet * floor(r * quantum / packet)`` tokens.  That closed form gives every token of every
document its place from (its queue, its place in the queue), so packing needs no ordering pass: each task computes
places for its own rows.  A place in a queue is a running count inside a task plus the exact counts of earlier tasks, which
carries the deficits over partitions.  Texts are tokenized once; the ids are written to the shared folder.

Ids: texts of common characters go through a faster reader of the same vocabulary, which gives the same ids (tested);
any other text, and any with the end-of-text mark, goes through the ``tokenizers`` file itself.

Edge cases: null and empty texts are the single id 0; a null source is a queue of its own; more than ``max_queues``
sources share that many queues by hash; repeated rows, ids included, are packed each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace, maybe_broadcast

#: Anything else than these characters, or the mark, is read by the tokenizer file itself.
_RARE = re.compile("[^\t\n\r -~¡-¬®-ɏΑ-ΡΣ-ωА-я一-龥ぁ-ゖァ-ヺ가-힣–—‘-”…€]|<\\|endoftext\\|>")
SPECIAL_END = 0


@cache
def _encoders(vocabulary: str, ranks: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
    with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return exact, fast


def encode(text: str, vocabulary: str = "", ranks: str = "") -> list[int]:
    exact, fast = _encoders(vocabulary, ranks)
    if _RARE.search(text):
        return exact.encode(text, add_special_tokens=False).ids
    return fast.encode_ordinary(text)


def tokenize(docs: DataFrame, vocabulary: str = "", ranks: str = "") -> DataFrame:
    """``docs(doc_id, queue, text)`` -> doc_id, queue, part, begin (tokens of the queue before it in this task), n, ids (uint16)."""

    def run(batches):
        part, sent = TaskContext.get().partitionId(), {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500)
                ids, begin, n = [], [], []
                for queue, text in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
                    made = np.array([*encode(text or "", vocabulary, ranks), SPECIAL_END], "<u2")
                    ids.append(made.tobytes())
                    n.append(len(made))
                    begin.append(sent.get(queue, 0))
                    sent[queue] = begin[-1] + len(made)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([part] * rows.num_rows, pa.int32()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "begin", "n", "ids"])

    return docs.mapInArrow(run, "doc_id bigint, queue string, part int, begin bigint, n bigint, ids binary")


class RoundRobin:
    """Where the tokens of each queue go."""

    def __init__(self, totals: list[int], weights: list[float], window: int, packet: int):
        self.total = np.array(totals, np.int64)
        self.packet = packet
        share = np.array(weights, float) / sum(weights)
        self.rate = window * share / packet  # packets a round
        self.last = np.ceil(self.total / (window * share)).astype(np.int64)  # the round that ends each queue

    def sent(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens each queue has sent after these rounds: rounds x queues."""
        whole = self.packet * np.floor(rounds[:, None] * self.rate[None, :]).astype(np.int64)
        return np.where(rounds[:, None] >= self.last[None, :], self.total[None, :], np.minimum(whole, self.total[None, :]))

    def rounds(self, queue: np.ndarray, packets: np.ndarray) -> np.ndarray:
        """The round in which each packet is sent: the first after which its queue has sent it whole, or its last."""
        rate = self.rate[queue]
        r = np.ceil((packets + 1) / rate).astype(np.int64)
        r -= np.floor((r - 1) * rate) >= packets + 1
        r += np.floor(r * rate) < packets + 1
        return np.minimum(np.maximum(r, 1), self.last[queue])

    def place(self, queue: np.ndarray, packets: np.ndarray) -> np.ndarray:
        """Global place of the first token of each packet."""
        r = self.rounds(queue, packets)
        out = np.empty(len(r), np.int64)
        for lo in range(0, len(r), 4096):
            q, k = queue[lo : lo + 4096], packets[lo : lo + 4096]
            some, back = np.unique(r[lo : lo + 4096], return_inverse=True)
            before, after = self.sent(some - 1), self.sent(some)
            ahead = np.concatenate((np.zeros((len(some), 1), np.int64), np.cumsum(after - before, axis=1)[:, :-1]), axis=1)
            out[lo : lo + 4096] = before.sum(axis=1)[back] + ahead[back, q] + k * self.packet - before[back, q]
        return out


def pack(docs: DataFrame, work: Workspace, length: int = 1024, window: int = 1024, packet: int = 128, weights: dict[str, float] | None = None, max_queues: int = 1024, vocabulary: str = "", ranks: str = "") -> DataFrame:
    """``docs(doc_id, source, text)`` -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``weights`` are target token shares by source; by default each source's own share of all tokens, so that every window
    has the mixture of the corpus and all queues end together.  ``packet`` must divide ``length``.

    With more than ``max_queues`` sources, those that ``weights`` does not name share queues by hash; a named one always has its own,
    and more names than queues are refused.  (Every token is still placed; shares then hold per queue.)"""
    if length % packet:
        raise ValueError("packet must divide length")
    source = F.coalesce("source", F.lit("\x00"))
    n_sources = docs.select(source.alias("s")).distinct().count()
    named = sorted(weights or {})
    if len(named) >= max_queues:
        raise ValueError("weights names more sources than there can be queues")
    shared = F.concat(F.lit("\x00#"), F.pmod(F.xxhash64(source), F.lit(max_queues - len(named))).cast("string"))
    queue = source if n_sources <= max_queues else F.when(source.isin(*named), source).otherwise(shared) if named else shared
    tokens = work.save(tokenize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text"), vocabulary, ranks), "tokens")
    per = work.save(tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens")), "per_task")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = work.save(per.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")), "base")
    totals = {r["queue"]: int(r["t"]) for r in per.groupBy("queue").agg(F.sum("tokens").alias("t")).orderBy("queue").collect()}
    names = list(totals)
    wanted = [float((weights or {}).get(q, 0) or totals[q] / sum(totals.values())) for q in names]
    plan = RoundRobin([totals[q] for q in names], wanted, window, packet) if names else None
    number = {q: i for i, q in enumerate(names)}
    placed = tokens.join(maybe_broadcast(base, base.count(), 80), ["queue", "part"]).select("doc_id", "queue", (F.col("base") + F.col("begin")).alias("at"), "n", "ids")

    work.keep_only("tokens", "base")

    def cut(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.slice(lo, 500)
                at, n = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                q = np.array([number[x] for x in rows.column(1).to_pylist()])
                first = at // packet
                count = (at + n - 1) // packet - first + 1
                doc = np.repeat(np.arange(len(n)), count)
                k = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(doc))
                begin = np.maximum(at[doc], k * packet)
                end = np.minimum(at[doc] + n[doc], (k + 1) * packet)
                place = plan.place(q[doc], k) + begin - k * packet
                room = length - place % length  # a piece that crosses the end of a sequence is cut in two
                split = end - begin > room
                doc2 = np.concatenate((doc, doc[split]))
                begin2 = np.concatenate((begin, (begin + room)[split]))
                end2 = np.concatenate((np.where(split, begin + room, end), end[split]))
                place2 = np.concatenate((place, (place + room)[split]))
                order = np.lexsort((begin2, doc2))
                doc2, begin2, end2, place2 = doc2[order], begin2[order], end2[order], place2[order]
                start = begin2 - at[doc2]
                ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in rows.column(4).to_pylist()]
                crc = [zlib.crc32(memoryview(ids[d])[4 * s : 4 * e]) for d, s, e in zip(doc2.tolist(), start.tolist(), (start + end2 - begin2).tolist(), strict=True)]
                take = pa.array(doc2)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(take), pa.array(start), pa.array(end2 - begin2), pa.array(crc, pa.int64()), pa.array(n[doc2]), pa.array(place2 // length), pa.array(place2 % length), rows.column(1).take(take)], names="doc_id start length ids_crc32 doc_tokens sequence_id offset queue".split())

    return placed.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string")


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return pack(docs, Workspace(spark, "packing"))
