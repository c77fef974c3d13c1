"""Trie, filter audit and exact duplicates against brute force, with nulls, ties, repeated rows, long texts and hot groups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import audit, exact, trie
from tidemark.llm.workspace import Workspace

ASCII = str.maketrans(exact.A_TO_Z, exact.A_TO_Z.lower())


# exact duplicates


@pytest.mark.parametrize("bits", [9, 20, 63, 64])
def test_golomb_round_trip(bits):
    rng = np.random.default_rng(bits)
    for low in (0, 1 << (bits - 2)):
        for n in (1, 2, 30, 4000):
            v = np.unique(rng.integers(low, 1 << bits, n, dtype=np.uint64))
            assert (exact.golomb_decode(len(v), low, *exact.golomb_encode(v, low)) == v).all()
    v = np.arange(500, dtype=np.uint64)
    assert (exact.golomb_decode(500, 0, *exact.golomb_encode(v, 0)) == v).all()
    sparse = np.unique(rng.integers(0, 1 << bits, 1000, dtype=np.uint64))
    k, unary, rest = exact.golomb_encode(sparse, 0)
    assert 8 * (len(unary) + len(rest)) <= len(sparse) * (bits - np.log2(len(sparse)) + 3) + 16


def _copies(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[(t or "").translate(ASCII)].append((d is not None, d or 0, i))
    out = []
    for text, members in groups.items():
        best = max(members)
        for m in members:
            out.append((rows[m[2]][0], rows[best[2]][0], len(members), m == best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(repr, out))


def _check_copies(spark, rows, parts=5, bits=None, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema).repartition(parts)
    got = exact.exact_duplicates(df, Workspace(spark, "t"), bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == _copies([r[:2] for r in rows])


def test_exact_edges(spark):
    long = "Wort " * 400_000
    rows = [(1, "A b"), (2, "a B"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (None, ""), (None, "x"), (None, "X"), (7, "É"), (8, "é"), (9, long), (10, long.upper()), (11, long + "."), (12, " a b"), (-5, "minus"), (-9, "MINUS")]
    _check_copies(spark, rows)
    _check_copies(spark, [])
    clash = [(d, t, "f", "s", 1, True) for d, t in rows]
    _check_copies(spark, clash, schema="doc_id long, text string, fp string, sha string, row int, suspect boolean")


@pytest.mark.parametrize("bits", [8, None])
def test_exact_hot_group_and_false_suspects(spark, bits):
    """A third of all rows is one text; with 8 bits nearly every row is a suspect, and bytes still decide."""
    rng = random.Random(3)
    rows = [(i, "Hot text" if i % 3 == 0 else f"text {rng.randrange(1500)}" if i % 3 == 1 else f"only {i}") for i in range(6000)]
    _check_copies(spark, rows, parts=9, bits=bits)


def test_exact_blocks_are_cut(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK", 64)
    import pyarrow as pa

    batch = pa.record_batch({"x": list(range(300))})
    blocks = list(exact._blocks([batch, batch]))
    assert [t.num_rows for _, t in blocks] == [64] * 9 + [24] and [n for n, _ in blocks] == list(range(10))


# filter audit


def _fails(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text)}


def _audit(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    parts = defaultdict(list)
    for d, t, p in docs:
        failed = _fails(t or "") | {"E": d is not None and d > least[t or ""]}
        parts[p or ""].append((d, {f for f, x in failed.items() if x}))
    out = []
    for p, members in parts.items():
        rows, share = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [d for d, x in members if f in x and not x & before]
                share[f] += len(removed)
                rows.append((f, p, order, step, sum(not x & (before | {f}) for _, x in members), len(removed), sum(f in x and bool(x & before) for _, x in members),
                             sum(x == {f} for _, x in members), sum(d in good for d in removed), sum(d in toxic for d in removed)))
        out += [(*r[1:], share[r[0]]) for r in rows]
    return sorted(map(repr, out))


def _check_audit(spark, docs, labels, schema="doc_id long, text string, part string"):
    got = audit.filter_audit(
        spark.createDataFrame(docs, schema).repartition(6), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), audit.standard_filters(), "E", Workspace(spark, "t"))
    want = _audit([d[:3] for d in docs], labels)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == want
    return want


def test_audit_edges(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Big", "ALL", "#", "a&b", "　", "\x0b"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 10, 49, 50, 70])))
    pool = [text() for _ in range(30)] + ["", None, "W " * 300_000]
    docs = [(rng.choice([None, *range(200)]), rng.choice(pool), rng.choice(["a", "b", "", None])) for _ in range(300)]
    labels = [(rng.choice([None, *range(200)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)]
    assert _check_audit(spark, docs, labels)
    assert _check_audit(spark, docs, [])
    assert not _check_audit(spark, [], labels)
    clash = [(*d, 1, "x", True) for d in docs]
    _check_audit(spark, clash, labels, "doc_id long, text string, part string, fp int, place string, again boolean")


def test_audit_hot_text_over_many_partitions(spark):
    """Half of the rows are one text, so its group covers several range partitions and all but one begin inside it."""
    docs = [(i * 7919 % 4001, "the same text" if i % 2 else f"another {i % 5} {i % 600}", "p" if i % 3 else "q") for i in range(4000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(docs, "doc_id long, text string, part string")
        placed = rows.withColumn("fp", F.xxhash64("text")).repartitionByRange("fp", "doc_id").where("text = 'the same text'").select(F.spark_partition_id()).distinct().count()
        assert placed > 1
        _check_audit(spark, docs, [(i, i % 2, i % 3) for i in range(0, 4000, 5)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_audit_colliding_fingerprints(spark, monkeypatch):
    """All texts have one fingerprint: bytes tell them apart, at the ends of partitions too."""
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    _check_audit(spark, [(i, f"text {i % 4}", "p") for i in range(500)], [])


# trie


def _trie(convs):
    """{conv: [(role, text), ..]} -> nodes."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(ends[p]))) for p, m in members.items())


def _rebuilt(turns):
    own = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [x[3] for x in sorted(rows)] for c, rows in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def _nodes(spark, turns, local, schema="conv_id long, turn long, role string, text string"):
    work = Workspace(spark, "t")
    convs = trie.shared_openings(trie.dictionary_encode(spark.createDataFrame(turns, schema).repartition(5), work), work)
    nodes = trie.prefix_trie(convs, work, local)
    digests = trie.list_digests(convs.select(F.xxhash64("turns").alias("x"), F.xxhash64(F.lit(1), "turns").alias("y"), "conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(digests, "end_id", "left").select(*[c for c in nodes.columns if c != "end_id"], F.coalesce("ends_sha256", F.lit(none)))
    return sorted(repr(tuple(r)) for r in full.collect())


def _conversations(rng, n):
    rows = []
    for c in range(n):
        c = c * 3 - 200 if rng.random() < 0.3 else c
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["same", "a", "bb", "", None, "é" * 5])))
    return rows


@pytest.mark.parametrize("local", [3, 200_000])
def test_trie_against_brute_force(spark, local):
    """With few turns a task, buckets are dealt in many rounds; the nodes are the same."""
    rng = random.Random(11)
    turns = _conversations(rng, 200)
    turns += [(5000 + c, t, "user", "deep") for c in range(60) for t in range(40)]  # equal, and long
    turns += [(6000 + c, t, "user", "deep" if t < 30 else f"{c % 7} {t}") for c in range(60) for t in range(33)]  # part late
    turns += turns[:50] + [(None, 1, "user", "nobody's")]
    assert _nodes(spark, turns, local) == _trie(_rebuilt(turns))


def test_trie_edges(spark):
    assert _nodes(spark, [], 10) == []
    one = [(7, None, None, None)]
    assert _nodes(spark, one, 10) == _trie(_rebuilt(one))
    turnless = [(c, 0, "user", "x") for c in range(101, 160)]  # no base conversation, one turn of their own
    assert _nodes(spark, turnless, 1) == _trie(_rebuilt(turnless))
    clash = [(c, t, "user", "ab" * c, 1, "k") for c in range(5) for t in range(3)]
    assert _nodes(spark, clash, 10, "conv_id long, turn long, role string, text string, code int, key string") == _trie(_rebuilt([r[:4] for r in clash]))
    long = [(1, 0, "user", "x" * 3_000_000), (2, 0, "user", "x" * 3_000_000)]
    assert _nodes(spark, long, 10) == _trie(_rebuilt(long))


def test_long_end_lists(spark, monkeypatch):
    rows = [(c % 3, 0, c) for c in range(20_000)]
    df = spark.createDataFrame(rows, "x long, y long, conv_id long").repartition(7)
    want = {min(v): hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k in range(3) for v in [[c for x, _, c in rows if x == k]]}
    assert {r[0]: r[1] for r in trie.list_digests(df).collect()} == want
