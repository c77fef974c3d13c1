"""Personal data: exact base patterns, then a skip-chain conditional random field for what they miss.

The field's nodes are the tokens that hold a digit or an ``@`` (all other tokens are known to be outside).  Chain edges join
neighbouring nodes; skip edges join distant nodes whose cores, of ``MIN_CORE`` characters at least and of any length beyond (shorter
ones repeat by chance), are equal or differ in one character, linked in text
order so that n equal tokens make n - 1 edges.  Loopy sum-product passes run per document; a token whose marginal for one
kind reaches ``threshold`` and that no base span touches is added, neighbours of one kind as one span.

The weights are trained here, node weights and both edge tables together, by pseudo-likelihood: every node's label given the labels
of its neighbours.  The base patterns give the labels; a token that they leave out is no example where an equal or similar one is
labelled.  Training reads a bounded sample: about ``sample_docs`` documents with digits
or ``@``, those of the smallest hash of the row, the first ``tokens_per_doc`` nodes of each.  The base patterns run over every whole text.

Offsets are code points, ends exclusive.  Edge cases: null and empty texts have no spans; without any labelled
token nothing is added; repeated rows each get a row; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Matches what ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`` matches, in one pass: a run of digits fails at its first digit or not at all.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NODE = re.compile(r"[0-9@]")
_EDGE = "\"'`()[]{}<>,;:!?.=|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str):
    """The matches of the e-mail pattern; only stretches around an ``@`` are searched, so long texts cost one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            yield m.start(), m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# ---- the field


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


#: name -> number of values; a token has one value of each.  What the base patterns compute (a check sum, the size of octets) is left out:
#: it would decide the training labels alone, and the field is there for tokens that fail it.
_FEATURES = {"digits": 7, "letters": 4, "dots": 5, "at": 3, "plus": 2, "paren": 2, "hyphen": 3, "quote": 2, "equals": 2, "pure": 2, "before": 4, "after": 4, "length": 6}
_START = dict(zip(_FEATURES, np.concatenate(([0], np.cumsum(list(_FEATURES.values()))[:-1])).tolist(), strict=True))
N_FEATURES = sum(_FEATURES.values()) + 1


def _values(core: str, token: str, before: int, after: int) -> list[int]:
    digits = sum(c in "0123456789" for c in core)
    at = core.find("@")
    got = {
        "digits": _bucket(digits, (1, 2, 4, 8, 12, 20)), "letters": _bucket(sum(c.isalpha() for c in core), (1, 3, 8)), "dots": min(core.count("."), 4),
        "at": 0 if at < 0 else 2 if "." in core[at:] else 1, "plus": int("+" in token), "paren": int("(" in token), "hyphen": min(core.count("-"), 2), "quote": int('"' in token),
        "equals": int("=" in token), "pure": int(digits == len(core)),
        "before": before, "after": after, "length": _bucket(len(core), (2, 4, 8, 14, 24)),
    }
    return [_START[k] + v for k, v in got.items()] + [N_FEATURES - 1]


def _kind_of_neighbour(token: str | None) -> int:
    return 0 if token is None or not _NODE.search(token) else 1 + ("+" in token) + 2 * ("(" in token and "+" not in token)


#: Shortest core that takes part in skip edges.
MIN_CORE = 6


def one_apart(cores: list[str]) -> list[tuple[int, int]]:
    """Of distinct cores, those that differ in one character: each with the next that agrees with it everywhere but at one place.

    Places are compared by hashes of what is left and right of them, so the cost follows the cores' length."""
    sizes = np.array([len(c) for c in cores])
    kept = np.flatnonzero(np.bincount(sizes)[sizes] > 1) if len(cores) else sizes
    if len(kept) < 2:
        return []
    size = sizes[kept]
    codes = np.frombuffer("".join(cores[i] for i in kept).encode("utf-32-le"), np.uint32).astype(np.uint64)
    end = np.repeat(np.cumsum(size), size)
    start, at = end - np.repeat(size, size), np.arange(len(codes))
    up, down = X.powers(len(codes) + 1)
    sums = np.append(np.uint64(0), np.cumsum(X.mix(codes + np.uint64(1)) * up[: len(codes)], dtype=np.uint64))
    before, after = (sums[at] - sums[start]) * down[start], (sums[end] - sums[at + 1]) * down[at + 1]
    key = X.mix(X.mix(before + (at - start).astype(np.uint64)) ^ (after + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    core = np.repeat(kept, size)
    order = np.lexsort((core, key))
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    return [(int(a), int(b)) for a, b in zip(core[order][same], core[order][same + 1], strict=True)]


class Field:
    """Nodes, features, chain and skip edges of one text."""

    def __init__(self, text: str):
        tokens = [(m.start(), m[0]) for m in _WORD.finditer(text)]
        self.spans, self.features, self.chain, self.skip = [], [], [], []
        last, groups = None, defaultdict(list)
        for i, (at, token) in enumerate(tokens):
            if not _NODE.search(token):
                continue
            core = token.strip(_EDGE)
            left = token.find(core) if core else 0
            core = core or token
            before = _kind_of_neighbour(tokens[i - 1][1] if i else None)
            after = _kind_of_neighbour(tokens[i + 1][1] if i + 1 < len(tokens) else None)
            node = len(self.spans)
            self.spans.append((at + left, at + left + len(core)))
            self.features.append(_values(core, token, before, after))
            if last == i - 1 and node:
                self.chain.append((node - 1, node))
            last = i
            if len(core) >= MIN_CORE:
                groups[core.lower()].append(node)
        for nodes in groups.values():
            self.skip += zip(nodes, nodes[1:], strict=False)
        firsts = [nodes[0] for nodes in groups.values()]
        self.skip += [(firsts[i], firsts[j]) for i, j in one_apart(list(groups))]
        self.skip = list(dict.fromkeys(self.skip))

    def labels(self, base: list[tuple[int, int, int]]) -> list[int]:
        out, j = [0] * len(self.spans), 0
        for n, (a, b) in enumerate(self.spans):
            while j < len(base) and base[j][2] <= a:
                j += 1
            if j < len(base) and base[j][0] < b:
                out[n] = base[j][1] + 1
        return out


def train(rows: list[tuple[list[list[int]], list[int], list[tuple[int, int]], list[tuple[int, int]]]], steps: int = 400) -> dict | None:
    """Node weights and edge tables from (features, labels, chain, skip) of the sampled texts, by pseudo-likelihood.

    Nodes with the same features and the same labels around them are one row with a weight, so all of the sample is used."""
    packed = []
    for features, y, chain, skip in rows:
        near = [[0] * 15 for _ in y]  # labels of the node before, of the node after, and of the skip neighbours
        for a, b in chain:
            near[b][y[a]] += 1
            near[a][5 + y[b]] += 1
        for a, b in skip:
            near[a][10 + y[b]] += 1
            near[b][10 + y[a]] += 1
        # an unlabelled near copy of a labelled token is a question, not an example of "outside"
        packed += [(*f, *n, v) for f, n, v in zip(features, near, y, strict=True) if v or not sum(n[11:])]
    if not any(r[-1] for r in packed):
        return None
    table, count = np.unique(np.array(packed, np.int32), axis=0, return_counts=True)
    width = len(_FEATURES) + 1
    x = np.zeros((len(table), N_FEATURES + 15))
    x[np.arange(len(table))[:, None], table[:, :width]] = 1
    x[:, N_FEATURES:] = table[:, width:-1]
    k, share = np.eye(5)[table[:, -1]], (count / count.sum())[:, None]
    w = np.zeros((N_FEATURES + 15, 5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        p = x @ w
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = x.T @ (share * (p - k))
        # one table for both ends of a chain edge, a symmetric one for skip edges
        before, after, skip = (g[N_FEATURES + 5 * i : N_FEATURES + 5 * i + 5].copy() for i in range(3))
        g[N_FEATURES : N_FEATURES + 5], g[N_FEATURES + 5 : N_FEATURES + 10], g[N_FEATURES + 10 :] = before + after.T, after + before.T, skip + skip.T
        g += 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"node": w[:N_FEATURES], "chain": w[N_FEATURES : N_FEATURES + 5], "skip": w[N_FEATURES + 10 :]}


def marginals(field: Field, model: dict, known: list[int] | None = None, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Loopy sum-product in log space; messages of all edges at once.  A node with a ``known`` kind is evidence, not a question."""
    node = model["node"][np.array(field.features)].sum(1)
    if known:
        sure = np.flatnonzero(np.array(known))
        node[sure] = -30.0
        node[sure, np.array(known)[sure]] = 0.0
    edges = np.array(field.chain + field.skip, int).reshape(-1, 2)
    if len(edges):
        table = np.concatenate((np.repeat(model["chain"][None], len(field.chain), 0), np.repeat(model["skip"][None], len(field.skip), 0)))
        src, dst = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
        table = np.concatenate((table, table.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        message = np.zeros((len(src), 5))
        for _ in range(rounds):
            belief = node.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + table
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            message = damping * message + (1 - damping) * new
        np.add.at(node, dst, message)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict | None, threshold: float) -> list[tuple[int, int, int]]:
    if model is None or not _NODE.search(text):
        return []
    field = Field(text)
    if not field.spans:
        return []
    known = field.labels(base)
    p = marginals(field, model, known)
    best = p.argmax(1)
    chained, out, covered = set(field.chain), [], -1
    free = [not y for y in known]
    for n, (a, b) in enumerate(field.spans):
        k = int(best[n])
        if not k or p[n, k] < threshold or not free[n]:
            continue
        if out and covered == n - 1 and (n - 1, n) in chained and out[-1][1] == k - 1:
            out[-1] = (out[-1][0], k - 1, b)
        else:
            out.append((a, k - 1, b))
        covered = n
    return out


def fit(docs: DataFrame, sample_docs: int = 2000, tokens_per_doc: int = 200) -> dict | None:
    """Train on a bounded sample of ``docs(doc_id, text)``; ``tokens_per_doc`` bounds what one text gives to training only."""
    some = docs.where(F.col("text").rlike("[0-9@]"))
    n = some.count()
    if not n:
        return None
    place = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 62) - 1))  # an even share of 2^62, whatever the number of rows
    chosen = some.where(place < min(1 << 62, (sample_docs << 62) // n)).withColumn("place", place)

    def rows(batches):
        for b in batches:
            out: dict[str, list] = {"x": [], "y": [], "chain": [], "skip": []}
            for text in b.column(0).to_pylist():
                f = Field(text)
                y = f.labels(base_spans(text))[:tokens_per_doc]
                out["x"].append([v for fs in f.features[:tokens_per_doc] for v in fs])
                out["y"].append(y)
                for name in ("chain", "skip"):
                    out[name].append([v for e in getattr(f, name) if max(e) < tokens_per_doc for v in e])
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.list_(pa.int32())) for v in out.values()), b.column(1)], names=[*out, "place"])

    got = chosen.select("text", "place").mapInArrow(rows, "x array<int>, y array<int>, chain array<int>, skip array<int>, place bigint")
    got = got.dropDuplicates(["place"]).collect()  # repeated rows have one hash and count once
    width = len(_FEATURES) + 1
    pairs = lambda v: list(zip(v[::2], v[1::2], strict=True))
    data = sorted(([r["x"][i : i + width] for i in range(0, len(r["x"]), width)], list(r["y"]), pairs(r["chain"]), pairs(r["skip"])) for r in got)
    return train(data)


def find_personal_data(docs: DataFrame, threshold: float = 0.9, sample_docs: int = 2000, redact: bool = False) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans; with ``redact`` the input
    columns and the text with every span replaced by its kind in angle brackets."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample_docs))
    where = docs.schema.fieldNames().index("text")

    def find(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                rows = b.slice(lo, 500)
                out: dict[str, list] = {k: [] for k in (*KINDS, "sha", "spans", "clean")}
                for text in rows.column(where).to_pylist():
                    base = base_spans(text or "")
                    every = sorted(base + added_spans(text or "", base, model.value, threshold))
                    for k, kind in enumerate(KINDS):
                        out[kind].append(sum(s[1] == k for s in base))
                    out["sha"].append(hashlib.sha256(render(base).encode()).hexdigest())
                    out["spans"].append(render(every))
                    out["clean"].append(replaced(text, every) if redact else None)
                if redact:
                    yield pa.RecordBatch.from_arrays([pa.array(out["clean"], pa.string()) if i == where else c for i, c in enumerate(rows.columns)], names=rows.schema.names)
                else:
                    yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(out[k], pa.int64()) for k in KINDS), pa.array(out["sha"]), pa.array(out["spans"])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    if redact:
        return docs.mapInArrow(find, docs.schema)
    where = 1
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def replaced(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], f"<{KINDS[k].upper()}>"] if a >= at else []
        at = max(at, b)
    return "".join([*out, text[at:]])


def op5_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
