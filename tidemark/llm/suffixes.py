"""Removing repeated byte strings by merged Burrows-Wheeler transforms of shards.

Texts are cut into phrases at anchors: the window of ``window`` starts from each byte chooses the smallest 8-byte hash in it
(rightmost on ties), so a repeated string has the same anchors inside, wherever it stands.  Every anchor is a
suffix of the phrase string.  Each shard (a partition of the documents) sends its suffixes, packed, to the bucket of their first phrase; the BWT symbol of
suffix (row, i) is the name of suffix (row, i - 1), so a transform and its mapping to the text are the same rows.

Merging interleaves the shards' transforms round by round.  After a round with depth d every suffix has the name of its interval:
the suffixes of all shards that agree on d phrases.  Only interval sizes are exchanged (counted inside each shard first).
An interval of size one is closed - its longest common prefix with any other suffix is below d - and its
suffix leaves; the others are refined to 2d by the interval name of the suffix d phrases on (the mapping that the BWT symbols
spell out), so no suffix is sorted again.  Rounds end when the phrases cover the part that every repeated
``length``-byte string around the anchor must share.

Surviving anchors are candidates; exact checks on their bytes follow: the shared right part of all strings the anchor stands for,
then the whole block of those strings at once, where that is not repeated short runs of them, and only then each string alone.  Names and
checks are 64-bit and longer hashes of bytes.

Passages of words that other texts have, too short in bytes or not, are counted beside this: the same choice of anchors over 8-word grams,
then blocks of passages, then single passages.

Matches never cross texts.  Edge cases: null and empty texts have no bytes; texts under ``length`` bytes keep everything; repeated rows
(equal id and text) are two occurrences and so lose their repeated bytes, each row for itself; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textops as X
from tidemark.llm.workspace import Workspace, flagged

K = 8
_U = np.uint64
_SECOND = X.mix(X._VALUE + _U(77))


def _chosen(g: np.ndarray, window: int) -> np.ndarray:
    """For each full window the place of its smallest hash, by the upper 40 bits, the rightmost among equals."""
    low = _U((1 << 24) - 1)
    if len(g) > int(low):
        return X.window_argmin(g >> _U(24), window)
    best, span = (g & ~low) | (low - np.arange(len(g), dtype=_U)), 1
    while span < window:
        step = min(span, window - span)
        best = np.minimum(best[: len(best) - step], best[step:])
        span += step
    return (low - (best & low)).astype(np.int64)


def _anchors(data: np.ndarray, offs: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts data[offs[t] : offs[t + 1]]: of each anchor its text, its place and the first and last string start that it
    stands for, places in ``data``."""
    long = np.flatnonzero(np.diff(offs) >= length)
    if not len(long):
        return (np.zeros(0, np.int64),) * 4
    g = np.ndarray(len(data) - K + 1, "<u8", np.ascontiguousarray(data), strides=(1,))
    return _runs(X.mix(g * _U(0x9E3779B97F4A7C15) + _U(1)), offs, long, window)


def _runs(h: np.ndarray, offs: np.ndarray, long: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from the hashes of all K-grams, for the texts ``long``."""
    at = _chosen(h, window)  # the choice of every start; some starts begin no string
    mark = np.zeros(len(at) + 1, np.int8)
    mark[offs[long]] += 1
    mark[offs[long + 1] - (window + K - 2)] -= 1  # from here on a window would leave the text
    inside = np.cumsum(mark, dtype=np.int8)[:-1] > 0
    other = at[1:] != at[:-1]
    first = np.flatnonzero(inside & np.append(True, other | ~inside[:-1]))
    last = np.flatnonzero(inside & np.append(other | ~inside[1:], True))
    return np.searchsorted(offs, first, "right") - 1, at[first], first, last


class _Prefix:
    """Hashes of any stretch of one text: two independent polynomials."""

    def __init__(self, part: np.ndarray):
        self.part, (self.up, self.down) = part, X.powers(len(part) + 1)
        self.one, self.two = self._sums(X._VALUE), None

    def _sums(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.part) + 1, _U)
        np.cumsum(values[self.part] * self.up[: len(self.part)], dtype=_U, out=sums[1:])
        return sums

    def one_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The first hash alone."""
        return X.mix((self.one[b] - self.one[a]) * self.down[a] + (b - a).astype(_U) * _U(0x2545F4914F6CDD1D))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.two is None:
            self.two = self._sums(_SECOND)
        n = (b - a).astype(_U) * _U(0x2545F4914F6CDD1D)
        return self.one_of(a, b), X.mix((self.two[b] - self.two[a]) * self.down[a] + n)


#: Suffixes that a map task packs at a time, and bytes of text whose suffixes one reduce task is to hold.
PACK, TASK_BYTES = 1 << 18, 24 << 20
#: kind 0: suffixes whose first phrase is once in the packet; 1: suffixes of phrases that repeat in it; 2: those phrases, once each.
_PACKED = "bucket int, kind int, row binary, at binary, name binary"


def _packed(row: np.ndarray, at: np.ndarray, name: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Suffixes by bucket of their first phrase, a row for each bucket.  What repeats in the packet is settled: only one
    mention of the phrase goes to the phrase's bucket, so a common phrase is no task's burden."""
    order = np.argsort(name)
    row, at, name = row[order], at[order], name[order]
    same = name[1:] == name[:-1]
    again = np.append(False, same)
    twice = again | np.append(same, False)
    rows: list[tuple[int, int, bytes, bytes, bytes]] = []
    for kind, some in ((0, ~twice), (2, twice & ~again)):
        r, a, n = row[some], at[some], name[some]
        bucket = ((n >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(n)])
        ends = np.append(cut[1:], len(n))[: len(cut)]
        rows += [(int(bucket[x]), kind, *((r[x:y].tobytes(), a[x:y].tobytes()) if kind == 0 else (b"", b"")), n[x:y].tobytes()) for x, y in zip(cut, ends, strict=True)]
    r, a, n = row[twice], at[twice], name[twice]
    step = max(1, len(n) // 16)
    turn = int(name[0] % _U(buckets))
    rows += [((turn + x) % buckets, 1, r[x : x + step].tobytes(), a[x : x + step].tobytes(), n[x : x + step].tobytes()) for x in range(0, len(n), step)]
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), *(pa.array(v, pa.binary()) for v in c[2:])], names=["bucket", "kind", "row", "at", "name"])


def _shards(docs: DataFrame, length: int, window: int, buckets: int) -> DataFrame:
    """One entry per anchor, packed: row, then i (its number in the text), at and depth (how many phrases all repeats of a
    string that the anchor stands for share for sure; -1 if it stands for no whole string), and name (its first phrase)."""
    sure = length - (window - 1) - (window + K - 1)  # the strings' bytes after the anchor, less the reach of a window
    if sure < window:
        raise ValueError("window is too wide for this length")

    def run(batches):
        held: list[tuple] = []
        size = 0
        for part, data, offs in X.chunks(batches, "text"):
            text, at, first, _ = _anchors(data, offs, length, window)
            if len(at):
                every = np.arange(len(at))
                new = np.append(True, text[1:] != text[:-1])
                bounds = np.where(np.append(new[1:], True), offs[text + 1], np.append(at[1:], 0))
                depth = np.where(first <= offs[text + 1] - length, np.searchsorted(at, at + sure, "right") - 1 - every, -1)
                number = every - np.maximum.accumulate(np.where(new, every, 0))
                held.append((part.column(0).to_numpy()[text], np.stack((number, at - offs[text], depth), 1).astype(np.int32), _Prefix(data).one_of(at, bounds)))
                size += len(at)
            if size >= PACK:
                yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)
                held, size = [], 0
        if size:
            yield _packed(*map(np.concatenate, zip(*held, strict=True)), buckets)

    return docs.mapInArrow(run, _PACKED)


def _first_round(packed: DataFrame) -> DataFrame:
    """The suffixes (row, i, at, depth, key) whose first phrase, the key, occurs at least twice in these partitions."""

    def out(row, at, name):
        for x in range(0, len(row), 1 << 16):
            y = x + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(row[x:y]), *(pa.array(np.ascontiguousarray(at[x:y, j])) for j in range(3)), pa.array(X.signed(name[x:y]))], names=["row", "i", "at", "depth", "key"])

    def run(batches):
        held: list[tuple] = []
        told = [np.zeros(0, _U)]
        for batch in batches:
            for kind, row, at, name in zip(batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                n = np.frombuffer(name.as_buffer(), _U)
                if kind == 2:
                    told.append(n)
                    continue
                one = np.frombuffer(row.as_buffer(), np.int64), np.frombuffer(at.as_buffer(), np.int32).reshape(-1, 3), n
                if kind:
                    yield from out(*one)
                else:
                    held.append(one)
        if held:
            row, at, name = map(np.concatenate, zip(*held, strict=True))
            known = np.concatenate((name, *told))
            held.clear()
            order = np.argsort(known)
            same = known[order[1:]] == known[order[:-1]]
            live = np.zeros(len(known), bool)
            live[order] = np.append(False, same) | np.append(same, False)
            live = live[: len(name)]
            yield from out(row[live], at[live], name[live])

    return packed.mapInArrow(run, "row bigint, i int, at int, depth int, key bigint")


#: Rows of one key that a task may hold before the key is dealt over several tasks.
HOT_ROWS = 1000


def _semi(rows: DataFrame, sizes: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """``rows`` whose key is among the saved ``sizes(key, n)``, n rows of each at least.  Keys of more than an eighth of an
    even share are dealt over the tasks by ``by``; there are at most eight times as many of them as partitions, so they are
    broadcast by a proven bound."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = max(HOT_ROWS, (sizes.agg(F.sum("n")).first()[0] or 0) // (8 * parts))
    hot = F.broadcast(sizes.where(F.col("n") > most).select(*key, F.lit(True).alias("_hot")))
    turn = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(parts))).otherwise(F.lit(0)).alias("_deal")
    dealt = rows.join(hot, key, "left").select(*rows.columns, turn)
    turns = F.expr(f"IF(n > {most}, sequence(0L, {parts - 1}L), array(0L))")
    return dealt.join(sizes.select(*key, F.explode(turns).alias("_deal")), [*key, "_deal"], "left_semi").drop("_deal")


def _repeated(rows: DataFrame, work: Workspace, name: str, *key: str) -> DataFrame:
    """The rows whose key occurs at least twice: sizes are combined before the shuffle, then a semi-join."""
    sizes = work.save(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}_sizes")
    return _semi(rows, sizes, list(key), ["row", "i"])


def merge_transforms(packed: DataFrame, work: Workspace, rounds: int = 4) -> DataFrame:
    """From packed suffixes, dealt by bucket, the anchors (row, at) whose ``depth`` phrases occur at least twice in the merged transform.

    Text without short periods has fewer than ``rounds`` phrases there; where short periods make many more, the interval of
    depth ``rounds`` decides, and the byte checks see to the rest: rounds only ever remove, so the result is the same."""
    live = work.save(_first_round(packed), "round1")
    deepest = live.agg(F.max("depth")).first()[0] or 0
    done, d = live.where("depth = 1").select("row", "at"), 1
    while d < min(deepest, rounds):
        # depth d..2d-1 is settled here: by its own interval, or by two overlapping ones; deeper suffixes join two adjoining
        ahead = live.groupBy("row", F.col("i").alias("j")).agg(F.first("key").alias("next"))
        step = F.when((F.col("depth") < 0) | (F.col("depth") >= 2 * d), F.lit(d)).otherwise(F.col("depth") - d)
        ends = F.when(F.col("depth").between(d + 1, 2 * d - 1), F.col("depth")).otherwise(F.lit(0)).alias("ends")
        named = live.where(f"depth < 0 OR depth > {d}").withColumn("j", F.col("i") + step).join(ahead, ["row", "j"])
        named = work.save(named.select("row", "i", "at", "depth", F.xxhash64("key", "next").alias("key"), ends), f"named{2 * d}")
        refined = work.save(_repeated(named, work, f"round{2 * d}", "ends", "key"), f"round{2 * d}")
        work.drop(f"named{2 * d}")
        d *= 2
        live = refined.where("ends = 0").drop("ends")
        done = done.union(refined.where(f"ends > 0 OR depth {'=' if d < min(deepest, rounds) else '>='} {d}").select("row", "at"))
    return done.distinct()


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """``docs(row, ..)`` joined with the saved ``lists(row, items)``; only texts that a list can belong to are shuffled."""
    return flagged(docs, lists).where("maybe").drop("maybe").join(lists, "row")


_CHECKED = ["row", "at", "first", "last", "w", "k1", "k2", "b1", "b2"]
_CHECKED_TYPE = "row bigint, at int, first int, last int, w int, k1 bigint, k2 bigint, b1 bigint, b2 bigint"


def _checked(out: list[tuple]) -> pa.RecordBatch:
    c = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c[0]), *(pa.array(x.astype(np.int32)) for x in c[1:5]), *(pa.array(X.signed(x)) for x in c[5:])], names=_CHECKED)


def _checks(rows: DataFrame, length: int, window: int) -> DataFrame:
    """``rows(row, text, items)`` -> for each candidate anchor the hashes of the part right of it that all its strings
    share (k) and of the block of all its strings (b)."""
    core = length - (window - 1)

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            items = part.column("items")
            text, at, first, last = _anchors(data, offs, length, window)
            wanted = items.flatten().to_numpy() + np.repeat(offs[:-1], items.value_lengths().to_numpy())
            keep = np.isin(at, wanted) & (first <= offs[text + 1] - length)
            text, at, first, last = text[keep], at[keep], first[keep], np.minimum(last[keep], offs[text[keep] + 1] - length)
            h, lo = _Prefix(data), offs[text]
            out = [(part.column("row").to_numpy()[text], at - lo, first - lo, last - lo, np.ones(len(at)), *h(at, at + core), *h(first, last + length))]
            yield _checked(out)

    return rows.mapInArrow(run, _CHECKED_TYPE)


def _finer(rows: DataFrame, length: int, width: int = 16) -> DataFrame:
    """The same for the strings of a block in bins of ``width`` distances to the anchor: strings that are equal have equal
    distances, and those of one bin share all but ``width - 1`` bytes."""

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            out = []
            rows_, items = part.column("row").to_numpy(), part.column("items")
            for t in range(part.num_rows):
                s = items[t].values
                at, first, last, w = (s.field(k).to_numpy().astype(np.int64) for k in ("at", "first", "last", "w"))
                low, high = (at - last) // width, (at - first) // width
                which = np.repeat(np.arange(len(at)), high - low + 1)
                bin_ = np.repeat(high + 1 - np.cumsum(high - low + 1), high - low + 1) + np.arange(len(which))
                at, w = at[which], w[which]
                lo, hi = np.maximum(first[which], at - bin_ * width - width + 1), np.minimum(last[which], at - bin_ * width)
                h = _Prefix(data[offs[t] : offs[t + 1]])
                k1, k2 = h(at - bin_ * width, at - bin_ * width - width + 1 + length)
                out.append((np.full(len(at), rows_[t]), at, lo, hi, w, X.mix(k1 + bin_.astype(_U)), k2, *h(lo, hi + length)))
            yield _checked(out)

    return rows.mapInArrow(run, _CHECKED_TYPE)


def _narrow(checks: DataFrame, work: Workspace, name: str, length: int) -> tuple[DataFrame, DataFrame]:
    """Spans whose whole block repeats, and what is left: (row, items array<struct<at, first, last, w>>) of blocks that do not
    repeat (w = 1) and of one example (w = 2) of each repeated block with the same shared part."""
    weigh = lambda: F.sum("w").cast("long").alias("n")
    sizes = work.save(checks.groupBy("k1", "k2").agg(weigh()).where("n > 1"), f"{name}_sizes")
    alike = work.save(_semi(checks, sizes, ["k1", "k2"], ["row", "at", "first"]), f"{name}_alike")
    blocks = work.save(alike.groupBy("k1", "k2", "b1", "b2").agg(weigh(), F.min(F.struct("row", "at", "first", "last")).alias("one")), f"{name}_blocks")
    whole = blocks.where("n > 1").groupBy("b1", "b2").agg(F.sum("n").alias("n"))
    settled = _semi(alike.where("w = 1"), work.save(whole, f"{name}_whole"), ["b1", "b2"], ["row", "at", "first"]).select("row", F.col("first").alias("a"), (F.col("last") + length).alias("b"))
    unsure = blocks.where("n = 1").select("k1", "k2").distinct()
    left = blocks.join(unsure, ["k1", "k2"], "left_semi").select("one.*", F.least("n", F.lit(2)).cast("int").alias("w"))
    return settled, work.save(left.groupBy("row").agg(F.collect_list(F.struct("at", "first", "last", "w")).alias("items")), f"{name}_left")


def _strings(rows: DataFrame, length: int) -> DataFrame:
    """``rows(row, text, items array<struct<at, first, last, w>>)`` -> every string start with its hashes and weight."""

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            out = []
            rows_, items = part.column("row").to_numpy(), part.column("items")
            for t in range(part.num_rows):
                s = items[t].values
                first, last, w = (s.field(k).to_numpy() for k in ("first", "last", "w"))
                count = last - first + 1
                p = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                out.append((np.full(len(p), rows_[t]), p, np.repeat(w, count), *map(X.signed, _Prefix(data[offs[t] : offs[t + 1]])(p, p + length))))
            c = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1].astype(np.int32)), pa.array(c[2].astype(np.int32)), pa.array(c[3]), pa.array(c[4])], names=["row", "p", "w", "h1", "h2"])

    return rows.mapInArrow(run, "row bigint, p int, w int, h1 bigint, h2 bigint")


def repeated_spans(docs: DataFrame, work: Workspace, length: int = 400, window: int = 128) -> DataFrame:
    """``docs(row, text)`` -> (row, items array<struct<a, b>>): byte spans covered by repeated strings; only rows that have any."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES + 1)
    packed = _shards(docs, length, window, 8 * n).repartition(n, "bucket")
    found = work.save(merge_transforms(packed, work).groupBy("row").agg(F.collect_list("at").alias("items")), "candidates")
    checks = work.save(_checks(_with_lists(docs, found), length, window), "checks")
    settled, left = _narrow(checks, work, "block", length)
    checks = work.save(_finer(_with_lists(docs, left), length), "finer")
    settled2, left = _narrow(checks, work, "bin", length)
    strings = work.save(_strings(_with_lists(docs, left), length), "strings")
    twice = work.save(strings.groupBy("h1", "h2").agg(F.sum("w").alias("n"), F.min("w").alias("least")).where("n > 1 AND least = 1"), "twice")
    single = _semi(strings.where("w = 1"), twice, ["h1", "h2"], ["row", "p"]).select("row", F.col("p").alias("a"), (F.col("p") + length).alias("b"))
    spans = work.save(settled.union(settled2).union(single).groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("items")), "spans")
    work.keep_only("spans")
    return spans


#: Words ``[^\x20\x09-\x0D]+`` as they stand, upper and lower case apart.
_AS_IS = np.where(X.SPACED > 0, np.arange(256), 0).astype(np.uint8)
_AS_IS[0] = X.SPACED[0]


def _stretches(values: np.ndarray, size: int):
    """A hash of any stretch of these words; ``size`` is that of their text, whose powers are at hand."""
    up, down = X.powers(size + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], dtype=_U, out=sums[1:])
    return lambda a, b: X.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0x2545F4914F6CDD1D))


def _passages(docs: DataFrame, words: int) -> DataFrame:
    """An entry for each anchor among the words, the smallest of the K-grams of a passage of ``words`` words: row, the first word and the end
    of the passages that chose it, key (its gram) and block (all their words)."""
    if words < K:
        raise ValueError(f"a passage has {K} words at least")

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            hashes, begin = X.words(data, offs, _AS_IS)
            long = np.flatnonzero(np.diff(begin) >= words)
            if len(long):
                of, every = _stretches(hashes, len(data)), np.arange(len(hashes) - K + 1)
                g = of(every, every + K)
                text, at, first, last = _runs(g, begin, long, words - K + 1)
                end, lo = last + words, begin[text]
                c = part.column("row").to_numpy()[text], (first - lo).astype(np.int32), (end - lo).astype(np.int32), X.signed(g[at]), X.signed(of(first, end))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["row", "first", "end", "key", "block"])

    return docs.mapInArrow(run, "row bigint, first int, end int, key bigint, block bigint")


def _single_passages(rows: DataFrame, words: int) -> DataFrame:
    """``rows(row, text, items array<struct<first, end, w>>)`` -> every passage of the items with its hashes and weight."""

    def run(batches):
        for part, data, offs in X.chunks(batches, "text"):
            hashes, begin = X.words(data, offs, _AS_IS)
            items = part.column("items")
            s, of_text = items.flatten(), np.repeat(np.arange(part.num_rows), items.value_lengths().to_numpy())
            first, end, w = (s.field(k).to_numpy() for k in ("first", "end", "w"))
            count = end - first - words + 1
            text = np.repeat(of_text, count)
            p = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            a = p + begin[text]
            h1, h2 = (_stretches(v, len(data))(a, a + words) for v in (hashes, X.mix(hashes + _U(77))))
            c = part.column("row").to_numpy()[text], p.astype(np.int32), np.repeat(w, count), X.signed(h1), X.signed(h2)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=["row", "p", "w", "h1", "h2"])

    return rows.mapInArrow(run, "row bigint, p int, w int, h1 bigint, h2 bigint")


def shared_words(docs: DataFrame, work: Workspace, words: int = 51) -> DataFrame:
    """``docs(row, text)`` -> (row, n_shared_words): words in passages of ``words`` words that another row has too, whatever stands between
    the words; only rows that have any.  As with bytes, anchors are met first, then all passages of an anchor, and only the rest one by one."""
    n, across = F.count(F.lit(1)).alias("n"), (F.min("row") < F.max("row")).alias("across")
    found = work.save(_passages(docs, words), "passages")
    keys = work.save(found.groupBy("key").agg(n, across).where("across").drop("across"), "passage_keys")
    alike = work.save(_semi(found, keys, ["key"], ["row", "first"]), "passages_alike")
    blocks = work.save(alike.groupBy("key", "block").agg(n, across, F.min(F.struct("row", "first", "end")).alias("one")), "passage_blocks")
    whole, alone = (work.save(blocks.where(c).select("key", "block", "n"), f"passages_{name}") for name, c in (("whole", "across"), ("alone", "NOT across")))
    settled = _semi(alike, whole, ["key", "block"], ["row", "first"]).select("row", F.col("first").alias("a"), F.col("end").alias("b"))
    unsure = work.save(blocks.groupBy("key").agg(n, F.bool_and("across").alias("sure")).where("NOT sure").drop("sure"), "passages_unsure")
    # of a block that many rows have, one mention is compared with what is left
    mention = _semi(blocks.where("across").select("key", "one.*"), unsure, ["key"], ["row", "first"]).select("row", "first", "end", F.lit(2).alias("w"))
    left = _semi(alike, alone, ["key", "block"], ["row", "first"]).select("row", "first", "end", F.lit(1).alias("w")).unionByName(mention)
    left = work.save(left.groupBy("row").agg(F.collect_list(F.struct("first", "end", "w")).alias("items")), "passages_left")
    single = work.save(_single_passages(_with_lists(docs, left), words), "passages_single")
    twice = single.groupBy("h1", "h2").agg(n, across, F.min("w").alias("least"), F.max("w").alias("most")).where("least = 1 AND (across OR most = 2)")
    rest = _semi(single.where("w = 1"), work.save(twice.select("h1", "h2", "n"), "passages_twice"), ["h1", "h2"], ["row", "p"])
    spans = settled.union(rest.select("row", F.col("p").alias("a"), (F.col("p") + words).alias("b"))).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    covered = F.expr("aggregate(s, named_struct('n', 0L, 'to', 0), (x, y) -> named_struct('n', x.n + greatest(0, y.b - greatest(y.a, x.to)), 'to', greatest(x.to, y.b)), x -> x.n)")
    return spans.select("row", covered.alias("n_shared_words"))


def remove_repeats(docs: DataFrame, work: Workspace, length: int = 400, window: int = 128, words: int = 51) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs ``a:b`` in bytes) and n_shared_words (words
    in passages of ``words`` words that another document has, removed or not)."""
    keyed = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("row"), "doc_id", "text")
    spans = repeated_spans(keyed.select("row", "text"), work, length, window)
    found = work.save(spans.join(shared_words(keyed.select("row", "text"), work, words), "row", "full"), "found")
    work.keep_only("found")
    marked = flagged(keyed, found)
    joined = marked.where("maybe").join(found, "row", "left").select("doc_id", "text", "items", "n_shared_words").unionByName(
        marked.where("NOT maybe").select("doc_id", "text", *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("items", "n_shared_words"))))
    joined = joined.withColumn("n_shared_words", F.coalesce("n_shared_words", F.lit(0).cast("long")))

    def cut(batches):
        for part, data, offs in X.chunks(batches, "text"):
            out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "kept_sha256", "spans")}
            items = part.column("items")
            for t in range(part.num_rows):
                text, gone = data[offs[t] : offs[t + 1]], []
                if items[t].is_valid:
                    s = items[t].values
                    mark = np.zeros(len(text) + 1, np.int64)
                    np.add.at(mark, s.field("a").to_numpy(), 1)
                    np.add.at(mark, s.field("b").to_numpy(), -1)
                    covered = np.cumsum(mark)[:-1] > 0
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                    gone = list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))
                    text = text[~covered]
                out["n_removed"].append(sum(b - a for a, b in gone))
                out["n_spans"].append(len(gone))
                out["kept_sha256"].append(hashlib.sha256(text.tobytes()).hexdigest())
                out["spans"].append(",".join(f"{a}:{b}" for a, b in gone))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs)), pa.array(out["n_removed"], pa.int64()), pa.array(out["n_spans"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["spans"]), part.column("n_shared_words")], names=["doc_id", "n_bytes", *out, "n_shared_words"])

    return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, n_shared_words bigint")


def op8_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, Workspace(spark, "suffixes")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", (F.col("n_removed") > 0).alias("repeated"), "n_shared_words"
    )
