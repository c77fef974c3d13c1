"""What comes first after a row, and how far things went until then, without the pairs of rows and all that lies ahead of them.

Rows and episodes meet by (instrument, cell of one window's length): a row goes to its own cell and the one before, so every episode has its whole
window in its group.  Inside a group the answers come from tables over halving blocks, n log n in size: a search takes some log n steps whatever lies
ahead, where a join would list every row of the window.  Work grows with rows and episodes, not with their product."""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from tidemark.functions.timeops import PRICE, micros

_FAR = 1 << 62  # beyond all prices in millionths: a decimal(18,6) is below 10**18


def millionths(price: str) -> Column:
    return (F.col(price).cast(PRICE) * 1_000_000).cast("long")


def points_up(points: float) -> Column:
    """The least number of millionths that are ``points`` or more."""
    return F.lit(math.ceil(Decimal(str(points)) * 1_000_000)).cast("long")


class FirstAbove:
    """The first position from ``start`` on with x >= ``least`` and y > ``beyond``.

    Per level the positions of every block of 2**level are sorted by x, each with the largest y from there to the block's end."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.n = n = len(x)
        order = np.argsort(x, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.xs, self.ys = x[order], np.sort(y)
        y_rank = np.searchsorted(self.ys, y)
        self.levels = []
        for level in range(max(n - 1, 0).bit_length() + 1):
            key = np.sort((np.arange(n) >> level) * n + rank)
            step = (key[-1:] // n - key // n) * n  # blocks further left are larger, so the running maximum starts anew in each
            best = np.maximum.accumulate((step + y_rank[order[key % n]])[::-1])[::-1] - step if n else key
            self.levels.append((key, best))

    def _in_block(self, level: int, block: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        key, best = self.levels[level]
        i = np.searchsorted(key, block * self.n + least)
        inside = np.minimum(i, self.n - 1)
        return (i < self.n) & (key[inside] < (block + 1) * self.n) & (best[inside] >= beyond)

    def find(self, start: np.ndarray, least: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Positions; the number of rows where there is none."""
        least, beyond = np.searchsorted(self.xs, least), np.searchsorted(self.ys, beyond, side="right")
        at, found, top = start.astype(np.int64), np.full(len(start), -1), len(self.levels) - 1
        for level in range(top + 1):  # up: the blocks that make up the rest of the rows
            i = np.nonzero((found < 0) & (at < self.n) & ((at >> level & 1 == 1) | (level == top)))[0]
            hit = self._in_block(level, at[i] >> level, least[i], beyond[i])
            found[i[hit]] = level
            at[i[~hit]] += 1 << level
        for level in range(top, 0, -1):  # down: the left half if it has one
            i = np.nonzero(found == level)[0]
            hit = self._in_block(level - 1, at[i] >> (level - 1), least[i], beyond[i])
            at[i[~hit]] += 1 << (level - 1)
            found[i] = level - 1
        return np.where(found == 0, at, self.n)


def range_max(values: np.ndarray, start: np.ndarray, stop: np.ndarray, empty: int) -> np.ndarray:
    """The largest of ``values[start:stop]`` each, ``empty`` if that is nothing."""
    length = stop - start
    level = np.frexp(np.maximum(length, 1).astype(float))[1] - 1
    out, table = np.full(len(start), empty, values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        i = np.nonzero((length > 0) & (level == k))[0]
        out[i] = np.maximum(table[start[i]], table[stop[i] - (1 << k)])
        table = np.maximum(table[: -(1 << k)], table[1 << k :])
    return out


def _ints(table: pa.Table, name: str, empty: int) -> np.ndarray:
    return table[name].fill_null(empty).to_numpy()


def first_ahead(episodes: DataFrame, rows: DataFrame, window_seconds: int, after: bool, mirrored: bool) -> DataFrame:
    """``episodes(instrument, ts, up, down, level, ..)`` and ``rows(instrument, rts, rseq, price, rlevel)`` -> every episode with ``end_at``, ``end_seq``,
    ``rose``, ``highest``, ``lowest``, ``n_seen``.  Prices are longs, in millionths.

    A row ends an episode when price >= up and rlevel > level (``rose``), or price <= down and rlevel > level, ``mirrored``: rlevel < level.  Rows count
    from the episode's time on, ``after``: later ones only, to the end of the window, in order of (rts, rseq).  Up to the end, itself included,
    go the extremes and the count; without an end, to the end of the window."""
    width = window_seconds * 1_000_000
    new = StructType().add("end_at", LongType()).add("end_seq", LongType()).add("rose", BooleanType()).add("highest", LongType()).add("lowest", LongType()).add("n_seen", LongType())
    left = episodes.withColumn("_at", micros(F.col("ts"))).withColumn("_c", F.floor(F.col("_at") / width))
    right = rows.where("rts IS NOT NULL").withColumn("_at", micros(F.col("rts")))
    own = F.floor(F.col("_at") / width)
    right = right.select(F.col("instrument").alias("_i"), F.explode(F.array(own, own - 1)).alias("_c"), "_at", "rseq", "price", "rlevel")

    def work(ep: pa.Table, seen: pa.Table) -> pa.Table:
        kept = ep.drop_columns(["_at", "_c"])
        at, seq = seen["_at"].to_numpy(), _ints(seen, "rseq", -_FAR)
        order = np.lexsort((seq, at))
        at, seq, level = at[order], seq[order], seen["rlevel"].to_numpy()[order]
        high, low = _ints(seen, "price", -_FAR)[order], -_ints(seen, "price", _FAR)[order]
        n, t = len(at), _ints(ep, "_at", _FAR)
        start = np.searchsorted(at, t, side="right" if after else "left")
        stop = np.searchsorted(at, np.minimum(t, _FAR - width) + width, side="right")
        limit = ep["level"].to_numpy()
        rises = FirstAbove(high, level).find(start, _ints(ep, "up", _FAR), limit)
        falls = FirstAbove(low, -level if mirrored else level).find(start, -_ints(ep, "down", -_FAR), -limit if mirrored else limit)
        end = np.minimum(rises, falls)
        ends = end < stop
        stop = np.where(ends, end + 1, np.maximum(stop, start))
        last, most, least = np.minimum(end, max(n - 1, 0)), range_max(high, start, stop, -_FAR), range_max(low, start, stop, -_FAR)
        pick = lambda a: a[last] if n else np.zeros(len(t), np.int64)
        columns = {"end_at": pa.array(pick(at), mask=~ends), "end_seq": pa.array(pick(seq), mask=~ends), "rose": pa.array(rises < falls, mask=~ends),
                   "highest": pa.array(most, mask=most == -_FAR), "lowest": pa.array(-least, mask=least == -_FAR), "n_seen": pa.array(stop - start)}
        for name, values in columns.items():
            kept = kept.append_column(name, values)
        return kept

    schema = StructType(episodes.schema.fields + new.fields)
    return left.groupBy("instrument", "_c").cogroup(right.groupBy("_i", "_c")).applyInArrow(work, schema)
