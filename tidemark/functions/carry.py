"""Sequential rules without a task that holds a whole key.

Market keys are few and large, so a window or a fold by instrument alone would put a third of all rows into one task.  The helpers
here work inside (key, time bucket) and pass only a bounded summary from bucket to bucket:

* ``with_halo``: windows that look back a bounded number of rows see copies of the last rows of earlier buckets;
* ``running``, ``previous``, ``peak_before``: running sums, the row before and running maxima are completed by one carried row per bucket;
* ``carried``: a fold over the one summary row per bucket, with the state as its only memory;
* ``sorted_fold``: a general fold in one pass over sorted rows, for rules that neither of the others can express.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.timeops import micros

DAY = 86_400


def bucket_of(ts: str | Column, seconds: int = DAY) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(micros(ts) / (seconds * 1_000_000))


def with_halo(df: DataFrame, keys: list[str], order: list[str], k: int, seconds: int = DAY) -> DataFrame:
    """``df`` with ``_b`` (bucket of order[0]), ``_halo`` and ``_before``, the number of the key's rows in earlier buckets: every bucket
    also holds copies of the k rows of the key before it.

    A window by (keys, _b) that looks back at most k rows then equals the window by the keys; drop the ``_halo`` rows after it."""
    rows = df.withColumn("_b", bucket_of(order[0], seconds))
    bucket = Window.partitionBy(*keys, "_b")
    newest = F.row_number().over(bucket.orderBy(*(F.desc(c) for c in order)))
    last = rows.select(*keys, "_b", F.struct(*df.columns).alias("_r"), newest.alias("_n"), F.count(F.lit(1)).over(bucket).alias("_c")).where(F.col("_n") <= k)
    item = F.struct((-F.col("_n")).alias("_n"), "_r")
    tails = last.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(item)).alias("_t"), F.first("_c").alias("_c"))
    # every bucket here holds a row at least, so the last k of them hold the last k rows
    past = Window.partitionBy(*keys).orderBy("_b")
    held = F.flatten(F.collect_list("_t").over(past.rowsBetween(-k, -1)))
    count = F.coalesce(F.sum("_c").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tails = tails.select(*keys, "_b", held.alias("_t"), count.alias("_before"))
    kept = F.slice("_t", F.greatest(F.size("_t") - k + 1, F.lit(1)), k)
    halo = tails.select("_b", "_before", F.explode(kept).alias("_t")).select("_t._r.*", "_b", F.lit(True).alias("_halo"), "_before")
    own = rows.join(tails.select(*keys, "_b", "_before"), [*keys, "_b"])
    return own.select(*df.columns, "_b", F.lit(False).alias("_halo"), "_before").unionByName(halo)


def with_time_halo(df: DataFrame, second: str, reach: int, seconds: int = DAY) -> DataFrame:
    """``df`` with ``_b`` and ``_halo``: every row is also in the later buckets of time that start within ``reach`` seconds of it
    (``second``: a column of whole seconds), for windows that look back a bounded time."""
    step = max(seconds, reach)
    at = lambda c: F.floor(c / step)
    copies = F.explode(F.sequence(at(F.col(second)), at(F.col(second) + reach)))
    return df.withColumn("_b", copies).withColumn("_halo", F.col("_b") != at(F.col(second)))


def without_halo(df: DataFrame) -> DataFrame:
    return df.where("NOT _halo").drop("_b", "_halo", "_before")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], seconds: int = DAY) -> DataFrame:
    """Running sums over the keys up to each row: inside the bucket, plus the total of the buckets before."""
    rows = df.withColumns({"_b": bucket_of(order[0], seconds)} | {f"_own_{n}": c for n, c in sums.items()})
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_b").agg(*(F.sum(f"_own_{n}").alias(f"_all_{n}") for n in sums))
    totals = totals.select(*keys, "_b", *(F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0)).alias(f"_all_{n}") for n in sums))
    out = rows.withColumns({n: F.sum(f"_own_{n}").over(inside) for n in sums}).join(totals, [*keys, "_b"])
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_all_{n}") for n in sums})
    return out.drop("_b", *(f"_own_{n}" for n in sums), *(f"_all_{n}" for n in sums))


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """``df`` with the ``values`` of the key's row before (null for the first one): a lag inside the bucket, and for its first row the last row of
    the buckets before.  The input is planned twice, once for one row a bucket.  ``bucket`` must not fall along the order; a day of order[0] by default."""
    rows = df.withColumns({"_b": bucket_of(order[0]) if bucket is None else bucket, "_own": F.struct(*(c.alias(n) for n, c in values.items()))})
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_own", F.struct(*order)).alias("_end"))
    past = Window.partitionBy(*keys).orderBy("_b")
    ends = ends.select(*keys, "_b", F.lag("_end").over(past).alias("_end"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = rows.withColumns({"_before": F.lag("_own").over(inside), "_first": F.row_number().over(inside) == 1}).join(ends, [*keys, "_b"])
    last = F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_before"))
    return out.withColumns({n: last[n] for n in values}).drop("_b", "_own", "_before", "_first", "_end")


def peak_before(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column, bucket: Column | None = None) -> DataFrame:
    """``df`` with the largest ``value`` of the key's rows before each: inside the bucket, or of the buckets before (``bucket`` as in ``previous``)."""
    rows = df.withColumns({"_b": bucket_of(order[0]) if bucket is None else bucket, "_own": value})
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(*keys, "_b").agg(F.max("_own").alias("_top")).select(*keys, "_b", F.max("_top").over(past).alias("_top"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn(name, F.max("_own").over(inside)).join(tops, [*keys, "_b"])
    return out.withColumn(name, F.greatest(name, "_top")).drop("_b", "_own", "_top")


def islands(df: DataFrame, keys: list[str], start: str, end: str, name: str = "island") -> DataFrame:
    """Number the runs of rows whose start equals the previous row's end."""
    w = Window.partitionBy(*keys, "_b").orderBy(start)
    begins = F.when(F.lag(end).over(w) == F.col(start), 0).otherwise(1)
    rows = without_halo(with_halo(df, keys, [start], 1).withColumn("_new", begins))
    return running(rows, keys, [start], {name: F.col("_new").cast("long")}).drop("_new")


def sorted_fold(rows: DataFrame, key: list[str], order: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """A fold of each key in order.  Rows arrive sorted in Arrow batches; ``make()`` gives a function of a row (named tuple) that
    returns the tuples it emits, and what it remembers is all that a task keeps, however long the key."""
    fields = StructType.fromDDL(schema).fieldNames()
    width = len(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = None, None
        for pdf in frames:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if step is None or r[:width] != at:
                    at, step = r[:width], make()
                out.extend(step(r))
            yield pd.DataFrame(out, columns=fields)

    names = [*key, *order, *(c for c in rows.columns if c not in (*key, *order))]
    return rows.select(*names).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def carried(summaries: DataFrame, keys: list[str], order: str, schema: str, start: Callable[[tuple], object], step: Callable[[object, tuple], object]) -> DataFrame:
    """``summaries(keys, order, ...)``, one row per bucket -> ``schema``: keys, order and the state before that bucket.

    ``start(row)`` is the state before a key's first bucket, ``step(state, row)`` the state after a bucket; a state is a tuple."""

    def make():
        state = None

        def one(r):
            nonlocal state
            before = start(r) if state is None else state
            state = step(before, r)
            return [(*r[: len(keys) + 1], *before)]

        return one

    return sorted_fold(summaries, keys, [order], schema, make)
