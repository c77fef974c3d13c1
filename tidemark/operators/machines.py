"""State machines whose next state depends on their own last state: one fold per key, bounded by the key's own events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.carry import carried, sorted_fold


def table_machine(rows: DataFrame, key: str, order: str, event: str, start: str, moves: dict[tuple[str, str], str], chunk: int = 1024) -> DataFrame:
    """A finite machine given by its table (state, event) -> state; unknown moves keep the state.

    A table machine composes: the events of a key whose ``order`` number lies in one chunk are a map of states to states, only the
    state passes from chunk to chunk, and inside a chunk the states follow from the one it began with."""
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    index = {s: i for i, s in enumerate(states)}
    events = sorted({e for _, e in moves})

    def move(at: Column, e: Column) -> Column:
        out = at
        for name in events:
            row = F.array(*(F.lit(index[moves.get((st, name), st)]) for st in states))
            out = F.when(e == name, F.element_at(row, at + 1)).otherwise(out)
        return out

    kind = rows.schema[key].dataType.simpleString()
    item = F.struct(F.col(order).alias("o"), F.col(event).alias("e"))
    packed = rows.withColumn("_b", F.floor(F.col(order) / chunk)).groupBy(key, "_b").agg(F.sort_array(F.collect_list(item)).alias("xs"))
    same = F.array(*map(F.lit, range(len(states))))
    maps = packed.select(key, "_b", F.aggregate("xs", same, lambda m, x: F.transform(m, lambda s: move(s, x["e"]))).alias("m"))
    before = carried(maps, [key], "_b", f"{key} {kind}, _b bigint, _s int", lambda r: (index[start],), lambda s, r: (int(r[2][s[0]]),))
    trace = F.aggregate("xs", F.array("_s"), lambda t, x: F.concat(t, F.array(move(F.element_at(t, -1), x["e"]))))
    traced = packed.join(before, [key, "_b"]).withColumn("t", trace)
    steps = F.expr("transform(xs, (x, i) -> struct(x.o AS o, x.e AS e, t[i] AS f, t[i + 1] AS s))")
    name = lambda i: F.element_at(F.array(*map(F.lit, states)), i + 1)
    return traced.select(key, F.explode(steps).alias("z")).select(key, F.col("z.o").alias(order), F.col("z.e").alias(event), name(F.col("z.f")).alias("from_state"), name(F.col("z.s")).alias("to_state"))


def fold(rows: DataFrame, key: str, order: str, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """General fold: ``make()`` gives a function of a row (named tuple) that returns the tuples it emits."""
    return sorted_fold(rows, [key], [order], schema, make)


def approach_alerts(rows: DataFrame, near: float, again: float) -> DataFrame:
    """``rows(instrument, ts, distance)``: fire when the distance falls within ``near``, re-arm beyond ``again``.

    Both marks are known per row, so the last mark seen decides: a window, not a fold."""
    w = Window.partitionBy("instrument").orderBy("ts")
    mark = F.when(F.col("distance") <= near, 1).when(F.col("distance") > again, 0)
    last = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("fired", (F.col("distance") <= near) & (F.coalesce(last, F.lit(0)) == 0))


def suppress_repeats(rows: DataFrame, keys: list[str], order: str, kind: str, kinds: list[str]) -> DataFrame:
    """Drop a row of the listed kinds when the row before had the same kind."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_p", F.lag(kind).over(w)).where(~(F.col(kind).isin(kinds) & F.col(kind).eqNullSafe(F.col("_p")))).drop("_p")


def percent_change(current: Column, previous: Column) -> Column:
    return F.round(F.when(previous != 0, 100 * (current - previous) / F.abs(previous)), 6)


def monotone_latest(rows: DataFrame, key: str, ts: str, *arrival: str) -> DataFrame:
    """Watchlist state: the newest observation by event time, and how many arrived after a newer one.  ``arrival`` must leave no ties."""
    w = Window.partitionBy(key).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    late = rows.withColumn("_late", F.col(ts) < F.max(ts).over(w))
    return late.groupBy(key).agg(F.max(ts).alias("latest_ts"), F.count_if("_late").alias("out_of_order"), F.count(F.lit(1)).alias("observations"))


def acceptance(checks: DataFrame) -> DataFrame:
    """``checks(name, ok)`` and one verdict row."""
    return checks.unionByName(checks.agg(F.lit("verdict").alias("name"), F.bool_and("ok").alias("ok")))
