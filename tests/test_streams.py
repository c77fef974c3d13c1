"""Keyed stream state: any split into runs gives the batch's result, and what a key holds is bounded."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.streaming import bars, state

HOUR = dt.timedelta(hours=1)
START = dt.datetime(2024, 1, 1)
BAR = "instrument string, arrival bigint, open_ts timestamp_ntz, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(18,6)"


def bar(i, hour, close=1.0, instrument="X"):
    return (instrument, i, START + hour * HOUR, *map(Decimal, (1, 5, 0)), Decimal(str(close)), Decimal(2))


def run(spark, tmp_path, rows, build, parts, schema=BAR, **more):
    path = str(tmp_path / f"out{parts}")
    bars.drain_in_parts(spark.createDataFrame(rows, schema), build, path, "arrival", parts, **more)
    return spark.read.parquet(path)


def test_accumulation_over_runs(spark, tmp_path):
    """Late, double and conflicting bars, a bucket that expires, one that is opened anew after it was full."""
    rows = [bar(0, 0), bar(1, 1), bar(2, 1), bar(3, 1, 2.0), bar(4, 3), bar(5, 2, 9.0), bar(6, 0), bar(7, 5), bar(8, 9), bar(9, 13), bar(10, 4)]
    want = ["HELD", "HELD", "DUPLICATE", "CONFLICT", "HELD", "COMPLETED", "HELD", "HELD", "HELD", "HELD", "HELD"]
    for parts in (1, 4):
        got = sorted(run(spark, tmp_path, rows, lambda r: state.accumulated_stream(r, 3600, 14_400, 2), parts).collect(), key=lambda r: r.arrival)
        assert [r.status for r in got] == want
        full = got[5]
        assert (full.bucket_ts, full.open, full.close, full.volume) == (START, 1, 1, 8) and full.high == 5
        assert [r.expired_ts for r in got if r.expired_ts] == [START, START + 4 * HOUR, START + 4 * HOUR]


def test_what_an_accumulator_holds_is_bounded(spark, tmp_path):
    class Kept:
        def exists(self):
            return hasattr(self, "rows")

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

        def clear(self):
            self.__dict__.pop("rows", None)

    import pandas as pd

    a = state.Accumulator(4, 3)
    a.held = Kept()
    for n in range(50):
        frame = pd.DataFrame([(n * 9 + i, (n * 9 + i) * 4, (n * 9 + i) * 4, *[Decimal(1)] * 5) for i in range(9)], columns=["arrival", "at", "bucket", *state.VALUES])
        list(a.handleInputRows(("X",), iter([frame]), None))
        assert len(a.held.rows) <= 3 * 4


def test_a_bar_of_an_earlier_bucket_is_late(spark, tmp_path):
    rows = [bar(i, h) for i, h in enumerate([0, 1, 2, 3, 4, 1, 8])]
    got = run(spark, tmp_path, rows, lambda r: state.forward_stream(r, 3600, 14_400), 3).collect()
    assert sorted((r.status, r.bucket_ts) for r in got) == [("COMPLETED", START), ("INCOMPLETE", START + 4 * HOUR), ("LATE", START)]


def test_seeds_continue_an_unfinished_bucket_only(spark, tmp_path):
    columns = "instrument string, open_ts timestamp_ntz, " + BAR.split("timestamp_ntz, ")[1]
    drop = lambda b: (b[0], *b[2:])
    for k, (warm, want) in enumerate([([0, 1, 2], {("COMPLETED", START), ("INCOMPLETE", START + 4 * HOUR)}), ([0, 1], {("INCOMPLETE", START), ("INCOMPLETE", START + 4 * HOUR)})]):
        seed = spark.createDataFrame([drop(bar(0, h)) for h in warm], columns)
        got = run(spark, tmp_path / str(k), [bar(1, 3), bar(2, 4), bar(3, 8)], lambda r, seed=seed: state.forward_stream(r, 3600, 14_400, seed), 2).collect()
        assert {(r.status, r.bucket_ts) for r in got} == want
    full = spark.createDataFrame([drop(bar(0, h)) for h in range(4)], columns)
    got = run(spark, tmp_path / "full", [bar(1, 4), bar(2, 8)], lambda r: state.forward_stream(r, 3600, 14_400, full), 1).collect()
    assert [(r.status, r.bucket_ts) for r in got] == [("INCOMPLETE", START + 4 * HOUR)]


def test_a_session_book_does_not_depend_on_the_order(spark, tmp_path):
    schema = BAR.replace("open_ts", "session timestamp_ntz, kind int, cutoff timestamp_ntz, open_ts")
    rows = []
    for day in range(6):
        s = START + day * 24 * HOUR
        for h in range(6):
            b = bar(0, day * 24 + h, h)
            rows.append((b[0], 0, s, 0, s + 3 * HOUR, *b[2:]))
            rows.append((b[0], 0, s, 1, None, *b[2:-2], b[-2] + 100, b[-1]))
    books = []
    for k, order in enumerate([lambda i: i, lambda i: -i, lambda i: i * 37 % 71]):
        moved = [(r[0], order(i), *r[2:]) for i, r in enumerate(rows)]
        versions = run(spark, tmp_path / str(k), moved, lambda r: state.session_book_stream(r, 3, 48), k + 1, schema)
        books.append(sorted(map(tuple, state.latest_versions(versions.drop("batch")).collect())))
    assert books[0] == books[1] == books[2]
    assert [r[1] for r in books[0]] == [START + d * 24 * HOUR for d in (3, 4, 5)]
    assert all(r[6] == 12 and r[5] == 105 and r[7] == 6 for r in books[0])


def test_the_ledger_remembers_over_runs(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x"), ("a", 5, "x"), ("a", 6, "y")]
    path = str(tmp_path / "ledger")
    df = spark.createDataFrame(rows, "key string, seq bigint, payload string")
    for i, part in enumerate(("seq <= 3", "seq > 3")):
        df.where(part).write.parquet(f"{path}-in/{i}")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}-in")
        bars.drain(state.ledger_stream(stream), path, idle_batches=False)
    got = spark.read.parquet(path).select("seq", "status").collect()
    assert dict(map(tuple, got)) == {1: "ACCEPTED", 2: "DUPLICATE", 3: "CONFLICT", 4: "ACCEPTED", 5: "DUPLICATE", 6: "CONFLICT"}


def test_final_bars_are_appended_once(spark, tmp_path):
    schema = "instrument string, ts timestamp, seq bigint, price decimal(18,6), size decimal(18,6)"
    at = lambda m: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(minutes=m)
    rows = [("X", at(m), i, Decimal(i), Decimal(1)) for i, m in enumerate([0, 30, 59, 60, 200])]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    bars.drain_final_bars(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 3600, 3600, str(tmp_path / "bars"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "bars")).select(F.hour("open_ts"), "n_trades").collect()))
    assert got == [(0, 3), (1, 1), (3, 1)]


def test_processors_bring_their_state_store(spark, tmp_path):
    """A session with Spark's default store, as a cluster's may be: five queries failed in it."""
    from tidemark.plans import streams

    name = "spark.sql.streaming.stateStore.providerClass"
    before, plain = spark.conf.get(name), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(name, plain)
    try:
        got = run(spark, tmp_path, [bar(0, 0), bar(1, 1), bar(2, 1)], lambda r: state.accumulated_stream(r, 3600, 14_400, 2), 2)
        assert sorted(r.status for r in got.collect()) == ["DUPLICATE", "HELD", "HELD"]
        events = spark.createDataFrame([(i, START, 1, "view", 1.0, "{}") for i in range(3)], bars.EVENTS)
        events.write.parquet(str(tmp_path / "sf" / "events.parquet"))
        assert sorted(r.status for r in streams.stream_ledger(spark, str(tmp_path / "sf")).collect()) == ["ACCEPTED", "CONFLICT", "CONFLICT"]
        assert spark.conf.get(name) == plain
    finally:
        spark.conf.set(name, before)


def test_a_ledger_key_works_on_rows():
    """Keys are many and their rows few, so no frame is built for a key."""
    from pyspark.sql import Row

    class Held:
        def exists(self):
            return hasattr(self, "value")

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    ledger = state.FirstAccepted(1000)
    ledger.first = Held()
    rows = [Row(key="a", seq=s, payload=p) for s, p in ((3, "y"), (1, "x"), (2, "x"), (4, None))]
    assert [tuple(r) for r in ledger.handleInputRows(("a",), iter(rows), None)] == [("a", 1, "ACCEPTED"), ("a", 2, "DUPLICATE"), ("a", 3, "CONFLICT"), ("a", 4, "CONFLICT")]
    assert [r.status for r in ledger.handleInputRows(("a",), iter([Row(key="a", seq=5, payload="x")]), None)] == ["DUPLICATE"]


def differs_in_a_plain_session(spark, tmp_path, name):
    """Rows of a query that differ from its SQL on a small table, in a session with Spark's default state store."""
    import collections

    import duckdb

    from tidemark.plans import library

    key, plain = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    sf = str(tmp_path / "sf")
    # two instruments over fifteen days, with hours that hold no event
    rows = [(i, START + i * dt.timedelta(minutes=27), i % 5, ("view", "click")[i % 2], i * 37 % 11 / 4, f'{{"k": {i % 4}}}') for i in range(800) if i % 13 > 1]
    spark.createDataFrame(rows, bars.EVENTS).write.parquet(f"{sf}/events.parquet")
    before = spark.conf.get(key)
    spark.conf.set(key, plain)
    try:
        df = library.QUERIES[name](spark, sf)
        got = collections.Counter(map(repr, map(tuple, df.collect())))
    finally:
        spark.conf.set(key, before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet/*.parquet'")
    want = collections.Counter(map(repr, con.sql(library.ORACLES[name]).select(", ".join(df.columns)).fetchall()))
    assert want
    return (got - want) + (want - got)


def test_bounded_observations_in_a_plain_session(spark, tmp_path):
    assert not differs_in_a_plain_session(spark, tmp_path, "stream_bounded_observations")


def test_seeded_bars_in_a_plain_session(spark, tmp_path):
    assert not differs_in_a_plain_session(spark, tmp_path, "stream_seeded_bars")


def test_accumulated_bars_in_a_plain_session(spark, tmp_path):
    assert not differs_in_a_plain_session(spark, tmp_path, "stream_accumulated_bars")


def test_the_session_book_in_a_plain_session(spark, tmp_path):
    assert not differs_in_a_plain_session(spark, tmp_path, "stream_session_book")
