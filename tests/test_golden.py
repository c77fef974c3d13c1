"""Small cases with known answers, and properties that hold for any input."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import timeops as T
from tidemark.operators import bars as B
from tidemark.operators import calendars as K
from tidemark.operators import flow, joins, maintenance, measurements, profile, signals
from tidemark.sources import catalog as C
from tidemark.streaming import bars as R

AT = dt.datetime(2024, 1, 2, 10)
TRADE = "instrument string, ts timestamp_ntz, seq bigint, price decimal(18,6), size decimal(18,6)"
QUOTE = "instrument string, ts timestamp_ntz, seq bigint, bid decimal(18,6), ask decimal(18,6)"
BAR = "instrument string, open_ts timestamp_ntz, close_ts timestamp_ntz, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(18,6)"


def sec(n):
    return AT + dt.timedelta(seconds=n)


def D(x):
    return Decimal(str(x))


def bars(spark, closes, seconds=60, spread=1, volumes=None, start=AT):
    rows = [("X", start + dt.timedelta(seconds=i * seconds), start + dt.timedelta(seconds=(i + 1) * seconds), D(c), D(c + spread), D(c - spread), D(c), D(volumes[i] if volumes else 10)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BAR)


def test_classification(spark):
    t = [("A", sec(1), 1, D(20000.5), D(1)), ("A", sec(1), 2, D(20000), D(1)), ("A", sec(2), 3, D(20000.25), D(1)), ("A", sec(9), 4, D(20000.25), D(1)), ("B", sec(0), 5, D(5), D(1)), ("C", sec(1), 6, D(5), D(1))]
    q = [("A", sec(1), 1, D(20000), D(20000.5)), ("B", sec(5), 2, D(4), D(6))]
    got = {r.seq: (r.side, r.reason) for r in flow.classify_trades(spark.createDataFrame(t, TRADE), spark.createDataFrame(q, QUOTE), 2).collect()}
    assert got == {1: ("BUY", "at_or_above_ask"), 2: ("SELL", "at_or_below_bid"), 3: ("BUY", "tick_up"), 4: ("UNKNOWN", "quote_stale"), 5: ("UNKNOWN", "no_quote_available"), 6: ("UNKNOWN", "no_quote_available")}


def test_as_of_carries_over_buckets_and_ignores_the_future(spark):
    left = spark.createDataFrame([("A", sec(90_000 * i), i) for i in range(1, 6)], "k string, ts timestamp_ntz, seq bigint")
    right = spark.createDataFrame([("A", sec(0), 0, 1.0), ("A", sec(200_000), 1, 2.0), ("B", sec(0), 2, 9.0)], "k string, ts timestamp_ntz, seq bigint, v double")
    got = [r.m.v for r in T.last_before(left, right, "k", "ts", "seq", "m", 3600).orderBy("seq").collect()]
    assert got == [1.0, 1.0, 2.0, 2.0, 2.0]


def test_bar_order_does_not_depend_on_row_order(spark):
    rows = [("X", sec(i % 50), i, D(100 + (i * 37) % 11), D(1)) for i in range(200)]
    a = B.build_bars(spark.createDataFrame(rows, TRADE), 60).collect()
    random.Random(1).shuffle(rows)
    assert a == B.build_bars(spark.createDataFrame(rows, TRADE).repartition(4), 60).collect()


def test_strict_aggregate(spark):
    b = bars(spark, [100 + i for i in range(12)], 5, start=AT).withColumn("health", F.lit("READY")).withColumn("evidence", F.array(F.date_format("open_ts", "ss")))
    r = B.utc_aggregate(b, 5, 60, strict=True).collect()
    assert len(r) == 1 and r[0].volume == 120 and r[0].fidelity == "DERIVED" and r[0].evidence.split(",") == [f"{i:02d}" for i in range(0, 60, 5)]
    with pytest.raises(Exception, match="incomplete bucket"):
        B.utc_aggregate(b.where(F.col("evidence")[0] != "05"), 5, 60, strict=True).collect()


def test_worst_health(spark):
    df = spark.createDataFrame([("a", "READY"), ("a", "STALE"), ("b", "READY")], "k string, h string")
    assert {r.k: r.w for r in df.groupBy("k").agg(T.worst(F.col("h")).alias("w")).collect()} == {"a": "STALE", "b": "READY"}


def test_completed_bar_metrics(spark):
    rows = [("X", AT, sec(60), D(100), D(101), D(99), D(100), D(1)), ("X", sec(60), sec(120), D(100), D(107), D(99), D(105), D(1))]
    a, b = measurements.completed_bar_metrics(spark.createDataFrame(rows, BAR)).orderBy("open_ts").collect()
    assert (a.health, a.simple_return, a.true_range) == ("WARMING", None, None) and (b.simple_return, b.true_range) == (0.05, 8.0)


def test_rolling_baseline(spark):
    r = measurements.recent_baseline(bars(spark, [100 + i for i in range(6)]), 60, 120, 2, 1.0, 2).orderBy("close_ts").collect()[-1]
    assert (r.price_range, r.reference_count, r.expansion_ratio, r.range_percentile) == (3.0, 2, 1.0, 0.5)
    w = measurements.rolling_windows(bars(spark, [100 + i for i in range(6)]), 60, 120, 1.0).orderBy("close_ts").collect()[-1]
    assert (w.average_true_range, w.directional_efficiency, w.coverage_ratio) == (2.0, 1.0, 1.0)


def test_volume_profile(spark):
    rows = [("X", sec(i), sec(i + 1), D(c), D(c), D(c), D(c), D(v)) for i, (c, v) in enumerate([(100, 10), (105, 100), (110, 10)])]
    r = profile.value_area(profile.profile_bins(spark.createDataFrame(rows, BAR), ["instrument"], 5), ["instrument"]).collect()[0]
    assert r.poc == 105 and r.total_volume == 120


def test_pressure_ratios(spark):
    rows = [("X", "BUY", "a", D(5)), ("X", "SELL", "b", D(2)), ("X", "UNKNOWN", "c", D(3))]
    r = flow.pressure(spark.createDataFrame(rows, "instrument string, side string, reason string, size decimal(18,6)"), ["instrument"]).collect()[0]
    assert (r.delta, r.classified_ratio, r.delta_ratio) == (3.0, 0.7, round(3 / 7, 6)) and r.reasons == "a=1;b=1;c=1"


def test_sequence_gap(spark):
    r = flow.sequence_gaps(spark.createDataFrame([("X", sec(0), 10), ("X", sec(1), 13), ("X", sec(2), 12)], "instrument string, ts timestamp_ntz, seq bigint"), ["instrument"]).collect()[0]
    assert (r.missing, r.jumps) == (2, 1)


def test_large_trade_cluster_resets_on_emission(spark):
    rows = [("X", sec(0) + dt.timedelta(milliseconds=100 * i), i, s, D(z)) for i, (s, z) in enumerate([("BUY", 30), ("BUY", 30), ("BUY", 30), ("UNKNOWN", 99), ("BUY", 30), ("BUY", 40)])]
    got = flow.large_trade_clusters(spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq bigint, side string, size decimal(18,6)"), 250, 60).collect()
    assert sorted((r.first_seq, r.last_seq, r.print_count) for r in got) == [(0, 1, 2), (4, 5, 2)]


def test_recency_profile(spark):
    r = signals.recency(spark.createDataFrame([("X", 1, 1000.0), ("X", 2, 2000.0)], "k string, o int, x double"), "k", "o", "x").collect()[0]
    assert (r["mean"], r["variance"]) == (1050.0, 47_500.0)


def test_episode_machine(spark):
    steps = [(True, 1), (True, 1), (True, 1), (False, 0), (True, -1), (True, -1), (True, -1)]
    rows = [("X", AT, sec(i), a, f) for i, (a, f) in enumerate(steps)]
    got = signals.episodes(spark.createDataFrame(rows, "instrument string, session timestamp_ntz, ts timestamp_ntz, inside boolean, favourable int"), 2).orderBy("ts").collect()
    assert [r.event for r in got] == ["entered", "confirmed", "exited", "entered", "rejected"]


def test_hysteresis(spark):
    rows = [("X", sec(i), v) for i, v in enumerate([9.0, 11.0, 11.0, 8.0, 4.0, 11.0, 4.0])]
    got = signals.hysteresis(spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double"), "k", "ts", "v", 10.0, 5.0, 2).orderBy("ts").collect()
    assert [(r.ts, r.event) for r in got] == [(sec(2), "raised"), (sec(4), "cleared")]


def test_gap_plan(spark):
    every = spark.createDataFrame([("X", sec(60 * i)) for i in range(10) if i != 5], "instrument string, open_ts timestamp_ntz")
    seen = spark.createDataFrame([("X", sec(60 * i)) for i in (0, 1, 4, 6, 8, 9)], "instrument string, open_ts timestamp_ntz")
    got = sorted((r.start_ts, r.end_ts, r.n) for r in maintenance.gap_plan(every, seen, 60, 1000).collect())
    assert got == [(sec(120), sec(240), 2), (sec(420), sec(480), 1)]


@pytest.mark.parametrize(("sign", "rows", "want"), [(1, [(102, 99, 101), (103, 98, 99), (101, 97, 98)], (-2.0, 3.0, 3.0)), (-1, [(102, 99, 99), (100, 96, 97)], (3.0, 4.0, 2.0))])
def test_forward_outcome(spark, sign, rows, want):
    b = spark.createDataFrame([("X", AT, i + 1, sec(i), D(h), D(lo), D(c)) for i, (h, lo, c) in enumerate(rows)], "instrument string, session timestamp_ntz, ordinal int, open_ts timestamp_ntz, high decimal(18,6), low decimal(18,6), close decimal(18,6)")
    e = spark.createDataFrame([("e", "X", AT, 0, 100.0, sign)], "event_id string, instrument string, session timestamp_ntz, ordinal int, reference double, sign int")
    got = {r.horizon: r for r in joins.forward_outcome(e, b, [len(rows), len(rows) + 1]).collect()}
    r = got[len(rows)]
    assert (r.ret, r.mfe, r.mae) == want and got[len(rows) + 1].reason == "bars_missing"


def test_break_subtraction(spark):
    w = spark.createDataFrame([(1, sec(0), sec(100)), (2, sec(0), sec(10))], "id int, open_ts timestamp_ntz, close_ts timestamp_ntz")
    b = spark.createDataFrame([(1, sec(20), sec(30)), (1, sec(50), sec(100)), (1, sec(200), sec(300))], "id int, open_ts timestamp_ntz, close_ts timestamp_ntz")
    got = sorted((r.id, r.open_ts, r.close_ts) for r in K.subtract(w, b).collect())
    assert got == [(1, sec(0), sec(20)), (1, sec(30), sec(50)), (2, sec(0), sec(10))]


def test_feature_store_refuses_conflicts(spark, tmp_path):
    f = spark.createDataFrame([("i", "h1", "X", "1h", AT)], "feature_id string, content_hash string, instrument string, timeframe string, as_of timestamp_ntz")
    C.append_features(f, f"{tmp_path}/f")
    stored = spark.read.parquet(f"{tmp_path}/f")
    assert C.append_features(f, f"{tmp_path}/f", stored).count() == 0
    with pytest.raises(Exception, match="conflicting feature"):
        C.append_features(f.withColumn("content_hash", F.lit("h2")), f"{tmp_path}/g", stored)


def test_reference_files(spark, tmp_path):
    schema = "id int, name string"
    (tmp_path / "a.csv").write_text("id,name\n1,x\n\n2,y\n")
    from pyspark.sql.types import StructType

    rows = C.read_reference(spark, str(tmp_path / "a.csv"), StructType.fromDDL(schema)).collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (2, "y")]
    (tmp_path / "b.csv").write_text("id,other\n1,x\n")
    with pytest.raises(Exception):  # noqa: B017
        C.read_reference(spark, str(tmp_path / "b.csv"), StructType.fromDDL(schema)).collect()
    C.write_jsonl(spark.createDataFrame(rows), f"{tmp_path}/j", ["id"])
    part = next((tmp_path / "j").glob("part-*"))
    assert part.read_text().splitlines() == ['{"id":1,"name":"x"}', '{"id":2,"name":"y"}']


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    rows = [(i, AT + dt.timedelta(minutes=7 * i), i % 5, ["a", "b"][i % 2], float(i % 13), '{"k": %d}' % (i % 9)) for i in range(300)]
    df = spark.createDataFrame(rows, R.EVENTS)
    for i in range(3):
        df.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    R.drain(R.bar_stream(R.event_stream(spark, f"{tmp_path}/in"), 3600, "1 hour"), f"{tmp_path}/out", "complete")
    k = F.get_json_object("props", "$.k").cast("long")
    batch = B.build_bars(df.select(F.col("event_type").alias("instrument"), "ts", F.col("event_id").alias("seq"), (100 + F.col("value")).cast(T.PRICE).alias("price"), (1 + k).cast(T.PRICE).alias("size")), 3600)
    cols = ["instrument", "open_ts", "open", "high", "low", "close", "volume", "n_trades"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))


def test_registry_and_settings(tmp_path):
    from tidemark.sources.config import Metric, Parameter, Registry, Settings, default_registry

    full = default_registry()
    assert len(full.metrics) == 3 + 7 + 27 + 2 * 11 + 13 + 3 * 11
    assert full.get("quote.midpoint").version == 1
    r = Registry().add(Metric("a"), Metric("a", 2), Metric("b", dependencies=("a",), parameters=(Parameter("n", Decimal(1), Decimal(9), Decimal(2)), Parameter("k", allowed=("x", "y")))))
    assert r.get("a").version == 2
    r.get("b").check({"n": Decimal(3), "k": "x"})
    for bad in ({"n": Decimal(2), "k": "x"}, {"n": Decimal(11), "k": "x"}, {"n": Decimal(3), "k": "z"}, {"n": Decimal(3)}):
        with pytest.raises(ValueError):
            r.get("b").check(bad)
    for metric in (Metric("a"), Metric("c", dependencies=("c",)), Metric("d", dependencies=("zz",))):
        with pytest.raises(ValueError):
            r.add(metric)
    (tmp_path / "s.toml").write_text("lookback_bars = 100\n")
    assert Settings.load(str(tmp_path / "s.toml")).lookback_bars == 100
    (tmp_path / "t.toml").write_text("nonsense = 1\n")
    with pytest.raises(ValueError):
        Settings.load(str(tmp_path / "t.toml"))
