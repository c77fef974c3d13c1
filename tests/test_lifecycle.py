"""Lifecycle rules by example."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.operators import control, intake, lifecycle, schedule
from tidemark.sources import catalog

DAY = dt.datetime(2024, 3, 4)
ZONE = [{"zone_id": "a", "lower": 100.0, "upper": 110.0, "tolerance": 1.0}]
OTHER = [{"zone_id": "b", "lower": 120.0, "upper": 130.0, "tolerance": 1.0}]
OBS = "instrument string, ts timestamp_ntz, direction string, regime string, status string, price double, zones array<struct<zone_id: string, lower: double, upper: double, tolerance: double>>"


def seen(spark, steps):
    rows = [("X", DAY + dt.timedelta(minutes=i), d, g, s, p, z) for i, (d, g, s, p, z) in enumerate(steps)]
    return spark.createDataFrame(rows, OBS)


def events(df):
    return [r.event for r in sorted(df.collect(), key=lambda r: r.ts)]


def test_all_ten_episode_events(spark):
    long, q, out = ("LONG", "r"), "qualified", "not_at_location"
    steps = [
        (*long, out, 90.0, []), (*long, "missing_evidence", None, []), (*long, q, 105.0, ZONE), (*long, q, 106.0, ZONE), (*long, out, 110.5, []), (*long, out, 115.0, []), (*long, out, 116.0, []),
        (*long, out, 98.0, []), (*long, q, 125.0, OTHER), (*long, out, 118.0, []), (*long, out, 117.0, []), (*long, out, 116.0, []),
    ]
    got = events(lifecycle.episodes(seen(spark, steps), 2, 2))
    assert got == ["no_episode", "evidence_gap", "entered", "active", "departure_unresolved", "favorable_departure", "rejected", "exit_pending", "replaced", "exit_pending", "exited", "no_episode"]


def test_an_episode_ends_with_its_direction_or_regime(spark):
    steps = [("LONG", "r", "qualified", 105.0, ZONE), ("SHORT", "r", "not_at_location", 105.0, []), ("SHORT", "r", "qualified", 105.0, ZONE), ("SHORT", "r2", "qualified", 105.0, ZONE), ("SHORT", "r2", "not_at_location", 95.0, [])]
    got = sorted(lifecycle.episodes(seen(spark, steps), 1, 3).collect(), key=lambda r: r.ts)
    assert [r.event for r in got] == ["entered", "exited", "entered", "replaced", "favorable_departure"]
    assert got[1].ended_episode_id == got[0].episode_id and got[3].ended_episode_id == got[2].episode_id


def test_a_repeated_observation_gets_the_same_decision_and_another_fails(spark):
    one = seen(spark, [("LONG", "r", "qualified", 105.0, ZONE)])
    got = lifecycle.episodes(one.union(one), 1, 1).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].event == "entered"
    with pytest.raises(Exception, match="conflicting observation"):
        lifecycle.episodes(one.union(seen(spark, [("LONG", "r", "qualified", 106.0, ZONE)])), 1, 1).collect()


def test_runtime_arms_expires_suppresses_and_releases(spark):
    rows = [(0, "entered", "e0", None), (10, "entered", "e1", None), (20, "active", "e1", None), (200, "active", "e1", None), (210, "active", "e1", None), (220, "replaced", "e2", "e1"), (230, "exited", "e2", "e2")]
    df = spark.createDataFrame([("X", DAY + dt.timedelta(minutes=m), e, i, x) for m, e, i, x in rows], "instrument string, ts timestamp_ntz, event string, episode_id string, ended_episode_id string")
    from pyspark.sql import functions as F

    got = lifecycle.runtime(df, F.lit(DAY).cast("timestamp_ntz"), 3600).collect()
    assert [(r.action, r.episode_id) for r in sorted(got, key=lambda r: r.ts)] == [
        ("stale", None), ("armed", "e1"), ("expired", "e1"), ("suppressed", "e1"), ("suppressed", "e1"), ("released", "e1"), ("armed", "e2"), ("invalidated", "e2")]


def test_a_batch_with_two_contents_of_one_id_fails(spark, tmp_path):
    rows = [("f", "h1", "X", "1h", DAY), ("f", "h2", "X", "1h", DAY)]
    df = spark.createDataFrame(rows, "feature_id string, content_hash string, instrument string, timeframe string, as_of timestamp_ntz")
    with pytest.raises(Exception, match="conflicting"):
        catalog.append_features(df, str(tmp_path / "features"))
    catalog.append_features(df.where("content_hash = 'h1'").union(df.where("content_hash = 'h1'")), str(tmp_path / "ok"))
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 1


def test_ledger_identities_do_not_collide(spark, tmp_path):
    schema = "run_id string, event_id string, sequence bigint, payload string"
    path = str(tmp_path / "ledger")
    catalog.append_ledger(spark.createDataFrame([("r", "e", 1, "a")], schema), path, spark)
    catalog.append_ledger(spark.createDataFrame([("r", "e", 1, "a"), ("r", "f", 2, "b")], schema), path, spark)
    assert spark.read.schema(schema).parquet(path).count() == 2
    with pytest.raises(Exception, match="collision"):
        catalog.append_ledger(spark.createDataFrame([("r", "e", 1, "other")], schema), path, spark)


def test_bounded_store_evicts_the_oldest(spark):
    at = lambda m: DAY + dt.timedelta(minutes=m)
    rows = [("X", 1, at(1), "a"), ("X", 2, at(2), "b"), ("X", 3, at(2), "b"), ("X", 4, at(2), "c"), ("X", 5, at(3), "d"), ("X", 6, at(1), "a")]
    df = spark.createDataFrame(rows, "instrument string, arrival bigint, open_ts timestamp_ntz, payload string")
    got = sorted(intake.bounded_store(df, ["instrument"], 2, "instrument string").collect(), key=lambda r: r.arrival)
    assert [r.status for r in got] == ["ACCEPTED", "ACCEPTED", "DUPLICATE", "CONFLICT", "ACCEPTED", "ACCEPTED"]
    assert [r.evicted_ts for r in got] == [None, None, None, None, at(1), at(1)]


def test_flush_keeps_equal_times_together(spark):
    rows = [("s", DAY + dt.timedelta(seconds=t)) for t in [0, 0, 1, 2, 2, 2, 2, 3]]
    got = control.flush_chunks(spark.createDataFrame(rows, "k string, t timestamp_ntz"), ["k"], "t", 3, "k string, t timestamp_ntz").collect()
    assert [(r.n, r.chunk) for r in sorted(got, key=lambda r: r.t)] == [(2, 0), (1, 0), (4, 1), (1, 2)]


def test_calendar_clips_suppresses_and_overrides(spark):
    d = lambda n: dt.datetime(2024, 3, n)
    at = lambda n, h: dt.datetime(2024, 3, n, h)
    plan = spark.createDataFrame([(d(4), at(4, 14), at(4, 21)), (d(5), at(5, 14), at(5, 18))], "trade_date timestamp_ntz, market_open timestamp_ntz, market_close timestamp_ntz")
    over = spark.createDataFrame([(d(9), "RTH", "10:00", "12:00", 0)], "trade_date timestamp_ntz, phase string, start string, end string, start_day_offset int")
    got = schedule.provider_calendar(plan, [schedule.Phase("RTH", "09:30", "16:00"), schedule.Phase("CURB", "16:15", "17:00")], over, "America/New_York").collect()
    assert sorted((r.trade_date.day, r.phase, r.open_ts.isoformat(), r.close_ts.isoformat()) for r in got) == [
        (4, "CURB", "2024-03-04T21:15:00", "2024-03-04T22:00:00"), (4, "RTH", "2024-03-04T14:30:00", "2024-03-04T21:00:00"), (5, "RTH", "2024-03-05T14:30:00", "2024-03-05T18:00:00"), (9, "RTH", "2024-03-09T15:00:00", "2024-03-09T17:00:00")]


def test_guards_fail_only_on_what_was_asked(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import joins

    left, right = spark.range(3).select(F.col("id").alias("k")), spark.createDataFrame([(0, 5), (1, 6), (9, 7), (9, 8)], "k bigint, replacement bigint")
    assert joins.unique_lookup(left, right, ["k"], strict=True).count() == 2  # 9 is ambiguous, but nobody asks for it
    with pytest.raises(Exception, match="several candidates"):
        joins.unique_lookup(left.union(spark.range(9, 10)), right, ["k"], strict=True).count()
    assert control.require_none(control.uncovered(spark.range(2), spark.range(5), ["id"]), "missing: ").count() == 0
    with pytest.raises(Exception, match="missing: "):
        control.require_none(control.uncovered(spark.range(6), spark.range(5), ["id"]), "missing: ").collect()


def test_recent_identities_are_renewed_and_forgotten(spark):
    from tidemark.operators import reports

    ids = [1, 2, 1, 3, 2, 4, 1]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(ids)], "stream string, seq bigint, identity bigint")
    got = sorted(reports.recent_identities(df, "stream", "seq", "identity", 2, "stream string, seq bigint, identity bigint").collect(), key=lambda r: r.seq)
    # 1 2 | 1 again | 3 pushes 2 out | 2 pushes 1 out | 4 pushes 3 out | 1 is forgotten
    assert [r.duplicate for r in got] == [False, False, True, False, False, False, False]


def test_interactions_keep_clusters_of_their_direction(spark):
    decided = lifecycle.episodes(seen(spark, [("LONG", "r", "qualified", 105.0, ZONE), ("LONG", "r", "qualified", 106.0, ZONE)]), 1, 1)
    clusters = [{"cluster_id": "c1", "direction": "LONG"}, {"cluster_id": "c2", "direction": "SHORT"}, {"cluster_id": "c0", "direction": "LONG"}]
    q = spark.createDataFrame([("X", DAY, "LONG", "c1", clusters), ("X", DAY + dt.timedelta(minutes=1), "LONG", "c2", clusters)], "instrument string, ts timestamp_ntz, direction string, selected string, clusters array<struct<cluster_id: string, direction: string>>")
    got = sorted(lifecycle.interactions(decided, q).collect(), key=lambda r: r.ts)
    assert [(r.cluster_ids, r.selected_cluster, r.reason) for r in got] == [("c0,c1", "c1", "location_entered"), ("c0,c1", None, "location_active")]


def test_halo_windows_equal_whole_windows(spark):
    """Sparse and dense days, ties in time: the bucketed helpers give what a window over the whole key gives."""
    import random

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from tidemark.functions import carry

    r = random.Random(1)
    rows = [("AB"[r.randrange(2)], DAY + dt.timedelta(hours=r.choice([0, 1, 2, 30, 31, 200, 201, 202, 500]), minutes=r.randrange(3)), i, r.randrange(100)) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, i bigint, v bigint")
    w = Window.partitionBy("k").orderBy("ts", "i")
    want = {x.i: (x.a, x.b, x.c) for x in df.select("i", F.lag("v", 3).over(w).alias("a"), F.sum("v").over(w).alias("b"), F.row_number().over(w).alias("c")).collect()}
    b = Window.partitionBy("k", "_b").orderBy("ts", "i")
    near = carry.with_halo(df, ["k"], ["ts", "i"], 3).withColumn("a", F.lag("v", 3).over(b)).withColumn("c", F.col("_before") + F.count_if(~F.col("_halo")).over(b))
    got = carry.running(carry.without_halo(near), ["k"], ["ts", "i"], {"b": F.col("v")})
    assert {x.i: (x.a, x.b, x.c) for x in got.collect()} == want
