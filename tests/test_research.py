"""Carry helpers, direction by policy, renames and locations by example."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions import ahead, carry
from tidemark.operators import direction, location, research

START = dt.datetime(2024, 1, 1)


def test_previous_rows_and_peaks_match_whole_windows(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), START + dt.timedelta(hours=r.randrange(400)), i, r.choice([None, *range(9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq bigint, x bigint").repartition(5)
    got = {(g.k, g.seq): g.before for g in carry.previous(df, ["k"], ["ts", "seq"], {"before": F.col("x")}).collect()}
    top = {(g.k, g.seq): g.top for g in carry.peak_before(df, ["k"], ["ts", "seq"], "top", F.col("x")).collect()}
    for k in "ab":
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: (x[1], x[2]))
        for i, x in enumerate(mine):
            assert got[k, x[2]] == (mine[i - 1][3] if i else None)
            assert top[k, x[2]] == max((y[3] for y in mine[:i] if y[3] is not None), default=None)


def test_definitions_judge_the_same_evidence_differently(spark):
    e = [("X", START, "1h", 1), ("X", START, "4h", 2), ("X", START, "1d", -2), ("Y", START, "1h", 1), ("Y", START, "4h", None), ("Y", START, "1d", 2)]
    evidence = spark.createDataFrame(e, "instrument string, ts timestamp_ntz, timeframe string, score int")
    definitions = spark.createDataFrame([("a", 1, 1, "degrade"), ("b", 1, 0, "veto"), ("c", 2, 1, "ignore")], "definition string, minimum_score int, minimum_confirmations int, opposing string")
    roles = [(d, t, r) for d in "abc" for t, r in (("1h", "evaluation"), ("4h", "primary"), ("1h", "confirmation"), ("1d", "context"))]
    got = direction.qualify_by_policy(evidence, definitions, spark.createDataFrame(roles, "definition string, timeframe string, role string")).collect()
    assert {(g.instrument, g.definition): (g.status, g.direction, g.is_degraded) for g in got} == {
        ("X", "a"): ("qualified", "LONG", True), ("X", "b"): ("vetoed", None, False), ("X", "c"): ("neutral", None, False),
        ("Y", "a"): ("missing_evidence", None, False), ("Y", "b"): ("missing_evidence", None, False), ("Y", "c"): ("missing_evidence", None, False)}


def test_files_that_swapped_moved_or_share_their_content(spark):
    records = spark.createDataFrame([("a", "1", "A"), ("b", "2", "B"), ("c", "3", "C"), ("d", "4", "D"), ("e", "4", "E"), ("f", "", "F"), ("g", "7", "G"), ("g", "8", "H")], "path string, sha string, note string")
    found = spark.createDataFrame([("a", "2"), ("b", "1"), ("z", "3"), ("y", "4"), ("x", "9"), ("f", "6"), ("g", "7")], "path string, sha string")
    got = {g.path: (g.status, g.previous_path, g.note) for g in research.synced_references(records, found, ["note"]).collect()}
    assert got == {
        "a": ("changed", None, None), "b": ("changed", None, None), "z": ("renamed", "c", "C"), "y": ("ambiguous", None, None), "x": ("new", None, None),
        "f": ("kept", None, "F"), "g": ("duplicate", None, None), "d": ("missing", None, "D"), "e": ("missing", None, "E")}


def test_value_area_grows_to_the_heavier_side_and_down_on_ties():
    assert location.value_area_of({0: 10, 1: 10, 2: 100, 3: 10, 4: 10}) == (2, 2, 2)
    assert location.value_area_of({0: 10, 1: 20, 2: 40, 3: 20, 4: 10}) == (2, 1, 3)
    assert location.value_area_of({0: 5, 3: 5}) == (3, 0, 3) and location.value_area_of({7: 0}) == (7, 7, 7)


def test_first_rows_above_match_a_scan():
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 65, 300):
        x, y, start = r.integers(0, 12, n), r.integers(0, 12, n), r.integers(0, n + 1, 40)
        least, beyond, stop = r.integers(-1, 14, 40), r.integers(-1, 14, 40), np.minimum(start + r.integers(0, n + 1, 40), n)
        want = [next((i for i in range(s, n) if x[i] >= a and y[i] > b), n) for s, a, b in zip(start, least, beyond)]
        assert ahead.FirstAbove(x, y).find(start, least, beyond).tolist() == want
        assert ahead.range_max(x, start, stop, -9).tolist() == [max(x[i:j], default=-9) for i, j in zip(start, stop)]


def test_outcomes_do_not_list_the_pairs_of_a_window(spark):
    """Thousands of trades and openings in one window: no join over what lies ahead, and the results of a scan."""
    from tidemark.operators import signals

    n = 3000
    r = random.Random(8)
    price = [Decimal(r.randrange(5_000, 6_000)) / 100 for _ in range(n)]
    rows = [("X", START + dt.timedelta(seconds=i // 2), i, price[i]) for i in range(n)]
    trades = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq bigint, price decimal(18,6)")
    opened = trades.select(F.col("seq").alias("id"), "instrument", "ts", "price", F.lit(-1).alias("sign"))
    got = signals.first_hit(opened, trades, 9.0, 3600)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    want = {}
    for i in range(n):
        move = next((price[i] - price[j] for j in range(i + 1, n) if abs(price[j] - price[i]) >= 9), None)
        want[i] = "unresolved" if move is None else "with_flow" if move > 0 else "trapped"
    assert {g.id: g.outcome for g in got.collect()} == want


def test_outcomes_of_aggression_match_a_scan(spark):
    r = random.Random(5)
    at = lambda s: START + dt.timedelta(seconds=s)
    times = sorted(r.randrange(3_000) for _ in range(400))
    rows, cvd = [], 0
    for i, s in enumerate(times):
        cvd += r.choice((-3, 1, 2))
        rows.append(("X", at(s), i, Decimal(r.randrange(50, 75)), Decimal(cvd)))
    trades = spark.createDataFrame(rows, "instrument string, ts timestamp_ntz, seq bigint, price decimal(18,6), cvd decimal(38,6)")
    side = lambda i: 1 if i % 2 else -1
    opened = trades.where("seq % 3 = 0").select(F.col("seq").alias("id"), "instrument", "ts", "seq", "price", F.when(F.col("seq") % 2 == 1, 1).otherwise(-1).alias("side"))
    got = {g.id: g for g in research.aggression_outcomes(opened, trades, 600, 20.0, 15.0, 4.0, 1000).collect()}
    assert sorted(got) == list(range(0, 400, 3))
    for i, g in got.items():
        seen, end = {}, None
        for x in rows[i + 1 :]:
            if rows[i][1] < x[1] <= rows[i][1] + dt.timedelta(seconds=600):
                seen.setdefault(x[1], x)
        moves = []
        for x in seen.values():
            move, flow = side(i) * (x[3] - rows[i][3]), side(i) * (x[4] - rows[i][4])
            moves.append(move)
            end = "with_flow" if move >= 20 and flow > 0 else "trapped" if move <= -15 and flow < 0 else None
            if end:
                break
        best, worst = max([0, *moves]), max([0, *(-m for m in moves)])
        over = "pending" if rows[-1][1] < rows[i][1] + dt.timedelta(seconds=600) else "absorbed" if max(best, worst) <= 4 else "unresolved"
        assert (g.outcome, g.favourable, g.adverse, g.n_trades) == (end or over, best, worst, len(moves))
        assert g.ended_ts == (x[1] if end else None if over == "pending" else rows[i][1] + dt.timedelta(seconds=600))


def test_equal_arrivals_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """Event 10007 arrives under the number of event 0: the id decides, whichever row a file or a partition has first."""
    from tidemark.plans import library
    from tidemark.streaming.bars import EVENTS

    rows = [(i, START + dt.timedelta(hours=h), 1, "click", 1.0, '{"k": 1}') for i, h in ((0, 9), (10007, 3), (20014, 5), (1, 4))]
    for k, some in enumerate((rows, rows[::-1], [rows[i] for i in (1, 0, 3, 2)])):
        path = str(tmp_path / str(k))
        spark.createDataFrame(some, EVENTS).coalesce(1).write.parquet(f"{path}/events.parquet")
        w, t = library.QUERIES["watchlist_state"](spark, path).first(), library.QUERIES["late_trade_counts"](spark, path).first()
        assert (w.out_of_order, w.observations, t.late, t.n) == (3, 4, 3, 4)
