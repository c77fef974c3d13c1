"""Timed execution of history requests by example."""

from __future__ import annotations

from types import SimpleNamespace

from tidemark.operators.acquisition import Lane, Policy, execute_requests

POLICY = Policy(capacity=4, in_flight=1, attempts=2, timeout=100, backoff=10)
SCHEMA = "lane string, at bigint, seq bigint, command string, request_id string, priority int, consumer string, minimum bigint, refused int, observed bigint, retry boolean, last boolean"


def command(at, name, request="r", **more):
    base = {"lane": "L", "at": at, "command": name, "request_id": request, "priority": 50, "consumer": "metric:test", "minimum": 2, "refused": 0, "observed": 0, "retry": True, "last": True}
    return SimpleNamespace(**(base | more))


def run(*commands, policy=POLICY):
    lane = Lane("L", policy)
    return [[(r[1], r[2], r[4], r[5]) if r[3] == "event" else (r[3], r[2], r[4], r[6]) for r in lane.settle(c)] for c in commands]


def test_higher_priority_first_and_the_next_after_completion():
    got = run(command(1, "enqueue", "low", priority=10, last=False), command(1, "enqueue", "high", priority=90), command(2, "complete", "high", observed=2))
    assert got[0] == [(1, "low", "QUEUED", 1)]
    assert got[1] == [(1, "high", "QUEUED", 1), (1, "high", "SUBMITTED", 1)]
    assert got[2] == [(2, "high", "COMPLETED", 1), ("result", "high", "READY", "metric:test"), (2, "low", "SUBMITTED", 1)]


def test_shared_requests_merge_consumers_and_judge_each_by_its_minimum():
    got = run(command(1, "enqueue", consumer="metric:a"), command(2, "enqueue", consumer="metric:b", minimum=4), command(2, "enqueue", consumer="metric:b", minimum=4), command(3, "complete", observed=3))
    assert got[1] == [(2, "r", "SHARED", 1)] and got[2] == []
    assert got[3] == [(3, "r", "COMPLETED", 1), ("result", "r", "READY", "metric:a"), ("result", "r", "DEGRADED", "metric:b")]


def test_a_refused_submission_waits_without_blocking_the_queue():
    got = run(command(1, "enqueue", "first", priority=90, refused=1, last=False), command(1, "enqueue", "second", priority=20), command(2, "complete", "second", observed=2), command(11, "advance"))
    assert got[1] == [(1, "second", "QUEUED", 1), (1, "first", "RETRY_SCHEDULED", 2), (1, "second", "SUBMITTED", 1)]
    assert got[3] == [(11, "first", "SUBMITTED", 2)]


def test_time_runs_out_twice():
    got = run(command(0, "enqueue"), command(100, "advance"), command(110, "advance"), command(210, "advance"))
    assert got[1] == [(100, "r", "RETRY_SCHEDULED", 2)] and got[2] == [(110, "r", "SUBMITTED", 2)]
    assert got[3] == [(210, "r", "EXPIRED", 2), ("result", "r", "EXPIRED", "metric:test")]
    late = run(command(0, "enqueue"), command(500, "advance"))
    assert late[1] == [*got[1], *got[2], *got[3]]  # deadlines are met in their order, however late the clock is read


def test_cancel_before_and_during_execution():
    got = run(command(1, "enqueue", "active", last=False), command(1, "enqueue", "pending"), command(2, "cancel", "pending"), command(3, "cancel", "active"), command(4, "cancel", "active"))
    assert got[2] == [(2, "pending", "CANCELED", 1), ("result", "pending", "CANCELED", "metric:test")]
    assert got[3] == [(3, "active", "CANCELED", 1), ("result", "active", "CANCELED", "metric:test")] and got[4] == []


def test_final_failure_reuse_and_capacity():
    got = run(command(1, "enqueue"), command(2, "fail", retry=False), command(3, "enqueue"), command(4, "complete"), *(command(5, "enqueue", f"q{i}") for i in range(5)))
    assert got[1] == [(2, "r", "FAILED", 1), ("result", "r", "FAILED", "metric:test")]
    assert got[2] == [("refused", "r", "ENDED", "metric:test")] and got[3] == [("refused", "r", "NOT_RUNNING", None)]
    assert got[8] == [("refused", "q4", "CAPACITY", "metric:test")]


def test_lanes_are_independent_in_spark(spark):
    rows = [(f"L{k}", 0, 0, "enqueue", "r", 1, "c", 2, 0, 0, True, True) for k in range(5)] + [(f"L{k}", 50 * k, 1, "complete", "r", 1, "c", 2, 0, k, True, True) for k in range(5)]
    got = execute_requests(spark.createDataFrame(rows, SCHEMA).repartition(3), POLICY).where("kind = 'result'").collect()
    # the third completes when its time has just run out, and waits again
    assert {(r.lane, r.state, r.attempt) for r in got} == {("L0", "DEGRADED", 1), ("L1", "DEGRADED", 1), ("L3", "READY", 2), ("L4", "READY", 2)}
