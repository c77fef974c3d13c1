"""Execution of history requests: a timed automaton for each lane of requests.

A lane's commands and the deadlines that they create are worked off in one order of time.  What a lane remembers are its waiting and running
requests, bounded by the policy's capacity, and the names of those that ended.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.functions.carry import sorted_fold

_OUT = "lane string, at bigint, request_id string, kind string, state string, attempt int, consumer string, observed bigint"


@dataclass(frozen=True)
class Policy:
    """``timeout`` and ``backoff`` in the unit of the commands' ``at``."""

    capacity: int = 64
    in_flight: int = 1
    attempts: int = 2
    timeout: int = 100
    backoff: int = 10


class _Request:
    def __init__(self, name: str, priority: int, ready_at: int):
        self.name, self.priority, self.ready_at = name, priority, ready_at
        self.attempt, self.due, self.consumers = 1, None, {}


class Lane:
    """One lane.  ``step(command)`` gives the rows that a command causes, those of deadlines up to its time first.

    Commands: enqueue (request, priority, consumer, minimum, refused: how many submissions the provider refuses), complete (observed), fail
    (retry or not), cancel, advance.  A deadline is the end of a running request's time or of a waiting request's backoff."""

    def __init__(self, name: str, policy: Policy):
        self.name, self.policy = name, policy
        self.waiting: dict[str, _Request] = {}
        self.running: dict[str, _Request] = {}
        self.ended: set[str] = set()
        self.refusals: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.now = 0

    def _event(self, at: int, r: _Request, state: str) -> None:
        self.rows.append((self.name, at, r.name, "event", state, r.attempt, None, None))

    def _end(self, at: int, r: _Request, state: str, observed: int = 0) -> None:
        self.ended.add(r.name)
        self._event(at, r, state)
        for consumer in sorted(r.consumers):
            verdict = state if state != "COMPLETED" else "READY" if observed >= r.consumers[consumer] else "DEGRADED"
            self.rows.append((self.name, at, r.name, "result", verdict, r.attempt, consumer, observed))

    def _again(self, at: int, r: _Request, state: str) -> None:
        if r.attempt >= self.policy.attempts:
            return self._end(at, r, state)
        r.attempt, r.ready_at, r.due = r.attempt + 1, at + self.policy.backoff, None
        self.waiting[r.name] = r
        self._event(at, r, "RETRY_SCHEDULED")

    def _dispatch(self, at: int) -> None:
        while len(self.running) < self.policy.in_flight:
            able = [(-r.priority, r.name) for r in self.waiting.values() if r.ready_at <= at]
            if not able:
                return
            r = self.waiting.pop(min(able)[1])
            if self.refusals.get(r.name, 0) > 0:
                self.refusals[r.name] -= 1
                self._again(at, r, "FAILED")
                continue
            r.due = at + self.policy.timeout
            self.running[r.name] = r
            self._event(at, r, "SUBMITTED")

    def _deadlines(self, until: int) -> None:
        """Ends of running requests up to a time and of backoffs before it, in order, those of one time by name."""
        while True:
            over = [(r.due, r.name) for r in self.running.values() if r.due <= until]
            free = len(self.running) < self.policy.in_flight
            ready = [r.ready_at for r in self.waiting.values() if max(r.ready_at, self.now) < until] if free else []
            if not over and not ready:
                return
            at = self.now = max(self.now, min([d for d, _ in over] + ready))
            for name in heapq.nsmallest(len(over), (n for d, n in over if d <= at)):
                self._again(at, self.running.pop(name), "EXPIRED")
            if at < until:
                self._dispatch(at)

    def step(self, c) -> list[tuple]:
        self.rows = []
        self._deadlines(c.at)
        self.now = c.at
        name, known = c.request_id, self.waiting.get(c.request_id) or self.running.get(c.request_id)
        if c.command == "enqueue":
            if known:
                if known.consumers.get(c.consumer, -1) < c.minimum:
                    known.consumers[c.consumer] = c.minimum
                    self._event(c.at, known, "SHARED")
            elif name in self.ended or len(self.waiting) + len(self.running) >= self.policy.capacity:
                self.rows.append((self.name, c.at, name, "refused", "ENDED" if name in self.ended else "CAPACITY", None, c.consumer, None))
            else:
                r = _Request(name, c.priority, c.at)
                r.consumers[c.consumer] = c.minimum
                self.waiting[name], self.refusals[name] = r, c.refused
                self._event(c.at, r, "QUEUED")
        elif c.command in ("complete", "fail") and name in self.running:
            r = self.running.pop(name)
            if c.command == "complete":
                self._end(c.at, r, "COMPLETED", c.observed)
            elif c.retry:
                self._again(c.at, r, "FAILED")
            else:
                self._end(c.at, r, "FAILED")
        elif c.command == "cancel" and known:
            self.waiting.pop(name, None)
            self.running.pop(name, None)
            self._end(c.at, known, "CANCELED")
        elif c.command in ("complete", "fail"):
            self.rows.append((self.name, c.at, name, "refused", "NOT_RUNNING", None, None, None))
        return self.rows

    def settle(self, c) -> list[tuple]:
        """``step``, and then what may be submitted; commands of one time are taken in before anything is dispatched at it."""
        rows = self.step(c)
        if c.last:
            self._dispatch(c.at)
        return rows


def execute_requests(commands: DataFrame, policy: Policy) -> DataFrame:
    """``commands(lane, at bigint, seq, command, request_id, priority, consumer, minimum, refused, observed, retry, last)`` -> lane, at, request_id,
    kind (event, result, refused), state, attempt, consumer, observed.

    ``last`` marks the last command of those that came together: one call with several requests queues all of them before the first is submitted.
    Lanes are spread over tasks; a lane is one pass over its sorted commands."""

    def make():
        lanes: dict[str, Lane] = {}

        def step(c):
            lane = lanes.setdefault(c.lane, Lane(c.lane, policy))
            return list(lane.settle(c))

        return step

    columns = ["lane", "at", "seq", "command", "request_id", "priority", "consumer", "minimum", "refused", "observed", "retry", "last"]
    return sorted_fold(commands.select(*columns), ["lane"], ["at", "seq"], _OUT, make)
