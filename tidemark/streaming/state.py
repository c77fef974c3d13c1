"""Keyed state of streams: first-accepted ledger, bounded stores, accumulation of bars, session books, seeds after a restart.

Every processor reads its key's state once in a micro-batch, works through the key's rows in order of arrival and writes the state back once.
What a key may hold is bounded by a parameter, or by a time to live, so state does not grow with the length of a stream.
Times are microseconds inside the processors; the functions at the end of the module speak of timestamps.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.timeops import PRICE, anchored_floor, from_micros, micros
from tidemark.operators.intake import NewestHeld

VALUES = ["open", "high", "low", "close", "volume"]
_VALUES = ", ".join(f"{v} {PRICE}" for v in VALUES)


def _arrived(rows: Iterator[pd.DataFrame], order: str = "arrival") -> pd.DataFrame:
    """The rows of one key in one micro-batch, in order; the source's limit on a trigger bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


def _combined(parts: dict[int, tuple]) -> tuple:
    """Open, high, low, close, volume of bars by start."""
    bars = [parts[s] for s in sorted(parts)]
    return bars[0][0], max(b[1] for b in bars), min(b[2] for b in bars), bars[-1][3], sum(b[4] for b in bars)


class _Keyed(StatefulProcessor):
    """A processor with one list of tuples as its state."""

    state = ""
    output = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.state)

    def load(self) -> list[tuple]:
        return list(self.held.get()) if self.held.exists() else []

    def store(self, rows: list[tuple]) -> None:
        if rows:
            self.held.put(rows)
        else:
            self.held.clear()

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[f.split()[0] for f in self.output.split(", ")])

    def close(self) -> None:
        pass

    def over(self, rows: DataFrame, *keys: str, initial: DataFrame | None = None, mode: str = "Append") -> DataFrame:
        seed = {} if initial is None else {"initialState": initial.groupBy(*keys)}
        return rows.groupBy(*keys).transformWithStateInPandas(self, self.output, mode, "None", **seed)


class FirstAccepted(StatefulProcessor):
    """Admission of (key, seq, payload): the first payload of a key is held until it has been idle for the time to live."""

    output = "key string, seq bigint, status string"

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "payload string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        """Rows, not frames: a ledger has many keys of few rows, and a frame for each costs more than the rule."""
        batch = sorted(((r.seq, r.payload) for r in rows), key=lambda r: r[0])
        known = self.first.get() if self.first.exists() else None
        held = known[0] if known else batch[0][1]
        self.first.update((held,))  # seen again: the time to live starts anew
        for i, (seq, payload) in enumerate(batch):
            yield Row(key=key[0], seq=seq, status="ACCEPTED" if not known and i == 0 else "DUPLICATE" if payload == held else "CONFLICT")

    def close(self) -> None:
        pass


class BoundedStore(_Keyed):
    """The newest ``most`` bars of a key; every arrival is ACCEPTED, DUPLICATE or CONFLICT, an acceptance may evict the oldest."""

    state = "at bigint, payload string"
    output = "instrument string, arrival bigint, at bigint, status string, evicted bigint"

    def __init__(self, most: int):
        self.most = most

    def handleInputRows(self, key, rows, timerValues):
        store = NewestHeld(self.most, dict(self.load()))
        out = [(key[0], r.arrival, r.at, *store.admit(r.at, r.payload)) for r in _arrived(rows).itertuples(index=False)]
        self.store([(int(a), p) for a, p in store.held.items()])
        result = self.frame(out)
        yield result.astype({"evicted": "Int64"})


class Accumulator(_Keyed):
    """Bars of a key to longer bars of ``expected`` parts.

    A longer bar is emitted when its last part comes, in whatever order, and its bucket is forgotten.  A part that is there already
    is a DUPLICATE or, with other values, a CONFLICT, and changes nothing.  At most ``most`` buckets are open; beyond that the oldest goes,
    full or not, and is reported as expired."""

    state = f"bucket bigint, at bigint, {_VALUES}"
    output = f"instrument string, arrival bigint, at bigint, status string, bucket bigint, {_VALUES}, expired bigint"

    def __init__(self, expected: int, most: int):
        self.expected, self.most = expected, most

    def handleInputRows(self, key, rows, timerValues):
        open_: dict[int, dict[int, tuple]] = defaultdict(dict)
        for bucket, at, *values in self.load():
            open_[bucket][at] = tuple(values)
        out = []
        for r in _arrived(rows).itertuples(index=False):
            values, none = tuple(getattr(r, v) for v in VALUES), (None,) * len(VALUES)
            held = open_[r.bucket].get(r.at)
            if held is not None:
                out.append((key[0], r.arrival, r.at, "DUPLICATE" if held == values else "CONFLICT", r.bucket, *none, None))
                continue
            parts = open_[r.bucket]
            parts[r.at] = values
            expired = min(open_) if len(open_) > self.most else None
            if expired is not None:
                del open_[expired]
            if len(parts) == self.expected and expired != r.bucket:
                out.append((key[0], r.arrival, r.at, "COMPLETED", r.bucket, *_combined(parts), expired))
                del open_[r.bucket]
            else:
                out.append((key[0], r.arrival, r.at, "HELD", r.bucket, *none, expired))
        self.store([(int(b), int(a), *v) for b, parts in open_.items() for a, v in parts.items()])
        yield self.frame(out).astype({"expired": "Int64"})


class ForwardBuckets(_Keyed):
    """Longer bars of a key whose bars come bucket after bucket.

    A bucket is closed by the first bar of a later one: COMPLETED if all its parts are there, else INCOMPLETE.  A bar again replaces its
    earlier self; a bar of an earlier bucket is LATE and ignored.  The initial state seeds a bucket that was forming."""

    state = f"bucket bigint, at bigint, {_VALUES}"
    output = f"instrument string, bucket bigint, status string, {_VALUES}"

    def __init__(self, expected: int):
        self.expected = expected

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.store([(int(r.bucket), int(r.at), *(getattr(r, v) for v in VALUES)) for r in initialState.itertuples(index=False)])

    def handleInputRows(self, key, rows, timerValues):
        current, parts, out = None, {}, []
        for bucket, at, *values in self.load():
            current = bucket
            parts[at] = tuple(values)
        for r in _arrived(rows).itertuples(index=False):
            if current is not None and r.bucket < current:
                out.append((key[0], r.bucket, "LATE", *(getattr(r, v) for v in VALUES)))
                continue
            if current is not None and r.bucket > current:
                whole = len(parts) == self.expected
                out.append((key[0], current, "COMPLETED" if whole else "INCOMPLETE", *_combined(parts)))
                parts = {}
            current = r.bucket
            parts[r.at] = tuple(getattr(r, v) for v in VALUES)
        self.store([(int(current), int(a), *v) for a, v in parts.items()])
        yield self.frame(out)


class SessionBook(_Keyed):
    """The newest ``sessions`` sessions of a key, each with its historical and its live bars, at most ``bars`` of either.

    The first bar of a time stays, per kind; historical bars hold up to the session's cutoff (the latest that any historical batch named),
    live bars replace them from there on.  What is kept depends on times alone, so any order of arrival ends in the same book.
    After a batch the touched sessions are emitted again under a higher version, evicted ones with n_bars 0."""

    state = f"session bigint, kind int, at bigint, cutoff bigint, {_VALUES}"
    output = f"instrument string, session bigint, version bigint, {_VALUES}, n_bars bigint, last bigint"

    def __init__(self, sessions: int, bars: int):
        self.sessions, self.bars = sessions, bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.version = handle.getValueState("version", "version bigint")

    def handleInputRows(self, key, rows, timerValues):
        book: dict[int, tuple[dict, dict]] = {}
        cutoff: dict[int, int] = {}
        for session, kind, at, cut, *values in self.load():
            book.setdefault(session, ({}, {}))[kind][at] = tuple(values)
            if cut is not None:
                cutoff[session] = cut
        touched = set()
        for r in _arrived(rows).itertuples(index=False):
            session = int(r.session)
            if session not in book and len(book) >= self.sessions and session < min(book):
                continue  # older than all that is kept: it would be the one to go
            kept = book.setdefault(session, ({}, {}))[int(r.kind)]
            kept.setdefault(int(r.at), tuple(getattr(r, v) for v in VALUES))
            if len(kept) > self.bars:
                del kept[min(kept)]
            if int(r.kind) == 0 and not pd.isna(r.cutoff):
                cutoff[session] = max(int(r.cutoff), cutoff.get(session, int(r.cutoff)))
            touched.add(session)
            if len(book) > self.sessions:
                touched.add(min(book))
                del book[min(book)]
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.version.update((version,))
        self.store([(s, kind, a, cutoff.get(s), *v) for s, kinds in book.items() for kind in (0, 1) for a, v in kinds[kind].items()])
        out = []
        for s in sorted(touched):
            chosen: dict[int, tuple] = {}
            if s in book:
                from_ = cutoff.get(s)
                chosen = book[s][0] | {a: v for a, v in book[s][1].items() if from_ is None or a >= from_}
            out.append((key[0], s, version, *(_combined(chosen) if chosen else (None,) * len(VALUES)), len(chosen), max(chosen, default=None)))
        yield self.frame(out).astype({"last": "Int64"})


def ledger_stream(rows: DataFrame, ttl_ms: int = 30 * 86_400_000) -> DataFrame:
    """``rows(key, seq, payload)`` -> key, seq, status."""
    return rows.groupBy("key").transformWithState(FirstAccepted(ttl_ms), FirstAccepted.output, "Append", "ProcessingTime")


def bounded_stream(rows: DataFrame, most: int) -> DataFrame:
    """``rows(instrument, arrival, open_ts, payload)`` -> status and evicted_ts of each arrival, as the batch ``bounded_store``."""
    out = BoundedStore(most).over(rows.select("instrument", "arrival", micros(F.col("open_ts")).alias("at"), "payload"), "instrument")
    return out.select("instrument", "arrival", from_micros(F.col("at")).alias("open_ts"), "status", from_micros(F.col("evicted")).alias("evicted_ts"))


def _parts(bars: DataFrame, seconds: int, anchor=None) -> DataFrame:
    return bars.withColumns({"at": micros(F.col("open_ts")), "bucket": micros(anchored_floor(F.col("open_ts"), seconds, anchor))})


def accumulated_stream(bars: DataFrame, base_seconds: int, seconds: int, most: int) -> DataFrame:
    """``bars(instrument, arrival, open_ts, open .. volume)`` -> one row per arrival; COMPLETED rows carry the longer bar of ``bucket_ts``."""
    rows = _parts(bars, seconds).select("instrument", "arrival", "at", "bucket", *VALUES)
    out = Accumulator(seconds // base_seconds, most).over(rows, "instrument")
    return out.select("instrument", "arrival", from_micros(F.col("at")).alias("open_ts"), "status", from_micros(F.col("bucket")).alias("bucket_ts"), *VALUES, from_micros(F.col("expired")).alias("expired_ts"))


def forward_stream(bars: DataFrame, base_seconds: int, seconds: int, warm: DataFrame | None = None, anchor=None) -> DataFrame:
    """``bars(instrument, arrival, open_ts, open .. volume)``, ``warm`` without arrival -> instrument, bucket_ts, status, open .. volume.

    Of the warm bars only those of each instrument's newest bucket enter the state, and only if that bucket is not full in time."""
    rows = _parts(bars, seconds, anchor).select("instrument", "arrival", "at", "bucket", *VALUES)
    seed = None
    if warm is not None:
        held = _parts(warm, seconds, anchor).select("instrument", "bucket", "at", *VALUES)
        newest = held.groupBy("instrument").agg(F.max("at").alias("latest"), F.max("bucket").alias("bucket"))
        newest = newest.where(F.col("latest") + base_seconds * 1_000_000 < F.col("bucket") + seconds * 1_000_000)
        seed = held.join(newest.drop("latest"), ["instrument", "bucket"]).select("instrument", "bucket", "at", *VALUES)
    out = ForwardBuckets(seconds // base_seconds).over(rows, "instrument", initial=seed)
    return out.select("instrument", from_micros(F.col("bucket")).alias("bucket_ts"), "status", *VALUES)


def session_book_stream(bars: DataFrame, sessions: int, most_bars: int) -> DataFrame:
    """``bars(instrument, arrival, session, kind, cutoff, open_ts, open .. volume)``, kind 0 historical and 1 live, ``cutoff`` null or the time
    from which live bars count -> versions of the sessions' summaries."""
    rows = bars.select("instrument", "arrival", micros(F.col("session")).alias("session"), "kind", micros(F.col("cutoff")).alias("cutoff"), micros(F.col("open_ts")).alias("at"), *VALUES)
    out = SessionBook(sessions, most_bars).over(rows, "instrument", mode="Update")
    return out.select("instrument", from_micros(F.col("session")).alias("session"), "version", *VALUES, "n_bars", from_micros(F.col("last")).alias("last_ts"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The newest version of each session; a version counts up per instrument, so the comparison is one maximum."""
    rest = [c for c in versions.columns if c not in ("instrument", "session")]
    newest = versions.groupBy("instrument", "session").agg(F.max_by(F.struct(*rest), "version").alias("v"))
    return newest.select("instrument", "session", "v.*").where("n_bars > 0").drop("version")
