"""Keyed state with expiry (``transformWithState``): run state, approval outcomes, artifact life.

State lives in Spark's RocksDB store and in the query's checkpoint, so a restarted query goes on where it stopped. All
three run on processing time: their timers fire on a silent stream too. Times are microseconds since the epoch, so no
time zone matters here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithState`` needs the RocksDB state store; queries started from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---------------------------------------------------------------------------
# Run state
# ---------------------------------------------------------------------------

# a task's writes of one run, folded before they are sent to the run's state
PARTIAL = ("run_id string, clear_seq long, msg_seq long, messages string, pend_seq long, pending string, model_seq long, "
           "model string, seqs array<long>, times array<long>")
RUN_STATE_OUT = ("run_id string, messages string, pending string, model string, created_at long, updated_at long, "
                 "n_writes long, exists boolean")


def partial_folds(batches: Iterator) -> Iterator:
    """One row a run: the latest value of each field with its seq, the last clear, and place and time of every write.

    Only these two numbers are kept of every write, not its payload, so a hot run's messages leave a task once.
    """
    import pyarrow as pa
    runs: dict[str | None, list] = {}
    names = ("run_id", "seq", "kind", "messages", "pending", "model", "written_at")
    for batch in batches:
        for run, seq, kind, messages, pending, model, at in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            # last clear; (seq, value) of messages, pending and model; seqs; times
            r = runs.setdefault(run, [None, (None, None), (None, None), (None, None), [], []])
            if kind == "clear":
                r[0] = seq if r[0] is None else max(r[0], seq)
                continue
            for k, counts, value in ((1, kind == "set_messages", messages), (2, kind == "set_pending", pending),
                                     (3, model is not None, model)):
                if counts and (r[k][0] is None or seq > r[k][0]):
                    r[k] = (seq, value)
            r[4].append(seq)
            r[5].append(at)
    rows = [(run, r[0], *r[1], *r[2], *r[3], r[4], r[5]) for run, r in runs.items()]
    if rows:
        text, number = pa.string(), pa.int64()
        types = [text, number, number, text, number, text, number, text, pa.list_(number), pa.list_(number)]
        names = [c.split()[0] for c in PARTIAL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


class RunState(StatefulProcessor):
    """A run's current state from its writes in any order.

    Every field is a value state of its own with the seq it came from, so a write reads and writes its own fields only.
    Place and time of each write are held until they lie ``late_ms`` behind the run's newest write; a clear that comes
    later than that is too late for the writes counted by then. A cleared run keeps only the seq of its clear, under a
    TTL of ``late_ms``; a run without a write for ``idle_ms`` is dropped by a timer, and a later write starts it anew.
    Without ``idle_ms`` nothing is dropped, and there are neither timers nor TTL.
    """

    FIELDS = ("messages", "pending", "model")

    def __init__(self, idle_ms: int | None, late_ms: int):
        self.idle_ms, self.late_ms = idle_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = {f: handle.getValueState(f, "seq long, value string") for f in self.FIELDS}
        self.clear = handle.getValueState("clear", "seq long", ttlDurationMs=self.late_ms if self.idle_ms else None)
        self.recent = handle.getListState("recent", "seq long, at long")
        self.settled = handle.getValueState("settled", "n long, first long, last long, seq long")
        self.touched = handle.getValueState("touched", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.idle_ms:
            now = timerValues.getCurrentProcessingTimeInMs()
            if not self.touched.exists():
                self.handle.registerTimer(now + self.idle_ms)
            self.touched.update((now,))
        held = self.clear.get()
        cleared = held[0] if held else None
        newest = {f: self.fields[f].get() for f in self.FIELDS}
        changed, writes, last_clear = set(), list(self.recent.get()), cleared
        for r in rows:
            if r.clear_seq is not None and (last_clear is None or r.clear_seq > last_clear):
                last_clear = r.clear_seq
            for f, seq, value in (("messages", r.msg_seq, r.messages), ("pending", r.pend_seq, r.pending), ("model", r.model_seq, r.model)):
                if seq is not None and (newest[f] is None or seq > newest[f][0]):
                    newest[f] = (seq, value)
                    changed.add(f)
            writes += zip(r.seqs, r.times, strict=True)
        settled = self.settled.get()
        if last_clear != cleared:
            self.clear.update((last_clear,))
            if settled and settled[3] <= last_clear:
                settled = None
                self.settled.clear()
        if last_clear is not None:
            writes = [w for w in writes if w[0] > last_clear]
            for f in self.FIELDS:
                if newest[f] is not None and newest[f][0] <= last_clear:
                    newest[f] = None
                    self.fields[f].clear()
        for f in changed:
            if newest[f] is not None:
                self.fields[f].update(tuple(newest[f]))
        if writes:
            bound = max(at for _, at in writes) - 1000 * self.late_ms
            old = [w for w in writes if w[1] < bound]
            if old:
                writes = [w for w in writes if w[1] >= bound]
                n, first, last, seq = settled or (0, old[0][1], old[0][1], old[0][0])
                settled = (n + len(old), min(first, *(at for _, at in old)), max(last, *(at for _, at in old)), max(seq, *(s for s, _ in old)))
                self.settled.update(settled)
            self.recent.put([(s, at) for s, at in writes])
        else:
            self.recent.clear()
        times = [at for _, at in writes] + ([settled[1], settled[2]] if settled else [])
        n = len(writes) + (settled[0] if settled else 0)
        value = {f: newest[f][1] if newest[f] is not None else None for f in self.FIELDS}
        yield Row(run_id=key[0], **value, created_at=min(times, default=None), updated_at=max(times, default=None), n_writes=n, exists=n > 0)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, touched = timerValues.getCurrentProcessingTimeInMs(), self.touched.get()
        if touched and now < touched[0] + self.idle_ms:
            self.handle.registerTimer(touched[0] + self.idle_ms)
        else:
            for state in (*self.fields.values(), self.clear, self.recent, self.settled, self.touched):
                state.clear()
        return iter(())

    def close(self) -> None:
        pass


# ---------------------------------------------------------------------------
# T4: approval outcomes
# ---------------------------------------------------------------------------

OUTCOME = "run_id string, tool_call_id string, event_time long, decided_at long, value string, status string"


class ApprovalOutcome(StatefulProcessor):
    """Each request of a tool call with its first decision within ``bound_ms``, or ``timed_out``.

    The time-out fires on the clock, ``late_ms`` after the bound (or after the request came, if that is later), also when
    nothing else arrives. Decisions that come before their request wait as long.
    """

    def __init__(self, bound_ms: int, late_ms: int):
        self.bound_ms, self.late_ms = bound_ms, late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = handle.getListState("requests", "at long, until long")
        self.decisions = handle.getListState("decisions", "at long, value string, until long")

    def answered(self, key: Any, requests: list[tuple], decisions: list[tuple]) -> tuple[list[Row], list[tuple]]:
        bound, out, left = 1000 * self.bound_ms, [], []
        for request in sorted(requests):
            fitting = [d for d in decisions if request[0] <= d[0] <= request[0] + bound]
            if fitting:
                first = min(fitting, key=lambda d: (d[0], d[1] is not None, d[1] or ""))
                out.append(Row(run_id=key[0], tool_call_id=key[1], event_time=request[0], decided_at=first[0], value=first[1], status="decided"))
            else:
                left.append(request)
        return out, left

    def store(self, requests: list[tuple], decisions: list[tuple]) -> None:
        for state, rows in ((self.requests, requests), (self.decisions, decisions)):
            state.put(rows) if rows else state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        requests, decisions = [tuple(r) for r in self.requests.get()], [tuple(d) for d in self.decisions.get()]
        for r in rows:
            until = max(r.at // 1000 + self.bound_ms, now) + self.late_ms
            if r.kind == "request":
                requests.append((r.at, until))
            else:
                decisions.append((r.at, r.value, until))
            self.handle.registerTimer(until)
        out, left = self.answered(key, requests, decisions)
        self.store(left, decisions)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())
        requests, decisions = [tuple(r) for r in self.requests.get()], [tuple(d) for d in self.decisions.get()]
        late = [r for r in requests if r[1] <= now]
        self.store([r for r in requests if r[1] > now], [d for d in decisions if d[2] > now])
        for r in sorted(late):
            yield Row(run_id=key[0], tool_call_id=key[1], event_time=r[0], decided_at=None, value=None, status="timed_out")

    def close(self) -> None:
        pass


# ---------------------------------------------------------------------------
# Artifact life
# ---------------------------------------------------------------------------

LIFE = "run_id string, artifact_id string, created_at long, event string, at long"


class ArtifactLife(StatefulProcessor):
    """``live`` when an artifact is registered, ``expired`` when it is more than ``ttl_ms`` old.

    Only the newest registration of an id counts, whatever order they come in; one that is too old on arrival never
    becomes live. The state has a TTL of its own, so an entry never outlives its artifact by more than that.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created_at long", ttlDurationMs=2 * self.ttl_ms + 60_000)

    def row(self, key: Any, created: int, event: str, at_ms: int) -> Row:
        return Row(run_id=key[0], artifact_id=key[1], created_at=created, event=event, at=1000 * at_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.entry.get()
        created = max(r.created_at for r in rows)
        if held and held[0] >= created:
            return
        ends = created // 1000 + self.ttl_ms
        if now > ends:  # the same strict rule as the batch operator
            return
        self.entry.update((created,))
        self.handle.registerTimer(ends + 1)
        yield self.row(key, created, "live", now)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = max(timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()), self.entry.get()
        if held and now > held[0] // 1000 + self.ttl_ms:
            self.entry.clear()
            yield self.row(key, held[0], "expired", now)

    def close(self) -> None:
        pass
