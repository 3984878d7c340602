"""ST-2, ST-3, ST-7, ST-8, ST-11: keyed state with time: retries, triggers, leases, order, expiry.

Each stream has a batch form over the same events.  Streams run on event
time: a timer goes off when the watermark passes it, so a replay gives the same rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ST-2: retries of a failed event, and the longest wait in seconds.
RETRIES, LONGEST_WAIT = 3, 30
#: ST-3: a claim without an answer for so long is lost.
LEASE_SECONDS = 300
#: ST-11: entries of a client's cache, and seconds that they live.
ENTRIES, LIVE_SECONDS = 1000, 300.0

_RETRY = "path string, attempt int, retry_at timestamp"
_LEASE = "outbox_id long, status string, attempts int, at timestamp"


def _ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


def _rows(batches: Iterator[pd.DataFrame], *order: str) -> list:
    """The rows of a key in one trigger, in order."""
    held = [b for b in batches if len(b)]
    return list(pd.concat(held).sort_values(list(order), kind="stable").itertuples(index=False)) if held else []


def retries(attempts: DataFrame) -> DataFrame:
    """ST-2, batch: (path, ts, attempt, retry_at, fired) of failed attempts (path, ts, ok).

    The n-th failure since the last success runs again min(2^n, 30) seconds
    later, up to three times (else ``retry_at`` is null), unless another event
    of the path comes before that (``fired`` is false)."""
    w = Window.partitionBy("path").orderBy("ts")
    runs = attempts.withColumn("_run", F.sum(F.col("ok").cast("int")).over(w)).withColumn("_next", F.lead("ts").over(w))
    n = F.row_number().over(Window.partitionBy("path", "_run").orderBy("ts"))
    first = F.first("ok").over(Window.partitionBy("path", "_run").orderBy("ts")).cast("int")  # a run begins with its success
    out = runs.withColumn("attempt", (n - first).cast("int")).filter(~F.col("ok"))
    wait = F.make_dt_interval(secs=F.least(F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(LONGEST_WAIT))))
    due = F.when(F.col("attempt") <= RETRIES, F.col("ts") + wait)
    return out.select("path", "ts", "attempt", due.alias("retry_at"), F.coalesce(F.col("_next").isNull() | (F.col("_next") > due), F.lit(False)).alias("_open")).select("path", "ts", "attempt", "retry_at", (F.col("retry_at").isNotNull() & F.col("_open")).alias("fired"))


def retry_stream(attempts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ST-2, stream: a row (path, attempt, retry_at) when a failed event's time has come.

    State holds a path's failures since its last success and the time of the
    next run; a newer event of the path replaces that time."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, due = state.get if state.exists else (0, 0)
        now, fired = state.getCurrentWatermarkMs(), []

        def fire() -> None:
            fired.append((key[0], failures, pd.Timestamp(due, unit="ms")))

        if state.hasTimedOut and due:
            fire()
            due = 0
        for r in _rows(batches, "ts"):
            if due and _ms(r.ts) > due:
                fire()
            failures = 0 if r.ok else failures + 1
            due = _ms(r.ts) + 1000 * min(2**failures, LONGEST_WAIT) if 0 < failures <= RETRIES else 0
        if due and due <= now:
            fire()
            due = 0
        if failures or due:
            state.update((failures, due))
            if due:
                state.setTimeoutTimestamp(due)
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame(fired, columns=["path", "attempt", "retry_at"])

    return attempts.withWatermark("ts", late).groupBy("path").applyInPandasWithState(fold, _RETRY, "failures int, due long", "append", GroupStateTimeout.EventTimeTimeout)


def triggers(processed: DataFrame, n: int = 10) -> DataFrame:
    """ST-7, batch: (key, ts, processed) of the rows (key, ts, seq) after which a key's count reaches a multiple of n."""
    count = F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq"))
    return processed.select("key", "ts", "seq", count.alias("processed")).filter(F.col("processed") % n == 0).select("key", "ts", "processed")


def leases(messages: DataFrame, now: Column) -> DataFrame:
    """ST-3, batch: (outbox_id, claimed_at, attempt, lost_at) of claims that got no answer in time.

    messages: outbox_id, ts, kind (``claim``, ``done``, ``fail``).  A claim is
    lost five minutes after it was made if no other message of its command has
    come by then; ``attempt`` counts the command's claims."""
    w = Window.partitionBy("outbox_id").orderBy("ts")
    is_claim = F.col("kind") == "claim"
    each = messages.withColumn("_next", F.lead("ts").over(w)).withColumn("attempt", F.sum(is_claim.cast("int")).over(w))
    lost = F.col("ts") + F.expr(f"INTERVAL {LEASE_SECONDS} SECONDS")
    return each.filter(is_claim & (F.coalesce("_next", now) > lost)).select("outbox_id", F.col("ts").alias("claimed_at"), F.col("attempt").cast("int").alias("attempt"), lost.alias("lost_at"))


def lease_stream(messages: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ST-3, stream: the status of commands as it changes: (outbox_id, status, attempts, at).

    A claim sets a timer.  If it goes off before an answer has come, the worker
    is taken to be lost and the command is pending again; an answer that comes
    after that changes nothing, unless the command was claimed again."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, due = state.get if state.exists else ("pending", 0, 0)
        now, out = state.getCurrentWatermarkMs(), []

        def lose() -> None:
            out.append((key[0], "pending", attempts, pd.Timestamp(due, unit="ms")))

        if state.hasTimedOut and due:
            lose()
            status, due = "pending", 0
        for r in _rows(batches, "ts"):
            at = _ms(r.ts)
            if due and at > due:
                lose()
                status, due = "pending", 0
            if r.kind == "claim" and status in ("pending", "processing"):
                status, attempts, due = "processing", attempts + 1, at + 1000 * LEASE_SECONDS
            elif status == "processing":
                status, due = ("succeeded" if r.kind == "done" else "pending"), 0
            else:
                continue
            out.append((key[0], status, attempts, r.ts))
        if due and due <= now:
            lose()
            status, due = "pending", 0
        state.update((status, attempts, due))
        if due:
            state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame(out, columns=["outbox_id", "status", "attempts", "at"])

    return messages.withWatermark("ts", late).groupBy("outbox_id").applyInPandasWithState(fold, _LEASE, "status string, attempts int, due long", "append", GroupStateTimeout.EventTimeTimeout)


def in_order(events: DataFrame, late: str = "10 seconds") -> DataFrame:
    """ST-8: a key's events (key, ts, seq, payload) one after the other: (key, n, ts, seq, payload).

    In a batch, by time and ``seq``.  In a stream, an event is held back until
    the watermark has passed it, so what arrives out of order within ``late``
    leaves in order, whatever micro-batches it came in.  State is a key's
    events of the last ``late``."""
    if not events.isStreaming:
        n = F.row_number().over(Window.partitionBy("key").orderBy("ts", "seq"))
        return events.select("key", n.cast("long").alias("n"), "ts", "seq", "payload")

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = (state.get[0], list(zip(*state.get[1:], strict=True))) if state.exists else (0, [])
        held += [(r.ts.value // 1000, int(r.seq), r.payload) for r in _rows(batches, "ts", "seq")]
        held.sort(key=lambda x: x[:2])
        now = state.getCurrentWatermarkMs()
        ready = [x for x in held if x[0] // 1000 < now]
        held = held[len(ready) :]
        if ready:
            yield pd.DataFrame([(key[0], n + i, pd.Timestamp(t, unit="us"), s, p) for i, (t, s, p) in enumerate(ready, 1)], columns=["key", "n", "ts", "seq", "payload"])
        n += len(ready)
        state.update((n, [x[0] for x in held], [x[1] for x in held], [x[2] for x in held]))
        if held:
            state.setTimeoutTimestamp(max(held[0][0] // 1000 + 1, now + 1))

    shape, kept = "key string, n long, ts timestamp, seq long, payload string", "n long, at array<long>, seq array<long>, payload array<string>"
    return events.withWatermark("ts", late).groupBy("key").applyInPandasWithState(fold, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)


class ExpiringCache:
    """Entries that live for a time from when they were put, least recently used out first when full."""

    def __init__(self, entries: int = ENTRIES, seconds: float = LIVE_SECONDS) -> None:
        self.entries, self.seconds = entries, seconds
        self._put: OrderedDict[str, float] = OrderedDict()  # key -> when it was put, in order of use

    def asked(self, key: str, at: float) -> bool:
        """Whether the key is there at a time; if not, it is put."""
        put = self._put.get(key)
        if put is not None and at - put < self.seconds:
            self._put.move_to_end(key)
            return True
        self._put.pop(key, None)
        if len(self._put) >= self.entries:
            for old in [k for k, t in self._put.items() if at - t >= self.seconds]:
                del self._put[old]
            while len(self._put) >= self.entries:
                self._put.popitem(last=False)
        self._put[key] = at
        return False


def cache_hits(requests: DataFrame, entries: int = ENTRIES, seconds: float = LIVE_SECONDS) -> DataFrame:
    """ST-11: (client, key, ts, hit) of requests (client, key, ts), each client with a cache of its own.

    Requests are sorted by client and time and read as a stream of batches, so
    a task holds one client's entries at a time, not its requests."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, cache = None, ExpiringCache(entries, seconds)
        for b in batches:
            hit = []
            for c, k, t in zip(b["client"], b["key"], b["ts"], strict=True):
                if c != client:
                    client, cache = c, ExpiringCache(entries, seconds)
                hit.append(cache.asked(k, t.value / 1e9))
            yield b.assign(hit=hit)

    sorted_ = requests.select("client", "key", "ts").repartition("client").sortWithinPartitions("client", "ts", "key")
    return sorted_.mapInPandas(run, f"client {requests.schema['client'].dataType.simpleString()}, key {requests.schema['key'].dataType.simpleString()}, ts timestamp, hit boolean")
