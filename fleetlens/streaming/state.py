"""Stateful processors: what each key remembers between batches, and the timers that let it be forgotten.

They run under ``transformWithStateInPandas``, which keeps its state in RocksDB: ``require_state_store`` says so where a session has
another store. State is read and written by piece, so a batch costs what it brings, not what a key has held before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def require_state_store(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(STORE, ""):
        raise ValueError(f"set {STORE} to {ROCKSDB}: keyed state with timers needs it")


def millis(t: pd.Timestamp) -> int:
    return int(t.timestamp() * 1000)


class Settled(StatefulProcessor):
    """A path settles once, when two successive polls agree on its size; it is forgotten ``forget_ms`` of event time after its last poll."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.polls = handle.getValueState("polls", "size long, done boolean, until long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        size, done, until = self.polls.get() if self.polls.exists() else (-1, False, 0)
        settled, first, watermark = None, until == 0, timerValues.getCurrentWatermarkInMs()
        polls = pd.concat([f.copy() for f in rows]).sort_values("t")  # one path's polls of one batch
        for t, now in polls[["t", "size"]].itertuples(index=False):
            if not pd.isna(t):
                until = max(until, millis(t) + self.forget_ms, watermark + self.forget_ms)
            if now is None or pd.isna(now):
                continue
            if not done and int(now) == size:
                done, settled = True, (t, int(now))
            size = int(now)
        self.polls.update((size, done, until))
        if first and until:
            self.handle.registerTimer(until)
        if settled is not None:
            yield pd.DataFrame({"path": [key[0]], "t": [settled[0]], "size": [settled[1]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        until = self.polls.get()[2] if self.polls.exists() else 0
        if until > expiredTimerInfo.getExpiryTimeInMs():  # polled since: one timer a path moves on
            self.handle.registerTimer(until)
        else:
            self.polls.clear()
        return iter(())

    def close(self) -> None:
        pass


class History(StatefulProcessor):
    """The events of the last ``keep`` microseconds before a key's latest, at most ``most`` of them.

    Times lie in buckets of a 64th of ``keep``, a map entry each, and a small value has the buckets' counts: a batch reads and writes the
    buckets that it adds to or trims, old buckets go as a whole. A key goes once the watermark is ``keep`` past its latest event."""

    def __init__(self, keep: int, most: int):
        self.keep, self.most, self.width = keep, most, max(1, keep // 64)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "bucket long", "at array<long>")
        self.counts = handle.getValueState("counts", "latest long, buckets array<long>, counts array<long>")

    def _cut(self, counts: dict[int, int], bucket: int, keep: Callable[[list[int]], list[int]]) -> None:
        kept = keep(list(self.times.getValue((bucket,))[0]))
        if kept:
            self.times.updateValue((bucket,), (kept,))
            counts[bucket] = len(kept)
        else:
            self.times.removeKey((bucket,))
            del counts[bucket]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        known = self.counts.exists()
        latest, buckets, numbers = self.counts.get() if known else (None, [], [])
        counts, new = dict(zip(buckets, numbers, strict=True)), {}
        for pdf in rows:
            for t in pd.to_datetime(pdf["t"]):
                if not pd.isna(t):
                    at = t.value // 1000
                    latest = at if latest is None else max(latest, at)
                    new.setdefault(at // self.width, []).append(at)
        if not new:
            return
        oldest = latest - self.keep
        for bucket, times in new.items():
            if bucket >= oldest // self.width:
                held = list(self.times.getValue((bucket,))[0]) if bucket in counts else []
                self.times.updateValue((bucket,), (sorted(held + times),))
                counts[bucket] = len(held) + len(times)
        for bucket in [b for b in counts if b < oldest // self.width]:
            self.times.removeKey((bucket,))
            del counts[bucket]
        if oldest // self.width in counts:
            self._cut(counts, oldest // self.width, lambda times: [t for t in times if t >= oldest])
        spare = sum(counts.values()) - self.most
        full = spare > 0
        for bucket in sorted(counts):
            if spare <= 0:
                break
            n = min(spare, counts[bucket])
            self._cut(counts, bucket, lambda times, n=n: times[n:])
            spare -= n
        self.counts.update((latest, list(counts), list(counts.values())))
        if not known:
            self.handle.registerTimer(max((latest + self.keep) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "n": [sum(counts.values())], "full": [full]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        until = (self.counts.get()[0] + self.keep) // 1000 + 1 if self.counts.exists() else 0
        if until > expiredTimerInfo.getExpiryTimeInMs():
            self.handle.registerTimer(until)
        else:
            self.times.clear()
            self.counts.clear()
        return iter(())

    def close(self) -> None:
        pass


class Harvest(StatefulProcessor):
    """Each path is read until its metadata parse, and given out once: path, t, meta, tries. A row whose body holds no metadata, as of a file
    that is still being copied, waits: after ``retry_ms`` of wall time, doubled each time, ``read`` fetches the body anew; after
    ``most`` tries the path is given out without metadata. A path that was given out is forgotten after ``forget_ms``."""

    def __init__(self, parse: Callable[[str], str | None], read: Callable[[str], str | None] | None, retry_ms: int, most: int, forget_ms: int):
        self.parse, self.read, self.retry_ms, self.most, self.forget_ms = parse, read, retry_ms, most, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "t timestamp, tries int, done boolean")

    def _attempt(self, key: tuple, t, tries: int, meta: str | None, now: int) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        done = meta is not None or tries >= self.most
        self.seen.update((t, tries, done))
        self.handle.registerTimer(now + (self.forget_ms if done else self.retry_ms << min(tries - 1, 20)))
        if done:
            yield pd.DataFrame({"path": [key[0]], "t": [t], "meta": [meta], "tries": [tries]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        known = self.seen.exists()
        t, tries, done = self.seen.get() if known else (None, 0, False)
        found = None
        for pdf in rows:  # all must be taken, also of a path that is done
            for at, body in pdf[["t", "body"]].itertuples(index=False):
                if not done and found is None:
                    found = self.parse(body) if isinstance(body, str) else None
                    t = at if t is None or found is not None else t
        if done or (known and found is None):  # a waiting path keeps its timer
            return
        if known:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        yield from self._attempt(key, t, tries + 1, found, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        t, tries, done = self.seen.get() if self.seen.exists() else (None, 0, True)
        if done:
            self.seen.clear()
            return
        body = self.read(key[0]) if self.read is not None else None
        yield from self._attempt(key, t, tries + 1, self.parse(body) if isinstance(body, str) else None, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass
