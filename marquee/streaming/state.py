"""Keyed state of the live feeds, in the RocksDB store: what a title has, open bursts, memberships that will end."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's setting is as before after it."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


TITLE_FIELDS = "base_name string, files long, tag string, qualities string, resolutions string, languages string, platforms string"


class TitleRollup(StatefulProcessor):
    """Of rows (filename, series, q, r, l, p) of a title: its number of files, and the sorted unions of what they say."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getMapState("names", "filename string", "seen boolean")
        self.values = handle.getMapState("values", "kind string, value string", "seen boolean")
        self.total = handle.getValueState("total", "files long, series boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        files, series = self.total.get() if self.total.exists() else (0, False)
        said: set[tuple[str, str]] = set()
        for batch in rows:
            for filename, of_series, *values in batch[["filename", "series", "q", "r", "l", "p"]].itertuples(index=False):
                if self.names.containsKey((filename,)):
                    continue
                self.names.updateValue((filename,), (True,))
                files, series = files + 1, bool(series or of_series)
                said |= {(kind, v) for kind, some in zip("qrlp", values, strict=True) if some is not None for v in some if v is not None}
        held = {tuple(k) for k in self.values.keys()} if self.values.exists() else set()  # noqa: SIM118
        for pair in said - held:
            self.values.updateValue(pair, (True,))
        self.total.update((files, series))
        union = lambda kind: ", ".join(sorted((v for k, v in held | said if k == kind), key=lambda v: v.encode())) or "N/A"
        yield pd.DataFrame([(key[0], files, "#SERIES" if series else "#MOVIE", *map(union, "qrlp"))], columns=["base_name", "files", "tag", "qualities", "resolutions", "languages", "platforms"])

    def close(self) -> None:
        pass


class Bursts(StatefulProcessor):
    """Open bursts of a key, each from its first to its last row in microseconds; rows that come late join what they touch."""

    def __init__(self, key: str, seconds: int) -> None:
        self.key, self.gap = key, seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("open", "first array<long>, last array<long>, n array<long>")

    def _held(self) -> list[list[int]]:
        return [list(x) for x in zip(*self.open.get(), strict=True)] if self.open.exists() else []

    def _keep(self, some: list[list[int]]) -> None:
        if some:
            self.open.update(tuple(list(x) for x in zip(*some, strict=True)))
        else:
            self.open.clear()

    def _ends(self, last: int) -> int:
        """The millisecond at which a burst is over."""
        return -(-(last + self.gap) // 1000)

    def _next(self, some: list[list[int]]) -> int | None:
        """The key's one timer: the end of the burst that is over first."""
        return min((self._ends(x[1]) for x in some), default=None)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        before = self._next(held)
        held = self._joined(held + [[t, t, 1] for batch in rows for t in batch["at"].tolist()])
        at = self._next(held)
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
        self._keep(held)
        return iter(())

    def _joined(self, some: list[list[int]]) -> list[list[int]]:
        """Bursts whose rows are less than the gap apart are one."""
        out: list[list[int]] = []
        for first, last, n in sorted(some):
            if out and first < out[-1][1] + self.gap:
                out[-1] = [out[-1][0], max(out[-1][1], last), out[-1][2] + n]
            else:
                out.append([first, last, n])
        return out

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, held = timerValues.getCurrentWatermarkInMs(), self._held()
        over = [x for x in held if self._ends(x[1]) <= at]
        held = [x for x in held if self._ends(x[1]) > at]
        if held:
            self.handle.registerTimer(self._next(held))
        self._keep(held)
        if over:
            yield pd.DataFrame({self.key: [key[0]] * len(over)} | {c: [x[k] for x in over] for k, c in enumerate(("first", "last", "n"))})

    def close(self) -> None:
        pass


#: In place of the end of a grant without one.
NO_END = -(1 << 63)


class Expiries(StatefulProcessor):
    """The end of each member's last grant, of the members of a bucket of ids, and one timer at the first of these ends.

    State is two packed arrays for a bucket, in microseconds and in the order of ids: what is asked of the store
    doesn't grow with the members. An end has passed once the watermark is behind it, not when they are equal.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ends = handle, handle.getValueState("ends", "ids binary, ends binary, timer long")

    def _held(self) -> tuple[np.ndarray, np.ndarray, int | None]:
        if not self.ends.exists():
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
        ids, ends, timer = self.ends.get()
        return np.frombuffer(ids, dtype=np.int64), np.frombuffer(ends, dtype=np.int64), timer

    def _keep(self, ids: np.ndarray, ends: np.ndarray, timer: int | None) -> None:
        """timer: the one that is set, None if it has run."""
        at = int(ends.min()) // 1000 + 1 if len(ends) else None
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if at is None:
            self.ends.clear()
            return
        if timer != at:
            self.handle.registerTimer(at)
        self.ends.update((ids.tobytes(), ends.tobytes(), at))

    @staticmethod
    def _last(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each id once, with its greatest end."""
        if not len(ids):
            return ids, ends
        order = np.lexsort((ends, ids))
        ids, ends = ids[order], ends[order]
        last = np.append(ids[1:] != ids[:-1], True)
        return ids[last], ends[last]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids, ends, timer = self._held()
        for batch in rows:
            batch = batch[batch["end"] != NO_END]
            ids, ends = self._last(np.append(ids, batch["id"].to_numpy(dtype=np.int64)), np.append(ends, batch["end"].to_numpy(dtype=np.int64)))
        self._keep(ids, ends, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids, ends, timer = self._held()
        over = ends // 1000 < timerValues.getCurrentWatermarkInMs()
        at = expiredTimerInfo.getExpiryTimeInMs()
        self._keep(ids[~over], ends[~over], None if timer == at else timer)
        if over.any():
            yield pd.DataFrame({"part": np.full(over.sum(), key[0], dtype=np.int32), "id": ids[over], "end": ends[over]})

    def close(self) -> None:
        pass
