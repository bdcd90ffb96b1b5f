"""Keyed state in arrival order: the streaming twins of ``operators.keyed``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 24 * 3600 * 1000


class NewFlag(StatefulProcessor):
    """A key's first record that says ``'1'`` keeps it; the state is that there was one, and it never expires."""

    def __init__(self, flag: str, arrival: str) -> None:
        self.flag, self.arrival = flag, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = self.seen.exists()
        for row in sorted(rows, key=lambda r: r[self.arrival]):
            if row[self.flag] == "1":
                if seen:
                    row = Row(**(row.asDict() | {self.flag: "0"}))
                else:
                    seen = True
                    self.seen.update((True,))
            yield row

    def close(self) -> None:
        pass


class DailyVisit(StatefulProcessor):
    """Entry pages whose day isn't the last one seen; the day is forgotten 24 hours after it was written."""

    def __init__(self, day: str, last_page: str, arrival: str, ttl_ms: int = DAY_MS) -> None:
        self.day, self.last_page, self.arrival, self.ttl_ms = day, last_page, arrival, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "day string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.last.get()[0] if self.last.exists() else None
        for row in sorted(rows, key=lambda r: r[self.arrival]):
            if not row[self.last_page] and row[self.day] != held:
                held = row[self.day]
                self.last.update((held,))
                yield row

    def close(self) -> None:
        pass


class Bounce(StatefulProcessor):
    """Entry pages that the next page, in event time, isn't reached from within the time.

    Records wait until the watermark has passed them, so that they are taken in order;
    an entry then waits for the next record or for its own timeout.
    """

    def __init__(self, ts: str, last_page: str, arrival: str, within_ms: int, columns: list[str]) -> None:
        self.ts, self.last_page, self.arrival, self.within, self.columns = ts, last_page, arrival, within_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.entry = handle.getValueState("entry", self.schema)

    def _ordered(self) -> list[tuple]:
        at, arrival = self.columns.index(self.ts), self.columns.index(self.arrival)
        return sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[at], r[arrival]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            if row[self.ts] >= now:
                self.waiting.appendValue(tuple(row[c] for c in self.columns))
                self.handle.registerTimer(row[self.ts] + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(timerValues.getCurrentWatermarkInMs())

    def _advance(self, now: int) -> Iterator[Row]:
        at, last = self.columns.index(self.ts), self.columns.index(self.last_page)
        held = tuple(self.entry.get()) if self.entry.exists() else None
        ordered = self._ordered()
        ready = [r for r in ordered if r[at] < now]
        for r in ready:
            is_entry = not r[last]
            if held is not None and (r[at] - held[at] >= self.within or is_entry):
                yield Row(**dict(zip(self.columns, held, strict=True)))
            held = r if is_entry else None
        if held is not None and now >= held[at] + self.within:
            yield Row(**dict(zip(self.columns, held, strict=True)))
            held = None
        self.waiting.clear()
        for r in ordered[len(ready) :]:
            self.waiting.appendValue(r)
        if held is None:
            self.entry.clear()
        else:
            self.entry.update(held)
            self.handle.registerTimer(held[at] + self.within + 1)

    def close(self) -> None:
        pass


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def repair_new_flag(df: DataFrame, key: str = "mid", flag: str = "is_new", arrival: str = "arrival") -> DataFrame:
    return df.groupBy(key).transformWithState(NewFlag(flag, arrival), df.schema, "append", "none")


def unique_visits(df: DataFrame, day: str = "day", key: str = "mid", last_page: str = "last_page_id", arrival: str = "arrival", ttl_ms: int = DAY_MS) -> DataFrame:
    return df.groupBy(key).transformWithState(DailyVisit(day, last_page, arrival, ttl_ms), df.schema, "append", "ProcessingTime")


def bounces(df: DataFrame, event_time: str = "event_time", delay: str = "1 second", within_ms: int = 10_000, key: str = "mid", ts: str = "ts", last_page: str = "last_page_id", arrival: str = "arrival") -> DataFrame:
    """``ts`` is ``event_time`` in milliseconds; the other columns must be simple ones."""
    kept = [c for c in df.columns if c != event_time]
    processor = Bounce(ts, last_page, arrival, within_ms, kept)
    processor.schema = _schema(df.select(*kept))
    return df.withWatermark(event_time, delay).groupBy(key).transformWithState(processor, df.select(*kept).schema, "append", "EventTime")
