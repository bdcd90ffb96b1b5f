"""Streaming forms of the layers: watermarks set, statistics with bounded state."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.scalar import event_time
from ..operators.joins import interval_join
from ..plans import middle, service
from ..plans.detail import database_changes
from ..sources.sinks import stream_batches

#: How late records of each stream may be. Bounces come 10 s late and keep their time, hence the 11 s of visitors.
DELAYS = {"order": "1 millisecond", "payment": "1 millisecond", "bounce": "1 second", "bounce_late": "2 seconds", "sql": "1 second", "product": "2 seconds", "visitor": "11 seconds"}


def timed(df: DataFrame, delay: str, millis: str = "ts", name: str = "event_time") -> DataFrame:
    return df.withColumn(name, F.timestamp_millis(millis)).withWatermark(name, delay)


def timed_by_text(df: DataFrame, text: str, delay: str, fallback: str | None = None, name: str = "event_time") -> DataFrame:
    """Event time from a text, or where it doesn't parse from the record's own timestamp."""
    other = F.col(fallback) if fallback else F.lit(None).cast("timestamp")
    return df.withColumn(name, event_time(F.col(text), other)).withWatermark(name, delay)


def joined(left: DataFrame, right: DataFrame, on: dict[str, str], left_time: str, right_time: str, low: str, high: str, delay: str = DELAYS["order"]) -> DataFrame:
    return interval_join(left, right, on, left_time, right_time, low, high, delay)


def order_wide(info: DataFrame, detail: DataFrame, dims: Mapping[str, DataFrame], as_of: Column, bounds: tuple[str, str] = middle.ORDER_BOUNDS, delay: str = DELAYS["order"], how: str | Mapping[str, str] = "left") -> DataFrame:
    """Wide orders from two streams, with dimensions that are looked up as they are at each micro-batch."""
    met = middle.order_wide(info, detail, bounds, delay)
    return middle.with_order_dimensions(met.select("*", *[F.lit(None).cast("string").alias(c) for c in schemas.ORDER_WIDE if c not in met.columns]), dims, as_of, how)


def payment_wide(payment: DataFrame, wide: DataFrame, bounds: tuple[str, str] = middle.PAYMENT_BOUNDS, fallback: str | None = None) -> DataFrame:
    return middle.payment_wide(payment, wide, bounds, DELAYS["payment"], fallback)


def route(changes: DataFrame, routes: Callable[[], DataFrame], checkpoint: str, facts: Callable[[DataFrame, int], None], dims: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Deals a stream of changes out. ``routes`` is asked at every micro-batch, so that changes are routed by the configuration as of their arrival. ``facts`` and ``dims`` get what is dealt out and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        dealt = database_changes(batch, routes())
        facts(dealt.facts, number)
        dims(dealt.dims, number)
        batch.unpersist()

    return stream_batches(changes, checkpoint, each, once)


def visitor_stats(rows: DataFrame, window: str = service.WINDOW) -> DataFrame:
    return service.visitor_stats(timed(rows, DELAYS["visitor"]), window=window, streaming=True)


def product_stats(rows: DataFrame, window: str = service.WINDOW) -> DataFrame:
    return service.product_stats(timed(rows, DELAYS["product"]), window=window, streaming=True)


def daily_visits(df: DataFrame, day: str = "day", key: str = "mid", delay: str = "1 day") -> DataFrame:
    """The cheaper form of unique visits, where arrival follows time: one record of each key and day within the watermark."""
    return df.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key, day])
