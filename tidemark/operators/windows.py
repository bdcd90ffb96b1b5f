"""Tumbling windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import seconds_text


def tumble(df: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], distinct: dict[str, str] | None = None, streaming: bool = False) -> DataFrame:
    """Aggregates by epoch-aligned window and keys, with its bounds as stt and edt.

    ``distinct`` (new name: column) counts distinct values, nulls left out. A batch does
    it by two stages of hash aggregation, which a hot key survives; a stream keeps the
    set of an open window's values.
    """
    count = (lambda c: F.size(F.collect_set(c))) if streaming else F.count_distinct
    counts = [count(F.col(c)).cast("long").alias(n) for n, c in (distinct or {}).items()]
    grouped = df.groupBy(F.window(ts, size).alias("w"), *keys).agg(*aggs, *counts)
    rest = [c for c in grouped.columns if c not in ("w", *keys)]
    return grouped.select(seconds_text(F.col("w.start")).alias("stt"), seconds_text(F.col("w.end")).alias("edt"), *keys, *rest)


def tumble_by_id(df: DataFrame, ts: str, size: str, keys: list[str], aggs: dict[str, Callable[[str], Column]], distinct: dict[str, str]) -> DataFrame:
    """The same for a batch whose ``distinct`` columns hold one id or null in each row: sums, minima or maxima of columns, and distinct ids.

    Rows are summed up by window, keys and id first, and then without the id, so that no
    row is multiplied for the sake of the counts. A row without an id has its keys' one
    group of such rows.
    """
    window, some = F.window(ts, size).alias("w"), F.coalesce(*distinct.values())
    first = df.groupBy(window, *keys, some.alias("__id")).agg(*[f(c).alias(c) for c, f in aggs.items()], *[F.max(F.col(c).isNotNull().cast("int")).alias(n) for n, c in distinct.items()])
    grouped = first.groupBy("w", *keys).agg(*[f(c).alias(c) for c, f in aggs.items()], *[F.sum(n).alias(n) for n in distinct])
    exact = {f.name: f.dataType for f in df.groupBy(*keys).agg(*[f(c).alias(c) for c, f in aggs.items()]).schema}
    return grouped.select(seconds_text(F.col("w.start")).alias("stt"), seconds_text(F.col("w.end")).alias("edt"), *keys, *[F.col(c).cast(exact[c]).alias(c) for c in aggs], *distinct)
