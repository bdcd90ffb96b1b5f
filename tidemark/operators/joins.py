"""Interval joins and dimension lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, on: Mapping[str, str], left_time: str, right_time: str, low: str, high: str, delay: str | None = None) -> DataFrame:
    """Inner join on equal keys where the right time lies in [left time + ``low``, left time + ``high``], bounds included.

    ``low`` and ``high`` are intervals such as ``"-5 seconds"``. Column names of the two
    sides must differ. Streams give the ``delay`` of the watermarks on both times: the same
    condition then bounds the state, and rows behind the watermark are dropped.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"both sides have {sorted(clash)}")
    if delay:
        left, right = left.withWatermark(left_time, delay), right.withWatermark(right_time, delay)
    lt, rt = F.col(left_time), F.col(right_time)
    near = (rt >= lt + F.expr(f"INTERVAL '{low}'")) & (rt <= lt + F.expr(f"INTERVAL '{high}'"))
    for a, b in on.items():
        near = (F.col(a) == F.col(b)) & near
    return left.join(right, near)


def enrich(df: DataFrame, dim: DataFrame, key: str, columns: Mapping[str, str], dim_key: str = "ID", how: str = "left") -> DataFrame:
    """Looks ``columns`` (new name: the dimension's name) up by key; columns of these names are replaced.

    ``how="left"`` keeps rows without an entry, ``"inner"`` loses them. Keys of the
    dimension are texts and are compared as such. Broadcast or shuffle is left to the
    planner, which knows the dimension's size.
    """
    looked = dim.select(F.col(dim_key).cast("string").alias("__key"), *[F.col(c).alias(f"__{new}") for new, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    met = df.join(looked, F.col(key).cast("string") == F.col("__key"), how)
    return met.select(*kept, *[F.col(f"__{new}").alias(new) for new in columns])
