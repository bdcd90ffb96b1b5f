"""Latest version of each key, and snapshots that are merged with what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(df: DataFrame, keys: list[str], version: list[str | Column]) -> DataFrame:
    """One row for each key: the one with the greatest ``version``.

    The maximum is combined before the shuffle, so that a hot key costs a row for each
    task, and nothing is sorted. Ties need a further version column; nulls come first.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[v if isinstance(v, Column) else F.col(v) for v in version])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in rest]).select(*df.columns)


def upserted(snapshot: DataFrame, news: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The snapshot with its keys' latest rows of ``news`` in their place. ``news`` has the columns of the snapshot and of ``order``."""
    columns = snapshot.columns
    old = snapshot.select(*columns, F.lit(0).alias("__new"), *[F.lit(None).cast(news.schema[c].dataType).alias(f"__o_{c}") for c in order])
    new = news.select(*columns, F.lit(1).alias("__new"), *[F.col(c).alias(f"__o_{c}") for c in order])
    return latest_by_key(old.unionByName(new), keys, ["__new", *[f"__o_{c}" for c in order]]).select(*columns)
