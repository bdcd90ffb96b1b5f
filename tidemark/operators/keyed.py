"""What keyed state computes in arrival order, as functions of a key's history.

``arrival`` is a total order of a key's records (an offset or event id); ``streaming``
holds the twins that keep the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import blank


def repair_new_flag(df: DataFrame, key: str = "mid", flag: str = "is_new", arrival: str = "arrival") -> DataFrame:
    """Only a key's first record that says ``'1'`` may keep it; later ones become ``'0'``.

    The first one is a minimum, combined before the shuffle and joined back, so that a
    hot key is never one task's sort.
    """
    first = df.where(F.col(flag) == "1").groupBy(F.col(key).alias("__key")).agg(F.min(arrival).alias("__first"))
    met = df.join(first, F.col(key) == F.col("__key"), "left")
    late = (F.col(flag) == "1") & (F.col(arrival) > F.col("__first"))
    return met.withColumn(flag, F.when(late, "0").otherwise(F.col(flag))).select(*df.columns)


def _neighbour(df: DataFrame, key: str, piece: Column, order: list[str], value: Column, after: bool) -> DataFrame:
    """Adds __value: ``value`` of the key's row before (or ``after``) each row, null at the end.

    Rows are sorted inside the pieces of a key only, and the rows at the ends of pieces
    get theirs from a table with a row for each piece, so that a hot key is many tasks'
    work. ``piece`` may not fall along ``order``.
    """
    columns, step = df.columns, F.lead if after else F.lag
    rows = df.withColumns({"__piece": piece, "__own": value})
    within = Window.partitionBy(key, "__piece").orderBy(*order)
    seen = rows.withColumns({"__near": step("__own").over(within), "__inner": step(F.lit(True)).over(within)})
    edge = (F.min_by if after else F.max_by)("__own", F.struct(*order))
    pieces = rows.groupBy(F.col(key).alias("__key"), F.col("__piece").alias("__of")).agg(edge.alias("__edge"))
    pieces = pieces.withColumn("__beyond", step("__edge").over(Window.partitionBy("__key").orderBy("__of")))
    met = seen.join(pieces, F.col(key).eqNullSafe(F.col("__key")) & F.col("__piece").eqNullSafe(F.col("__of")))
    return met.select(*columns, F.when(F.col("__inner"), F.col("__near")).otherwise(F.col("__beyond")).alias("__value"))


def unique_visits(df: DataFrame, day: str = "day", key: str = "mid", last_page: str = "last_page_id", arrival: str = "arrival", piece: Column | None = None) -> DataFrame:
    """Entry pages whose day isn't that of the key's entry page before.

    With ``piece``, which may not fall along arrival (hours of it, say), no key is one
    task's sort.
    """
    entries = df.where(blank(F.col(last_page)))
    if piece is None:
        entries = entries.withColumn("__value", F.lag(day).over(Window.partitionBy(key).orderBy(arrival)))
    else:
        entries = _neighbour(entries, key, piece, [arrival], F.col(day), after=False)
    return entries.where(F.col("__value").isNull() | (F.col("__value") != F.col(day))).drop("__value")


def first_of_day(df: DataFrame, day: str = "day", key: str = "mid", last_page: str = "last_page_id", arrival: str = "arrival") -> DataFrame:
    """The same where arrival follows time: the first entry page of each key and day, combined before the shuffle."""
    from .versions import latest_by_key

    return latest_by_key(df.where(blank(F.col(last_page))), [key, day], [-F.col(arrival)])


def bounces(df: DataFrame, within_ms: int = 10_000, key: str = "mid", ts: str = "ts", last_page: str = "last_page_id", arrival: str = "arrival", piece: Column | None = None) -> DataFrame:
    """Entry pages that the key's next page, if within the time, isn't reached from: next is an entry again, too late, or missing.

    With ``piece``, which may not fall along ``ts``, no key is one task's sort.
    """
    entry = blank(F.col(last_page))
    own = F.struct(F.col(ts).alias("at"), entry.alias("entry"))
    if piece is None:
        seen = df.withColumn("__value", F.lead(own).over(Window.partitionBy(key).orderBy(ts, arrival)))
    else:
        seen = _neighbour(df, key, piece, [ts, arrival], own, after=True)
    left = F.col("__value").isNull() | (F.col("__value.at") - F.col(ts) >= within_ms) | F.col("__value.entry")
    return seen.where(entry & left).drop("__value")
