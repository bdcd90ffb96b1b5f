"""Scalar expressions: times, JSON, maps, names. All stay inside the JVM."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECONDS = "yyyy-MM-dd HH:mm:ss"
#: Fixed value: the 32-bit product 1000*60*60*24*365, which the compatible age divides by.
OVERFLOWED_YEAR_MS = 1471228928


def blank(text: Column) -> Column:
    """Null or empty."""
    return F.coalesce(text, F.lit("")) == ""


def to_millis(text: Column) -> Column:
    """Milliseconds of a ``yyyy-MM-dd HH:mm:ss`` text in the session's zone; null if it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit(SECONDS)))


def event_time(text: Column, fallback: Column) -> Column:
    """The text's time, or where it doesn't parse the time of the record."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(SECONDS)), fallback)


def whole_seconds(millis: Column) -> Column:
    """Row time of the SQL tables: milliseconds cut to seconds."""
    return F.timestamp_seconds(F.floor(millis / 1000))


def ntz_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def seconds_text(ts: Column) -> Column:
    return F.date_format(ts, SECONDS)


def day_text(millis: Column) -> Column:
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")


def day_number(ts: Column) -> Column:
    """yyyyMMdd as a number."""
    return F.date_format(ts, "yyyyMMdd").cast("int")


def on_day(ts: Column, day: int) -> Column:
    """Whether a time lies on day yyyyMMdd, as a half-open range, which scans can push down."""
    first = date(day // 10000, day // 100 % 100, day % 100)
    bounds = [F.lit(f"{d} 00:00:00").cast("timestamp_ntz") for d in (first, first + timedelta(days=1))]
    return (ts >= bounds[0]) & (ts < bounds[1])


def with_create_parts(df: DataFrame, text: str = "create_time") -> DataFrame:
    """Adds create_date, create_hour and create_ts (milliseconds)."""
    return df.withColumns({
        "create_date": F.split_part(text, F.lit(" "), F.lit(1)),
        "create_hour": F.substring(text, 12, 2),
        "create_ts": to_millis(F.col(text)),
    })


def age(birthday: Column, as_of: Column, compat: bool = False) -> Column:
    """Whole years between two dates, cut towards zero: dates less than a year before the birthday are 0 too. With ``compat`` by the divisor that has overflowed, rounded down."""
    if compat:
        between = F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(birthday.cast("timestamp"))
        return F.floor(between / OVERFLOWED_YEAR_MS).cast("int")
    return (F.months_between(as_of, birthday) / 12).cast("int")


def get(json: Column, path: str, kind: str = "string") -> Column:
    """A typed member of a JSON text; null where it is missing or of another type."""
    return F.get_json_object(json, path).try_cast(kind)


def to_value(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the other columns as one JSON text, nulls left out."""
    rest = [c for c in df.columns if c not in keep]
    return df.select(*keep, F.to_json(F.struct(*rest)).alias("value"))


def put(map_: Column, key: str, value: Column) -> Column:
    """The map with one more entry; an entry of that key is replaced."""
    return F.map_concat(drop(map_, key), F.create_map(F.lit(key), value))


def drop(map_: Column, key: str) -> Column:
    return F.map_filter(map_, lambda k, _: k != key)


def keep_keys(map_: Column, names: Column) -> Column:
    """The entries whose key is in a comma-separated list, compared as written."""
    return F.transform(F.array(F.split(names, ",")), lambda wanted: F.map_filter(map_, lambda k, _: F.array_contains(wanted, k)))[0]


def camel(name: str) -> str:
    """snake_case to camelCase."""
    head, *rest = re.sub(r"_+", "_", name.lower()).strip("_").split("_")
    return head + "".join(r.capitalize() for r in rest)


def with_camel_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel(c) for c in df.columns])
