"""Serving: a day's turnover and rankings from the product statistics, and their JSON."""

from __future__ import annotations

import json
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import on_day
from ..operators.versions import latest_by_key

#: Rows of a ranking unless the caller says otherwise.
LIMITS = {"spu": 10, "category3": 4, "trademark": 20}


def current(stats: DataFrame) -> DataFrame:
    """The latest version of each row, as replacing tables have after merging."""
    return latest_by_key(stats, schemas.OLAP_KEYS["product_stats"], ["ts"])


def today(day: int = 0) -> int:
    return day or int(datetime.now().strftime("%Y%m%d"))


def _of_day(stats: DataFrame, day: int) -> DataFrame:
    """The rows of a day; tables that are partitioned by ``dt`` read that folder alone."""
    number = today(day)
    if "dt" in stats.columns:
        stats = stats.where(F.col("dt") == f"{number // 10000:04}-{number // 100 % 100:02}-{number % 100:02}")
    return stats.where(on_day(F.col("stt").cast("timestamp_ntz"), number))


def gmv(stats: DataFrame, day: int = 0) -> DataFrame:
    """One row: the turnover of a day, null if there is none."""
    return _of_day(stats, day).agg(F.sum("order_amount").alias("gmv"))


def ranking(stats: DataFrame, keys: list[str], day: int = 0, limit: int = 10, orders: bool = False) -> DataFrame:
    """Keys with turnover by descending order_amount, ties by the first key. order_ct sums windows' distinct counts."""
    sums = [F.sum("order_amount").alias("order_amount")] + ([F.sum("order_ct").alias("order_ct")] if orders else [])
    grouped = _of_day(stats, day).groupBy(*keys).agg(*sums)
    return grouped.where("order_amount > 0").orderBy(F.desc("order_amount"), keys[0]).limit(limit)


def top_spu(stats: DataFrame, day: int = 0, limit: int = LIMITS["spu"]) -> DataFrame:
    return ranking(stats, ["spu_id", "spu_name"], day, limit, orders=True)


def top_category3(stats: DataFrame, day: int = 0, limit: int = LIMITS["category3"]) -> DataFrame:
    return ranking(stats, ["category3_id", "category3_name"], day, limit)


def top_trademark(stats: DataFrame, day: int = 0, limit: int = LIMITS["trademark"]) -> DataFrame:
    return ranking(stats, ["tm_id", "tm_name"], day, limit)


def _json(data: object) -> str:
    return json.dumps({"status": 0, "data": data}, ensure_ascii=False, default=lambda x: float(x) if isinstance(x, Decimal) else str(x))


def gmv_json(df: DataFrame) -> str:
    return _json(df.head()[0])


def spu_json(df: DataFrame) -> str:
    titles = {"spu_name": "spu_name", "order_amount": "order_amount", "order_ct": "order_ct"}
    rows = [{k: r[k] for k in titles} for r in df.collect()]  # a ranking's few rows
    return _json({"columns": [{"name": t, "id": k} for k, t in titles.items()], "rows": rows})


def category3_json(df: DataFrame) -> str:
    return _json([{"name": r["category3_name"], "value": r["order_amount"]} for r in df.collect()])


def trademark_json(df: DataFrame) -> str:
    rows = df.collect()
    return _json({"categories": [r["tm_name"] for r in rows], "series": [{"data": [r["order_amount"] for r in rows]}]})
