"""Parsing with a dirty side, log splitting, display explosion, and config-driven routing of changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.scalar import keep_keys, to_millis
from .versions import latest_by_key

CORRUPT = "_corrupt"


def parse(df: DataFrame, schema: str = schemas.LOG, value: str = "value") -> DataFrame:
    """``data`` (the parsed JSON text), ``corrupt`` (whether it didn't parse) and the text, which passes through.

    A generator makes the parsed record a column of its own, so that each text is parsed
    once however many of its fields are asked for.
    """
    fields = f"{schema.strip()}, {CORRUPT} STRING"
    parsed = F.from_json(F.col(value), fields, {"columnNameOfCorruptRecord": CORRUPT})
    data = df.select("*", F.inline_outer(F.array(F.struct(parsed.alias("data")))).alias("data"))
    return data.withColumn("corrupt", F.col("data").isNull() | F.coalesce(F.col(f"data.{CORRUPT}").isNotNull(), F.lit(False)))


def split_dirty(parsed: DataFrame, required: str | None = "data.common.mid") -> tuple[DataFrame, DataFrame]:
    """Clean rows, and the texts of those that don't parse or lack the key that they are dealt out by."""
    bad = F.col("corrupt") | (F.col(required).isNull() if required else F.lit(False))
    return parsed.where(~bad).drop("corrupt"), parsed.where(bad).select("value")


def fail_fast(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The parsed columns; a text that doesn't parse fails the job."""
    return df.select(F.from_json(F.col(value), schema, {"mode": "FAILFAST"}).alias("data")).select("data.*")


def parsed_rows(df: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The columns of a fixed schema: unknown keys are ignored, missing ones null."""
    return df.select(F.from_json(F.col(value), schema).alias("data")).select("data.*")


def split_log(rows: DataFrame, is_start: Column) -> tuple[DataFrame, DataFrame]:
    """Start records, and page records."""
    flag = F.coalesce(is_start, F.lit(False))
    return rows.where(flag), rows.where(~flag)


def explode_displays(pages: DataFrame, displays: str = "displays", page_id: str = "page_id") -> DataFrame:
    """A row for each displayed element, with the page's id and nothing else of the page."""
    return pages.select(F.col(page_id).alias("page_id"), F.explode(displays).alias("d")).select("page_id", "d.*")


def split_times(rows: DataFrame, text: str = "create_time") -> tuple[DataFrame, DataFrame]:
    """Rows whose time is one, and the others, which no interval join could place."""
    good = F.coalesce(to_millis(F.col(text)).isNotNull(), F.lit(False))
    return rows.where(good), rows.where(~good)


def without_deletes(changes: DataFrame, kind: str = "type") -> DataFrame:
    """Changes that aren't deletions; a change without a type is dropped too."""
    return changes.where(F.col(kind) != "delete")


def latest_routes(routes: DataFrame, version: str | None = None) -> DataFrame:
    """One route for each table and operation: the last by ``version``, which later configuration replaces."""
    return latest_by_key(routes, ["sourceTable", "operateType"], [version]) if version else routes.dropDuplicates(["sourceTable", "operateType"])


def route(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """Changes that a route covers, with sinkType, sinkTable, sinkPk and the entries of ``after`` that its columns list.

    The routes are the configuration table, keyed by table and operation; whether it is
    broadcast is left to its size.
    """
    cfg = routes.select(F.col("sourceTable").alias("r_table"), F.col("operateType").alias("r_type"), "sinkType", "sinkTable", "sinkColumns", "sinkPk")
    met = changes.join(cfg, (F.col("tableName") == F.col("r_table")) & (F.col("type") == F.col("r_type")))
    return met.withColumn("after", keep_keys(F.col("after"), F.col("sinkColumns"))).drop("r_table", "r_type", "sinkColumns")


def to_sink(routed: DataFrame, kind: str) -> DataFrame:
    """The rows of one kind of sink: ``schemas.SINK_FACT`` goes to topics, ``schemas.SINK_DIM`` to dimension tables; others go nowhere."""
    return routed.where(F.col("sinkType") == kind)


def searches(views: DataFrame) -> DataFrame:
    """Page views (maps) that a search led to, with what was searched for."""
    return views.where("page['last_page_id'] = 'search' AND page['item'] IS NOT NULL").select(F.col("page")["item"].alias("full_word"), *[c for c in views.columns if c not in ("page", "common")])


def union_all(parts: list[DataFrame], missing: bool = False) -> DataFrame:
    """Bag union by column name; with ``missing`` absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), parts)
