"""Detail layer: behaviour logs and database changes, cleaned and dealt out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import keyed, routing


@dataclass
class Logs:
    start: DataFrame
    page: DataFrame
    display: DataFrame
    dirty: DataFrame


def behaviour_logs(lines: DataFrame, arrival: str = "arrival") -> Logs:
    """Log lines (``value``, and their arrival order) as start, page and display records, and dirty lines.

    is_new is repaired by history; a page record keeps its displays.
    """
    clean, dirty = routing.split_dirty(routing.parse(lines))
    rows = clean.select(arrival, F.col("data.*")).drop(routing.CORRUPT).withColumns({"mid": F.col("common.mid"), "is_new": F.col("common.is_new")})
    fixed = keyed.repair_new_flag(rows, arrival=arrival)
    fixed = fixed.withColumn("common", F.col("common").withField("is_new", F.col("is_new"))).drop("mid", "is_new")
    start, page = routing.split_log(fixed, F.col("start").isNotNull())
    display = routing.explode_displays(page.where("size(displays) > 0"), "displays", "page.page_id")
    return Logs(start, page, display.select("display_type", "page_id", "item", "item_type", "pos_id", "order"), dirty)


@dataclass
class Changes:
    facts: DataFrame
    dims: DataFrame


def database_changes(changes: DataFrame, routes: DataFrame) -> Changes:
    """Changes as records for topics (sinkTable and ``after`` as JSON) and as rows for dimension tables."""
    routed = routing.route(routing.without_deletes(changes), routes)
    facts = routing.to_sink(routed, schemas.SINK_FACT).select(F.col("sinkTable").alias("topic"), F.to_json("after").alias("value"))
    return Changes(facts, routing.to_sink(routed, schemas.SINK_DIM))


def dimension_rows(dims: DataFrame, table: str, columns: str) -> DataFrame:
    """The rows of one dimension table, its configured columns as texts."""
    names = columns.split(",")
    return dims.where(F.col("sinkTable") == table).select(*[F.col("after")[n].alias(n) for n in names], *[c for c in dims.columns if c not in ("after", "sinkTable", "sinkType", "sinkPk", "before", "database", "tableName", "type")])
