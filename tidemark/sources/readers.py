"""Sources: topics, files, JDBC, change feeds, elements. Every one gives a DataFrame, batch or stream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import whole_seconds, with_camel_names


def topic(spark: SparkSession, name: str, servers: str, group: str | None = None, starting: str = "latest", stream: bool = True) -> DataFrame:
    """Texts of a Kafka topic (``value``, and the record's ``timestamp`` and ``offset``); needs the connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": name, "startingOffsets": starting if stream else "earliest"}
    options |= {"kafka.group.id": group} if group else {}
    reader = spark.readStream if stream else spark.read
    return reader.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"), "timestamp", "offset", "partition")


def topic_files(spark: SparkSession, path: str, stream: bool = False, per_trigger: int | None = None) -> DataFrame:
    """The same interface over files of lines: ``value``."""
    reader = spark.readStream if stream else spark.read
    if stream and per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format("text").load(path)


def table_files(spark: SparkSession, path: str, schema: str | None = None, stream: bool = False, fmt: str = "parquet") -> DataFrame:
    """Files of a format that keeps columns; a stream needs their schema."""
    reader = spark.readStream if stream else spark.read
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket, for trying things out."""
    return spark.readStream.format("socket").options(host=host, port=port).load()


def csv_fields(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    return lines.select(F.from_csv(value, schema).alias("r")).select("r.*")


def elements(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def jdbc(spark: SparkSession, url: str, query: str, options: Mapping[str, Any] | None = None, camel: bool = False) -> DataFrame:
    """The rows of a query; with ``camel`` its names in camelCase. Give partitionColumn, bounds and numPartitions to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    df = (reader.option("dbtable", f"({query}) q") if options and "partitionColumn" in options else reader.option("query", query)).load()
    return with_camel_names(df) if camel else df


def point(dim: DataFrame, key: Any, id_col: str = "ID") -> DataFrame:
    """One dimension entry by its key; the filter is pushed down to the files."""
    return dim.where(F.col(id_col) == F.lit(key).cast("string"))


def sql_view(rows: DataFrame, name: str, millis: str = "ts", delay: str = "1 second", text: str | None = None) -> DataFrame:
    """Registers a view with the row time ``rt`` (whole seconds of ``millis``, or a parsed text column) and its watermark."""
    rt: Column = F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss") if text else whole_seconds(F.col(millis))
    view = rows.withColumn("rt", rt)
    view = view.withWatermark("rt", delay)
    view.createOrReplaceTempView(name)
    return view


def changes(records: DataFrame, snapshot_as_insert: bool = False) -> DataFrame:
    """Change records as envelopes.

    ``records`` has topic (``server.database.table``), op (create, update, delete, read)
    and the maps before and after. A missing map is empty; create becomes insert, and so
    does read with ``snapshot_as_insert``; other operations are lower-cased as they are.
    """
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    op = F.lower("op")
    renamed = F.when(op.isin(["create", "read"] if snapshot_as_insert else ["create"]), "insert").otherwise(op)
    parts = F.split("topic", r"\.")
    return records.select(parts[1].alias("database"), parts[2].alias("tableName"), F.coalesce("before", empty).alias("before"), F.coalesce("after", empty).alias("after"), renamed.alias("type"))


def change_source(spark: SparkSession, records: DataFrame | str, database: str, table: str | None = None, **kind: Any) -> DataFrame:
    """Envelopes of one database (and table, as for the routing configuration), from records or a folder of them."""
    if isinstance(records, str):
        records = table_files(spark, records, "topic STRING, op STRING, before MAP<STRING,STRING>, after MAP<STRING,STRING>", fmt="json", **kind)
    found = changes(records).where(F.col("database") == database)
    return found.where(F.col("tableName") == table) if table else found


def routes(envelopes: DataFrame, version: str | None = None) -> DataFrame:
    """Routing rows from changes of the configuration table; its deletions are ignored."""
    names = ["sourceTable", "operateType", "sinkType", "sinkTable", "sinkColumns", "sinkPk", "sinkExtend"]
    after = F.col("after")
    snake = {n: "".join("_" + c.lower() if c.isupper() else c for c in n) for n in names}
    rows = envelopes.where("type != 'delete' AND size(after) > 0")
    return rows.select(*[F.coalesce(after[n], after[snake[n]]).alias(n) for n in names], *([version] if version else []))
