"""Sinks: topics, dimension snapshots, OLAP tables, the console."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..functions.scalar import to_value
from ..operators.versions import latest_by_key, upserted


def to_topic(df: DataFrame, topic: str) -> DataFrame:
    """Every row as JSON (nulls left out) for one topic."""
    return to_value(df).select(F.lit(topic).alias("topic"), "value")


def write_topics(messages: DataFrame, path: str | None = None, servers: str | None = None, batch: int | None = None) -> None:
    """Messages (topic, value), each to the topic that it names: to Kafka, or to files with a folder for each topic.

    With ``batch``, a micro-batch's number, its files replace those of an earlier try.
    """
    if servers:
        messages.write.format("kafka").option("kafka.bootstrap.servers", servers).save()
    elif batch is None:
        messages.write.mode("append").partitionBy("topic").text(path)
    else:
        messages.write.mode("overwrite").partitionBy("topic").text(f"{path}/batch={batch}")


def stream_topics(messages: DataFrame, checkpoint: str, path: str | None = None, servers: str | None = None, once: bool = True) -> StreamingQuery:
    """The same for a stream. The checkpoint makes the files exactly-once."""
    writer = messages.writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    if servers:
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).start()
    return writer.format("text").option("path", path).partitionBy("topic").start()


def stream_batches(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], once: bool = True, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def console(df: DataFrame) -> StreamingQuery:
    return df.writeStream.format("console").start()


class Store:
    """Versioned tables under one folder, in buckets by key: a version of some buckets is written whole, then named in the table's pointer.

    An upsert rewrites only the buckets that new rows fall into. Readers of the version
    before are not disturbed, and a failed write leaves no trace that they could see;
    older versions are removed. Files are reached through Spark's file systems only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _pointers(self, table: str) -> list:
        """The last two pointers, the current one first; a pointer has a row."""
        if not self.exists(table):
            return []
        return self.spark.read.schema(_POINTER).parquet(f"{self.path}/{table}/current").orderBy(F.desc("number")).limit(2).collect()

    def exists(self, table: str) -> bool:
        fs, p = self._fs(f"{self.path}/{table}/current")
        return fs.exists(p)

    def about(self, table: str) -> dict:
        """The table's schema, primary key, extension (the clause that a route gives) and number of buckets."""
        now = self._pointers(table)[0]
        return {c: now[c] for c in ("schema", "keys", "extend", "buckets")}

    def read(self, table: str) -> DataFrame:
        now = self._pointers(table)[0]
        paths = [f"{self.path}/{table}/{version}/{_BUCKET}={b}" for b, version in sorted(now["versions"].items())]
        return self.spark.read.schema(now["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], now["schema"])

    def _write(self, table: str, df: DataFrame, about: dict, versions: dict[int, str], kept: list) -> None:
        """A version of the buckets that ``df`` has rows of; others stay as ``versions`` says."""
        version, number = f"v-{uuid.uuid4().hex}", 1 + (kept[0]["number"] if kept else 0)
        dealt = df.withColumn(_BUCKET, self._bucket(about))
        dealt.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.path}/{table}/{version}")
        fs, folder = self._fs(f"{self.path}/{table}/{version}")
        for status in fs.listStatus(folder):  # a folder for each bucket
            name = status.getPath().getName()
            if name.startswith(f"{_BUCKET}="):
                versions = versions | {int(name.split("=")[1]): version}
        pointer = [(number, versions, about["schema"], about["keys"], about["extend"], about["buckets"])]
        self.spark.createDataFrame(pointer, _POINTER).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}/current")
        if len(kept) > 1:  # what the pointer before the last one has and neither of the later ones
            gone = {(b, v) for b, v in kept[1]["versions"].items()} - set(kept[0]["versions"].items()) - set(versions.items())
            for b, v in gone:
                fs.delete(self._fs(f"{self.path}/{table}/{v}/{_BUCKET}={b}")[1], True)

    @staticmethod
    def _bucket(about: dict):
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in about["keys"].split(",")]), F.lit(about["buckets"])).cast("int")

    def replace(self, table: str, df: DataFrame, keys: str | None = None, extend: str | None = None) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        about = {"schema": schema, "keys": keys or ("id" if "id" in df.columns else df.columns[0]), "extend": extend, "buckets": self.buckets}
        self._write(table, df, about, {}, self._pointers(table))

    def create(self, table: str, columns: str, keys: str | None = None, extend: str | None = None) -> None:
        """An empty table of text columns with a primary key (a comma-separated list, ``id`` by default), unless it exists."""
        if not self.exists(table):
            empty = self.spark.createDataFrame([], T.StructType([T.StructField(c.strip(), T.StringType()) for c in columns.split(",")]))
            self.replace(table, empty, keys, extend)

    def create_dimensions(self, routes: DataFrame) -> None:
        """Every dimension table that the routes name, with its primary key and extension."""
        named = routes.where(F.col("sinkType") == schemas.SINK_DIM).groupBy("sinkTable").agg(*[F.max(c).alias(c) for c in ("sinkColumns", "sinkPk", "sinkExtend")])
        for r in named.collect():  # configuration
            self.create(r["sinkTable"], r["sinkColumns"], r["sinkPk"], r["sinkExtend"])

    def upsert(self, table: str, news: DataFrame, keys: str | None, order: list[str]) -> None:
        """The latest row of each key (the table's primary key by default)."""
        kept = self._pointers(table)
        about = self.about(table)
        if keys and keys != about["keys"]:  # other keys fall into other buckets
            about, kept_versions = about | {"keys": keys}, {}
            old = self.read(table)
        else:
            kept_versions = dict(kept[0]["versions"])
            touched = {r[0] for r in news.select(self._bucket(about)).distinct().collect()}  # as many as there are buckets
            paths = [f"{self.path}/{table}/{v}/{_BUCKET}={b}" for b, v in sorted(kept_versions.items()) if b in touched]
            old = self.spark.read.schema(about["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], about["schema"])
        self._write(table, upserted(old, news, about["keys"].split(","), order), about, kept_versions, kept)


_BUCKET = "__bucket"
_POINTER = "number int, versions map<int,string>, schema string, keys string, extend string, buckets int"


def write_olap(df: DataFrame, path: str, mode: str = "append") -> None:
    """Statistics with stt, in a folder for each day."""
    dated = df.withColumn("dt", F.substring("stt", 1, 10))
    dated.hint("rebalance", F.col("dt")).write.mode(mode).partitionBy("dt").parquet(path)


def read_olap(spark: SparkSession, path: str, name: str, merged: bool = True) -> DataFrame:
    """An OLAP table; ``merged`` keeps the latest version of each key."""
    rows = spark.read.parquet(path)
    return latest_by_key(rows, schemas.OLAP_KEYS[name], ["ts"]) if merged else rows
