"""Runs a stream over what is there now and gives its output as a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ROCKSDB

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


_roots: set[str] = set()


def work_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, until the application's JVM ends: under ``spark.checkpoint.dir``, or in a local session without it a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    root = f"{base.rstrip('/')}/tidemark-streams-{spark.sparkContext.applicationId}"
    if root not in _roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        store = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _roots.add(root)
    return f"{root}/{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append", once: bool = False, folder: str | None = None) -> DataFrame:
    """What the stream has put out when it has read all its input: closed windows and expired timers only.

    ``once`` reads it in one batch. State with a time to live by the clock needs that, as
    it asks for further batches without end. A run in the ``folder`` of an earlier one
    goes on from its checkpoint.
    """
    spark = stream.sparkSession
    folder = folder or work_folder(spark)
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        run = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        run = run.trigger(once=True) if once else run.trigger(availableNow=True)
        run.start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the parquet files under ``path`` (a file or a folder), in their schema."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    from_file = spark.read.format("binaryFile").load(path).select("path").where(f"path LIKE '%/{name}'").isEmpty()
    return reader.parquet(path) if from_file else reader.option("pathGlobFilter", name).parquet(head)
