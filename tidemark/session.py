"""Session settings that the layers rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Keyed state with time to live and timers needs this provider.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(master: str = "local[*]", app: str = "tidemark", time_zone: str = "Asia/Shanghai", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session in the zone of the business texts; pass ``time_zone="UTC"`` for zone-free data."""
    conf = {
        "spark.sql.session.timeZone": time_zone,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.ui.enabled": "false",
    }
    session = SparkSession.builder.master(master).appName(app).config(map=conf | more).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
