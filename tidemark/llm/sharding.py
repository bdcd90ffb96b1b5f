"""Contiguous shards of near equal bytes, cut from global prefix sums.

Documents are ranked by doc_id (null first), ties by size and checksum. Each range
partition reports its byte total, the totals are summed up over the partitions, and a
document goes to the shard in whose equal share of all bytes its middle byte falls.
Shards are runs of the ranking, and their sizes differ from the target by less than
the two documents at their ends. All of it is DataFrame operations: one pass reads the
texts and leaves four short columns; only those are shuffled.

Defined cases: null text has size 8 and the checksum of the empty text; equal rows are
placed like any others; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, global_prefix, table

#: Added to the bytes of each text, so that empty documents count.
OVERHEAD = 8


def shard_by_bytes(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard (0 to n_shards - 1) and slot (gapless from 0 in each shard)."""
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    raw = F.coalesce(df[text_col].cast("binary"), F.lit(b""))
    light = df.select(df[id_col].alias("doc_id"), (F.octet_length(raw).cast("long") + OVERHEAD).alias("size"), F.crc32(raw).alias("text_crc32"))
    ranked = global_prefix(light, ["doc_id", "size", "text_crc32"], ("size",))
    ranked = cut(ranked, "ranked")
    total = ranked.agg(F.sum("size").cast("long").alias("__total"))  # one row
    middle = (F.lit(2) * F.col("before_size") + F.col("size")).cast("decimal(28,0)") * n_shards
    placed = ranked.join(F.broadcast(total)).withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle / (F.lit(2) * F.col("__total"))).cast("int")))
    first = placed.groupBy("shard").agg(F.min("g_index").alias("__first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("g_index") - F.col("__first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
