"""From documents to token ids, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, with the columns of
documents but for the last. ``run`` writes what a stage returns to the shared scratch
folder and reads it again for the next, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import pipeline
from tidemark.llm.common import cut, table

STAGES = [
    ("quality rules", pipeline.quality),
    ("near duplicates", pipeline.near_duplicates),
    ("secret scans", pipeline.without_secrets),
    ("mixing sources", pipeline.mix),
    ("bpe encoding", pipeline.encode),
]

#: Robust distances, sketches and dependent draws are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name.replace(" ", "-"))
    return docs
