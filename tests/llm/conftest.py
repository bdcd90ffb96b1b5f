import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text[, lang[, source]]) as documents."""

    def make(rows, partitions=3):
        full = [(*r, *["en", "s", None][len(r) - 2 :])[:5] for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
