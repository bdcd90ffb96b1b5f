"""What the operators share: row keys, names, settings, scratch tables."""

import subprocess
import sys
import textwrap
from pathlib import Path

from pyspark.sql import functions as F

from tidemark.llm import common


def test_row_keys_tell_rows_apart(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, "a", None), (1, "a", None), (None, None, None)], "n int, x string, `a.b` string").withColumn("m", F.create_map(F.lit("k"), "n"))
    keys = [tuple(r) for r in rows.select(*common.row_key(rows)).collect()]
    assert len(set(keys)) == 3 and keys[1] == keys[2]


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2)], "K0 int, _k0 int")
    assert common.fresh(df, "k0", "k1") == ["__k0", "k1"]


def test_a_setting_of_ones_own_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "12345")
        common.small_batches(spark.range(1))
        assert spark.conf.get(key) == "12345"
    finally:
        spark.conf.set(key, before)


def test_small_sides(spark):
    small, large = (common.small_side(spark.range(3), n) for n in (3, common.BROADCAST_KEYS + 1))
    hinted = lambda df: "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small) and not hinted(large)


def test_scratch_tables_go_after_the_session(tmp_path):
    code = f"""
        from tidemark.session import build
        from tidemark.llm import common
        spark = build("local[1]", **{{"spark.checkpoint.dir": {str(tmp_path)!r}}})
        assert common.cut(spark.range(5), "t").count() == 5
        spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=Path(__file__).parents[2], capture_output=True)
    assert not list(tmp_path.glob("tidemark-*"))
