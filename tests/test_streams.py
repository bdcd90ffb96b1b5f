"""Streams over several micro-batches: changing configuration, restarts, expiring state, late bounces."""

import time

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import keyed
from tidemark.plans import middle
from tidemark.sources import readers, sinks
from tidemark.streaming import jobs, processors
from tidemark.streaming.run import drained, work_folder

VISITS = "mid bigint, arrival bigint, day string, last_page_id string"


def put(spark, path, n, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/n={n}")


def stream(spark, path, schema):
    return spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(path).drop("n")


def test_routes_are_those_of_arrival(spark, tmp_path):
    change = lambda i: [("d", "t", {}, {"id": str(i), "x": "1"}, "insert")]
    for n in range(3):
        put(spark, str(tmp_path / "in"), n, change(n), schemas.CHANGE)
    asked = []

    def routes():
        asked.append(1)
        return spark.createDataFrame([("t", "insert", schemas.SINK_FACT, f"topic{min(len(asked), 2)}", "id" if len(asked) < 3 else "id,x", None, None)], schemas.ROUTES)

    out = str(tmp_path / "topics")
    run = jobs.route(stream(spark, str(tmp_path / "in"), schemas.CHANGE), routes, str(tmp_path / "checkpoint"), lambda df, n: sinks.write_topics(df, out, batch=n), lambda df, n: None)
    run.awaitTermination()
    got = sorted((r.topic, r.value) for r in spark.read.schema("value string, batch int, topic string").text(out).collect())
    assert [t for t, _ in got] == ["topic1", "topic2", "topic2"] and sum('"x"' in v for _, v in got) == 1


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    path, folder = str(tmp_path / "in"), work_folder(spark)
    schema = "mid bigint, arrival bigint, is_new string"
    put(spark, path, 0, [(1, 0, "1"), (2, 1, "1")], schema)
    run = lambda: sorted((r.arrival, r.is_new) for r in drained(processors.repair_new_flag(stream(spark, path, schema)), folder=folder).collect())
    assert run() == [(0, "1"), (1, "1")]
    put(spark, path, 1, [(1, 2, "1"), (3, 3, "1")], schema)
    assert run() == [(0, "1"), (1, "1"), (2, "0"), (3, "1")]  # neither read again nor forgotten
    assert run() == [(0, "1"), (1, "1"), (2, "0"), (3, "1")]


def test_visits_are_forgotten_in_time(spark, tmp_path):
    rows = [(1, 0, "d", None)], [(1, 1, "d", None)]
    for name, ttl, pause, want in (("short", 1000, 2.5, [0, 1]), ("long", 3_600_000, 0, [0])):
        path, folder = str(tmp_path / name), work_folder(spark)
        for n, part in enumerate(rows):
            put(spark, path, n, part, VISITS)
            seen = stream(spark, path, VISITS)
            out = drained(processors.unique_visits(seen, ttl_ms=ttl), once=True, folder=folder)
            time.sleep(pause)
        assert sorted(r.arrival for r in out.collect()) == want, name


def test_settings_are_left_alone(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    put(spark, str(tmp_path / "in"), 0, [(1,)], "a int")
    assert drained(stream(spark, str(tmp_path / "in"), "a int")).count() == 1
    assert spark.conf.get(key) == before


def test_bounces_come_late_and_keep_their_time(spark, tmp_path):
    """Visitor statistics wait for bounces as long as these may take."""
    times = [1_000_000 + t for t in (0, 1000, 20_000, 100_000)]
    put(spark, str(tmp_path / "in"), 0, [(1, i, t, None) for i, t in enumerate(times)], "mid bigint, arrival bigint, ts bigint, last_page_id string")
    rows = stream(spark, str(tmp_path / "in"), "mid bigint, arrival bigint, ts bigint, last_page_id string").withColumn("event_time", F.timestamp_millis("ts"))
    late = drained(processors.bounces(rows, delay=jobs.DELAYS["bounce_late"]))
    assert sorted(r.ts for r in late.collect()) == times[:3]


def test_pieces_of_a_key(spark):
    rows = [(1 + i % 2, i, 1000 * (i * 7 % 40), f"d{i // 9}", None if i % 3 else "home") for i in range(80)] + [(None, 90, 5, "d", None)]
    df = spark.createDataFrame(rows, "mid bigint, arrival bigint, ts bigint, day string, last_page_id string")
    both = lambda f, **more: (sorted(r.arrival for r in f(df).collect()), sorted(r.arrival for r in f(df, **more).collect()))
    plain, cut = both(keyed.unique_visits, piece=F.floor(F.col("arrival") / 5))
    assert plain == cut and plain
    plain, cut = both(keyed.bounces, piece=F.floor(F.col("ts") / 3000))
    assert plain == cut and plain


def test_payments_by_the_record_time(spark):
    at = F.lit("2020-12-20 23:28:51").cast("timestamp")
    pay = spark.createDataFrame([(1, 5, 1, None, "s", "1101", "no time", None)], schemas.PAYMENT_INFO).withColumn("at", at)
    wide = spark.createDataFrame([(7, 5, "2020-12-20 23:28:50")], "detail_id bigint, order_id bigint, create_time string").withColumn("at", at)
    wide = wide.select("*", *[F.lit(None).cast("string").alias(c) for c in schemas.ORDER_WIDE if c not in ("detail_id", "order_id", "create_time")])
    assert middle.payment_wide(pay, wide).count() == 0
    assert middle.payment_wide(pay, wide, fallback="at").count() == 1


def test_store_rewrites_touched_buckets(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "dims"), buckets=8)
    cfg = spark.createDataFrame([("a", "insert", schemas.SINK_DIM, "T", "id,kind,v", "id,kind", "SALT 4"), ("a", "update", schemas.SINK_DIM, "T", "id,kind,v", "id,kind", None)], schemas.ROUTES)
    store.create_dimensions(cfg)
    assert store.about("T")["keys"] == "id,kind" and store.about("T")["extend"] == "SALT 4" and store.read("T").count() == 0
    news = lambda rows: spark.createDataFrame(rows, "id string, kind string, v string, seq bigint")
    store.upsert("T", news([(str(i), "x", "old", i) for i in range(50)]), None, ["seq"])
    before = dict(store._pointers("T")[0]["versions"])
    store.upsert("T", news([("7", "x", "new", 1), ("7", "y", "other", 2)]), None, ["seq"])
    after = dict(store._pointers("T")[0]["versions"])
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    rows = {(r.id, r.kind): r.v for r in store.read("T").collect()}
    assert len(rows) == 51 and rows["7", "x"] == "new" and rows["7", "y"] == "other" and rows["8", "x"] == "old"
    for turn in range(3):
        store.upsert("T", news([("7", "x", f"v{turn}", turn)]), None, ["seq"])
    assert {(r.id, r.kind): r.v for r in store.read("T").collect()}["7", "x"] == "v2"
    folders = [p for p in (tmp_path / "dims" / "T").glob("v-*/__bucket=*") if p.name == f"__bucket={[b for b in after if after[b] != before[b]][0]}"]
    assert len(folders) <= 3  # older versions are gone


def test_days_are_folders(spark, tmp_path):
    from tidemark.plans import serving

    rows = spark.createDataFrame([("2021-03-01 10:00:00", "e", 1, 5.0, 1), ("2021-03-02 10:00:00", "e", 1, 7.0, 1)], "stt string, edt string, sku_id bigint, order_amount double, ts bigint")
    sinks.write_olap(rows, str(tmp_path / "p"))
    day = serving.gmv(sinks.read_olap(spark, str(tmp_path / "p"), "product_stats", merged=False), 20210302)
    assert day.first().gmv == 7.0
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert serving.today(20210302) == 20210302 and len(str(serving.today())) == 8


def test_connectors_are_asked_for(spark):
    """Without their jars the readers fail by name, not silently."""
    import pytest

    with pytest.raises(Exception, match="(?i)kafka"):
        readers.topic(spark, "t", "host:1", group="g")
    with pytest.raises(Exception, match="(?i)driver"):
        readers.jdbc(spark, "jdbc:none://h/db", "SELECT 1", camel=True)
    lines = readers.socket(spark, "localhost", 9)
    assert lines.isStreaming and lines.columns == ["value"]


def test_one_scan_for_each_table(spark):
    from tidemark import queries

    for name, most in (("product_stats", 2), ("log_split_page", 2)):
        plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, name
        assert "Expand" not in plan
