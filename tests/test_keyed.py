"""History operators against a replay of the state machines, batch and streaming."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import keyed
from tidemark.streaming import processors
from tidemark.streaming.run import drained

SCHEMA = "mid bigint, arrival bigint, ts bigint, day string, last_page_id string, is_new string"


def sequences(seed, n=400):
    r = random.Random(seed)
    t = 0
    for i in range(n):
        t += r.choice([0, 1000, 4000, 9999, 10000, 10001, 30000])
        yield (r.randrange(9), i, t, f"d{t // 500000}", r.choice([None, "", "home"]), r.choice(["0", "1", None]))


def replay_new(rows):
    seen, out = set(), []
    for mid, a, *_, new in rows:
        out.append((a, "0" if new == "1" and mid in seen else new))
        if new == "1":
            seen.add(mid)
    return sorted(out)


def replay_visits(rows):
    state, out = {}, []
    for mid, a, _, day, last, _ in rows:
        if not last and state.get(mid) != day:
            state[mid] = day
            out.append(a)
    return sorted(out)


def replay_bounces(rows, within=10_000):
    held, out = {}, []
    for mid, a, t, _, last, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if mid in held and (t - held[mid][1] >= within or not last):
            out.append(held[mid][0])
        held.pop(mid, None)
        if not last:
            held[mid] = (a, t)
    return sorted([*out, *[a for a, _ in held.values()]])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_is_replay(spark, seed):
    rows = list(sequences(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in keyed.repair_new_flag(df).select("arrival", "is_new").collect()) == replay_new(rows)
    assert sorted(r.arrival for r in keyed.unique_visits(df).collect()) == replay_visits(rows)
    assert sorted(r.arrival for r in keyed.bounces(df).collect()) == replay_bounces(rows)


def test_stream_is_replay(spark, tmp_path):
    rows = list(sequences(7))
    for i in range(0, len(rows), 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a record far in the future lets every timer expire
    spark.createDataFrame([(-1, 10**6, 10**9, "z", "home", "0")], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    new = drained(processors.repair_new_flag(stream.select("mid", "arrival", "is_new")))
    assert sorted(tuple(r) for r in new.where("mid >= 0").select("arrival", "is_new").collect()) == replay_new(rows)
    visits = drained(processors.unique_visits(stream), once=True)
    assert sorted(r.arrival for r in visits.where("mid >= 0").collect()) == replay_visits(rows)
    timed = stream.withColumn("event_time", F.timestamp_millis("ts"))
    jumps = drained(processors.bounces(timed))
    assert sorted(r.arrival for r in jumps.where("mid >= 0").collect()) == replay_bounces(rows)


def test_four_row_sample(spark):
    rows = [(101, 0, 10000, "d", None, "0"), (102, 1, 12000, "d", None, "0"), (102, 2, 15000, "d", "home", "0"), (102, 3, 30000, "d", "detail", "0")]
    assert [r.arrival for r in keyed.bounces(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_same_key_sample(spark):
    rows = [(1, i, t, "d", None, "0") for i, t in enumerate([370000, 375000, 379000, 392000])]
    assert sorted(r.arrival for r in keyed.bounces(spark.createDataFrame(rows, SCHEMA)).collect()) == [0, 1, 2, 3]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keyed.repair_new_flag(df).count() == keyed.unique_visits(df).count() == keyed.bounces(df).count() == 0
