"""Shards and mixes against plain Python."""

import collections
import random
import zlib

import pytest

from tidemark.llm import mixing, sharding
from tidemark.llm.common import global_prefix

SPACES = " \t\n\x0b\x0c\r"


def some_docs(seed, n=300):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", "é " * r.randrange(40), "w " * r.randrange(200)]), "en", r.choice(["a", "b", "b", "b", "ü", None, "zz"])) for i in range(n)]
    return rows + [rows[5]] * 20 + [(None, "x", "en", "a")]


def brute_shards(rows, n):
    ranked = sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=lambda r: (r[0] is not None, r))
    total, before, out, slots = sum(r[1] for r in ranked), 0, [], collections.Counter()
    for i, size, crc in ranked:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out.append((i, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize("n", [1, 5, 24])
def test_shards(docs, n):
    rows = some_docs(1)
    got = [tuple(r) for r in sharding.shard_by_bytes(docs(rows), n).collect()]
    assert sorted(got, key=repr) == sorted(brute_shards(rows, n), key=repr)
    sizes = collections.Counter()
    for _, size, _, shard, _ in got:
        sizes[shard] += size
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r[1] for r in got)


def test_shards_of_nothing(docs):
    assert sharding.shard_by_bytes(docs([(1, "a")]).where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_by_bytes(docs([(1, "a")]), 0)


def test_global_prefix_by_group(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), r.randrange(9)) for _ in range(500)] + [("a", 1, 2)] * 300
    df = spark.createDataFrame(rows, "g string, k int, v bigint").repartition(5)
    want, seen = [], collections.defaultdict(lambda: [0, 0])
    for g, k, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1], x[2])):
        want.append((g, k, v, *seen[g]))
        seen[g][0] += 1
        seen[g][1] += v
    got = [tuple(x) for x in global_prefix(df, ["g", "k", "v"], ("v",), "g").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= 2 * sizes[s]
        open_ -= full


def words(t):
    for c in SPACES[1:]:
        t = (t or "").replace(c, " ")
    return len([w for w in (t or "").split(" ") if w])


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 4), (3, 2)])
def test_mix(docs, seed, block):
    rows = some_docs(seed)
    out = mixing.mix(docs(rows), block=block).collect()
    again = mixing.mix(docs(rows, partitions=7), block=block).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(map(tuple, again), key=repr)
    sizes, taken, most = collections.Counter(), collections.Counter(), collections.Counter()
    for i, t, _, s in rows:
        sizes[s] += words(t)
        most[s] = max(most[s], words(t))
    want = brute_targets(sizes)
    assert sorted((r.k0 is None, r.k0 or 0, r.size) for r in out) == sorted((i is None, i or 0, words(t)) for i, t, *_ in rows)
    for r in out:
        taken[r.source] += r.copies * r.size
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)


def test_take(docs):
    rows = some_docs(5)
    df = docs(rows).withColumnRenamed("lang", "k0")
    counts = collections.Counter(map(tuple, mixing.take(df).collect()))
    total = sum(words(t) * c for (_, t, *_), c in counts.items())
    assert abs(total - 1.5 * sum(words(t) for _, t, *_ in rows)) < 5 * max(words(t) for _, t, *_ in rows)
    limit = collections.Counter((i, t, "en", s, None) for i, t, _, s in rows)
    assert all(c <= 2 * limit[r] for r, c in counts.items())
    assert mixing.take(df.where("false")).count() == 0


def test_native_plans(docs):
    for df in (sharding.shard_by_bytes(docs([(1, "a")])), mixing.mix(docs([(1, "a b", "en", "s")]))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
