"""Near duplicates by bottom-k sketches.

A text's set is the distinct hashes of its runs of words, and its sketch the k smallest
of them, from one hash function. Texts with equal sets are one node from the start, so
that copies are never compared. Two sets with a similarity of ``SIMILAR`` or more hold
at least ``least_shared`` values of their sketches in common but for a chance of
``MISSED``, and so share one of the first of each when both are ordered by how many
nodes retain a value, rarest first: only these go to the inverted lists, and passages
that many texts hold go there only with texts that consist of little else.

1. One node of each inverted list (its pivot, the one that has most of its retained values
   in common with others, as the source of many copies has) is paired with the others. Pairs pass if
   the sketch of their union has enough values of both, and are links if the exact
   Jaccard similarity of the full sets says so. Connected nodes get one label.
2. Nodes of different labels that share a pivot may still be linked. Up to ``SMALL``
   nodes of a pivot are paired. Beyond, with X the symmetric difference of x and a
   reference set p, x and y are alike only if X and Y overlap enough, as the difference
   of x and y is that of X and Y. That overlap is over zero unless both are close to p, so
   prefixes of X and Y in one order have a value in common, which another inverted list
   over (p, value) finds; near copies of one text differ from it in different places, and
   few of them meet there.
3. Only labels are asked for, not all links of a group: the node nearest to p is paired
   with all of the pivot's nodes first, and lists whose nodes have one label then are done
   with. In the others the nodes outside each list's most frequent label are paired with
   all. If that is much work, there are rounds before in which all nodes of a list are
   paired with ``REPS`` of it and what is linked gets one label. As signatures of the sets
   tell the pairs that are linked from nearly all that are not, hardly any others are left.
4. All pairs pass the same filter and the same exact check; labels are joined up.

Nothing is dropped or capped: the lists are exact but for the chance that the sketches
of a linked pair are that unlike. No group is collected; hot lists are sums and joins.
Sets are sets of 63-bit hashes of shingles, made from 128-bit digests of their words; two
different shingles agree with a chance of 2**-63, whatever they are, and two different
sets are one node with one of 2**-127.

Defined cases: null and empty texts have the empty set, are linked with nothing and
kept; rows with one doc_id and several texts are a node for each text; rows without
doc_id count in the node of their set, but a node of such rows alone is linked with
nothing and has no component_id; texts of any length are read whole; an empty table gives
no rows; other columns, whatever their names, are ignored, or passed on by ``keep_one``.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, cut, fresh, keeps, named, row_key, small_side, table
from .hashing import forget, mix, shingles

SKETCH = 64
SIMILAR = 0.8
MISSED = 2e-10
#: Nodes of a pivot up to which they are paired one by one.
SMALL = 48
#: Nodes of a list that all of it is paired with in a round, rounds at most, and entries that an
#: entry is paired with on average beyond which there is another round; what they leave is paired in full.
REPS, ROUNDS, PAIRED = 4, 3, 1024
STEP_BYTES = 1 << 18


def least_shared(k: int, similar: float = SIMILAR, missed: float = MISSED) -> int:
    """The most values that k draws from the union have in common but for a chance of ``missed``."""
    chance, m = 0.0, 0
    while (chance := chance + comb(k, m) * similar**m * (1 - similar) ** (k - m)) <= missed:
        m += 1
    return m


def _enough(size: str, k: int) -> str:
    """SQL for how many of ``size`` values two linked sketches share at least."""
    return f"least({least_shared(k)}, CAST(ceil({size} * {SIMILAR} - 1e-9) AS int))"


def _identity(values: np.ndarray, second: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, from two independent hashes of its members."""
    return int(mix(values.astype(np.uint64)).sum(dtype=np.uint64).astype(np.int64)), int(mix(second + np.uint64(len(second))).sum(dtype=np.uint64).astype(np.int64))


#: Bits of a set's signature, in words of 64.
BITS = 1024


def _parities(values: np.ndarray) -> list[int]:
    """For each of ``BITS`` bits, whether an odd number of values falls on it. Two sets' signatures differ in no more bits than the sets in values."""
    odd = np.bincount(values % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def with_sets(df: DataFrame, text: str, words: int, what: str) -> DataFrame:
    """The columns of ``df`` but ``text``, with __a and __b (the set's identity), __n (its size) and, as ``what`` says, __sketch, or __set and its __bits."""
    longs = T.ArrayType(T.LongType())
    added = [T.StructField(c, T.LongType()) for c in ("__a", "__b", "__n")] + [T.StructField(c, longs) for c in {"sketch": ["__sketch"], "set": ["__set", "__bits"]}[what]]

    def begin():
        keeps("shingles", forget)

        def work(texts: list[bytes], known: list[bool]) -> list[pa.Array]:
            both = shingles(texts, words)
            ids = [_identity(*s) for s in both]
            made = [pa.array([a for a, _ in ids], pa.int64()), pa.array([b for _, b in ids], pa.int64()), pa.array([len(s) for s, _ in both], pa.int64())]
            made.append(pa.array([s[:SKETCH] if what == "sketch" else s for s, _ in both], pa.list_(pa.int64())))
            return made if what == "sketch" else [*made, pa.array([_parities(s) for s, _ in both], pa.list_(pa.int64()))]

        return work

    return computed(df, named(text), added, begin, (text,), STEP_BYTES)


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of the pairs x, y those whose union's sketch has enough values of both and whose sizes allow it, with the sizes nx and ny."""
    own = nodes.select("node", "n", "sketch")
    met = pairs.join(own.toDF("x", "nx", "sx"), "x").join(own.toDF("y", "ny", "sy"), "y")
    both = f"slice(array_sort(array_union(sx, sy)), 1, {SKETCH})"
    shared = "size(array_intersect(array_intersect(sx, sy), u))"
    met = met.where("100 * least(nx, ny) >= 80 * greatest(nx, ny)").withColumn("u", F.expr(both))
    return met.where(f"{shared} >= {_enough('size(u)', SKETCH)}").select("x", "y", "nx", "ny")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs x, y (x may be a hub) those whose full sets are similar."""
    met = pairs.join(sets.select(F.col("node").alias("y"), F.col("set").alias("ty")), "y").join(sets.select(F.col("node").alias("x"), F.col("set").alias("tx")), "x")
    met = met.withColumn("both", F.size(F.array_intersect("tx", "ty")).cast("long"))
    return met.where("100 * both >= 80 * (nx + ny - both)").select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node that it reaches) of every node in the links x, y.

    Every node is joined to its smallest neighbour, the chains are halved, and the
    links are drawn anew between what is left, until none is.
    """
    labels = None
    edges = cut(links.where("x != y").select("x", "y").distinct(), "edges")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        up = ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("p"))
        again = up.toDF("p", "pp")
        up = cut(up.join(again, "p").select("x", F.col("pp").alias("p")), "parents")
        left, right = up.toDF("x", "px"), up.toDF("y", "py")
        edges = cut(edges.join(left, "x").join(right, "y").where("px != py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "edges")
        if labels is None:
            labels = up.toDF("node", "label")
        else:
            moved = labels.join(up.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = cut(moved, "labels")
    return labels if labels is not None else links.select(F.col("x").alias("node"), F.col("x").alias("label")).where("false")


def _relabelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``df`` with the label of its node; a node without links is its own label."""
    return df.join(labels.toDF(node, "__label"), node, "left").withColumn(label, F.coalesce("__label", node)).drop("__label")


def _small_pairs(group: DataFrame) -> DataFrame:
    """Pairs of different labels among a pivot's nodes; ``group`` has pivot, node, n and label."""
    x, y = (group.select("pivot", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("label").alias(f"l{c}")) for c in "xy")
    return x.join(y, "pivot").where("x < y AND lx != ly AND 100 * least(nx, ny) >= 80 * greatest(nx, ny)").select("x", "y").distinct()


def _apart(group: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, node, n, first, bits, d and diff (what differs from the reference, d values) of each node of pivots with many; see the module's text.

    The reference p is what half of the pivot's nodes have of the pivot.
    """
    own = sets.select("node", F.col("set").alias("own"), "bits")
    hub = sets.select(F.col("node").alias("pivot"), F.col("set").alias("hub"))
    held = group.join(own, "node").join(hub, "pivot")
    n_parts = int(group.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = held.select("pivot", "node", "many", F.array_intersect("own", "hub").alias("has")).repartition(n_parts, "pivot", "node")  # a hot pivot's nodes go to all tasks
    common = even.select("pivot", "many", F.explode("has").alias("v"))
    counts = common.groupBy("pivot", "v", "many").agg(F.count(F.lit(1)).alias("n")).where("2 * n >= many")
    middle = cut(counts.groupBy("pivot").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "v"))).alias("mid")).select("pivot", F.col("mid.v").alias("mid")), "middle")  # as long as the pivot's set at most
    met = group.join(own, "node").join(middle, "pivot", "left").withColumn("mid", F.coalesce("mid", F.array().cast("array<bigint>")))
    # one order for all nodes of a pivot: what they add, mostly theirs alone, then what they lack, first what few lack
    apart = met.withColumn("diff", F.concat(F.array_sort(F.array_except("own", "mid")), F.array_except("mid", "own")))
    return cut(apart.select("pivot", "node", "n", F.col("label").alias("first"), "bits", F.size("diff").alias("d"), "diff"), "apart")


def _entries(apart: DataFrame, best: DataFrame) -> DataFrame:
    """Lists of the values that nodes differ in from the reference.

    With a and b the sizes of X and Y, a <= b, and sizes nx and ny within a factor of
    1.25, linked x and y share c >= (a + b - (nx + ny) / 9) / 2 values of X and Y. Where
    that is not over zero the two are linked for certain. The node with the greatest
    n - 9 a, r, has been paired with all others; any two nodes that aren't both linked to
    it for certain have c over zero. As seen from x, c is at least a - nx / 8 and
    (a + (r - 1.25 nx) / 9) / 2, as seen from y, as a >= c, b - ny / 4: the entries before
    ``near`` are x's in the role of x, and all are its own in the role of y.
    """
    n_parts = int(apart.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least_near = "greatest(1, CAST(ceil(greatest(d - n / 8, (d + (r - 1.25 * n) / 9) / 2) - 1e-9) AS int))"
    least_far = "greatest(1, CAST(ceil(d - n / 4 - 1e-9) AS int))"
    even = apart.join(best, "pivot").repartition(n_parts, "pivot", "node")
    far = even.selectExpr("pivot", "node", "n", "first", "label", "bits", "d", f"d - {least_near} + 1 AS near", f"slice(diff, 1, greatest(0, d - {least_far} + 1)) AS far")
    return far.select("pivot", "node", "n", "first", "label", "bits", "d", "near", F.posexplode("far").alias("at", "v"))


_ENTRY = ("n", "label", "bits", "d", "at", "near")


def _met(xs: DataFrame, ys: DataFrame) -> DataFrame:
    """Pairs x, y of entries of a list that may be linked: ``xs`` in the role of x, ``ys`` in that of y.

    Of the values from their first common one on, both must have c, and neither b - a
    nor the bits in which their signatures differ can be over (nx + ny) / 9.
    """
    side = lambda rows, c: rows.select("pivot", "v", F.col("node").alias(c), *[F.col(x).alias(x + c) for x in _ENTRY])
    differ = " + ".join(f"bit_count(bitsx[{i}] ^ bitsy[{i}])" for i in range(BITS // 64))
    met = side(xs, "x").join(side(ys, "y"), ["pivot", "v"]).where(
        f"""labelx != labely AND (dx < dy OR (dx = dy AND x < y)) AND atx < nearx AND 100 * least(nx, ny) >= 80 * greatest(nx, ny)
        AND 18 * least(dx - atx, dy - aty) >= 9 * (dx + dy) - (nx + ny) AND 9 * (dy - dx) <= nx + ny AND 9 * ({differ}) <= nx + ny"""
    )
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))


def _several(entries: DataFrame) -> DataFrame:
    """The entries of lists with more than one label, with the list's most frequent label as ``most`` and the number of entries that it is paired with in the end as ``against``."""
    by_label = entries.groupBy("pivot", "v", "label").agg(F.count(F.lit(1)).alias("k"))
    lists = by_label.groupBy("pivot", "v").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.max("k").alias("top"), F.sum("k").alias("length")).where("top < length")
    against = F.when(F.col("label") == F.col("most"), F.col("length") - F.col("top")).otherwise(F.col("length"))
    return cut(entries.drop("most", "against").join(lists, ["pivot", "v"]).withColumn("against", against).drop("top", "length"), "mixed")


def _represented(entries: DataFrame, turn: int) -> DataFrame:
    """Pairs of the entries of each list with ``REPS`` of it, others in every turn."""
    item = F.struct("node", *_ENTRY)
    draws = [F.struct("d", "node")] if turn == 0 else []
    draws += [F.struct(F.xxhash64(F.lit(turn * REPS + k), "node"), "node") for k in range(REPS - len(draws))]
    reps = entries.groupBy("pivot", "v").agg(*[F.min_by(item, draw).alias(f"r{k}") for k, draw in enumerate(draws)])
    reps = reps.select("pivot", "v", F.explode(F.array_distinct(F.array(*[f"r{k}" for k in range(len(draws))]))).alias("r")).select("pivot", "v", "r.*")
    reps = cut(reps, "reps")
    return _met(reps, entries).unionByName(_met(entries, reps)).distinct()


def _large_links(group: DataFrame, sets: DataFrame, nodes: DataFrame) -> list[DataFrame]:
    """Links between nodes of different labels among the nodes of pivots with many, as many as join all that belong together."""

    def checked(pairs: DataFrame) -> DataFrame:
        return cut(_verified(cut(_estimated(cut(pairs, "rest"), nodes), "near"), sets), "links")

    apart = _apart(group, sets)
    first = apart.select("node", "first").distinct()
    best = apart.groupBy("pivot").agg(F.min_by("node", F.struct(9 * F.col("d") - F.col("n"), "node")).alias("best"), F.max(F.col("n") - 9 * F.col("d")).alias("r"))
    best = cut(best, "best")
    sure = apart.select("pivot", "node").join(best, "pivot").where("node != best").select(F.least("node", "best").alias("x"), F.greatest("node", "best").alias("y"))
    found = [checked(sure.distinct())]
    left = _several(_entries(_relabelled(apart, components(_by_label(found, first)), "first", "label"), best))
    for turn in range(ROUNDS):
        work, many = left.agg(F.sum("against"), F.count(F.lit(1))).head()
        if not many:
            return found
        if work <= PAIRED * many:
            break
        found.append(checked(_represented(left, turn)))
        if found[-1].isEmpty():
            break
        left = _several(_relabelled(left.drop("label"), components(_by_label(found, first)), "first", "label"))
    # all that is left: what isn't of a list's most frequent label with everything, in either role
    own, other = left.where("label = most"), left.where("label != most")
    return [*found, checked(_met(other, left).unionByName(_met(own, other)).distinct())]


def _by_label(links: list[DataFrame], first: DataFrame) -> DataFrame:
    """All of ``links`` between the labels that their nodes had at first."""
    every = reduce(DataFrame.unionByName, links)
    x, y = first.toDF("x", "lx"), first.toDF("y", "ly")
    return every.join(x, "x").join(y, "y").select(F.col("lx").alias("x"), F.col("ly").alias("y"))


def link(df: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: each row's doc_id, __k0 and __k1 (its ``row_key``), __a, __b, __n and __sketch; and each node's a, b, n, min_doc and component (of node numbers)."""
    k0, k1 = row_key(df)
    rows = cut(with_sets(df.select(named(id_col).alias("doc_id"), k0.alias("__k0"), k1.alias("__k1"), named(text_col).alias("text")), "text", words, "sketch"), "rows")
    full = rows.where("__n > 0")
    nodes = full.groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(F.min("doc_id").alias("min_doc"), F.first("__n").alias("n"), F.first("__sketch").alias("sketch"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # inverted lists of the rarest retained values
    retained = nodes.where("min_doc IS NOT NULL").select("node", F.explode("sketch").alias("v"))
    often = retained.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = retained.join(often, "v").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("often"))
    held = held.join(nodes.select("node", F.least(F.col("n"), F.lit(SKETCH)).cast("int").alias("s")), "node")
    first = F.expr(f"slice(often, 1, greatest(0, s - {_enough('s', SKETCH)} + 1 - (s - size(often))))")
    lists = cut(held.select("node", F.size("often").alias("common"), F.explode(first).alias("t")).select(F.col("t.v").alias("v"), "node", "common"), "lists")

    # each list's pivot, the node with most values in common with others, with the rest of the list
    pivots = lists.groupBy("v").agg(F.min_by("node", F.struct(-F.col("common"), "node")).alias("pivot"), F.count(F.lit(1)).alias("length")).where("length > 1")
    star = cut(lists.join(pivots, "v").where("node != pivot").select("pivot", "node").distinct(), "star")
    near = cut(_estimated(star.toDF("x", "y"), nodes), "near")
    wanted = cut(star.select("pivot").union(star.select("node")).distinct().toDF("node").join(nodes.select("node", "a", "b", "n", "min_doc"), "node"), "wanted")
    some = df.select(named(id_col).alias("doc_id"), named(text_col).alias("text")).join(wanted.select(F.col("min_doc").alias("doc_id")).distinct(), "doc_id", "left_semi")
    found = with_sets(some.select("text"), "text", words, "set")
    sets = cut(found.join(wanted, (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b"))).groupBy("node").agg(F.first("__set").alias("set"), F.first("__bits").alias("bits")), "sets")
    labels = components(_verified(near, sets))

    # what is left among the nodes of a pivot; pivots of one label are one, that with the most nodes
    hubs = _relabelled(star.groupBy("pivot").agg(F.count(F.lit(1)).alias("own")), labels, "pivot", "hub")
    chief = hubs.groupBy("hub").agg(F.max_by("pivot", F.struct("own", "pivot")).alias("chief"))
    chief = cut(hubs.select("pivot", "hub").join(chief, "hub").select("pivot", "chief", "hub"), "chiefs")
    group = star.join(chief, "pivot").select(F.col("chief").alias("pivot"), "hub", "node").distinct().join(nodes.select("node", "n"), "node")
    group = _relabelled(group, labels, "node", "label")
    sizes = group.groupBy("pivot").agg(F.count(F.lit(1)).alias("many"), F.max(F.col("label") != F.col("hub")).alias("mixed")).where("mixed AND many > 1")
    group = cut(group.join(sizes, "pivot").select("pivot", "node", "n", "label", "many"), "group")
    rest = _small_pairs(group.where(F.col("many") <= SMALL))
    more = _verified(cut(_estimated(cut(rest, "rest"), nodes), "near"), sets)
    large = group.where(F.col("many") > SMALL)
    if not large.isEmpty():
        for links in _large_links(large, sets, nodes):
            more = more.unionByName(links)
    joined = components(_relabelled(_relabelled(more, labels, "x", "lx"), labels, "y", "ly").select(F.col("lx").alias("x"), F.col("ly").alias("y")))
    nodes = _relabelled(nodes.select("node", "a", "b", "n", "min_doc"), labels, "node", "first")
    nodes = _relabelled(nodes, joined, "first", "component").drop("first")
    return rows, cut(nodes, "components")


def _resolved(df: DataFrame, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows, nodes = link(df, words, id_col, text_col)
    lowest = nodes.groupBy("component").agg(F.min("min_doc").alias("component_id"))
    return rows, nodes.join(lowest, "component")


def deduplicate(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, n_shingles, component_id (the smallest doc_id that it reaches) and kept (whether it is that one)."""
    rows, nodes = _resolved(df.select(named(id_col), named(text_col)), words, id_col, text_col)
    met = rows.drop("__sketch").join(nodes.select("a", "b", "component_id"), (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")) & (F.col("__n") > 0), "left")
    component: Column = F.when(F.col("__n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return met.select("doc_id", F.col("__n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def keep_one(df: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without words, and of each component one row, with the smallest doc_id; columns unchanged.

    Which rows go is decided on their keys alone; texts are read once more at the end and
    only move if there are too many of these keys to broadcast.
    """
    rows, nodes = _resolved(df, words, id_col, text_col)
    best = nodes.where(F.col("min_doc").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min(F.struct("min_doc", "a", "b")).alias("k")).select("k.*")
    same = (F.col("__a") == F.col("a")) & (F.col("__b") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("min_doc"))
    one = rows.where("__n > 0").join(best, same).groupBy("__a", "__b").agg(F.min(F.struct("__k0", "__k1")).alias("k")).select("k.*")
    keyed = rows.where("__n > 0").groupBy("__k0", "__k1").agg(F.count(F.lit(1)).alias("__rows"))
    kept = one.withColumn("__kept", F.lit(True))
    fate = cut(keyed.join(kept, ["__k0", "__k1"], "left").where("__kept IS NULL OR __rows > 1").select("__k0", "__k1", F.coalesce("__kept", F.lit(False)).alias("__kept")), "fate")
    counts = {r["__kept"]: r["count"] for r in fate.groupBy("__kept").count().collect()}  # two rows
    key = fresh(df, "k0", "k1")
    marked = df.withColumns(dict(zip(key, row_key(df), strict=True)))
    gone = fate.select(F.col("__k0").alias(key[0]), F.col("__k1").alias(key[1]), "__kept")
    out = marked.join(small_side(gone.drop("__kept"), sum(counts.values())), key, "left_anti")
    if counts.get(True):  # kept rows that are there several times, equal in all columns
        out = out.unionByName(marked.join(gone.where("__kept").drop("__kept"), key, "left_semi").dropDuplicates(key))
    return out.select(*[named(c) for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), words=4)
