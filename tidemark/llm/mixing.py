"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its documents
should have on average. The whole part is given to all of them; the rest is a
probability, and probability times size is the document's share of fractional words.
Documents fight in pairs: words move from one to the other, in a direction drawn so
that both keep their expected value, until one of the two has none or all of its words
and is settled. The other goes on to the next fight. Words only move, so a source's
taken words stay at its target up to the one document that is left at the end.

The fights are held in a tree: blocks of at most ``block`` documents first, then blocks
of the documents that blocks have left over, until each source has one. A hot source is
many blocks. Blocks follow the global rank in the source, the largest documents first and
by a hash within a size, so that the one document left at the end is a small one; draws
are hashes of that rank, so reruns and lost tasks give the same result. All of it is DataFrame and
SQL operations.

Defined cases: null text has size 0; a document of size 0 takes 0; null is a source of
its own, the last; equal rows are drawn one by one; documents that tie in size are ranked
by a hash; texts of any length are counted whole; an empty table gives no rows; other
columns, whatever their names, are ignored, or passed on by ``take``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, global_prefix, named, row_key, small_side, table, words

#: Weights of the sources by code point, repeating; share of all words to take; most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 256


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n_docs, source_size and target of each source, from rows of source and size.

    Targets are the lesser of ``most`` times a source's size and its weight times one
    level that all share. In the order of size over weight the sources that stop at
    their limit come first, so prefix sums over that order give the level.
    """
    by = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by = cut(by.withColumn("last", F.col("source").isNull().cast("int")), "sources")
    ranked = global_prefix(by, ["last", "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("g_index") % len(weights) + 1).cast("int"))
    weighed = ranked.withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * most).drop("g_index")
    weighed = weighed.withColumn("ratio", F.col("limit") / F.col("weight"))
    ordered = cut(global_prefix(weighed, ["ratio"], ("limit", "weight")), "ordered")
    total = ordered.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    levelled = ordered.crossJoin(F.broadcast(total)).withColumn(
        "level", (share * F.col("all_size") - F.col("before_limit")) / (F.col("all_weight") - F.col("before_weight"))
    )
    level = levelled.where(F.col("ratio") > F.col("level")).agg(F.min_by("level", "g_index").alias("final"))  # one row
    free = F.col("limit").cast("double")
    return ordered.crossJoin(F.broadcast(level)).select(
        "source", "n_docs", "source_size", F.coalesce(F.least(free, F.col("final") * F.col("weight")), free).alias("target")
    )


def _fights(item: str) -> str:
    """SQL that lets the items of a block fight one after another; it yields the one left over and those settled."""
    moved = "named_struct({fields}, 'm', {m}, 'u', {w}.u)"

    def left(who: str, mass: str) -> str:
        return moved.format(fields=", ".join(f"'{f}', {who}.{f}" for f in item.split()), m=mass, w=who)

    def step(stays: str, mass: str, gone: str, bit: int) -> str:
        return f"named_struct('a', {left(stays, mass)}, 'done', concat(acc.done, array(named_struct('who', {gone}, 'bit', {bit}))))"

    a, x = "acc.a", "x"
    return f"""CASE WHEN acc.a IS NULL THEN named_struct('a', x, 'done', acc.done)
      WHEN x.u * (least({a}.m, x.size - x.m) + least(x.m, {a}.size - {a}.m)) < least(x.m, {a}.size - {a}.m)
      THEN CASE WHEN {a}.m <= x.size - x.m THEN {step(x, f"x.m + {a}.m", a, 0)} ELSE {step(a, f"{a}.m - (x.size - x.m)", x, 1)} END
      ELSE CASE WHEN x.m <= {a}.size - {a}.m THEN {step(a, f"{a}.m + x.m", x, 0)} ELSE {step(x, f"x.m - ({a}.size - {a}.m)", a, 1)} END END"""


def mix(df: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text", source_col: str = "source", seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """A row for each of ``df``: k0, k1, ... (its keys), source, size, source_size, target, copies (0 to ``most``)."""
    names = [f"k{i}" for i in range(len(keys))]
    sized = cut(
        df.select(*[named(k).alias(n) for k, n in zip(keys, names, strict=True)], named(source_col).alias("source"), F.size(words(named(text_col))).cast("long").alias("size")),
        "sized",
    )
    goal = cut(targets(sized, weights, share, most), "targets")
    largest = goal.agg(F.max("n_docs")).head()[0] or 0  # one number
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate)).withColumn("rest", rate - F.floor(rate))
    sized = sized.withColumn("draw", F.xxhash64(F.lit(seed), *names, "size"))
    ranked = global_prefix(sized.withColumn("falling", -F.col("size")), ["source", "falling", "draw", *names], group="source")
    goal = goal.withColumnRenamed("source", "its")
    rows = cut(
        ranked.join(goal, ranked["source"].eqNullSafe(goal["its"])).select(
            *names, "source", "size", "source_size", "target", "whole", "rest", "g_index"
        ),
        "ranked",
    )
    certain = (F.col("rest") == 0) | (F.col("size") == 0)
    out = [rows.where(certain).select(*names, "source", "size", "whole", F.lit(0).alias("bit"))]
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("source"), F.col("at"), F.col("level")), F.lit(1 << 52)) / float(1 << 52)
    fields = [*names, "whole", "size"]
    item = F.struct(*fields, "m", draw.alias("u"))
    level, blocks = 0, largest
    tier = rows.where(~certain).select("source", F.col("g_index").alias("at"), *fields, (F.col("rest") * F.col("size")).alias("m"))
    kind = tier.withColumn("level", F.lit(0)).select(item.alias("i")).schema["i"].dataType.simpleString()
    while True:
        blocks = -(-blocks // block)
        grouped = (
            tier.withColumn("level", F.lit(level))
            .withColumn("item", item)
            .groupBy("source", F.expr(f"at div {block}").alias("at"))  # at most `block` rows each
            .agg(F.sort_array(F.collect_list(F.struct("at", "item"))).alias("items"))
        )
        none = f"named_struct('a', CAST(NULL AS {kind}), 'done', CAST(array() AS array<struct<who:{kind},bit:int>>))"
        fought = f"aggregate(transform(items, i -> i.item), {none}, (acc, x) -> {_fights(' '.join(fields))})"
        settled = cut(grouped.select("source", "at", F.expr(fought).alias("r")).select("source", "at", "r.*"), f"level{level}")
        who = [F.col(f"d.who.{f}").alias(f) for f in fields]
        out.append(settled.select("source", F.explode("done").alias("d")).select(*[w for w, f in zip(who, fields, strict=True) if f in names], "source", F.col("d.who.size").alias("size"), F.col("d.who.whole").alias("whole"), F.col("d.bit").alias("bit")))
        tier = settled.select("source", "at", *[F.col(f"a.{f}").alias(f) for f in fields], F.col("a.m").alias("m"))
        level += 1
        if blocks <= 1:
            break
    last = tier.withColumn("level", F.lit(level))
    out.append(last.select(*names, "source", "size", "whole", (draw * F.col("size") < F.col("m")).cast("int").alias("bit")))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    result = result.join(goal.select("its", "source_size", "target"), F.col("source").eqNullSafe(F.col("its")))
    return result.select(*names, "source", "size", "source_size", "target", (F.col("whole") + F.col("bit")).cast("int").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("k0").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take(df: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken, columns unchanged.

    Rows that are equal in all columns are drawn one by one and counted together: one of
    them is repeated as often as all of them are taken. The draws are made on keys of rows;
    whole rows meet their counts by a broadcast if these are few, else by a shuffle.
    """
    key = fresh(df, "k0", "k1", "times")
    marked = df.withColumns(dict(zip(key, row_key(df), strict=False)))
    drawn = mix(marked, tuple(key[:2]), text, source)
    times = drawn.groupBy(F.col("k0").alias(key[0]), F.col("k1").alias(key[1])).agg(F.sum("copies").cast("int").alias(key[2]), F.count(F.lit(1)).alias("__rows"))
    times = cut(times.where(F.col(key[2]) > 0), "times")
    n, most = times.agg(F.count(F.lit(1)), F.max("__rows")).head()

    def met(some: DataFrame) -> DataFrame:
        return marked.join(small_side(some.drop("__rows"), n), key[:2])

    taken = met(times.where("__rows = 1"))
    if (most or 0) > 1:
        taken = taken.unionByName(met(times.where("__rows > 1")).dropDuplicates(key[:2]))
    copies = F.explode(F.sequence(F.lit(1), F.col(key[2])))
    return taken.withColumn(key[2], copies).select(*[named(c) for c in df.columns])
