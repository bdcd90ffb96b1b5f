"""Quality rules: fixed limits, then robust multivariate outliers.

Statistics of a text are turned into a vector (logarithms of its length, of its mean
word length and of its shares of symbols, repeated lines and repeated words). For each
language and source the minimum covariance determinant gives a centre and a scatter that
outliers do not move: several starts (distances by medians and quartiles, and by the
covariances of spatial signs and of bounded scores) go through concentration steps, each
of which takes the mean and the covariance of the ``COVERAGE`` of the rows that are
nearest by the last estimate; the start whose covariance has the least determinant goes
on until it hardly changes. The same is done for each language and for all documents.
A language's estimate is then drawn towards that of all documents, and a source's towards
its language's, as if that were worth ``WORTH`` rows, so that a few rows have little say and
every document is judged, whatever the size of its group. A document is rejected when
its squared Mahalanobis distance is over ``CUTOFF``.

All of it is DataFrame and SQL functions. Texts are read once; their statistics are
written to the scratch folder and only these short rows are grouped, by sums and by
counts in bins, which are combined before they are shuffled; estimates come back to the
rows by a broadcast of their counted table (by a shuffle where that is long), so that a
hot source is only more rows to sum up. Quartiles and coverage limits come from such bins
and are the same whatever the partitions. Repeated windows are told by 64-bit hashes of
their words; two different ones of a text agree with a chance of 2**-64.

Defined cases: null text has no words; texts with fewer than 20 words fail the fixed
limits; null languages and sources are groups of their own; equal rows count one by one
and get the same verdict; of starts that tie the first is taken; of rows that tie at the
coverage limit all are taken; texts of any length are read whole; an empty table gives no
rows; other columns, whatever their names, are ignored or, in ``keep``, passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, small_side, table, words

#: Characters that count as symbols, words in a window, limits of the base rule.
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent


def _repeated(n: str) -> str:
    """SQL for the words inside windows whose hash occurs again in the array ``n``."""
    return f"""CASE WHEN size(array_distinct({n})) = size({n}) THEN 0L ELSE
      transform(array(sort_array(transform({n}, (x, i) -> named_struct('h', x, 'i', i)))), s ->
        aggregate(
          transform(array(sort_array(transform(
            filter(
              zip_with(zip_with(s, concat(array(CAST(NULL AS struct<h:bigint,i:int>)), slice(s, 1, size(s) - 1)), (c, p) -> named_struct('c', c, 'p', p.h)),
                       slice(s, 2, size(s)), (cp, q) -> named_struct('i', cp.c.i, 'again', cp.c.h <=> cp.p OR cp.c.h <=> q.h)),
              e -> e.again),
            e -> e.i))), at -> zip_with(at, slice(at, 2, size(at)), (a, b) -> CAST(least({WINDOW_WORDS}, b - a) AS bigint)))[0],
          0L, (sum, v) -> sum + v))[0] END"""


def statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long) of each row's whole text."""
    whole = F.coalesce(named(text), F.lit(""))
    rows = df.select(*[named(k) for k in keep], whole.alias("__text"), words(named(text)).alias("__words"))
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SYMBOLS, F.col("__text"))
    lines = F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        *[named(k) for k in keep],
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(plain)).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.expr(f"CASE WHEN size(__words) < {WINDOW_WORDS} THEN CAST(array() AS array<bigint>) ELSE transform(sequence(1, size(__words) - {WINDOW_WORDS - 1}), i -> xxhash64(slice(__words, i, {WINDOW_WORDS}))) END").alias("__windows"),
    )
    return rows.select(*[named(c) for c in rows.columns[:-1]], F.expr(_repeated("__windows")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


#: Share of the rows whose covariance has the least determinant; concentration steps of each start, and of the best one after that.
COVERAGE = 0.75
STEPS, MORE_STEPS = 2, 2
STARTS = 3
#: Rows that the estimate of all rows of a language is worth to a source in it, and that of all documents to a language.
WORTH = 100
#: Least standard deviation of each coordinate: closer texts are not told apart, and a constant coordinate does not make the scatter singular.
FLOOR = (0.25, 0.04, 0.3, 0.7, 1.0)
#: Chance that a normal vector is rejected. Statistics of texts have longer tails than that, hence so low.
TAIL = 1e-9
#: Bins in a unit of a coordinate or a logarithmic distance.
BINS = 64
D = len(FLOOR)


def chi_square_cdf(x: float, d: int) -> float:
    """Probability that a chi-square variable with ``d`` degrees of freedom is at most ``x``."""
    import math

    term = total = 1.0 / (d / 2)
    for k in range(1, 2000):
        term *= (x / 2) / (d / 2 + k)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total * math.exp(-x / 2 + d / 2 * math.log(x / 2) - math.lgamma(d / 2))) if x > 0 else 0.0


def chi_square_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, d) < p else (low, middle)
    return high


#: The covariance of the nearest share of normal rows is smaller than that of all by this factor.
CONSISTENCY = COVERAGE / chi_square_cdf(chi_square_quantile(COVERAGE, D), D + 2)
CUTOFF = chi_square_quantile(1 - TAIL, D)


def vector() -> list[Column]:
    words_, chars = F.col("n_words") + 1.0, F.col("word_chars") + 1.0
    return [
        F.log(words_),
        F.log(chars / words_),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / words_),
        F.log1p(100 * F.col("n_repeat_words") / words_),
    ]


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
MEANS = [f"m{i}" for i in range(D)]
SPREADS = [f"s{i}{j}" for i, j in PAIRS]
FACTORS = [f"i{i}{j}" for i, j in PAIRS]


def _cells(rows: DataFrame) -> tuple[DataFrame, int]:
    """__l, __s, __n (rows that pass the fixed limits) and __names, of the three cells whose estimates the rows are part of: their own, their language's, and that of all; and how many there are."""
    name = lambda *of: F.to_json(F.struct(*[F.col(c).alias(c[2:]) for c in of]), {"ignoreNullFields": "false"})
    counts = rows.where("NOT __failed").groupBy(F.col("__lang").alias("__l"), F.col("__source").alias("__s")).agg(F.count(F.lit(1)).alias("__n"))
    cells = cut(counts.withColumn("__names", F.array(name("__l", "__s"), name("__l"), F.lit("{}"))), "cells")
    return cells, cells.count()


def _factored(found: DataFrame) -> DataFrame:
    """Adds i00, i10, ..., the inverse Cholesky factor of the scatter s00, s10, ..., and logdet, the logarithm of its determinant."""
    columns = found.columns
    for i, j in PAIRS:
        known = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        found = found.withColumn(f"l{i}{j}", F.sqrt(F.greatest(F.col(f"s{i}{i}") - known, F.lit(1e-12))) if i == j else (F.col(f"s{i}{j}") - known) / F.col(f"l{j}{j}"))
    for i, j in PAIRS:
        known = sum((F.col(f"l{i}{k}") * F.col(f"i{k}{j}") for k in range(j, i)), F.lit(0.0))
        found = found.withColumn(f"i{i}{j}", 1 / F.col(f"l{i}{i}") if i == j else -known / F.col(f"l{i}{i}"))
    return found.select(*columns, *FACTORS, sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0)).alias("logdet"))


def _distance() -> Column:
    """Squared Mahalanobis distance from the estimate that the row has been joined with."""
    z = [sum((F.col(f"i{i}{j}") * (F.col(f"__x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(D)]
    return sum((v * v for v in z), F.lit(0.0))


def _concentrated(measured: DataFrame, estimates: DataFrame, n: int) -> DataFrame:
    """For each estimate (__cell and __start, of which there are ``n``) that of the rows that are nearest by it."""
    key = ["__cell", "__start"]
    small = small_side(estimates.select(*key, *MEANS, *FACTORS), n)
    near = measured.join(small, "__cell").withColumn("__bin", F.floor(BINS * F.log1p(_distance())))
    limit = small_side(near.groupBy(*key).agg(F.percentile("__bin", COVERAGE).alias("__limit")), n)
    inside = near.join(limit, key).where("__bin <= __limit")
    # centred on the last estimate, so that squares do not swamp the variance
    y = [F.col(f"__x{i}") - F.col(f"m{i}") for i in range(D)]
    sums = [F.first(m).alias(f"last_{m}") for m in MEANS] + [F.avg(y[i]).alias(f"y{i}") for i in range(D)] + [F.avg(y[i] * y[j]).alias(f"p{i}{j}") for i, j in PAIRS]
    spread = [(CONSISTENCY * (F.col(f"p{i}{j}") - F.col(f"y{i}") * F.col(f"y{j}")) + (FLOOR[i] ** 2 if i == j else 0.0)).alias(f"s{i}{j}") for i, j in PAIRS]
    found = inside.groupBy(*key).agg(*sums).select(*key, *[(F.col(f"last_m{i}") + F.col(f"y{i}")).alias(f"m{i}") for i in range(D)], *spread)
    return cut(_factored(found), "scatter")


def _starts(measured: DataFrame, n: int) -> DataFrame:
    """The estimates that concentration begins with, for each of ``n`` cells: medians, and three scatters."""
    quartiles = measured.groupBy("__cell").agg(*[F.percentile(F.floor(BINS * F.col(f"__x{i}")), [0.25, 0.5, 0.75]).alias(f"q{i}") for i in range(D)])
    medians = [(F.col(f"q{i}")[1] / BINS).alias(f"m{i}") for i in range(D)]
    scales = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / BINS / 1.349, F.lit(FLOOR[i])).alias(f"w{i}") for i in range(D)]
    plain = cut(quartiles.select("__cell", *medians, *scales), "medians")
    z = [(F.col(f"__x{i}") - F.col(f"m{i}")) / F.col(f"w{i}") for i in range(D)]
    scored = measured.join(small_side(plain, n), "__cell").select("__cell", *[z[i].alias(f"z{i}") for i in range(D)])
    scored = scored.withColumn("__far", F.sqrt(sum((F.col(f"z{i}") ** 2 for i in range(D)), F.lit(0.0))))
    sign = [F.coalesce(F.col(f"z{i}") / F.nullif(F.col("__far"), F.lit(0.0)), F.lit(0.0)) for i in range(D)]
    bounded = [F.tanh(F.col(f"z{i}")) for i in range(D)]
    shapes = scored.groupBy("__cell").agg(*[F.avg(v[i] * v[j]).alias(f"{kind}{i}{j}") for kind, v in (("u", sign), ("t", bounded)) for i, j in PAIRS], *[F.avg(bounded[i]).alias(f"t{i}") for i in range(D)])
    met = cut(plain.join(small_side(shapes, n), "__cell"), "shapes")

    def start(number: int, shape) -> DataFrame:
        scatter = [(F.col(f"w{i}") * F.col(f"w{j}") * (shape(i, j) + (0.01 if i == j and number else 0.0))).alias(f"s{i}{j}") for i, j in PAIRS]
        return met.select("__cell", F.lit(number).alias("__start"), *MEANS, *scatter)

    kinds = [lambda i, j: F.lit(float(i == j)), lambda i, j: F.col(f"u{i}{j}"), lambda i, j: F.col(f"t{i}{j}") - F.col(f"t{i}") * F.col(f"t{j}")]
    return cut(_factored(reduce(DataFrame.unionByName, [start(k, shape) for k, shape in enumerate(kinds)])), "starts")


def determinants(measured: DataFrame, n: int) -> DataFrame:
    """__cell, __start and the estimate of each start after ``STEPS`` steps, for each of the ``n`` values of __cell of rows with __x0, __x1, ..."""
    found = _starts(measured, n)
    for _ in range(STEPS):
        found = _concentrated(measured, found, STARTS * n)
    return found


def estimated(measured: DataFrame, n: int) -> DataFrame:
    """__cell, m0, ... and s00, ... of the least determinant that was found for each cell."""
    found = determinants(measured, n)
    item = F.struct("__start", *MEANS, *SPREADS, *FACTORS)
    found = found.groupBy("__cell").agg(F.min_by(item, F.struct("logdet", "__start")).alias("e")).select("__cell", "e.*")
    for _ in range(MORE_STEPS):
        found = _concentrated(measured, found, n)
    return found.select("__cell", *MEANS, *SPREADS)


def judge(stats: DataFrame, lang: str, source: str) -> DataFrame:
    """A row for each of ``stats`` (as ``statistics`` gives it), with base_failed and kept added."""
    columns = stats.columns
    rows = cut(
        stats.select("*", named(lang).alias("__lang"), named(source).alias("__source"), base_failed().alias("__failed"), *[v.alias(f"__x{i}") for i, v in enumerate(vector())]),
        "statistics",
    )
    cells, n = _cells(rows)
    of_row = F.col("__lang").eqNullSafe(F.col("__l")) & F.col("__source").eqNullSafe(F.col("__s"))
    passed = rows.where("NOT __failed").select("__lang", "__source", *[f"__x{i}" for i in range(D)])
    measured = passed.join(small_side(cells.select("__l", "__s", "__names"), n), of_row)
    measured = cut(measured.select(F.explode("__names").alias("__cell"), *[f"__x{i}" for i in range(D)]), "measured")
    found = estimated(measured, 2 * n + 1)
    sizes = cells.select("*", F.col("__names")[0].alias("__c0"), F.col("__names")[1].alias("__c1"), F.col("__names")[2].alias("__c2"))
    by_lang = cells.groupBy(F.col("__names")[1].alias("__c1")).agg(F.sum("__n").alias("__n1"))
    met = sizes.join(by_lang, "__c1")
    for k in range(3):
        met = met.join(found.select(F.col("__cell").alias(f"__c{k}"), *[F.col(c).alias(f"e{k}_{c}") for c in (*MEANS, *SPREADS)]), f"__c{k}")
    own, of_lang = F.col("__n") / (F.col("__n") + WORTH), F.col("__n1") / (F.col("__n1") + WORTH)
    drawn = [(own * F.col(f"e0_{c}") + (1 - own) * (of_lang * F.col(f"e1_{c}") + (1 - of_lang) * F.col(f"e2_{c}"))).alias(c) for c in (*MEANS, *SPREADS)]
    estimates = cut(_factored(met.select("__l", "__s", *drawn)).select("__l", "__s", *MEANS, *FACTORS), "estimates")
    judged = rows.join(small_side(estimates, n), of_row, "left")
    far = F.coalesce(_distance() > CUTOFF, F.lit(False))
    return judged.select(*[named(c) for c in columns], F.col("__failed").alias("base_failed"), (~F.col("__failed") & ~far).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    stats = statistics(table(spark, sf_dir, "documents"))
    return judge(stats, "lang", "source").drop("lang", "source")


def keep(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``df`` that pass, columns unchanged."""
    packed = df.select(F.struct(*[named(c) for c in df.columns]).alias("doc"), named(text).alias("its_text"), named(lang).alias("its_lang"), named(source).alias("its_source"))
    judged = judge(statistics(packed, "its_text", ("doc", "its_lang", "its_source")), "its_lang", "its_source")
    return judged.where("kept").select("doc.*")
