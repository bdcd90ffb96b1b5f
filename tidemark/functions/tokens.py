"""Words of search texts: Latin words and digits in lower case, and dictionary words of CJK runs.

CJK runs are cut at the greatest granularity: every dictionary word at every position,
overlapping ones too, and single characters where no word covers them. The dictionary is
a parameter; without one each character is a word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

LATIN = "[a-z0-9]+"
CJK = "[\\x{3400}-\\x{9FFF}]+"


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LATIN})"))


#: Words of a dictionary up to which it is part of the expression.
INLINE = 500


def words(text: Column, dictionary: Iterable[str] = ()) -> Column:
    """All words of a text: Latin ones, then those of its CJK runs.

    Native with a short dictionary; a longer one is looked up as a hash set in Arrow
    batches, so that neither the plan nor the time for a character grows with it.
    """
    known = sorted(set(dictionary), key=lambda w: (-len(w), w))
    if len(known) > INLINE:
        held, longest = frozenset(known), len(known[0])
        return F.udf(lambda t: list(split_text(t, held, longest)), "array<string>", useArrow=True)(text)
    longest = max(map(len, known), default=1)
    listed = F.array(*[F.lit(w) for w in known]) if known else F.array().cast("array<string>")

    def of_run(run: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(run))
        pieces = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("i"), n.alias("n"), F.substr(run, i, n).alias("w")))))
        found = F.filter(pieces, lambda p: (F.length(p["w"]) == p["n"]) & F.array_contains(listed, p["w"]))
        lone = F.filter(starts, lambda i: ~F.exists(found, lambda p: (p["i"] <= i) & (i < p["i"] + p["n"])))
        single = F.transform(lone, lambda i: F.struct(i.alias("i"), F.lit(1).alias("n"), F.substr(run, i, F.lit(1)).alias("w")))
        return F.transform(F.array_sort(F.concat(found, single)), lambda p: p["w"])

    runs = F.regexp_extract_all(text, F.lit(f"({CJK})"))
    return F.concat(latin_words(text), F.flatten(F.transform(runs, of_run)))


def split_text(text: str | None, dictionary: frozenset[str] = frozenset(), longest: int | None = None) -> Iterator[str]:
    """The same words in Python."""
    import re

    if text is None:
        return
    yield from re.findall(LATIN, text.lower())
    longest = longest or max(map(len, dictionary), default=1)
    for run in re.findall("[㐀-鿿]+", text):
        spans = [(i, n) for i in range(len(run)) for n in range(1, longest + 1) if run[i : i + n] in dictionary and i + n <= len(run)]
        covered = {k for a, n in spans for k in range(a, a + n)}
        spans += [(i, 1) for i in range(len(run)) if i not in covered]
        yield from (run[i : i + n] for i, n in sorted(spans))


def register_split_words(spark: SparkSession, name: str = "split_words", dictionary: Iterable[str] = ()) -> None:
    """Registers the table function ``split_words(text) -> word`` for SQL; hot paths use ``words`` instead."""
    known = frozenset(dictionary)

    @F.udtf(returnType="word string")
    class SplitWords:
        def eval(self, text: str):  # noqa: A003
            for word in split_text(text, known):
                yield (word,)

    spark.udtf.register(name, SplitWords)
