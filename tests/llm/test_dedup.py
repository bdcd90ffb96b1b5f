"""Components against all pairs of full sets."""

import itertools
import random
import re

import pytest

from tidemark.llm import dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    n = min(k, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute(rows, k):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            up[root(b)] = root(a)
    groups = {}
    for n, (i, s) in enumerate(sets):
        groups.setdefault(root(n), []).append(i)
    return sorted((i, len(s), min(groups[root(n)]) if s else i) for n, (i, s) in enumerate(sets))


def corpus(seed, bases=6, copies=14, near=90):
    """Copies of some texts with words changed, a text with many near copies around the limit, a passage in many texts, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 7)))
    texts = ["", None, "One", "one", "one two", "One  two", "one two three", "x " * 50]

    def changed(base, n):
        out = list(base)
        for _ in range(n):
            out[r.randrange(len(out))] = word()
        return " ".join(out)

    for _ in range(bases):
        base = [word() for _ in range(r.choice([12, 60, 150]))]
        texts += [changed(base, r.randrange(4)) for _ in range(copies)]
    base = [word() for _ in range(120)]
    texts += [changed(base, r.randrange(8)) for _ in range(near)]
    passage = " ".join(word() for _ in range(60))
    texts += [f"{passage} " + " ".join(word() for _ in range(r.randrange(5, 60))) for _ in range(70)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "small"), [(1, 48), (2, 3), (3, 3)])
def test_components_are_brute_force(docs, monkeypatch, seed, small):
    monkeypatch.setattr(dedup, "SMALL", small)
    rows = corpus(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.deduplicate(docs(rows), words=4).collect())
    assert got == brute(rows, 4)


def test_defined_cases(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, ""), (9, None), (None, "p q r s t"), (7, "P q r s t"), (None, "lone words here now")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.deduplicate(docs(rows), words=4).collect()), key=repr)
    assert out == sorted([(5, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (9, 0, 9, True), (9, 0, 9, True), (None, 2, 7, False), (7, 2, 7, True), (None, 1, None, True)], key=repr)
    assert dedup.deduplicate(docs(rows).where("false")).count() == 0


def test_keep_one(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, ""), (10, None), (7, "other words that are long")]
    kept = dedup.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9, 10]


def test_least_shared():
    assert dedup.least_shared(64) == 29
    assert dedup.least_shared(1) == 0
