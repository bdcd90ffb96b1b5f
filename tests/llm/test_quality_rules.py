"""Statistics against plain counting, and the estimate against numpy."""

import collections
import random
import re

import numpy as np

from tidemark.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.defaultdict(list)
    for i in range(len(w) - 7):
        seen[tuple(w[i : i + 8])].append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in q.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(docs, documents):
    r = random.Random(1)
    texts = [None, "", " \n\t", "é# a", "a\n\na\na ", "x y " * 5000, "a b c d e f g h", "a b c d e f g h a b c d e f g h", "\x1c\x85 z"]
    texts += ["".join(r.choices(["a ", "b ", "c\n", "# ", "日 ", "\t"], k=r.randrange(80))) for _ in range(200)]
    rows = list(enumerate(texts))
    got = {s.doc_id: tuple(s)[3:] for s in q.statistics(docs(rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}
    real = {s.doc_id: tuple(s)[3:] for s in q.statistics(documents).collect()}
    assert real == {d.doc_id: brute(d.text) for d in documents.collect()}


def test_chi_square():
    assert abs(q.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(q.chi_square_cdf(q.chi_square_quantile(0.3, 7), 7) - 0.3) < 1e-9


def plain_step(x, m, c):
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    b = np.floor(q.BINS * np.log1p(d))
    inside = x[b <= np.percentile(b, 100 * q.COVERAGE)]
    return inside.mean(axis=0), q.CONSISTENCY * np.cov(inside.T, bias=True) + np.diag(np.array(q.FLOOR) ** 2)


def plain_starts(x):
    """Centre and scatter of each start after its steps, in numpy."""
    low, med, high = (np.percentile(np.floor(q.BINS * x), p, axis=0) / q.BINS for p in (25, 50, 75))
    w = np.maximum((high - low) / 1.349, q.FLOOR)
    z = (x - med) / w
    norm = np.sqrt((z**2).sum(axis=1, keepdims=True))
    u = np.divide(z, norm, out=np.zeros_like(z), where=norm > 0)
    t = np.tanh(z)
    shapes = [np.eye(q.D), u.T @ u / len(x) + 0.01 * np.eye(q.D), np.cov(t.T, bias=True) + 0.01 * np.eye(q.D)]
    out = []
    for shape in shapes:
        m, c = med, np.outer(w, w) * shape
        for _ in range(q.STEPS):
            m, c = plain_step(x, m, c)
        out.append((m, c))
    return out


def plain_estimate(x):
    m, c = min(plain_starts(x), key=lambda e: np.linalg.slogdet(e[1])[1])
    for _ in range(q.MORE_STEPS):
        m, c = plain_step(x, m, c)
    return m, c


def plain_verdicts(vectors, langs, sources):
    """Verdicts of documents that pass the fixed limits."""
    x, keys = np.array(vectors), list(zip(langs, sources, strict=True))
    of = lambda test: x[[test(k) for k in keys]]
    every = plain_estimate(x)
    draw = lambda n, a, b: tuple(n / (n + q.WORTH) * p + q.WORTH / (n + q.WORTH) * r for p, r in zip(a, b, strict=True))
    by_lang = {lang: draw(sum(k[0] == lang for k in keys), plain_estimate(of(lambda k: k[0] == lang)), every) for lang in {k[0] for k in keys}}  # noqa: B023
    by_key = {key: draw(sum(k == key for k in keys), plain_estimate(of(lambda k: k == key)), by_lang[key[0]]) for key in set(keys)}  # noqa: B023
    return [bool((v - by_key[k][0]) @ np.linalg.inv(by_key[k][1]) @ (v - by_key[k][0]) <= q.CUTOFF) for v, k in zip(x, keys, strict=True)]


def vectors_of(found):
    return [[np.log(s.n_words + 1), np.log((s.word_chars + 1) / (s.n_words + 1)), np.log1p(100 * s.n_symbols / (s.word_chars + 1)), np.log1p(100 * s.n_dup_lines / (s.n_words + 1)), np.log1p(100 * s.n_repeat_words / (s.n_words + 1))] for s in found]


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randrange(2, 9)))
    clean = lambda: " ".join(word() for _ in range(r.randrange(20, 300)))
    junk = lambda: " ".join(word() + "***" for _ in range(40))
    rows = [(i, junk() if i % 40 == 0 else clean(), "en", "big") for i in range(400)]
    rows += [(1000 + i, junk(), "en", "rare") for i in range(60)]  # drawn to its language
    rows += [(2000 + i, junk() if i == 0 else clean(), "fr", "few") for i in range(30)]  # a gross outlier among few
    rows += [(3000 + i, clean(), "xx" if i % 2 else None, f"s{i % 3}" if i % 3 else None) for i in range(9)]
    return rows


def test_verdicts_are_brute_force(docs):
    rows = [*corpus(), (9000, "too short", "en", "big"), (9001, None, None, None)]
    out = {x.doc_id: x for x in q.judge(q.statistics(docs(rows)), "lang", "source").collect()}
    passed = [row for row in rows if not out[row[0]].base_failed]
    assert len(passed) == len(rows) - 2
    got = {row[0]: out[row[0]].kept for row in passed}
    assert got == dict(zip(got, plain_verdicts(vectors_of(out[i] for i in got), [row[2] for row in passed], [row[3] for row in passed]), strict=True))
    gone = {i for i, kept in got.items() if not kept}
    assert gone == {*range(0, 400, 40), *range(1000, 1060), 2000}
    assert not out[9000].kept and not out[9001].kept


def test_least_determinant_of_several_starts(spark):
    r = np.random.default_rng(2)
    far = r.normal(size=(140, q.D)) * 0.3 + np.array([3.0, 0.5, 2.0, 0.0, 0.0])
    x = np.concatenate([r.normal(size=(260, q.D)) @ r.normal(size=(q.D, q.D)), far])
    frame = spark.createDataFrame([("c", *row) for row in x.tolist()], ["__cell", *[f"__x{i}" for i in range(q.D)]])
    found = {row["__start"]: row["logdet"] for row in q.determinants(frame, 1).collect()}
    want = [np.linalg.slogdet(c)[1] for _, c in plain_starts(x)]
    assert np.allclose([found[k] for k in range(q.STARTS)], want) and len({round(v, 6) for v in want}) > 1
    best = q.estimated(frame, 1).first()
    m, c = plain_estimate(x)
    assert np.allclose([best[f"m{i}"] for i in range(q.D)], m) and np.allclose([best[f"s{i}{j}"] for i, j in q.PAIRS], [c[i, j] for i, j in q.PAIRS])


def test_keep_passes_columns_on(docs):
    rows = [(1, "w " * 10), (2, " ".join(f"w{i}" for i in range(40)))]
    df = docs(rows).withColumnRenamed("n_chars", "n_words").withColumnRenamed("source", "kept")
    kept = q.keep(df, source="kept")
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [2]
    assert q.keep(df.where("false"), source="kept").count() == 0


def test_no_python_in_the_plan(docs):
    plan = q.judge(q.statistics(docs([(1, "a")])), "lang", "source")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table_and_odd_columns(spark, docs, monkeypatch):
    monkeypatch.setattr(q, "table", lambda *a: docs([(1, "a")]).where("false"))
    assert q.query(spark, "").count() == 0
    odd = docs([(1, " ".join(f"w{i}" for i in range(40)), "en", "s"), (1, None, None, None)]).withColumnRenamed("n_chars", "a.b").withColumnRenamed("doc_id", "__x0")
    assert q.keep(odd).columns == odd.columns and q.keep(odd).count() == 1
