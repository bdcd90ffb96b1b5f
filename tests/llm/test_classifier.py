import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier

LABELS = "doc_id bigint, quality int, toxic int"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 8)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(40)]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            w = [x + "###" for x in w]
        if toxic:
            for _ in range(3):
                w[r.randrange(40)] = r.choice(["scoundrel", "wretches", "vermin"])
        docs.append((i, " ".join(w), "en", f"s{i % 3}"))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_unseen_documents(spark, docs):
    rows, labels = corpus()
    some = spark.createDataFrame(labels[:300], LABELS)
    out = {r.doc_id: r for r in classifier.classify(docs(rows), some).collect()}
    wrong = [i for i, q, t in labels[300:] if out[i].kept != (q == 1 and t == 0)]
    assert len(wrong) <= 3
    assert all(0 <= r.bad_score <= 1 and 0 <= r.toxic_score <= 1 for r in out.values())


def strength(groups, base):
    n = np.array([c for _, c in groups.values()])
    rate, b = np.array([m for m, _ in groups.values()]), np.array([base[k] for k in groups])
    apart, chance, all_ = (n * (rate - b) ** 2).sum() / n.sum(), (b * (1 - b)).sum() / n.sum(), (n * b * (1 - b)).sum() / n.sum()
    share = min(max((apart - chance) / max(all_, 1e-12), 1e-4), 0.5)
    return (1 - share) / share


def plain_sites(seen, sites):
    """Of each document the posterior of its path, with and without itself, and the global rate."""
    host = [h for h, _ in sites]
    mean = lambda keys: {k: (np.mean([v for v, q in zip(seen, keys) if q == k]), keys.count(k)) for k in set(keys)}
    prior, hosts, paths = np.mean(seen), mean(host), mean(list(sites))
    hk = strength(hosts, {h: prior for h in hosts})
    shrunk = lambda total, n, base, k: (total + k * base) / (n + k)
    rates = {h: shrunk(m * n, n, prior, hk) for h, (m, n) in hosts.items()}
    k = strength(paths, {q: rates[q[0]] for q in paths})
    out = []
    for v, q in zip(seen, sites):
        (m, n), (hm, hn) = paths[q], hosts[q[0]]
        out.append((shrunk(m * n, n, rates[q[0]], k), shrunk(m * n - v, n - 1, shrunk(hm * hn - v, hn - 1, prior, hk), k), prior))
    return out


def test_posteriors_are_plain(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.uniform(0, 0.7), r.uniform(0, 1)) for _ in range(300)] + [("rare", "x", 0.9, 0.9)]
    got = {(x["__host"], x["__path"]): x for x in classifier.posteriors(spark.createDataFrame(rows, "h string, p string, seen_bad double, seen_toxic double"), "h", "p").collect()}
    for row, (rate, _, _) in zip(rows, plain_sites([x[2] for x in rows], [x[:2] for x in rows])):
        assert got[row[:2]]["rate_bad"] == pytest.approx(rate)


def test_query_is_plain(spark, docs, monkeypatch):
    """Scores by the fitted weights and plain sums over sites, for sparse sites and labelled documents too."""
    rows, labels = corpus(300)
    r = random.Random(9)
    rows = [(*row[:2], r.choice(["en", "fr", None]), r.choice(["s1", "s2", *[f"rare{i}" for i in range(30)], None])) for row in rows] + [(900, None, None, "new"), (901, "", "en", "s1")]
    frames = {"documents": docs(rows), "labels": spark.createDataFrame(labels[:150], LABELS)}
    monkeypatch.setattr(classifier, "table", lambda spark, sf, name: frames[name])
    got = {x.doc_id: x for x in classifier.query(spark, "").collect()}
    model = classifier.fit(frames["documents"], frames["labels"])
    z = model.score([(t or "").encode() for _, t, *_ in rows])
    known = {i: (float(q == 0), float(t == 1)) for i, q, t in labels[:150]}
    keep = {i: True for i, *_ in rows}
    for k, target in enumerate(classifier.TARGETS):
        seen = [known[i][k] if i in known else 1 / (1 + np.exp(-v)) for (i, *_), v in zip(rows, z[:, k])]
        logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
        for (i, *_), v, (rate, alone, prior) in zip(rows, z[:, k], plain_sites(seen, [(row[3], row[2]) for row in rows])):
            score = 1 / (1 + np.exp(-(v + logit(alone) - logit(prior))))
            assert got[i][f"{target}_score"] == pytest.approx(score, abs=1e-9) and got[i][f"site_{target}"] == pytest.approx(rate)
            keep[i] &= score < 0.5
    assert {i: x.kept for i, x in got.items()} == keep


def test_held_out_labels(spark):
    """Labels of a fifth of the labelled documents, which nothing is learned from."""
    sf = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    out = classifier.classify(documents, labels.where(fold != 0)).join(labels.where(fold == 0), "doc_id")
    right = out.agg(F.avg((F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int"))).first()[0]
    assert right > 0.9


def test_defined_cases(spark, docs):
    rows, labels = corpus(200)
    odd = [*labels, (0, None, 1), (None, 1, 1), (1, 0, 1), (9999, 0, 0)]
    more = [*rows, (1000, None, None, None), (1001, ""), (None, "abc"), rows[3]]
    out = classifier.classify(docs(more), spark.createDataFrame(odd, LABELS)).collect()
    assert len(out) == len(more)
    none = spark.createDataFrame([], LABELS)
    assert all(r.kept for r in classifier.classify(docs(rows[:5]), none).collect())
    assert classifier.classify(docs(rows).where("false"), spark.createDataFrame(labels, LABELS)).count() == 0


def test_sites_of_urls(spark):
    host, path = classifier.site_of_url(F.col("u"))
    got = spark.createDataFrame([("https://u@WWW.a.b:80/x/y?z",), ("nothing",)], "u string").select(host.alias("h"), path.alias("p")).collect()
    assert [tuple(r) for r in got] == [("www.a.b", "x"), ("", "")]
