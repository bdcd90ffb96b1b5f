import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid


def test_held_out_accuracy(spark, sf):
    out = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 OR score > 1").count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_is_brute_force(seed):
    r = np.random.default_rng(seed)
    score = r.normal(size=(6, 3)) * 3
    best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(score[t, k] for t, k in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])))
    runs = langid.viterbi(score, 1.5)
    assert [k for k, a, b in runs for _ in range(a, b)] == list(best)


def test_steady_texts_skip_the_recursion_rightly():
    r = np.random.default_rng(1)
    for _ in range(300):
        score = r.normal(size=(12, 3)) * r.choice([1, 4])
        best = int(score.sum(axis=0).argmax())
        if langid.Model._steady(score, best):
            path = langid.viterbi(score, langid.SWITCH)
            assert path == [(best, 0, 12)]


def letters(alphabet, n, r):
    return " ".join("".join(r.choices(alphabet, k=r.randrange(2, 7))) for _ in range(n))


def test_scripts_spans_and_cases(docs):
    r = random.Random(2)
    train = [(i, letters("abcd", 30, r), "xa") for i in range(30)] + [(100 + i, letters("qrst", 30, r), "xq") for i in range(30)] + [(200 + i, letters("жзий", 30, r), "ru") for i in range(30)]
    model = langid.fit(docs(train))
    assert model.languages == ["ru", "xa", "xq"]
    mixed = letters("abcd", 40, r) + ". " + letters("qrst", 30, r)
    rows = [(1, mixed), (2, letters("жзий", 5, r)), (3, None), (4, " 12 ?!"), (5, ""), (6, letters("жзий", 3, r) + " " + letters("abcd", 9, r)), (None, "ab cd " * 20_000), (1, mixed)]
    df = docs(rows).withColumnRenamed("source", "score")
    out = langid.label(df, model)
    got = sorted(((x.doc_id or 0, x.lang_pred, [s.lang for s in x.lang_spans]) for x in out.collect()), key=repr)
    assert got == sorted([(1, "xa", ["xa", "xq"]), (1, "xa", ["xa", "xq"]), (2, "ru", ["ru"]), (3, "und", []), (4, "und", []), (5, "und", []), (6, "xa", ["ru", "xa"]), (0, "xa", ["xa"])], key=repr)
    cut = mixed.index(".")
    spans = out.where("doc_id = 1").first().lang_spans
    assert spans[0].start == 0 and abs(spans[0].end - cut) <= 12 and spans[1].end == len(mixed)
    assert {x.score for x in out.where("doc_id IN (3, 4, 5)").collect()} == {0.0}


def test_nothing_to_learn_from(docs):
    model = langid.fit(docs([(1, "abc", None)]))
    assert langid.label(docs([(1, "abc")]), model).first().lang_pred == "und"
    assert langid.label(docs([(1, "abc")]).where("false"), model).count() == 0


def test_any_number_of_languages(docs):
    r = random.Random(4)
    alphabets = ["".join(chr(0x4E00 + 9 * i + k) for k in range(9)) for i in range(500)]
    rows = [(i, letters(a, 20, r), f"l{i:03}") for i, a in enumerate(alphabets)]
    model = langid.fit(docs(rows))
    assert len(model.languages) == 500
    fresh = [(i, letters(a, 12, r)) for i, a in enumerate(alphabets)]
    out = {x.doc_id: x.lang_pred for x in langid.label(docs(fresh), model).collect()}
    assert sum(out[i] == f"l{i:03}" for i in out) >= 495


def test_lower_case_is_by_letter():
    plain, odd = langid.Words(["hello there".encode()]), langid.Words(["HELLO THERE İ".encode()])
    assert odd.pair[:10].tolist() == plain.pair.tolist() and odd.triple[:10].tolist() == plain.triple.tolist()


def test_odd_columns_and_ties(docs):
    model = langid.fit(docs([(1, "ab ab", "xb"), (2, "ab ab", "xa")]))
    df = docs([(1, "ab")]).withColumnRenamed("lang", "a.b").withColumnRenamed("source", "__source").withColumnRenamed("n_chars", "score")
    out = langid.label(df, model)
    assert out.columns == ["doc_id", "a.b", "__source", "lang_spans", "lang_pred", "score"] and out.first().lang_pred == "xa"


def plain_words(text):
    """Words as lists of letters, each with the hashes of its pair and triple, one at a time."""
    out, mask = [], 0xFFFFFFFF
    for is_letter, run in itertools.groupby(text, str.isalpha):
        if not is_letter:
            continue
        word = list(run)
        c = [0, *(ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in word), 0]
        features = []
        for before, own, after in zip(c, c[1:], c[2:]):
            pair = (own * 0x9E3779B1 + before * 0x85EBCA77) & mask
            triple = (pair + after * 0xC2B2AE3D) & mask
            features.append(((((pair ^ pair >> 15) * 0x27D4EB2F) & mask) >> 20, (((triple ^ triple >> 15) * 0x165667B1) & mask) >> 17))
        out.append((word, features))
    return out


def plain_query(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    pair, triple, script = (collections.defaultdict(collections.Counter) for _ in range(3))
    name = lambda c: [s for at, s in langid.SCRIPTS if at <= ord(c)][-1]
    for i, text, lang in rows:
        if lang is not None and i is not None and not held(i):
            for word, features in plain_words(text or ""):
                pair[lang].update(f[0] for f in features)
                triple[lang].update(f[1] for f in features)
                script[lang][name(word[0])] += len(word)
    langs = sorted(pair)
    chance = lambda seen, f, n: math.log((seen[f] + langid.SMOOTH) / (seen.total() + langid.SMOOTH * n)) / 2
    out = []
    for i, text, _ in rows:
        words = plain_words(text or "")
        if not words:
            out.append((i, held(i), "und", 0.0))
            continue
        score = []
        for word, features in words:
            allowed = [x for x in langs if script[x][name(word[0])] >= langid.LEAST_SHARE * script[x].total()] or langs
            score.append([sum(chance(pair[x], a, langid.PAIRS) + chance(triple[x], b, langid.TRIPLES) for a, b in features) if x in allowed else -1e6 for x in langs])
        value, paths = score[0], [[k] for k in range(len(langs))]
        for row in score[1:]:
            moves = [max((v - langid.SWITCH * (j != k), j == k, -j) for j, v in enumerate(value)) for k in range(len(langs))]
            paths = [[*paths[-j], k] for k, (_, _, j) in enumerate(moves)]
            value = [m[0] + r for m, r in zip(moves, row)]
        path = paths[max(range(len(langs)), key=lambda k: value[k])]
        # letters of a span and what stands between its words
        spans, at = [], 0
        starts = []
        for is_letter, run in itertools.groupby(text, str.isalpha):
            n = len(list(run))
            if is_letter:
                starts.append((at, at + n))
            at += n
        for k, (a, b) in zip(path, starts):
            if spans and spans[-1][0] == k:
                spans[-1][2] = b
            else:
                spans.append([k, a, b])
        mass = [sum(b - a for j, a, b in spans if j == k) for k in range(len(langs))]
        top = max(range(len(langs)), key=lambda k: (mass[k], -k))
        out.append((i, held(i), langs[top], mass[top] / sum(mass)))
    return out


def test_query_is_brute_force(spark, docs, monkeypatch):
    r = random.Random(8)
    alphabets = {"xa": "abcdéE", "xq": "qrstA", "ru": "жзийЖ"}
    rows = [(i, letters(alphabets[x], r.randrange(1, 25), r), x) for i, x in enumerate(r.choices(list(alphabets), k=60))]
    rows += [(100 + i, ". ".join(letters(alphabets[x], r.randrange(1, 30), r) for x in r.choices(list(alphabets), k=4)), None) for i in range(20)]
    rows += [(200, None, "xa"), (201, "", "xq"), (202, "12 !", "ru"), (203, "日本 İab", None), (None, "abc", "xa"), (5, "abcd", "xa"), (5, "abcd", "xa")]
    monkeypatch.setattr(langid, "table", lambda *a: docs(rows))
    got = sorted(((x.doc_id is None, x.doc_id or 0, x.held_out, x.lang_pred, round(x.score, 9)) for x in langid.query(spark, "").collect()))
    assert got == sorted((i is None, i or 0, h, p, round(s, 9)) for i, h, p, s in plain_query(rows))
