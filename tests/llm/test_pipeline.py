"""The stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from tidemark.llm import pipeline


def test_stages(spark, docs):
    r = random.Random(1)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(clean)]
    rows += [(100, clean[0], "en", "s1", 1), (101, clean[1] + " " + word(), "en", "s1", 1), (102, "short", "en", "s1", 5), (103, None, "en", None, None)]
    rows += [(104, " ".join(word() for _ in range(60)) + " password = abcdefghijklmnop", "en", "s2", 9)]
    frame = docs(rows)
    kept = pipeline.quality(spark, frame, "")
    assert kept.columns == frame.columns
    assert {x.doc_id for x in kept.collect()} == {*range(40), 100, 101, 104}
    one = pipeline.near_duplicates(spark, kept, "")
    assert {x.doc_id for x in one.collect()} == {*range(40), 104}
    safe = pipeline.without_secrets(spark, one, "")
    texts = {x.doc_id: (x.text, x.n_chars) for x in safe.collect()}
    assert texts[104][0].endswith(" [assign]") and texts[104][1] == len(texts[104][0]) and texts[5][0] == clean[5]
    mixed = pipeline.mix(spark, safe, "")
    assert mixed.columns == frame.columns
    words = sum(len(t.split()) for t, _ in texts.values())
    assert abs(sum(len(x.text.split()) for x in mixed.collect()) - 1.5 * words) <= 70 * 4
    last = pipeline.encode(spark, mixed, "")
    assert last.count() == mixed.count() and {"doc_id", "n_tokens", "ids"} <= set(last.columns)


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and out.where("n_tokens < 20").count() == 0


def test_stages_take_anything(spark, docs):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, long, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, long, "en", "s", 1), (2, long, "en", "s", 1), (None, None, None, None, None)]
    odd = docs(rows).selectExpr("*", "n_chars AS `a.b`", "map('k', source) AS `__a`", "1 AS k0", "lang AS `__source`", "'x' AS `__x0`")
    frame = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for empty in (False, True):
            got = stage(spark, frame.where("false") if empty else frame, "")
            assert got.columns == odd.columns, name
            assert got.count() >= (0 if empty else 1), name
            assert not empty or got.count() == 0, name
        frame = stage(spark, frame, "").repartition(2)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, odd.where("false"), "").count() == 0


def test_near_duplicates_of_equal_rows(spark, docs):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "en", "s", 1)] * 3 + [(7, text, "en", "t", 1), (9, text + " x", "en", "s", 1), (8, "", "en", "s", 1), (8, "", "en", "s", 1)]
    got = pipeline.near_duplicates(spark, docs(rows), "").collect()
    assert sorted((r.doc_id, r.text[:2]) for r in got) == [(7, "w0"), (8, ""), (8, "")]
