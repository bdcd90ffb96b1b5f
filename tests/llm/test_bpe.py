"""Encoding and decoding against the library's own."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, common, hashing

PIECES = ["a", " ", "  ", "\n", "\t", "'s", "\xa0", "à", "é", "　", " ", "12", ".", "<|endoftext|>", "\x1c", "\x85", "don't", "!'s", "日本", "\r\n", "à ", "🙂", "ʼn", "x" * 300]


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


@pytest.mark.parametrize("seed", range(3))
def test_fuzz(tokenizer, seed):
    library = Tokenizer.from_file(tokenizer)
    codec = bpe.ForcedBoundaryBPE(open(tokenizer, encoding="utf-8").read())
    r = random.Random(seed)
    texts = ["".join(r.choices(PIECES, k=r.randrange(30))) for _ in range(2000)]
    got = [ids_of(x) for x in codec.encode_batch([t.encode() for t in texts])]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [codec.decode(np.array(i, dtype="<u4").tobytes()).decode() for i in got] == [library.decode(i, skip_special_tokens=False) for i in want]


def test_certain_cuts(tokenizer):
    codec = bpe.ForcedBoundaryBPE(open(tokenizer, encoding="utf-8").read())
    inside = {(a, b) for t in codec.token for a, b in zip(t, t[1:]) if t not in codec.special}
    assert all(codec.certain[a][b] == ((a, b) not in inside) for a in range(256) for b in range(256))


def long_texts():
    r = random.Random(5)
    texts = ["foo,bar;baz(qux)\x00zz", " " * 3000 + "x", "\n" * 2000, "ab" * 700, "日本語テキスト" * 300, "=" * 4097, "a" * 999, "-" * 1001 + "=" * 1003]
    texts += ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5000)), "".join(r.choices("aab ", k=3000))]
    return texts + ["".join(chr(r.randrange(a, b)) for _ in range(3000)) for a, b in ((0x4E00, 0x9FFF), (32, 0x2FFF))]


def test_long_fragments(tokenizer, monkeypatch):
    library = Tokenizer.from_file(tokenizer)
    want = [e.ids for e in library.encode_batch(long_texts(), add_special_tokens=False)]
    codec = bpe.ForcedBoundaryBPE(open(tokenizer, encoding="utf-8").read())
    assert codec.ordered
    assert [ids_of(x) for x in codec.encode_batch([t.encode() for t in long_texts()])] == want
    monkeypatch.setattr(bpe, "LONG", 3)  # all but the shortest rank by rank
    codec.known.clear()
    assert [ids_of(x) for x in codec.encode_batch([t.encode() for t in long_texts()])] == want


def test_generations_of_the_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 40)
    library = Tokenizer.from_file(tokenizer)
    codec = bpe.ForcedBoundaryBPE(open(tokenizer, encoding="utf-8").read())
    r = random.Random(6)
    for _ in range(30):
        texts = ["".join(r.choices([*PIECES, " the", " of, "], k=30)) for _ in range(4)]
        assert [ids_of(x) for x in codec.encode_batch([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(codec.known) + len(codec.older) < 1000


def test_a_million_without_a_cut(tokenizer):
    codec = bpe.ForcedBoundaryBPE(open(tokenizer, encoding="utf-8").read())
    spaces = b" " * 1_200_000
    assert codec.decode(codec.encode_batch([spaces])[0]) == spaces


def test_frames(spark, docs, tokenizer):
    library = Tokenizer.from_file(tokenizer)
    rows = [(1, None), (2, ""), (3, "Hello  world"), (3, "Hello  world"), (None, "x " * 50_000), (4, " \n ")]
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs(rows), tokenizer).collect())
    ids = {t: library.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    want = sorted((i or 0, len(ids[t]), hashlib.sha256(np.array(ids[t], dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert got == want
    assert bpe.digests(docs(rows).where("false"), tokenizer).count() == 0
    clash = docs(rows).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    out = bpe.decode(bpe.encode(clash, tokenizer), tokenizer)
    assert sorted((r.text or "", r.decoded) for r in out.collect()) == sorted((t or "", t or "") for _, t in rows)
    odd = docs(rows).withColumnRenamed("lang", "a.b").withColumnRenamed("source", "__source")
    assert sorted(r.n for r in bpe.encode(odd, tokenizer).selectExpr("octet_length(ids) AS n").collect()) == sorted(4 * n for _, n, *_ in want)


def test_one_worker_for_a_task(docs, tokenizer):
    """Two steps of Python in one plan are two processes for each task, with a vocabulary and caches in both."""
    out = bpe.digests(docs([(1, "some words")]), tokenizer)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = bpe.round_trip(docs([(1, "some  words"), (2, None)]), tokenizer)
    apart = bpe.decode(bpe.encode(docs([(1, "some  words"), (2, None)]), tokenizer), tokenizer)
    assert both.columns == apart.columns and sorted(both.collect()) == sorted(apart.collect())


def test_other_work_gives_the_codec_back(tokenizer):
    codec = bpe._codec(open(tokenizer, encoding="utf-8").read())
    assert bpe._codec(open(tokenizer, encoding="utf-8").read()) is codec
    common.keeps("shingles", hashing.forget)
    assert not bpe._built
    hashing.shingles([b"a b c"], 2)
    assert hashing._digests
    bpe._codec(open(tokenizer, encoding="utf-8").read())
    assert not hashing._digests and bpe._built
