"""Spans against regular expressions, and the automaton against the same on random bytes."""

import hashlib
import random
import re

import pytest

from tidemark.llm import secrets
from tidemark.llm.automata import compile_rules

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
PIECES = ["token", "=", ":", " ", "  ", "'", '"', "Secret", "api_key", "APIKEY", "AKIA", "ABCDEF0123456789", "abcdef", "0123", "\n", "é", "x", ".", "-", "ghp_", "日本"]


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16])


def random_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(PIECES, k=r.randrange(60))) for _ in range(n)]


def test_query_columns(spark, docs, monkeypatch):
    texts = [*random_texts(1, 300), "", "0" * 100_000, "token=" + "A" * 50_000]
    rows = [*enumerate(texts), (None, None), (7, texts[7])]
    monkeypatch.setattr(secrets, "table", lambda *a: docs(rows))
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.query(spark, "").collect()))
    want = []
    for i, t in rows:
        spans = brute(t or "")
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        want.append((i is None, i or 0, *[sum(k == x for _, k, _ in spans) for x in range(3)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)


def test_further_kinds(docs):
    text = "é ghp_" + "a" * 36 + " xoxb-1234567890 sk_live_" + "b" * 16 + " -----BEGIN RSA PRIVATE KEY-----"
    row = secrets.scan(docs([(1, text)])).first()
    assert {"github", "slack", "stripe", "pem"} <= {s.kind for s in row.spans}
    assert all(text[s.start : s.end].startswith("ghp_") for s in row.spans if s.kind == "github")


def test_redact(docs):
    rows = [(1, "a token=abcdef0123456789abcdef b"), (2, None), (3, ""), (4, "clean é")]
    out = {r.doc_id: r.text for r in secrets.redact(docs(rows)).collect()}
    assert out == {1: "a [assign] b", 2: None, 3: "", 4: "clean é"}


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,3}d?", "(?i:ab)+c", "a?b?c{2}", "(ab|a)(c|bcd)", "[^a]b"])
def test_automaton(pattern):
    d = compile_rules([pattern], anywhere=False)
    r = random.Random(pattern)
    for _ in range(500):
        text = "".join(r.choices("abcdAB", k=r.randrange(8)))
        s = 0
        for b in text.encode():
            s = int(d.next[s * d.width + d.group[b]])
        assert bool(d.accept[s]) == bool(re.fullmatch(pattern, text)), text


def test_minimal():
    assert len(compile_rules(["(a|b)(c|d)"], anywhere=False).accept) == 4  # start, after one, end, dead


def test_whole_pem_keys_go(docs):
    r = random.Random(7)
    b64 = lambda n: "".join(r.choices("ABCDEFabcdef0123456789+/", k=n))
    lines = [*(b64(64) for _ in range(25)), b64(18) + "=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    fields = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C3D", ""]
    key = [begin, *lines, end]
    narrow = [begin, *(b64(8) for _ in range(9)), end]
    forms = ["\n".join(key), "\r\n".join(key), "\n    ".join(key), " ".join(key), "\\n".join(key), '\\n" +\n"'.join(key), "\n> ".join(key), "\n".join([begin, *fields, *lines, end]), "\n".join(narrow)]
    rows = [(i, f"é before\n{x}\nafter it\n{x} token=abcdef0123456789") for i, x in enumerate(forms)]
    out = {x.doc_id: x.text for x in secrets.redact(docs(rows)).collect()}
    assert out == {i: "é before\n[pem]\nafter it\n[pem] [assign]" for i in range(len(forms))}
    # without an END line the lines of the key go, and text stays
    more = [(1, "\n".join([begin, *lines[:3], "c2hvcnQ="]) + "\n\nThis is text."), (2, f"{begin} is how a header looks."), (3, f"{begin}\n{lines[0]}\n{forms[0]}\nx")]
    out = {x.doc_id: x.text for x in secrets.redact(docs(more)).collect()}
    assert out == {1: "[pem]\n\nThis is text.", 2: "[pem] is how a header looks.", 3: "[pem]\n[pem]\nx"}


def test_time_grows_with_the_length():
    s = secrets.scanner(secrets.RULES)
    near = lambda k: b"eyJ" * k + b" eyJaa.bb.cccccccc"
    assert s.scan([near(100_000)]) == [[(300_001, 7, 300_018)]]  # quadratic work on this would take hours
    dump = b"0a" * 200_000
    assert s.scan([dump, b"token=" + dump]) == [[(0, 2, 400_000)], [(0, 0, 400_006), (6, 2, 400_006)]]
    heads = b"x: -----BEGIN PRIVATE KEY-----" * 5000
    assert len(s.scan([heads])[0]) == 5000


def test_rules_end_with_their_tails():
    with pytest.raises(ValueError, match="must end"):
        secrets.Scanner((secrets.Rule("odd", "a(ba*)?", "b"), secrets.Rule("odder", "x", "(y|z.*w)")))


def test_empty_table_and_odd_columns(docs):
    df = docs([(1, "token=abcdefghijklmnop", "en", "s"), (2, None), (2, None)]).withColumnRenamed("lang", "a.b").withColumnRenamed("source", "__source")
    assert secrets.scan(df).columns == [*df.columns, "spans"]
    assert sorted(len(r.spans) for r in secrets.scan(df).collect()) == [0, 0, 1]
    clean = secrets.redact(df)
    assert clean.columns == df.columns and sorted(r.text or "" for r in clean.collect()) == ["", "", "[assign]"]
    assert secrets.scan(df.where("false")).count() == 0 and secrets.redact(df.where("false")).count() == 0
