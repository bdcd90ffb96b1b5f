"""Secret scans: all rules in one pass of one deterministic automaton over the bytes.

Rules are a head and a tail, a run of one class of bytes. Their patterns, read backwards,
are compiled together by subset construction and minimisation into one transition array.
It reads each text once, from its end to its beginning, and tells for every byte which
rules have a match that begins there. Bytes that no match can hold (line ends, most
punctuation, everything above ASCII) part the text into runs, and many runs step through
the array side by side. From the first such byte of a rule, the rule's own automaton
follows the match to its end; the next match begins at the first such byte after that.
Once a match could end, a rule's automaton can only go on with the tail (the compiler
makes sure of it), so nothing beyond matches is read again, and the time grows with the
length of the text whatever it holds. These are the leftmost, longest matches that do not
overlap; those whose tail or whole is too short are dropped. A rule may go on beyond its
run: the header of a PEM key is found in its run, and the span then goes on over lines of
base64 to the END line (``pem_end``).

Defined cases: null and empty texts have no spans; positions are code points, the end
exclusive; spans of different rules may overlap; texts of any length are scanned whole;
equal rows are scanned alike, each one; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import Dfa, compile_rules
from .common import computed, named, table


#: Between pieces of a key: white space, line ends as they are escaped in strings, quotes, and marks of quoted or commented lines.
_GAP = rb"""(?:\s|\\+[nrt]|["'`,>#*|;\\])*+"""
_PIECE = re.compile(_GAP + rb"([A-Za-z0-9+/=]++)")
_FIELD = re.compile(_GAP + rb"[A-Za-z][A-Za-z0-9\-]*+:(?:(?!-----)[^\r\n\\])*+")
_END = re.compile(_GAP + rb"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: Pieces of at least so many characters belong to a key even where its END line is missing.
LEAST_PIECE = 16


def pem_end(raw: bytes, at: int) -> int:
    """Where the PEM key whose header ends at ``at`` ends: after its END line, or without one after its last long line and one short line that follows it."""
    end, after_long = at, False
    while m := _FIELD.match(raw, at):
        at = m.end()
    while m := _PIECE.match(raw, at):
        at, long = m.end(), len(m[1]) >= LEAST_PIECE
        if long or after_long and re.search(rb"\n|\r|\\[nr]", raw[m.start() : m.start(1)]):
            end = at
        after_long = long
    closing = _END.match(raw, at)
    return closing.end() if closing else end


@dataclass(frozen=True)
class Rule:
    """A match is ``head`` and then one or more of ``tail``; it is kept with that many bytes of tail and in all.

    ``seen`` is how many bytes of tail the combined automaton asks for before it reports a beginning.
    """

    name: str
    head: str
    tail: str
    least_tail: int = 1
    least: int = 1
    seen: int = 1
    #: From a text and a match's end to where its span ends, in this or a later run.
    beyond: Callable[[bytes, int], int] | None = None


#: The kinds that every scan reports, in the order in which they are listed.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=\\-]", least_tail=12),
    Rule("access", "AKIA", "[A-Z0-9]", least=18),
    Rule("hex", "", "[0-9a-f]", least=16, seen=16),
)
#: Formats of further keys.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", least_tail=36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9\\-]", least_tail=10),
    Rule("stripe", "[rs]k_(live|test)_", "[A-Za-z0-9]", least_tail=16),
    Rule("google", "AIza", "[A-Za-z0-9_\\-]", least_tail=35),
    Rule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.", "[A-Za-z0-9_\\-]", least_tail=8),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY", "[\\-]", least_tail=5, beyond=pem_end),
)
RULES = BASE + MORE

#: Under so many runs at a time, each is stepped through alone.
FEW = 96


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.rules = rules
        self.all = compile_rules([r.head + r.tail + "{%d}" % r.seen for r in rules], anywhere=True, reverse=True)
        self.each = [compile_rules([r.head + r.tail + "+"], anywhere=False) for r in rules]
        self.dead = [self._dead(d) for d in self.each]
        for r, d, dead in zip(rules, self.each, self.dead, strict=True):
            after = np.unique(d.next.reshape(-1, d.width)[d.accept > 0])
            if any(s != dead and not d.accept[s] for s in after.tolist()):
                raise ValueError(f"a match of {r.name} must end where its tail ends")
        self.resets = self.all.resets()
        self.shortest = self.all.shortest()
        self.rows = self.all.next.reshape(-1, self.all.width).tolist()
        self.ends = self.all.accept.tolist()
        self.each_rows = [d.next.reshape(-1, d.width).tolist() for d in self.each]
        self.each_ends = [d.accept.tolist() for d in self.each]

    @staticmethod
    def _dead(d: Dfa) -> int:
        table = d.next.reshape(-1, d.width)
        stuck = [s for s in range(len(table)) if not d.accept[s] and (table[s] == s).all()]
        return stuck[0] if stuck else -1

    def beginnings(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, in order, at which matches may begin, and the bits of the rules that have one there."""
        at = np.flatnonzero(np.concatenate([[True], self.resets[data], [True]]))
        lengths, last = np.diff(at) - 1, at[1:] - 2  # of each run, and its last byte
        long = lengths >= self.shortest
        lengths, last = lengths[long], last[long]
        order = np.argsort(-lengths, kind="stable")
        lengths, last = lengths[order], last[order]
        group, width = self.all.group[data], self.all.width
        state = np.zeros(len(last), dtype=np.int32)
        found, kinds = [], []
        active, step = len(last), 0
        shorter = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
        while active >= FEW:
            now = self.all.next[state[:active] * width + group[last[:active] - step]]
            state[:active] = now
            bits = self.all.accept[now]
            if bits.any():
                hit = np.flatnonzero(bits)
                found.append(last[hit] - step)
                kinds.append(bits[hit])
            step += 1
            active = int(shorter[step]) if step < len(shorter) else 0
        rows, ends = self.rows, self.ends
        for k in range(active):
            s, i, own, bits = int(state[k]), int(last[k]) - step, [], []
            for g in group[last[k] - lengths[k] + 1 : i + 1].tobytes()[::-1]:
                s = rows[s][g]
                if ends[s]:
                    own.append(i)
                    bits.append(ends[s])
                i -= 1
            found.append(np.array(own, dtype=np.int64))
            kinds.append(np.array(bits, dtype=np.int32))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        where, what = np.concatenate(found), np.concatenate(kinds)
        order = np.argsort(where)
        return where[order], what[order]

    def matches(self, rule: int, raw: bytes, begin: np.ndarray) -> Iterator[tuple[int, int]]:
        """Of the matches of one rule that begin at some of ``begin`` in ``raw`` the leftmost, longest, non-overlapping ones that are long enough."""
        rows, ends, dead, kept = self.each_rows[rule], self.each_ends[rule], self.dead[rule], self.rules[rule]
        group, n, k = self.each[rule].group.tolist(), len(raw), 0
        while k < len(begin):
            at = int(begin[k])
            s, i, first, last = 0, at, -1, -1
            while i < n:
                s = rows[s][group[raw[i]]]
                i += 1
                if ends[s]:
                    last = i
                    first = i if first < 0 else first
                elif s == dead:
                    break
            if last - first + 1 >= kept.least_tail and last - at >= kept.least:
                yield at, last
            k = int(np.searchsorted(begin, last))

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Of each text its (start, rule, end) in bytes, in order."""
        joined = b"\n".join(texts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not joined:
            return found
        where, what = self.beginnings(np.frombuffer(joined, dtype=np.uint8))
        if not len(where):
            return found
        bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
        for rule, r in enumerate(self.rules):
            begin = where[what >> rule & 1 > 0]
            if not len(begin):
                continue
            first = np.searchsorted(begin, bounds)
            for doc in np.flatnonzero(np.diff(first)).tolist():
                raw = texts[doc]
                for x, y in self.matches(rule, raw, begin[first[doc] : first[doc + 1]] - bounds[doc]):
                    found[doc].append((x, rule, r.beyond(raw, y) if r.beyond else y))
        for spans in found:
            spans.sort()
        return found


@functools.lru_cache(maxsize=2)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    """One for each worker process and set of rules."""
    built = Scanner(rules)
    if not built.resets[10]:
        raise ValueError("no head or tail of a rule may hold a line end")
    return built


def _points(raw: bytes) -> np.ndarray:
    """Code points before each byte offset."""
    return np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(df: DataFrame, text: str = "text", spans: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``spans``: kind, start and end of every match, by start and then by the order of the rules. Replaces a column of that name."""

    def begin():
        s = scanner(rules)

        def work(texts: list[bytes], known: list[bool]) -> list[pa.Array]:
            out = []
            for raw, found in zip(texts, s.scan(texts), strict=True):
                points = _points(raw) if found else None
                out.append([{"kind": rules[r].name, "start": int(points[a]), "end": int(points[b])} for a, r, b in found])
            return [pa.array(out, ARROW_SPANS)]

        return work

    return computed(df, named(text), [T.StructField(spans, SPANS)], begin)


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replaces every stretch of ``text`` that spans cover by ``[kind]``, of the first span in it. Null stays null."""

    def begin():
        s = scanner(rules)

        def work(texts: list[bytes], known: list[bool]) -> list[pa.Array]:
            return [pa.array([cover(raw, spans, rules) if ok else None for raw, spans, ok in zip(texts, s.scan(texts), known, strict=True)], pa.binary()).cast(pa.string())]

        return work

    return computed(df, named(text), [df.schema[text]], begin).select(*[named(c) for c in df.columns])


def cover(raw: bytes, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> bytes:
    """The text with each stretch of touching or overlapping spans replaced."""
    out, done, i = [], 0, 0
    while i < len(spans):
        a, rule, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][0] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [raw[done:a], b"[", rules[rule].name.encode(), b"]"]
        done = b
    return b"".join([*out, raw[done:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(names: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(names))


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    kinds = [r.name for r in BASE]
    counts = [F.size(_of([k])).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(_joined(_of(kinds)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
