"""Language ID: script ranges narrow the candidates, Viterbi labels the spans.

Words are runs of letters. A word's score for a language is the log-likelihood of its
hashed letter pairs and triples there; languages whose share of the word's script was
under ``LEAST_SHARE`` in training are no candidates. Over the words of a text the best
path through languages is sought where each change costs ``SWITCH``. If no stretch of
words prefers other languages to the text's best one by more than one change costs, the
best path has one label, and that is found by prefix sums alone; other texts go through
the recursion word by word. A text's language is the one with the most letters in its
spans, and its score their share.

The model is fitted on at most about ``SAMPLE_DOCS`` labelled rows for each language,
chosen by a hash of the whole row; counting is distributed, and the driver gets the counts
of buckets that occur. There may be any number of languages; the model has 147 kB for each.
Every row is labelled, over its whole text.

Defined cases: null text, or one without letters, has no span, language ``und`` and score
0; without labelled rows, as in an empty table, every text is ``und``; rows without a label
are not learned from; of languages that tie the first by code point is taken; letters whose
lower case is more than one letter stand for themselves; texts of any length are labelled
whole; equal rows count one by one; other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, cut, named, row_key, slices, small_batches, small_side, table

UNKNOWN = "und"
SAMPLE_DOCS = 10_000
#: Buckets of letter pairs and of letter triples.
PAIRS, TRIPLES = 1 << 12, 1 << 15
SMOOTH = 0.1
LEAST_SHARE = 0.01
SWITCH = 25.0
#: Text that is held at a time, at most; scores of letters.
STEP_BYTES, HELD = 1 << 20, 1 << 22

#: First code points of stretches, and the script whose letters lie there.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"),
    (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0x20000, "Han"),
)
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], dtype=np.uint32)
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS], dtype=np.int64)
#: No letter lies beyond.
_POINTS = 0x40000


@functools.cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point whether it is a letter, and its lower case where that is one code point."""
    letter = np.fromiter((chr(i).isalpha() for i in range(_POINTS)), dtype=bool, count=_POINTS)
    lower = np.arange(_POINTS, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        low = chr(i).lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return letter, lower


class Words:
    """The words of some texts: first letter and one past the last (of the texts in a row), text, script, and hashed features of each letter."""

    def __init__(self, texts: list[bytes]) -> None:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        self.base = np.cumsum([0, *[len(d) + 1 for d in decoded]])
        joined = ("\n".join(decoded) + "\n").encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(joined, dtype=np.uint32)
        is_letter, lower = _letters()
        known = np.minimum(points, np.uint32(_POINTS - 1))
        letter = is_letter[known]
        c = np.where(letter, lower[known], 0).astype(np.uint32)
        edge = np.diff(letter.astype(np.int8), prepend=0)
        self.first, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.base, self.first, side="right") - 1
        self.at = np.flatnonzero(letter)
        self.offset = np.concatenate([[0], np.cumsum(self.end - self.first)])
        before, own = c[self.at - 1] if len(self.at) else c[:0], c[self.at]
        if len(self.at) and self.at[0] == 0:
            before = before.copy()
            before[0] = 0
        after = c[self.at + 1] if len(self.at) else c[:0]
        pair = own * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)
        triple = pair + after * np.uint32(0xC2B2AE3D)
        self.pair = ((pair ^ pair >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(20)).astype(np.int64)
        self.triple = ((triple ^ triple >> np.uint32(15)) * np.uint32(0x165667B1) >> np.uint32(17)).astype(np.int64)
        self.script = _SCRIPT[np.maximum(np.searchsorted(_STARTS, points[self.first], side="right") - 1, 0)]


class Model:
    def __init__(self, counts: pa.Table) -> None:
        """From lang, kind (0 pairs, 1 triples, 2 letters of a script), bucket and n, once for each that occurs."""
        self.languages = sorted(set(counts.column("lang").to_pylist()))
        place = {name: i for i, name in enumerate(self.languages)}
        lang = np.array([place[x] for x in counts.column("lang").to_pylist()], dtype=np.int64)
        kind, bucket, n = (counts.column(c).to_numpy() for c in ("kind", "bucket", "n"))
        seen = []
        for k, size in enumerate((PAIRS, TRIPLES, len(NAMES))):
            own = np.zeros((size, len(self.languages)), dtype=np.float32)
            own[bucket[kind == k], lang[kind == k]] = n[kind == k]
            seen.append(own)
        self.pair, self.triple = (np.log((s + SMOOTH) / (s.sum(axis=0, dtype=np.float64) + SMOOTH * len(s)).astype(np.float32)) / 2 for s in seen[:2])
        share = seen[2] / np.maximum(1, seen[2].sum(axis=0))
        #: candidate[script, language]; a script that no language is written in leaves all of them.
        self.candidate = share >= LEAST_SHARE
        self.candidate[~self.candidate.any(axis=1)] = True

    def label(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Of each text its spans: language, first code point, one past the last."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        w = Words(texts)
        if not len(w.first) or not self.languages:
            return out
        score = np.empty((len(w.first), len(self.languages)))
        step = max(1, HELD // len(self.languages))  # letters that are looked up at a time
        at = 0
        while at < len(w.first):
            end = max(at + 1, int(np.searchsorted(w.offset, w.offset[at] + step, side="right")) - 1)
            a, b = w.offset[at], w.offset[end]
            score[at:end] = np.add.reduceat(self.pair[w.pair[a:b]] + self.triple[w.triple[a:b]], w.offset[at:end] - a, axis=0)
            at = end
        score[~self.candidate[w.script]] = -1e6
        bounds = np.searchsorted(w.text, np.arange(len(texts) + 1))
        for i in range(len(texts)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                continue
            s = score[a:b]
            best = int(s.sum(axis=0).argmax())
            path = [(best, 0, b - a)] if self._steady(s, best) else viterbi(s, SWITCH)
            shift = int(w.base[i])
            out[i] = [(label, int(w.first[a + x]) - shift, int(w.end[a + y - 1]) - shift) for label, x, y in path]
        return out

    @staticmethod
    def _steady(s: np.ndarray, best: int) -> bool:
        """Whether no run of words gains more by other languages than one change costs."""
        if s.shape[1] == 1:
            return True
        other = np.delete(s, best, axis=1).max(axis=1) - s[:, best]
        total = np.concatenate([[0.0], np.cumsum(other)])
        return bool((total - np.minimum.accumulate(total)).max() <= SWITCH)


def viterbi(score: np.ndarray, switch: float) -> list[tuple[int, int, int]]:
    """Runs (label, first word, one past the last) of the path with the greatest score less ``switch`` for each change."""
    n, width = score.shape
    value, labels = score[0].tolist(), range(width)
    back = array("i")  # for each word but the first, and each label, the label before
    for at in range(1, n, 4096):
        for row in score[at : at + 4096].tolist():
            top = max(value)
            source = value.index(top)
            top -= switch
            back.extend([k if value[k] >= top else source for k in labels])
            value = [(v if v >= top else top) + r for v, r in zip(value, row, strict=True)]
    label = value.index(max(value))
    runs, end = [], n
    for t in range(n - 1, 0, -1):
        before = back[(t - 1) * width + label]
        if before != label:
            runs.append((label, t, end))
            label, end = before, t
    return [*runs, (label, 0, end)][::-1]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> Model:
    """A model of the languages of the rows that have one, from about ``sample_docs`` of each chosen by hash."""
    key = F.pmod(F.xxhash64(F.lit(seed), *row_key(labelled)), F.lit(1 << 30))
    rows = labelled.select(named(lang).cast("string").alias("lang"), named(text).cast("binary").alias("text"), key.alias("key")).where("lang IS NOT NULL")
    rates = rows.groupBy(F.col("lang").alias("own")).agg(F.least(F.lit(1.0), sample_docs / F.count(F.lit(1))).alias("rate"))
    rates = cut(rates, "rates")
    drawn = rows.join(small_side(rates, rates.count()), F.col("lang") == F.col("own")).where(F.col("key") < F.col("rate") * float(1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for start, texts in slices(batch.column(1), STEP_BYTES):
                own = langs[start : start + len(texts)]
                for name in sorted(set(own)):
                    w = Words([t for t, x in zip(texts, own, strict=True) if x == name])
                    held = sums.setdefault(name, [np.zeros(n, dtype=np.int64) for n in (PAIRS, TRIPLES, len(NAMES))])
                    held[0] += np.bincount(w.pair, minlength=PAIRS)
                    held[1] += np.bincount(w.triple, minlength=TRIPLES)
                    held[2] += np.bincount(w.script, weights=w.end - w.first, minlength=len(NAMES)).astype(np.int64)
        for name, held in sums.items():
            for kind, values in enumerate(held):
                at = np.flatnonzero(values)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["lang", "kind", "bucket", "n"])

    counted = small_batches(drawn).mapInArrow(count, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    return Model(counted.toArrow())  # a row for each language and bucket that occurs


ARROW_SPANS = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
ADDED = T.StructType([
    T.StructField("lang_spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def label(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_spans (lang, start, end in code points), lang_pred and score. Replaces columns of these names; drops ``text``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def begin():
        m = shared.value

        def work(texts: list[bytes], known: list[bool]) -> list[pa.Array]:
            spans, preds, scores = [], [], []
            for found in m.label(texts):
                mass = np.zeros(len(m.languages) + 1)
                for k, a, b in found:
                    mass[k] += b - a
                top = int(mass.argmax())
                spans.append([{"lang": m.languages[k], "start": a, "end": b} for k, a, b in found])
                preds.append(m.languages[top] if found else UNKNOWN)
                scores.append(float(mass[top] / mass.sum()) if found else 0.0)
            return [pa.array(spans, ARROW_SPANS), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]

        return work

    return computed(df, named(text), ADDED.fields, begin, (text,), max(1 << 14, min(STEP_BYTES, 16 * STEP_BYTES // max(1, len(model.languages)))))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(docs["doc_id"].cast("string")) % 5
    model = fit(docs.where(fold != 0).select("doc_id", "text", "lang"))
    labelled = label(docs.select("doc_id", "text", F.coalesce(fold == 0, F.lit(False)).alias("held_out")), model)
    return labelled.select("doc_id", "held_out", "lang_pred", "score", F.size("lang_spans").cast("long").alias("n_spans"))
