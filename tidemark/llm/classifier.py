"""Quality classifier: evidence of the text, shrunk posteriors of its path and host.

A linear classifier gives each document the log-odds of being bad and of being toxic.
Sites say more: the mean of a host's documents, their labels where they have some and
else their probabilities, is shrunk towards the global rate, and that of a path towards
its host's. How strongly is estimated from how much more hosts (and paths in hosts)
differ than chance would make them, by moments; a site with few documents has little say
against what it is shrunk to. A document's final log-odds are its own plus what its
path's posterior, made without the document itself, adds to the global rate. Sites are
summed up by grouped aggregation, so that a hot host is a sum like any other.

The classifier's features are hashed words and beginnings of words, and bins of the
shares of symbols, capitals, repeated words and so on. It is fitted on about
``SAMPLE_ROWS`` labelled documents, chosen by a hash of doc_id: counts by feature and
label are summed up, the ``FEATURES`` that tell most are kept, and a logistic regression
over them is solved on the driver. All documents are scored, over their whole texts.

Defined cases: null and empty texts have only the features of emptiness; a document with
several labels counts as bad or toxic if one of them says so; null labels and labels
without a document are ignored; without labels of both kinds the log-odds are the prior's
(kept); null hosts and paths are sites of their own; equal rows count one by one; of
features that tie those in lower buckets are kept; texts of any length are read whole; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, cut, named, slices, small_batches, table
from .hashing import IS_SPACE, LOWER, joined, run_hashes, word_runs

#: Labelled documents that the classifier is fitted on, about; features that it keeps, at most.
SAMPLE_ROWS = 20_000
FEATURES = 3000
BUCKETS = 1 << 18
#: Least standard score of a feature's difference between the labels, and least documents with it.
LEAST_Z, LEAST_DOCS = 4.0, 3
STEP_BYTES = 1 << 20
TARGETS = ("bad", "toxic")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'\"-()" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def _bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Shares in bins of powers of two, from none to all."""
    share = part / np.maximum(1, whole)
    return np.where(part > 0, np.clip(np.floor(np.log2(np.maximum(share, 2.0**-10))) + 11, 1, 12), 0).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (the texts' numbers) and buckets of the distinct features of some texts."""
    data, starts = joined(texts)
    n = len(texts)
    lower = LOWER[data]
    doc_of = lambda at: np.searchsorted(starts, at, side="right") - 1
    first, end = word_runs(_LETTER[data])
    word_doc = doc_of(first)
    word = run_hashes(lower, first, end)
    begun = [run_hashes(lower, first[end - first > k], (first + k)[end - first > k]) for k in (4, 5, 6)]
    begun_doc = [word_doc[end - first > k] for k in (4, 5, 6)]
    token_first, token_end = word_runs(~IS_SPACE[data])
    token_doc = doc_of(token_first)
    size = np.bincount(token_doc, weights=token_end - token_first, minlength=n)[:n]
    tokens = np.bincount(token_doc, minlength=n)[:n]
    shares = [np.add.reduceat(np.concatenate([kind[data], [False]]).astype(np.int64), starts[:-1]) if n else np.zeros(0) for kind in (_SYMBOL, _UPPER, _DIGIT)]
    pairs = np.unique(np.stack([token_doc, run_hashes(lower, token_first, token_end).astype(np.int64)]), axis=1)[0] if len(token_doc) else token_doc
    distinct = np.bincount(pairs, minlength=n)[:n]
    surface = [
        _bin(shares[0], size),
        _bin(shares[1], size),
        _bin(shares[2], size),
        _bin(tokens - distinct, tokens),
        np.log2(tokens + 1).astype(np.int64),
        (2 * size / np.maximum(1, tokens)).astype(np.int64).clip(0, 30),
    ]
    rows = np.concatenate([word_doc, *begun_doc, *[np.arange(n)] * len(surface)])
    buckets = np.concatenate([
        word >> np.uint64(46),
        *[(h ^ np.uint64(0x5851F42D4C957F2D * (k + 1) % 2**64)) >> np.uint64(46) for k, h in enumerate(begun)],
        *[((b * 64 + k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46) for k, b in enumerate(surface)],
    ]).astype(np.int64)
    return rows, buckets


def _unique(rows: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * BUCKETS + buckets)
    return both // BUCKETS, both % BUCKETS


class Linear:
    """Log-odds of each target as sums over the distinct features of a text that it knows."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        self.place = np.full(BUCKETS, -1, dtype=np.int32)
        self.place[chosen] = np.arange(len(chosen))
        self.weights, self.bias = weights, bias

    def known(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rows, buckets = features(texts)
        place = self.place[buckets]
        held = place >= 0
        return _unique(rows[held], place[held].astype(np.int64))

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows, place = self.known(texts)
        return np.stack([np.bincount(rows, weights=w[place], minlength=len(texts)) + b for w, b in zip(self.weights, self.bias, strict=True)], axis=1)


def logistic(rows: np.ndarray, place: np.ndarray, n: int, d: int, y: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression over 0/1 features, by gradient steps with momentum per coordinate."""
    rate = min(max(float(y.mean()), 1.0 / (n + 2)), 1 - 1.0 / (n + 2))
    w, b = np.zeros(d), float(np.log(rate / (1 - rate)))
    m, v, mb, vb = np.zeros(d), np.zeros(d), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[place], minlength=n) + b
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.bincount(place, weights=error[rows], minlength=d) + ridge / n * w
        gb = float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id, bad and toxic (0 or 1) of each labelled document."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return known.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))


def sample_labels(labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = 5) -> DataFrame:
    """__id, bad and toxic of about ``rows`` labelled documents, chosen by a hash of doc_id."""
    one = known_labels(labels)
    n = one.count()
    scale = 1 << 30
    drawn = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(scale)) < int(scale * min(1.0, rows / max(1, n)))
    return one.where(drawn).select(F.col("doc_id").alias("__id"), "bad", "toxic")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Linear:
    """The classifier; ``docs`` has doc_id and text, ``labels`` has doc_id, quality and toxic."""
    sample = sample_labels(labels, sample_rows)
    # the sample has a bound, so it may be broadcast, and no text is shuffled
    learned = docs.select("doc_id", docs["text"].cast("binary").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("__id")).select("text", "bad", "toxic")
    learned = cut(learned, "learned")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, BUCKETS), dtype=np.int64)
        for batch in batches:
            y = [np.array(batch.column(1 + k).to_pylist(), dtype=np.int64) for k in range(2)]
            for start, texts in slices(batch.column(0), STEP_BYTES):
                rows, buckets = _unique(*features(texts))
                sums[0] += np.bincount(buckets, minlength=BUCKETS)
                for k in range(2):
                    sums[1 + k] += np.bincount(buckets, weights=y[k][start + rows], minlength=BUCKETS).astype(np.int64)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(s[at]) for s in sums]], names=["bucket", "n", "bad", "toxic"])

    total = learned.agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).head()
    counted = small_batches(learned).mapInArrow(count, "bucket long, n long, bad long, toxic long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    best = F.lit(0.0)
    for t in TARGETS:
        ones, zeros = total[t] or 0, total["n"] - (total[t] or 0)
        if ones and zeros:
            rate = F.col("n") / total["n"]
            z = F.abs(F.col(t) / ones - (F.col("n") - F.col(t)) / zeros) / F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-12)) * (1 / ones + 1 / zeros))
            best = F.greatest(best, z)
    telling = counted.where(F.col("n") >= LEAST_DOCS).select("bucket", best.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(FEATURES)
    chosen = np.array(sorted(r["bucket"] for r in telling.collect()), dtype=np.int64)
    blank = Linear(chosen, np.zeros((2, len(chosen))), np.zeros(2))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch.column(0), STEP_BYTES):
                rows, place = blank.known(texts)
                ends = np.searchsorted(rows, np.arange(len(texts) + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], names=["bad", "toxic", "place"])

    got = small_batches(learned).mapInArrow(known, "bad int, toxic int, place array<int>").orderBy("bad", "toxic", "place").toArrow()  # bounded rows of at most FEATURES numbers
    n = got.num_rows
    lists = got.column("place").combine_chunks() if n else pa.array([], pa.list_(pa.int32()))
    counts = np.diff(lists.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    rows, place = np.repeat(np.arange(n), counts), lists.flatten().to_numpy() if n else np.zeros(0, dtype=np.int64)
    weights, bias = np.zeros((2, len(chosen))), np.full(2, -10.0)
    for k, t in enumerate(TARGETS):
        y = got.column(t).to_numpy().astype(float) if n else np.zeros(0)
        if n and 0 < y.sum() < n:
            weights[k], bias[k] = logistic(rows, place, n, len(chosen), y)
    return Linear(chosen, weights, bias)


def evidence(docs: DataFrame, model: Linear, text: str = "text") -> DataFrame:
    """The columns of ``docs`` without ``text``, and the log-odds bad_logit and toxic_logit of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        def work(texts: list[bytes], known: list[bool]) -> list[pa.Array]:
            z = shared.value.score(texts)
            return [pa.array(z[:, k]) for k in range(len(TARGETS))]

        return work

    return computed(docs, named(text), [T.StructField(f"{t}_logit", T.DoubleType()) for t in TARGETS], begin, (text,))


def _logit(p: Column) -> Column:
    safe = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(safe / (1 - safe))


def _strength(sites: DataFrame, rate: Column, base: Column, n: Column, name: str) -> DataFrame:
    """One row: how many documents the rate above is worth against a site's own, by moments of beta-binomial rates."""
    apart = F.sum(n * F.pow(rate - base, 2)) / F.sum(n)
    chance = F.sum(base * (1 - base)) / F.sum(n)
    all_ = F.sum(n * base * (1 - base)) / F.sum(n)
    share = F.least(F.greatest((apart - chance) / F.greatest(all_, F.lit(1e-12)), F.lit(1e-4)), F.lit(0.5))
    return sites.agg(F.coalesce((1 - share) / share, F.lit(1.0)).alias(name))


def posteriors(scored: DataFrame, host: str, path: str) -> DataFrame:
    """A row for each path: __host, __path, n, host_n, and for each target t its sum t, that of the host host_t, the global rate prior_t, how many documents it (host_k_t) and the host's rate (k_t) are worth, and the posterior rate_t.

    ``scored`` has what is known of each document's targets as seen_t, from 0 to 1.
    """
    paths = cut(scored.groupBy(F.col(host).alias("__host"), F.col(path).alias("__path")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"seen_{t}").alias(t) for t in TARGETS]), "paths")
    hosts = paths.groupBy(F.col("__host").alias("__h")).agg(F.sum("n").alias("host_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    world = hosts.agg(F.sum("host_n").alias("all_n"), *[F.sum(f"host_{t}").alias(f"all_{t}") for t in TARGETS])  # one row
    hosts = hosts.crossJoin(F.broadcast(world))
    for t in TARGETS:
        base = F.col(f"all_{t}") / F.col("all_n")
        strength = _strength(hosts, F.col(f"host_{t}") / F.col("host_n"), base, F.col("host_n"), f"host_k_{t}")
        hosts = hosts.crossJoin(F.broadcast(strength)).withColumn(f"prior_{t}", base)
    hosts = cut(hosts.drop("all_n", *[f"all_{t}" for t in TARGETS]), "hosts")
    met = paths.join(hosts, F.col("__host").eqNullSafe(F.col("__h"))).drop("__h")
    for t in TARGETS:
        base = _shrunk(F.col(f"host_{t}"), F.col("host_n"), F.col(f"prior_{t}"), F.col(f"host_k_{t}"))
        strength = _strength(met, F.col(t) / F.col("n"), base, F.col("n"), f"k_{t}")
        met = met.crossJoin(F.broadcast(strength)).withColumn(f"rate_{t}", _shrunk(F.col(t), F.col("n"), base, F.col(f"k_{t}")))
    return cut(met, "posteriors")


def _shrunk(sum_: Column, n: Column, base: Column, worth: Column) -> Column:
    return (sum_ + worth * base) / (n + worth)


def without_itself(t: str) -> Column:
    """The posterior of a document's path without the document."""
    own = F.col(f"seen_{t}")
    host = _shrunk(F.col(f"host_{t}") - own, F.col("host_n") - 1, F.col(f"prior_{t}"), F.col(f"host_k_{t}"))
    return _shrunk(F.col(t) - own, F.col("n") - 1, host, F.col(f"k_{t}"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, bad_score and toxic_score (0 to 1), the path's posteriors site_bad and site_toxic, and kept, for each row."""
    return combined(docs, labels, fit(docs, labels, sample_rows), host, path)


def combined(docs: DataFrame, labels: DataFrame, model: Linear, host: str = "source", path: str = "lang") -> DataFrame:
    """The same by a classifier that has been fitted."""
    own = docs.select("doc_id", named(host).alias("__own_host"), named(path).alias("__own_path"), "text")
    known = known_labels(labels).select(F.col("doc_id").alias("__id"), *[F.col(t).alias(f"label_{t}") for t in TARGETS])
    rows = cut(evidence(own, model).join(known, F.col("doc_id") == F.col("__id"), "left").drop("__id"), "evidence")
    scored = rows.withColumns({f"seen_{t}": F.coalesce(F.col(f"label_{t}").cast("double"), 1 / (1 + F.exp(-F.col(f"{t}_logit")))) for t in TARGETS})
    sites = posteriors(scored, "__own_host", "__own_path")
    met = scored.join(sites, F.col("__own_host").eqNullSafe(F.col("__host")) & F.col("__own_path").eqNullSafe(F.col("__path")))
    score = {t: 1 / (1 + F.exp(-(F.col(f"{t}_logit") + _logit(without_itself(t)) - _logit(F.col(f"prior_{t}"))))) for t in TARGETS}
    return met.select(
        "doc_id",
        *[v.alias(f"{t}_score") for t, v in score.items()],
        *[F.col(f"rate_{t}").alias(f"site_{t}") for t in TARGETS],
        ((score["bad"] < 0.5) & (score["toxic"] < 0.5)).alias("kept"),
    )


def site_of_url(url: Column) -> tuple[Column, Column]:
    """Host and first step of the path of a URL, for tables that have one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.regexp_extract(url, r"^[^:]+://[^/?#]*/([^/?#]*)", 1)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
