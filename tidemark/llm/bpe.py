"""Byte-level BPE by forced-boundary splitting.

A pair of bytes that lies inside no vocabulary token can lie inside no merge, so a
cut between the two is certain. Texts are cut before white space first (a cut that the
pattern which splits text before the merges makes too, whatever surrounds it), and
stretches that are known already are looked up. New ones are split by the pattern, each
piece is cut at all of its certain pairs, every distinct fragment is merged alone, and the
ids are concatenated. No library takes part.

Short fragments merge one pair at a time. Fragments without a certain pair may be as
long as a text (a run of white space, or of letters); there all places of a rank are
merged at once, rank by rank, so that time grows with the length and not its square.
That is the same order as long as no merge uses what a later one makes, which the
constructor looks up; other vocabularies merge one pair at a time throughout.

Defined cases: null text encodes as the empty text (no ids, empty decoded text); the
strings of special tokens are single ids, as in the library; bytes that are not UTF-8
count as U+FFFD; texts of any length are encoded whole; equal rows are encoded alike, each
one; an empty table gives no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, keeps, named, table

#: Fixed value: the pattern by which byte-level BPE splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACES = b"\t\n\x0b\x0c\r "
#: Last bytes of the characters above ASCII that count as white space, each with what precedes it.
WIDE_SPACES = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80[\x80-\x8a\xa8\xa9\xaf]", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
#: Stretches, and fragments of them, whose ids a worker keeps (a fragment that is a whole
#: stretch elsewhere has the same ids there), in each of two generations; longer ones are not kept.
CACHE = 150_000
CACHED_BYTES = 64
#: Fragments of more bytes are merged rank by rank.
LONG = 200
#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max


def byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file (its JSON text) with a byte-level BPE model."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        symbol = byte_of_symbol()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        special_ids = {*self.special.values()}
        size = 1 + max([*spec["model"]["vocab"].values(), *special_ids])
        self.token = [b""] * size
        inside: set[tuple[int, int]] = set()
        for text, i in spec["model"]["vocab"].items():
            if i not in special_ids:
                raw = bytes(symbol[c] for c in text)
                self.token[i] = raw
                inside.update(zip(raw, raw[1:], strict=False))
        for raw, i in self.special.items():
            self.token[i] = raw
        #: certain[a][b]: no token holds byte a followed by byte b.
        self.certain = np.ones((256, 256), dtype=bool)
        self.certain[tuple(zip(*inside, strict=True))] = False
        self.sure_end = self.certain[:, list(SPACES)].all(axis=1)
        self.stretches = re.compile(self._pattern())
        self.pieces = regex.compile(PATTERN).findall
        self._merges(spec["model"], [symbol_ for symbol_, _ in sorted(symbol.items(), key=lambda x: x[1])], size)
        self.specials = re.compile(b"|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        #: What was met since the last change of generations, and what before.
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _merges(self, model: dict, symbols: list[str], size: int) -> None:
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte = np.array([vocab[c] for c in symbols], dtype=np.int32)
        self.left, self.right, self.result = (np.array([vocab[t] for t in column], dtype=np.int32) for column in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.rank = {pair: k for k, pair in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True))}
        self.results, self.bytes = self.result.tolist(), self.byte.tolist()
        #: Of each token the ranks of its pairs by the token on the right; of each two bytes the rank of theirs.
        self.after: list[dict[int, int]] = [{} for _ in range(size)]
        for (a, b), k in self.rank.items():
            self.after[a][b] = k
        self.of_bytes = [self.after[a].get(b, NONE) for a in self.bytes for b in self.bytes]
        codes = self.left.astype(np.int64) * size + self.right
        order = np.argsort(codes, kind="stable")
        self.codes, self.code_rank, self.size = codes[order], order.astype(np.int32), size
        made = np.full(size, -1)
        np.maximum.at(made, self.result, np.arange(len(pairs)))
        #: Whether all that a merge joins is made by earlier ones.
        self.ordered = bool((np.maximum(made[self.left], made[self.right]) < np.arange(len(pairs))).all())

    def _pattern(self) -> bytes:
        """Stretches: white space, then a run without it, then on over every white space before which no cut is certain."""
        unsure = [b for b in range(256) if b not in SPACES and not self.sure_end[b]]
        held = WIDE_SPACES + ([b"[" + b"".join(re.escape(bytes([b])) for b in unsure) + b"]"] if unsure else [])
        behind = b"|".join(b"(?<=" + h + b")" for h in held)
        return rb"[\t-\r ]*[^\t-\r ]+(?:(?:" + behind + rb")[\t-\r ]+[^\t-\r ]*)*|[\t-\r ]+"

    def _short(self, raw: bytes) -> list[int]:
        """Ids of a fragment: the pair of least rank, the leftmost of its kind, is joined until none is left."""
        first, after, results, of_bytes = self.bytes, self.after, self.results, self.of_bytes
        ids = [first[b] for b in raw]
        ranks = [of_bytes[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            made = ids[i] = results[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = after[ids[i - 1]].get(made, NONE)
            if i < len(ranks):
                ranks[i] = after[made].get(ids[i + 1], NONE)
        return ids

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.code_rank[at], NONE)

    def _long(self, raw: bytes) -> np.ndarray:
        """The same for a long fragment, all places of a rank at once."""
        ids = self.byte[np.frombuffer(raw, dtype=np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        todo: list[int] = []
        places: dict[int, list[np.ndarray]] = {}

        def add(starts: np.ndarray) -> None:
            starts = starts[after[starts] < n]
            ranks = self._ranks(ids[starts], ids[after[starts]])
            starts, ranks = starts[ranks != NONE], ranks[ranks != NONE]
            if not len(starts):
                return
            order = np.argsort(ranks, kind="stable")
            starts, ranks = starts[order], ranks[order]
            bounds = np.flatnonzero(np.diff(ranks)) + 1
            for part, r in zip(np.split(starts, bounds), ranks[np.concatenate([[0], bounds])].tolist(), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(todo, r)
                places[r].append(part)

        add(np.arange(n, dtype=np.int32))
        while todo:
            r = heapq.heappop(todo)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[ids[at] == self.left[r]]  # joined bytes have the id -1
            at = at[after[at] < n]
            at = at[ids[after[at]] == self.right[r]]
            if len(at) > 1 and self.left[r] == self.right[r]:  # of a run of overlapping places, every second
                begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
                count = np.arange(len(at))
                at = at[(count - np.maximum.accumulate(np.where(begins, count, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at], ids[gone] = self.result[r], -1
            beyond = after[gone]
            after[at] = beyond
            before[beyond[beyond < n]] = at[beyond < n]
            add(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return ids[ids >= 0]

    def _fragment(self, raw: bytes) -> bytes:
        ids = self.known.get(raw) or self.older.get(raw)
        if ids is None:
            if len(raw) > LONG and self.ordered:
                return self._long(raw).astype("<u4").tobytes()
            short = self._short(raw)
            ids = struct.pack(f"<{len(short)}I", *short)
            if len(raw) <= CACHED_BYTES:
                self.known[raw] = ids
        return ids

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of stretches: split by the pattern, cut at all certain pairs, fragments merged one by one."""
        found: dict[bytes, bytes] = {}
        pieces: list[bytes] = []
        counts = []
        for f in new:
            plain = (f[1:] if f[:1] == b" " else f).isalpha()  # one word of ASCII letters
            own = [f] if plain else [p.encode() for p in self.pieces(f.decode("utf-8", "replace"))]
            pieces += own
            counts.append(len(own))
        joined = b"".join(pieces)
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        cut = np.concatenate([self.certain[data[:-1], data[1:]], [True]])
        cut[ends - 1] = True
        stops = np.flatnonzero(cut) + 1
        last = np.searchsorted(stops, ends[np.cumsum(counts) - 1]) + 1  # fragments up to each stretch's end
        starts = [0, *stops.tolist()]
        ids = [self._fragment(joined[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        at = 0
        for f, end in zip(new, last.tolist(), strict=True):
            found[f] = ids[at] if end - at == 1 else b"".join(ids[at:end])
            at = end
        return found

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._split(t) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set()
        for f in {f for parts in split for f in parts if f not in known}:
            if f in older:
                known[f] = older[f]
            else:
                missing.add(f)
        extra: dict[bytes, bytes] = {f: struct.pack("<I", self.special[f]) for f in missing if f in self.special}
        if missing := list(missing.difference(extra)):
            for f, ids in self._learn(missing).items():
                (known if len(f) <= CACHED_BYTES else extra)[f] = ids
        if not extra:
            return [b"".join(map(known.__getitem__, parts)) for parts in split]
        return [b"".join([extra[f] if f in extra else known[f] for f in parts]) for parts in split]

    def _split(self, text: bytes) -> list[bytes]:
        if self.specials is None or not self.specials.search(text):
            return self.stretches.findall(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += self.stretches.findall(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.stretches.findall(text[at:])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text, special tokens included."""
        raw = b"".join(map(self.token.__getitem__, memoryview(ids).cast("I")))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


_built: dict[int, ForcedBoundaryBPE] = {}


def _codec(tokenizer_json: str) -> ForcedBoundaryBPE:
    """One for each worker process and vocabulary, until the worker does something else."""
    keeps("bpe", _built.clear)
    key = hash(tokenizer_json)
    if key not in _built:
        _built.clear()
        _built[key] = ForcedBoundaryBPE(tokenizer_json)
    return _built[key]


def _mapped(df: DataFrame, source: str, targets: list[T.StructField], tokenizer_path: str, work) -> DataFrame:
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def begin():
        codec = _codec(shared.value)
        return lambda rows, known: work(codec, rows)

    return computed(df, named(source), targets, begin)


def _encoded(codec: ForcedBoundaryBPE, rows: list[bytes]) -> pa.Array:
    return pa.array(codec.encode_batch(rows), pa.binary())


def _decoded(codec: ForcedBoundaryBPE, ids: list[bytes]) -> pa.Array:
    return pa.array([codec.decode(r) for r in ids], pa.binary()).cast(pa.string())


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds binary column ``ids``: the text's ids as little-endian unsigned 32-bit integers. Replaces a column of that name."""
    return _mapped(df, text, [T.StructField(ids, T.BinaryType())], tokenizer_path, lambda codec, rows: [_encoded(codec, rows)])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds string column ``text``: what the ids decode to. Replaces a column of that name."""
    return _mapped(df, ids, [T.StructField(text, T.StringType())], tokenizer_path, lambda codec, rows: [_decoded(codec, rows)])


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds what ``encode`` adds, and as ``decoded`` what ``decode`` makes of it. One worker process for a task does both; in two steps a task has two, each with a codec of its own."""

    def both(codec: ForcedBoundaryBPE, rows: list[bytes]) -> list[pa.Array]:
        made = codec.encode_batch(rows)
        return [pa.array(made, pa.binary()), _decoded(codec, made)]

    return _mapped(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], tokenizer_path, both)


def digests(df: DataFrame, tokenizer_path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_tokens, ids, ids_sha256 and decoded_sha256 of every row's whole text."""
    held = [named(c) for c in keep]
    both = round_trip(df.select(*held, named("text").alias("__text")), tokenizer_path, "__text", "__ids", "__decoded")
    return both.select(
        *held,
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.col("__ids").alias("ids"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2(F.col("__decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).drop("ids")
