"""Hashes of words and of runs of words, for many texts at a time.

Sets of shingles are made of 128-bit BLAKE2 digests of the words, as two numbers of 64
bits that are combined into two independent hashes of each run of words. ``run_hashes``
is a cheaper hash of runs of bytes, their polynomial in an odd base modulo 2**64, from
prefix sums over the whole buffer. Words can be built that collide under it, so that it
only serves where features share buckets anyway.
"""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15
_tables: dict[str, np.ndarray] = {}

#: Of each byte, whether it is white space in the word contracts.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Of each byte, its ASCII lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_tables.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["up"], _tables["down"]


def run_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run data[first:end] of a byte array."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def word_runs(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and one past the last of each run of set flags."""
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a line end between them, and where each begins."""
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return np.frombuffer(b"\n".join(texts) or b"\n", dtype=np.uint8), starts


class Digests(dict):
    """128-bit digests of words, kept for short words up to a bound."""

    KEPT, LONGEST = 200_000, 32

    def __missing__(self, word: bytes) -> bytes:
        digest = hashlib.blake2b(word, digest_size=16).digest()
        if len(word) <= self.LONGEST:
            if len(self) >= self.KEPT:
                self.clear()
            self[word] = digest
        return digest


_digests = Digests()
#: Gives the digests back.
forget = _digests.clear
_LOWER = LOWER.tobytes()


def _combined(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` of ``words`` in a row."""
    size = len(words) - n + 1
    runs = np.full(size, n, dtype=np.uint64)
    for k in range(n):
        runs = mix(runs * np.uint64(BASE) + words[k : k + size])
    return runs


def shingles(texts: list[bytes], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text its distinct runs of ``size`` words, ASCII letters in lower case, by two independent hashes.

    The first hash has 63 bits, so that it orders alike as a signed integer, and is in
    ascending order; the second has 64 and is that of the same run. A text with fewer
    words has one run, all of them; one without words has none.
    """
    split = [t.translate(_LOWER).split() for t in texts]  # at 0x20 and 0x09 to 0x0D
    ends = np.cumsum([0, *map(len, split)])
    digests = np.frombuffer(b"".join([_digests[w] for words in split for w in words]), dtype="<u8").reshape(-1, 2)
    one, two = digests[:, 0].copy(), digests[:, 1].copy()
    whole = [_combined(h, size) for h in (one, two)] if len(one) >= size else []
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            first, second = (h[a : b - size + 1] for h in whole)
        else:
            first, second = (_combined(h[a:b], b - a) if b > a else h[:0] for h in (one, two))
        values, at = np.unique(first >> np.uint64(1), return_index=True)
        out.append((values.astype(np.int64), second[at]))
    return out
