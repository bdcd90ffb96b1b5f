"""Media columns: WAV sound in a binary column, and fingerprints of its spectral peaks.

A payload is written as the 8-bit samples of a mono WAV file by the ``wave`` module and
read back by it, byte for byte. The fingerprint follows from short-time Fourier
transforms: Hann windows of 1152 samples, 576 apart; in each window the strongest bin of
each of four bands that rises over the window's mean is a peak; each peak is paired with
the peaks of the next windows in the same band. A pair is stored as a number, its time
(the window's number) in the upper half and its code (both bins and the distance) in the
lower, so that two recordings can be aligned by equal codes.

Those windows are longer than most short texts, which have one or two of them and no
pairs, or few. So there is a second, fine layer: windows of 256 samples, 64 apart, over
the recording with silence on both sides, so that its first and last samples count as
much as the others; the strongest bin of each band is a peak where it rises over twice
the mean of its band. Its pairs carry ``FINE`` and follow the others, so that the array
ascends, and each layer is in order of time. A recording is transformed a stretch of
windows at a time.

Defined cases: null text is the empty text, whose payload is one block of padding; equal
payloads have equal files and fingerprints; fingerprints say where spectra peak, so texts
of a few letters that move no peak may share one; a null recording has a null payload and
fingerprint; texts of any length are stored and read whole; equal rows have equal values,
each its own; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import computed, named, table

BLOCK = 576
#: Follows the text; no UTF-8 text holds it.
PAD = b"\xff"
RATE = 8000
WINDOW, HOP = 2 * BLOCK, BLOCK
#: Bounds of the bands in bins of a window's spectrum.
BANDS = (4, 32, 96, 240, WINDOW // 2 + 1)
#: Each peak is paired with the same band's peaks of so many following windows.
REACH = 3
#: The same for the fine layer; its pairs have this bit.
FINE_WINDOW, FINE_HOP = 256, 64
FINE_BANDS = (2, 8, 24, 56, FINE_WINDOW // 2 + 1)
FINE = 1 << 62
#: Power that a fine peak exceeds: rounding in a window of constant samples stays far below.
QUIET = 1.0
#: Windows that are transformed at a time.
STRETCH = 1024
_HANN = np.hanning(WINDOW).astype(np.float32)
#: Periodic, so that a constant window has power in its two lowest bins alone.
_FINE_HANN = np.hanning(FINE_WINDOW + 1)[:-1].astype(np.float32)


def padded(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono samples are expected")
        return r.readframes(r.getnframes())


def _sound(samples: bytes) -> np.ndarray:
    return np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - np.float32(128)


def _silence(n: int) -> np.ndarray:
    return np.zeros(n, dtype=np.float32)


def peaks(samples: bytes) -> np.ndarray:
    """For each window the peak's bin in each band, or -1."""
    sound = _sound(samples)
    n = max(1, -(-len(sound) // HOP) - 1)
    sound = np.concatenate([sound, _silence(max(0, (n - 1) * HOP + WINDOW - len(sound)))])
    return _peaks(sound, n, HOP, _HANN, BANDS, lambda power, band: power.mean(axis=1))


def fine_peaks(samples: bytes) -> np.ndarray:
    """The same in the fine layer, whose first window ends with the first ``FINE_HOP`` samples and whose last begins with the last ones."""
    sound = _sound(samples)
    n = -(-len(sound) // FINE_HOP) + FINE_WINDOW // FINE_HOP - 1
    before = FINE_WINDOW - FINE_HOP
    sound = np.concatenate([_silence(before), sound, _silence((n - 1) * FINE_HOP + FINE_WINDOW - before - len(sound))])
    return _peaks(sound, n, FINE_HOP, _FINE_HANN, FINE_BANDS, lambda power, band: np.maximum(2 * band.mean(axis=1), QUIET))


def _peaks(sound: np.ndarray, n: int, hop: int, hann: np.ndarray, bands: tuple[int, ...], floor) -> np.ndarray:
    """Of ``n`` windows each band's strongest bin that rises over ``floor`` (of all powers and the band's), or -1."""
    frames = np.lib.stride_tricks.sliding_window_view(sound, len(hann))[::hop]
    found = []
    for at in range(0, n, STRETCH):
        spectrum = np.fft.rfft(frames[at : at + STRETCH] * hann)
        power = spectrum.real**2 + spectrum.imag**2
        bins = []
        for low, high in zip(bands, bands[1:], strict=False):
            band = power[:, low:high]
            top = band.argmax(axis=1)
            bins.append(np.where(np.take_along_axis(band, top[:, None], axis=1)[:, 0] > floor(power, band), top + low, -1))
        found.append(np.stack(bins, axis=1))
    return np.concatenate(found)


def pairs(peak: np.ndarray) -> np.ndarray:
    """Time-coded pairs: time << 32 | first bin << 20 | second bin << 8 | distance, ascending."""
    out = []
    for distance in range(1, min(REACH, len(peak) - 1) + 1):
        first, second = peak[:-distance], peak[distance:]
        time, band = np.nonzero((first >= 0) & (second >= 0))
        code = first[time, band] << 20 | second[time, band] << 8 | distance
        out.append(time.astype(np.int64) << 32 | code)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def features(samples: bytes) -> np.ndarray:
    """The pairs of both layers, ascending."""
    return np.concatenate([pairs(peaks(samples)), pairs(fine_peaks(samples)) | FINE])


def _mapped(df: DataFrame, source: str, added: list[T.StructField], arrow: list[pa.DataType], work) -> DataFrame:
    def begin():
        def each(rows: list[bytes], known: list[bool]) -> list[pa.Array]:
            done = [work(raw, ok) for raw, ok in zip(rows, known, strict=True)]
            return [pa.array([d[i] for d in done], t) for i, t in enumerate(arrow)]

        return each

    return computed(df, named(source), added, begin)


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds binary column ``media``: the text, padded to whole blocks, as a WAV file. Replaces a column of that name."""
    return _mapped(df, text, [T.StructField(media, T.BinaryType())], [pa.binary()], lambda raw, ok: (to_wav(padded(raw)),))


def fingerprint(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds ``payload`` (the samples read back) and ``fingerprint`` (array of time-coded pairs, the fine ones last). Replaces columns of these names."""

    def work(raw: bytes, ok: bool):
        if not ok:
            return None, None
        samples = from_wav(raw)
        return samples, features(samples)

    added = [T.StructField("payload", T.BinaryType()), T.StructField("fingerprint", T.ArrayType(T.LongType()))]
    return _mapped(df, media, added, [pa.binary(), pa.list_(pa.int64())], work)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.octet_length(F.coalesce(docs["text"], F.lit(""))).cast("long").alias("n_bytes"), "text")
    stored = store(sized).select("doc_id", "n_bytes", "media")
    read = fingerprint(stored)
    coded = F.array_join(read["fingerprint"].cast("array<string>"), ",")
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(read["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(read["payload"], -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2(read["media"], 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprint").cast("string"), F.sha2(coded.cast("binary"), 256)).alias("feature"),
    )
