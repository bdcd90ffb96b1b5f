import hashlib
import io
import random
import wave
import zlib

import numpy as np

from tidemark.llm import media


def test_query(spark, docs, monkeypatch):
    rows = [(1, None), (2, ""), (3, "é" * 288), (4, "abc " * 20_000), (5, "abc " * 20_000), (None, "x")]
    monkeypatch.setattr(media, "table", lambda *a: docs(rows))
    got = {r.doc_id: r for r in media.query(spark, "").collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(payload) + 44
    assert got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256 and got[3].feature != got[4].feature
    assert media.query(spark, "").where("doc_id < 0").count() == 0


def test_wav_is_read_by_the_module():
    payload = bytes(range(256)) * 9
    with wave.open(io.BytesIO(media.to_wav(payload))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, payload)
    assert media.from_wav(media.to_wav(payload)) == payload


def test_peaks_are_brute_force():
    r = np.random.default_rng(1)
    sound = r.integers(0, 256, 576 * 9, dtype=np.uint8)
    got = media.peaks(sound.tobytes())
    for t in range(len(got)):
        frame = (sound[t * 576 : t * 576 + 1152].astype(np.float32) - 128) * np.hanning(1152).astype(np.float32)
        power = np.abs(np.fft.rfft(frame)) ** 2
        for k, (low, high) in enumerate(zip(media.BANDS, media.BANDS[1:])):
            assert got[t, k] == low + power[low:high].argmax()
    p = media.pairs(got)
    assert (np.diff(p) >= 0).all()
    want = {(t << 32) | (int(got[t, k]) << 20) | (int(got[t + d, k]) << 8) | d for d in (1, 2, 3) for t in range(len(got) - d) for k in range(4)}
    assert set(p.tolist()) == want


def test_shifted_sound_has_the_same_codes():
    r = np.random.default_rng(2)
    sound = r.integers(0, 256, 576 * 20, dtype=np.uint8).tobytes()
    a, b = media.pairs(media.peaks(sound)), media.pairs(media.peaks(bytes(576 * 5) + sound))
    moved = {int(x) + (5 << 32) for x in a}
    assert len(moved & set(b.tolist())) >= 0.9 * len(moved)


def test_stretches_do_not_matter(monkeypatch):
    sound = np.random.default_rng(3).integers(0, 256, 576 * 40, dtype=np.uint8).tobytes()
    whole = media.peaks(sound)
    monkeypatch.setattr(media, "STRETCH", 7)
    assert (media.peaks(sound) == whole).all()


def test_short_texts_have_features_of_their_own(spark, docs, monkeypatch):
    words = "stream table window join key late state sink topic order price city".split()
    r = random.Random(5)
    texts = [" ".join(r.choices(words, k=n)) for n in (8, 30, 80, 150) for _ in range(12)]
    texts += [w * k for w in ("abcdefghi", "zyxwvutsr") for k in (64, 128)]  # whole blocks, without padding
    assert len(set(texts)) == len(texts) and {-(-len(t) // 576) for t in texts} == {1, 2}
    rows = [*enumerate(texts), (100, texts[0])]
    monkeypatch.setattr(media, "table", lambda *a: docs(rows))
    got = {r.doc_id: r.feature for r in media.query(spark, "").collect()}
    assert len({got[i] for i in range(len(texts))}) == len(texts) and got[100] == got[0]
    assert not any(f.startswith("0:") for f in got.values())


def test_fine_layer():
    r = np.random.default_rng(4)
    raw = r.integers(0, 256, 576, dtype=np.uint8).tobytes()
    got = media.fine_peaks(raw)
    sound = np.concatenate([np.zeros(192), np.frombuffer(raw, dtype=np.uint8).astype(float) - 128, np.zeros(192)]).astype(np.float32)
    assert len(got) == 12
    for t in range(12):
        power = np.abs(np.fft.rfft(sound[t * 64 : t * 64 + 256] * np.hanning(257)[:-1].astype(np.float32))) ** 2
        for k, (low, high) in enumerate(zip(media.FINE_BANDS, media.FINE_BANDS[1:])):
            band = power[low:high]
            assert got[t, k] == (low + band.argmax() if band.max() > max(2 * band.mean(), media.QUIET) else -1)
    found = media.features(raw * 3)
    assert (np.diff(found) > 0).all() and set(media.pairs(media.peaks(raw * 3)).tolist()) == {int(x) for x in found if x < media.FINE}
    assert (media.fine_peaks(b"\xff" * 576)[4:8] == -1).all()  # constant windows have no peaks
