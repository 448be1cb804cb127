"""Audio fingerprints: what they are invariant to, and recall against all pairs."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from placeloom.llm import chroma, recordings


def wav(x, rate=4000, width=2, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        data = (np.clip(x, -1, 1) * 32767).astype("<i2") if width == 2 else (np.clip(x, -1, 1) * 127 + 128).astype(np.uint8)
        w.writeframes(np.repeat(data, channels).tobytes())
    return out.getvalue()


def tone(hz, seconds=4, rate=4000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(seconds * rate) / rate)


def test_pitch_class_of_a_tone():
    for octave in (220.0, 440.0, 880.0):
        frames = chroma.chroma(*chroma.samples(wav(tone(octave))))
        assert (frames.argmax(axis=1) == 0).all() and np.allclose((frames**2).sum(axis=1), 1)


def test_loudness_and_container_do_not_matter():
    x = np.concatenate([tone(f, 1) for f in (220, 330, 275, 440, 247, 370)])
    base = chroma.packed(chroma.chroma(*chroma.samples(wav(x))))
    for other in (wav(x * 0.3), wav(x, channels=2), wav(x, width=1)):
        got = chroma.packed(chroma.chroma(*chroma.samples(other)))
        # most pitch classes of bare tones are empty, so some bits compare rounding with rounding
        assert np.bitwise_count((got ^ base).view(np.uint32)).sum() <= 0.1 * 32 * len(base)


@pytest.mark.parametrize("media", [None, b"", b"RIFFjunk", wav(np.zeros(100)), wav(tone(440))[:50]])
def test_nothing_to_hear(media):
    assert len(chroma.packed(chroma.chroma(*chroma.samples(media)))) == 0


def test_silence_is_zero():
    assert not chroma.packed(chroma.chroma(*chroma.samples(wav(np.zeros(20_000))))).any()


def best(a, b):
    out = (1.0, 0, 0)
    for s in range(-len(b) + 24, len(a) - 23):
        i, j = max(0, s), max(0, -s)
        n = min(len(a) - i, len(b) - j)
        if n >= 24:
            e = float(np.bitwise_count((a[i : i + n] ^ b[j : j + n]).view(np.uint32)).sum() / 32 / n)
            out = min(out, (e, s, n))
    return out


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(160)]
    media = recordings.recordings(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    prints = chroma.fingerprints(media).cache()
    fps = {r["id"]: np.array(r["fp"], np.int32) for r in prints.collect()}
    true = {(a, b) for a in range(0, 160, 5) for b in fps if a != b and best(fps[a], fps[b])[0] <= 0.2}
    got = chroma.align(prints, "id % 5 = 0").collect()
    found = {(r["query_id"], r["match_id"]) for r in got}
    assert found <= true and len(found) >= 0.9 * len(true) and len(true) > 60
    for r in got:
        e, s, n = best(fps[r["query_id"]], fps[r["match_id"]])
        assert abs(r["shift"] - s) <= 1 and abs(r["bit_error"] - e) < 0.05


def test_copies_are_one_class(spark):
    rng = np.random.default_rng(2)
    tune = np.concatenate([tone(f, 1) for f in rng.choice([220, 247, 275, 330, 370, 415, 440], 8)])
    near = tune + rng.normal(0, 0.02, len(tune))
    rows = [(k, wav(tune), 0) for k in range(1, 40)] + [(100, wav(near), 0), (101, None, 0), (102, wav(np.zeros(20_000)), 0), (103, wav(np.zeros(20_000)), 0), (None, wav(tune), 0)]
    prints = chroma.fingerprints(spark.createDataFrame(rows, "id long, audio binary, fp int"))
    got = chroma.align(prints, "id >= 100").collect()
    assert [(r["query_id"], r["match_id"], r["match_rows"], r["shift"]) for r in got] == [(100, 1, 40, 0)]
    assert chroma.align(prints.where("false"), "id > 0").count() == 0


def test_query_against_all_pairs(spark, sf_dir):
    """The query's alignments on a whole table: nine tenths or more of those that a comparison with all recordings finds, and no other."""
    from placeloom.llm.queries import QUERIES

    media = recordings.recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    fps = {r["id"]: np.array(r["fp"], np.int32) for r in chroma.fingerprints(media).collect()}
    asked = [i for i in fps if i % 50 == 0]
    true = {(a, b) for a in asked for b in fps if a != b and best(fps[a], fps[b])[0] <= 0.2}
    got = QUERIES["op5_media_columns"](spark, sf_dir).collect()
    found = {(r["query_id"], r["match_id"]) for r in got}
    assert len(asked) >= 4 and len(true) >= 24 and found <= true and len(found) >= 0.9 * len(true)


@pytest.mark.parametrize(("rate", "width", "channels"), [(4000, 2, 1), (4000, 1, 2), (44_100, 2, 2)])
def test_pieces_give_the_frames_of_the_whole(rate, width, channels):
    rng = np.random.default_rng(6)
    media = wav(np.concatenate([tone(f, 1, rate) for f in rng.choice([220, 247, 330, 440], 9)]) + rng.normal(0, 0.05, 9 * rate), rate, width, channels)
    whole = chroma.chroma(*chroma.samples(media))
    for at_once in (1, 3, 64):
        assert np.array_equal(chroma.frames(media, at_once), whole)
    assert len(chroma.frames(media[:-3])) in (len(whole), len(whole) - 1) and not len(chroma.frames(media[:50]))


def test_a_long_recording_takes_bounded_memory():
    """Beside its bytes, four times the length takes little more: half an hour of stereo at 44.1 kHz under 100 MB."""
    import tracemalloc

    minute = wav(np.random.default_rng(7).normal(0, 0.1, 60 * 44_100), 44_100, 2, 2)
    peaks = []
    for minutes in (8, 32):
        media = wav(np.zeros(0), 44_100, 2, 2)[:44] + minute[44:] * minutes
        media = media[:4] + (len(media) - 8).to_bytes(4, "little") + media[8:40] + (len(media) - 44).to_bytes(4, "little") + media[44:]
        tracemalloc.start()
        found = chroma.packed(chroma.frames(media))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) > 1200 * minutes
    assert peaks[1] < 100e6 and peaks[1] < 3 * peaks[0]
