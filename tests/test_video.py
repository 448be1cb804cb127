"""Headers and sound of generated MP4 files."""

from __future__ import annotations

import struct

import pyarrow as pa
import pytest

from placeloom.plans.video import box, esds, movie
from placeloom.sources import tables, video

FRAMES = [bytes([k % 251]) * (k % 40 + 1) for k in range(100)]


def _adts(frame: bytes) -> bytes:
    """A header bit by bit: AAC LC, 44.1 kHz, two channels."""
    bits = "111111111111" + "0" + "00" + "1" + "01" + "0100" + "0" + "010" + "0000" + f"{len(frame) + 7:013b}" + "1" * 11 + "00"
    return int(bits, 2).to_bytes(7, "big") + frame


def _write(folder, **files):
    for name, data in files.items():
        (folder / f"{name}.mp4").write_bytes(data)


def _rows(df):
    return {(r["path"] or "").rsplit("/", 1)[-1].removesuffix(".mp4"): r for r in df.collect()}


def test_headers(spark, tmp_path):
    big = movie(3.5, 1080, 1920, 90, FRAMES, late=True, pictures=bytes(200_000))
    cut = movie(3.5, 640, 360, 0, FRAMES)
    mehd = box("moov", box("mvhd", struct.pack(">IIIII", 0, 0, 0, 600, 0), bytes(76)), box("mvex", box("mehd", struct.pack(">II", 0, 9000))))
    _write(
        tmp_path, late=big, early=movie(61.25, 640, 360, 270, None, wide=True), wide=movie(0.04, 10, 10, 180, FRAMES, wide=True, late=True), cut=cut[:200], text=b"no movie at all, but some text", zero=movie(0, 640, 360), fragments=box("ftyp", b"isom") + mehd,
        unknown=box("moov", box("mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, 0xFFFFFFFF), bytes(76))), scale=box("moov", box("mvhd", struct.pack(">IIIII", 0, 0, 0, 0, 5), bytes(76))), small=box("moov", b"\0\0\0\3mvhd"), short=box("moov", box("mvhd", b"\0")),
        last=struct.pack(">I4s", 0, b"moov") + box("mvhd", struct.pack(">IIIII", 0, 0, 0, 10, 25), bytes(76)),
    )
    files = tables.media_files(spark, str(tmp_path), "*.mp4").select("path", "length")
    got = _rows(video.probe(files))
    assert {k: r["duration"] for k, r in got.items() if not r["broken"]} == {"late": 3.5, "early": 61.25, "wide": 0.04, "zero": 60.0, "fragments": 15.0, "unknown": 60.0, "scale": 60.0, "last": 2.5}
    assert {k for k, r in got.items() if r["broken"]} == {"cut", "text", "small", "short"} and {r["duration"] for r in got.values() if r["broken"]} == {60.0}
    assert [(got[k]["width"], got[k]["height"], got[k]["rotation"], got[k]["has_audio"]) for k in ("late", "early", "wide")] == [(1080, 1920, 90, True), (640, 360, 270, False), (10, 10, 180, True)]
    assert len(big) > 6_000_000 and max(r["bytes_read"] for r in got.values()) < 1024
    row = video.probe(files.where("path LIKE '%/late.mp4'")).select(*[c.alias(n) for c, n in zip(video.shown(), ("w", "h"))]).first()
    assert tuple(row) == (1920, 1080)


def test_missing_repeated_and_no_files(spark, tmp_path):
    _write(tmp_path, one=movie(2, 4, 4), empty=b"")
    paths = spark.createDataFrame([(f"{tmp_path}/one.mp4", 1), (f"{tmp_path}/one.mp4", 2), (f"{tmp_path}/gone.mp4", 3), (None, 4), (f"{tmp_path}/empty.mp4", 5)], "path string, duration int")
    got = video.probe(paths).collect()
    assert sorted((r["duration"], r["broken"]) for r in got) == [(2.0, False), (2.0, False), (60.0, True)] + [(60.0, True)] * 2
    assert video.probe(paths.where("false")).count() == video.sound(paths.where("false")).count() == 0
    assert sorted((r["codec"], r["content"]) for r in video.sound(paths).collect() if r["content"] is not None) == [("", b""), ("", b"")]


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("each", [1, 3, 7, 100, 1000])
def test_sound_to_the_byte(spark, tmp_path, each, wide):
    aac = box("mp4a", bytes(6), b"\0\1", bytes(8), struct.pack(">HHII", 2, 16, 0, 44100 << 16), esds(0x40, bytes([0x12, 0x10])))
    other = box("Opus", bytes(6), b"\0\1", bytes(20))
    make = lambda **kw: movie(1, 4, 4, 0, FRAMES, each, wide, late=bool(each % 2), **kw)
    _write(tmp_path, mp3=make(), aac=make(entry=aac), opus=make(entry=other), silent=movie(1, 4, 4), nothing=movie(1, 4, 4, 0, []))
    got = _rows(video.sound(tables.media_files(spark, str(tmp_path), "*.mp4")))
    raw = b"".join(FRAMES)
    assert {k: (r["codec"], r["content"]) for k, r in got.items()} == {"mp3": ("mp3", raw), "aac": ("aac", b"".join(map(_adts, FRAMES))), "opus": ("Opus", raw), "silent": ("", b""), "nothing": ("mp3", b"")}


def test_long_tracks_come_in_pieces_and_broken_ones_do_not(spark, tmp_path):
    frames = [bytes([k % 256]) * 2000 for k in range(5000)]
    good = movie(1, 4, 4, 0, frames, 5000)
    _write(tmp_path, long=good, cut=good[: len(good) // 2], beyond=movie(1, 4, 4, 0, FRAMES, late=True).replace(struct.pack(">I", 100) + struct.pack(">I", 1), struct.pack(">I", 101) + struct.pack(">I", 1)))
    rows = video.sound(tables.media_files(spark, str(tmp_path), "*.mp4")).collect()
    parts = sorted((r["piece"], r["content"]) for r in rows if r["path"].endswith("long.mp4"))
    assert [len(c) for _, c in parts] == [video.PIECE, video.PIECE, 10_000_000 - 2 * video.PIECE] and b"".join(c for _, c in parts) == b"".join(frames)
    assert [(r["codec"], r["content"]) for r in rows if not r["path"].endswith("long.mp4")] == [(None, None)] * 2


def test_many_small_files_take_few_tasks_and_batches(spark, sf_dir, tmp_path):
    """What tasks wrote isn't listed, where each small file counts as 4 MB of a scan; tracks share a batch."""
    from placeloom.plans import video as plans

    files = plans._files(spark, sf_dir)
    paths = [r["path"] for r in files.collect()]
    assert len(paths) == spark.read.parquet(f"{sf_dir}/part.parquet").count() and files.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(files), "mapInArrow", lambda self, run, schema: seen.append(run) or self)
        video.sound(files)
    batches = list(seen[0]([pa.RecordBatch.from_pydict({"path": paths})]))
    assert len(batches) == 1 and len(paths) == batches[0].num_rows
