"""Column functions on media: kinds, limits and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _col

#: Audio that may be uploaded.
AUDIO_TYPES = [
    "audio/mpeg",
    "audio/mp3",
    "audio/wav",
    "audio/wave",
    "audio/x-wav",
    "audio/x-pn-wav",
    "audio/m4a",
    "audio/x-m4a",
    "audio/ogg",
    "audio/webm",
    "audio/aac",
    "audio/x-aac",
]
AUDIO_NAME = r"(?i)\.(mp3|wav|m4a|ogg|webm|aac)$"
MOST_UPLOAD_BYTES = 50 * 1024 * 1024


def may_upload(mime: ColumnOrName, name: ColumnOrName, size: ColumnOrName) -> Column:
    """Whether a file is audio by type or name, and not too large."""
    return F.coalesce((_col(mime).isin(AUDIO_TYPES) | _col(name).rlike(AUDIO_NAME)) & (_col(size) <= MOST_UPLOAD_BYTES), F.lit(False))


def media_kind(video_url: ColumnOrName, content_type: ColumnOrName, images: ColumnOrName) -> Column:
    """``video`` (a reel or video with a file; an unknown type counts as reel), ``carousel`` (a sidecar, or several images) or ``image``."""
    kind = F.coalesce(F.when(_col(content_type) != "", _col(content_type)), F.lit("reel"))
    video = F.coalesce(_col(video_url) != "", F.lit(False)) & kind.isin("video", "reel")
    carousel = (kind == "sidecar") | F.coalesce(F.size(_col(images)) > 1, F.lit(False))
    return F.when(video, "video").when(carousel, "carousel").otherwise("image")


def orientation(width: ColumnOrName, height: ColumnOrName) -> Column:
    return F.when(_col(height) > _col(width), "vertical").when(_col(width).isNotNull() & _col(height).isNotNull(), "horizontal")


def known_duration(c: ColumnOrName, default: float = 60.0) -> Column:
    """A probed duration, or the default where the probe failed."""
    return F.coalesce(_col(c), F.lit(default))


def frame_budget(duration: ColumnOrName, missing: int = 15) -> Column:
    """Frames for a video: 3 up to 15 s, 5 up to 30 s, else 6; an unknown duration (null or 0) counts as 15 s."""
    d = F.coalesce(F.when(_col(duration) != 0, _col(duration)), F.lit(missing))
    return F.when(d <= 15, 3).when(d <= 30, 5).otherwise(6)


def frame_number(path: ColumnOrName) -> Column:
    """The number in a frame's file name."""
    return F.regexp_extract(_col(path), r"frame_(\d+)\.jpg$", 1).try_cast("int")


def frame_time(number: ColumnOrName, duration: ColumnOrName, interval: float = 1.0) -> Column:
    """Seconds of the nth frame (from 1), at most the duration."""
    return F.least((_col(number) - 1) * interval, _col(duration))


def sample_times(duration: ColumnOrName, most: int = 30) -> Column:
    """Evenly spaced seconds of up to ``most`` frames, all below the duration."""
    d = _col(duration)
    n = F.least(F.lit(most), F.floor(d + 0.5)).cast("int")
    times = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * d / n)
    return F.when(n > 0, F.filter(times, lambda t: t < d)).otherwise(F.array().cast("array<double>"))
