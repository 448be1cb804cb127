"""Column functions on numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _col


def round_half_up(c: ColumnOrName, default: int | None = None) -> Column:
    """The nearest whole number, halves upwards (also of negative ones)."""
    out = F.floor(_col(c).cast("double") + 0.5).cast("long")
    return out if default is None else F.coalesce(out, F.lit(default).cast("long"))


def engagement_rate(likes: ColumnOrName, comments: ColumnOrName, views: ColumnOrName) -> Column:
    """(likes + comments) / views in percent to four digits; null if one is unknown or there are no views. Beyond 9999.9999 it raises, as the stored type does."""
    rate = (_col(likes) + _col(comments)) / _col(views) * 100
    return F.when(_col(likes).isNotNull() & _col(comments).isNotNull() & (_col(views) > 0), F.round(rate, 4).cast("decimal(8,4)"))


def clamp(c: ColumnOrName, low: int, high: int) -> Column:
    return F.least(F.greatest(_col(c), F.lit(low)), F.lit(high))


def published_at(iso: ColumnOrName, epoch: ColumnOrName) -> Column:
    """The ISO time if given, else that of the epoch seconds; 0 is unknown."""
    return F.coalesce(F.try_to_timestamp(_col(iso)), F.timestamp_seconds(F.when(_col(epoch) != 0, _col(epoch))))


def total_pages(total: ColumnOrName, limit: int) -> Column:
    return F.ceil(_col(total) / limit).cast("long")


def confidence_share(c: ColumnOrName) -> Column:
    """A confidence in percent as a share."""
    return _col(c) / 100.0


def percent_text(c: ColumnOrName) -> Column:
    return F.concat(round_half_up(_col(c) * 100).cast("string"), F.lit("%"))


def number_text(c: ColumnOrName) -> Column:
    """With thousands separators."""
    return F.format_number(_col(c), 0)
