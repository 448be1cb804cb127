"""Sorting, paging and lookups."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy_to_null
from ..sources.tables import scratch_folder

#: Of what share of the rows on a page's bucket is stored.
STORED = 16


@dataclass(frozen=True)
class Page:
    """A page request. ``of`` reads request parameters: the limit is capped, the page is 1 at least.

    A limit below 1 or a number that isn't one raises ValueError.
    """

    limit: int = 10
    page: int = 1

    @staticmethod
    def of(limit: str | int | None = None, page: str | int | None = None, default: int = 10, most: int = 100) -> Page:
        size, number = int(default if limit is None else limit), int(1 if page is None else page)
        if size < 1:
            raise ValueError("limit must be 1 or more")
        return Page(min(size, most), max(number, 1))

    @property
    def offset(self) -> int:
        return (self.page - 1) * self.limit


#: Defaults and caps of page sizes.
PLACES_PAGE = {"default": 10, "most": 100}
SAVED_PAGE = {"default": 10, "most": 100}
CATEGORIES_PAGE = {"default": 50, "most": 100}
CITIES_PAGE = {"default": 50, "most": 200}


def sort_keys(by: str, ascending: bool, allowed: dict[str, str], default: str, *keys: str) -> list[Column]:
    """An allowed sort column (else the default), nulls last upwards and first downwards, then the keys, so that pages are whole."""
    column = F.col(allowed.get(by, allowed[default]))
    return [column.asc_nulls_last() if ascending else column.desc_nulls_first(), *[F.col(k).asc_nulls_last() for k in keys]]


def paged(df: DataFrame, order: list[Column], page: Page) -> DataFrame:
    """One page, by a top-k of offset and limit rather than a full sort."""
    return df.orderBy(*order).offset(page.offset).limit(page.limit)


def _levels(c: str, kind: str) -> list[Column]:
    """Numbers that never fall as a column rises, each to tell apart what the one before holds equal; nulls stay null."""
    if kind == "string":
        code = lambda k: F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), k, 6)), 12, "0"), 16, 10).cast("double")
        return [code(1), code(7), code(13)]
    if kind in ("date", "timestamp"):
        return [F.unix_micros(F.col(c).cast("timestamp")).cast("double")]
    if kind == "boolean":
        return [F.col(c).cast("int").cast("double")]
    return [F.col(c).cast("double")]


def deep_page(df: DataFrame, order: list[tuple[str, bool]], page: Page, most: int = 100_000, buckets: int = 1024) -> DataFrame:
    """One page however deep, without sorting what lies before it.

    ``order`` is columns with whether they rise; nulls come last upwards and first downwards, as in ``sort_keys``. A histogram of
    the first column tells in which of ``buckets`` the page lies; those are divided anew, by the next column where the
    first tells no more apart, until they hold ``most`` rows or can't be divided. Only their rows are sorted. Each turn is one
    aggregation that brings ``buckets`` counts with the bounds that later turns need, so what is equal throughout takes no
    turn. What is left is stored once it is a sixteenth (``STORED``), and later turns read only that. A NaN counts as the
    greatest number. A page beyond the end is empty.
    """
    kinds = dict(df.dtypes)
    keys = [c.asc_nulls_last() if up else c.desc_nulls_first() for c, up in ((F.col(name), up) for name, up in order)]
    # a quarter, so that differences don't overflow; what is beyond is told apart by the sort
    within = lambda level: F.when(level.isNotNull(), F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.when(F.isnan(level), F.lit(1.7e308)).otherwise(level))) / 4)
    levels = [(name, within(level), up) for name, up in order for level in _levels(name, kinds[name])]
    names = list(dict.fromkeys(name for name, _ in order))
    # projected, so that a level is computed once a row; of strings the lengths, as strings themselves would have to be sorted
    seen = [*[level.alias(f"level{k}") for k, (_, level, _) in enumerate(levels)], *[(F.octet_length(c) if kinds[c] == "string" else F.col(c)).alias(f"whole_{c}") for c in names]]
    told = [F.count("*").alias("n"), *[f(f"level{k}").alias(f"{f.__name__}{k}") for k in range(len(levels)) for f in (F.min, F.max)]]
    told += [x for c in names for x in (F.min(f"whole_{c}").alias(f"min_{c}"), F.max(f"whole_{c}").alias(f"max_{c}"), F.count(f"whole_{c}").alias(f"count_{c}"))]
    base = rows = df
    kept: dict[int, Column] = {}
    skipped, held_before, at = 0, None, 0
    found = [rows.select(*seen).agg(*told).first()]
    total = held = found[0]["n"]
    stored = len({c.lower() for c in df.columns}) < len(df.columns)  # names that clash can't be
    if total <= page.offset:
        return df.limit(0)
    while at < len(levels):
        name, level, up = levels[at]
        low = min((r[f"min{at}"] for r in found if r[f"min{at}"] is not None), default=None)
        high = max((r[f"max{at}"] for r in found if r[f"max{at}"] is not None), default=None)
        if low is None or low == high and all(r[f"count_{name}"] == r["n"] for r in found):  # equal so far
            if held <= most:
                break
            if (at + 1 == len(levels) or levels[at + 1][0] != name) and not _equal(rows, name, kinds[name], {x for r in found for x in (r[f"min_{name}"], r[f"max_{name}"]) if x is not None}):
                break  # but not the values themselves
            at, held_before = at + 1, held
            continue
        width = max((high - low) / buckets, 5e-324)
        place = F.least(F.lit(buckets - 1), F.floor((level - F.lit(low)) / F.lit(width))).cast("int") if high > low else F.lit(0)
        part = F.when(level.isNotNull(), place)
        part = F.coalesce(part if up else F.lit(buckets - 1) - part, F.lit(buckets if up else -1))
        counts = sorted(rows.select(part.alias("part"), *seen).groupBy("part").agg(*told).collect(), key=lambda r: r["part"])
        upto, found, before = skipped, [], skipped
        for r in counts:
            if not found and upto + r["n"] > page.offset:
                before = upto
            upto += r["n"]
            if upto > page.offset:
                found.append(r)
            if upto >= page.offset + page.limit:
                break
        skipped, held = before, upto - before
        # of a level the last turn's bounds hold, so conditions don't pile up
        low, high = (f((r[f"{f.__name__}{at}"] for r in found if r[f"{f.__name__}{at}"] is not None), default=None) for f in (min, max))
        null = found[0 if not up else -1]["part"] == (buckets if up else -1)
        between = level.isNull() if low is None else (level >= F.lit(low)) & (level <= F.lit(high))
        kept[at] = F.coalesce(between, F.lit(True)) if null else between
        rows = base.where(reduce(and_, kept.values()))
        if held <= most or len(counts) > 1 and held == held_before:
            break
        if not stored and held * STORED <= total:
            folder, stored = scratch_folder(df.sparkSession, "page"), True
            rows.write.parquet(folder)
            base = rows = df.sparkSession.read.schema(df.schema).parquet(folder)
            kept = {}
        held_before = held
    return rows.orderBy(*keys).offset(page.offset - skipped).limit(page.limit)


def _equal(rows: DataFrame, name: str, kind: str, bounds: set) -> bool:
    """Whether a column whose levels are equal has one value beside null. ``bounds`` are its least and most, of strings those of the lengths."""
    if kind != "string":
        return len({repr(x) if x != 0 else "0" for x in bounds}) <= 1
    if len(bounds) <= 1 and max(bounds, default=0) <= 18:  # the levels hold all of it
        return True
    return rows.agg(F.min(name).eqNullSafe(F.max(name))).first()[0]


def with_total(df: DataFrame, name: str = "total_items") -> DataFrame:
    """The filtered rows with their number. The count is an aggregate of its own, so the rows are read twice."""
    return df.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))  # one row


def envelope(df: DataFrame, page: Page) -> DataFrame:
    """One row: ``page, limit, total_items, total_pages, has_next, has_prev``."""
    counted = df.agg(F.count("*").alias("total_items"))
    pages = F.ceil(F.col("total_items") / page.limit).cast("long")
    return counted.select(
        F.lit(page.page).cast("long").alias("page"), F.lit(page.limit).cast("long").alias("limit"), "total_items", pages.alias("total_pages"),
        (F.lit(page.page) < pages).alias("has_next"), F.lit(page.page > 1).alias("has_prev"),
    )


def lookup(df: DataFrame, key: str, value: object, exactly: bool = False):
    """The one row with the key, or None; more than one (or, if ``exactly``, none) raises LookupError."""
    rows = df.where(F.col(key) == F.lit(value)).limit(2).collect()
    if len(rows) > 1 or exactly and not rows:
        raise LookupError(f"{len(rows)} rows with {key} = {value!r}")
    return rows[0] if rows else None


def with_creator(df: DataFrame, profiles: DataFrame, user: str, profile_key: str, display: str, name: str = "created_by") -> DataFrame:
    """``created_by``: the display name of the row's user, 'Anonymous' if the user or a name that isn't empty is missing.

    ``profiles`` has one row per key; Catalyst broadcasts it only if its size allows.
    """
    who = profiles.select(F.col(profile_key).alias("__profile__"), falsy_to_null(display).alias("__name__"))
    joined = df.join(who, F.col(user) == F.col("__profile__"), "left")
    return joined.withColumn(name, F.coalesce("__name__", F.lit("Anonymous"))).drop("__profile__", "__name__")
