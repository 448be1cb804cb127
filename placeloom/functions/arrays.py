"""Column functions on arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _col, trim_space


def truthy(c: ColumnOrName) -> Column:
    """Without null and empty strings."""
    return F.filter(_col(c), lambda x: x.isNotNull() & (x != ""))


def clean_array(c: ColumnOrName) -> Column:
    """Trimmed strings that aren't empty; no array is an empty one."""
    out = F.filter(F.transform(_col(c), lambda x: trim_space(x.cast("string"))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(out, F.array().cast("array<string>"))


def first_seen(*cs: ColumnOrName) -> Column:
    """Arrays one after the other, each value where it came first, without null and ''."""
    empty = F.array().cast("array<string>")
    return truthy(F.array_distinct(F.concat(*[F.coalesce(_col(c), empty) for c in cs])))


def combined_text(*cs: ColumnOrName) -> Column:
    """The texts of arrays, each once, joined by a blank; null if there are none."""
    joined = F.array_join(first_seen(*cs), " ")
    return F.when(joined != "", joined)


def empty_to_null(c: ColumnOrName) -> Column:
    return F.when(F.size(_col(c)) > 0, _col(c))


def first_or_null(c: ColumnOrName) -> Column:
    return F.get(_col(c), F.lit(0))


def find_by_prefix(c: ColumnOrName, field: str, prefixes: list[str], value: str) -> Column:
    """``value`` of the first struct whose ``field`` begins with one of the prefixes."""
    hit = F.filter(_col(c), lambda x: F.coalesce(_any([F.startswith(x[field], F.lit(p)) for p in prefixes]), F.lit(False)))
    return F.get(hit, F.lit(0))[value]


def find_by_member(c: ColumnOrName, field: str, members: list[str], value: str) -> Column:
    """``value`` of the first struct whose array ``field`` has one of the members."""
    hit = F.filter(_col(c), lambda x: F.coalesce(F.arrays_overlap(x[field], F.array(*[F.lit(m) for m in members])), F.lit(False)))
    return F.get(hit, F.lit(0))[value]


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def to_map(keys: ColumnOrName, values: ColumnOrName) -> Column:
    """An aggregate: a map from a group's keys to their values. For bounded groups; else join."""
    return F.map_from_entries(F.collect_list(F.struct(_col(keys), _col(values))))


def known_and_unknown(columns: dict[str, ColumnOrName]) -> tuple[Column, Column]:
    """Names of the columns that aren't null, and of those that are."""
    named = F.array(*[F.struct(F.lit(k).alias("k"), _col(c).isNotNull().alias("known")) for k, c in columns.items()])
    pick = lambda want: F.transform(F.filter(named, lambda x: x["known"] if want else ~x["known"]), lambda x: x["k"])
    return pick(True), pick(False)


def json_or_wrapped(c: ColumnOrName, key: str = "error_message") -> Column:
    """Text that is JSON as it is, other text in an object under ``key``."""
    c = _col(c)
    return F.when(F.try_parse_json(c).isNotNull(), c).otherwise(F.to_json(F.struct(c.alias(key))))


def json_text(c: ColumnOrName, path: str, default: str | None = None) -> Column:
    """A JSON field as text."""
    out = F.get_json_object(_col(c), path)
    return out if default is None else F.coalesce(out, F.lit(default))
