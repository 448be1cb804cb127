"""Containment in JSON documents: which documents hold a pattern, by postings of hashed paths and values.

An object holds an object whose keys it has, with values that it holds; an array holds an array of
whose elements each is held by one of its own, in any order; other values hold what equals them, and
an array at the top also a value that is one of its elements. Numbers are equal by value (1 and 1.0),
of repeated keys the last counts.

A document has an entry for each value and each object or array in it: the hash of the keys that
lead there (places in arrays aside) and of the value or kind. A document that holds a pattern has all
its entries, so the rarest one gives the candidates, which are then compared in full.

Null, text that isn't JSON and what is nested deeper than 400 levels (``DEPTH``) hold nothing and are
held by nothing. Rows of one id count as one document that holds what any of them does; a null id is
an id. Empty tables have no matches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels of nesting, bytes of JSON that are told at once.
DEPTH, BLOCK = 400, 1 << 21
#: Rows that are taken out of Arrow at once; how many keys and values a worker remembers, and how long these may be.
ROWS, KEPT, SHORT = 64, 1 << 16, 64
_NOTHING = object()


def _whole(text: str) -> tuple[int, str, int]:
    """A number by value: sign, digits without zeros at the ends, exponent."""
    digits = text.removeprefix("-")
    kept = digits.rstrip("0")
    return (len(text) - len(digits), kept, len(digits) - len(kept)) if kept else (0, "", 0)


def _number(text: str) -> tuple[int, str, int]:
    """The same of a number with a fraction or an exponent."""
    sign, digits, exponent = Decimal(text).as_tuple()
    all_digits = "".join(map(str, digits)).lstrip("0")
    kept = all_digits.rstrip("0")
    return (sign, kept, int(exponent) + len(all_digits) - len(kept)) if kept else (0, "", 0)


def _refused(text: str) -> Any:
    raise ValueError(text)


_DECODER = json.JSONDecoder(parse_int=_whole, parse_float=_number, parse_constant=_refused)


def parsed(text: str | None) -> Any:
    """Values with numbers as tuples, or ``_NOTHING``."""
    if text is None:
        return _NOTHING
    try:
        value = _DECODER.decode(text)
    except (ValueError, InvalidOperation, RecursionError):
        return _NOTHING
    if text.count("{") + text.count("[") <= DEPTH:  # too few to be nested deeper
        return value
    level, depth = [value], 0
    while level:
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
        if depth > DEPTH + 1:
            return _NOTHING
    return value


def _is_plain(value: Any) -> bool:
    return not isinstance(value, (dict, list))


def holds(held: Any, asked: Any, top: bool = True) -> bool:
    """Whether a parsed document holds a parsed pattern."""
    if isinstance(asked, dict):
        return isinstance(held, dict) and all(k in held and holds(held[k], v, False) for k, v in asked.items())
    if isinstance(asked, list):
        if not isinstance(held, list):
            return False
        plain = {(type(h), h) for h in held if _is_plain(h)}
        nested = [h for h in held if not _is_plain(h)]
        return all((type(a), a) in plain if _is_plain(a) else any(holds(h, a, False) for h in nested) for a in asked)
    if top and isinstance(held, list):
        return any(_is_plain(h) and type(h) is type(asked) and h == asked for h in held)
    return type(held) is type(asked) and held == asked


class _Place:
    """Where keys lead: its hash, the places below it and the entries there, of which a worker remembers some."""

    __slots__ = ("path", "below", "plain", "object", "array")
    kept = 0
    top: _Place

    def __init__(self, path: int) -> None:
        self.path, self.below, self.plain = path, {}, {}
        self.object, self.array = self._hashed(b"o"), self._hashed(b"a")

    def _hashed(self, what: bytes) -> int:
        found = xxhash.xxh64_intdigest(what, self.path)
        return found - (1 << 64) if found >> 63 else found

    def at(self, key: str) -> _Place:
        """The place below that a key leads to."""
        made = _Place(xxhash.xxh64_intdigest(b"k" + key.encode("utf-8", "surrogatepass"), self.path))
        if len(key) <= SHORT:
            self.below[key] = made
            _Place.kept += 1
        return made

    def entry(self, v: Any) -> int:
        """The entry of a plain value."""
        found = self._hashed(b"s" + v.encode("utf-8", "surrogatepass") if isinstance(v, str) else repr(v).encode())
        if not isinstance(v, (str, tuple)) or len(v if isinstance(v, str) else v[1]) <= SHORT:
            self.plain[v] = found
            _Place.kept += 1
        return found


_Place.top = _Place(0)


def entries(value: Any) -> set[int]:
    """Hashes of a parsed value's paths with what lies there, as signed 64-bit integers."""
    if _Place.kept > KEPT:
        _Place.top, _Place.kept = _Place(0), 0
    out: set[int] = set()
    places, left = ([_Place.top], [value]) if value is not _NOTHING else ([], [])
    while left:
        place, v = places.pop(), left.pop()
        kind = type(v)
        if kind is dict:
            out.add(place.object)
            places += [place.below.get(k) or place.at(k) for k in v]
            left += v.values()
        elif kind is list:
            out.add(place.array)
            places += [place] * len(v)
            left += v
        else:
            out.add(place.plain.get(v) or place.entry(v))
    return out


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The values of a column, some at a time."""
    for begin in range(0, len(column), ROWS):
        yield from column.slice(begin, ROWS).to_pylist()


def _told(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers with an entry each, some documents at a time."""
    begin, counts, found, size = 0, [], [], 0
    for k, doc in enumerate(_texts(texts)):
        of = entries(parsed(doc))
        counts.append(len(of))
        found.extend(of)
        size += len(doc or "")
        if size > BLOCK or k == len(texts) - 1:
            yield np.repeat(np.arange(begin, k + 1), counts), np.array(found, np.int64)
            begin, counts, found, size = k + 1, [], [], 0


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns ``pattern, asked`` as rows with an entry each."""
    for batch in batches:
        for rows, found in _told(batch.column(1)):
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(found)], names=["pattern", "asked", "entry"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents ``doc, text`` as entries with the documents of a block that have them, so what all have is a row a block."""
    for batch in batches:
        for rows, found in _told(batch.column(1)):
            order = np.argsort(found, kind="stable")
            found = found[order]
            begins = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, np.int64)
            held = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(found)].astype(np.int32)), batch.column(0).take(pa.array(rows[order])))
            yield pa.RecordBatch.from_arrays([pa.array(found[begins]), held], names=["entry", "held"])


def _postings(spark: SparkSession, path: str, docs: DataFrame, id_col: str) -> DataFrame:
    kind = T.StructType([T.StructField("entry", T.LongType()), T.StructField("held", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(kind).parquet(f"{path}/postings")


def _frequencies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("entry long, docs long, bucket int").parquet(f"{path}/frequencies")


def write_index(docs: DataFrame, id_col: str, json_col: str, path: str, buckets: int = 64, salts: int = 8) -> None:
    """Postings ``entry, doc`` by bucket of the entry, sorted, under ``path``, and how many rows have an entry.

    A row of the postings has the documents of one block. A bucket is dealt to ``salts`` tasks by block, so an entry that all
    documents have isn't one task's. Rows of one id repeat an entry, which readers allow for.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(json_col).cast("string").alias("text"))
    kind = T.StructType([T.StructField("entry", T.LongType()), T.StructField("held", T.ArrayType(rows.schema["doc"].dataType))])
    deal = [F.pmod(F.col("entry"), F.lit(buckets)).cast("int").alias("bucket"), F.pmod(F.xxhash64(F.get("held", F.lit(0))), F.lit(salts)).alias("salt")]
    dealt = rows.mapInArrow(_gathered, kind).select("entry", "held", *deal).repartition("bucket", "salt").drop("salt")
    dealt.sortWithinPartitions("bucket", "entry").write.partitionBy("bucket").parquet(f"{path}/postings")
    counted = _postings(docs.sparkSession, path, docs, id_col).groupBy("bucket", "entry").agg(F.sum(F.size("held")).alias("docs"))
    counted.repartition("bucket").sortWithinPartitions("entry").write.partitionBy("bucket").parquet(f"{path}/frequencies")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of ``pattern, asked, doc, text`` that hold; a document or pattern that follows itself is parsed once."""
    seen: dict[str, tuple[str, Any]] = {"asked": ("", _NOTHING), "text": ("", _NOTHING)}

    def value(side: str, text: str) -> Any:
        if seen[side][0] != text:
            seen[side] = (text, parsed(text))
        return seen[side][1]

    for batch in batches:
        good = [_holds(value("text", t), value("asked", a)) for a, t in zip(_texts(batch.column("asked")), _texts(batch.column("text")))]
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("pattern"), kept.column("doc")], names=["pattern", "doc"])


def _holds(held: Any, asked: Any) -> bool:
    return held is not _NOTHING and asked is not _NOTHING and holds(held, asked)


def _pairs(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates ``pattern, asked, doc`` that hold, with the texts of ``docs`` (``__id__, text``)."""
    joined = candidates.join(docs, F.col("doc").eqNullSafe(F.col("__id__"))).where("text IS NOT NULL").select("pattern", "asked", "doc", "text")
    return joined.mapInArrow(_verified, T.StructType([joined.schema["pattern"], joined.schema["doc"]])).distinct()


def holding(spark: SparkSession, path: str, docs: DataFrame, id_col: str, json_col: str, pattern: str, buckets: int = 64) -> DataFrame:
    """``doc`` of the documents that hold a pattern, which reads the row groups of its entries only. A pattern that isn't JSON raises ValueError."""
    found = sorted(entries(parsed(pattern)))
    if not found:
        raise ValueError("the pattern is no JSON")
    hit = F.col("bucket").isin(sorted({e % buckets for e in found})) & F.col("entry").isin(found)
    counts = {r["entry"]: r["docs"] for r in _frequencies(spark, path).where(hit).collect()}  # at most as many rows as the pattern has entries
    least = sorted(found, key=lambda e: (counts.get(e, 0), e))[:3]  # the rarest three leave few candidates; the rest is compared in full
    hit = F.col("bucket").isin(sorted({e % buckets for e in least})) & F.col("entry").isin(least)
    has = [F.bool_or(F.col("entry") == e).alias(f"has{k}") for k, e in enumerate(least)]
    met = _postings(spark, path, docs, id_col).where(hit).select("entry", F.explode("held").alias("doc")).groupBy("doc").agg(*has).where(" AND ".join(f"has{k}" for k in range(len(least))))
    texts = docs.select(F.col(id_col).alias("__id__"), F.col(json_col).cast("string").alias("text"))
    return _pairs(met.select(F.lit(0).alias("pattern"), F.lit(pattern).alias("asked"), "doc"), texts).select("doc")


def matches(spark: SparkSession, path: str, docs: DataFrame, id_col: str, json_col: str, patterns: DataFrame, pattern_id: str, pattern_json: str, buckets: int = 64) -> DataFrame:
    """``pattern, doc``: every document with every pattern of a table that it holds.

    A pattern meets the documents that have its rarest entry; one with an entry that no document has meets none.
    """
    asked = patterns.select(F.col(pattern_id).alias("pattern"), F.col(pattern_json).cast("string").alias("asked")).distinct()
    kind = T.StructType([*asked.schema.fields, T.StructField("entry", T.LongType())])
    wanted = asked.mapInArrow(_spread, kind).withColumn("bucket", F.pmod(F.col("entry"), F.lit(buckets)).cast("int"))
    known = wanted.join(_frequencies(spark, path), ["bucket", "entry"], "left")
    rarest = known.groupBy("pattern", "asked").agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "bucket", "entry")).alias("least")).where("least.docs > 0")
    chosen = rarest.select("pattern", "asked", "least.bucket", "least.entry")
    candidates = chosen.join(_postings(spark, path, docs, id_col), ["bucket", "entry"]).select("pattern", "asked", F.explode("held").alias("doc"))
    return _pairs(candidates, docs.select(F.col(id_col).alias("__id__"), F.col(json_col).cast("string").alias("text")))
