"""Full-text search: English stems, positional postings by term, boolean and phrase queries with a rank.

Tokens are runs of letters and digits in lower case. Stop words keep their place but aren't indexed;
words of the letters a to z are stemmed by Porter's steps, with y a vowel but at the beginning. The
postings of a term lie in one bucket, sorted, so a search reads the row groups of its terms only.
Texts are split and queries evaluated by column expressions; the words of a document are stemmed and
gathered in numpy, where a worker stems a word once. A document's postings are made and stored where
it is read; only those of an id that several rows have are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOP_WORDS

_STOPS = frozenset(STOP_WORDS)
#: Words that are gathered at once; ids that may be broadcast.
BLOCK, BROADCAST_ROWS = 1 << 18, 50_000
#: What separates tokens.
BREAK = r"[^\p{L}\p{N}]+"
#: A stem that has a vowel and then a consonant once, and twice.
_ONCE = r"^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+?.*?)"
_TWICE = r"^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]+?.*?)"
#: The same, up to the last of its consonants.
_TO_LAST = r"^(y?[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+.*"
#: Porter's suffixes of the second, third and fourth step, with what they become.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


@dataclass(frozen=True)
class Step:
    """If ``pattern`` is found (and ``unless`` is not), the word becomes its first group and ``put`` (or what its second group stands for)."""

    pattern: str
    put: str | dict[str, str] = ""
    unless: str | None = None


#: Steps in order; of a list of steps the first that fits counts.
STEPS: list[list[Step]] = [
    [Step(r"^(.*ss)es$"), Step(r"^(.*i)es$"), Step(r"^(.*[^s])s$")],
    [Step(_ONCE + "eed$", "ee"), Step(r"^(.*[aeiouy].*)(?:ed|ing)$", "+", ".eed$")],  # + marks what the next step mends
    [Step(r"^(.*(?:at|bl|iz))\+$", "e"), Step(r"^(.*(?:b|d|f|g|m|n|p|r|t))(?:b|d|f|g|m|n|p|r|t)\+$", "", r"(?:b[^b]|d[^d]|f[^f]|g[^g]|m[^m]|n[^n]|p[^p]|r[^r]|t[^t])\+$"), Step(r"^(y?[^aeiouy]*[aeiouy][^aeiouywx])\+$", "e"), Step(r"^(.*)\+$")],
    [Step(r"^(.*[aeiouy].*)y$", "i")],
    [Step(_ONCE + f"({'|'.join(SECOND)})$", SECOND)],
    [Step(_ONCE + f"({'|'.join(THIRD)})$", THIRD)],
    [Step(_TWICE + f"(?:{'|'.join(FOURTH)})$"), Step(_TO_LAST + r"[st])ion$")],
    [Step(_TWICE + "e$"), Step(_ONCE + "e$", "", r"^y?[^aeiouy]*[aeiouy][^aeiouywx]e$")],
    [Step(_TO_LAST + "l)l$")],
]


def _stepped(now: Column, step: list[Step]) -> Column:
    found = None
    for s in step:
        put: Column = F.lit(s.put) if isinstance(s.put, str) else F.element_at(F.create_map(*[F.lit(x) for kv in s.put.items() for x in kv]), F.regexp_extract(now, s.pattern, 2))
        fits = now.rlike(s.pattern) & ~now.rlike(s.unless) if s.unless else now.rlike(s.pattern)
        becomes = F.concat(F.regexp_extract(now, s.pattern, 1), put)
        found = F.when(fits, becomes) if found is None else found.when(fits, becomes)
    return now if found is None else found.otherwise(now)


def _step_of(step: list[Step]) -> Callable[[Column], Column]:
    return lambda now: _stepped(now, step)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; other than of letters a to z, or of fewer than three, it stays."""
    out = F.array(word)  # a step refers to its word more than once, so each is bound by a lambda
    for step in STEPS:
        out = F.transform(out, _step_of(step))
    return F.when(word.rlike("^[a-z]{3,}$"), F.get(out, F.lit(0))).otherwise(word)


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    """The stem by the same steps, for words inside tasks."""
    if not re.search("^[a-z]{3,}$", word):
        return word
    for step in STEPS:
        for s in step:
            found = re.search(s.pattern, word)
            if found and not (s.unless and re.search(s.unless, word)):
                word = found.group(1) + (s.put if isinstance(s.put, str) else s.put[found.group(2)])
                break
    return word


def tokens(text: Column) -> Column:
    """Tokens in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), lambda t: t != "")


def _gathered(docs: pa.Array, words: pa.ListArray) -> pa.RecordBatch:
    """``term, doc, positions`` of each document's words."""
    lengths = np.diff(np.asarray(words.offsets))
    spread = words.flatten().dictionary_encode()
    unique = spread.dictionary.to_pylist()
    terms = {t: k for k, t in enumerate(dict.fromkeys(stem_word(w) for w in unique if w not in _STOPS))}
    number = np.array([-1 if w in _STOPS else terms[stem_word(w)] for w in unique], dtype=np.int64)[spread.indices.to_numpy()]
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    key, at = (row * max(len(terms), 1) + number)[number >= 0], at[number >= 0]
    order = np.argsort(key, kind="stable")  # a word's places stay in order
    key = key[order]
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    of, term = np.divmod(key[begins], max(len(terms), 1))
    places = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(key)].astype(np.int32)), pa.array(at[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()).take(pa.array(term)), docs.take(pa.array(of)), places], ["term", "doc", "positions"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of some documents, a long one alone, so that what is held follows the longest text."""
    for batch in batches:
        upto = np.asarray(batch.column(1).offsets)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + BLOCK, "right")) - 1)
            part = batch.slice(begin, end - begin)
            yield _gathered(part.column(0), pa.ListArray.from_arrays(pa.array(upto[begin : end + 1] - upto[begin]), batch.column(1).values.slice(upto[begin], upto[end] - upto[begin])))
            begin = end


def spread(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``term, doc, positions`` of each row, without a shuffle; rows of one id aren't one document yet."""
    rows = docs.select(F.col(id_col).alias("doc"), tokens(F.col(text)).alias("words"))
    kind = T.StructType([T.StructField("term", T.StringType()), rows.schema["doc"], T.StructField("positions", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_told, kind)


def _merged(found: DataFrame, *keys: str) -> DataFrame:
    return found.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))


def postings(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """``term, doc, positions`` (sorted, from 0). Null and empty texts have none, rows of one id count as one document, a null id is one.

    Ids are counted first: postings of an id on one row are whole as they are and aren't shuffled, those of the others are merged.
    """
    again = docs.groupBy(F.col(id_col).alias("__again__")).agg(F.count("*").alias("__rows__")).where(F.col("__rows__") > 1).select("__again__")
    n = again.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return spread(docs, id_col, text)
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    same = F.col(id_col).eqNullSafe(F.col("__again__"))
    whole, parts = docs.join(again, same, "left_anti"), docs.join(again, same, "left_semi")
    return spread(whole, id_col, text).unionByName(_merged(spread(parts, id_col, text), "term", "doc"))


def write_postings(found: DataFrame, path: str, buckets: int = 64, salts: int | None = None) -> None:
    """What ``spread`` gave by bucket of the term's hash, sorted by term; ``search`` merges rows of one id.

    Each task writes its own rows, a file a bucket. With ``salts`` a bucket is dealt to so many tasks by document, which shuffles
    all postings but leaves fewer files.
    """
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    if salts:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts))).repartition("bucket", "salt").drop("salt")
    rows.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)


def _lists(texts: Sequence[str]) -> list[str]:
    """The words of query texts in order, without stop words."""
    return [w for t in texts for w in re.split(r"[\W_]+", t.lower()) if w and w not in STOP_WORDS]


def _moved(by: int) -> Callable[[Column], Column]:
    return lambda at: at - F.lit(by)


@dataclass(frozen=True)
class Query:
    """Texts whose words must all, in part (one at least) or not at all be in a document, and phrases that must."""

    all_of: Sequence[str] = ()
    any_of: Sequence[str] = ()
    none_of: Sequence[str] = ()
    phrases: Sequence[str] = ()


def search(spark: SparkSession, path: str, asked: Query, documents: int, buckets: int = 64) -> DataFrame:
    """``doc, rank`` of the documents that a query matches.

    The rank sums over the words that should be there ln(1 + documents / documents with it) * f / (f + 1), f times met.
    A query needs a word, a part or a phrase that must be there, else ValueError; query words that are stop words count as met.
    """
    must, some, none = (list(dict.fromkeys(_lists(x))) for x in (asked.all_of, asked.any_of, asked.none_of))
    phrases = [[(k, w) for k, w in enumerate(x for x in re.split(r"[\W_]+", p.lower()) if x) if w not in STOP_WORDS] for p in asked.phrases]
    phrases = [p for p in phrases if p]
    good = list(dict.fromkeys([*must, *some, *(w for p in phrases for _, w in p)]))
    if not good:
        raise ValueError("nothing to look for")
    every = list(dict.fromkeys([*good, *none]))
    place = {w: f"p{k}" for k, w in enumerate(every)}
    found = spark.range(1).select(*[x for w in every for x in (stem(F.lit(w)), F.pmod(F.xxhash64(stem(F.lit(w))), F.lit(buckets)).cast("int"))]).first()
    of = dict(zip(every, found[::2]))  # constants, which are pushed down to the scan
    hit = F.col("bucket").isin(sorted(set(found[1::2]))) & F.col("term").isin(sorted(set(of.values())))
    rows = spark.read.parquet(path)
    lists = rows.where(hit).groupBy("doc").agg(*[F.collect_list(F.when(F.col("term") == of[w], F.col("positions"))).alias(place[w]) for w in every])
    held = lists.select("doc", *[F.when(F.size(place[w]) > 0, F.array_sort(F.array_distinct(F.flatten(place[w])))).alias(place[w]) for w in every])
    there = lambda w: F.col(place[w]).isNotNull()
    keep = F.lit(True)
    for w in must:
        keep = keep & there(w)
    if some:
        keep = keep & F.coalesce(*[F.when(there(w), True) for w in some], F.lit(False))
    for w in none:
        keep = keep & ~there(w)
    for p in phrases:
        (first, head), rest = p[0], p[1:]
        # where the phrase may begin: places of its words, moved back by their distance, that all words share
        begins = F.col(place[head])
        for k, w in rest:
            begins = F.array_intersect(begins, F.transform(place[w], _moved(k - first)))
        keep = keep & F.coalesce(F.size(begins) > 0, F.lit(False))
    frequency = held.agg(*[F.count(place[w]).alias(f"n{place[w]}") for w in good])  # one row
    size = {w: F.size(place[w]).cast("double") for w in good}
    rank = sum((F.when(there(w), F.log1p(F.lit(float(documents)) / F.col(f"n{place[w]}")) * size[w] / (size[w] + 1)).otherwise(0.0) for w in good), F.lit(0.0))
    return held.crossJoin(F.broadcast(frequency)).where(keep).select("doc", rank.alias("rank"))
