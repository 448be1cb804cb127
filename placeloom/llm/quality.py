"""Quality rules by repetition coverage.

Rolling hashes of n-grams of several lengths, computed with numpy on the UTF-8 bytes of many texts
at once, mark the words that lie inside n-grams met before in the same text. The rules bound the
share of characters that lie inside

* n-grams of 2 to 10 words met before, and words equal to the word before;
* lines met before;
* character trigrams of symbols: of symbols alone, met before in the text (``word### word###``), or
  of symbols and blanks, met ``bar_times`` times in their line (``one | two | three`` without end).
  Tables and code, whose lines hold fewer of these, stay.

A word is a run of anything but ASCII white space; a line counts if it has a word. ``fitted`` chooses
the limits from labelled texts.

Null and empty texts have no word and fail. A very long text is measured whole; memory follows its
length, some 60 bytes a byte. Each repeated row is judged alike. Extra columns are kept by
``keep_good`` and ignored by ``signals``. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import powers, blocks, mix64, span_hashes, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_TURN = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Rules:
    """Most characters (of those in words; for symbols, of all) inside what was met before. Beyond five words the limits are published corpus rules, the others lie between good and bad labelled texts."""

    least_words: int = 10
    window: int = 5
    most_repeat_percent: int = 20
    most_in_ngrams: dict[int, float] = field(default_factory=lambda: {2: 0.45, 3: 0.35, 4: 0.25, 5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    most_in_lines: float = 0.20
    most_in_echoes: float = 0.20
    most_in_symbols: float = 0.10
    bar_times: int = 6

    def shares(self) -> dict[str, tuple[str, float]]:
        """By signal, of what it is a share and the most that it may be."""
        out = {f"dup_{k}gram_chars": ("word_chars", most) for k, most in self.most_in_ngrams.items()}
        return out | {"dup_line_chars": ("word_chars", self.most_in_lines), "echo_chars": ("word_chars", self.most_in_echoes), "symbol_gram_chars": ("text_chars", self.most_in_symbols)}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]] if len(keys) else np.zeros(0, bool)
    twice = np.zeros(len(keys), bool)
    twice[order] = same | np.r_[same[1:], False] if len(keys) else same
    at = np.flatnonzero(twice)
    order = at[np.lexsort((at, keys[at]))]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return twice, later


def _covered(at: np.ndarray, length: int, n: int) -> np.ndarray:
    """Words inside the windows that begin at ``at``."""
    turns = np.bincount(at, minlength=n + 1)[: n + 1] - np.bincount(at + length, minlength=n + 1)[: n + 1]
    return np.cumsum(turns)[:n] > 0


def _symbol_grams(data: np.ndarray, offsets: np.ndarray, heads: np.ndarray, own: np.ndarray, times: int) -> np.ndarray:
    """Bytes inside trigrams of symbols met before in the text, or of symbols and blanks met ``times`` times in their line; ``heads`` begin lines."""
    n = len(data)
    symbol = _SYMBOL[data]
    either = symbol | (data == 0x20) | (data == 0x09)
    at = np.flatnonzero(either[:-2] & either[1:-1] & either[2:] & (symbol[:-2] | symbol[1:-1] | symbol[2:]))
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[doc + 1]
    at, doc = at[inside], doc[inside]
    wide = data.astype(np.uint64)
    gram = wide[at] << np.uint64(16) | wide[at + 1] << np.uint64(8) | wide[at + 2] if len(at) else np.zeros(0, np.uint64)
    line = np.searchsorted(heads, at, "right").astype(np.uint64)
    _, inverse, met = np.unique(line << np.uint64(24) | gram, return_inverse=True, return_counts=True)
    solid = np.flatnonzero(symbol[at] & symbol[at + 1] & symbol[at + 2]) if len(at) else np.zeros(0, np.int64)
    _, later = _repeats(mix64(gram[solid] + own[doc[solid]]))
    return _covered(np.concatenate([at[met[inverse] >= times], at[solid[later]]]), 3, n)


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    """Signals of each text."""
    docs, n_bytes = len(offsets) - 1, len(data)
    space = _SPACE[data]
    begins, stops = np.ones(n_bytes, bool), np.ones(n_bytes, bool)
    begins[1:], stops[:-1] = space[:-1], space[1:]
    filled = offsets[1:] > offsets[:-1]
    begins[offsets[:-1][filled]] = stops[offsets[1:][filled] - 1] = True
    starts, ends = np.flatnonzero(begins & ~space), np.flatnonzero(stops & ~space) + 1
    n = len(starts)
    points = np.zeros(n_bytes + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    chars = points[ends] - points[starts]
    at = np.searchsorted(starts, offsets)  # words before each text
    doc = np.repeat(np.arange(docs), np.diff(at))
    own = mix64(np.arange(1, docs + 1, dtype=np.uint64) * _TURN)  # sets the texts of a block apart
    out = {"n_words": np.diff(at), "word_chars": _sums(chars, at), "n_symbols": _sums(_SYMBOL[data], offsets), "text_chars": np.diff(points[offsets])}

    opens = np.zeros(n_bytes, bool)
    feeds = np.flatnonzero(data == 0x0A)
    opens[feeds[feeds + 1 < n_bytes] + 1] = True
    opens[offsets[:-1][filled]] = True
    heads = np.flatnonzero(opens)
    out["symbol_gram_chars"] = _sums(_symbol_grams(data, offsets, heads, own, rules.bar_times), offsets)
    tails = np.r_[heads[1:], n_bytes] if len(heads) else heads
    tails = tails - (data[tails - 1] == 0x0A) if len(heads) else tails
    words_in = np.searchsorted(starts, tails) - np.searchsorted(starts, heads)
    heads, tails = heads[words_in > 0], tails[words_in > 0]
    line_doc = np.searchsorted(offsets, heads, "right") - 1
    _, again = _repeats(span_hashes(data, heads, tails) ^ own[line_doc])
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    total = np.r_[0, np.cumsum(chars)]
    in_line = total[np.searchsorted(starts, tails)] - total[np.searchsorted(starts, heads)]
    out["dup_line_chars"] = np.bincount(line_doc[again], weights=in_line[again], minlength=docs).astype(np.int64)

    up, down = powers(n + 1)
    words = span_hashes(data, starts, ends)
    echo = np.zeros(n, bool)
    echo[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out["echo_chars"] = _sums(np.where(echo, chars, 0), at)
    rolled = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=rolled[1:])
    last = np.repeat(at[1:], np.diff(at))
    begin = np.arange(n)
    for length in sorted({rules.window, *rules.most_in_ngrams}):
        begin = begin[begin + length <= last[begin]]
        # an n-gram's hash follows from the sums at its ends, for any length
        keys = mix64((rolled[begin + length] - rolled[begin]) * down[begin] + own[doc[begin]])
        twice, later = _repeats(keys)
        if length == rules.window:
            out["n_repeat_words"] = _sums(_covered(begin[twice], length, n), at)
        if length in rules.most_in_ngrams:
            out[f"dup_{length}gram_chars"] = _sums(np.where(_covered(begin[later], length, n), chars, 0), at)
        begin = begin[twice]  # a longer n-gram met twice begins with one met twice
    out["base_failed"] = (out["n_words"] < rules.least_words) | (100 * out["n_repeat_words"] > rules.most_repeat_percent * out["n_words"])
    out["kept"] = ~out["base_failed"]
    for signal, (whole, most) in rules.shares().items():
        out["kept"] &= out[signal] <= most * np.maximum(out[whole], 1)
    return out


def signals(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, the counts (longs), ``base_failed`` and ``kept``."""
    rules = rules or Rules()
    rows = docs.select(id_col, text)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "text_chars", *rules.shares()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            found = measure(*utf8(batch.column(1)), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[c].astype(np.int64)) for c in longs), pa.array(found["base_failed"]), pa.array(found["kept"])], [id_col, *longs, "base_failed", "kept"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, {', '.join(f'{c} long' for c in longs)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """The rows whose text passes, all columns."""
    rules = rules or Rules()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            yield batch.filter(pa.array(measure(*utf8(batch.column(text)), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame, rules: Rules | None = None, keep: float = 0.999, least: int = 5, id_col: str = "doc_id", quality: str = "quality") -> Rules:
    """The rules with limits from labelled texts (1 good, 0 bad): halfway from the share that ``keep`` of the good ones stay
    within to the median of the bad ones beyond it, where ``least`` of them are; other limits stay. Base failures don't count."""
    rules = rules or Rules()
    known = labels.select(F.col(id_col).alias("__id__"), F.col(quality).alias("__good__")).where("__id__ is not null")
    found = signals(docs, rules, id_col).where("not base_failed").join(known, F.col(id_col) == F.col("__id__"))
    shares = {name: F.col(name) / F.greatest(F.col(whole), F.lit(1)) for name, (whole, _) in rules.shares().items()}
    found = found.select("__good__", *[v.alias(k) for k, v in shares.items()])
    good = found.where("__good__ = 1").agg(*[F.percentile_approx(k, keep, 10_000).alias(k) for k in shares]).first()
    beyond = lambda k: F.when((F.col("__good__") == 0) & (F.col(k) > F.lit(good[k])), F.col(k))
    if any(v is None for v in good):
        return rules
    bad = found.agg(*[F.count(beyond(k)).alias(f"n_{k}") for k in shares], *[F.percentile_approx(beyond(k), 0.5, 10_000).alias(k) for k in shares]).first()
    limits = {k: (good[k] + bad[k]) / 2 for k in shares if bad[f"n_{k}"] >= least}
    grams = {n: limits.get(f"dup_{n}gram_chars", most) for n, most in rules.most_in_ngrams.items()}
    return replace(rules, most_in_ngrams=grams, most_in_lines=limits.get("dup_line_chars", rules.most_in_lines), most_in_echoes=limits.get("echo_chars", rules.most_in_echoes), most_in_symbols=limits.get("symbol_gram_chars", rules.most_in_symbols))
