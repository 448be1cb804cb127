"""Language identification with interpolated Kneser-Ney character models.

One model per language, of n-grams up to ``order`` characters: interpolated probabilities and
back-off weights lie in arrays sorted by n-gram hash. The language of the lowest cross-entropy per
character wins. A text is rejected if it has no letter, or if its cross-entropy lies above its
language's limit by more than three standard errors, which widen for short texts. The limit is
calibrated by leaving languages out: it lies most of the way from the median of the language's own
held-aside texts to what texts of all languages get from the models of the others only, as an
unknown language would. Both hardly move with the sample. So a text that quotes another language stays.

The models are fitted on a bounded sample of labelled rows: about ``docs_per_lang`` distinct whole
texts a language, chosen by the hash of the text alone, but ``TEXTS`` and ``CHARS`` characters in all
(``LEAST_TEXTS`` a language at least). A model stops taking texts when it has its share of the
``GRAMS`` n-grams that all models may hold (``LEAST_GRAMS`` at least). So what comes to the driver and
lies in a worker is bounded, and every label can be predicted however many there are.

Null labels and null texts teach nothing; without any labelled text every prediction is ``und``.
Null, empty and letter-less texts are ``und`` with score 0; a very long text is scored whole, in
pieces, so that memory follows the length of the text itself only; ties go to the language first in
code-point order; repeated rows are judged alike. Extra columns are kept by ``keep_known``. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, keep, mix64, small, stored

ORDER = 5
#: Labelled texts that one language's model is fitted and calibrated on, about.
DOCS_PER_LANG = 400
#: Most such texts and characters of all languages, but so many texts a language at least.
TEXTS, CHARS, LEAST_TEXTS = 100_000, 400_000_000, 20
#: Most characters of a language.
CHARS_PER_LANG = 4_000_000
#: Most n-grams and contexts of all models (16 bytes each), but so many a language at least.
GRAMS, LEAST_GRAMS = 1_500_000, 500
#: A fifth of them calibrate; without other languages the limit lets this share of them pass.
PASS_SHARE = 0.995
#: What texts get from other languages' models, of so many texts at least: the quantile below which they lie. Over five
#: samples of the same table it moved by 6 %, the 5 % quantile of each language's own such texts by 40 %.
UNKNOWN_SHARE, LEAST_UNKNOWN = 0.25, 20
#: Where the limit lies from a language's own texts (0) to those of unknown languages (1).
TOWARDS_UNKNOWN = 0.75
LEAST_DEVIATIONS = 4.0
#: Characters that the score's posterior counts.
SHARPNESS = 20.0

_TURN = np.uint64(0xD6E8FEB86659FD93)
#: Log-probabilities that a worker's table holds, and that are looked up at once.
_TABLE, _PIECE = 1 << 22, 1 << 19
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def symbols(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each after ``order`` - 1 spaces; white space is a space and digits are 0.

    Also the offsets of the texts, and which positions count: no leading space and no second space in a row.
    """
    pad = " " * (order - 1)
    low = [pad + (t or "").lower() for t in texts]
    offsets = np.r_[0, np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).copy()
    codes[(codes < 32) | (codes == 0xA0) | (codes == 0x85)] = 32
    codes[(codes > 47) & (codes < 58)] = 48
    counts = np.ones(len(codes), bool)
    counts[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    for k in range(order - 1):
        counts[offsets[:-1] + k] = False
    return codes, offsets, counts


def grams(codes: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, for n from 1."""
    one = mix64(codes.astype(np.uint64))
    out, factor = [one], np.uint64(1)
    for n in range(1, order):
        factor = np.uint64((int(factor) * int(_TURN)) & (2**64 - 1))
        longer = out[-1].copy()
        longer[n:] += one[:-n] * factor
        out.append(longer)
    return out


@dataclass
class Model:
    """Of one language: for each n, sorted n-gram hashes with probabilities, sorted context hashes with back-off weights."""

    lang: str
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    floor: float = 1e-6
    within: float = 1.0
    limit: float = float("inf")
    middle: float = 0.0
    between: float = 0.0

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        hashes, values = table
        if not len(hashes):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where(hashes[at] == keys, values[at], default)

    def log_probs(self, ends: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Of n-grams ``ends[n-1]`` after contexts ``before[n-1]`` (of n characters)."""
        p = np.full(len(ends[0]), self.floor)
        for n, table in enumerate(self.grams):
            weight = self._find(self.contexts[n], before[n - 1] if n else np.zeros(len(p), np.uint64), 1.0)
            seen = self._find(table, ends[n], -1.0)
            p = np.where(seen >= 0, seen, weight * p)
        return np.log(p)


def _merged(parts: list[list[np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray]:
    """Unique rows by their first column, with the sums of the last."""
    cols = [np.concatenate(c) for c in zip(*parts)]
    _, first, inverse = np.unique(cols[0], return_index=True, return_inverse=True)
    return [c[first] for c in cols[:-1]], np.bincount(inverse, weights=cols[-1], minlength=len(first))


def fit(lang: str, texts: list[str], order: int = ORDER, most: int = GRAMS) -> Model:
    """The model of one language, of about ``most`` n-grams and contexts at most; every fifth text calibrates (all do if there are few)."""
    held = texts[::5] if len(texts) >= 10 else texts
    taught = [t for k, t in enumerate(texts) if k % 5] if len(texts) >= 10 else texts
    taught = [t for t in taught if 2 * len(t) <= most] or sorted(taught, key=len)[:1]
    table: list[list[np.ndarray]] = []
    block: list[str] = []
    for k, t in enumerate(taught):
        block.append(t)
        if sum(map(len, block)) > min(200_000, most // 4) or k == len(taught) - 1:
            codes, _, counts = symbols(block, order)
            g, at = grams(codes, order), np.flatnonzero(counts)
            # n-gram hashes of this position, longest first, then those of its contexts
            row = [x[at] for x in reversed(g)] + [x[at - 1] for x in reversed(g[:-1])]
            _, first, n = np.unique(row[0], return_index=True, return_counts=True)
            table.append([*(c[first] for c in row), n.astype(float)])
            cols, n = _merged(table)
            table, block = [[*cols, n]], []
            if sum(len(np.unique(c)) for c in cols) > most:
                break
    model = Model(lang)
    cols, count = _merged(table)
    tables = []
    for n in range(order, 0, -1):
        skip = order - n
        tables.append((n, cols[skip], cols[order + skip] if n > 1 else np.zeros(len(count), np.uint64), cols[skip + 1] if n > 1 else None, count))
        if n > 1:  # lower orders count the distinct characters before an n-gram
            _, first, again = np.unique(cols[skip + 1], return_index=True, return_counts=True)
            cols, count = [c[first] for c in cols], again.astype(float)
    model.floor = 1.0 / (len(tables[-1][1]) + 1)
    for n, hashes, context, shorter, count in reversed(tables):
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = float(np.clip(once / (once + 2 * twice), 0.1, 0.95)) if once else 0.1
        keys, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=count)
        weight = discount * kinds / total
        below = Model._find(model.grams[-1], shorter, model.floor) if n > 1 else model.floor
        p = np.maximum(count - discount, 0) / total[inverse] + weight[inverse] * below
        order_of = np.argsort(hashes)
        model.grams.append((hashes[order_of], p[order_of]))
        model.contexts.append((keys, weight))
    means, variances, lengths = [], [], []
    for t in held:
        codes, _, counts = symbols([t], order)
        g, at = grams(codes, order), np.flatnonzero(counts)
        if len(at):
            lp = model.log_probs([x[at] for x in g], [x[at - 1] for x in g])
            means.append(-lp.mean())
            variances.append(lp.var())
            lengths.append(len(at))
    if means:
        h, n = np.array(means), np.array(lengths)
        middle, model.within = float(np.median(h)), float(np.median(variances))
        between = max(0.02, 1.4826 * float(np.median(np.abs(h - middle))))
        own = h - 3 * np.sqrt(model.within / n)
        model.middle, model.between = middle, between
        model.limit = max(middle + LEAST_DEVIATIONS * between, float(np.quantile(own, PASS_SHARE)))
    return model


def _rows(model: Model) -> pa.Table:
    kinds, hashes, values = [], [], []
    for n, (h, v) in enumerate(model.grams):
        kinds.append(np.full(len(h), n))
        hashes.append(h)
        values.append(v)
    for n, (h, v) in enumerate(model.contexts):
        kinds.append(np.full(len(h), 100 + n))
        hashes.append(h)
        values.append(v)
    own = [model.floor, model.within, model.limit, model.middle, model.between]
    kinds.append(np.arange(200, 200 + len(own)))
    hashes.append(np.zeros(len(own), np.uint64))
    values.append(np.array(own))
    kind = np.concatenate(kinds)
    return pa.table({"lang": pa.array([model.lang] * len(kind)), "kind": kind.astype(np.int32), "hash": np.concatenate(hashes).view(np.int64), "value": np.concatenate(values).astype(np.float64)})


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, order: int = ORDER, text: str = "text", lang: str = "lang", grams: int = GRAMS, texts: int = TEXTS, seed: int = 0) -> list[Model]:
    """One model per non-null label, in code-point order; the models, bounded by the parameters, come to the driver. Another ``seed`` chooses another sample."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text), F.lit(seed)).alias("h")).where("lang is not null and text is not null")
    counts = stored(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("count")), "langs")  # copies count once
    langs = max(1, counts.count())
    each, chars = max(LEAST_GRAMS, grams // langs), min(CHARS_PER_LANG, CHARS // langs)
    wanted = max(LEAST_TEXTS, min(docs_per_lang, texts // langs))
    below = F.lit(-(2.0**63)) + F.least(F.lit(1.0), F.lit(float(wanted)) / F.greatest(F.col("count"), F.lit(1))) * F.lit(2.0**64)
    sample = rows.join(small(counts), "lang").where(F.col("h").cast("double") <= below).select("lang", "text", "h").distinct()
    over = Window.partitionBy("lang").orderBy("h", "text")
    sample = sample.withColumn("upto", F.sum(F.length("text")).over(over)).withColumn("nth", F.row_number().over(over))
    sample = stored(sample.where((F.col("upto") <= chars) | (F.col("nth") == 1)).select("lang", "text"), "lang-sample")

    def run(table: pa.Table) -> pa.Table:
        texts = sorted(table.column("text").to_pylist(), key=lambda t: (hash_text(t), t))
        return _rows(fit(table.column("lang")[0].as_py(), texts, order, each))

    got = sample.groupBy("lang").applyInArrow(run, "lang string, kind int, hash long, value double").toArrow()
    langs_of, kind, hashes, values = (got.column(k).to_numpy() for k in range(4))
    models = []
    for name in sorted(set(langs_of)):
        own = langs_of == name
        k, h, v = kind[own], hashes[own].view(np.uint64), values[own]
        part = lambda n: (h[k == n][o := np.argsort(h[k == n])], v[k == n][o])
        own_values = [float(v[k == 200 + n][0]) for n in range(5)]
        models.append(Model(str(name), [part(n) for n in range(order)], [part(100 + n) for n in range(order)], *own_values))
    if len(models) > 1:
        _calibrate(sample, models, order)
    return models


def _calibrate(sample: DataFrame, models: list[Model], order: int) -> None:
    """Set limits by what texts get from the best of all models but their own."""
    shared = _share(sample, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value[1], order)
        for batch in blocks(batches, "text"):
            entropy, n = scorer.entropies(*symbols(batch.column(1).to_pylist(), order)[:3])
            known = {m.lang: k for k, m in enumerate(scorer.models)}
            entropy[np.arange(len(n)), [known[x] for x in batch.column(0).to_pylist()]] = np.inf
            yield pa.RecordBatch.from_arrays([pa.array(entropy.min(axis=1)), pa.array(n)], ["entropy", "n"])

    got = sample.mapInArrow(run, "entropy double, n long").where("n >= 200").select("entropy").toArrow()
    shared.unpersist()
    entropy = got.column(0).to_numpy()
    if len(entropy) < LEAST_UNKNOWN:
        return
    unknown = float(np.quantile(entropy, UNKNOWN_SHARE))
    for model in models:
        model.limit = model.middle + max(LEAST_DEVIATIONS * model.between, TOWARDS_UNKNOWN * (unknown - model.middle))


def hash_text(text: str) -> int:
    """An order of texts that doesn't follow their source's."""
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


class Scorer:
    """Scores blocks of texts; log-probabilities of n-grams that a worker has met are kept in a table of fixed size."""

    def __init__(self, models: list[Model], order: int = ORDER) -> None:
        self.models, self.order = models, order
        self.slots = 1 << max(6, (_TABLE // max(1, len(models))).bit_length() - 1)
        self.keys = np.zeros(self.slots, np.uint64)
        self.logs = np.zeros((self.slots, len(models)), np.float32)

    def entropies(self, codes: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text under each model, and the characters that count (1 at least); pieces of a block at a time."""
        sums, n = np.zeros((len(offsets) - 1, len(self.models))), np.zeros(len(offsets) - 1, np.int64)
        step = max(1024, _PIECE // max(1, len(self.models)))
        for a in range(0, len(codes), step):
            low = max(0, a - self.order)
            at = np.flatnonzero(counts[a : a + step]) + a
            if len(at):
                logs = self._logs(grams(codes[low : a + step], self.order), at - low)
                edges = np.searchsorted(at, offsets)
                doc = np.flatnonzero(np.diff(edges) > 0)
                sums[doc] += np.add.reduceat(logs, edges[doc], axis=0, dtype=np.float64)
                n[doc] += np.diff(edges)[doc]
        n = np.maximum(n, 1)
        return -sums / n[:, None], n

    def _logs(self, g: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log-probabilities of the characters at some positions, a column for each model."""
        keys = mix64(g[-1][at]) | np.uint64(1)
        slot = (keys >> np.uint64(1) & np.uint64(self.slots - 1)).astype(np.int64)
        logs = self.logs[slot]
        missed = np.flatnonzero(self.keys[slot] != keys)
        if len(missed):
            new, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            where = at[missed[first]]
            ends, before = [x[where] for x in g], [x[where - 1] for x in g]
            found = np.stack([m.log_probs(ends, before) for m in self.models], axis=1).astype(np.float32)
            logs[missed] = found[inverse]
            self.keys[slot[missed[first]]] = new
            self.logs[slot[missed[first]]] = found
        return logs

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        n_docs = len(texts)
        codes, offsets, counts = symbols(texts, self.order)
        letters = np.r_[0, np.cumsum(_letters()[codes])]
        has = letters[offsets[1:]] > letters[offsets[:-1]]
        if not self.models:
            return ["und"] * n_docs, np.zeros(n_docs), np.ones(n_docs, bool)
        entropy, n = self.entropies(codes, offsets, counts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(n_docs), best]
        score = 1.0 / np.exp((lowest[:, None] - entropy) * SHARPNESS).sum(axis=1)
        limit, within = (np.array([getattr(m, x) for m in self.models])[best] for x in ("limit", "within"))
        names = [self.models[b].lang if ok else "und" for b, ok in zip(best.tolist(), has.tolist())]
        return names, np.where(has, score, 0.0), ~has | (lowest - 3 * np.sqrt(within / n) > limit)


def _share(docs: DataFrame, models: list[Model]):
    import uuid

    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, models))


def identify(docs: DataFrame, models: list[Model], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, ``lang_pred``, ``score`` and ``rejected``. Only the text is looked at."""
    shared, rows = _share(docs, models), docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, found = shared.value
        scorer = keep(("langid", mark), lambda: Scorer(found))
        for batch in blocks(batches, text, keeps=("langid", mark)):
            names, score, rejected = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, models: list[Model], text: str = "text") -> DataFrame:
    """The rows that aren't rejected, all columns."""
    shared = _share(docs, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, found = shared.value
        scorer = keep(("langid", mark), lambda: Scorer(found))
        for batch in blocks(batches, text, keeps=("langid", mark)):
            yield batch.filter(pa.array(~scorer(batch.column(text).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
