"""Language models: the sums of Kneser-Ney, held-out accuracy, rejection."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.llm import langid
from placeloom.llm.queries import QUERIES

from .test_quality import plain


def plain_grams(text: str, order: int) -> list[str]:
    padded = " " * (order - 1) + text.lower()
    return [padded[i - order + 1 : i + 1] for i in range(order - 1, len(padded)) if not (padded[i] == " " and padded[i - 1] == " ")]


def plain_kneser_ney(text: str | list[str], order: int):
    """A dictionary version: P(last character | those before)."""
    top = Counter(g for t in ([text] if isinstance(text, str) else text) for g in plain_grams(t, order))
    counts = {order: top}
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
    totals, kinds = defaultdict(Counter), defaultdict(Counter)
    for n, c in counts.items():
        for g, v in c.items():
            totals[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1
    floor = 1 / (len(counts[1]) + 1)

    def p(gram: str) -> float:
        n = len(gram)
        below = p(gram[1:]) if n > 1 else floor
        t = totals[n][gram[:-1]]
        if not t:
            return below
        return max(counts[n][gram] - discount[n], 0) / t + discount[n] * kinds[n][gram[:-1]] / t * below

    return p


def test_model_equals_a_plain_one():
    text = "the cat sat on the mat and the rat ran to that hat in the attic"
    model, order = langid.fit("en", [text], 4), 4
    p = plain_kneser_ney(text, order)
    probe = "the bat sat in the hat"
    codes, _, counts = langid.symbols([probe], order)
    g, at = langid.grams(codes, order), np.flatnonzero(counts)
    got = np.exp(model.log_probs([x[at] for x in g], [x[at - 1] for x in g]))
    padded = " " * (order - 1) + probe
    assert got == pytest.approx([p(padded[i - order + 1 : i + 1]) for i in at])


def test_probabilities_sum_to_one():
    text = "abracadabra abba cab"
    p = plain_kneser_ney(text, 3)
    assert sum(p("ab" + c) for c in sorted(set(text))) == pytest.approx(1, abs=0.06)  # the rest is for unknown characters


@pytest.fixture(scope="module")
def models(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return langid.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op2_language_id"](spark, sf_dir)
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(held) > 10 and sum(held) / len(held) >= 0.97
    assert not any(r["rejected"] for r in rows if plain(r["text"])["kept"])  # clean documents stay


def test_edges(edges, clashing, nothing, models):
    got = {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(edges, models).collect()}
    by = {g[0]: g for g in got}
    for k in (4, 5, 6, 8):
        assert by[k] == (k, "und", 0.0, True)
    assert by[9][1] != "und"
    kept = langid.keep_known(clashing, models)
    assert kept.columns == clashing.columns and not {4, 5, 6, 8} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(nothing, models).count() == 0
    assert langid.train(nothing) == []
    assert {r["lang_pred"] for r in langid.identify(edges, []).collect()} == {"und"}


def test_unknown_languages_are_rejected(spark, models):
    far = "Съешь же ещё этих мягких французских булок да выпей чаю и жди друзей у моря " * 5
    noise = "qzxv jkwq zzxq vvkj qqxz wkjv " * 20
    rows = spark.createDataFrame([(1, far), (2, noise)], "doc_id long, text string")
    assert [r["rejected"] for r in langid.identify(rows, models).collect()] == [True, True]


def test_copies_do_not_swell_the_sample(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the very same text in every row").alias("text"), F.lit("en").alias("lang"))
    models = langid.train(rows, docs_per_lang=50)
    assert [m.lang for m in models] == ["en"]


def test_ids_are_no_input(spark, sf_dir):
    """The same texts and labels under other ids give the same models, and so the same scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, second = (langid.train(d, docs_per_lang=20) for d in (docs, docs.withColumn("doc_id", F.col("doc_id") + 1_000_000).repartition(7)))
    texts = [r["text"] for r in docs.limit(50).collect()]
    a, b = (langid.Scorer(m)(texts) for m in (first, second))
    assert [(m.lang, m.limit) for m in first] == [(m.lang, m.limit) for m in second]
    assert a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all()


def test_limits_hold_over_samples(spark, sf_dir):
    """Another sample of the same table moves no limit by more than a tenth."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    limits = np.array([[m.limit for m in langid.train(docs, docs_per_lang=120, seed=k)] for k in range(4)])
    assert (np.abs(limits / np.median(limits, axis=0) - 1) < 0.1).all()


def _tongue(rng, letters: str, n: int) -> list[str]:
    words = ["".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(40)]
    return [" ".join(rng.choice(words, rng.integers(3, 30))) for _ in range(n)]


def test_query_against_plain_models(spark, tmp_path):
    """Predictions and scores of a whole table, from dictionaries of the texts that may be learned from."""
    rng = np.random.default_rng(8)
    rows = [(None, "abc", "aa", "s", 1), (5000, None, "aa", "s", 1), (5001, "12 34", "bb", "s", 1)]
    for k, (lang, letters) in enumerate([("aa", "abcdefg"), ("bb", "defghij"), ("cc", "ghijkab"), ("dd", "xyzabé")]):
        rows += [(1000 * k + i, t, lang, "s", 1) for i, t in enumerate(_tongue(rng, letters, 60))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda t: zlib.crc32(t.encode())
    taught: dict = defaultdict(set)
    for i, t, lang, *_ in rows:
        if t is not None and crc("" if i is None else str(i)) % 5:
            taught[lang].add(t)
    models = {}
    for lang, texts in sorted(taught.items()):
        ordered = sorted(texts, key=crc)
        models[lang] = plain_kneser_ney([t for k, t in enumerate(ordered) if k % 5], langid.ORDER)
    memo: dict = {}

    def entropy(lang: str, text: str) -> float:
        found = plain_grams(text, langid.ORDER)
        for g in found:
            if (lang, g) not in memo:
                memo[lang, g] = -np.log(models[lang](g))
        return sum(memo[lang, g] for g in found) / max(1, len(found))

    got = QUERIES["op2_language_id"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        t = texts[r["doc_id"]]
        if t is None or not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        e = {lang: entropy(lang, t) for lang in models}
        best = min(e, key=lambda x: (e[x], x))
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 / sum(np.exp((e[best] - v) * langid.SHARPNESS) for v in e.values()), abs=1e-3)


def test_many_labels_stay_small(spark):
    """With 300 labels each has a model, the models hold no more than their share, and still tell languages apart."""
    rng = np.random.default_rng(9)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rows = [(f"l{k:03d}", t) for k in range(300) for t in _tongue(rng, "".join(letters[10 * k : 10 * k + 10]), 12)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    models = langid.train(docs, grams=100_000)
    held = [sum(len(h) for h, _ in [*m.grams, *m.contexts]) for m in models]
    assert len(models) == 300 and max(held) < 4 * 500
    assert len(langid.train(docs, grams=100_000, texts=300)) == 300  # some texts a label, however few there may be in all
    scorer = langid.Scorer(models)
    assert scorer.logs.nbytes + scorer.keys.nbytes < 40 << 20
    names, _, _ = scorer([t for _, t in rows])
    assert np.mean([n == lang for n, (lang, _) in zip(names, rows)]) > 0.95


def test_a_very_long_text_is_scored_whole(models):
    """In pieces, with the sums of the whole."""
    parts = ["the quick brown fox and the lazy dog ", "und der schnelle braune Fuchs "]
    text = (parts[0] * 3 + parts[1]) * 5000
    scorer = langid.Scorer(models)
    codes = langid.symbols([text, parts[1]])
    whole, n = scorer.entropies(*codes[:3])
    g, at = langid.grams(codes[0]), np.flatnonzero(codes[2])
    at = at[at < codes[1][1]]
    for k, m in enumerate(models):
        assert whole[0, k] == pytest.approx(-m.log_probs([x[at] for x in g], [x[at - 1] for x in g]).mean(), rel=1e-5)
    assert n[0] == len(at)
