"""Near-duplicates by exact similarity against all pairs."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from placeloom.llm import minhash


def plain_set(text: str | None) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts: list[str | None], least: float = 0.8) -> list[int]:
    sets, parent = [plain_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= least:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(texts))]


def check(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["root"] for r in minhash.near_groups(rows, **options).collect()}
    want, pairs = plain_groups(texts), set()
    for k, w in enumerate(want):
        pairs.add((got[k], w))
    assert len(pairs) == len(set(got.values())) == len(set(want))


@pytest.mark.parametrize("options", [{}, {"block_rows": 5}, {"block_shingles": 300}])
def test_groups_of_edited_copies(spark, options):
    rng = random.Random(4)
    texts: list[str | None] = [None, "", " \n", "one", "ONE", "two words", "a b c d e", "A b\tc d  e"]
    for _ in range(12):
        words = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(8, 300))]
        for _ in range(6):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    check(spark, texts, **options)


def test_whole_table(spark, sf_dir):
    check(spark, [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()])


def test_stage_drops_an_edited_copy(spark):
    """Three changed words in 200: similarity above 0.8, but more than 3 bits of the fingerprint differ."""
    words = [f"w{k}" for k in range(200)]
    near = [w if k not in (30, 100, 170) else "changed" for k, w in enumerate(words)]
    far = [w if k % 20 else "changed" for k, w in enumerate(words)]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "a", 1) for k, t in enumerate([words, near, far])], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [0, 2]
    assert corpus_pipeline.simhash_near_dedup(spark, docs.where("false"), "").count() == 0
