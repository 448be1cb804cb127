"""The five stages against plain versions of their operators."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from placeloom.llm import langid, mixing
from placeloom.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

from .test_minhash import plain_groups
from .test_quality import plain


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns == corpus_pipeline.COLUMNS
    before, after = out["quality_rules"]
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if plain(r["text"])["kept"])
    before, after = out["language_id"]
    assert len(after) >= 0.98 * len(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = out["simhash_near_dedup"]
    order = sorted(before, key=lambda r: r["doc_id"])
    roots = plain_groups([r["text"] for r in order])  # five words, a similarity of 0.8
    assert sorted(r["doc_id"] for r in after) == sorted({order[k]["doc_id"] for k in roots})
    before, after = out["mixing"]
    plan = mixing.plan_mix(spark.read.parquet(f"{tmp_path}/simhash_near_dedup")).collect()
    assert Counter(r["doc_id"] for r in after) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"] and r["size"]})
    before, after = out["packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    ids = {r["doc_id"]: [*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in before}
    times = Counter(r["doc_id"] for r in before)
    assert sum(r["length"] for r in after) == sum(len(ids[d]) * n for d, n in times.items())
    for r in after:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert bytes(r["ids"]) == b"".join(i.to_bytes(4, "little") for i in part)


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_edges(spark, edges, nothing, tmp_path, empty):
    """run() over a table of odd rows, and over an empty one: what is packed are words of documents that pass."""
    (nothing if empty else edges).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {r["doc_id"] for r in edges.collect() if plain(r["text"])["kept"]}
    assert {r["doc_id"] for r in got} <= good and bool(got) is not empty


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and len(QUERIES) == 13
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert langid.ORDER >= 3


def test_near_dedup_takes_candidates_by_simhash(spark, monkeypatch):
    """Fingerprints are linked in the stage itself, and their pairs hold texts that differ by a word."""
    from placeloom.llm import minhash

    found, original = [], minhash.fingerprint_pairs
    monkeypatch.setattr(minhash, "fingerprint_pairs", lambda *a: found.append(original(*a)) or found[-1])
    words = [f"w{k}" for k in range(2000)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), "quite another text of some words", "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and [p.count() for p in found] == [1]
