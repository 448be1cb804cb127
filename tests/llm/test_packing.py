"""Packing: exact token round trips."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from placeloom.llm import packing
from placeloom.llm.common import utf8
from placeloom.llm.queries import QUERIES, tokenizer_path
from placeloom.llm.tokens import CachedTokenizer


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def test_cached_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(2)
    parts = ["a", "b", "é", " ", "  ", "\n", "\t", "'s", "'", "don't", ".", ",", "!!", "1", "23", " ", "　", "漢字", "ß", " the", "The", "#", "\r\n", "<|endoftext|>", "😀", " ", "\x1c", "_", "Ж", "'ll", "…", "ﬁ", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", None, "x" * 5000]
    coder = CachedTokenizer(tokenizer_path(), most=500)
    for at in range(0, len(texts), 300):
        block = texts[at : at + 300]
        ids, off = coder.encode(*utf8(pa.array(block)))
        want = tokenizer.encode_batch([t or "" for t in block], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [w.ids for w in want]


@pytest.mark.parametrize("longest", [1, 2, 8, 2048])
def test_pieces_are_powers_of_two(longest):
    totals = np.array([1, 2, 3, 7, 8, 9, 2047, 2048, 5000])
    doc, start, length = packing.decompose(totals, longest)
    for d, n in enumerate(totals):
        own = [(s, x) for k, s, x in zip(doc, start, length) if k == d]
        at = 0
        for s, x in own:
            assert s == at and x <= longest and x & (x - 1) == 0
            at += x
        assert at == n and len(own) == n // longest + bin(n % longest).count("1")


def check(rows, texts, tokenizer):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} <= {0}
    for doc, group in by.items():
        own = [t for d, t in texts if d == doc]
        ids = np.array([*tokenizer.encode(own[0] or "", add_special_tokens=False).ids, 1], "<u4")
        for r in group:
            assert r["doc_tokens"] == len(ids)
            assert r["crc"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert sorted((r["start"], r["length"]) for r in group) == sorted([x for x in {(r["start"], r["length"]) for r in group} for _ in own])
        assert sum(r["length"] for r in group) == len(ids) * len(own)


def test_edges(edges, clashing, nothing, tokenizer):
    texts = [(r["doc_id"], r["text"]) for r in edges.collect()]
    for docs in (edges, clashing):
        check(packing.pack(docs, tokenizer_path()).selectExpr("*", "crc32(ids) crc").collect(), texts, tokenizer)
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edges, tokenizer_path(), longest=1000)


def test_whole_table(spark, sf_dir, tokenizer):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op9_packing"](spark, sf_dir).withColumnRenamed("ids_crc32", "crc").collect()
    check(rows, texts, tokenizer)
    assert {r["doc_id"] for r in rows} == {d for d, _ in texts}
