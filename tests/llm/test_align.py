"""Alignment of two tokenizers against byte offsets."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import align
from placeloom.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(A, B)


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def piece_bytes(model, i: int) -> bytes:
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()


def plain(libraries, rows) -> list[tuple]:
    """By offsets: groups between common ends, links by overlapping ranges, counts over all rows."""
    a_model, b_model = libraries
    from tokenizers.pre_tokenizers import ByteLevel

    shown = sorted(ByteLevel.alphabet())
    ordinary = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    back = ordinary | dict(zip(sorted(c for c in shown if ord(c) > 255), [b for b in range(256) if chr(b) not in ordinary]))
    held, found = Counter(), []
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in a_model.id_to_token(k)) for k in a]
        b_bytes = [piece_bytes(b_model, k) for k in b]
        body = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != body or b"".join(b_bytes) != body:
            found.append((i, [], [], [], ""))
            continue
        x, y = np.cumsum([0, *map(len, a_bytes)]).tolist(), np.cumsum([0, *map(len, b_bytes)]).tolist()
        common = sorted(set(x[1:]) & set(y[1:]))
        groups, s = [], 0
        for e in common:
            groups.append((",".join(str(k) for k, u, v in zip(a, x, x[1:]) if s <= u and v <= e), ",".join(str(k) for k, u, v in zip(b, y, y[1:]) if s <= u and v <= e)))
            s = e
        links, j = [], 0
        for k in range(len(a)):
            while y[j + 1] <= x[k]:
                j += 1
            m = j
            while m < len(b) and y[m] < x[k + 1]:
                links.append((a[k], b[m]))
                m += 1
        held.update(set(links))
        found.append((i, a, b, links, ";".join("|".join(g) for g in groups)))
    top = defaultdict(int)
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    return sorted(
        ((i, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, links, g in found),
        key=repr,
    )


ODD = [
    "a  b   c ", " leading", "trailing ", "   ", " ", "\n\n x\t\ty", "<s> and </s> <unk> <0x41> <|endoftext|>", "é漢字😀 ñ́ İı ﬁ ½ Å Å", "U+2581 ▁ in▁text", "a b c　d", "\x00nul\x01", "don't won't 's 'll   're", "1234567890 3.14159 1,000", "x" * 3000, "﻿bom ​zero", "ﷺ ㍿ ℀",
    "🇩🇪👩‍👩‍👧‍👦", "नमस्ते दुनिया", "العربية", "<0x0A>", "▁", "a▁ ▁b", "\r\n\r\n", "word" + " " * 70 + "word",
]


def whole(aligner, libraries, text: str) -> None:
    """Segments' ids, one after another, are those of the whole text."""
    import pyarrow as pa

    from placeloom.llm.common import utf8

    data, offsets = utf8(pa.array([" " + text]))
    begin = np.flatnonzero(aligner.a_cuts(data) & aligner.b_cuts(data)).tolist()
    raw = data.tobytes()
    parts = [raw[s:e].decode() for s, e in zip([0, *begin], [*begin, len(raw)])]
    assert sum(aligner.piece_ids(parts), []) == (libraries[1].encode(text) or [aligner.b.piece_to_id("▁")]), text
    assert sum((e.ids for e in aligner.a.encode_batch(parts, add_special_tokens=False)), []) == libraries[0].encode(" " + text, add_special_tokens=False).ids, text


@settings(max_examples=600, deadline=None)
@given(st.text(st.one_of(st.sampled_from(list(" \n\t▁<>0xAé漢'aBs1.,")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_ids_of_segments(aligner, libraries, text):
    whole(aligner, libraries, text)


def test_ids_of_odd_texts(aligner, libraries):
    for text in ODD:
        whole(aligner, libraries, text)


def test_cuts_of_other_files(tmp_path):
    """Texts for a tokenizer with another pattern are not cut."""
    import json

    from placeloom.llm import tokens

    data = np.frombuffer(b"one two, three", np.uint8)
    assert tokens.cuts_of(A)(data).any() and not tokens.cuts_of(tokenizer_path("word_bpe_49k.json"))(data).any()
    made = json.load(open(A, encoding="utf-8"))
    made["pre_tokenizer"] = {"type": "Whitespace"}
    (tmp_path / "t.json").write_text(json.dumps(made))
    assert not tokens.cuts_of(str(tmp_path / "t.json"))(data).any()


def test_a_full_cache_is_emptied(spark, edges, libraries, monkeypatch):
    monkeypatch.setattr(align, "MEMO", 10)
    docs = edges.where("length(text) < 20000 or text is null")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    aligner = align.Aligner(A, B, 10)
    for _ in range(3):
        aligner.settle()
        import pyarrow as pa

        counts = aligner.align(pa.array([t for _, t in rows]))[0]
        want = plain(libraries, list(enumerate(t for _, t in rows)))
        assert [tuple(c) for c in counts.tolist()] == [w[1:5] for w in sorted(want, key=lambda w: w[0])]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=30), st.sets(st.integers(1, 29)), st.sets(st.integers(1, 29)))
def test_transducer(body, a_cuts, b_cuts):
    cut = lambda at: [body[s:e] for s, e in zip([0, *at], [*at, len(body)])]
    a_at, b_at = sorted(x for x in a_cuts if x < len(body)), sorted(x for x in b_cuts if x < len(body))
    a, b = cut(a_at), cut(b_at)
    got = align.Transducer(a, b).groups(list(range(len(a))), list(range(len(b))))
    assert [sum(map(len, a[:i])) for i, _ in got] == [sum(map(len, b[:j])) for _, j in got] == sorted(set(a_at) & set(b_at)) + [len(body)]
    for (i, j), (k, m) in zip([(0, 0), *got], got):
        base = sum(map(len, a[:i]))
        spans = lambda x: [(base + sum(map(len, x[:n])), base + sum(map(len, x[: n + 1]))) for n in range(len(x))]
        want = [(p, q) for p, u in enumerate(spans(a[i:k])) for q, v in enumerate(spans(b[j:m])) if max(u[0], v[0]) < min(u[1], v[1])]
        assert align.overlaps(a[i:k], b[j:m]) == want


def test_mismatches_and_early_ends():
    t = align.Transducer([b"ab", b"c"], [b"a", b"bc", b"x"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and t.groups([0], [0]) is None and t.groups([0, 1], [0, 2]) is None
    assert t.groups([], []) == [] and t.groups([], [0]) is None and t.groups([0, 1], [0, 1, 2]) is None
    assert align.Transducer([b"ab"], [b"ab"], most=0).groups([0, 0], [0, 0]) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("chunk", [1 << 24, 500])
def test_rows_against_plain(spark, edges, libraries, chunk):
    odd = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    docs = edges.select("doc_id", "text").where("length(text) < 20000 or text is null").unionByName(odd)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = align.align(docs, A, B, chunk=chunk).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == plain(libraries, rows)


def test_query_against_plain(spark, sf_dir, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_tokenizer_alignment"](spark, sf_dir).collect()), key=repr) == plain(libraries, rows)


def test_clashing_names_and_no_rows(clashing, nothing):
    got = align.align(clashing.withColumnRenamed("doc_id", "number"), A, B, "number")
    assert "number" in got.columns and got.count() == clashing.count()
    assert align.align(nothing, A, B).count() == 0
