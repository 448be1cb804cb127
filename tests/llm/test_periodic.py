"""Periodic runs against a search by the definition."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import periodic
from placeloom.llm.common import utf8
from placeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(words: list[str], least: int = 12) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) by comparing all words p apart, for all p."""
    ends = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, 2 * p):
                ends.setdefault((i, j + p), p)
            i = j
    return sorted((i, j - i, p) for (i, j), p in ends.items())


def plain_collapsed(words: list[str], runs) -> str:
    dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def check(texts: list[str | None], least: int = 12) -> None:
    data, offsets = utf8(pa.array(texts, pa.string()))
    found, words = periodic.find(data, offsets, least)
    collapsed = periodic.collapsed(data, words, found).to_pylist()
    for k, t in enumerate(texts):
        own = WORD.findall(t or "")
        want = plain(own, least)
        assert sorted((s, e - s, p) for d, s, e, p in found.tolist() if d == k) == want, t
        assert collapsed[k] == plain_collapsed(own, want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "ab", "é"]), max_size=60), min_size=1, max_size=5), st.sampled_from([2, 6, 12]))
def test_random_words(texts, least):
    check([" ".join(t) for t in texts], least)


def test_many_kinds(monkeypatch):
    rng = np.random.default_rng(3)
    texts: list[str | None] = [None, "", " \n", "x", "x " * 11, "x " * 12, "x " * 13, "a b " * 6, "a b " * 6 + "a", "é ñ\t漢 " * 40, "a  b\n" * 7 + "c " * 13]
    for n in (30, 200, 900):
        for p in (1, 2, 5, 13, 40):
            words = [f"w{x}" for x in rng.integers(0, 50, n)]
            a = int(rng.integers(0, n // 2))
            texts.append(" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]))
    blocks = " ".join(f"line {k} of the poem" for k in range(9))
    texts += [f"{blocks} {blocks}", f"intro {blocks} {blocks} {blocks} outro", " ".join(["a b c d e f g h"] * 3 + ["a b c d e f g x"] * 3)]
    check(texts)
    monkeypatch.setattr(periodic, "PAIRS", 50)  # many blocks of pairs
    check(texts)


def test_words_that_hashes_confuse():
    """Polynomials modulo 2^64 are equal for two words in the Thue-Morse order and its opposite; the words decide."""
    order = [bin(k).count("1") & 1 for k in range(1 << 12)]
    morse, other = ["ab"[x] for x in order], ["ba"[x] for x in order]
    text = " ".join(morse + other + morse[:50])
    data, offsets = utf8(pa.array([text]))
    found, _ = periodic.find(data, offsets)
    words = text.split()
    for _, s, e, p in found.tolist():
        assert words[s : e - p] == words[s + p : e] and e - s >= max(12, 2 * p)
        assert (s == 0 or words[s - 1] != words[s - 1 + p]) and (e == len(words) or words[e] != words[e - p])
    small = " ".join(morse[:256] + other[:256])
    check([small])


def test_confused_hashes_are_read_anew(monkeypatch):
    """Where prefix hashes agree in vain (here always), the words are compared and all runs inside found."""
    monkeypatch.setattr(periodic._Prefixes, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    check(["a b " * 8 + "x y z " * 6 + "k", "u " * 20 + "v " * 20])


def query_rows(rows):
    """The query's result by its definition."""
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(b"" if i is None else str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = plain(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        listed = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(runs, key=lambda r: (r[0], r[2])))
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(plain_collapsed(words, runs))))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def few(spark, sf_dir):
    """Whole texts of up to 1,500 words: the plain search takes a square."""
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.length("text") < 10_000)


def test_query_against_plain(spark, few, clashing, tmp_path):
    for name, docs in (("few", few), ("odd", clashing.where("doc_id <> 9 or doc_id is null"))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = QUERIES["op13_periodic_runs"](spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got), key=repr) == query_rows(rows)


def test_whole_table(spark, sf_dir):
    assert QUERIES["op13_periodic_runs"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_very_long_text(spark):
    """300,000 words, the second half repeating 997 of them."""
    rng = np.random.default_rng(1)
    words = [f"w{x}" for x in rng.integers(0, 10_000, 150_000)]
    text = " ".join(words + [words[-997 + k % 997] for k in range(150_000)])
    got = periodic.runs(spark.createDataFrame([(1, text), (None, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["runs"] == [] and got[0]["collapsed"] == ""
    assert [tuple(r) for r in got[1]["runs"]] == [(149_003, 150_997, 997)]
    assert got[1]["collapsed"] == " ".join(words)
