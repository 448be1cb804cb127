"""Quality rules against a plain version."""

from __future__ import annotations

import re
from collections import Counter

from placeloom.llm import quality
from placeloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None, rules: quality.Rules = quality.Rules()) -> dict:
    text = text or ""
    words, seen, dup, dup_chars = WORD.findall(text), set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    grams = lambda n: [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    times, covered = Counter(grams(5)), set()
    for k, g in enumerate(grams(5)):
        if times[g] > 1:
            covered.update(range(k, k + 5))
    symbols, marked, before = set("#*$%&|<>"), set(), set()
    grams_of = lambda s, to: [(k, s[k : k + 3]) for k in range(len(s) - 2) if set(s[k : k + 3]) <= to and set(s[k : k + 3]) & symbols]
    for k, g in grams_of(text, symbols):
        marked.update(range(k, k + 3) if g in before else ())
        before.add(g)
    base = 0
    for line in text.split("\n"):
        own = grams_of(line, symbols | {" ", "\t"})
        met = Counter(g for _, g in own)
        for k, g in own:
            marked.update(range(base + k, base + k + 3) if met[g] >= rules.bar_times else ())
        base += len(line) + 1
    echo = sum(len(b) for a, b in zip(words, words[1:]) if a == b)
    out = {"symbol_gram_chars": len(marked), "echo_chars": echo, "text_chars": len(text), "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered), "dup_line_chars": dup_chars}
    good = True
    for n, most in rules.most_in_ngrams.items():
        before, inside = set(), set()
        for k, g in enumerate(grams(n)):
            if g in before:
                inside.update(range(k, k + n))
            before.add(g)
        out[f"dup_{n}gram_chars"] = sum(len(words[k]) for k in inside)
        good &= out[f"dup_{n}gram_chars"] <= most * max(1, out["word_chars"])
    out["base_failed"] = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    good &= dup_chars <= rules.most_in_lines * max(1, out["word_chars"]) and echo <= rules.most_in_echoes * max(1, out["word_chars"]) and len(marked) <= rules.most_in_symbols * max(1, len(text))
    out["kept"] = not out["base_failed"] and good
    return out


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r["doc_id"]])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_edges(edges):
    check(quality.signals(edges).collect(), _Texts(edges))


class _Texts(dict):
    def __init__(self, df):
        self.n = 0
        for r in df.collect():
            self[r["doc_id"]] = r["text"]
            self.n += 1

    def __len__(self):
        return self.n


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check(QUERIES["op8_quality_rules"](spark, sf_dir).collect(), _Texts(docs))


def test_filter_keeps_columns(edges, clashing, nothing):
    good = quality.keep_good(clashing)
    assert good.columns == clashing.columns
    assert good.count() == quality.signals(edges).where("kept").count() > 20
    assert quality.keep_good(nothing).count() == quality.signals(nothing).count() == 0


def test_labelled_quality(spark, sf_dir):
    """Documents labelled as bad go; of the good ones nearly all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality.signals(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(labels, "doc_id").collect()
    bad, good = [r["kept"] for r in got if r["quality"] == 0], [r["kept"] for r in got if r["quality"] == 1]
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.9 * len(good)


def test_coverage_decides(spark, sf_dir):
    """Beyond the base, repetition coverage rejects, by more than one rule; with limits that let all pass, nothing is."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [r for r in quality.signals(docs).join(labels, "doc_id", "left").collect() if not r["base_failed"]]
    rejected = [r for r in rows if not r["kept"]]
    by = Counter(k for r in rejected for k, (whole, most) in quality.Rules().shares().items() if r[k] > most * max(1, r[whole]))
    assert len(rejected) > 10 and by["symbol_gram_chars"] and sum(by.values()) >= len(rejected)
    assert not any(r["quality"] == 1 for r in rejected) and sum(r["quality"] == 0 and r["kept"] for r in rows) <= 0.1 * sum(r["quality"] == 0 for r in rows)
    free = quality.Rules(most_in_ngrams={5: 1.0}, most_in_lines=1.0, most_in_echoes=1.0, most_in_symbols=1.0)
    assert quality.signals(docs, free).where("kept = base_failed").count() == 0


def test_each_rule_decides(spark):
    prose = " ".join(f"word{k * 7919 % 1000}x" for k in range(200))
    texts = {
        "symbol_gram_chars": " ".join(f"word{k}###" for k in range(60)),
        "echo_chars": " ".join(f"word{k // 2}" for k in range(60)),
        "dup_3gram_chars": " ".join(f"a{k} the same phrase" for k in range(40)),
        "dup_line_chars": "\n".join([prose[:300], "three little words", *["three little words"] * 8]),
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts.values(), prose])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality.signals(docs, quality.Rules(most_repeat_percent=100)).collect()}
    for k, name in enumerate(texts):
        whole, most = quality.Rules().shares()[name]
        assert rows[k][name] > most * rows[k][whole] and not rows[k]["kept"], name
    assert rows[len(texts)]["kept"]


def test_fitted_limits(spark, sf_dir, nothing):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.fitted(docs, labels)
    assert 0.0 < rules.most_in_symbols < 0.2
    got = [r for r in quality.signals(docs, rules).join(labels, "doc_id").collect() if not r["base_failed"]]
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert quality.fitted(nothing, labels) == quality.Rules()


def test_tables_and_code_stay(spark):
    table = "".join(f"| item {k} | {k * 37 % 101} % | <b>{k * k}</b> |\n" for k in range(20, 60))
    code = "".join(f"if (a{k} && b{k} > {k}) {{ x{k} = y{k} << {k}; *p{k} |= {k * 7}; }} // ## step {k}\n" for k in range(30))
    junk = " ".join(f"word{k}{'###' if k % 2 else '$$$'}" for k in range(200))
    bars = " | ".join(f"word{k}" for k in range(200))
    docs = spark.createDataFrame([(1, table), (2, code), (3, junk), (4, bars)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in quality.keep_good(docs).collect()) == [1, 2]
