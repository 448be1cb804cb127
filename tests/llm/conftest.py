from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size long, hash long, fp long, shard int, key string, u long, v long, h string, copies int, start long, bucket int, keep boolean, `count` long, p string, s string"


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and odd texts, a very long one, ties and repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eins", "zwei", "drei", "été", "ñandú", "漢字"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 400)) for _ in range(n))
    base = prose(120)
    near = base.replace("alpha", "omega", 1)
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "b", 1), (3, near, "en", None, None), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " \n\t ", "de", "a", 3),
        (7, "one", "en", "c", 3), (8, "$$$ ### %%%", "en", "c", 11), (9, prose(30_000), "fr", "hot", 9), (10, "x\ty\x0bz\x0cw\r\n q", None, "hot", 5), (11, "A B C d", "en", "hot", 4), (12, "a b c D", "en", "hot", 4),
        (13, "no space　between  é", "es", "hot", 4), (14, "same line here\n" * 30, "en", "hot", 4), (14, "same line here\n" * 30, "en", "hot", 4), (None, "nobody's text " * 20, "en", "z", 2), (None, "nobody's text " * 20, "en", "z", 2), (15, "😀 emoji 😀 and 𝒳 text", "en", "é", 3),
    ]
    return rows + [(100 + k, prose(20 + k % 60), ["en", "de", "fr"][k % 3], f"src{k % 4}", k) for k in range(60)]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with extra columns whose names operators might use."""
    extra = len(CLASHING.split(",")) - 5
    return spark.createDataFrame([(*r, *([None] * extra)) for r in edge_rows()], CLASHING)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
