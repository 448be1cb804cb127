"""From documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read back as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeloom.llm import langid, mixing, packing, quality, simhash
from placeloom.llm.common import stored
from placeloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the repetition rules."""
    return quality.keep_good(docs.select(*COLUMNS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by models of the labels that are left."""
    docs = docs.select(*COLUMNS)
    return langid.keep_known(docs, langid.train(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, a Jaccard similarity of 0.8 or more), that of the least id.

    Candidates are fingerprints that three bits link and, as most pairs that similar lie 5 to 17 of 64 bits apart (README), what MinHash bands add.
    """
    return simhash.keep_one(docs.select(*COLUMNS), similarity=0.8, shingle=5).select(*COLUMNS)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents are dropped or repeated so that each source comes near its target."""
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def power_of_two_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs.select(*COLUMNS), tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mixing", mixing_to_targets),
    ("packing", power_of_two_packing),
]

#: SQL has no character models, fingerprints of shingles or tokenizers; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is stored in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs


QUERIES = {"pipeline": run}
QUERY_SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
