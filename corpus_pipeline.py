"""From raw documents to training tokens: the corpus operators as one chain of stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a table with the columns of documents; the last returns tokens. ``run`` writes
each stage's table to the shared folder and reads it back for the next.

Defined for all stages: null and empty texts do not crash (language identification
rejects texts without a letter), repeated rows of one text become one row at exact dedup,
columns beyond those of documents are carried along, an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from patronly.llm import exact, language, minhash, mixture, pieces
from patronly.llm.queries import PIECE_MODEL
from patronly.llm.text import may_learn
from patronly.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a recognised language; a text without a letter goes."""
    return language.keep_known(docs, docs.filter(may_learn(F.col("doc_id"), 4, 2)))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, keep the longest (then the smallest doc_id)."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicate texts, keep the smallest doc_id."""
    return minhash.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix sources to their target weights: a document comes once per pass that takes it,
    with the words taken; its doc_id may thus come twice."""
    return mixture.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every mixed document, checked by the reference library and by decoding."""
    return pieces.encode(docs, PIECE_MODEL, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mixture", mix_sources),
    ("sentencepiece", tokenize),
]

#: MinHash signatures, block permutations and token ids are beyond SQL; the tests compare
#: every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
