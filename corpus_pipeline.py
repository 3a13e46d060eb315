"""Documents to packed training sequences: language ID, near duplicates, secrets, source mix, packing.

Each stage's result is written as Parquet to the shared scratch folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkframe.llm.common import read_table, stash
from inkframe.llm.langid import known_language
from inkframe.llm.mixing import mix
from inkframe.llm.ngram_join import keep_one
from inkframe.llm.packing import pack
from inkframe.llm.secrets import without_secrets

#: No source is repeated more often than this; every document that reaches the mix is in it.
MAX_REPEATS = 1.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that no learned language fits, and names the language of documents without one."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents; secrets in them are replaced by a mark."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources; a document comes as many rows as the mix gives it."""
    return mix(docs, max_repeats=MAX_REPEATS).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return pack(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scan", secrets), ("source mix", mixing), ("packing", packing)]

#: The stages' models and tree traversals aren't SQL; tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs, f"stage-{k}")
    return docs
