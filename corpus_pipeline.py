"""The training-corpus pipeline: five stages over the documents table, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyoflux.llm import bpe, exact_dedup, langid, minhash, mixing
from karyoflux.llm.common import table
from karyoflux.llm.queries import tokenizer_path
from karyoflux.runtime import collected, discard, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: no letters, or mostly letters of scripts that no language has."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is equal but for white space."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group: five-word shingle sets of Jaccard similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come in proportion to their weights."""
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document as little-endian unsigned 32-bit integers, with the text they decode to."""
    coded = bpe.encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.expr("cast(length(ids_le) div 4 as long)"))


#: What the stage called last wrote under the shared folder; its result, which reads it, is written before the next one's call.
_left: list[DataFrame] = []


def _tidy(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def tidied(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            discard(_left.pop(), spark)
        with collected(_left):
            return stage(spark, docs, sf_dir)

    return tidied


STAGES = [(stage.__name__, _tidy(stage)) for stage in (language, exact, near, mixture, tokens)]

#: SQL can't express the language model, so tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    while _left:
        discard(_left.pop(), spark)
    return docs
