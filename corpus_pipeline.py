"""A training corpus from documents: known language, no near-duplicates, no personal data, mixed to weights, encoded.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it.
All but the last return the columns of documents. Extra columns, whatever their names, go along; null, empty and
very long texts, ties, repeated rows and empty tables are said of each stage below. No stage fails on any of them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import byte_bpe, fair_mix, language_id, minhash_dedup, pii_surrogates
from glyphmill.llm.common import Scratch, collect_executors, fresh, released, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """``stage``, before which executors give back the heap that the one before it has left."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_executors(spark)
        return stage(spark, docs, sf_dir)

    return run


@_lean
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without a letter and undecided ones go.

    Null and empty texts go, as they have no letter. Very long texts are read whole. Between languages of equal
    posterior none reaches a half, so that a tie goes. Repeated rows go or stay together. An empty table, or one without
    labels to learn from, gives an empty one.
    """
    return language_id.keep_identified(docs, language_id.fit(docs))


@_lean
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of smallest id.

    Texts without words and rows without an id stay. Of rows of one id only near-duplicates go; ties go to the smaller
    hash of the text, then of the row. Of repeated rows one stays. Very long texts are compared whole. An empty table gives an empty one.
    """
    return minhash_dedup.keep_one(docs)


@_lean
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with keyed surrogates; n_chars, where it is a column, follows the text.

    Null and empty texts stay as they are, very long ones are scanned whole, repeated rows stay repeated, with the same
    surrogates; entities are found from left to right, so there are no ties. An empty table gives an empty one.
    """
    found = fresh(docs.columns, "n_entities")
    out = pii_surrogates.pseudonymise(docs, count_col=found)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_lean
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Documents without words, null texts among them, are never taken. A null source is one of its own, a null id is ordered
    as an empty one. Repeated rows are taken one by one; ties in finish time go by source, key, id, size and text. Of very
    long texts all words count. An empty table gives an empty one.
    """
    return fair_mix.mix_rows(docs)


@_lean
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document taken, and digests of them and of the bytes that they decode to.

    Null and empty texts have no ids. Very long texts are encoded whole. Repeated rows give repeated rows; an empty table an empty one.
    """
    done = byte_bpe.encode(docs, decoded_col="decoded")
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mix", mixed),
    ("encode", encoded),
]

#: Language model and BPE merging are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for _, stage in STAGES[:-1]:
        with released():
            docs = scratch.cut(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
