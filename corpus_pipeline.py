"""From raw documents to packed sequences: language, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns keep their values, whatever their names. An empty table gives an empty result in every stage; texts of any length are
taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import language, mixing, near_dedup, packing, secrets
from sightline.llm.common import fold, table, written

#: Least share of a text's n-grams, corrected for chance, that its language must explain.
LEAST_SCORE = 0.2


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language that was learned stay; null and empty texts, texts without letters and ones that no language explains go.

    Repeated rows stay or go together; a null lang is predicted like any other; at equal scores the first language by name wins.
    """
    model = language.train(docs.filter(fold(F.col("doc_id"), 4) != 2).select("text", "lang"))
    found = language.identify(docs.select(F.struct(*docs.columns).alias("_row")), model, ["_row"], row="_row")
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("_row.*")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: that of the least doc_id, null last, and of its least text hash.

    Texts without words are linked with nothing and all stay, but for repeated rows, of which one stays.
    """
    return near_dedup.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, repeated ones too; secrets in their texts are masked and n_chars is counted anew. Null texts stay null."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources meet their target weights; a null source is one like others.

    Null and empty texts have size 0 and are drawn like others of their source. Of equal rows as many are taken as a quota needs.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their texts and their places in the packed sequences.

    Null and empty texts have one piece without a place. Pieces of equal length are placed in the order of a hash, so equal
    input is packed alike; repeated rows are packed one by one.
    """
    return packing.pack(docs, texts=True)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("secrets", redact), ("mixture", mix), ("packing", pack)]

#: Language models, MinHash groups and packing have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
