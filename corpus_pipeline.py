"""From documents to token ids: language ID, quality rules, near duplicates, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), and its result is written as Parquet and read again as the next one's docs.
All but the last give back the columns of documents, under any names, clashing ones included, and take empty tables
(with an empty result), null ids, nulls in any other column, repeated rows and texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, langid, mixing, neardup, quality
from plumbline.llm.common import new_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no word, that uniform bytes fit better than any language, or that are long and have less than
    0.6 of the evidence that text of their language has. Null, empty and blank texts go.

    lang becomes the language found where that is surely another than the declared one, or none is declared. Languages
    that tie go by name. Repeated rows and null ids are judged each by itself.
    """
    return langid.identify(docs, keep_all=True)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose characters or words are far from their language's. Short ones, null and empty texts stay.

    A null language is one of its own. Common words that tie go by their order. Repeated rows and null ids are judged each
    by itself.
    """
    return quality.judge(docs, keep_all=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the least id, null ids last; of several texts of one id that of the least hash.

    Rows are told apart by id and text; rows equal in both are one document. Texts without a word are near to nothing and
    stay.
    """
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut, or repeated for another epoch, to their weights. Null, empty and blank texts go.

    Null languages and sources count as unknown. Rows that tie in the seeded order are equal in all that counts; of rows
    equal in id and text as many stay as were selected.
    """
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and byte offsets of each document, with proof that they decode to its text.

    A null text has null results, an empty one empty lists; pairs that tie merge from the left; repeated rows and null ids
    are encoded each by itself; columns but the id are left out.
    """
    return bpe.encode(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("byte_bpe", tokenize)]

#: SQL can express neither the forward algorithm over segmentations nor pair merging.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
