"""The corpus pipeline: language ID, line dedup, near dedup, mixing and packing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes to the
shared folder as Parquet and reads again as the next stage's docs. All stages but the last
return the columns of `documents`, extra ones included, whatever their names.

Documents without a letter, null and empty texts among them, go in the first stage; those that become empty later
stay. Repeated rows are copies, of which the third stage keeps one; where rows tie, the least
doc_id stays, a null one before others. Texts of any length go whole through every stage. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import language_id, line_dedup, mixing, near_dedup, packing
from quarry.llm.common import documents, small_batches, written
from quarry.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects."""
    small_batches(spark)
    return language_id.accepted(docs, language_id.train(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; n_chars follows, and a document whose lines all go stays, empty."""
    fresh = [max(docs.columns, key=len) + end for end in ("_lines", "_dropped")]
    return line_dedup.with_length(line_dedup.dedup_lines(docs).toDF(*docs.columns, *fresh)).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    return near_dedup.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does; documents taken no time go."""
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Kneser-Ney scores, knapsack choices and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
