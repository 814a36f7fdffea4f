"""Merging ranked lists: first occurrences, weighted reciprocal ranks, interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_occurrence(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).filter("_n = 1").drop("_n")


def merged_variants(hits: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): a query's variants' lists one after another, each document at its first place.

    hits has qid, variant, doc_id and rank; the new rank counts on through all variants, without the repeats.
    """
    first = first_occurrence(hits, ["qid", "doc_id"], ["variant", "rank"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("variant", "rank", "doc_id"))
    return first.select("qid", "doc_id", place.alias("rank"))


def weighted_rrf(dense: DataFrame, sparse: DataFrame, dense_weight: Column, sparse_weight: Column, constant: int = 60, keep: int = 15) -> DataFrame:
    """(qid, doc_id, dense_rank, sparse_rank, rrf_score, rrf_rank): weights over constant plus rank, summed over both lists.

    Equal scores stay in order of the dense rank, then the sparse rank. The weights may use qid, and
    dense_weight or sparse_weight: the column weight of that list, where it has one.
    """
    side = lambda rows, name: rows.select("qid", "doc_id", F.col("rank").alias(f"{name}_rank"), *([F.col("weight").alias(f"{name}_weight")] if "weight" in rows.columns else []))
    d, s = side(dense, "dense"), side(sparse, "sparse")
    both = d.join(s, ["qid", "doc_id"], "full")
    part = lambda w, r: F.coalesce(w / (constant + F.col(r)), F.lit(0.0))
    scored = both.withColumn("rrf_score", part(dense_weight, "dense_rank") + part(sparse_weight, "sparse_rank"))
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "doc_id")
    return scored.withColumn("rrf_rank", F.row_number().over(order)).filter(F.col("rrf_rank") <= keep)


def interleaved(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """(qid, doc_id, arm, position): both lists by turns, rank by rank, each document once."""
    rows = dense.select("qid", "doc_id", "rank", F.lit(0).alias("arm")).unionAll(sparse.select("qid", "doc_id", "rank", F.lit(1).alias("arm")))
    first = first_occurrence(rows, ["qid", "doc_id"], ["rank", "arm"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "arm"))
    return first.select("qid", "doc_id", "arm", place.alias("position"))


def reciprocal_rank_fusion(dense: DataFrame, sparse: DataFrame, weights: object = None, constant: object = None) -> DataFrame:
    """The older name of `interleaved`, which uses neither weights nor constant."""
    return interleaved(dense, sparse)
