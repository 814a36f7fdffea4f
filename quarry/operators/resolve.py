"""From found chunks to context: parents in order of first hit, and the parts of a service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.sinks import stored


def parents(children: DataFrame, parent_table: DataFrame) -> DataFrame:
    """(qid, parent_rank, parent_id, category, service_name, text_content) of each query's found children, each parent once at its best child's place; unknown parents go.

    children has qid, parent_id and rank; parent_table has doc_id, category, service_name and text_content.
    """
    first = children.groupBy("qid", "parent_id").agg(F.min("rank").alias("rank"))
    met = first.join(parent_table, first["parent_id"] == parent_table["doc_id"])
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank", "parent_id"))
    return met.select("qid", place.alias("parent_rank"), "parent_id", "category", "service_name", "text_content")


def context(resolved: DataFrame) -> DataFrame:
    """(qid, n_parents, context): the parents' blocks in order, with a blank line between."""
    block = F.concat(
        F.lit("--- CONTEXT BLOCK ---\n[Category: "), "category", F.lit("]\n[Service: "), "service_name", F.lit("]\n"),
        F.btrim("text_content"), F.lit("\n--- END CONTEXT BLOCK ---"))
    rows = resolved.select("qid", F.struct("parent_rank", block.alias("b")).alias("p")).groupBy("qid").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return rows.select("qid", F.size("p").alias("n_parents"), F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("context"))


def with_siblings(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, position, id): found chunks (qid, id, rank), and before each part of a service its other parts, by id; each once.

    chunks has id and chunk_type. Only parts of services, `<base>:part-<n>`, have siblings, and only those that chunks knows.
    """
    base = lambda c: F.when(F.col(c).contains(":part-"), F.regexp_replace(c, r":part-[^:]*$", ""))
    parts = chunks.filter((F.col("chunk_type") == "service") & F.col("id").contains(":part-")).select(base("id").alias("base"), F.col("id").alias("sibling")).distinct()
    # Stored, so that the size of the different parts is known and few of them go to the tasks.
    parts = stored(parts, "parts")
    own = stored(parts.groupBy("base").agg(F.collect_list("sibling").alias("siblings")), "siblings")
    # Dealt by query before siblings make more rows of them; all that follows stays within a query.
    met = found.select("qid", "rank", "id").repartition("qid").join(parts.withColumnRenamed("sibling", "id"), "id", "left").join(own, "base", "left")
    others = F.transform(F.filter("siblings", lambda s: s != F.col("id")), lambda s: F.struct(F.lit(0).alias("is_self"), s.alias("id")))
    rows = met.select("qid", "rank", F.explode(F.concat(F.array(F.struct(F.lit(1).alias("is_self"), F.col("id"))), F.coalesce(others, F.array().cast("array<struct<is_self:int,id:string>>")))).alias("c"))
    kept = rows.groupBy("qid", "c.id").agg(F.min(F.struct("rank", "c.is_self")).alias("first"))
    return kept.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("first.rank", "first.is_self", "id")).alias("position"), "id")
