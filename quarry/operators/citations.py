"""Citation labels and the citations that an answer makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The answer that says nothing was found, and words that tell no service.
REFUSAL = "This isn't covered in the document."
COMMON_WORDS = ["amazon", "service", "services"]


def _or(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def label() -> Column:
    """The label of a chunk (chunk_type, service_name, category, concept_group, page_start, page_end, id)."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("page "), F.col("page_start"))).otherwise(F.concat(F.lit("pages "), F.col("page_start"), F.lit("-"), F.col("page_end")))
    kind, service, category, id_ = F.col("chunk_type"), _or("service_name"), _or("category"), _or("id")
    title = F.initcap(F.replace(F.split_part(id_, F.lit(":"), F.lit(2)), F.lit("-"), F.lit(" ")))
    compute = F.lower(id_).contains("compare") & F.lower(id_).contains("compute")
    table = F.when(compute, "Table: Compare AWS compute services").when(id_.contains(":"), F.concat(F.lit("Table: "), title)).otherwise("Comparison table")
    name = F.when((kind == "service") & (service != ""), service).when(kind == "table", table)
    name = name.when(kind == "image_caption", F.concat(F.lit("Diagram: "), F.when(category != "", category).otherwise("Architecture")))
    name = name.when(kind == "concept", F.concat(F.lit("Concept: "), F.coalesce(F.nullif("concept_group", F.lit("")), F.lit("Cloud Computing Concepts"))))
    name = name.when(service != "", service).otherwise(F.when(category != "", category).otherwise("AWS Overview"))
    return F.concat(name, F.lit(", "), pages)


def segments(answer: Column) -> Column:
    """What stands in round and square brackets of an answer, cut at semicolons, in lower case."""
    raw = F.concat(F.regexp_extract_all(answer, F.lit(r"\(([^)]+)\)"), F.lit(1)), F.regexp_extract_all(answer, F.lit(r"\[([^\]]+)\]"), F.lit(1)))
    cut = F.flatten(F.transform(raw, lambda r: F.split(r, ";")))
    return F.filter(F.transform(cut, lambda s: F.lower(F.btrim(s))), lambda s: s != "")


def _cited(seg: Column) -> Column:
    service, category, group, kind = F.lower(F.btrim(_or("service_name"))), F.lower(F.btrim(_or("category"))), F.lower(_or("concept_group")), F.col("chunk_type")
    page = F.concat(F.lit("page "), F.col("page_start"))
    on_page = seg.contains(page) | seg.contains(F.concat(F.lit("pages "), F.col("page_start")))
    named = (service != "") & (seg.contains(service) | service.contains(seg))
    table = (kind == "table") & (seg.contains("table") | seg.contains("compare")) & (on_page | seg.contains("compute"))
    image = (kind == "image_caption") & (seg.contains("diagram") | seg.contains("figure")) & (((category != "") & seg.contains(category)) | on_page)
    concept = (kind == "concept") & (seg.contains("concept") | ((group != "") & seg.contains(group)) | seg.contains(page))
    words = F.filter(F.split(service, r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(COMMON_WORDS))
    return named | table | image | concept | (on_page & F.exists(words, lambda w: seg.contains(w)))


def cited(chunks: DataFrame) -> DataFrame:
    """chunks (qid, rank, answer and a chunk's columns) that the answer cites, each id once, with citation_label.

    A chunk is cited by a bracketed segment that names it, or by its whole label in the answer. A refusal cites nothing.
    """
    labelled = chunks.withColumn("citation_label", label())
    by_segment = F.exists(segments(F.col("answer")), _cited)
    by_label = F.lower("answer").contains(F.lower("citation_label"))
    kept = labelled.filter((F.btrim("answer") != REFUSAL) & (by_segment | by_label))
    first = F.row_number().over(Window.partitionBy("qid", "id").orderBy("rank"))
    return kept.withColumn("n", first).filter("n = 1").drop("n")


def answer_text(raw: Column) -> Column:
    """A reply that holds the refusal is the refusal."""
    return F.when(F.lower(raw).contains(REFUSAL.lower().rstrip(".")), REFUSAL).otherwise(F.btrim(raw))


def sources_line(labels: str | Column) -> Column:
    """`Sources: ` and the labels that are not blank, or nothing."""
    full = F.filter(F.transform(labels, lambda x: F.btrim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.when(F.size(full) > 0, F.concat(F.lit("Sources: "), F.array_join(full, "; "))).otherwise("")
