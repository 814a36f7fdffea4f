"""Every registered query of the retrieval engine; quarry.plans.sql has the SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import ann, chunking, citations, evaluate, fusion, intent, layout, lexical, merges, models, resolve, sampling, vector
from quarry.operators import tables as T
from quarry.plans import inputs as I
from quarry.plans import retrieval
from quarry.plans.sql import oracle_sql
from quarry.sources import sinks
from quarry.sources.readers import table
from quarry.streaming import ingest

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def _bm25(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.Bm25Index(table(spark, sf_dir, "documents")).search(table(spark, sf_dir, "benchmark"), k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, 10).select("qid", "doc_id", "score", "rank")


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    idf = lexical.Bm25Index(table(spark, sf_dir, "documents")).idf()
    return idf.select("term", "df", F.round("idf", 6).alias("idf"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    query = vectors.filter("vec_id = 0").select("embedding").first()
    return vector.nearest(vectors, list(query[0]) if query else [1.0], 20)


def dense_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return vector.nearest_each(vectors, asked, 20).select("qid", "doc_id", "score", "rank")


def dense_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector.nearest_hashed(vector.hashed(vectors), vectors.filter("vec_id % 100 = 0"), 10)


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists of the benchmark items; an item's vector is the one with its id."""
    vectors = table(spark, sf_dir, "embeddings")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    asked = items.join(vectors, items["qid"] == vectors["vec_id"]).select("qid", "embedding")
    return vector.nearest_each(vectors, asked, 20), _bm25(spark, sf_dir, 20)


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    technical = F.col("qid") % 2 == 0
    fused = fusion.weighted_rrf(*_arms(spark, sf_dir), F.when(technical, 0.3).otherwise(0.5), F.when(technical, 0.7).otherwise(0.5))
    return fused.select("qid", "doc_id", "dense_rank", "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"), "rrf_rank")


def interleave_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.interleaved(*_arms(spark, sf_dir)).select("qid", "doc_id", "arm", "position")


def multi_query_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.merged_variants(I.rows(spark, sf_dir, I.VARIANTS))


def fts_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.fulltext_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 20)


def category_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("source = 'src3'").select("doc_id", "lang")


def category_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.asked_category(I.rows(spark, sf_dir, I.QUESTIONS)).select("qid", "category")


def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intent.intent(I.rows(spark, sf_dir, I.QUESTIONS)).select("qid", "is_comparison", "is_technical", "is_summary", "bm25_weight", "vector_weight")


def query_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intent.intent(I.rows(spark, sf_dir, I.QUESTIONS))
    return found.select("qid", F.posexplode("variations").alias("place", "variation"))


def clean_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.rows(spark, sf_dir, I.MATTER)
    return rows.select("doc_id", F.sha2(X.clean_page(F.col("text")), 256).alias("page_sha"), F.sha2(X.clean_markdown(F.col("text")), 256).alias("markdown_sha"))


def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.slug(F.col("url")).alias("slug"), F.sha2(X.collapsed(html), 256).alias("collapsed_sha"), F.sha2(X.clean_cell(html), 256).alias("cell_sha"),
        X.token_count(html).cast("bigint").alias("n_tokens"), X.approx_tokens(html).cast("bigint").alias("approx_tokens"), X.clean_header(F.concat(F.lit("**<u>"), "url", F.lit("</u>__ "))).alias("header"),
        X.mime_type(F.element_at(F.split("url", "[./]"), -1)).alias("mime"))


def header_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = lambda n: F.when(F.col("user_id") % n > 0, F.concat("event_type", F.lit(f" h{n}")))
    category, service, path = X.header_metadata(F.lit("Title"), level(2), level(3), level(5), level(7))
    return table(spark, sf_dir, "events").select("event_id", category.alias("category"), service.alias("service_name"), path.alias("header_path"))


def nfkc_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.repair("text").alias("text"))


def merge_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", X.lowercase_runs(F.col("text")).alias("runs"))
    return rows.filter(F.size("runs") > 0).select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.element_at("runs", 1).alias("first_run"))


def merge_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits of texts in which pairs of words lost the blank between them, by the frequencies of the texts as they were."""
    docs = table(spark, sf_dir, "documents").select("text")
    merged = docs.withColumn("text", F.regexp_replace("text", r"\b([a-z]{6}) ([a-z]{6})\b", "$1$2"))
    return merges.splits(merges.runs(merged), merges.vocabulary(docs))


def json_text_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.json_texts(table(spark, sf_dir, "clicks").select("click_id", "props").distinct(), "props", "click_id", ("ver",))


def json_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of letters in the strings of JSON documents made of whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("lang", F.struct(F.array("text", "source").alias("parts"), F.col("text").alias("image_path")).alias("body"))).alias("json"))
    return merges.runs(merges.json_texts(docs, "json", "doc_id")).select("doc_id", "path", "run")


def dense_quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    index = ann.VectorIndex.build(vectors, f"{sinks.shared_dir(spark)}/vectors-{uuid.uuid4().hex}")
    return index.search(vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), 10)


def chunk_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.parent_chunks(table(spark, sf_dir, "documents"))


def chunk_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.child_chunks(chunk_parents(spark, sf_dir))


def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve.parents(I.rows(spark, sf_dir, I.CHILDREN), I.rows(spark, sf_dir, I.PARENTS))
    return resolve.context(found)


def sibling_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_siblings(I.rows(spark, sf_dir, I.FOUND), I.rows(spark, sf_dir, I.PARTS))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rows(spark, sf_dir, I.PAGE_TABLES).withColumn("headers", F.array("h1", "h2")).withColumn("rows", F.array(F.array("c1", "c2"), F.array("h1", "h2")))


def table_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = T.continued(_tables(spark, sf_dir))
    body = T.body_rows("rows", "headers")
    return merged.select("document", "table_id", "page_start", "page_end", F.col("parts").cast("bigint").alias("parts"), F.size(body).cast("bigint").alias("n_rows"), T.shape("headers").alias("shape"), T.markdown(F.col("headers"), body).alias("markdown"))


def _found_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as a page reader gives them: some without a header, some pages that could not be read."""
    rows = I.rows(spark, sf_dir, I.PAGE_TABLES)
    headers = F.when(F.col("table_id") % 4 > 0, F.array(F.concat(F.lit(" "), "h1"), "h2"))
    return rows.select("document", "table_id", F.col("page_start").alias("page"), headers.alias("headers"), F.array(F.array("h1", "h2"), F.array("c1", "c2"), F.array(F.upper("h1"), "h2"), F.array(F.lit(" "), F.lit(None))).alias("rows"), F.when(F.col("table_id") % 11 == 0, F.lit("broken")).alias("error"))


def extract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.extracted(_found_tables(spark, sf_dir))
    return found.select("table_id", "page", F.array_join("headers", "|").alias("headers"), F.size("rows").cast("bigint").alias("n_rows"), "shape")


def extraction_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.extraction_report(_found_tables(spark, sf_dir))
    return found.select("document", "page", F.array_join("headers", "|").alias("headers"), "reason")


def table_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.row_groups(I.rows(spark, sf_dir, I.ROWS), 60).select("table_id", "row_no", "size", "group_no")


def table_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.rows(spark, sf_dir, I.LINES).withColumn("text", F.when(F.col("line_id") % 9 == 0, F.concat(F.lit("Compare "), "text")).otherwise(F.col("text")))
    found = I.rows(spark, sf_dir, I.IMAGES).select(F.col("image_id").alias("table_id"), "document", "page", F.col("y").alias("y0"), F.array(F.lit("A"), F.col("image_id").cast("string")).alias("headers"))
    return T.nearest_title(found, lines).select("table_id", "title")


def asof_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = I.rows(spark, sf_dir, I.LINES).filter("size = 12").select("document", "page", F.col("y0").alias("y"), F.col("text").alias("category"))
    return layout.nearest_heading(I.rows(spark, sf_dir, I.IMAGES), headings).select("image_id", "page", "category")


def running_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.running_matter(I.rows(spark, sf_dir, I.LINES), 792.0).select("line_id", "is_running")


def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.style_profile(I.rows(spark, sf_dir, I.LINES))


def heading_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.heading_state(I.rows(spark, sf_dir, I.LINES), 18.0, 12.0).select("line_id", "kind", "category", "service")


def _one_document(rows: DataFrame) -> DataFrame:
    """rows of all documents as those of one, page after page."""
    return rows.withColumn("page", F.col("page") + 10 * F.col("document")).withColumn("document", F.lit(0).cast("long"))


def heading_state_one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """heading_state where one document holds every line."""
    found = layout.heading_state_of_long(_one_document(I.rows(spark, sf_dir, I.LINES)), 18.0, 12.0)
    return found.select("line_id", "kind", "category", "service")


def asof_heading_one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _one_document(I.rows(spark, sf_dir, I.LINES))
    headings = lines.filter("size = 12").select("document", "page", F.col("y0").alias("y"), F.col("text").alias("category"))
    return layout.nearest_heading_of_long(_one_document(I.rows(spark, sf_dir, I.IMAGES)), headings).select("image_id", "page", "category")


def service_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = layout.heading_state(I.rows(spark, sf_dir, I.LINES), 18.0, 12.0)
    found = layout.concepts_and_services(layout.service_records(state), ["Category click"])
    return found.select("document", "category", "name", "page_start", "page_end", F.sha2("description", 256).alias("description_sha"), "record_type", "concept_group")


def matter_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.rows(spark, sf_dir, I.LINES)
    found = lines.filter("size = 18 AND text <> 'Category click'").select("document", F.col("page").alias("page_start"), (F.col("page") + 2).alias("page_end"))
    return layout.matter_ranges(found, lines.groupBy("document").agg(F.max("page").alias("page_count")).withColumn("page_count", F.col("page_count") + F.col("document") % 2)).select("document", "kind", "page_start", "page_end")


def link_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = I.rows(spark, sf_dir, I.LINES).select(F.floor(F.col("line_id") / 20).alias("owner"), "document", "page", F.lit(50.0).alias("box_x0"), F.lit(500.0).alias("box_x1"), F.col("y0").alias("box_y0"), F.col("y1").alias("box_y1"))
    return layout.overlapping_links(boxes, I.rows(spark, sf_dir, I.LINKS)).select("document", "owner", F.array_join("source_urls", " ").alias("urls"))


def outside_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.rows(spark, sf_dir, I.LINES).select("line_id", "document", "page", F.lit(50.0).alias("line_x0"), F.lit(490.0).alias("line_x1"), F.col("y0").alias("line_y0"), F.col("y1").alias("line_y1"))
    regions = I.rows(spark, sf_dir, I.LINKS).select("document", "page", *(F.col(f"link_{c}").alias(f"region_{c}") for c in ("x0", "x1", "y0", "y1")))
    return layout.outside_regions(lines, regions).select("line_id")


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = I.rows(spark, sf_dir, I.LINES).select("document", "page", F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  "))).alias("text"), F.lit(50.0).alias("line_x0"), F.lit(490.0).alias("line_x1"), F.col("y0").alias("line_y0"), F.col("y1").alias("line_y1"))
    regions = I.rows(spark, sf_dir, I.LINKS).select("document", "page", *(F.col(f"link_{c}").alias(f"region_{c}") for c in ("x0", "x1", "y0", "y1")))
    return layout.record_lines(lines, regions).select("document", "page", "line_no", "text")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = I.rows(spark, sf_dir, I.CHUNKS).withColumn("text", F.nullif("answer", F.lit("Nothing is cited here (perhaps)"))).withColumn("source_urls", F.when(F.col("rank") % 3 > 0, F.array(F.lit("u"), F.col("id"))))
    found = chunking.as_documents(chunks)
    return found.select("id", "page_content", *(F.col(f"metadata.{c}") for c in ("chunk_type", "category", "service_name", "concept_group", "page_start", "page_end", "source_urls")))


def parsing_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_start") % 4 == 0, "concept").otherwise("service")
    rows = I.rows(spark, sf_dir, I.SERVICES).withColumn("record_type", kind).withColumn("source_urls", F.when(F.col("page_start") % 3 > 0, F.array("url"))).withColumn("description", F.when(F.col("page_start") % 5 > 0, F.col("description")))
    return chunking.parsing_report(rows)


def uncovered_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = I.rows(spark, sf_dir, I.SERVICES).select(F.col("category").alias("name"))
    return chunking.uncovered(names, I.rows(spark, sf_dir, I.SERVICES).filter("page_start < 20").select("category"))


def judge_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.rows(spark, sf_dir, I.TRUTHS).select(F.col("no").alias("qid"), "question", F.array("question_id", F.lit("b"), F.lit("c"), F.lit("d")).alias("contexts"), F.upper("question").alias("answer"), F.col("question_id").alias("ground_truth_answer"))
    return models.judge_prompts(rows)


def rerank_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.passed_through(I.rows(spark, sf_dir, I.VARIANTS).filter("variant = 0").withColumnRenamed("rank", "rrf_rank"), 2).select("qid", "rrf_rank", "rank")


def image_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = I.rows(spark, sf_dir, I.IMAGES)
    return layout.image_routes(images, images.filter("pixel_width > 300").select("document", "category", "page")).select("image_id", "route")


def joined_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_spans(I.rows(spark, sf_dir, I.SPANS))


def notice_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    services = I.rows(spark, sf_dir, I.SERVICES).withColumn("source_urls", F.array("url"))
    found = chunking.notice_context(I.rows(spark, sf_dir, I.NOTICES), services)
    return found.select("notice_id", "category", "service_name", F.array_join("source_urls", " ").alias("urls"))


def catalog_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all kinds of several documents in one table, notices outside the skipped pages 10 to 20 of document 0."""
    services = I.rows(spark, sf_dir, I.SERVICES).withColumn("source_urls", F.array("url"))
    boxes = I.rows(spark, sf_dir, I.NOTICES).select("document", F.col("notice_id").alias("table_id"), F.lit(" | ").alias("title"), F.lit("unrecognized_table").alias("shape"), F.array(F.array("text")).alias("rows"), "page_start", F.col("page_start").alias("page_end"))
    skipped = spark.range(1).select(F.col("id").alias("document"), F.lit(10).alias("page_start"), F.lit(20).alias("page_end"))
    concepts = services.filter("page_start < 10").withColumn("concept_group", F.concat("category", F.lit(" models")))
    tables = I.rows(spark, sf_dir, I.PAGE_TABLES).select("document", "table_id", F.concat(F.lit("Compare AWS "), "title", F.lit(" services")).alias("title"), "page_start", "page_end", F.array(F.lit("Kind"), F.lit("Brand")).alias("headers"), F.array(F.array("c1", F.lit("x"))).alias("rows"))
    drawn = services.select("document", F.col("category").alias("name"), F.array(F.struct(F.col("page_start").alias("page"), F.lit("p.png").alias("image_path"), F.concat(F.lit(" "), "description").alias("caption"))).alias("image_captions"))
    found = chunking.together(chunking.service_chunks(services), chunking.concept_chunks(concepts), chunking.table_chunks(tables), chunking.notice_chunks(boxes, skipped, services), chunking.caption_chunks(drawn))
    return found.select("document", "id", "text", "chunk_type", "category", "service_name", "concept_group", "page_start", "page_end", F.array_join("source_urls", " ").alias("urls"), F.col("kind_no").cast("bigint").alias("kind_no"))


def verify_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.verified(I.rows(spark, sf_dir, I.CHUNKS).withColumn("text", F.when(F.col("rank") % 13 == 0, " ").otherwise(F.col("answer"))))


def index_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.rows(spark, sf_dir, I.FOUND)
    return sinks.audit(I.rows(spark, sf_dir, I.PARTS), found)


def gt_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.matched_questions(I.rows(spark, sf_dir, I.INPUTS), I.rows(spark, sf_dir, I.TRUTHS)).select("input_id", "matched_no", F.col("how").cast("bigint").alias("how"))


def expected_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    truths = I.rows(spark, sf_dir, I.TRUTHS)
    known = truths.select("question", F.array(F.col("question_id")).alias("expected_parent_ids"))
    ids = F.when(F.col("no") % 3 == 0, F.array().cast("array<string>")).when(F.col("no") % 3 == 1, F.array(F.lit("own")))
    asked = truths.select("no", F.concat(F.lit(" "), "question").alias("question"), ids.alias("expected_parent_ids"))
    found = evaluate.expected_filled(asked, known)
    return found.select("no", F.array_join("expected_parent_ids", " ").alias("ids"))


def service_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.rows(spark, sf_dir, I.NAMES)
    return rows.select("pair_id", evaluate.service_matches(F.col("retrieved"), F.col("expected")).alias("matches"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRR and NDCG@5 of BM25 for the benchmark items; a document that holds the item's text is relevant."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("asked"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = _bm25(spark, sf_dir, 10).join(items, "qid").join(docs, "doc_id").select("qid", "rank", F.col("text").contains(F.col("asked")).alias("relevant"))
    return evaluate.first_match_metrics(hits, items.select("qid", (F.col("qid") % 10 < 9).alias("expects")))


def batch_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scorecard(I.rows(spark, sf_dir, I.METRICS))


def query_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.scored(I.rows(spark, sf_dir, I.METRICS)).select("qid", "verdict")


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.judged(I.rows(spark, sf_dir, I.REPLIES)).select("reply_id", "score", "reason", "status")


def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rows(spark, sf_dir, I.CHUNKS).select("rank", citations.label().alias("citation_label"))


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.cited(I.rows(spark, sf_dir, I.CHUNKS)).select("qid", "rank", "id", "citation_label")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.windowed(table(spark, sf_dir, "events"))
    return found.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 3).alias("total"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.sessions(table(spark, sf_dir, "events"))
    return found.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")


def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.seeded_sample(table(spark, sf_dir, "documents"), 50, "doc_id").select("doc_id", "lang")


def response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.rows(spark, sf_dir, I.RESPONSES)
    return rows.select("reply_id", X.response_text(F.col("reply")).alias("text"), citations.answer_text(X.response_text(F.col("reply"))).alias("answer"))


def sources_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = I.rows(spark, sf_dir, I.CHUNKS).select("qid", "rank", F.when(F.col("rank") % 7 > 0, citations.label()).otherwise(" ").alias("label"))
    rows = labelled.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("p"))
    return rows.select("qid", citations.sources_line(F.transform("p", lambda x: x["label"])).alias("sources"))


def image_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = I.rows(spark, sf_dir, I.IMAGES)
    names = images.filter("category IS NOT NULL").select("document", F.col("category").alias("name")).distinct()
    captions = images.select("document", "category", "page", F.concat(F.lit("p"), "image_id").alias("image_path"), F.concat(F.lit("caption "), "image_id").alias("caption"))
    found = layout.with_captions(names, captions)
    return found.select("document", "name", F.size("image_captions").cast("bigint").alias("n"), F.sha2(F.array_join(F.transform("image_captions", lambda c: c["caption"]), "|"), 256).alias("captions_sha"))


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of BM25's 15 by shared words, the offline stand-in for a reranker."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    hits = _bm25(spark, sf_dir, 15).join(items, "qid").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text_content")), "doc_id")
    found = models.reranked(hits.withColumnRenamed("rank", "rrf_rank"))
    return found.select("qid", "doc_id", "rank", F.col("cross_encoder_score").alias("score"))


def queries() -> dict[str, Query]:
    found = [
        bm25_topk, bm25_term_stats, dense_topk, dense_topk_batch, dense_hashed, hybrid_rrf, interleave_dedup, multi_query_union, fts_and_match,
        category_scan, category_detect, query_intent, query_variations, clean_text_lines, text_scalars, header_metadata, nfkc_normalize, merge_suspects, merge_splits, json_text_paths, json_runs, dense_quantised,
        chunk_parents, chunk_children, parent_resolution, sibling_expansion, table_continuation, extract_tables, extraction_report, table_row_groups, table_titles, asof_heading,
        running_matter, style_profile, heading_state, heading_state_one_document, asof_heading_one_document, service_records, matter_ranges, link_overlap, outside_regions, record_lines, chunk_documents, parsing_report, uncovered_categories, judge_prompts, rerank_passed, image_routing, joined_spans,
        notice_context, catalog_chunks, verify_chunks, index_audit, gt_match, expected_backfill, service_match, retrieval_metrics, batch_scorecard,
        query_verdicts, judge_parse, citation_labels, citation_extract, event_windows, event_sessions,
        seeded_sample, response_text, sources_line, image_captions, rerank_overlap,
    ]
    return {q.__name__: q for q in found} | {"answer_batch": retrieval.answer_batch, "retrieve_batch": retrieval.retrieve_batch}
