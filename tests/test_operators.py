"""Operators on small fixtures, against plain Python."""

import itertools
import json
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry.config import Config, load_config
from quarry.functions import text as X
from quarry.operators import chunking, citations, evaluate, fusion, intent, layout, lexical, models, resolve, vector
from quarry.operators import tables as T
from quarry.plans import catalogue, retrieval
from quarry.sources import readers, sinks
from quarry.sources.segments import Index
from quarry.streaming import ingest

MARKDOWN = """# Title
Intro line
## Section
### **Analytics**
#### <u>Amazon Athena</u>
<!-- PAGE_11 -->
Query data in place.
14
AWS Whitepaper
##### Details
More text.
```
# not a heading
```
### Storage
Objects.
"""


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def test_sections_follow_heading_levels():
    found = chunking.sections(MARKDOWN)
    assert [h for h, _ in found] == [
        ["Title", None, None, None, None], ["Title", "Section", None, None, None], ["Title", "Section", "**Analytics**", None, None],
        ["Title", "Section", "**Analytics**", "<u>Amazon Athena</u>", None], ["Title", "Section", "**Analytics**", "<u>Amazon Athena</u>", "Details"],
        ["Title", "Section", "Storage", None, None]]
    assert "# not a heading" in found[4][1]


def test_parents_and_children(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, ""), (4, "### Long\n" + "word one. " * 600)], "doc_id long, text string")
    parents = chunking.parent_chunks(docs)
    rows = {r["header_path"]: r for r in parents.collect()}
    athena = rows["Analytics > Amazon Athena"]
    assert athena["category"] == "Analytics" and "14" not in athena["text_content"] and "PAGE" not in athena["text_content"]
    assert "Analytics > Amazon Athena > Details" in rows
    children = chunking.child_chunks(parents)
    joined = children.join(parents.select(F.col("doc_id").alias("p"), F.col("text_content").alias("whole")), F.col("parent_id") == F.col("p")).collect()
    for r in joined:
        head, body = r["text_content"].split("\n\n", 1)
        assert head == f"[Context: {r['header_path']}]" and body in r["whole"] and len(body) <= 900
    long = [r for r in parents.collect() if r["category"] == "Long"]
    assert len(long) > 2 and all(len(r["text_content"]) <= 2000 for r in long)
    assert chunking.parent_chunks(docs).select("doc_id").exceptAll(parents.select("doc_id")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["alpha", "b", ". ", "\n", "\n\n", " ", "gamma delta"]), max_size=80), st.integers(20, 60), st.integers(0, 15))
def test_split_keeps_text_and_size(parts, size, overlap):
    text = "".join(parts)
    found = chunking.split_text(text, size, overlap, chunking.PARENT_SEPARATORS)
    assert all(0 < len(p) <= size for p in found)
    assert all(p in text for p in found)
    # Nothing but white space goes: without overlaps the parts are the text.
    assert "".join("".join(chunking.split_text(text, size, 0, chunking.PARENT_SEPARATORS)).split()) == "".join(text.split())


def test_table_heads_go_to_children():
    parent = "| A | B |\n|---|---|\nend"
    assert chunking.with_table_heads(parent, ["| 3 | 4 |", "plain"]) == ["| A | B |\n|---|---|\n| 3 | 4 |", "plain"]
    assert chunking.with_table_heads("no table", ["| 3 | 4 |"]) == ["| 3 | 4 |"]
    assert chunking.with_table_heads("a\n| A | B |\n| :-- | --: |\n| 1 | 2 |", ["x\n| 3 | 4 |", "| A | B |\n|---|---|"]) == ["| A | B |\n| :-- | --: |\nx\n| 3 | 4 |", "| A | B |\n|---|---|"]
    assert chunking.table_head("| A |\nno rule\n| - |") is None


def test_catalog_chunk_ids(spark):
    services = spark.createDataFrame([("Web & Co", "Amazon X", "word " * 30, 2, 3, ["u"]), ("Web & Co", "Amazon Y", "short", 4, 4, None)], "category string, name string, description string, page_start int, page_end int, source_urls array<string>")
    ids = sorted(r["id"] for r in chunking.service_chunks(services, 20).collect())
    assert ids == [*(f"service:web-co:amazon-x:part-{i}" for i in (1, 2, 3)), "service:web-co:amazon-y"]
    concepts = spark.createDataFrame([("Deployment models", "Cloud", "d", 1, 1, ["u"])], "concept_group string, name string, description string, page_start int, page_end int, source_urls array<string>")
    tables = spark.createDataFrame([(1, " Compare AWS compute services", 5, 6, ["A", "B"], [["x y", "1"], ["z", "2"]])], "table_id int, title string, page_start int, page_end int, headers array<string>, rows array<array<string>>")
    captions = spark.createDataFrame([("Web & Co", [(7, "p.png", " a drawing ")])], "name string, image_captions array<struct<page:int,image_path:string,caption:string>>")
    chunks = chunking.together(chunking.service_chunks(services), chunking.concept_chunks(concepts), chunking.table_chunks(tables), chunking.caption_chunks(captions))
    kinds = {r["id"]: r["kind_no"] for r in chunks.collect()}
    assert kinds == {"service:web-co:amazon-x": 0, "service:web-co:amazon-y": 0, "concept:deployment-models:cloud": 1, "table:compare-aws-compute-services:p5": 2, "image-caption:web-co:p7:part-1": 4}
    assert chunking.children_of(chunks, 60, 0).filter("id <> parent_id").count() > 0
    assert chunking.require_unique(chunks) is chunks
    with pytest.raises(ValueError, match="not unique"):
        chunking.require_unique(chunks.unionAll(chunks))
    assert {r["check"]: r["n"] for r in chunking.verified(chunks).collect()}["chunks"] == 5


def test_documents_keep_their_chunks_apart(spark):
    """Two documents with the same long service, concept, table, caption and notice: every id once in each."""
    services = spark.createDataFrame([(d, "Web", "Amazon X", f"word{d} " * 30, 2, 3, ["u"]) for d in (1, 2)], "document int, category string, name string, description string, page_start int, page_end int, source_urls array<string>")
    found = chunking.service_chunks(services, 5).collect()
    assert len(found) == 14 and len({(r["document"], r["id"]) for r in found}) == 14 and len({r["id"] for r in found}) == 7
    assert all(f"word{r['document']}" in r["text"] or r["text"] == "Amazon X" for r in found)
    tables = spark.createDataFrame([(d, 1, "Compare AWS compute services", 5, 6, ["A"], [[f"x{d} y z"], ["z w v"]]) for d in (1, 2)], "document int, table_id int, title string, page_start int, page_end int, headers array<string>, rows array<array<string>>")
    cut = chunking.table_chunks(tables, 13).collect()
    assert len(cut) == 4 and all((f"x{r['document']}" in r["text"]) == r["id"].endswith("part-1") for r in cut)
    captions = spark.createDataFrame([(d, "Web", [(7, "p.png", f"drawing {d}")]) for d in (1, 2)], "document int, name string, image_captions array<struct<page:int,image_path:string,caption:string>>")
    chunks = chunking.together(chunking.service_chunks(services), chunking.table_chunks(tables), chunking.caption_chunks(captions))
    assert chunking.require_unique(chunks).count() == 6
    assert {r["check"]: r["n"] for r in chunking.verified(chunks).collect()}["repeated_ids"] == 0
    children = chunking.children_of(chunks, 60, 0).collect()
    assert len({(r["document"], r["id"]) for r in children}) == len(children) and {r["document"] for r in children} == {"1", "2"}
    for r in children:
        assert r["chunk_type"] != "service" or f"word{r['document']}" in r["text"] or r["text"] == "Amazon X"


def test_table_parts_repeat_their_header(spark):
    tables = spark.createDataFrame([(1, "T", ["A"], [[f"w{i} w w w"] for i in range(9)])], "table_id int, title string, headers array<string>, rows array<array<string>>")
    parts = [r["text"] for r in T.table_parts(tables, 24).orderBy("part").collect()]
    assert len(parts) > 1 and all(p.startswith("T\n\n| A |\n| --- |\n| w") for p in parts)
    assert [w for p in parts for w in p.split() if w[0] == "w" and len(w) > 1] == [f"w{i}" for i in range(9)]


@pytest.mark.parametrize("word,expected", [
    ("caresses", "caress"), ("flies", "fli"), ("dies", "die"), ("mules", "mule"), ("denied", "deni"), ("agreed", "agre"), ("owned", "own"), ("humbled", "humbl"),
    ("sized", "size"), ("meeting", "meet"), ("stating", "state"), ("itemization", "item"), ("sensational", "sensat"), ("traditional", "tradit"), ("reference", "refer"),
    ("colonizer", "colon"), ("plotted", "plot"), ("services", "servic"), ("generously", "generous"), ("happy", "happi"), ("databases", "databas"), ("news", "news")])
def test_stems(word, expected):
    assert lexical.stem(word) == expected


def test_fulltext_needs_all_stems(spark):
    docs = spark.createDataFrame([(1, "running dogs and cats"), (2, "a dog runs"), (3, "cat"), (4, None), (5, "dog a b c d runs")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "the dog running"), (2, "of the")], "item_id long, text string")
    found = {(r["qid"], r["doc_id"]): r["score"] for r in lexical.fulltext_search(docs, asked, 9).collect()}
    assert set(found) == {(1, 1), (1, 2), (1, 5)} and found[1, 2] > found[1, 5]
    some = lexical.fulltext_search(docs, spark.createDataFrame([(1, "dog cat")], "item_id long, text string"), 9, any_term=True)
    assert {r["doc_id"] for r in some.collect()} == {1, 2, 3, 5}


def test_bm25_against_plain_python(spark):
    texts = ["a b c a", "b c d", "e", "a e e", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in lexical.Bm25Index(docs).search(spark.createDataFrame([(7, "A e e")], "item_id long, text string"), 5).collect()}
    split = [t.split() for t in texts]
    avg = sum(map(len, split)) / len(split)
    vocabulary = {w for t in split for w in t}
    raw = {w: math.log(5 - sum(w in t for t in split) + 0.5) - math.log(sum(w in t for t in split) + 0.5) for w in vocabulary}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    for i, t in enumerate(split):
        score = sum(q * idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w, q in (("a", 1), ("e", 2)))
        assert found.get(i, 0) == pytest.approx(score, abs=2e-6)


def test_vector_searches_agree(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    query = rows.filter("vec_id = 7").first()["embedding"]
    single = [(r["doc_id"], r["score"]) for r in vector.nearest(rows, query, 5).collect()]
    batch = vector.nearest_each(rows, rows.filter("vec_id IN (7, 9)").select(F.col("vec_id").alias("qid"), "embedding"), 5).filter("qid = 7").orderBy("rank")
    assert single == [(r["doc_id"], r["score"]) for r in batch.collect()] and single[0] == (7, 1.0)
    assert vector.nearest_each(rows, rows.filter("false").select(F.col("vec_id").alias("qid"), "embedding"), 5).count() == 0


def ranked(spark, lists):
    return spark.createDataFrame([(1, d, r) for r, d in enumerate(lists, 1)], "qid long, doc_id long, rank int")


@pytest.mark.parametrize("dense,sparse", [([1, 2, 3], [3, 4]), ([], [5, 6]), ([1, 2], []), ([1, 2], [2, 1])])
def test_fusion(spark, dense, sparse):
    d, s = ranked(spark, dense), ranked(spark, sparse)
    scores = {}
    for weight, items in ((0.3, dense), (0.7, sparse)):
        for r, x in enumerate(items, 1):
            scores[x] = scores.get(x, 0) + weight / (60 + r)
    order = sorted(scores, key=lambda x: (-scores[x], dense.index(x) if x in dense else 99, sparse.index(x) if x in sparse else 99))
    assert [r["doc_id"] for r in fusion.weighted_rrf(d, s, F.lit(0.3), F.lit(0.7)).orderBy("rrf_rank").collect()] == order
    turns = [x for pair in itertools.zip_longest(dense, sparse) for x in pair if x is not None]
    assert [r["doc_id"] for r in fusion.reciprocal_rank_fusion(d, s).orderBy("position").collect()] == list(dict.fromkeys(turns))


def test_siblings_come_before_the_found_part(spark):
    found = spark.createDataFrame([(1, "service:a:b:part-2", 1), (1, "concept:x", 2), (1, "service:a:b:part-1", 3), (1, "service:q:part-1", 4)], "qid long, id string, rank int")
    chunks = spark.createDataFrame([(f"service:a:b:part-{i}", "service") for i in (1, 2, 10)], "id string, chunk_type string")
    order = [r["id"] for r in resolve.with_siblings(found, chunks).orderBy("position").collect()]
    assert order == ["service:a:b:part-1", "service:a:b:part-10", "service:a:b:part-2", "concept:x", "service:q:part-1"]


def test_siblings_move_found_rows_once(spark):
    """F8: rows are dealt by query once, before siblings make more of them; repeated, null and unknown ids keep their places."""
    found = [(q, r, i) for q in range(5) for r, i in enumerate(["service:b:part-1", "x", None, f"service:b:part-{q}", "service:b:part-1", "service:c:part-1"])]
    chunks = [(f"service:b:part-{i}", "service") for i in range(4)] * 2 + [("service:c:part-1", "table")]
    rows = resolve.with_siblings(spark.createDataFrame(found, "qid long, rank int, id string"), spark.createDataFrame(chunks, "id string, chunk_type string"))
    known = sorted({i for i, kind in chunks if kind == "service"})
    expected = {}
    for q, _, i in found:
        for x in [*[k for k in known if i in known and k != i], i]:
            expected.setdefault(q, []).append(x) if x not in expected.get(q, []) else None
    got = {}
    for r in rows.orderBy("qid", "position").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    assert got == expected
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_intent_cases(spark):
    rows = [(1, "EC2 vs S3"), (2, "summary of emails"), (3, "best s3x bucket"), (4, "port 80"), (5, "lambda"), (6, "use EC2 and ec2")]
    found = {r["qid"]: r for r in intent.intent(spark.createDataFrame(rows, "qid long, text string")).collect()}
    assert found[1]["is_comparison"] and found[2]["is_summary"] and found[4]["is_technical"] and found[4]["bm25_weight"] == 0.7
    assert found[3]["variations"][0] == intent.PADDING + "best s3x bucket"
    assert found[6]["variations"][0].count("Elastic Compute Cloud") == 2
    asked = spark.createDataFrame([(1, "What services are in email?"), (2, "how are you"), (3, "What are the AWS storage services?")], "qid long, text string")
    assert [r["category"] for r in intent.asked_category(asked).orderBy("qid").collect()] == [intent.ALIASES["ai"], None, "Storage"]


def test_metrics_edges(spark):
    hits = spark.createDataFrame([(1, 6, True), (2, 1, True), (3, 2, False), (4, 8, True)], "qid long, rank int, relevant boolean")
    asked = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True), (5, False)], "qid long, expects boolean")
    found = {r["qid"]: (r["mrr"], r["ndcg_at_5"]) for r in evaluate.first_match_metrics(hits, asked, 2).collect()}
    assert found == {1: (0.17, 0.0), 2: (1.0, 1.0), 3: (0.0, 0.0), 4: (0.12, 0.0), 5: (1.0, 1.0)}
    empty = evaluate.scorecard(spark.createDataFrame([], "mrr double, ndcg_at_5 double, context_precision double, context_recall double, faithfulness double, answer_correctness double"))
    assert empty.first()["overall"] == 0.0 and "verdict" in evaluate.scorecard_text(empty).first()[0]
    ids = spark.createDataFrame([(" Ab ", ["x", "aB"]), ("c", [])], "r string, e array<string>")
    assert [r[0] for r in ids.select(evaluate.id_matches(F.col("r"), F.col("e"))).collect()] == [True, False]


def test_judge_never_passes_without_a_number(spark):
    found = evaluate.judged(spark.createDataFrame([("SCORE: 0.95\nREASON: " + "x" * 130,), ("nothing",), (None,)], "reply string")).collect()
    assert found[0]["score"] == 0.95 and len(found[0]["reason"]) == 120 and found[0]["reason"].endswith("...")
    assert [r["score"] for r in found[1:]] == [None, None] and found[1]["status"] == "unparsed"


def test_response_text_and_sources(spark):
    assert one(spark, "  hi ", X.response_text) == "hi"
    assert one(spark, json.dumps(["a", {"type": "text", "text": "b", "extras": {"k": 1}}, {"other": 1}]), X.response_text) == "ab"
    labels = spark.createDataFrame([(["Amazon EMR, page 22", " ", None, "X, pages 1-2"],), ([],), (None,)], "l array<string>")
    assert [r[0] for r in labels.select(citations.sources_line(F.col("l"))).collect()] == ["Sources: Amazon EMR, page 22; X, pages 1-2", "", ""]
    assert one(spark, "Sorry. this isn't covered in the document!", citations.answer_text) == citations.REFUSAL
    assert X.repaired("cafÃ©") == "café" and X.repaired("ﬁne") == "fine" and X.repaired(None) is None


def test_headings_links_images(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Cat", 18.0, True), (2, 1, 1, "Svc", 12.0, True), (3, 1, 1, "body", 9.0, False), (4, 1, 2, "Cat2", 18.0, True), (5, 1, 2, "lost", 9.0, False)], "line_id long, document long, page int, text string, size double, bold boolean")
    state = layout.heading_state(lines, 18.0, 12.0)
    assert [(r["kind"], r["service"]) for r in state.orderBy("line_id").collect()] == [("category", None), ("service", "Svc"), ("body", "Svc"), ("category", None), ("none", None)]
    assert [tuple(r)[3:5] for r in layout.service_records(state).select("document", "category_no", "service_no", "name", "description").collect()] == [("Svc", "body")]
    captions = layout.with_captions(spark.createDataFrame([(1, "Cat", "old"), (2, "Cat", "old")], "document long, name string, image_captions string"), spark.createDataFrame([(1, "Cat", 2, "b", "y"), (1, "Cat", 1, "a", "x")], "document long, category string, page int, image_path string, caption string"))
    assert {r["document"]: [c["caption"] for c in r["image_captions"] or ()] for r in captions.collect()} == {1: ["x", "y"], 2: []}


def test_pages_of_other_documents_do_not_meet(spark):
    lines = spark.createDataFrame([(1, 1, 1, "7", 740.0, 750.0), (2, 1, 1, "Title", 740.0, 750.0), (3, 2, 1, "Alone", 740.0, 750.0), (4, 2, 1, "8", 300.0, 310.0)], "line_id long, document long, page int, text string, y0 double, y1 double")
    assert {r["line_id"] for r in layout.running_matter(lines, 792.0).filter("is_running").collect()} == {1, 2}
    boxes = lines.select("document", "page", "line_id", *(F.lit(v).alias(f"line_{c}") for c, v in (("x0", 0.0), ("x1", 9.0), ("y0", 0.0), ("y1", 9.0))))
    region = spark.createDataFrame([(2, 1, 1.0, 1.0, 2.0, 2.0)], "document long, page int, region_x0 double, region_y0 double, region_x1 double, region_y1 double")
    assert {r["line_id"] for r in layout.outside_regions(boxes, region).collect()} == {1, 2}
    numbered = layout.record_lines(boxes.withColumn("text", F.concat(F.lit("  a \n"), "line_id")), region).orderBy("line_id").collect()
    assert [(r["text"], r["line_no"]) for r in numbered] == [("a 1", 1), ("a 2", 2)]
    services = spark.createDataFrame([(1, "C", "Amazon X", 1, 3, ["u"]), (2, "C", "Amazon Y", 1, 3, ["v"])], "document long, category string, name string, page_start int, page_end int, source_urls array<string>")
    found = chunking.notice_context(spark.createDataFrame([(1, 5, "on amazon x and amazon y", 2)], "document long, notice_id long, text string, page_start int"), services).first()
    assert (found["service_name"], found["source_urls"]) == ("Amazon X", ["u"])


def test_notices_meet_names_by_equality(spark):
    """a notice is not held against every service of its page; repeated names, an empty name and page ranges that run backwards count as in SQL."""
    names = ["Ab", "ab c", "Äx", "", None, "Ab", "zz", "b c"]
    s = [(d, "C", n, lo, lo + w, [f"u{i}"]) for i, (d, n, lo, w) in enumerate((d, n, lo, w) for d in (0, 1) for k, n in enumerate(names) for lo, w in (((k + d) % 4, k % 3 - 1),))]
    texts = ["on AB C here", "äX äx", "nothing", "", None, "zz b c zz", "ab"]
    n = [(d, 100 * d + 10 * p + i, t, p) for d in (0, 1, 2) for p in range(6) for i, t in enumerate(texts)]
    services = spark.createDataFrame(s, "document long, category string, name string, page_start int, page_end int, source_urls array<string>")
    found = chunking.notice_context(spark.createDataFrame(n, "document long, notice_id long, text string, page_start int"), services)
    expected = set()
    for d, no, t, p in n:
        own = [x for x in s if t is not None and x[0] == d and x[2] is not None and x[3] <= p <= x[4] and x[2].lower() in t.lower()]
        expected.add((d, no, own[0][2], own[0][5][0]) if len(own) == 1 else (d, no, None, None))
    assert {(r["document"], r["notice_id"], r["service_name"], (r["source_urls"] or [None])[0]) for r in found.collect()} == expected
    assert any(e[2] for e in expected)
    assert "Contains" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_records_and_reports(spark, tmp_path):
    chunks = spark.createDataFrame([("a", None, "service", "Cat", None, None, 3, None, ["u"])], "id string, text string, chunk_type string, category string, service_name string, concept_group string, page_start int, page_end int, source_urls array<string>")
    doc = chunking.as_documents(chunks).first()
    assert doc["page_content"] == "" and doc["metadata"].asDict() == {"id": "a", "chunk_type": "service", "category": "Cat", "service_name": "", "concept_group": "", "page_start": 3, "page_end": 0, "source_urls": '["u"]'}
    assert [r[0] for r in chunking.uncovered(spark.createDataFrame([("Cat",), ("Dog",)], "name string"), chunks).collect()] == ["Dog"]
    parsed = spark.createDataFrame([(1, "Cat", "service", "d", ["u"]), (1, "Cat", "service", " ", None), (1, "Sec", "concept", "d", [])], "document long, category string, record_type string, description string, source_urls array<string>")
    assert tuple(chunking.parsing_report(parsed).first()) == (1, 1, 2, 1, 2, 1)
    sinks.write_json_documents(parsed.limit(1), str(tmp_path / "structure"))
    assert readers.json_document(spark, str(tmp_path / "structure"), "category string").first()["category"] == "Cat"
    nested = spark.createDataFrame([('["a", {"text": ["b", {"text": "c"}]}, 7]',), ("[{'type': 'text', 'text': 'x'}]",), (" [plain ",), (None,)], "r string")
    assert [r[0] for r in nested.select(X.nested_text("r")).collect()] == ["abc", "x", "[plain", None]


def test_models_are_called(spark):
    class Fixed:
        def score(self, pairs):
            return [float(len(t)) for _, t in pairs]

        def caption(self, image):
            return [{"text": f"{len(image)} bytes"}]

        def reply(self, prompt):
            if "bad" in prompt:
                raise RuntimeError("quota")
            return "SCORE: 0.9\nREASON: fine." if prompt.count("ctx") in (0, 3, 4) else "no number"

    candidates = spark.createDataFrame([(1, "q", "aa", 1), (1, "q", "a", 2), (1, "q", "aaa", 3)], "qid long, question string, text_content string, rrf_rank int")
    assert [r["rrf_rank"] for r in models.reranked_by(candidates, Fixed(), 2).orderBy("rank").collect()] == [3, 1]
    assert [r["rrf_rank"] for r in models.passed_through(candidates, 2).orderBy("rank").collect()] == [1, 2]
    assert models.captioned(spark.createDataFrame([(b"abc",)], "content binary"), Fixed()).first()["caption"] == "3 bytes"
    rows = spark.createDataFrame([(1, "q", [f"ctx{i}" for i in range(4)], "a", "g"), (2, "bad", ["ctx"], "a", "g")], "qid long, question string, contexts array<string>, answer string, ground_truth_answer string")
    prompts = models.judge_prompts(rows)
    assert {(r["metric"], r["prompt"].count("ctx")) for r in prompts.filter("qid = 1").collect()} == {("context_precision", 3), ("context_recall", 4), ("faithfulness", 4), ("answer_correctness", 0)}
    found = {r["qid"]: r for r in evaluate.judged_metrics(models.judge_replies(prompts, Fixed())).collect()}
    assert found[1]["context_precision"] == 0.9 and found[1]["faithfulness_reason"] == "fine"
    # A call that fails and a reply without a number score nothing, and do not touch the other metrics.
    assert (found[2]["context_precision"], found[2]["faithfulness"], found[2]["answer_correctness"]) == (None, None, 0.9)


def test_repl():
    said, asked = [], iter(["", "one", "boom", "busy", "two", "QUIT", "never"])

    def answer(q):
        if q == "boom":
            raise ValueError("x")
        if q == "busy":
            raise RuntimeError("429 quota")
        return q.upper()

    assert cli.repl(answer, lambda _: next(asked), said.append) == 2
    assert said == ["ONE", "failed: ValueError: x", "The model is busy; wait a little and ask again.", "TWO"]

    def ended(_):
        raise EOFError

    assert cli.repl(answer, ended, said.append) == 0


def test_sources_and_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    sinks.write_json_lines(chunks, str(tmp_path / "chunks"))
    assert readers.json_lines(spark, str(tmp_path / "chunks")).count() == 2
    (tmp_path / "truth.json").write_text(json.dumps([{"question_id": "Q1", "question": "q"}]))
    path = readers.first_existing(spark, str(tmp_path / "none"), str(tmp_path / "truth.json"))
    assert readers.json_document(spark, path, readers.TRUTH_SCHEMA).first()["question"] == "q"
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, str(tmp_path / "none"))
    assert sinks.append_missing(chunks, str(tmp_path / "t"), ["id"]) == 2
    assert sinks.append_missing(chunks.unionAll(spark.createDataFrame([("c", "z")], chunks.schema)), str(tmp_path / "t"), ["id"]) == 1
    new = spark.createDataFrame([("a", "new", 2), ("a", "older", 1)], "id string, text string, at int")
    old = spark.read.parquet(str(tmp_path / "t")).withColumn("at", F.lit(0))
    old.write.parquet(str(tmp_path / "t2"))
    assert {r["id"]: r["text"] for r in sinks.upsert(new, str(tmp_path / "t2"), "at").collect()} == {"a": "new", "b": "y", "c": "z"}
    assert [r["text"] for r in sinks.upsert(new, str(tmp_path / "none"), "at").collect()] == ["new"]
    (tmp_path / "one.bin").write_bytes(b"abc")
    found = readers.decoded(readers.binary_files(spark, str(tmp_path), "*.bin"), lambda b: [{"n": len(b)}] if b else 1 / 0, "n long")
    assert [(r["n"], r["error"]) for r in found.collect()] == [(3, None)]
    pages = spark.createDataFrame([("d", 10, "toc"), ("d", 12, "two\n7"), ("d", 11, " one "), ("d", 13, "9")], "document string, page int, text string")
    assert readers.markdown_document(pages).first()["text"] == "<!-- PAGE_11 -->\none\n\n<!-- PAGE_12 -->\ntwo"


def test_models_isolate_failures(spark):
    class Flaky:
        def answer(self, question, context):
            if question == "bad":
                raise RuntimeError("quota")
            return f"{question}: {context}"

    rows = spark.createDataFrame([("ok", "c"), ("bad", "c")], "question string, context string")
    found = {r["question"]: (r["answer"], r["failure"]) for r in models.generated(rows, Flaky()).collect()}
    assert found == {"ok": ("ok: c", None), "bad": (None, "RuntimeError: quota")}
    vectors = models.embedded(spark.createDataFrame([("a b",), (None,)], "text string"), models.HashingEmbedder(16)).collect()
    assert len(vectors[0]["embedding"]) == 16 and vectors[1]["embedding"] is None


def test_retrieval_finds_the_verbatim_document(spark):
    docs = spark.createDataFrame([(i, f"### Topic {i}\nThe zebra{i} likes apple{i} and pear{i}.") for i in range(30)], "doc_id long, text string")
    embedder = models.HashingEmbedder()
    retriever = retrieval.Retriever(*retrieval.build(docs, embedder), embedder)
    asked = spark.createDataFrame([(1, "zebra7 likes apple7"), (2, "compare zebra3 vs pear3")], "qid long, question string")
    top = {r["qid"]: r["text_content"] for r in retriever.retrieve(asked).filter("rank = 1").collect()}
    assert "zebra7" in top[1] and "zebra3" in top[2]
    answers = {r["qid"]: r for r in retriever.answer(asked).collect()}
    assert answers[1]["sources"].startswith("Sources: Topic 7, page 0") and answers[1]["n_parents"] >= 1


def test_config(tmp_path, monkeypatch):
    assert load_config(str(tmp_path / "none.yaml")) == Config()
    (tmp_path / "c.yaml").write_text("rrf_keep: 9 # few\nindex_path: 'x'\n")
    monkeypatch.setenv("QUARRY_DENSE_DEPTH", "7")
    found = load_config(str(tmp_path / "c.yaml"))
    assert (found.rrf_keep, found.index_path, found.dense_depth) == (9, "x", 7)
    (tmp_path / "bad.yaml").write_text("just a list")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "bad.yaml"))


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    q = ingest.windowed(ingest.event_stream(spark, str(tmp_path / "events"))).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()


def test_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(i, f"### Topic {i}\nThe zebra{i} likes apple{i}.") for i in range(12)], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    index = str(tmp_path / "index")
    assert cli.main(["build", "--documents", str(tmp_path / "docs"), "--index", index]) == 0
    assert cli.main(["ask", "--index", index, "zebra5 apple5", " "]) == 0
    assert "Sources: Topic 5" in capsys.readouterr().out
    assert cli.main(["ask", "--index", index, "--sparse", "fulltext", "zebra5 or apple5"]) == 0
    assert "Sources: Topic 5" in capsys.readouterr().out
    parent = Index.opened(spark, index).parents().filter("category = 'Topic 3'").first()["doc_id"]
    (tmp_path / "q.json").write_text(json.dumps([{"question": "zebra3 apple3", "expected_parent_ids": [parent]}, {"question": "none"}]))
    card = cli.evaluated(spark, index, str(tmp_path / "q.json"))
    assert "mrr                   : 1.0000" in card and "faithfulness" in card and "verdict" in card
    with pytest.raises(SystemExit):
        cli.main(["ask"])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_hashed_recall_against_brute_force(spark, sf):
    """dense_hashed finds at least 0.9 of the true ten nearest, also when the query's own row does not count."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    true = {(r["qid"], r["doc_id"]) for r in vector.nearest_each(rows, rows.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "qid"), 10).collect()}
    found = catalogue.dense_hashed(spark, f"/root/testdata/{sf}").collect()
    mine = {(r["qid"], r["doc_id"]) for r in found}
    others = {(q, d) for q, d in true if q != d}
    print(sf, "recall@10", len(mine & true) / len(true), "without the query's row", len(mine & others) / len(others))
    assert len(mine & true) >= 0.9 * len(true) and len(mine & others) >= 0.9 * len(others)
    assert len(found) == len(true)


def test_one_document_in_several_tasks(spark):
    """Folds over one document with all rows agree with windows over it, however it is cut."""
    from quarry.operators import scan
    from quarry.plans import inputs

    lines = catalogue._one_document(inputs.rows(spark, "/root/testdata/sf0.001", inputs.LINES))
    assert scan.pieces(lines, ["document"], ["line_id"], 7).select("piece").distinct().count() == 7
    columns = ["line_id", "kind", "category", "service", "category_no"]
    want = sorted(tuple(r) for r in layout.heading_state(lines, 18.0, 12.0).select(*columns).collect())
    assert sorted(tuple(r) for r in layout.heading_state_of_long(lines, 18.0, 12.0, partitions=7).select(*columns).collect()) == want
    headings = lines.filter("size = 12").select("document", "page", F.col("y0").alias("y"), F.col("text").alias("category"))
    images = catalogue._one_document(inputs.rows(spark, "/root/testdata/sf0.001", inputs.IMAGES))
    want = sorted(map(str, layout.nearest_heading(images, headings).collect()))
    assert sorted(map(str, layout.nearest_heading_of_long(images, headings, partitions=7).collect())) == want


def test_question_match_is_that_of_all_pairs(spark):
    """Each way against all pairs, and no nested loop whatever Spark may broadcast."""
    import random
    import re

    draw = random.Random(6)
    words = [f"w{i}" for i in range(25)] + ["the"] * 6
    truths = [(i, f"Q{i:02}", " ".join(draw.choice(words) for _ in range(draw.randint(1, 14)))) for i in range(60)] + [(60, "q60", ""), (61, "q61", "the w1"), (62, "q62", "w1")]
    asked = [(i, draw.choice([lambda: " ".join(draw.choice(words) for _ in range(draw.randint(1, 12))), lambda: draw.choice(truths)[2], lambda: draw.choice(truths)[2][2:30], lambda: "x " + draw.choice(truths)[2] + " y", lambda: f"q{draw.randrange(70)}"])()) for i in range(250)]
    token = lambda t: set(re.findall(r"\w+", t))

    def best(text):
        inp = text.lower().strip()
        found = []
        for no, qid, q in truths:
            qid, q = qid.lower(), q.lower().strip()
            a, b = re.fullmatch(r"q0*(\d+)", inp), re.fullmatch(r"q0*(\d+)", qid)
            if inp == qid or a and b and a[1] == b[1]:
                found.append((1, 0.0, no))
            if inp == q:
                found.append((2, 0.0, no))
            if len(inp) >= 8 and (inp in q or q in inp):
                found.append((3, 0.0, no))
            share = len(token(inp) & token(q)) / max(len(token(inp)), 1)
            if share > 0.65:
                found.append((4, 1 - share, no))
        how, _, no = min(found, default=(None, None, None)) if inp else (None, None, None)
        return no, how

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evaluate.matched_questions(spark.createDataFrame(asked, "input_id int, input string"), spark.createDataFrame(truths, "no int, question_id string, question string"))
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r["input_id"]: (r["matched_no"], r["how"]) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {i: best(t) for i, t in asked}
    assert {how for _, how in got.values()} == {None, 1, 2, 3, 4}


def test_cards_retries_and_fallbacks(spark, tmp_path):
    metrics = spark.createDataFrame([(1, "q?", 2, 0.5, 0.63, 1.0, None, 0.9, 0.8, "ok", None, "fine", "so", "PARTIAL PASS"), (2, "none", None, 0.0, 0.0, None, None, None, None, None, None, None, None, "PARTIAL PASS")],
        "qid int, question string, first_rank int, mrr double, ndcg_at_5 double, context_precision double, context_recall double, faithfulness double, answer_correctness double, context_precision_reason string, context_recall_reason string, faithfulness_reason string, answer_correctness_reason string, verdict string")
    cards = {r["qid"]: r["card"] for r in evaluate.single_card_text(metrics).collect()}
    assert "mrr                   : 0.50 (first relevant at rank 2)" in cards[1] and "context_recall        : - (not judged)" in cards[1] and cards[1].endswith("verdict: PARTIAL PASS")
    assert "nothing relevant found" in cards[2]

    folder = str(tmp_path)

    class Flaky:
        def answer(self, question, context):
            import os

            mark = os.path.join(folder, question)
            if question == "bad" or not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("busy")
            return "done"

    rows = spark.createDataFrame([("good", "c" * 40), ("bad", None)], "question string, context string")
    found = {r["question"]: r for r in models.generated(rows, Flaky(), tries=3, wait=0.01).collect()}
    assert (found["good"]["answer"], found["good"]["failure"], found["good"]["attempts"], found["good"]["tokens_used"]) == ("done", None, 2, 12)
    assert found["bad"]["answer"] is None and found["bad"]["attempts"] == 3 and "busy" in found["bad"]["failure"] and found["bad"]["seconds"] > 0

    asked = spark.createDataFrame([(1, "What quantum services does AWS offer?"), (2, "What storage services does AWS offer?"), (3, "hello")], "qid int, text string")
    named = intent.asked_category(asked, classify=lambda texts: ["Compute" if "quantum" in t else "no such" for t in texts]).collect()
    plain = {r["qid"]: r["category"] for r in intent.asked_category(asked).collect()}
    assert plain[1] is None and plain[3] is None and {r["qid"]: r["category"] for r in named} == plain | {1: "Compute" if "Compute" in intent.CATEGORIES else None}


def test_caption_job_is_taken_up(spark, tmp_path):
    class Eye:
        def __init__(self, broken):
            self.broken = broken

        def caption(self, image):
            if image in self.broken:
                raise RuntimeError("unreadable")
            return f"a drawing of {bytes(image).decode()}"

    images = spark.createDataFrame([(i, f"i{i}".encode()) for i in range(20)], "image_id long, content binary")
    path = str(tmp_path / "captions")
    first = {r["status"]: r["n"] for r in models.caption_job(images.filter("image_id < 12"), Eye([b"i3", b"i5"]), path, batches=3).collect()}
    assert first == {"known": 0, "captioned": 10, "failed": 2, "left": 2}
    again = {r["status"]: r["n"] for r in models.caption_job(images, Eye([b"i5"]), path, batches=3).collect()}
    assert again == {"known": 10, "captioned": 9, "failed": 1, "left": 1}
    held = spark.read.parquet(f"{path}/captions").collect()
    assert len(held) == 19 == len({r["image_id"] for r in held}) and {r["caption"] for r in held if r["image_id"] == 7} == {"a drawing of i7"}
    assert spark.read.parquet(f"{path}/failures").filter("failure LIKE '%unreadable%'").count() == 3


def test_python_workers_get_small_batches(spark):
    """what goes to a Python worker at once is bounded in rows and bytes."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"# H{i}\n\nsome text") for i in range(3)], "doc_id long, text string")
    for make in (chunking.parent_chunks, lambda d: chunking.split_rows(d, "text", 5, 0, [" "]), lambda d: lexical.Bm25Index(d).rows):
        spark.conf.unset(rows)
        spark.conf.unset(size)
        assert make(docs).count() > 0
        assert int(spark.conf.get(rows)) <= 1000 and int(spark.conf.get(size).rstrip("b")) <= 4 << 20


def test_embedder_hashes_a_word_once(monkeypatch):
    calls = []
    hashed = models.hashlib.blake2b
    monkeypatch.setattr(models.hashlib, "blake2b", lambda w, **how: calls.append(w) or hashed(w, **how))
    embedder = models.HashingEmbedder(8)
    found = embedder.embed(["a B a b", "", "b a"])
    assert sorted(calls) == [b"a", b"b"] and not found[1].any()
    monkeypatch.setattr(models.HashingEmbedder, "KNOWN", 1)
    assert (models.HashingEmbedder(8).embed(["a B a b", "", "b a"]) == found).all()


def test_only_documents_at_the_edge_leave_other_blocks(spark, monkeypatch):
    """The k-th score of a query's first block holds back what cannot be among its k best; results are those of all scores."""
    passes = []
    made = lexical.postings.cogrouped
    monkeypatch.setattr(lexical.postings, "cogrouped", lambda *args: passes.append(made(*args)) or passes[-1])
    docs = [(i, " ".join(["w"] * (1 + i % 7) + ["x"] * (i % 5) + [f"u{i}"] * 3)) for i in range(400)]
    index = lexical.Bm25Index(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(1, "w x"), (2, "x u7"), (3, "nothing")], "item_id long, text string")
    found = [tuple(r) for r in index.search(asked, 5).select("qid", "doc_id", "score", "rank").orderBy("qid", "rank").collect()]
    everything = [tuple(r) for r in index.search(asked, 400).select("qid", "doc_id", "score", "rank").filter("rank <= 5").orderBy("qid", "rank").collect()]
    assert found == everything and len(found) == 10
    edge = {r["qid"]: r["edge"] for r in passes[0].groupBy("qid").agg(F.min("score").alias("edge"), F.count("*").alias("n")).filter("n >= 5").collect()}
    second = passes[1].collect()
    assert edge and all(r["score"] >= edge.get(r["qid"], r["score"]) for r in second)


def test_running_lines_of_odd_texts(spark):
    texts = {None: None, "": "", "12": "", " 12 \n\nx": "\nx", "1a\n7": "1a", "<<u>!-- PAGE_3 -->\n4": "", "  AWS Whitepaper \nq": "q", "AWS Whitepaper x": "AWS Whitepaper x",
             "a ©": "a ©", " © a\nb": "b", "x\rcopyright \t© 2024 z Amazon Web Services": "", "x\n\n\n5\n": "x\n\n\n", "plain\n<u>\n": "plain\n\n"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.clean_markdown(F.col("t")).alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == texts
