"""An index that changes gives what an index made anew gives."""

import random

import pytest

from quarry import __main__ as cli
from quarry.operators import lexical, models
from quarry.plans import retrieval
from quarry.sources.segments import Index
from quarry.sources.sinks import scratch, stored
from quarry.streaming import ingest

WORDS = [f"word{i}" for i in range(60)] + ["running", "runs", "the", "of"]


def documents(spark, ids, seed):
    draw = random.Random(seed)
    rows = [(i, f"### Topic {i}\n" + " ".join(draw.choice(WORDS) for _ in range(draw.randint(5, 400))) + ".") for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string")


def built(spark, docs):
    return retrieval.build(docs, models.HashingEmbedder(8))


def asked(spark):
    draw = random.Random(5)
    return spark.createDataFrame([(i, " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 6)))) for i in range(12)] + [(12, "word1 or word2 running"), (13, "the"), (14, "nothing")], "item_id long, text string")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("qid", "doc_id", "score", "rank").collect())


def same_as_rebuilt(spark, index):
    """Every search over the index agrees with one over an index of its live children."""
    children, queries = index.children(), asked(spark)
    assert rows_of(index.bm25().search(queries, 7)) == rows_of(lexical.Bm25Index(children, "child_no", "text_content").search(queries, 7))
    assert rows_of(index.fulltext().search(queries, 7)) == rows_of(lexical.FulltextIndex(children, "child_no", "text_content").search(queries, 7))
    assert index.version.n == children.count()
    parents = {r[0] for r in index.parents().select("doc_id").collect()}
    assert {r[0] for r in children.select("parent_id").collect()} <= parents


def test_add_replace_delete_compact_agree_with_a_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    first = Index.opened_or_empty(spark, path).add(*built(spark, documents(spark, range(10), 1)))
    # Documents 8 to 13: two replace what they were, with other text.
    second = first.add(*built(spark, documents(spark, range(8, 14), 2)))
    assert second.parents().select("source").distinct().count() == 14
    third = second.delete(spark.createDataFrame([("3",), ("9",), ("77",)], "source string"), "source")
    assert {r[0] for r in third.parents().select("source").collect()} == set(range(14)) - {3, 9}
    # A document that was taken out comes back.
    fourth = third.add(*built(spark, documents(spark, [3], 3)))
    same_as_rebuilt(spark, Index.opened(spark, path))
    last = fourth.compact()
    assert len(last.version.segments) == 1 and not last.version.dead
    assert rows_of(last.bm25().search(asked(spark), 7)) == rows_of(fourth.bm25().search(asked(spark), 7))
    # Readers of an older version are not disturbed.
    assert first.parents().select("source").distinct().count() == 10
    # The same batch again changes nothing; deleting nothing neither.
    again = last.add(*built(spark, documents(spark, [90], 4)), segment="batch-1")
    assert again.add(*built(spark, documents(spark, [91], 4)), segment="batch-1").version == again.version
    assert again.delete(spark.createDataFrame([("404",)], "doc_id string")).version == again.version


def test_no_index_and_orphans(spark, tmp_path):
    with pytest.raises(ValueError):
        Index.opened(spark, str(tmp_path / "nothing"))
    parents, children = built(spark, documents(spark, range(3), 1))
    with pytest.raises(ValueError):
        Index.opened_or_empty(spark, str(tmp_path / "bad")).add(parents.filter("source = 0"), children)
    with pytest.raises(ValueError):  # nothing counts that was not committed
        Index.opened(spark, str(tmp_path / "bad"))


def test_bm25_fills_up_to_k(spark):
    docs = spark.createDataFrame([(i, "common words here" if i % 7 else "a zebra") for i in range(30)] + [(99, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "zebra"), (2, "absent"), (3, "")], "item_id long, text string")
    found = lexical.Bm25Index(docs).search(queries, 8, fill=True).collect()
    by = {q: sorted((r["rank"], r["doc_id"], r["score"] > 0) for r in found if r["qid"] == q) for q in (1, 2, 3)}
    assert [d for _, d, _ in by[1]] == [0, 7, 14, 21, 28, 1, 2, 3] and [s for *_, s in by[1]] == [True] * 5 + [False] * 3
    assert [d for _, d, _ in by[2]] == list(range(8)) == [d for _, d, _ in by[3]]
    plain = lexical.Bm25Index(docs).search(queries, 8).collect()
    assert {r["qid"] for r in plain} == {1} and len(plain) == 5


def test_blocks_that_cannot_reach_the_threshold_are_skipped(spark, monkeypatch):
    """Rare words in few blocks: the second pass scores less than all blocks, with the same result as one block for all."""
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(WORDS[:20]) for _ in range(30)) + (" rare rare rare rare" if i in (5, 6) else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare word1"), (2, "word3 word4 word5")], "item_id long, text string")
    monkeypatch.setattr(lexical.postings, "LEAST_BLOCKS", 40)
    many = lexical.Bm25Index(docs)
    shipped = []
    whole = lexical.postings.cogrouped
    monkeypatch.setattr(lexical.postings, "cogrouped", lambda rows, heads, asked, *rest: (shipped.append(stored(asked.select("qid", "block").distinct(), "shipped")), whole(rows, heads, asked, *rest))[1])
    got = rows_of(many.search(queries, 1))
    assert sum(s.filter("qid = 1").count() for s in shipped) < 10
    monkeypatch.setattr(lexical.postings, "LEAST_BLOCKS", 1)
    assert got == rows_of(lexical.Bm25Index(docs).search(queries, 1))


def test_streamed_documents_are_found(spark, tmp_path):
    index, path = str(tmp_path / "index"), str(tmp_path / "docs")
    schema = "doc_id long, text string, ts timestamp"
    spark.sql("SELECT 1L AS doc_id, '### Cats\nThe zebra sleeps.' AS text, timestamp'2024-01-01' AS ts UNION ALL SELECT 1L, '### Cats\nThe zebra sleeps.', timestamp'2024-01-01' UNION ALL SELECT 2L, 'plain', timestamp'2024-01-01'").write.parquet(path)

    def run():
        stream = spark.readStream.schema(schema).parquet(path)
        ingest.ingest(stream, index, str(tmp_path / "check"), event_time="ts").awaitTermination(300)

    run()
    assert Index.opened(spark, index).parents().select("source").distinct().count() == 2
    assert "zebra sleeps" in cli.ask(cli.opened(spark, index), ["zebra"])[0]
    version = Index.opened(spark, index).version
    run()  # nothing new: nothing changes
    assert Index.opened(spark, index).version == version
    spark.sql("SELECT 1L AS doc_id, '### Dogs\nThe heron sleeps.' AS text, timestamp'2024-02-01' AS ts").write.mode("append").parquet(path)
    run()
    assert "heron sleeps" in cli.ask(cli.opened(spark, index, sparse="fulltext"), ["heron sleeping"])[0]
    assert Index.opened(spark, index).parents().filter("source = 1").count() == 1
    assert Index.opened(spark, index).bm25().search(spark.createDataFrame([(1, "zebra")], "item_id long, text string"), 3).count() == 0


def test_scratch_tables_are_deleted(spark):
    with scratch(spark):
        held = stored(spark.range(3), "scratch")
        assert held.count() == 3
        files = held.inputFiles()
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
