"""Vector indexes against exact search, and merged words against all ways to split them."""

import itertools
import json
import math
import random

import numpy as np
import pytest

from quarry.operators import ann, merges, vector


def brute(rows, queries, k):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = {}
    for q, v in queries:
        scored = sorted((-round(float(unit(np.array(v)) @ unit(np.array(x))), 6) + 0.0, i) for i, x in rows)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_block_join_finds_the_nearest(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 3)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 20)
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(200)] + [(200, [0.0] * 8), (201, None), (202, [1.0] * 8), (203, [2.0] * 8)]
    queries = [(i, draw.normal(size=8).tolist()) for i in range(10)] + [(10, [3.0] * 8), (11, [0.0] * 8)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([*queries, (12, None)], "qid long, embedding array<double>")
    found = {}
    for r in vector.nearest_each(corpus, asked, 5).orderBy("qid", "rank").collect():
        found.setdefault(r["qid"], []).append(r["doc_id"])
    want = brute([r for r in rows if r[1]], queries, 5)
    assert set(found) == set(want) and all(found[q] == want[q] for q in want if q != 11)
    assert found[10][:2] == [202, 203]  # a tie, in order of id
    assert vector.nearest_each(corpus, asked.filter("false"), 5).count() == 0 == vector.nearest_each(corpus.filter("false"), asked, 5).count()
    # A vector of zeros is last, not first.
    hashed = vector.nearest_hashed(vector.hashed(corpus, dimension=8), asked.withColumnRenamed("qid", "vec_id"), 300, probes=256, dimension=8).filter("qid < 10")
    assert hashed.filter("isnan(score)").count() == 0 and hashed.filter("doc_id = 200 AND score = 0").count() == 10


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quantised_index_recall(spark, tmp_path, sf):
    """Recall@10 of at least 0.9 with at most a fifth of all pairs scored exactly; a tied vector many times over is found too."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    asked = rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    true = {(r["qid"], r["doc_id"]) for r in vector.nearest_each(rows, asked, 10).collect()}
    index = ann.VectorIndex.build(rows, str(tmp_path / "index"))
    found = ann.VectorIndex(spark, str(tmp_path / "index")).search(asked, 10).collect()
    recall = len({(r["qid"], r["doc_id"]) for r in found} & true) / len(true)
    print(sf, "recall@10", recall, "pairs scored exactly", 100 / rows.count())
    assert recall >= 0.9 and 100 / rows.count() <= 0.2 and len(found) == len(true)
    assert index.rows.count() == rows.count() and index.rows.filter("length(codes) <> 16").count() == 0
    scores = {(r["qid"], r["doc_id"]): r["score"] for r in vector.nearest_each(rows, asked, 10).collect()}
    assert all(abs(r["score"] - scores[r["qid"], r["doc_id"]]) < 2e-6 for r in found if (r["qid"], r["doc_id"]) in scores)


def test_quantised_index_of_few_and_equal_rows(spark, tmp_path):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 0.0, float(i % 3)]) for i in range(40)] + [(98, [0.0] * 4), (99, None)], "vec_id long, embedding array<double>")
    index = ann.VectorIndex.build(rows, str(tmp_path / "few"), parts=2)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, None)], "qid long, embedding array<double>")
    found = index.search(asked, 4, probes=1.0).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(0, 1.0), (3, 1.0), (6, 1.0), (9, 1.0)]
    with pytest.raises(ValueError):
        ann.VectorIndex.build(rows.filter("false"), str(tmp_path / "none"))


def walked(value, skipped, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in skipped:
                yield from walked(v, skipped, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walked(v, skipped, f"{path}[{i}]")
    elif isinstance(value, str):
        yield path, value


def test_json_walk(spark):
    docs = [{"a": "x", "source_urls": ["no"], "b": [{"c": "y", "image_path": "no"}, "z", [["deep"]], 3, None, True], "": {}}, "plain", [], {"n": None}, ["one", {"two": {"three": {"four": ["five"]}}}]]
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(90, "{broken"), (91, None), (92, "")], "k int, j string")
    got = sorted(tuple(r) for r in merges.json_texts(rows, "j", "k").collect())
    assert got == sorted((i, *found) for i, d in enumerate(docs) for found in walked(d, merges.SKIPPED))


def test_splits_are_the_likeliest(spark):
    draw = random.Random(4)
    common = ["cloud", "storage", "data", "base", "server", "service", "compute", "a", "i", "an", "or", "to", "analytics"]
    texts = [" ".join(draw.choice(common) for _ in range(60)) for _ in range(400)]
    texts += ["cloudstorageserver datasomethingelse serviceanalytics", "cloudstorageserver zzzzzzzzzzzzzz computeanalytics x2dataserverservice", "databaseserver " * 200]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = merges.vocabulary(docs.filter("text LIKE '% %'"))
    found = {r["run"]: r for r in merges.splits(merges.runs(docs), words, spark.createDataFrame([("Compute Analytics computeanalytics",)], "name string")).collect()}
    share = {r["word"]: (r["n"], r["share"]) for r in words.collect()}

    def best(run):
        options = []
        for n in range(1, 6):
            for cuts in itertools.combinations(range(1, len(run)), n):
                parts = [run[a:b] for a, b in zip((0, *cuts), (*cuts, len(run)))]
                if all(p in share and share[p][0] >= merges.LEAST_COUNT and (len(p) >= 2 or p in "ai") for p in parts):
                    options.append((sum(math.log(share[p][1]) for p in parts), " ".join(parts)))
        return max(options, default=None)

    for run in ("cloudstorageserver", "serviceanalytics", "datasomethingelse", "zzzzzzzzzzzzzz", "databaseserver"):
        own, b = math.log(share[run][1]), best(run)
        if b is None or round(b[0] - own, 6) <= 0:
            assert run not in found
        else:
            assert found[run]["suggested_split"] == b[1] and abs(found[run]["score"] - (b[0] - own)) < 1e-5
    assert found["cloudstorageserver"]["suggested_split"] == "cloud storage server" and found["cloudstorageserver"]["n"] == 2
    assert "databaseserver" not in found  # a word often enough is a word
    assert "computeanalytics" not in found and not any("x2" in r for r in found)


def test_splits_by_slices_of_the_vocabulary(spark):
    """substrings meet the vocabulary where they are made, whatever its size; slices of it give what the whole gives."""
    draw = random.Random(4)
    names = ["".join(draw.choice("abcde") for _ in range(draw.randint(2, 7))) for _ in range(60)]
    texts = [(" ".join(draw.choice(names) for _ in range(40)),) for _ in range(30)] + [("".join(draw.sample(names, 3)) + "z" * (i % 2),) for i in range(60)]
    docs = spark.createDataFrame(texts, "text string")
    words = merges.vocabulary(docs.filter("text LIKE '% %'"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = [merges.splits(merges.runs(docs), words, most_words=n, most_runs=m) for n, m in ((10**6, 10**6), (7, 10))]
        whole, sliced = (sorted(map(tuple, f.collect())) for f in found)
        assert whole and whole == sliced
        plan = merges.splits(merges.runs(docs), words)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin [word#") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
