"""Trained embeddings against numpy's SVD, and extracted answers with their citations."""

import random

import numpy as np

from quarry.operators import citations, trained


def test_svd_is_that_of_the_whole_matrix(spark, tmp_path):
    draw = random.Random(1)
    topics = [[f"t{k}w{i}" for i in range(15)] for k in range(4)]
    texts = [" ".join(draw.choice(topics[i % 4] + ["the", "of"]) for _ in range(40)) for i in range(80)]
    docs = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string").repartition(5)
    own = trained.train(docs, size=4, rounds=12)
    dense = np.zeros((len(texts), len(own.terms)))
    for r, t in zip(dense, texts):
        at, w = own.row(t)
        r[at] = w
    right = np.linalg.svd(dense, full_matrices=False)[2][:4]
    # The same subspace: projections agree whatever the basis.
    assert np.abs(own.components @ own.components.T - right.T @ right).max() < 1e-3
    vectors = own.embed(texts)
    like = vectors @ vectors.T
    same = np.equal.outer(np.arange(80) % 4, np.arange(80) % 4)
    assert like[same].min() > like[~same].max()
    assert not own.embed(["", "unknown words"]).any()
    own.save(spark, str(tmp_path / "model"))
    assert np.allclose(trained.SvdEmbedder.load(spark, str(tmp_path / "model")).embed(texts[:5]), vectors[:5])


def test_near_copies_are_nearest(spark):
    """Of documents with some words changed the original is the nearest other text."""
    rows = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars between 600 and 4000").dropDuplicates(["text"]).orderBy("doc_id").limit(60).collect()]
    draw = random.Random(2)
    copies = [" ".join(w for w in t.split() if draw.random() > 0.1) for t in rows]
    own = trained.train(spark.createDataFrame([(t,) for t in rows], "text string"), size=32)
    found = (own.embed(copies) @ own.embed(rows).T).argmax(1)
    assert (found == np.arange(len(rows))).mean() >= 0.95


def test_answers_from_several_contexts(spark):
    contexts = [("Athena, page 3", "# Head\nAthena queries data in place. It is serverless. Bananas are yellow."), ("S3, page 9", "S3 stores data as objects. Athena queries data in place."), ("EC2, page 1", "EC2 rents machines.")]
    answer = trained.extracted_answer("Where does Athena query data and how does S3 store objects?", contexts)
    assert "Athena queries data in place (Athena, page 3)." in answer and "S3 stores data as objects (S3, page 9)." in answer
    assert answer.count("Athena queries data") == 1 or answer.index("S3 stores") > 0
    assert "Bananas" not in answer and "EC2" not in answer
    assert trained.extracted_answer("zebra?", contexts) == citations.REFUSAL == trained.extracted_answer("x", []) == trained.extracted_answer("", [("a", None)])
    rows = spark.createDataFrame([(q, "Athena data", n, label, text) for q in (1, 2) for n, (label, text) in enumerate(contexts, 1)], "qid long, question string, rank int, label string, text_content string")
    found = trained.extracted(rows).collect()
    assert [r["qid"] for r in sorted(found)] == [1, 2] and all("Athena queries data in place" in r["answer"] for r in found)
