"""Models that are trained here: embeddings by truncated SVD of tf-idf, and answers extracted from several contexts.

The SVD runs over all documents by subspace iteration: each round every task adds up A' (A Q) over its documents' sparse tf-idf rows, in chunks of terms
that Spark sums; only the terms x size matrix, bounded by MOST_TERMS, comes to the driver for its QR step and goes out again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import TOKEN, tokens
from quarry.operators.citations import REFUSAL

#: Terms of an embedding at most, those of most documents; rounds of subspace iteration; terms of a chunk.
MOST_TERMS, ROUNDS, CHUNK = 20_000, 5, 512
_WORD = regex.compile(TOKEN)


class SvdEmbedder:
    """Texts as their tf-idf rows times the leading right singular vectors of the training corpus, scaled to length 1; no known term: zeros."""

    def __init__(self, terms: list[str], idf: np.ndarray, components: np.ndarray) -> None:
        self.terms, self.idf, self.components = terms, idf, components
        self.place = {t: i for i, t in enumerate(terms)}
        self.size = components.shape[1]

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and weights of a text's known terms, of length 1 together."""
        counts: dict[int, int] = {}
        for w in _WORD.findall(text.lower()):
            at = self.place.get(w)
            if at is not None:
                counts[at] = counts.get(at, 0) + 1
        at = np.fromiter(counts, np.int64, len(counts))
        weight = (1 + np.log(np.fromiter(counts.values(), float, len(counts)))) * self.idf[at]
        return at, weight / max(np.linalg.norm(weight), 1e-12)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            at, weight = self.row(t)
            out[i] = weight @ self.components[at]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(t, float(w), c.tolist()) for t, w, c in zip(self.terms, self.idf, self.components)]
        spark.createDataFrame(rows, "term string, idf double, components array<double>").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SvdEmbedder:
        rows = spark.read.parquet(path).orderBy("term").collect()
        return cls([r["term"] for r in rows], np.array([r["idf"] for r in rows]), np.array([r["components"] for r in rows]))


def train(docs: DataFrame, text: str = "text", size: int = 64, most_terms: int = MOST_TERMS, rounds: int = ROUNDS, seed: int = 11) -> SvdEmbedder:
    """An embedder fit on all of docs; a null text has no terms. A corpus of fewer terms than size gives fewer dimensions."""
    held = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    n = held.count()
    found = held.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kept = sorted((r["term"], r["df"]) for r in found.orderBy(F.desc("df"), "term").limit(most_terms).collect())
    if not kept:
        raise ValueError("no words to train on")
    idf = np.log((n + 1) / (np.array([d for _, d in kept]) + 1)) + 1
    size = min(size, len(kept))
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(kept), size)))[0]
    own = SvdEmbedder([t for t, _ in kept], idf, basis)
    for _ in range(rounds):
        shared = held.sparkSession.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            model = shared.value
            total = np.zeros_like(model.components)
            for b in batches:
                for t in b.column(0).to_pylist():
                    at, weight = model.row(t)
                    total[at] += np.outer(weight, weight @ model.components[at])
            for a in range(0, len(total), CHUNK):
                part = total[a : a + CHUNK]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([part.tobytes()], pa.binary())], ["chunk", "part"])

        def add(table: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x) for x in table.column("part").to_pylist()]
            return pa.table({"chunk": [table.column("chunk")[0].as_py()], "part": pa.array([sum(parts).tobytes()], pa.binary())})

        sums = np.zeros((len(kept), size))
        for r in held.mapInArrow(run, "chunk long, part binary").groupBy("chunk").applyInArrow(add, "chunk long, part binary").collect():
            part = np.frombuffer(r["part"]).reshape(-1, size)
            sums[r["chunk"] : r["chunk"] + len(part)] = part
        shared.unpersist()
        own = SvdEmbedder(own.terms, idf, np.linalg.qr(sums)[0])
    return own


#: Sentences of an answer, and how much likeness to those taken already takes from a sentence.
SENTENCES, REPEAT, DAMPING = 3, 0.5, 0.85
_SENTENCE = regex.compile(r"(?<=[.!?])\s+|\n+")


def _graph(question: str, sentences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(likeness to the question, likeness among sentences), cosines of word counts weighted by rarity among the sentences."""
    bags = [set(_WORD.findall(s.lower())) for s in [question, *sentences]]
    words = {w: i for i, w in enumerate(sorted(set().union(*bags)))}
    rows = np.zeros((len(bags), max(len(words), 1)))
    for r, bag in zip(rows, bags):
        r[[words[w] for w in bag]] = 1
    rows *= np.log(1 + len(sentences) / np.maximum(rows[1:].sum(0), 1))
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows[1:] @ rows[0], rows[1:] @ rows[1:].T


def extracted_answer(question: str, contexts: list[tuple[str, str]], sentences: int = SENTENCES) -> str:
    """Sentences of contexts (label, text) that answer the question, each with its label; the refusal where none shares a word with it.

    A walk over the graph of like sentences that returns to those like the question ranks them; then they are taken one by one, the
    best first, less what is like those taken already. They stand in the order of their contexts.
    """
    cut = [(label, s.strip().rstrip(".!?")) for label, text in contexts for s in _SENTENCE.split(text or "") if _WORD.search(s) and not s.lstrip().startswith("#")]
    if not cut:
        return REFUSAL
    asked, like = _graph(question, [s for _, s in cut])
    if not asked.any():
        return REFUSAL
    np.fill_diagonal(like, 0)
    step = like / np.maximum(like.sum(1, keepdims=True), 1e-12)
    home = asked / asked.sum()
    rank = home
    for _ in range(30):
        rank = DAMPING * rank @ step + (1 - DAMPING) * home
    score = asked + rank / rank.max()
    taken: list[int] = []
    while len(taken) < min(sentences, len(cut)):
        left = score - 2 * REPEAT * (like[:, taken].max(1) if taken else 0)
        left[taken] = -np.inf
        left[asked == 0] = -np.inf
        best = int(np.round(left, 9).argmax())
        if not np.isfinite(left[best]):
            break
        taken.append(best)
    return " ".join(f"{cut[i][1]} ({cut[i][0]})." for i in sorted(taken))


def extracted(chunks: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(qid, answer) from each question's contexts (qid, question, rank, label, text_content): few rows a question, as many as its contexts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        answer = extracted_answer(rows["question"].iloc[0] or "", list(zip(rows["label"], rows["text_content"])), sentences)
        return pd.DataFrame({"qid": rows["qid"].iloc[:1], "answer": [answer]})

    kind = chunks.schema["qid"].dataType.simpleString()
    return chunks.select("qid", "question", "rank", "label", "text_content").groupBy("qid").applyInPandas(run, f"qid {kind}, answer string")
