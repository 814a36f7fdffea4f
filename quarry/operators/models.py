"""Places for models, and offline stand-ins. The stand-ins are no models: their names say what they do."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.functions.text import plain_text, tokens
from quarry.operators.citations import REFUSAL
from quarry.sources.sinks import stored

#: Fixed value: what some embedding models want before a question.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class Generator(Protocol):
    def answer(self, question: str, context: str) -> str: ...


class Judge(Protocol):
    def reply(self, prompt: str) -> str: ...


class Captioner(Protocol):
    def caption(self, image: bytes) -> object: ...


class HashingEmbedder:
    """Stand-in: signed counts of hashed words, scaled to length 1."""

    #: Words whose places are kept at once.
    KNOWN = 1 << 18

    def __init__(self, size: int = 64) -> None:
        self.size = size
        self.known: dict[str, int] = {}

    def place(self, word: str) -> int:
        """Twice the word's place, and one more where it counts as -1."""
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
        if len(self.known) >= self.KNOWN:
            self.known.clear()
        at = self.known[word] = 2 * (h % self.size) + (0 if h >> 63 else 1)
        return at

    def embed(self, texts: list[str]) -> np.ndarray:
        known = self.known
        places = [[known[w] if w in known else self.place(w) for w in t.lower().split()] for t in texts]
        at = np.fromiter(chain.from_iterable(places), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(p) for p in places])
        out = np.bincount(row * self.size + (at >> 1), 1.0 - 2.0 * (at & 1), len(texts) * self.size).reshape(len(texts), self.size)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "text", prefix: str = "", batch: int = 32, into: str = "embedding") -> DataFrame:
    """rows with the text's vector; a null text has none. The model is set up once a task."""

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in batches:
            full = [prefix + t for t in s.to_pylist() if t is not None]
            found = [np.asarray(embedder.embed(full[a : a + batch]), np.float32) for a in range(0, len(full), batch)]
            values = np.concatenate(found) if found else np.zeros((0, 0), np.float32)
            held = s.is_valid().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(held * values.shape[1])])
            # A place without a value marks a list that is null.
            starts = pa.array(ends, pa.int32(), mask=np.append(~held, False))
            yield pa.ListArray.from_arrays(starts, pa.array(values.reshape(-1), pa.float32()))

    return rows.withColumn(into, run(F.col(text)))


def overlap_score(question: Column, text: Column) -> Column:
    """Stand-in for a reranker: the share of the question's words that the text holds."""
    q = F.array_distinct(tokens(question))
    return F.round(F.size(F.array_intersect(q, tokens(text))) / F.greatest(F.size(q), F.lit(1)), 6)


def reranked(candidates: DataFrame, keep: int = 5, score: Column | None = None, question: str = "question", text: str = "text_content") -> DataFrame:
    """The `keep` best candidates (qid, rrf_rank) of each query by score, with rank; equals stay in order of rrf_rank."""
    scored = candidates.withColumn("cross_encoder_score", overlap_score(F.col(question), F.col(text)) if score is None else score)
    order = Window.partitionBy("qid").orderBy(F.desc("cross_encoder_score"), "rrf_rank")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def passed_through(candidates: DataFrame, keep: int = 5) -> DataFrame:
    """The first `keep` candidates (qid, rrf_rank) as they stand, with rank: a reranker that changes nothing."""
    return candidates.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rrf_rank"))).filter(F.col("rank") <= keep)


def reranked_by(candidates: DataFrame, reranker: Reranker, keep: int = 5, question: str = "question", text: str = "text_content") -> DataFrame:
    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(list(zip(q, t))))

    return reranked(candidates, keep, run(F.col(question), F.col(text)), question, text)


def first_sentence(text: Column, label: Column) -> Column:
    """Stand-in for a generator: the first context's first sentence with its label, or the refusal."""
    sentence = F.btrim(F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1))
    return F.when(F.coalesce(sentence, F.lit("")) == "", F.lit(REFUSAL)).otherwise(F.concat(sentence, F.lit(" ("), label, F.lit(")")))


def captioned(images: DataFrame, captioner: Captioner, image: str = "content") -> DataFrame:
    """images with caption (the plain text of the reply) and failure; an image whose call fails does not stop the others."""

    @F.pandas_udf("struct<caption:string,failure:string>")
    def run(data: pd.Series) -> pd.DataFrame:
        out = []
        for x in data:
            try:
                out.append((plain_text(captioner.caption(x)).strip(), None))
            except Exception as e:  # noqa: BLE001 - whatever a model raises concerns its image alone
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["caption", "failure"])

    return images.withColumn("c", run(F.col(image))).select(*images.columns, "c.caption", "c.failure")


#: Headings of the parts of a judge's prompt, and what each metric asks. The wording is this engine's own.
TASKS = {
    "context_precision": ("Question", "Contexts", "How much of the contexts helps to answer the question?"),
    "context_recall": ("Reference answer", "Contexts", "How many of the facts of the reference answer stand in the contexts?"),
    "faithfulness": ("Answer", "Contexts", "How many of the answer's statements are supported by the contexts?"),
    "answer_correctness": ("Answer", "Reference answer", "How far does the answer agree with the reference answer?"),
}
_FORM = "Reply in two lines:\nSCORE: <a number from 0.00 to 1.00>\nREASON: <one short sentence>"
#: Contexts that the judge of precision sees.
PRECISION_CONTEXTS = 3


def judge_prompts(rows: DataFrame) -> DataFrame:
    """(qid, metric, prompt): four prompts for each row (qid, question, contexts, answer, ground_truth_answer)."""
    few = F.array_join(F.slice("contexts", 1, PRECISION_CONTEXTS), "\n\n")
    parts = {"Question": F.col("question"), "Answer": F.col("answer"), "Reference answer": F.col("ground_truth_answer"), "Contexts": F.array_join("contexts", "\n\n")}

    def prompt(metric: str) -> Column:
        first, second, task = TASKS[metric]
        pieces = [F.lit(f"## {first}\n"), parts[first], F.lit(f"\n\n## {second}\n"), few if metric == "context_precision" else parts[second], F.lit(f"\n\n## Task\nYou judge answers strictly. {task}\n{_FORM}")]
        if metric == "context_recall":
            pieces = [F.lit("## Question\n"), parts["Question"], F.lit("\n\n"), *pieces]
        return F.concat(*(F.coalesce(p, F.lit("")) for p in pieces))

    asked = F.array(*(F.struct(F.lit(m).alias("metric"), prompt(m).alias("prompt")) for m in TASKS))
    return rows.select("qid", F.explode(asked).alias("p")).select("qid", "p.*")


class OverlapJudge:
    """Stand-in for a judge: the share of the first part's words that the second holds."""

    def reply(self, prompt: str) -> str:
        parts = [p.split("\n", 1)[-1] for p in ("\n" + prompt).split("\n## ")[1:]]
        first, second = (set(p.lower().split()) for p in parts[-3:-1])
        return f"SCORE: {len(first & second) / max(len(first), 1):.2f}\nREASON: shared words"


def judge_replies(prompts: DataFrame, judge: Judge) -> DataFrame:
    """prompts with reply; null where the call fails, which scores nothing."""

    @F.pandas_udf("string")
    def run(asked: pd.Series) -> pd.Series:
        out: list = []
        for p in asked:
            try:
                out.append(plain_text(judge.reply(p)))
            except Exception:  # noqa: BLE001 - whatever a model raises concerns its prompt alone
                out.append(None)
        return pd.Series(out, dtype=object)

    return prompts.withColumn("reply", run("prompt"))


def generated(rows: DataFrame, generator: Generator, question: str = "question", context: str = "context", tries: int = 1, wait: float = 1.0) -> DataFrame:
    """rows with answer, failure, seconds, attempts and tokens_used: a question whose call fails `tries` times has no answer and does not stop the others.

    Between tries it waits, twice as long each time. tokens_used is about what went in and came out, four letters a token.
    """

    @F.pandas_udf("struct<answer:string,failure:string,seconds:double,attempts:int,tokens_used:long>")
    def run(q: pd.Series, c: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(q, c):
            began, answer, failure = time.monotonic(), None, None
            for n in range(1, tries + 1):
                try:
                    answer, failure = plain_text(generator.answer(x, y or "")), None
                    break
                except Exception as e:  # noqa: BLE001 - whatever a model raises concerns its question alone
                    failure = f"{type(e).__name__}: {e}"
                    if n < tries:
                        time.sleep(wait * 2 ** (n - 1))
            size = len(x or "") + len(y or "") + len(answer or "")
            out.append((answer, failure, time.monotonic() - began, n, size // 4))
        return pd.DataFrame(out, columns=["answer", "failure", "seconds", "attempts", "tokens_used"])

    made = rows.withColumn("g", run(F.col(question), F.col(context)))
    return made.select(*rows.columns, "g.answer", "g.failure", "g.seconds", "g.attempts", "g.tokens_used")


def caption_job(images: DataFrame, captioner: Captioner, path: str, key: str = "image_id", batches: int = 16) -> DataFrame:
    """Captions the images that path has no caption of yet, batch by batch; (status, n): known before, captioned, failed, left without a caption.

    A batch counts once it is written, so a run that stops is taken up where it stopped. Failures are written beside, with their reason, and tried again by the next run.
    """
    spark = images.sparkSession

    def done() -> DataFrame:
        try:
            return spark.read.parquet(f"{path}/captions").select(key)
        except AnalysisException:
            return images.select(key).limit(0)

    before, failed = done().count(), 0
    name = uuid.uuid4().hex
    for n in range(batches):
        todo = images.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == n).join(done(), key, "left_anti")
        if not todo.limit(1).count():
            continue
        # Written before it is split, so that no image is asked about twice.
        found = stored(captioned(todo, captioner).select(key, "caption", "failure"), "captioned")
        found.filter("failure IS NOT NULL").write.mode("append").parquet(f"{path}/failures/run={name}")
        found.filter("failure IS NULL").select(key, "caption").write.mode("append").parquet(f"{path}/captions")
        failed += found.filter("failure IS NOT NULL").count()
    after = done().count()
    return spark.createDataFrame([("known", before), ("captioned", after - before), ("failed", failed), ("left", images.count() - after)], "status string, n long")
