"""Command line: build an index, ask it questions, evaluate it.

    python -m quarry build --documents docs.parquet --index index
    python -m quarry add --documents more.parquet --index index
    python -m quarry delete --index index 17 23
    python -m quarry compact --index index
    python -m quarry ask --index index "a question" ["another"]
    python -m quarry chat --index index
    python -m quarry evaluate --index index --dataset questions.json
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.config import Config, load_config
from quarry.operators import evaluate, models, trained
from quarry.plans import retrieval
from quarry.session import session
from quarry.sources import readers, sinks
from quarry.sources.segments import Index


def build(spark: SparkSession, documents: str, index: str, config: Config = Config(), add: bool = False) -> int:
    """Makes the index of the documents (doc_id, text), or with add puts them to those it has: parents, embedded children, postings; returns the number of live children."""
    with sinks.scratch(spark):
        own, docs = Index.opened_or_empty(spark, index), spark.read.parquet(documents)
        if not add or not own.version.segments:
            # Trained on what the index is made of; what is added later is embedded alike.
            trained.train(docs, size=config.embedding_size).save(spark, f"{index}/embedder")
        parents, children = retrieval.build(docs, embedder(spark, index, config), config)
        return (own.add if add else own.replace)(parents, children).version.n


def embedder(spark: SparkSession, index: str, config: Config = Config()) -> models.Embedder:
    """The index's own trained embedder; hashed words for an index that has none, as one that a stream began."""
    try:
        return trained.SvdEmbedder.load(spark, f"{index}/embedder")
    except AnalysisException:
        return models.HashingEmbedder(config.embedding_size)


def delete(spark: SparkSession, index: str, documents: list[str]) -> int:
    """Takes documents (by doc_id) out of the index; returns the number of live children."""
    rows = spark.createDataFrame([(d,) for d in documents], "source string")
    return Index.opened(spark, index).delete(rows, "source").version.n


def opened(spark: SparkSession, index: str, config: Config = Config(), sparse: str = "bm25") -> retrieval.Retriever:
    """A retriever over one version of the stored index; nothing is indexed again."""
    own = Index.opened(spark, index)
    return retrieval.Retriever(own.parents(), own.children(), embedder(spark, index, config), config, index=own.bm25() if sparse == "bm25" else own.fulltext(), sparse=sparse)


def ask(retriever: retrieval.Retriever, questions: list[str]) -> list[str]:
    """An answer with its sources for each question that is not blank."""
    full = [(i, q.strip()) for i, q in enumerate(questions) if q.strip()]
    if not full:
        return []
    spark = retriever.children.sparkSession
    with sinks.scratch(spark):
        found = {r["qid"]: r for r in retriever.answer(spark.createDataFrame(full, "qid long, question string")).collect()}
    return ["\n".join(x for x in (found[i]["answer"] or f"failed: {found[i]['failure']}", found[i]["sources"]) if x) for i, _ in full]


def evaluated(spark: SparkSession, index: str, dataset: str, config: Config = Config(), limit: int | None = None, sparse: str = "bm25") -> str:
    """The scorecard of a dataset's questions (all, or the first `limit` by text), as text."""
    asked = readers.json_document(spark, dataset, readers.BATCH_SCHEMA).withColumn("qid", F.xxhash64("question"))
    asked = asked if limit is None else asked.orderBy("question").limit(limit)
    with sinks.scratch(spark):
        metrics = sinks.stored(opened(spark, index, config, sparse).evaluate(asked), "metrics")
        return evaluate.scorecard_text(evaluate.scorecard(metrics)).first()["scorecard"]


def repl(answer: Callable[[str], str], read: Callable[[str], str] = input, write: Callable[[str], None] = print) -> int:
    """Answers questions until `exit`, `quit` or the end of the input; returns how many were answered.

    Blank lines are passed over. A question that fails is reported and does not count.
    """
    n = 0
    while True:
        try:
            question = read(f"[{n + 1}] > ").strip()
        except (EOFError, KeyboardInterrupt):
            break
        if question.lower() in ("exit", "quit"):
            break
        if not question:
            continue
        try:
            write(answer(question))
        except Exception as e:  # noqa: BLE001 - the next question may do better
            limited = any(x in str(e).lower() for x in ("429", "quota", "rate limit"))
            write("The model is busy; wait a little and ask again." if limited else f"failed: {type(e).__name__}: {e}")
            continue
        n += 1
    return n


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, options in {"build": ("--documents", "--index"), "add": ("--documents", "--index"), "ask": ("--index",), "chat": ("--index",), "delete": ("--index",), "compact": ("--index",), "evaluate": ("--index", "--dataset")}.items():
        command = commands.add_parser(name)
        command.add_argument("--config")
        for option in options:
            command.add_argument(option, required=option != "--index")
        if name in ("ask", "chat", "evaluate"):
            command.add_argument("--sparse", choices=["bm25", "fulltext"], default="bm25")
        if name == "ask":
            command.add_argument("questions", nargs="+")
        if name == "delete":
            command.add_argument("documents", nargs="+")
        if name == "evaluate":
            command.add_argument("--limit", type=int)
    given = parser.parse_args(args)
    config = load_config(given.config)
    index = given.index or config.index_path
    spark = SparkSession.getActiveSession() or session()
    if given.command in ("build", "add"):
        print(f"{build(spark, given.documents, index, config, given.command == 'add')} children")
    elif given.command == "delete":
        print(f"{delete(spark, index, given.documents)} children")
    elif given.command == "compact":
        print(f"{Index.opened(spark, index).compact().version.n} children")
    elif given.command == "ask":
        print("\n\n".join(ask(opened(spark, index, config, given.sparse), given.questions)))
    elif given.command == "chat":
        retriever = opened(spark, index, config, given.sparse)
        repl(lambda q: "\n".join(ask(retriever, [q])))
    else:
        print(evaluated(spark, index, given.dataset, config, given.limit, given.sparse))
    return 0


if __name__ == "__main__":
    sys.exit(main())
