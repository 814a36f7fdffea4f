"""The life of many questions as one plan: intent, search, fusion, reranking, parents, answers, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions.text import approx_tokens
from quarry.operators import chunking, citations, evaluate, fusion, intent, lexical, models, resolve, trained, vector
from quarry.sources.readers import table
from quarry.sources.sinks import stored


class Retriever:
    """Searches children of an index, (doc_id, parent_id, category, service_name, text_content, embedding), and gives their parents.

    index is a BM25 or, where sparse is `fulltext` and not `bm25`, a full-text index of the children by child_no; without it one is made. reranker, generator and judge are models; without them the offline stand-ins serve.
    """

    def __init__(self, parents: DataFrame, children: DataFrame, embedder: models.Embedder, config: Config = Config(), query_prefix: str = "", index: lexical.Bm25Index | lexical.FulltextIndex | None = None,
                 sparse: str = "bm25", reranker: models.Reranker | None = None, generator: models.Generator | None = None) -> None:
        if sparse not in ("bm25", "fulltext"):
            raise ValueError(f"no such search: {sparse}")
        self.parents, self.config, self.embedder, self.prefix = parents, config, embedder, query_prefix
        self.sparse, self.reranker, self.generator = sparse, reranker, generator
        # Texts meet the hits only after the ranking; scoring reads ids, tokens and vectors.
        self.children = numbered(children)
        self.index = index or (lexical.Bm25Index if sparse == "bm25" else lexical.FulltextIndex)(self.children, "child_no", "text_content")

    def _sparse(self, variants: DataFrame) -> DataFrame:
        c = self.config
        depth = max(c.sparse_depth, c.comparison_depth)
        return self.index.search(variants.select("vq", "text"), depth, "vq")

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """(qid, question, rank, child_id, parent_id, rrf_score, cross_encoder_score, text_content) of the children kept for each question (qid, question)."""
        c = self.config
        asked = intent.intent(questions, "question")
        variants = asked.select("qid", "is_comparison", F.posexplode(F.concat(F.array("question"), "variations")).alias("variant", "text"))
        variants = stored(variants.withColumn("vq", F.xxhash64("qid", "variant")), "variants")
        vectors = models.embedded(variants.select("vq", "text"), self.embedder, prefix=self.prefix)
        dense = vector.nearest_each(self.children.select("child_no", "embedding"), vectors, max(c.dense_depth, c.comparison_depth), "child_no", query_key="vq")
        arms = []
        for hits, usual in ((dense, c.dense_depth), (self._sparse(variants), c.sparse_depth)):
            depth = F.when(F.col("is_comparison"), c.comparison_depth).otherwise(usual)
            met = hits.withColumnRenamed("qid", "vq").join(variants.select("vq", "qid", "variant", depth.alias("depth")), "vq").filter("rank <= depth")
            arms.append(fusion.merged_variants(met.select("qid", "variant", "doc_id", "rank")))
        weights = asked.select("qid", "question", "bm25_weight", "vector_weight")
        dense, sparse = (a.join(weights.select("qid", F.col(w).alias("weight")), "qid") for a, w in zip(arms, ("vector_weight", "bm25_weight")))
        fused = fusion.weighted_rrf(dense, sparse, F.col("dense_weight"), F.col("sparse_weight"), c.rrf_constant, c.rrf_keep)
        fused = fused.select("qid", F.col("doc_id").alias("child_no"), "rrf_score", "rrf_rank")
        texts = self.children.select("child_no", F.col("doc_id").alias("child_id"), "parent_id", "text_content")
        candidates = fused.join(texts, "child_no").join(weights.select("qid", "question"), "qid")
        best = models.reranked(candidates, c.rerank_keep) if self.reranker is None else models.reranked_by(candidates, self.reranker, c.rerank_keep)
        return best.select("qid", "question", "rank", "child_id", "parent_id", "rrf_score", "cross_encoder_score", "text_content")

    def answer(self, questions: DataFrame, hits: DataFrame | None = None) -> DataFrame:
        """(qid, answer, failure, n_parents, context_chars, context_tokens, chunks_used, retrieved_chunks, contexts, sources).

        A question without contexts gets the refusal, one whose model call fails the failure
        and no answer. chunks_used are the parents' ids in order of rank.
        """
        hits = stored(self.retrieve(questions), "hits") if hits is None else hits
        found = resolve.parents(hits.select("qid", "parent_id", "rank"), self.parents)
        chunk = found.withColumn("chunk_type", F.lit("parent")).withColumn("id", F.col("parent_id")).withColumn("concept_group", F.lit(None).cast("string"))
        chunk = chunk.withColumn("page_start", F.lit(0)).withColumn("page_end", F.lit(0)).withColumnRenamed("parent_rank", "rank")
        chunk = stored(chunk.withColumn("label", citations.label()), "contexts")
        fields = [F.col("rank"), F.col("id"), F.col("chunk_type"), F.coalesce("category", F.lit("")).alias("category"), F.coalesce("service_name", F.lit("")).alias("service_name"), F.col("page_start"), F.col("page_end"), F.col("label").alias("citation_label")]
        rows = chunk.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("retrieved_chunks"), F.array_sort(F.collect_list(F.struct("rank", "text_content"))).alias("t"))
        rows = rows.select("qid", F.transform("retrieved_chunks", lambda x: x["id"]).alias("chunks_used"), "retrieved_chunks", F.transform("t", lambda x: x["text_content"]).alias("contexts"))
        asked = questions.join(resolve.context(found), "qid")
        if self.generator is None:
            first = trained.extracted(chunk.join(questions.select("qid", "question"), "qid")).withColumn("failure", F.lit(None).cast("string"))
        else:
            first = models.generated(asked.select("qid", "question", "context"), self.generator).select("qid", "answer", "failure")
        first = stored(first.withColumn("answer", citations.answer_text(F.col("answer"))), "answers")
        cited = citations.cited(chunk.join(first, "qid")).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_label"))).alias("c"))
        cited = cited.select("qid", citations.sources_line(F.transform("c", lambda x: x["citation_label"])).alias("sources"))
        out = questions.join(first, "qid", "left").join(asked.select("qid", "n_parents", "context"), "qid", "left").join(rows, "qid", "left").join(cited, "qid", "left")
        answer = F.when(F.col("failure").isNull(), F.coalesce("answer", F.lit(citations.REFUSAL)))
        return out.select(
            "qid", answer.alias("answer"), "failure", F.coalesce("n_parents", F.lit(0)).alias("n_parents"), F.length("context").alias("context_chars"),
            F.when(F.col("context").isNotNull(), approx_tokens(F.col("context"))).alias("context_tokens"), "chunks_used", "retrieved_chunks", "contexts", F.coalesce("sources", F.lit("")).alias("sources"))

    def evaluate(self, questions: DataFrame, judge: models.Judge | None = None) -> DataFrame:
        """Six metrics, reasons and verdict for each question (qid, question, ground_truth_answer, expected_parent_ids); no judge: the stand-in."""
        hits = stored(self.retrieve(questions.select("qid", "question")), "hits")
        answers = self.answer(questions.select("qid", "question"), hits).select("qid", "answer", "contexts")
        prompts = models.judge_prompts(questions.select("qid", "question", "ground_truth_answer").join(answers, "qid"))
        replies = stored(models.judge_replies(prompts, models.OverlapJudge() if judge is None else judge), "replies")
        expected = questions.select("qid", "expected_parent_ids")
        ranked = hits.join(expected, "qid").select("qid", "rank", evaluate.id_matches(F.col("parent_id"), F.col("expected_parent_ids")).alias("relevant"))
        asked = questions.select("qid", "question", (F.coalesce(F.size("expected_parent_ids"), F.lit(0)) > 0).alias("expects"))
        return evaluate.six_metrics(asked, ranked, replies)


def numbered(children: DataFrame) -> DataFrame:
    """children with child_no, the number that searches know them by."""
    return children.withColumn("child_no", F.xxhash64("doc_id"))


def build(docs: DataFrame, embedder: models.Embedder, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Parents and embedded children of documents (doc_id, text), stored."""
    parents = stored(chunking.parent_chunks(docs, threshold=config.parent_threshold, size=config.parent_chunk_size, overlap=config.parent_chunk_overlap), "parents")
    children = chunking.child_chunks(parents, config.child_chunk_size, config.child_chunk_overlap)
    return parents, stored(models.embedded(children, embedder, "text_content"), "children")


def _retriever(spark: SparkSession, sf_dir: str) -> tuple[Retriever, DataFrame]:
    embedder = models.HashingEmbedder()
    parents, children = build(table(spark, sf_dir, "documents"), embedder)
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    return Retriever(parents, children, embedder), asked


def retrieve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever, asked = _retriever(spark, sf_dir)
    return retriever.retrieve(asked)


def answer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    retriever, asked = _retriever(spark, sf_dir)
    return retriever.answer(asked).select("qid", "answer", "n_parents", "context_chars", "sources")
