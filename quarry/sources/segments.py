"""An index that changes: immutable segments, tombstones and a list of versions.

    <path>/versions            one JSON row a version: its number, segments, tombstones and statistics
    <path>/segments/<name>/    parents, children, postings and lexemes of some documents, never changed
    <path>/dead/<name>/        what a change took out of earlier segments: parents, children
    <path>/terms/<name>        frequency of every term over all live children

A version counts once its row is written, after all it names; a run that dies leaves the version before. A reader looks the newest version
up once, in `Index.opened`, and takes everything from that. One writer at a time. A document that is added again replaces its
earlier parents and children. `compact` writes all that lives into one segment. Search results after any changes are those of an index
made anew from the live rows: frequencies and lengths are merged over segments less what is dead.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.functions.text import tokens
from quarry.operators import lexical, postings

_ROW = "number long, at double, segments array<string>, dead array<string>, terms string, n long, words double"


class Version(NamedTuple):
    number: int
    segments: tuple[str, ...]
    dead: tuple[str, ...]
    terms: str
    n: int
    words: float


class Index:
    """One version of the index at path."""

    def __init__(self, spark: SparkSession, path: str, version: Version) -> None:
        self.spark, self.path, self.version = spark, path, version

    @classmethod
    def opened(cls, spark: SparkSession, path: str) -> Index:
        """The newest version. ValueError where there is none."""
        try:
            last = spark.read.schema(_ROW).json(f"{path}/versions").orderBy(F.desc("number"), F.desc("at")).first()
        except AnalysisException:
            last = None
        if last is None:
            raise ValueError(f"no index at {path}")
        return cls(spark, path, Version(last["number"], tuple(last["segments"]), tuple(last["dead"]), last["terms"], last["n"], last["words"]))

    @classmethod
    def opened_or_empty(cls, spark: SparkSession, path: str) -> Index:
        try:
            return cls.opened(spark, path)
        except ValueError:
            return cls(spark, path, Version(0, (), (), "", 0, 0.0))

    # Reading

    def _segments(self, table: str) -> DataFrame:
        """A table's rows of all segments, the dead ones too, with `segment`."""
        parts = [self.spark.read.parquet(f"{self.path}/segments/{s}/{table}").withColumn("segment", F.lit(s)) for s in self.version.segments]
        if not parts:
            raise ValueError(f"the index at {self.path} is empty")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def _dead(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/dead/{d}/{table}") for d in self.version.dead]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def _live(self, table: str) -> DataFrame:
        rows = self._segments(table)
        return rows.join(self._dead(table, "segment string, doc_id string"), ["segment", "doc_id"], "left_anti") if self.version.dead else rows

    def parents(self) -> DataFrame:
        return self._live("parents").drop("segment")

    def children(self) -> DataFrame:
        return self._live("children").drop("segment")

    def _dead_numbers(self) -> DataFrame | None:
        return self._dead("numbers", "block long, nos array<int>") if self.version.dead else None

    def bm25(self) -> lexical.Bm25Index:
        """BM25 over the live children by child_no, from stored postings."""
        sizes = self.spark.createDataFrame([(self.version.n, self.version.words)], "n long, words double")
        return lexical.Bm25Index.opened(self._segments("postings").drop("segment"), self.spark.read.parquet(f"{self.path}/terms/{self.version.terms}"), sizes, self._dead_numbers())

    def fulltext(self) -> lexical.FulltextIndex:
        return lexical.FulltextIndex.opened(self._segments("lexemes").drop("segment"), self._dead_numbers())

    # Changing

    def _commit(self, segments: tuple[str, ...], dead: tuple[str, ...], terms: DataFrame, n: int, words: float) -> Index:
        name = f"terms-{uuid.uuid4().hex}"
        terms.filter("df > 0").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{self.path}/terms/{name}")
        row = (self.version.number + 1, time.time(), list(segments), list(dead), name, n, float(words))
        self.spark.createDataFrame([row], _ROW).coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return Index(self.spark, self.path, Version(row[0], segments, dead, name, n, float(words)))

    def _write_segment(self, name: str, parents: DataFrame, children: DataFrame) -> tuple[DataFrame, int, float]:
        """Writes a segment; (term, df), documents and words of it. What an interrupted try left is overwritten."""
        folder = f"{self.path}/segments/{name}"
        parents.write.mode("overwrite").parquet(f"{folder}/parents")
        children.withColumn("child_no", F.xxhash64("doc_id")).write.mode("overwrite").parquet(f"{folder}/children")
        parents, children = (self.spark.read.parquet(f"{folder}/{t}") for t in ("parents", "children"))
        orphans = children.join(parents, children["parent_id"] == parents["doc_id"], "left_anti").limit(1).count()
        if orphans:
            raise ValueError("a child's parent_id is no parent's doc_id")
        for table, renamed, places in (("postings", None, False), ("lexemes", lexical.lexeme, True)):
            rows = postings.build(children, "child_no", "text_content", renamed, places, name)
            # In the order of terms, so a search reads few row groups.
            rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/{table}")
        terms, sizes = lexical.statistics(self.spark.read.parquet(f"{folder}/postings"))
        size = sizes.first()
        return terms, size["n"] or 0, size["words"] or 0.0

    def _terms(self) -> DataFrame:
        if not self.version.terms:
            return self.spark.createDataFrame([], "term string, df long")
        return self.spark.read.parquet(f"{self.path}/terms/{self.version.terms}")

    def _buried(self, gone: DataFrame) -> tuple[str, DataFrame, int, float]:
        """Writes the tombstones of parents (segment, doc_id); their name, and (term, df), documents and words of their children."""
        name = f"dead-{uuid.uuid4().hex}"
        folder = f"{self.path}/dead/{name}"
        gone.select("segment", "doc_id").distinct().write.parquet(f"{folder}/parents")
        gone = self.spark.read.parquet(f"{folder}/parents").withColumnRenamed("doc_id", "parent_id")
        lost = self._live("children").join(gone, ["segment", "parent_id"]).select("segment", "doc_id", "child_no", tokens(F.col("text_content")).alias("words"))
        lost.write.parquet(f"{folder}/children")
        lost = self.spark.read.parquet(f"{folder}/children")
        heads = self._segments("postings").filter("term IS NULL").select("segment", "block", F.posexplode("ids").alias("no", "child_no"))
        heads.join(lost.select("segment", "child_no"), ["segment", "child_no"]).groupBy("block").agg(F.collect_list("no").alias("nos")).write.parquet(f"{folder}/numbers")
        terms = lost.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        size = lost.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
        return name, terms, size["n"], float(size["words"] or 0)

    def replace(self, parents: DataFrame, children: DataFrame) -> Index:
        """The next version, with these parents and children (embedded) alone."""
        name = f"segment-{uuid.uuid4().hex}"
        terms, n, words = self._write_segment(name, parents, children)
        return self._commit((name,), (), terms, n, words)

    def add(self, parents: DataFrame, children: DataFrame, segment: str | None = None) -> Index:
        """The next version, with these parents and children (embedded) too, in a segment of their own.

        Live parents of the same `source`, or where they have none of the same doc_id, go with their children. A segment named before is in the index already:
        nothing changes, so a batch that is tried again counts once.
        """
        name = segment or f"segment-{uuid.uuid4().hex}"
        if name in self.version.segments:
            return self
        terms, n, words = self._write_segment(name, parents, children)
        new = self.spark.read.parquet(f"{self.path}/segments/{name}/parents")
        dead, both = self.version.dead, [self._terms(), terms]
        total_n, total_words = self.version.n + n, self.version.words + words
        if self.version.segments:
            key = "source" if "source" in new.columns else "doc_id"
            old = self._live("parents").select("segment", "doc_id", *({key} - {"doc_id"})).join(new.select(key).distinct(), key, "left_semi")
            if old.limit(1).count():
                tomb, lost, lost_n, lost_words = self._buried(old)
                dead, total_n, total_words = (*dead, tomb), total_n - lost_n, total_words - lost_words
                both.append(lost.select("term", (-F.col("df")).alias("df")))
        merged = reduce(DataFrame.unionByName, both).groupBy("term").agg(F.sum("df").alias("df"))
        return self._commit((*self.version.segments, name), dead, merged, total_n, total_words)

    def delete(self, ids: DataFrame, key: str = "doc_id") -> Index:
        """The next version, without the parents of these ids (doc_id, or `source`) and all that is made from them."""
        asked = ids.select(F.col(key).cast("string").alias("asked")).distinct()
        gone = self._live("parents").join(asked, F.col(key).cast("string") == F.col("asked"), "left_semi")
        if not gone.limit(1).count():
            return self
        tomb, lost, n, words = self._buried(gone)
        merged = self._terms().unionByName(lost.select("term", (-F.col("df")).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        return self._commit(self.version.segments, (*self.version.dead, tomb), merged, self.version.n - n, self.version.words - words)

    def compact(self) -> Index:
        """The next version, with all that lives in one segment and no tombstones; older versions can still be read."""
        return self.replace(self.parents(), self.children().drop("child_no"))
