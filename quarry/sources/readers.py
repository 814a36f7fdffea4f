"""Tables, JSON lines, JSON documents and binary files as DataFrames."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "id string, text string, chunk_type string, category string, service_name string, concept_group string, page_start int, page_end int, source_urls array<string>, parent_id string"
TRUTH_SCHEMA = "question_id string, question string, ground_truth_answer string, expected_service string, category string, query_type string"
BATCH_SCHEMA = "type string, question string, ground_truth_answer string, expected_parent_ids array<string>, expected_page_numbers array<int>"
SERVICE_SCHEMA = "struct<name:string,description:string,page_start:int,page_end:int,source_urls:array<string>,record_type:string,concept_group:string>"
STRUCTURE_SCHEMA = (
    f"source_document string, page_count int, categories array<struct<name:string,page_start:int,page_end:int,services:array<{SERVICE_SCHEMA}>,"
    f"image_caption:array<struct<page:int,image_path:string,caption:string>>>>, concepts array<{SERVICE_SCHEMA}>, "
    "tables array<struct<title:string,page_start:int,page_end:int,headers:array<string>,rows:array<array<string>>,markdown:string,shape:string>>"
)


#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that go to a Python worker at once, which bounds its memory; a longer text still goes whole."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    try:
        spark.conf.set(size, str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 - a Spark without this setting has the row bound alone
        pass


def trimmed() -> None:
    """Gives memory that a Python worker no longer needs back to the system; idle workers would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def tidy(run):
    """run, a function of batches, that gives its memory back when a task ends."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            trimmed()

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, a missing path is an AnalysisException."""
    return spark.read.schema(schema).json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole file as one JSON object or array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, in the order given; FileNotFoundError if none does. Any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def services_of(structure: DataFrame) -> DataFrame:
    """(category, name, description, page_start, page_end, source_urls, record_type) of a structure document's services."""
    return structure.select(F.explode("categories").alias("c")).select(F.col("c.name").alias("category"), F.explode("c.services").alias("s")).select("category", "s.*")


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def decoded(files: DataFrame, decode: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Records that a decoder finds in each file (pages, lines, images), one row each with path and error.

    A file that cannot be read is one row with its error; the others are not affected.
    """
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rows += [{"path": path, "error": None, **r} for r in decode(bytes(content))]
                except Exception as e:  # noqa: BLE001 - the error is data
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "error", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def markdown_document(pages: DataFrame, front_pages: int = 10) -> DataFrame:
    """(document, text): the cleaned pages (document, page, text) after the front matter in order, each after its page mark; empty pages go."""
    from quarry.functions.text import clean_page, stripped

    kept = pages.filter(F.col("page") > front_pages).withColumn("text", stripped(clean_page(F.col("text")))).filter("text <> ''")
    entry = F.struct("page", F.concat(F.lit("<!-- PAGE_"), "page", F.lit(" -->\n"), "text").alias("t"))
    return kept.groupBy("document").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["t"]), "\n\n").alias("text"))
