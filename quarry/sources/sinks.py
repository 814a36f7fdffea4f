"""Where results go: index tables, JSON lines, text, and appends that can be taken up again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from quarry.operators.fusion import first_occurrence


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the one set on the context.

    Only where all run in one process, as in tests, a local folder stands in; elsewhere a missing setting is a ValueError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if context.master != "local" and not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


#: Tables stored within each open `scratch`.
_SCRATCH: list[list[str]] = []


def stored(rows: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """rows as a Parquet table in the shared folder, read back from there: made once, lineage cut, and a lost executor does not cost it."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    (rows.write.option("compression", codec) if codec else rows.write).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are deleted at the end: for results that are taken in before it."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_json_documents(rows: DataFrame, path: str) -> None:
    """Each row as one indented JSON document, null fields kept."""
    json = F.to_json(F.struct(*rows.columns), {"pretty": "true", "ignoreNullFields": "false"})
    rows.select(json.alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def write_text(rows: DataFrame, path: str, column: str = "text") -> None:
    rows.select(column).write.mode("overwrite").text(path)


def upsert(rows: DataFrame, path: str, order: str, key: str = "id") -> DataFrame:
    """The table at path with rows put in by key, new ones before old; of a key's rows the one with the greatest `order` counts. The caller writes it."""
    spark = rows.sparkSession
    newest = first_occurrence(rows, [key], [F.desc(order)])
    try:
        old = spark.read.parquet(path)
    except AnalysisException:
        return newest
    both = newest.withColumn("_age", F.lit(0)).unionByName(old.withColumn("_age", F.lit(1)))
    return first_occurrence(both, [key], ["_age"]).drop("_age")


def append_missing(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Appends the rows whose keys are not at path yet, so a stopped run can be taken up; returns how many."""
    spark = rows.sparkSession
    try:
        todo = rows.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    except AnalysisException:
        todo = rows
    before = spark.read.parquet(path).count() if todo is not rows else 0
    todo.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def audit(expected: DataFrame, stored: DataFrame, key: str = "id") -> DataFrame:
    """One row: expected, stored, missing (expected but not stored) and unexpected ids."""
    e, s = expected.select(F.col(key).alias("k"), F.lit(1).alias("e")).distinct(), stored.select(F.col(key).alias("k"), F.lit(1).alias("s")).distinct()
    both = e.join(s, "k", "full")
    return both.agg(F.count("e").alias("n_expected"), F.count("s").alias("n_stored"), F.count_if(F.col("s").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_unexpected"))
