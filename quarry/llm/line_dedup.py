"""Line dedup: explode normalised lines, hash, count distinct documents, drop, reassemble by position.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends and with A-Z lower-cased.
A key of at least `min_chars` code points that at least `min_docs` documents hold loses all
its lines but those of the largest doc_id that holds it.

Null or empty text is one empty line. Rows that share a doc_id count as one document, and
each such row keeps the key's lines if that doc_id is the largest. A null doc_id counts as
one document below all others. An empty table gives an empty result; other columns, whatever
their names, do not matter.

Plan: only 16-byte hashes and ids are exploded; two aggregations that combine before their
shuffle find the repeated keys, so a line in every document is no hot spot; the join back
to (document, hash) rows is a sort-merge join that adaptive execution may split. A text
crosses one shuffle, to meet the hashes that its document loses.
A text of any length is cut into all its lines, within one row of one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, doc_key, tidy, written

_ENDS = b" \t\n\x0b\x0c\r"


def _key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of the line's key; None for a key that is too short. bytes.lower() lowers A-Z alone."""
    k = line.strip(_ENDS)
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(k.lower(), digest_size=16).digest()


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def line_keys(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, line_hash): each key of each document once."""

    def run(batches):
        for b in batches:
            keys, hashes = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {_key(x, min_chars) for x in _lines(text)}
                own.discard(None)
                keys += [key] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.binary())], ["key", "line_hash"])

    return docs.select(doc_key().alias("key"), "text").mapInArrow(tidy(run), "key long, line_hash binary")


def lost_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(key, lost): for each document that loses lines, the hashes of their keys."""
    held = line_keys(docs, min_chars)
    repeated = (
        held.groupBy("line_hash", "key").agg(F.lit(1).alias("one"))
        .groupBy("line_hash").agg(F.count("*").alias("n"), F.max("key").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("line_hash", "keeper")
    )
    # Written, so that the join has a shuffle of its own on both sides, which Spark can split where a line is in many documents.
    repeated = written(repeated, "lines")
    lost = held.join(repeated, "line_hash").filter(F.col("key") != F.col("keeper"))
    return lost.groupBy("key").agg(F.collect_set("line_hash").alias("lost"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The columns of docs, text without the lost lines, and n_lines, n_dropped (longs).

    A null text stays null.
    """
    return _applied(docs, lost_lines(docs, min_chars, min_docs), min_chars, digest=False)


def with_length(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where it is there, brought in line with text; null text keeps its n_chars."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def line_digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of the kept text."""
    return _applied(docs.select("doc_id", "text"), lost_lines(docs, min_chars, min_docs), min_chars, digest=True)


def _applied(docs: DataFrame, lost: DataFrame, min_chars: int, digest: bool) -> DataFrame:
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at_id, at_text = names.index("doc_id"), names.index("text")
    joined = plain.withColumn("key", F.coalesce(F.col(f"c{at_id}").cast("long"), F.lit(NULL_ID)))
    joined = joined.join(lost, "key", "left").select(*plain.columns, "lost")
    kept_fields = [plain.schema[f"c{at_id}"]] if digest else list(plain.schema)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept_fields)
    schema += ", n_lines long, n_dropped long" + ", kept_sha256 string" * digest

    def run(batches):
        for b in batches:
            out, total, dropped = [], [], []
            for text, lost_here in zip(b.column(at_text).to_pylist(), b.column(len(names)).to_pylist()):
                lines = _lines(text)
                kept = lines
                if lost_here:
                    gone = set(lost_here)
                    kept = [x for x in lines if _key(x, min_chars) not in gone]
                whole = b"\n".join(kept)
                out.append(hashlib.sha256(whole).hexdigest() if digest else None if text is None else whole.decode())
                total.append(len(lines))
                dropped.append(len(lines) - len(kept))
            counts = [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
            if digest:
                arrays = [b.column(at_id), *counts, pa.array(out, pa.string())]
            else:
                arrays = [pa.array(out, pa.string()) if i == at_text else b.column(i) for i in range(len(names))] + counts
            yield pa.RecordBatch.from_arrays(arrays, [x.split(" ")[0] for x in schema_names])

    schema_names = [f.name for f in kept_fields] + ["n_lines", "n_dropped"] + ["kept_sha256"] * digest
    done = joined.mapInArrow(tidy(run), schema)
    if digest:
        return done.withColumnRenamed(f"c{at_id}", "doc_id")
    return done.toDF(*names, "n_lines", "n_dropped")
