"""Vector search by cosine similarity, exact or through hashed buckets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.lexical import top_k

#: Queries that meet a block of the corpus at once, and rows of such a block: with vectors of 1024 doubles 8 MB and 64 MB.
BLOCK, CORPUS_BLOCK, LEAST_BLOCKS = 1024, 8192, 8
#: Buckets that a query looks at in each of the tables, of 256 with 8 planes.
PROBES = 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; 0 where one is all zeros."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zeros stay."""
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1)


def nearest(corpus: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(doc_id, score) of the k rows most like one vector; Spark keeps k rows a task and merges them."""
    scored = corpus.select(F.col(key).alias("doc_id"), F.round(cosine(F.col(vector), F.lit([float(x) for x in query])), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def _table_rows(column: pa.ChunkedArray, n: int) -> np.ndarray:
    held = column.combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    return held.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, equals in order of id."""
    at = np.arange(len(ids)) if len(ids) <= 4 * k else np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def block_join(corpus: DataFrame, queries: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, n_corpus: int, n_queries: int, key: str) -> DataFrame:
    """run(block of corpus, group of queries) for all pairs of these: a block is shuffled once for each group of queries, a query once for each block.

    The plan is the same whatever the number of queries; nothing goes through the driver.
    """
    blocks, groups = max(LEAST_BLOCKS, -(-n_corpus // CORPUS_BLOCK)), max(1, -(-n_queries // BLOCK))
    left = corpus.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("_group", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int")).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = right.select(*(F.col(c).alias(c if c not in ("_block", "_group") else f"{c}_q") for c in right.columns))

    empty = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}[t]) for n, t in (f.split(" ") for f in schema.split(", "))]).empty_table()
    return left.groupBy("_block", "_group").cogroup(right.groupBy("_block_q", "_group_q")).applyInArrow(lambda l, r: run(l, r) if l.num_rows and r.num_rows else empty, schema)


def nearest_each(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "qid") -> DataFrame:
    """(qid, doc_id, score, rank) of the k rows most like each query vector.

    Groups of queries meet blocks of the corpus; each keeps k rows a query, so what is ranked is k rows a query and block.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).cast("long").alias("qid"), F.col(vector).alias("asked"))
    held = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(vector).alias("held"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("doc_id").to_numpy(), right.column("qid").to_numpy()
        scores = np.round(_unit(_table_rows(right.column("asked"), len(qids))) @ _unit(_table_rows(left.column("held"), len(ids))).T, 6) + 0.0
        at = [best_rows(s, ids, k) for s in scores]
        return pa.table({"qid": np.repeat(qids, [len(a) for a in at]), "doc_id": ids[np.concatenate(at)], "score": np.concatenate([s[a] for s, a in zip(scores, at)])})

    return top_k(block_join(held, asked, run, "qid long, doc_id long, score double", held.count(), asked.count(), "doc_id"), k)


def _normals(planes: int, tables: int, dimension: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(tables, planes, dimension))


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)


def hashed(corpus: DataFrame, planes: int = 8, tables: int = 8, dimension: int = 64, seed: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, vector, buckets): each vector's bucket of random hyperplanes in each table, an approximate index."""
    normals = _normals(planes, tables, dimension, seed)

    def run(batches):
        for b in batches:
            if b.num_rows:
                signs = np.einsum("tpd,nd->ntp", normals, _rows(b.column(1), b.num_rows)) > 0
                buckets = signs @ (1 << np.arange(planes, dtype=np.int32))
                ends = pa.array(np.arange(0, buckets.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(buckets.reshape(-1), pa.int32()))], [key, vector, "buckets"])

    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector)
    kind = corpus.schema[vector].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` long, `{vector}` {kind}, buckets array<int>")


def probed(vectors: np.ndarray, normals: np.ndarray, probes: int) -> np.ndarray:
    """Boolean [vector, table, bucket]: the `probes` buckets of each table that a vector is nearest to.

    A bucket is as far as the squared distances to the planes between add up to, so the own bucket comes first.
    """
    planes = normals.shape[1]
    side = np.arange(1 << planes)[:, None] >> np.arange(planes) & 1
    out = np.zeros((len(vectors), len(normals), 1 << planes), bool)
    for t, own in enumerate(normals):
        away = vectors @ (own / np.linalg.norm(own, axis=1, keepdims=True)).T
        # The squares of the planes on whose other side the bucket lies.
        far = np.where(away > 0, away**2, 0) @ (1 - side).T + np.where(away > 0, 0, away**2) @ side.T
        np.put_along_axis(out[:, t], np.argsort(far, axis=1, kind="stable")[:, :probes], True, 1)
    return out


def nearest_hashed(index: DataFrame, queries: DataFrame, k: int, probes: int = PROBES, planes: int = 8, tables: int = 8, dimension: int = 64, seed: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, doc_id, score, rank) among the rows of index (from `hashed`) that lie in a probed bucket of some table.

    Queries meet blocks of the index as in `nearest_each`; only rows in probed buckets are scored. A vector of zeros scores 0.
    """
    normals = _normals(planes, tables, dimension, seed)
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("qid"), F.col(vector).alias("asked"))
    held = index.select(F.col(key).alias("doc_id"), F.col(vector).alias("held"), "buckets")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, qids = left.column("doc_id").to_numpy(), right.column("qid").to_numpy()
        unit, rows = _unit(_table_rows(right.column("asked"), len(qids))), _unit(_table_rows(left.column("held"), len(ids)))
        buckets = _table_rows(left.column("buckets"), len(ids)).astype(np.int64)
        wanted = probed(unit, normals, probes)
        met = np.zeros((len(qids), len(ids)), bool)
        for t in range(buckets.shape[1]):
            met |= wanted[:, t][:, buckets[:, t]]
        found = []
        for q in range(len(qids)):
            at = np.flatnonzero(met[q])
            s = np.round(rows[at] @ unit[q], 6) + 0.0
            best = best_rows(s, ids[at], k) if len(at) else np.zeros(0, np.int64)
            found.append((np.full(len(best), qids[q]), ids[at[best]], s[best]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("qid", "doc_id", "score"), zip(*found))})

    return top_k(block_join(held, asked, run, "qid long, doc_id long, score double", held.count(), asked.count(), "doc_id"), k)
