"""An approximate vector index that lies on disk: k-means cells, product-quantised codes, exact scores of the survivors.

Cells and codebooks are fit on a bounded sample (SAMPLE rows, the first by a hash of the key); every row is indexed: its cell, a code of one byte for
each part of its residual, and its unit vector, in a file order of cells. A search looks at the `probes` cells nearest to a query, where codes
alone rank the rows; the `rescored` best of each query are scored exactly. Codes are read for probed cells only, vectors for survivors only.
A null vector is not indexed; a vector of zeros scores 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lexical import top_k
from quarry.operators.vector import _rows, _table_rows, _unit
from quarry.sources.sinks import stored

#: Rows that the model is fit on at most, cells at most, entries of a codebook, rounds of k-means, rows of a cell that go through one task.
SAMPLE, CELLS, CODES, ROUNDS, CELL_ROWS = 20_000, 1024, 256, 8, 1 << 15


def k_means(rows: np.ndarray, k: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """k centres of rows (fewer rows: as many), by Lloyd's rounds; a centre without rows takes the row farthest from its own."""
    draw = np.random.default_rng(seed)
    centres = rows[draw.permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        far = (rows**2).sum(1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(1)
        own = far.argmin(1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        worst = np.argsort(-far[np.arange(len(rows)), own], kind="stable")
        empty = np.flatnonzero(count == 0)
        centres[empty] = rows[worst[: len(empty)]]
    return centres


class Model:
    """Cells and codebooks; books[p] are the codes of part p of a residual."""

    def __init__(self, cells: np.ndarray, books: np.ndarray) -> None:
        self.cells, self.books = cells, books

    @classmethod
    def fit(cls, rows: np.ndarray, parts: int, seed: int = 7) -> Model:
        cells = k_means(rows, min(CELLS, max(1, int(len(rows) ** 0.5))), seed)
        rest = rows - cells[cls.nearest(rows, cells)]
        width = rows.shape[1] // parts
        books = [k_means(rest[:, p * width : (p + 1) * width], CODES, seed + p) for p in range(parts)]
        full = max(map(len, books))
        return cls(cells, np.stack([np.concatenate([b, np.repeat(b[:1], full - len(b), 0)]) for b in books]))

    @staticmethod
    def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, codes [row, part]) of unit vectors."""
        cell = self.nearest(rows, self.cells)
        rest, width = rows - self.cells[cell], self.books.shape[2]
        codes = [self.nearest(rest[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def approximate(self, query: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Inner product of a query with each coded row of a cell, from tables of its parts with the codebooks."""
        width = self.books.shape[2]
        tables = np.stack([book @ query[p * width : (p + 1) * width] for p, book in enumerate(self.books)])
        return query @ self.cells[cell] + tables[np.arange(len(tables)), codes].sum(1)


class VectorIndex:
    """The rows (doc_id, cell, codes, unit) and the model of an index, as Parquet at path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(f"{path}/rows")
        told = spark.read.parquet(f"{path}/model").first()
        self.model = Model(np.array(told["cells"]), np.array(told["books"]))
        self.sizes = spark.read.parquet(f"{path}/sizes")

    @classmethod
    def build(cls, corpus: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", parts: int = 16) -> VectorIndex:
        """Fits, writes and opens the index of corpus. The vectors' length is a multiple of parts."""
        spark = corpus.sparkSession
        held = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(vector).alias("v"))
        # A sample of a documented size; everything else runs over all rows.
        sample = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).toArrow()
        if not sample.num_rows:
            raise ValueError("no vectors to index")
        model = Model.fit(_unit(_table_rows(sample.column("v"), sample.num_rows)), parts)

        def run(batches):
            for b in batches:
                if b.num_rows:
                    unit = _unit(_rows(b.column(1), b.num_rows))
                    cell, codes = model.encode(unit)
                    ends = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1)))], ["doc_id", "cell", "codes", "unit"])

        rows = held.mapInArrow(run, "doc_id long, cell int, codes binary, unit array<double>")
        rows.repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(model.cells.tolist(), model.books.tolist())], "cells array<array<double>>, books array<array<array<double>>>").write.mode("overwrite").parquet(f"{path}/model")
        spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, probes: float = 0.75, rescored: int = 100, key: str = "qid", vector: str = "embedding") -> DataFrame:
        """(qid, doc_id, score, rank) of about the k rows most like each query: by codes in the nearest share `probes` of all cells, then exactly among the `rescored` best."""
        model = self.model
        n_probes = max(1, int(np.ceil(probes * len(model.cells))))
        asked = queries.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("qid"), F.col(vector).alias("asked"))

        def nearest(batches):
            for b in batches:
                if b.num_rows:
                    unit = _unit(_rows(b.column(1), b.num_rows))
                    cells = np.argsort((model.cells**2).sum(1) - 2 * unit @ model.cells.T, axis=1, kind="stable")[:, :n_probes]
                    ends = pa.array(np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32))
                    where = pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(unit.reshape(-1))), pa.ListArray.from_arrays(where, pa.array(cells.reshape(-1), pa.int32()))], ["qid", "unit", "cells"])

        probed = stored(asked.mapInArrow(nearest, "qid long, unit array<double>, cells array<int>"), "probed")
        # A cell of many rows is dealt to several tasks, each of which meets all queries of the cell.
        shares = self.sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / CELL_ROWS)).cast("int").alias("shares"))
        codes = self.rows.select("doc_id", "cell", "codes").join(shares, "cell").select("doc_id", "cell", "codes", F.pmod(F.xxhash64("doc_id"), "shares").cast("int").alias("share"))
        right = probed.select("qid", F.col("unit").alias("asked"), F.explode("cells").alias("q_cell"))
        right = right.join(shares.withColumnRenamed("cell", "q_cell"), "q_cell").withColumn("q_share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")

        def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"qid": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
            ids, cell = left.column("doc_id").to_numpy(), left.column("cell")[0].as_py()
            own = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            qids = right.column("qid").to_numpy()
            out = []
            for qid, q in zip(qids, _table_rows(right.column("asked"), len(qids))):
                near = model.approximate(q, cell, own)
                at = np.argsort(-near, kind="stable")[:rescored]
                out.append((np.full(len(at), qid), ids[at], near[at]))
            return pa.table({n: np.concatenate(c) for n, c in zip(("qid", "doc_id", "near"), zip(*out))})

        near = codes.groupBy("cell", "share").cogroup(right.groupBy("q_cell", "q_share")).applyInArrow(ranked, "qid long, doc_id long, near double")
        left = top_k(near, rescored, score="near").select("qid", "doc_id")
        units = self.rows.select("doc_id", "unit")
        # Units are scaled to length 1 already; what is zero stays zero.
        both = left.join(units, "doc_id").join(probed.select("qid", F.col("unit").alias("asked")), "qid")
        product = F.aggregate(F.zip_with("unit", "asked", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return top_k(both.select("qid", "doc_id", F.round(product, 6).alias("score")), k)
