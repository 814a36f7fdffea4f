"""Connected components of a graph of links, by alternating large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(u, root) for every end u of a link (a, b) but the roots; a root is its component's least id.

    A large star ties each node's greater neighbours to its least one, a small star its lesser
    ones; the rounds needed grow with the logarithm of a component's diameter. Each round is
    written to the shared folder; only a count and a checksum come to the driver. Null ends and
    links of a node with itself are left out; no links give no rows. More rounds than any real
    graph needs are an error, not a result.
    """
    edges = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    if not state[0]:
        return edges.select("u", F.col("v").alias("root"))
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(tied.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            return edges.select("u", F.col("v").alias("root"))
    raise RuntimeError(f"links did not settle within {rounds} rounds")
