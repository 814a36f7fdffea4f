"""Samples that a seed decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seeded_sample(rows: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows, the first by a hash of seed and key; every task keeps n rows at most. The same rows whatever the partitioning."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)
