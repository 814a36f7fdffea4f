"""Running values over the rows of a group that is too large for one task.

The rows are dealt by range of (group, order), so a large group lies in several pieces, each of consecutive rows. Every piece runs alone; one small table
with a row for each piece carries what came before it; both are added up. A window over a whole group never forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.sinks import stored


def pieces(rows: DataFrame, by: list[str], order: list[str | Column], partitions: int | None = None) -> DataFrame:
    """rows, stored, with `piece`: rows of one group with a less piece come before those with a greater one. order tells all rows of a group apart."""
    keys = [*by, *order]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return stored(dealt.withColumn("piece", F.spark_partition_id()), "pieces")


def running(rows: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, Column], lasts: dict[str, Column]) -> DataFrame:
    """rows (from `pieces`) with running sums, and last values that are not null, up to and with each row. Groups (by) may not be null."""
    own = Window.partitionBy(*by, "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows
    for name, c in sums.items():
        out = out.withColumn(name, F.sum(c).over(own))
    for name, c in lasts.items():
        out = out.withColumn(name, F.last(c, ignorenulls=True).over(own))
    # One row a piece: few, whatever a group holds.
    place = F.struct(*(o if isinstance(o, Column) else F.col(o) for o in order)) if lasts else None
    ends = rows.groupBy(*by, "piece").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.max_by(c, F.when(c.isNotNull(), place)).alias(n) for n, c in lasts.items()))
    before = Window.partitionBy(*by).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "piece", *(F.sum(n).over(before).alias(f"_{n}") for n in sums), *(F.last(n, ignorenulls=True).over(before).alias(f"_{n}") for n in lasts))
    out = out.join(carried, [*by, "piece"])
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(n, f"_{n}"))
    return out.drop(*(f"_{n}" for n in [*sums, *lasts]))
