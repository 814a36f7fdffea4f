"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code point order, null last, weigh 1, 2, 3 and so on, repeating, and share the
size of the whole table by weight; a target stops at `max_repeats` times its source's size
and the excess is shared again by weight among the others until none is above. A source's
documents are counted by exact length, each length gives its proportional part of the target,
copies included, and a bounded-knapsack dynamic programme over the copies that are left closes
the gap, to the word where any choice of them can. Which documents of a length are taken once more than the others follows
a seeded hash, so reruns agree.

Null text has size 0; null source is a source of its own, the last; a null doc_id is a
document like others. Repeated rows are separate documents. An empty table gives an empty
result; columns other than doc_id, text and source do not matter.

Scale: only (source, length) counts reach a group function, so a group's rows are bounded
by the distinct lengths of one source. Documents of one length are picked through at most
4096 hash buckets, of which only the one at the boundary is ranked: a length shared by a
third of all rows is no hot spot. Nothing is collected but totals.
A text of any length is counted whole; only its number of words goes on.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import WORD, written

#: Words of short documents that are given to the dynamic programme besides what is left over.
SLACK = 4096
_BUCKETS, _PER_BUCKET = 4096, 64


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def bounded_knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near to budget as can be, not above.

    Sums are the bits of one integer. Each new sum notes the length that first reached it, so a
    chain of notes uses no length more often than it is there.
    """
    taken = [0] * len(lengths)
    if budget <= 0:
        return taken
    mask, reach = (1 << (budget + 1)) - 1, 1
    by = np.full(budget + 1, -1, dtype=np.int32)
    for i, (length, count) in enumerate(zip(lengths, counts)):
        new = reach
        for _ in range(min(count, budget // length) if length else 0):
            new = (new << length) & mask & ~reach
            if not new:
                break
            bits = np.unpackbits(np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
            by[np.flatnonzero(bits[: budget + 1])] = i
            reach |= new
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at:
        taken[by[at]] += 1
        at -= lengths[by[at]]
    return taken


def fit_budget(lengths: list[int], counts: list[int], budget: int, seed: int, max_repeats: int = 1) -> list[int]:
    """Copies to take of the documents of each length, together as near to budget as can be found, not above it.

    Long lengths first, each length gives its proportional part and hands what does not come
    out even on to the next, so that less than one document's length is left at the end. To it
    come SLACK words of the shortest lengths, one copy each, and the programme fits this rest: with one
    more of each document at most and, where that does not do (one long document that is
    above the budget by itself), with as many as max_repeats allows. The rest's size follows
    the longest document, not the source.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget >= total * max_repeats:
        return [c * max_repeats for c in counts]
    taken = [c * (max(budget, 0) // total) if total and not n else 0 for n, c in zip(lengths, counts)]
    if budget <= 0:
        return taken
    used = seen = 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i]:
            seen += lengths[i] * counts[i]
            taken[i] = min(counts[i] * max_repeats, (budget * seen // total - used) // lengths[i])
            used += taken[i] * lengths[i]
    left, slack = budget - used, 0
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if slack < SLACK and lengths[i] and taken[i]:
            taken[i], slack = taken[i] - 1, slack + lengths[i]
    left += slack
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    for most in (1, max_repeats):
        room = [min(c * max_repeats - k, c * most) if n else 0 for n, c, k in zip(lengths, counts, taken)]
        for i, k in zip(order, bounded_knapsack([lengths[i] for i in order], [room[i] for i in order], left)):
            taken[i] += k
            left -= k * lengths[i]
        if not left:
            break
    return taken


def targets(sources: DataFrame, max_repeats: int = 3) -> DataFrame:
    """source, source_size, weight and target (double) from (source, source_size)."""
    spark = sources.sparkSession
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(lambda x: (*x[0], x[1]))
    kind = T.StructType([*sources.schema.fields, T.StructField("place", T.LongType())])
    ranked = written(spark.createDataFrame(ordered, kind).withColumn("weight", (F.col("place") % 3 + 1).cast("double")), "sources")
    share, before = 0.0, -1
    while True:
        full = F.col("source_size") * max_repeats < F.col("weight") * share
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.count_if(full).alias("n"),
            F.sum(F.when(full, F.col("source_size") * max_repeats)).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if row["n"] == before or not row["weights"] or not row["total"]:
            break
        before, share = row["n"], (row["total"] - (row["held"] or 0)) / row["weights"]
    target = F.least(F.col("source_size") * F.lit(float(max_repeats)), F.col("weight") * F.lit(float(share)))
    return ranked.withColumn("target", target).drop("place")


def plan(sizes: DataFrame, seed: int, max_repeats: int = 3) -> DataFrame:
    """source, size, n (documents), base (times each is taken), extra (of the n, those taken once more) and the source's size and target."""
    counts = written(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), max_repeats)
    goals = goals.select(F.col("source").alias("of"), "source_size", "target")
    both = counts.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    def one_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size", ignore_index=True)
        goal = int(rows["target"].iloc[0] + 1e-6)
        copies = np.array(fit_budget(rows["size"].tolist(), rows["n"].tolist(), goal, seed, max_repeats), dtype=np.int64)
        rows["base"], rows["extra"] = copies // rows["n"], copies % rows["n"]
        return rows[["source", "size", "n", "base", "extra", "source_size", "target"]]

    kind = counts.schema["source"].dataType.simpleString()
    return both.groupBy("source").applyInPandas(one_source, f"source {kind}, size long, n long, base long, extra long, source_size long, target double")


def times_taken(sizes: DataFrame, seed: int = 17, max_repeats: int = 3) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target and times (0 to max_repeats)."""
    chosen = written(plan(sizes, seed, max_repeats), "plan")
    to = chosen.select(F.col("source").alias("s2"), F.col("size").alias("z2"), "n", "base", "extra", "source_size", "target")
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))
    rows = sizes.join(to, same).drop("s2", "z2")
    unit = (F.shiftrightunsigned(F.col("pick"), 11).cast("double")) * F.lit(2.0**-53)
    buckets = F.least(F.ceil(F.col("n") / _PER_BUCKET), F.lit(_BUCKETS))
    rows = rows.withColumn("pick", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("bucket", F.floor(unit * buckets))
    split = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    keys = ["source", "size", "bucket"]
    part = rows.filter(split)
    room = part.groupBy(*keys).agg(F.count("*").alias("here"), F.first("extra").alias("of_all"))
    upto = F.sum("here").over(Window.partitionBy("source", "size").orderBy("bucket"))
    room = room.withColumn("room", F.least(F.col("here"), F.greatest(F.lit(0), F.col("of_all") - upto + F.col("here"))))
    room = room.select(*(F.col(k).alias(f"r_{k}") for k in keys), "here", "room")
    met = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")) & (F.col("bucket") == F.col("r_bucket"))
    part = part.join(room, met)
    edge = (F.col("room") > 0) & (F.col("room") < F.col("here"))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("pick", "doc_id"))
    at_edge = part.filter(edge).withColumn("more", (order <= F.col("room")).cast("long"))
    inside = part.filter(~edge).withColumn("more", (F.col("room") > 0).cast("long"))
    whole = rows.filter(~split).withColumn("more", (F.col("extra") > 0).cast("long"))
    names = ["doc_id", "source", "size", "source_size", "target"]
    done = [x.select(*names, (F.col("base") + F.col("more")).alias("times")) for x in (whole, inside, at_edge)]
    return done[0].unionAll(done[1]).unionAll(done[2])


def sizes(docs: DataFrame) -> DataFrame:
    return written(docs.select("doc_id", "source", size_of().alias("size")), "sizes")


def mix(docs: DataFrame, seed: int = 17, max_repeats: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken (size times the number of times taken)."""
    done = times_taken(sizes(docs), seed, max_repeats)
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, max_repeats: int = 3) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs.

    Rows that share doc_id, source and size also share what the mix takes of them.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    of = {k: F.col(f"c{names.index(k)}") for k in ("doc_id", "source", "text")}
    taken = times_taken(sizes(docs), seed, max_repeats)
    taken = taken.groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count("*").alias("rows")).filter("times > 0")
    plain = plain.withColumn("n_words", F.coalesce(F.regexp_count(of["text"], F.lit(WORD)).cast("long"), F.lit(0).cast("long")))
    met = of["doc_id"].eqNullSafe(F.col("doc_id")) & of["source"].eqNullSafe(F.col("source")) & (F.col("n_words") == F.col("size"))
    both = plain.join(taken, met)
    alone = both.filter("rows = 1").withColumn("own", F.col("times"))
    place = F.row_number().over(Window.partitionBy(of["doc_id"], of["source"], "n_words").orderBy(F.xxhash64(of["text"])))
    several = both.filter("rows > 1").withColumn("own", F.floor(F.col("times") / F.col("rows")) + (place <= F.col("times") % F.col("rows")).cast("long"))
    both = alone.unionAll(several).filter("own > 0")
    again = both.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("own"))))
    return again.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
