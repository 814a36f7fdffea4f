"""Mergeable quantile summaries: an exponential hierarchy of sorted blocks (Zhang and Wang).

The rows of a group are cut into blocks of a fixed number of points, each sorted. Two summaries of one
level are merged and pruned into one of the next level, so level l stands for twice the blocks
of level l - 1 and a group of any size holds one summary a level. Pruning at level l may add the local error
2 E / ((l + 1)(l + 2)); these sum to E over all levels, whatever the number of rows, so the bound is deterministic.

A summary is a set of points x with what is known of the rows below and up to each:
lt_lo <= rows < x <= lt_hi and le_lo <= rows <= x <= le_hi. Merging adds bounds, pruning drops points;
the least and the greatest x always stay. A block that was never pruned (level 0) is exact, and of its
bounds only le_lo is kept.

On Spark: every task folds the rows it has (`partial`), so a group that holds a third of all rows leaves a task
as one summary; then lanes of at most FAN tasks are merged in rounds (`combined`) until a group has one
summary, pruned to max_points. `merged_batches` merges such summaries, and only these, across batches.
No step sees all of a group's rows, and nothing goes to the driver but the number of the last lane.

Rows without a value do not count; NaN and infinite values are the caller's to drop. Null keys are a group like
any other, but `exact_ranks` asks for keys without nulls. Equal rows may come as one with a weight; ties are one point, whose bounds
hold all of them. A row of weight null or below 1 does not count. An empty table has no summaries. Columns other than the named ones do
not matter; a key may not be called lane, level, n or like one of the bounds that are made here (rename it before).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import tidy, written

#: Points of a block.
BLOCK = 1024
#: Tasks whose summaries of a group meet in one task of a round.
FAN = 256
_ARRAYS = ["x", "lt_lo", "lt_hi", "le_lo", "le_hi"]
_L = np.int64


class Summary(NamedTuple):
    x: np.ndarray
    lt_lo: np.ndarray
    lt_hi: np.ndarray
    le_lo: np.ndarray
    le_hi: np.ndarray
    n: int
    level: int


def exact(x: np.ndarray, weight: np.ndarray) -> Summary:
    """The summary of some rows that keeps every value."""
    order = np.argsort(x, kind="stable")
    x, upto = x[order], np.cumsum(weight[order], dtype=_L)
    last = np.flatnonzero(np.append(x[1:] != x[:-1], True))
    le = upto[last]
    lt = np.concatenate([[0], le[:-1]])
    return Summary(x[last], lt, lt, le, le, int(le[-1]), 0)


def merged(parts: list[Summary], level: int) -> Summary:
    """All points of the parts with bounds for all their rows.

    Where a part lacks a value, its rows below it are at least those up to its point before and at most
    those below its point after.
    """
    x = np.unique(np.concatenate([p.x for p in parts]))
    sums = [np.zeros(len(x), _L) for _ in range(4)]
    for p in parts:
        at = np.searchsorted(p.x, x)
        known = p.x[np.minimum(at, len(p.x) - 1)] == x
        before = np.concatenate([[0], p.le_lo])[at]
        after = np.append(p.lt_hi, p.n)[at]
        inside = np.minimum(at, len(p.x) - 1)
        for total, own, other in zip(sums, p[1:5], (before, after, before, after)):
            total += np.where(known, own[inside], other)
    return Summary(x, *sums, sum(p.n for p in parts), level)


def pruned(s: Summary, most: int) -> Summary:
    """s with at most `most` (2 or more) points: those nearest to evenly spaced ranks, the first and the last among them.

    Where heavy values leave some of these out, others in even steps take their place. Adds at most
    n / (most - 1) to the gap between neighbours.
    """
    if len(s.x) <= most:
        return s
    ranks = 1 + (s.n - 1) * np.arange(most) / (most - 1)
    right = np.minimum(np.searchsorted(s.le_lo, ranks), len(s.x) - 1)
    left = np.maximum(right - 1, 0)
    worst = [np.maximum(s.lt_hi[i] + 1 - ranks, ranks - s.le_lo[i]) for i in (left, right)]
    keep = np.zeros(len(s.x), bool)
    keep[np.where(worst[0] <= worst[1], left, right)] = True
    keep[[0, -1]] = True
    spare = most - int(keep.sum())
    if spare < 0:  # the two ends came on top: give up inner points
        inner = np.flatnonzero(keep)[1:-1]
        keep[inner[np.linspace(0, len(inner) - 1, -spare).astype(int)]] = False
    elif spare:
        rest = np.flatnonzero(~keep)
        keep[rest[np.linspace(0, len(rest) - 1, min(spare, len(rest))).astype(int)]] = True
    return Summary(*(a[keep] for a in s[:5]), s.n, s.level)


def level_points(level: int, error: float) -> int:
    """Points that a summary keeps at a level (1 or more) for its local error."""
    return -int(-(level + 1) * (level + 2) // (4 * error)) + 1


class Hierarchy:
    """One group's blocks and at most one summary a level."""

    def __init__(self, error: float, block: int = BLOCK) -> None:
        self.error, self.block = error, block
        self.levels: dict[int, Summary] = {}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, x: np.ndarray, weight: np.ndarray) -> None:
        self.waiting.append((x, weight))
        self.size += len(x)
        if self.size >= self.block:
            xs, ws = (np.concatenate(c) for c in zip(*self.waiting))
            whole = self.size // self.block * self.block
            for a in range(0, whole, self.block):
                self.insert(exact(xs[a : a + self.block], ws[a : a + self.block]))
            self.waiting, self.size = [(xs[whole:], ws[whole:])], self.size - whole

    def insert(self, s: Summary) -> None:
        while s.level in self.levels:
            level = s.level + 1
            s = pruned(merged([self.levels.pop(s.level), s], level), level_points(level, self.error))
        self.levels[s.level] = s

    def result(self) -> Summary:
        parts = list(self.levels.values())
        if self.size:
            parts.append(exact(*(np.concatenate(c) for c in zip(*self.waiting))))
        if len(parts) == 1:
            return parts[0]
        level = max(p.level for p in parts) + 1
        return pruned(merged(parts, level), level_points(level, self.error))


def best_points(s: Summary, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each target rank the place of the point with the least certified rank error, and that error.

    Of equals the first counts; as bounds grow with x, answers do not fall as targets grow.
    """
    worst = np.maximum(s.lt_hi[None, :] + 1 - targets[:, None], targets[:, None] - s.le_lo[None, :])
    at = worst.argmin(axis=1)
    return at, np.maximum(worst[np.arange(len(targets)), at], 0)


class _Rows:
    """A batch of rows sorted by key: the points of each, flat, with bounds where a row has them."""

    def __init__(self, batch: pa.RecordBatch, n_keys: int, scalar: bool) -> None:
        self.keys = batch.columns[:n_keys]
        rows = batch.num_rows
        if scalar:
            self.x, self.weight = (batch.column(i).to_numpy() for i in (n_keys, n_keys + 1))
            self.level = np.zeros(rows, _L)
            self.at = np.arange(rows + 1)
        else:
            self.level, self.n = (batch.column(i).to_numpy() for i in (n_keys, n_keys + 1))
            lists = [batch.column(n_keys + 2 + i) for i in range(5)]
            self.lists = [c.flatten().to_numpy() for c in lists]
            self.at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy(), dtype=_L)])
            # Rows of level 0 have no points but in x and le_lo.
            self.more = np.concatenate([[0], np.cumsum(np.where(self.level > 0, np.diff(self.at), 0), dtype=_L)])
            self.x, upto = self.lists[0], self.lists[3]
            first = np.zeros(len(upto), bool)
            first[self.at[:-1][np.diff(self.at) > 0]] = True
            self.weight = np.where(first, upto, upto - np.concatenate([[0], upto[:-1]])) if len(upto) else upto
        changed = np.zeros(max(rows - 1, 0), bool)
        for k in self.keys:
            codes = k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            changed |= codes[1:] != codes[:-1]
        self.cuts = np.concatenate([[0], np.flatnonzero(changed) + 1, [rows]]) if rows else np.zeros(1, int)

    def key(self, row: int) -> tuple:
        return tuple(k[row].as_py() for k in self.keys)

    def feed(self, into: Hierarchy, first: int, stop: int) -> None:
        """Rows first to stop go into a hierarchy: exact ones as points, the others as summaries."""
        plain = np.flatnonzero(self.level[first:stop] == 0)
        if len(plain) == stop - first:
            into.add(self.x[self.at[first] : self.at[stop]], self.weight[self.at[first] : self.at[stop]])
            return
        for row in range(first, stop):
            a, b = self.at[row], self.at[row + 1]
            if self.level[row] == 0:
                into.add(self.x[a:b], self.weight[a:b])
            else:
                c, d = self.more[row], self.more[row + 1]
                lt_lo, lt_hi, le_hi = (self.lists[i][c:d] for i in (1, 2, 4))
                into.insert(Summary(self.x[a:b], lt_lo, lt_hi, self.lists[3][a:b], le_hi, int(self.n[row]), int(self.level[row])))


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _batch(keys: list[pa.Array], names: list[str], level, n, at, x, le, more_at, more) -> pa.RecordBatch:
    lists = [_lists(at, x), _lists(more_at, more[0]), _lists(more_at, more[1]), _lists(at, le), _lists(more_at, more[2])]
    return pa.RecordBatch.from_arrays([*keys, pa.array(level, pa.int32()), pa.array(n, pa.int64()), *lists], names)


def _small(rows: _Rows, groups: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Exact summaries of many small groups at once; groups are places in rows.cuts."""
    first, stop = rows.cuts[groups], rows.cuts[groups + 1]
    lo, hi = rows.at[first], rows.at[stop]
    sizes = hi - lo
    group = np.repeat(np.arange(len(groups)), sizes)
    place = np.arange(len(group)) + np.repeat(lo - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    x, weight = rows.x[place], rows.weight[place]
    order = np.lexsort((x, group))
    x, weight, group = x[order], weight[order], group[order]
    last = np.append((x[1:] != x[:-1]) | (group[1:] != group[:-1]), True)
    total = np.cumsum(weight, dtype=_L)
    ends = np.searchsorted(group, np.arange(len(groups)), side="right")
    base = np.concatenate([[0], total[ends - 1]])
    kept = np.flatnonzero(last)
    at = np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=len(groups)))])
    none = np.zeros(0, _L)
    return _batch([k.take(pa.array(first)) for k in rows.keys], names, np.zeros(len(groups), _L), np.diff(base), at, x[kept], total[kept] - base[group[kept]], np.zeros(len(groups) + 1, _L), [none] * 3)


def _folded(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType], names: list[str], scalar: bool, error: float, block: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """One summary for each group of rows that lie together, pruned to `most` points if given."""
    n_keys = len(kinds)
    open_key, open_ = None, None
    ready: list[tuple[tuple, Summary]] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        found = [s for _, s in ready]
        at = np.concatenate([[0], np.cumsum([len(s.x) for s in found])])
        more_at = np.concatenate([[0], np.cumsum([len(s.x) if s.level else 0 for s in found])])
        more = [np.concatenate([s[i] if s.level else s[i][:0] for s in found]) for i in (1, 2, 4)]
        keys = [pa.array([k[i] for k, _ in ready], kinds[i]) for i in range(n_keys)]
        return _batch(keys, names, [s.level for s in found], [s.n for s in found], at, np.concatenate([s.x for s in found]), np.concatenate([s.le_lo for s in found]), more_at, more)

    def close(key, hierarchy) -> None:
        nonlocal held
        s = hierarchy.result()
        if most and len(s.x) > most:
            s = pruned(s, most)._replace(level=s.level + 1)
        ready.append((key, s))
        held += len(s.x)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _Rows(batch, n_keys, scalar)
        groups = len(rows.cuts) - 1
        first_key = rows.key(0)
        start = 0
        if open_ is not None:
            if first_key == open_key:
                rows.feed(open_, 0, rows.cuts[1])
                start = 1
            if start == 0 or groups > 1:
                close(open_key, open_)
                open_ = None
        if open_ is None:
            # The last group may go on in the next batch; those before it are whole.
            whole = np.arange(start, groups - 1)
            points = rows.at[rows.cuts[1:]] - rows.at[rows.cuts[:-1]]
            pruned_rows = np.concatenate([[0], np.cumsum(rows.level > 0)])
            plain = (points <= min(block - 1, most or block)) & (pruned_rows[rows.cuts[1:]] == pruned_rows[rows.cuts[:-1]])
            small = whole[plain[whole]]
            if len(small):
                yield _small(rows, small, names)
            for g in whole[~plain[whole]]:
                h = Hierarchy(error, block)
                rows.feed(h, rows.cuts[g], rows.cuts[g + 1])
                close(rows.key(rows.cuts[g]), h)
            open_key, open_ = rows.key(rows.cuts[groups - 1]), Hierarchy(error, block)
            rows.feed(open_, rows.cuts[groups - 1], rows.cuts[groups])
        if held > 1 << 16:
            yield flushed()
            ready, held = [], 0
    if open_ is not None:
        close(open_key, open_)
    if ready:
        yield flushed()


def _fold(rows: DataFrame, keys: list[str], scalar: bool, error: float, block: int, most: int | None) -> DataFrame:
    fields = [rows.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", level int, n long, " + ", ".join(f"{a} array<long>" for a in _ARRAYS)
    names = [*keys, "level", "n", *_ARRAYS]

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = [first.schema.field(i).type for i in range(len(keys))]

        def all_():
            yield first
            yield from batches

        yield from _folded(all_(), kinds, names, scalar, error, block, most)

    return rows.mapInArrow(tidy(run), schema)


def partial(rows: DataFrame, keys: list[str], value: str, weight: str | None = None, error: float = 0.0125, block: int = BLOCK) -> DataFrame:
    """keys, level, n and points: one summary for each group of each partition of rows, with `lane`, the partition's number."""
    own = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("long").alias("x"), (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("weight"))
    own = own.filter("weight >= 1").sortWithinPartitions(*keys)
    return _fold(own, keys, True, error, block, None).withColumn("lane", F.spark_partition_id())


def combined(summaries: DataFrame, keys: list[str], error: float = 0.0125, block: int = BLOCK, max_points: int | None = None) -> DataFrame:
    """One summary for each group of keys, made of the summaries that share it. Each group's go through one task: FAN times batches of them at most."""
    by_key = summaries.select(*keys, "level", "n", *_ARRAYS).repartition(*keys).sortWithinPartitions(*keys)
    return _fold(by_key, keys, False, error, block, max_points)


def summarise(rows: DataFrame, keys: list[str], value: str, weight: str | None = None, error: float = 0.0125, max_points: int = 400, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """keys, level, n, x, lt_lo, lt_hi, le_lo, le_hi: a summary of at most max_points points for each group.

    Rank error of an answer: at most (2 error + 1 / (max_points - 1)) n, by its own bounds mostly half of that.
    """
    found = written(partial(rows, keys, value, weight, error, block), "partial")
    lanes = (found.agg(F.max("lane")).first()[0] or 0) + 1
    while lanes > fan:
        lanes = -(-lanes // fan)
        by_lane = found.withColumn("lane", F.floor(F.col("lane") / fan).cast("int"))
        found = written(combined(by_lane, [*keys, "lane"], error, block), "lanes")
    return combined(found, keys, error, block, max_points)


def merged_batches(summaries: DataFrame, keys: list[str], error: float = 0.0125, max_points: int = 400, block: int = BLOCK) -> DataFrame:
    """One summary for each group of keys from the batches' summaries alone."""
    return combined(summaries, keys, error, block, max_points)


def quantiles(summaries: DataFrame, keys: list[str], parts: int = 10, least: int = 1) -> DataFrame:
    """keys, n, i, target, answer, points, bound: for i in 1..parts-1 the point nearest to rank ceil(i n / parts), and its certified rank error.

    Summaries of fewer than `least` rows have no answers.
    """
    fields = [summaries.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n long, i int, target long, answer long, points long, bound long"
    names = [*keys, "n", "i", "target", "answer", "points", "bound"]
    steps = np.arange(1, parts, dtype=_L)

    def run(batches):
        for batch in batches:
            n_keys = len(keys)
            rows = _Rows(batch, n_keys, False)
            out = []
            for r in range(batch.num_rows):
                h = Hierarchy(1.0)
                rows.feed(h, r, r + 1)
                s = h.result()
                targets = -(-steps * s.n // parts)
                at, bound = best_points(s, targets)
                out.append((np.full(len(steps), s.n), steps, targets, s.x[at], np.full(len(steps), len(s.x)), bound))
            if not out:
                continue
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), len(steps)))
            columns = [np.concatenate(c) for c in zip(*out)]
            kinds = (pa.int64(), pa.int32(), *(pa.int64(),) * 4)
            yield pa.RecordBatch.from_arrays([*(k.take(repeat) for k in rows.keys), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    asked = summaries.filter(F.col("n") >= least).select(*keys, "level", "n", *_ARRAYS)
    return asked.mapInArrow(tidy(run), schema)


#: Bits of x that each step of the exact ranks takes; a window holds 2**BITS rows of a group at most.
_BITS = 16


def exact_ranks(cells: DataFrame, answers: DataFrame, keys: list[str], parts: int = 10) -> DataFrame:
    """answers (from `quantiles`) with exact_x, n_below and n_upto by exact counts of cells (keys, x, weight; one row for each x of a group).

    Rows below x are counted digit by digit: in the piece of x (x without its last 16 bits), in the piece's
    piece, and so on. Each running count is a window over at most 2**16 rows, so no task holds a group.
    """
    base = cells.withColumn("p1", F.shiftright("x", _BITS))
    pieces = base.groupBy(*keys, "p1").agg(F.sum("weight").alias("c")).withColumn("p2", F.shiftright("p1", _BITS))
    wider = pieces.groupBy(*keys, "p2").agg(F.sum("c").alias("c")).withColumn("p3", F.shiftright("p2", _BITS))
    widest = wider.groupBy(*keys, "p3").agg(F.sum("c").alias("c"))

    def running(rows: DataFrame, within: list[str], order: str, out: str, size: str = "c") -> DataFrame:
        w = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.withColumn(out, F.sum(size).over(w) - F.col(size))

    before = running(widest, keys, "p3", "before").drop("c")
    for rows, own, up in ((wider, "p2", "p3"), (pieces, "p1", "p2")):
        here = running(rows, [*keys, up], own, "here").drop("c")
        before = here.join(before, [*keys, up]).select(*keys, own, (F.col("here") + F.col("before")).alias("before"))
    asked = answers.groupBy(*keys, F.shiftright("answer", _BITS).alias("p1")).agg(F.collect_set("answer").alias("asked"))
    sizes = answers.select(*keys, "n").distinct()
    # Only groups with answers go on; a piece without one may still hold a target's value.
    before = before.join(sizes, keys).join(asked, [*keys, "p1"], "left")
    placed = running(base, [*keys, "p1"], "x", "here", "weight").join(before, [*keys, "p1"])
    below = F.col("here") + F.col("before")
    placed = placed.select(*keys, "x", "n", "asked", below.alias("n_below"), (below + F.col("weight")).alias("n_upto"))
    # Step i asks for row ceil(i n / parts), which has this x where n_below < i n / parts <= n_upto.
    first, last = F.call_function("div", F.col("n_below") * parts, F.col("n")) + 1, F.least(F.call_function("div", F.col("n_upto") * parts, F.col("n")), F.lit(parts - 1))
    steps = F.when(first <= last, F.sequence(first, last).cast("array<int>")).otherwise(F.array().cast("array<int>"))
    hit = placed.withColumn("steps", steps).filter((F.size("steps") > 0) | F.array_contains("asked", F.col("x")))
    hit = written(hit.select(*keys, "x", "n_below", "n_upto", "steps", F.coalesce(F.array_contains("asked", F.col("x")), F.lit(False)).alias("answers")), "ranks")
    counts = hit.filter("answers").select(*keys, F.col("x").alias("answer"), "n_below", "n_upto")
    exact_ = hit.select(*keys, F.explode("steps").alias("i"), F.col("x").alias("exact_x"))
    return answers.join(exact_, [*keys, "i"]).join(counts, [*keys, "answer"])


def with_rank_error(ranked: DataFrame, per_mille: int) -> DataFrame:
    """rank_error, the distance of the target from the ranks that the answer's rows have, and whether it is within per_mille thousandths of n."""
    error: Column = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return ranked.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= per_mille * F.col("n"))
