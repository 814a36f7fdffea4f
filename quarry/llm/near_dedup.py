"""MinHash near-dedup by ProbMinHash over weighted word shingles.

A text's shingles are its SHINGLE-word windows (a shorter text is one shingle), weighted by how often
they occur. Two texts' similarity is the probability Jaccard of these weights, which for
texts without repeated shingles is the plain Jaccard index. Each shingle is a Poisson process
with its weight as rate; every arrival falls on one of SLOTS slots, a slot keeps its first
arrival's shingle, and arrivals stop once all slots have one. Slots agree between two texts
with the similarity's probability. Bands of slots give candidates, which are verified by exact
similarity; links make classes.

1. Texts with the same words are one: the least doc_id stands for all, before any banding.
   It is known by a hash of its doc_id and text, so texts under one doc_id do not mix.
2. In each bucket all are compared with the member that meets others most often, the likely
   original of a family. Members that are thereby in one class need no more comparing, so a
   family of n near copies costs n comparisons and not n squared.
3. Members of a bucket that are in different classes still are compared with each other, all
   of them: the buckets with one leader form a family, which is cut into blocks of FAMILY
   members; two blocks meet in one task, where products of their shingle matrices tell all
   overlaps, and only links that join classes leave it. So every pair that shares a bucket is
   linked, compared, or in one class already, and rows grow with a family's size times its
   number of blocks.

At similarity 0.8 a pair shares one of 32 bands of 4 with probability 1 - 5e-8.

Null text and text without words are alone. A null doc_id is below all others. Repeated rows
are copies of each other; different texts under one doc_id are separate. Of a class one row
stays, one with the least doc_id. An empty table gives an empty result; other columns do not matter.
A text of any length gives all its shingles, in memory of a task in proportion to it; a block of a family holds its members' texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, blocks, doc_key, mixed, rolling, row_key, texts, tidy, trimmed, written
from quarry.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
#: Members of a family that are compared in one block.
FAMILY = 160
#: Members of families for each partition that compares them, about.
PART_ROWS = 500
_COLUMNS = 4096
SLOTS = BANDS * ROWS
_U = np.uint64
_BLOCK = 512 << 10


def shingles(words: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, hash and count of each distinct shingle of each text."""
    starts, h = words.windows(width)
    owner = words.text[starts]
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        whole = []
        for d in short.tolist():
            whole.append(rolling(words.hash[words.first[d] : words.first[d] + words.count[d]], int(words.count[d]))[0])
        owner, h = np.concatenate([owner, short]), np.concatenate([h, np.array(whole, dtype=_U)])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, int)
    return owner[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def signatures(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The shingle in each slot of each of n texts (slots a power of two); texts without shingles hold 0.

    Arrivals of all shingles up to a time limit are drawn at once; the limit is where a
    text's slots most likely all have one, and is doubled for texts where some have none.
    """
    out = np.zeros((n, slots), dtype=_U)
    first = np.full(n * slots, np.inf)
    total = np.bincount(owner, weight, n)
    limit = slots * (np.log(slots) + 2) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    flat = out.reshape(-1)
    while len(todo):
        again = np.zeros(n, bool)
        again[todo] = True
        rows = np.flatnonzero(again[owner])
        time = np.zeros(len(rows))
        step = 0
        while len(rows):
            draw = mixed(h[rows] + _U((step + 1) * 0xD1B54A32D192ED03 % 2**64))
            time = time - np.log(((draw >> _U(11)).astype(float) + 0.5) * 2.0**-53) / weight[rows]
            keep = time < limit[owner[rows]]
            rows, time, draw = rows[keep], time[keep], draw[keep]
            at = owner[rows] * slots + (draw & _U(slots - 1)).astype(np.int64)
            np.minimum.at(first, at, time)
            won = first[at] == time
            flat[at[won]] = h[rows[won]]
            step += 1
        todo = todo[np.isinf(first.reshape(n, slots)[todo]).any(1)]
        limit[todo] *= 2
    return out


def band_hashes(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    n, slots = sig.shape
    width = slots // bands
    parts = mixed(sig).reshape(n, bands, width)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=_U)[None, :] * _U(0xA24BAED4963EE407), (n, bands)).copy()
    for k in range(width):
        out = mixed(out * _U(0x9FB21C651E98DF25) + parts[:, :, k])
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes, counts).

    For each common shingle d it adds 1 / sum over e of max(a_e / a_d, b_e / b_d); with shingles
    in order of a_e / b_e that sum is a prefix and a suffix.
    """
    common, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    total_a, total_b = float(a[1].sum()), float(b[1].sum())
    if total_a == len(a[0]) and total_b == len(b[0]):
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    # e with a_e / b_e at least d's count by a_e / a_d, the others by b_e / b_d.
    at = np.searchsorted(ratio, ratio, side="left")
    below_a = np.concatenate([[0.0], np.cumsum(wa)])[at]
    below_b = np.concatenate([[0.0], np.cumsum(wb)])[at]
    only_b = total_b - wb.sum()
    return float((1 / ((total_a - below_a) / wa + (below_b + only_b) / wb)).sum())


def signed(docs: DataFrame) -> DataFrame:
    """(key, row, digest, bands): doc_id and hash of each row, digest of its text's words (null for none) and its band hashes."""

    def run(batches):
        for b in batches:
            values = texts(b.column(2))
            for first, end in blocks(values, _BLOCK):
                part = values[first:end]
                words = Words(part)
                owner, h, count = shingles(words)
                found = band_hashes(signatures(owner, h, count.astype(float), len(part))).view(np.int64)
                digests = [hashlib.blake2b(b" ".join(v.split()), digest_size=16).digest() if n else None for v, n in zip(part, words.count)]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.reshape(-1)))
                own = [b.column(c).slice(first, end - first) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(digests, pa.binary()), bands], ["key", "row", "digest", "bands"])

    return docs.select(doc_key().alias("key"), row_key().alias("row"), "text").mapInArrow(tidy(run), "key long, row long, digest binary, bands array<long>")


def verified(pairs: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose texts are similar enough; held has key and text."""

    def run(batches):
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def weights(key: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in known:
                if len(known) > 256:
                    known.clear()
                known[key] = shingles(Words([text.encode()]))[1:]
            return known[key]

        for batch in batches:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            ok = [similarity(weights(x, s), weights(y, t)) >= threshold - 1e-12 for x, y, s, t in zip(a, b, ta, tb)]
            keep = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep))], ["a", "b"])

    both = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(held.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long")


def family_links(keys: np.ndarray, classes: np.ndarray, sides: np.ndarray, values: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of similar texts; sides (0, 1 or both alike) says who meets whom.

    Overlaps come from matrix products over the shingles that two texts at least hold. Among
    texts without repeated shingles they give the similarity itself; for others the share of
    a text's weight that the overlap has bounds it from above, and what passes is computed.
    """
    n = len(keys)
    owner, h, count = shingles(Words(values))
    bounds = np.searchsorted(owner, np.arange(n + 1))
    sets = [(h[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]]) for i in range(n)]
    size = np.bincount(owner, minlength=n).astype(float)
    weight = np.bincount(owner, count, n)
    _, column, held = np.unique(h, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    row, col, w = owner[shared], column[shared], count[shared].astype(np.float32)
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    row, col, w = row[order], col[order], w[order]
    overlap = np.zeros((n, n))
    for a in range(0, int(col.max(initial=-1)) + 1, _COLUMNS):
        x, y = np.searchsorted(col, [a, a + _COLUMNS])
        part = np.zeros((n, _COLUMNS), dtype=np.float32)
        part[row[x:y], col[x:y] - a] = w[x:y]
        overlap += part @ (part > 0).astype(np.float32).T
    plain = size == weight
    exact = overlap / np.maximum(size[:, None] + size[None, :] - overlap, 1)
    bound = overlap / np.maximum(weight, 1)[:, None]
    bound = np.minimum(bound, bound.T)
    both = plain[:, None] & plain[None, :]
    near = np.where(both, exact, bound) >= threshold - 1e-12
    near &= classes[:, None] != classes[None, :]
    if len(np.unique(sides)) > 1:
        near &= sides[:, None] != sides[None, :]
    leader = {c: c for c in classes.tolist()}

    def top(c: int) -> int:
        while leader[c] != c:
            leader[c] = leader[leader[c]]
            c = leader[c]
        return c

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1)))):
        a, b = top(int(classes[i])), top(int(classes[j]))
        if a != b and (both[i, j] or similarity(sets[i], sets[j]) >= threshold - 1e-12):
            leader[max(a, b)] = min(a, b)
            links.append((int(keys[i]), int(keys[j])))
    return links


def compared(families: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between classes of each family; families has family, key and class."""
    sizes = families.groupBy("family").agg(F.ceil(F.count("*") / FAMILY).cast("int").alias("blocks"))
    dealt = families.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "class")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        found = family_links(rows["key"].to_numpy(), rows["class"].to_numpy(), rows["block"].to_numpy(), [t.encode() for t in rows["text"]], threshold)
        trimmed()
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # Little data and much work: as many partitions as the work asks for, which Spark does not join by size.
    met = dealt.join(held, "key").repartition(max(1, -(-families.count() // PART_ROWS)), "family", "low", "high")
    return met.groupBy("family", "low", "high").applyInPandas(meet, "a long, b long")


def near_links(signs: DataFrame, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b): links between texts that differ, enough to connect every class.

    signs has key (as by row_key) and bands, one row for each different text.
    """
    bands = signs.select("key", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(bands.join(shared, "bucket"), "buckets")
    degree = met.groupBy("key").agg(F.sum("n").alias("degree"))
    ranked = met.join(degree, "key").groupBy("bucket").agg(F.max(F.struct("degree", F.negative("key").alias("k"))).alias("top"))
    pivots = ranked.select("bucket", F.negative("top.k").alias("pivot"))
    met = written(met.join(pivots, "bucket"), "pivots")
    held = written(docs.select(row_key().alias("key"), "text").filter(F.col("text").isNotNull()).join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "texts")
    stars = met.filter("key <> pivot").select(F.col("pivot").alias("a"), F.col("key").alias("b")).distinct()
    links = written(verified(stars, held, threshold), "links")
    # Members of one bucket that are not in one class yet.
    classes = components(links)
    labelled = met.join(classes, met["key"] == classes["u"], "left").select("bucket", "key", "pivot", F.coalesce("root", "key").alias("class"))
    open_ = labelled.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("bucket")
    rest = labelled.join(open_, "bucket").filter("key <> pivot").select(F.col("pivot").alias("family"), "key", "class").distinct()
    return links.unionAll(written(compared(written(rest, "families"), held, threshold), "links"))


def _grouped(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """signs (from `signed`); digest, copy_of and root of each different text; root, class_id and row of the one that stays of each class."""
    signs = written(signed(docs), "signs")
    # Written, as are the tables below: a join then has a shuffle of its own on both sides, which Spark can split where a text has many copies.
    least = signs.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min(F.struct("key", "row")).alias("least"))
    least = written(least.select("digest", F.col("least.key").alias("copy_of"), F.col("least.row").alias("row")), "copies")
    different = signs.join(least, ["digest", "row"], "left_semi").dropDuplicates(["digest"])
    roots = components(near_links(different.select(F.col("row").alias("key"), "bands"), docs, threshold))
    least = least.join(roots, least["row"] == roots["u"], "left").select("digest", "copy_of", "row", F.coalesce("root", "row").alias("root"))
    least = written(least, "rooted")
    tops = least.groupBy("root").agg(F.min(F.struct("copy_of", "row")).alias("top"))
    tops = written(tops.select("root", F.col("top.copy_of").alias("class_id"), F.col("top.row").alias("row")), "tops")
    return signs, least.drop("row"), tops


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) and copy_of (least doc_id with the same words)."""
    signs, least, tops = _grouped(docs, threshold)
    least = written(least.join(tops, "root").select("digest", "copy_of", "class_id"), "classes")
    out = signs.select("key", "digest").join(least, "digest", "left")
    null = F.lit(None).cast("long")
    out = out.select("key", F.coalesce("class_id", "key").alias("class_id"), F.coalesce("copy_of", "key").alias("copy_of"))
    lowest = F.lit(-(2**63))
    return out.select(*(F.when(F.col(c) != lowest, F.col(c)).otherwise(null).alias(n) for c, n in (("key", "doc_id"), ("class_id", "class_id"), ("copy_of", "copy_of"))))


def kept_rows(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, one for each class: one with the least doc_id. Texts without words all stay."""
    names = docs.columns
    signs, _, tops = _grouped(docs, threshold)
    stay = tops.select(F.col("row").alias("stay")).unionAll(signs.filter(F.col("digest").isNull()).select("row")).distinct()
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    mine, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    kept = plain.join(stay, row_key(mine, text) == F.col("stay"), "left_semi")
    words = F.expr(f"regexp_count({text}, '[^\\\\x20\\\\x09-\\\\x0D]+')")
    again = F.xxhash64(F.col(text), F.when(F.coalesce(words, F.lit(0)) == 0, F.monotonically_increasing_id()))
    return kept.withColumn("again", again).dropDuplicates([mine, "again"]).drop("again").toDF(*names)
