"""Postings in blocks of documents: how they are built, and how queries meet them.

Documents are dealt by hash to blocks of about BLOCK_DOCS documents or BLOCK_CHARS characters. A block has a head (the ids of its
documents, in order, and how many words each has) and for each of its terms one row: the numbers of the documents that hold it, how often,
where, and the greatest frequency and the least length among them, which bound the term's weight in the block whatever the
corpus grows to. A search ships only rows of asked terms in blocks that may matter; queries meet them block by block in
`cogrouped`, at most QUERY_GROUP queries at once, and what leaves a block is its best documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.sources.readers import small_batches, trimmed

#: Documents and characters of a block, about; the least number of blocks, so that a small corpus is built and searched in parallel.
BLOCK_DOCS, BLOCK_CHARS, LEAST_BLOCKS = 4096, 16 << 20, 8
#: Queries that meet a block in one task.
QUERY_GROUP = 1024
#: Bits of a block's number that count within its segment.
_BLOCK_BITS = 24
SCHEMA = "block long, term string, df int, top_tf int, least_dl int, nos array<int>, tfs array<int>, places array<int>, ids array<long>"
_NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]


def base_of(segment: str) -> int:
    """Where a segment's block numbers begin; segments differ in it."""
    return int.from_bytes(hashlib.blake2b(segment.encode(), digest_size=8).digest(), "big") >> 1 >> _BLOCK_BITS << _BLOCK_BITS


def _lists(offsets: np.ndarray, values: np.ndarray, kind=None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind or pa.int32()))


def block_rows(table: pa.Table, renamed: Callable[[str], str | None] | None, with_places: bool) -> pa.Table:
    """The head and the posting rows of one block's documents (block, doc_id, tokens). renamed gives each word's term, or None to leave it out."""
    table = table.sort_by("doc_id")
    lists = table.column("tokens").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    place = np.arange(len(codes), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    if renamed is not None:
        seen: dict[str, int] = {}
        map_ = np.array([-1 if t is None else seen.setdefault(t, len(seen)) for t in map(renamed, words.to_pylist())] or [-1], np.int32)
        codes = map_[codes] if len(codes) else codes
        kept = codes >= 0
        codes, doc, place, words = codes[kept], doc[kept], place[kept], pa.array(list(seen), pa.string())
    order = np.argsort(codes, kind="stable")
    code, doc, place = codes[order], doc[order], place[order]
    del order, codes, coded, lists
    block = table.column("block")[0].as_py()
    if len(code):
        new_term = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        new_doc = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    else:
        new_term = new_doc = np.zeros(0, np.int64)
    tf, nos = np.diff(np.append(new_doc, len(code))), doc[new_doc]
    first = np.searchsorted(new_doc, new_term)
    ends = np.append(first, len(nos))
    n = len(new_term)
    reduced = (lambda f, v: f.reduceat(v, first)) if n else (lambda f, v: v[:0])
    columns = [
        pa.array(np.full(n, block), pa.int64()), words.take(pa.array(code[new_term])), pa.array(np.diff(ends), pa.int32()),
        pa.array(reduced(np.maximum, tf), pa.int32()), pa.array(reduced(np.minimum, lengths[nos]), pa.int32()), _lists(ends, nos), _lists(ends, tf),
        _lists(np.append(new_term, len(code)), place) if with_places else _lists(np.zeros(n + 1), place[:0]), _lists(np.zeros(n + 1), np.zeros(0), pa.int64())]
    head = [pa.array([block], pa.int64()), pa.array([None], pa.string()), pa.array([len(lengths)], pa.int32()), *(pa.array([0], pa.int32()),) * 2,
            pa.array([[]], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32())), pa.array([[]], pa.list_(pa.int32())), pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
    return pa.concat_tables([pa.Table.from_arrays(head, _NAMES), pa.Table.from_arrays(columns, _NAMES)])


def build(docs: DataFrame, key: str = "doc_id", text: str = "text", renamed: Callable[[str], str | None] | None = None, with_places: bool = False, segment: str = "") -> DataFrame:
    """The blocks of a corpus, as rows of SCHEMA. Ids are longs, one document each; a null text has no words."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("chars")).first()
    blocks = max(LEAST_BLOCKS, -(-size["n"] // BLOCK_DOCS), -(-(size["chars"] or 0) // BLOCK_CHARS))
    number = F.lit(base_of(segment)) + F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    words = F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))
    held = docs.select(number.alias("block"), F.col(key).cast("long").alias("doc_id"), words.alias("tokens"))

    def run(table: pa.Table) -> pa.Table:
        try:
            return block_rows(table, renamed, with_places)
        finally:
            trimmed()  # a block's arrays would stay with the worker

    small_batches(docs.sparkSession)
    return held.groupBy("block").applyInArrow(run, SCHEMA)


def heads(rows: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """block, nos (numbers of dead documents), tfs (words of each document), ids of the blocks; dead: (block, nos)."""
    own = rows.filter("term IS NULL").select("block", "tfs", "ids")
    if dead is None:
        return own.select("block", F.array().cast("array<int>").alias("nos"), "tfs", "ids")
    gone = dead.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))
    return own.join(gone, "block", "left").select("block", F.coalesce("nos", F.array().cast("array<int>")).alias("nos"), "tfs", "ids")


class Block:
    """What a task sees of a block: its documents and the posting rows of the asked terms."""

    def __init__(self, left: pa.Table) -> None:
        left = left.combine_chunks()
        names = left.column("term").to_pylist()

        def lists(column: str) -> tuple[np.ndarray, np.ndarray]:
            """Where each row's values begin, and all values."""
            held = left.column(column).combine_chunks()
            held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
            return np.concatenate([[0], np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False), dtype=np.int64)]), held.flatten().to_numpy(zero_copy_only=False)

        (at, nos), (at_tf, tfs), (at_id, ids) = lists("nos"), lists("tfs"), lists("ids")
        at_place, places = lists("places") if "places" in left.column_names else (None, None)
        head = names.index(None)
        self.ids, self.lengths = ids[at_id[head] : at_id[head + 1]], tfs[at_tf[head] : at_tf[head + 1]].astype(float)
        self.alive = np.ones(len(self.ids), bool)
        self.alive[nos[at[head] : at[head + 1]]] = False
        #: Of each term: numbers of its documents, how often they hold it, and where, one after another.
        self.terms = {t: (nos[at[i] : at[i + 1]], tfs[at_tf[i] : at_tf[i + 1]], None if places is None else places[at_place[i] : at_place[i + 1]]) for i, t in enumerate(names) if t is not None}


def best_of(scores: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of `held` by score; equal scores in order of place."""
    at = np.flatnonzero(held)
    if len(at) > 4 * k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((at, -scores[at]))[:k]]


def query_groups(asked: DataFrame, key: str = "qid") -> int:
    return max(1, -(-asked.select(key).distinct().count() // QUERY_GROUP))


def cogrouped(rows: DataFrame, own_heads: DataFrame, asked: DataFrame, groups: int, columns: list[str], run: Callable[[Block, pa.Table], Iterator[pa.Table]], schema: str) -> DataFrame:
    """run(block, its part of asked) for every block and group of queries. asked: (qid, block, term, ..); rows of other terms or blocks don't move."""
    right = asked.withColumn("qg", F.pmod(F.xxhash64("qid"), F.lit(groups)))
    need = right.select("block", "term", "qg").distinct()
    met = rows.filter("term IS NOT NULL").select("block", "term", *columns).join(need, ["block", "term"])
    blank = F.array().cast("array<int>")
    met = met.select("block", "qg", "term", "nos", "tfs", *(["places"] if "places" in columns else []), F.array().cast("array<long>").alias("ids"))
    tops = own_heads.join(right.select("block", "qg").distinct(), "block")
    tops = tops.select("block", "qg", F.lit(None).cast("string").alias("term"), "nos", "tfs", *([blank.alias("places")] if "places" in columns else []), "ids")
    left = met.unionByName(tops).withColumnsRenamed({"block": "own_block", "qg": "own_qg"}).select(*(F.col(c).alias(c) for c in ["own_block", "own_qg", "term", "nos", "tfs", *(["places"] if "places" in columns else []), "ids"]))

    def each(l: pa.Table, r: pa.Table) -> pa.Table:
        kinds = pa.schema([(n, {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}[t]) for n, t in (f.split(" ") for f in schema.split(", "))])
        found = list(run(Block(l), r)) if l.num_rows and r.num_rows else []
        columns_ = [pa.array([x for part in found for x in part[i]], kinds.field(i).type) for i in range(len(kinds))]
        return pa.Table.from_arrays(columns_, schema=kinds)

    return left.groupBy("own_block", "own_qg").cogroup(right.groupBy("block", "qg")).applyInArrow(each, schema)
