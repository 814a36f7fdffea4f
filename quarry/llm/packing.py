"""Best-fit packing: best-fit decreasing in partitions, certified by dual-feasible-function bounds.

Documents become token ids with an end id; longer ones are cut into pieces of `capacity`, the
first taking the rest. Full pieces are sequences of their own. The others are dealt to partitions of at most
part_rows pieces, each of which gets its even share of every length; each is packed best-fit decreasing and
gets a lower bound on its number of bins from dual feasible functions (`part_gap`: its bins above that). A
partition that meets its bound is proved best for its own pieces, the whole packing where it meets the bound of
all lengths together, which comes from their histogram. While it doesn't, partitions exchange documents: bins with more than some
slack of room are opened, their pieces dealt anew to partitions of the same size and packed again, and the new
packing replaces the old where it needs fewer bins. Slacks take turns; rounds end when one turn of slacks has saved
next to nothing (SAVING of what is above the bound). What then stays above it is told in the column gap.

Null and empty texts are the end id alone. Rows are documents each, repeated rows and null
ids too; ties in length go by doc_id. A text of any length is encoded whole. An empty table
gives an empty result; columns but doc_id and text do not matter.

Tokens: a text is cut at single blanks and newlines between other characters, where no token of this
byte-level vocabulary can lie across, and the ids of each part are looked up in a bounded
table of parts seen before; only new parts go through the tokenizer. Ids themselves never
leave the task, only lengths and checksums do.
"""

from __future__ import annotations

import gc
import os
import re
import sys
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import trimmed, written

CAPACITY = 1024
END_ID = 2
#: Pieces that a partition packs together, about; its memory and time are bounded by this.
PART_ROWS = 20_000
#: Room, in tokens of a capacity of 1024, above which a bin is opened, round after round.
SLACKS = (4, 16, 64)
#: A round that saves less than this share of the bins above the bound, or none, has failed.
SAVING = 0.02
#: Parts in each of the two generations of a worker's table, about 100 MB.
_CACHE = 600_000
#: Texts that are looked up together.
_TEXTS = 128
#: Parts that go through the tokenizer as one text.
_JOINED = 256
#: White space other than blank and newline; a text with any goes through the tokenizer whole.
_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\0"
_OTHER_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


class CachedTokenizer:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    _own: dict[str, CachedTokenizer] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        assert sys.byteorder == "little" and array("I").itemsize == 4
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.old: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Of each id: whether its token begins with a blank.
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    @classmethod
    def of(cls, path: str) -> CachedTokenizer:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def encode(self, values: list[str]) -> list[bytes]:
        if not values:
            return []
        found = self.tokenizer.encode_batch_fast(values, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode_parts(self, values: list[str]) -> list[bytes]:
        """`encode` of parts; those that begin with a blank go many in one text, which is cut again where a token begins with a blank."""
        found = dict.fromkeys(values, b"")
        blank = [p for p in found if p[:1] == " "]
        groups = [blank[a : a + _JOINED] for a in range(0, len(blank), _JOINED)]
        alone = [p for p in found if p[:1] != " "]
        for group, data in zip(groups, self.encode(["".join(g) for g in groups])):
            at = np.flatnonzero(self.begins[np.frombuffer(data, "<u4")])
            if len(at) == len(group):
                edges = [*(4 * at).tolist(), len(data)]
                found.update((p, data[i:j]) for p, i, j in zip(group, edges, edges[1:]))
            else:
                alone += group
        found.update(zip(alone, self.encode(alone)))
        return [found[p] for p in values]

    @staticmethod
    def parts(text: str) -> list[str] | None:
        """The parts of a text; None if white space stands next to white space or at an end, or is of a rarer kind."""
        if not text or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return None
        if any(c in text for c in _ASCII_SPACE) or not text.isascii() and _OTHER_SPACE.search(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _learn(self, parts: set[str]) -> None:
        """Puts parts into the table. A full stop or comma after a letter is a part of its own."""
        new, old = self.new, self.old
        cut: list[tuple[str, str, str]] = []
        todo: set[str] = set()
        for p in parts:
            known = old.get(p)
            if known is not None:
                new[p] = known
                continue
            core = p.rstrip(".,")
            if len(core) < len(p) and core[-1:].isalpha():
                tail = p[len(core) :]
                cut.append((p, core, tail))
                for x in (core, tail):
                    if x not in new:
                        known = old.get(x)
                        if known is None:
                            todo.add(x)
                        else:
                            new[x] = known
            else:
                todo.add(p)
        values = list(todo)
        new.update(zip(values, self.encode_parts(values)))
        for p, core, tail in cut:
            new[p] = new[core] + new[tail]

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        get = self.new.get
        cut = [self.parts(t) for t in texts]
        found = [None if p is None else [*map(get, p)] for p in cut]
        gaps = [() if p is None else [x for x, known in zip(p, ids) if known is None] for p, ids in zip(cut, found)]
        missing = set().union(*gaps)
        if missing:
            self._learn(missing)
        out = []
        for t, p, ids, gap in zip(texts, cut, found, gaps):
            if p is None:
                out.append(self.encode([t])[0] if t else b"")
            else:
                out.append(b"".join([get(x) if known is None else known for x, known in zip(p, ids)] if gap else ids))
        if len(self.new) > _CACHE:
            self.old, self.new = self.new, {}
        return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        own = CachedTokenizer.of(tokenizer)
        gc.disable()  # millions of short-lived strings and lists, none in a cycle
        try:
            for b in batches:
                ids, rows = [], []
                keys, values = b.column(0).to_pylist(), ["" if t is None else t for t in b.column(1).to_pylist()]
                for a in range(0, len(values), _TEXTS):
                    for key, data in zip(keys[a : a + _TEXTS], own.bytes_of(values[a : a + _TEXTS])):
                        data += end
                        n = len(data) // 4
                        at, k, stop = 0, 0, n % capacity or capacity
                        while at < n:
                            ids.append(key)
                            rows.append((k, at, stop - at, zlib.crc32(memoryview(data)[4 * at : 4 * stop])))
                            at, stop, k = stop, stop + capacity, k + 1
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:
            gc.enable()
            own.old = {}  # an idle worker keeps one generation at most
            trimmed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin of each item, its offset there, number of bins) of best-fit decreasing.

    Open bins lie in stacks by room left; an integer's bits say which stacks are not empty,
    so the tightest bin that fits is one shift away.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, n = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                open_ ^= 1 << room
        else:
            room, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - room
        room -= size
        if room:
            open_ |= 1 << room
            stacks[room].append(at)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of the lengths needs."""
    return lower_bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def lower_bound_of(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs of counts[n] items of each length n: the largest of some dual feasible functions' sums.

    u_k rounds an item by multiples of 1 / k; the threshold function counts items above
    capacity - t whole, drops those below t and leaves the others.
    """
    size = np.arange(capacity + 1)
    best = -(-int((counts * size).sum()) // capacity)
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    sums, whole = np.cumsum(counts * size), np.cumsum(counts)
    t = np.arange(1, capacity // 2 + 1)
    middle = sums[capacity - t] - sums[t - 1]
    above = whole[capacity] - whole[capacity - t]
    return max(best, int((above - (-middle // capacity)).max(initial=0)))


def _packed(capacity: int, names: list[str]):
    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        """The pieces of one partition with bin, offset, the bin's room and the partition's gap."""
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = rows["length"].to_numpy(np.int64)
        rows["bin"], rows["offset"], n = best_fit(lengths, capacity)
        rows["room"] = capacity - np.bincount(rows["bin"], lengths, n).astype(np.int64)[rows["bin"]]
        rows["part_gap"] = n - lower_bound(lengths, capacity)
        return rows[names]

    return packed


def dealt(rows: DataFrame, n_rows: int, part_rows: int, turn: int, base: int) -> tuple[DataFrame, int]:
    """(rows with their `part`, from base on; number of parts): parts of at most part_rows rows that share every length evenly.

    Rows are sorted by length over all (a frequent length spans partitions, by hash); of each `parts` rows in a row every part gets one.
    """
    ranges = -(-n_rows // (50 * part_rows)) or 1
    parts = max(1, -(-n_rows // max(1, part_rows - ranges + 1)))
    mix = F.xxhash64(F.lit(turn), "doc_id", "piece", "ids_crc32")
    lined = rows.withColumn("mix", mix).repartitionByRange(ranges, "length", "mix").sortWithinPartitions("length", "mix").withColumn("at", F.monotonically_increasing_id())
    stratum, place = F.floor((F.col("at") % (1 << 33)) / parts), F.shiftright("at", 33)
    shift = F.xxhash64(F.lit(turn), stratum, place)
    return lined.withColumn("part", F.lit(base) + F.pmod(F.col("at") % (1 << 33) + F.pmod(shift, F.lit(parts)), F.lit(parts))).drop("mix", "at"), parts


def pack_pieces(parts: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """parts (from `pieces`) with sequence_id, offset, part_gap and gap: bins of the sequence's partition above its certified bound, and of all above theirs."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    zero = F.lit(0).cast("long")
    rest = parts.filter(F.col("length") < capacity).select(*names)
    # At most capacity - 1 rows.
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in rest.groupBy("length").count().collect():
        counts[n] = c
    bound, n_rows = lower_bound_of(counts, capacity), int(counts.sum())
    kind = parts.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, room long, part_gap long"
    run = _packed(capacity, [x.split(" ")[0] for x in out.split(", ")])

    def packing_of(rows: DataFrame, n: int, turn: int, base: int) -> tuple[DataFrame, int]:
        shared, k = dealt(rows, n, part_rows, turn, base)
        return written(shared.groupBy("part").applyInPandas(run, out), "packed"), k

    now, base = packing_of(rest, n_rows, 0, 0)
    bins, turn, failed = now.filter("offset = 0").count(), 0, 0
    while bins > bound and failed < len(SLACKS):
        slack = max(0, SLACKS[turn % len(SLACKS)] * capacity // CAPACITY)
        turn += 1
        open_ = now.filter(F.col("room") > slack)
        n_open, n_bins = open_.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        new_bins = n_bins
        if n_open:
            new, k = packing_of(open_.select(*names), n_open, turn, base)
            new_bins = new.filter("offset = 0").count()
        failed = failed + 1 if n_bins - new_bins < max(1, SAVING * (bins - bound)) else 0
        if new_bins < n_bins:
            now, base, bins = now.filter(F.col("room") <= slack).unionByName(new), base + k, bins - n_bins + new_bins
    full = parts.filter(F.col("length") == capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), zero.alias("offset"), zero.alias("part_gap"))
    numbered = F.shiftleft(F.col("part"), 28) + F.col("bin")
    packed = now.select(*names, numbered.alias("sequence_id"), "offset", "part_gap")
    return full.unionByName(packed).withColumn("gap", F.lit(bins - bound).cast("long"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int = PART_ROWS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, part_gap and gap of every piece of docs."""
    return pack_pieces(written(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, part_rows)
