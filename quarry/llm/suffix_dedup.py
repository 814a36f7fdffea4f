"""Suffix-array dedup by deep-shallow sorting.

Texts are UTF-8 bytes. Every byte covered by a WIDTH-byte string that also starts anywhere
else, in this or another text, is removed, in all places; strings are judged on the input.

A sparse suffix array is enough: each WIDTH-byte string names its least GRAM-byte gram (the
leftmost of equals), so equal strings name equal grams at equal offsets. Windows that name one
gram position form a segment, anchored there. Grams named at one position only can't repeat
and drop out; where all segments of a gram are equal, by 64-bit hashes, all its windows repeat. For the others the contexts to the right of the anchors, and to the left read
backwards, are sorted with their common prefix lengths: a multikey quicksort goes to a shallow depth
by 8-byte characters, and the groups that still agree, with long common prefixes, are ordered
by blind tries. A window at offset o before its anchor repeats when another anchor of its gram
agrees on o bytes to the left and WIDTH - o to the right, which the two sorted orders tell for
all offsets at once.

Equal segments are counted before the sort and sorted once, combined before the shuffle. What
returns to a document is the windows that are unique after all; the other windows of repeated
grams are removed. The segments of a gram meet in one task; a gram named at more than BUSY
positions takes another way: its windows are counted by 64-bit hash, combined before the shuffle.

Null and empty texts are empty bytes. Rows that share a doc_id are separate texts, so equal
rows lose what they share; a null doc_id is like another. What is found goes back by a hash of
doc_id and text, so texts under one doc_id do not mix. An empty table gives an empty result;
other columns do not matter.
A text of any length is cut at its anchors within one task; segments, not texts, meet others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, blocks, doc_key, minimizers, rolling, row_key, span_hashes, texts, tidy

WIDTH, GRAM = 200, 32
#: Bytes that the multikey quicksort looks at before the blind tries take over.
SHALLOW = 32
#: Segments whose contexts are compared at once, unless one gram has more.
_ROWS = 4096
#: Positions of one gram up to which its segments are sorted together.
BUSY = 20_000
_OFFSETS = 32
_BLOCK = 1 << 20
_U = np.uint64


class _Segments:
    """The segments of some texts: gram, text, first window, number of windows, anchor."""

    def __init__(self, values: list[bytes], width: int, gram: int) -> None:
        self.data = b"".join(values)
        lengths = np.array([len(v) for v in values], dtype=np.int64)
        self.stop = np.cumsum(lengths)
        self.begin = self.stop - lengths
        codes = np.frombuffer(self.data, dtype=np.uint8).astype(_U) + _U(1)
        grams = rolling(codes, gram)
        least = minimizers(grams, width - gram + 1)
        text = np.repeat(np.arange(len(values)), lengths)[: len(least)]
        starts = np.flatnonzero(np.arange(len(least)) + width <= self.stop[text])
        at, owner = least[starts], text[starts]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
        head = np.flatnonzero(new)
        self.first, self.anchor, self.text = starts[head], at[head], owner[head]
        self.count = np.diff(np.concatenate([head, [len(at)]]))
        self.gram = grams[self.anchor]
        self.hash = span_hashes(codes, self.first, self.first + self.count - 1 + width)
        self.bounds = np.searchsorted(self.text, np.arange(len(values) + 1))

    def flagged(self, flags: list) -> np.ndarray:
        """Segments whose gram is among their text's flags."""
        found = [np.zeros(0, np.int64)]
        for d, own in enumerate(flags):
            if own is not None and len(own):
                a, z = self.bounds[d], self.bounds[d + 1]
                found.append(a + np.flatnonzero(np.isin(self.gram[a:z], np.asarray(own, dtype=np.int64).view(_U))))
        return np.concatenate(found)


def grams(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, gram, n, low, high): the grams that each text names, at how many positions, and the least and greatest hash of its segments there.

    rows has key and text.
    """

    def run(batches):
        for b in batches:
            keys, values = b.column(0).to_numpy(zero_copy_only=False), texts(b.column(1))
            for first, end in blocks(values, _BLOCK):
                s = _Segments(values[first:end], width, gram)
                h = s.hash.view(np.int64)
                order = np.lexsort((h, s.gram, s.text))
                g, t, h = s.gram[order], s.text[order], h[order]
                head = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (t[1:] != t[:-1])])) if len(g) else np.zeros(0, int)
                n = np.diff(np.concatenate([head, [len(g)]]))
                arrays = [keys[first:end][t[head]], g[head].view(np.int64), n, h[head], h[head + n - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["key", "gram", "n", "low", "high"])

    return rows.select("key", "text").mapInArrow(tidy(run), "key long, gram long, n long, low long, high long")


def repeated_grams(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, grams, mixed, busy): for each document the grams that are named at two positions or more, those among them whose segments differ, and of these those named at more than BUSY positions."""
    named = grams(rows, width, gram)
    shared = named.groupBy("gram").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    shared = shared.filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("differ"), (F.col("n") > BUSY).alias("much"))
    both = named.select("key", "gram").join(shared, "gram")
    differs, much = F.col("differ"), F.col("differ") & F.col("much")
    return both.groupBy("key").agg(F.collect_set("gram").alias("grams"), F.collect_set(F.when(differs, F.col("gram"))).alias("mixed"), F.collect_set(F.when(much, F.col("gram"))).alias("busy"))


def segments(flagged: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(gram, anchor, bytes, n, key, first, busy): different segments of mixed grams, how often each is there, and one place of it."""

    def run(batches):
        for b in batches:
            keys, values = b.column(0).to_numpy(zero_copy_only=False), texts(b.column(1))
            flags, much = b.column(2).to_pylist(), b.column(3).to_pylist()
            for first, end in blocks(values, _BLOCK):
                s = _Segments(values[first:end], width, gram)
                at = s.flagged(flags[first:end])
                busy = np.isin(at, s.flagged(much[first:end]))
                a, z = s.first[at], s.first[at] + s.count[at] - 1 + width
                pieces = [s.data[x:y] for x, y in zip(a.tolist(), z.tolist())]
                own = s.text[at]
                arrays = [pa.array(s.gram[at].view(np.int64), pa.int64()), pa.array(s.anchor[at] - a, pa.int32()), pa.array(pieces, pa.binary()), pa.array(keys[first:end][own], pa.int64()), pa.array(a - s.begin[own], pa.int64()), pa.array(busy, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, ["gram", "anchor", "bytes", "key", "first", "busy"])

    # All columns of the rows are read, doc too: the shuffle of texts is then the same as the last step's and is made once.
    found = flagged.filter(F.size("mixed") > 0).select("key", "text", "mixed", "busy", "doc")
    found = found.mapInArrow(tidy(run), "gram long, anchor int, bytes binary, key long, first long, busy boolean")
    # busy follows from gram; as an aggregate it keeps both ways below on one shuffle.
    return found.groupBy("gram", "anchor", "bytes").agg(F.count("*").alias("n"), F.min("key").alias("key"), F.min("first").alias("first"), F.max("busy").alias("busy"))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by the places at which they differ, without storing the bytes between.

    A node holds a place and a child for each byte found there; -1 stands for the end of a
    string. A string goes down by those places alone to some leaf, is compared with the leaf
    once, and a node is put in where the two first differ.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | tuple | None = None

    @staticmethod
    def _at(s: bytes, place: int) -> int:
        return s[place] if place < len(s) else -1

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        path, node = [], self.root
        while isinstance(node, tuple):
            path.append(node)
            child = node[1].get(self._at(s, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node[0]]
        if s == other:
            node.append(i)
            return
        place = common_prefix(s, other)
        depth = 0
        while depth < len(path) and path[depth][0] < place:
            depth += 1
        if depth < len(path) and path[depth][0] == place:
            path[depth][1][self._at(s, place)] = [i]
            return
        below = path[depth] if depth < len(path) else node
        new = (place, {self._at(other, place): below, self._at(s, place): [i]})
        if depth:
            up = path[depth - 1]
            up[1][self._at(s, up[0])] = new
        else:
            self.root = new

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings' numbers in order, and the common prefix of each with the one before."""
        order: list[int] = []
        prefix: list[int] = []
        todo: list = [(self.root, 0)] if self.root is not None else []
        while todo:
            node, before = todo.pop()
            if isinstance(node, tuple):
                children = [node[1][k] for k in sorted(node[1])]
                todo += [(c, node[0]) for c in children[:0:-1]] + [(children[0], before)]
            else:
                order += node
                prefix += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, prefix


def deep_shallow(heads: np.ndarray, strings: list[bytes], shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings by (head, bytes), and each one's common prefix with the one before, -1 at a new head."""
    n, depth = len(strings), shallow // 8
    flat = b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings)
    keys = np.concatenate([heads.astype(_U)[:, None], np.frombuffer(flat, dtype=">u8").astype(_U).reshape(n, depth)], 1)
    order, prefix = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    done = 0
    todo: list[tuple[np.ndarray, int]] = [(np.arange(n), 0)]
    while todo:
        rows, level = todo.pop()
        if len(rows) == 1:
            order[done] = rows[0]
            done += 1
        elif level > depth:
            part = [strings[i] for i in rows.tolist()]
            trie = BlindTrie(part)
            for i in range(len(part)):
                trie.insert(i)
            own, common = trie.ordered()
            order[done : done + len(own)] = rows[own]
            prefix[done + 1 : done + len(own)] = common[1:]
            done += len(own)
        else:
            column = keys[rows, level]
            pivot = column[len(column) // 2]
            less, equal, more = rows[column < pivot], rows[column == pivot], rows[column > pivot]
            todo += [(part, k) for part, k in ((more, level), (equal, level + 1), (less, level)) if len(part)]
    # Common prefixes across parts of the quicksort: compare neighbours with the same head.
    todo_at = np.flatnonzero((prefix[1:] < 0) & (heads[order][1:] == heads[order][:-1])) + 1
    for k in todo_at.tolist():
        prefix[k] = common_prefix(strings[order[k - 1]], strings[order[k]])
    return order, prefix


def _classes(order: np.ndarray, prefix: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """For each depth (rows) and string (columns) a number that strings share if they agree to that depth."""
    new = np.cumsum(prefix[None, :] < depths[:, None], axis=1)
    out = np.empty_like(new)
    out[:, order] = new
    return out


def unique_windows(heads: np.ndarray, anchors: np.ndarray, pieces: list[bytes], counts: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> np.ndarray:
    """Boolean [offset, segment]: whether the window that lies so far before the anchor is there once only."""
    offsets = np.arange(width - gram + 1)
    right = deep_shallow(heads, [p[a + gram :] for p, a in zip(pieces, anchors.tolist())])
    left = deep_shallow(heads, [p[:a][::-1] for p, a in zip(pieces, anchors.tolist())])
    windows = np.array([len(p) for p in pieces]) - width + 1
    n = len(pieces)
    out = np.zeros((len(offsets), n), bool)
    for k in range(0, len(offsets), _OFFSETS):
        part = offsets[k : k + _OFFSETS]
        valid = (part[:, None] <= anchors[None, :]) & (part[:, None] > anchors[None, :] - windows[None, :])
        both = _classes(*right, width - gram - part) * (n + 1) + _classes(*left, part)
        both = np.where(valid, both, -1 - np.arange(n)[None, :])
        by = np.argsort(both, axis=1, kind="stable")
        ordered = np.take_along_axis(both, by, 1)
        same = ordered[:, 1:] == ordered[:, :-1]
        again = np.zeros(both.shape, bool)
        again[:, 1:] |= same
        again[:, :-1] |= same
        once = np.zeros(both.shape, bool)
        np.put_along_axis(once, by, ~again, 1)
        out[k : k + _OFFSETS] = once & valid & (counts == 1)[None, :]
    return out


def counted_windows(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(key, low, high): the windows of busy grams that are there once only, each a range of one, counted by hash of gram and window."""

    def run(batches):
        for b in batches:
            for gram, piece, n, key, first in zip(*(c.to_pylist() for c in b.columns)):
                h = rolling(np.frombuffer(piece, dtype=np.uint8).astype(_U) + _U(1), width).view(np.int64)
                m = len(h)
                arrays = [np.full(m, gram), h, np.full(m, n), np.full(m, key), first + np.arange(m)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["gram", "window", "n", "key", "low"])

    rows = found.select("gram", "bytes", "n", "key", "first").mapInArrow(tidy(run), "gram long, window long, n long, key long, low long")
    once = rows.groupBy("gram", "window").agg(F.sum("n").alias("n"), F.min("key").alias("key"), F.min("low").alias("low")).filter("n = 1")
    return once.select("key", "low", (F.col("low") + 1).alias("high"))


def unique_ranges(found: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(key, unique): ranges of window starts that name a repeated gram but are there once only.

    found is from `segments`; the segments of a gram that is not busy meet in one task.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        heads = np.array([r[0] for r in rows], dtype=np.int64).view(_U)
        anchors = np.array([r[1] for r in rows], dtype=np.int64)
        once = unique_windows(heads, anchors, [r[2] for r in rows], np.array([r[3] for r in rows]), width, gram)
        keys, low, high = [], [], []
        for j in np.flatnonzero(once.any(0)).tolist():
            starts = np.sort(rows[j][5] + anchors[j] - np.flatnonzero(once[:, j]))
            cut = np.flatnonzero(np.diff(starts) > 1)
            for x, y in zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist()):
                keys.append(rows[j][4])
                low.append(x)
                high.append(y + 1)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["key", "low", "high"])

    def run(batches):
        waiting: list[tuple] = []
        group: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and group[0][0] != row[0]:
                    if len(group) > 1 or group[0][3] == 1:
                        waiting += group
                    group = []
                    if len(waiting) >= _ROWS:
                        yield settle(waiting)
                        waiting = []
                group.append(row)
        if len(group) > 1 or group and group[0][3] == 1:
            waiting += group
        if waiting:
            yield settle(waiting)

    met = found.filter("NOT busy").repartition("gram").sortWithinPartitions("gram").select("gram", "anchor", "bytes", "n", "key", "first")
    ranges = met.mapInArrow(tidy(run), "key long, low long, high long")
    ranges = ranges.unionAll(counted_windows(found.filter("busy"), width))
    return ranges.groupBy("key").agg(F.collect_list(F.struct("low", "high")).alias("unique"))


def dedup_suffixes(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (first byte and byte after the last) and kept (binary).

    The texts cross one shuffle, by doc_id and text; later steps read it.
    """
    rows = docs.select(doc_key().alias("doc"), row_key().alias("key"), "text")
    flagged = rows.join(repeated_grams(rows, width, gram), "key", "left")
    both = flagged.join(unique_ranges(segments(flagged, width, gram), width, gram), "key", "left").select("doc", "text", "grams", "unique")

    def run(batches):
        for b in batches:
            values, flags, unique = texts(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()
            for first, end in blocks(values, _BLOCK):
                part = values[first:end]
                s = _Segments(part, width, gram)
                marks = np.zeros(len(s.data) + 1, dtype=np.int32)
                at = s.flagged(flags[first:end])
                np.add.at(marks, s.first[at], 1)
                np.add.at(marks, s.first[at] + s.count[at], -1)
                repeated = np.cumsum(marks[:-1]) > 0
                for d, ranges in enumerate(unique[first:end]):
                    for r in ranges or ():
                        repeated[s.begin[d] + r["low"] : s.begin[d] + r["high"]] = False
                start = np.flatnonzero(repeated)
                cover = np.zeros(len(s.data) + width + 1, dtype=np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + width, -1)
                gone = np.cumsum(cover)[: len(s.data)] > 0
                kept, lost, spans = [], [], []
                for d, v in enumerate(part):
                    own = gone[s.begin[d] : s.stop[d]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))).tolist()
                    pieces, place = [], 0
                    for x, y in zip(edge[::2], edge[1::2]):
                        pieces.append(v[place:x])
                        place = y
                    kept.append(b"".join([*pieces, v[place:]]))
                    lost.append(len(v) - len(kept[-1]))
                    spans.append([{"first": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
                arrays = [b.column(0).slice(first, end - first), pa.array([len(v) for v in part], pa.int64()), pa.array(lost, pa.int64()), pa.array([len(x) for x in spans], pa.int64())]
                arrays += [pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    done = both.mapInArrow(tidy(run), "key long, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,end:long>>, kept binary")
    doc_id = F.when(F.col("key") != NULL_ID, F.col("key")).cast(docs.schema["doc_id"].dataType)
    return done.select(doc_id.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept")
