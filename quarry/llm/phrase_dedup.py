"""Substring dedup by repeated-phrase automata.

A window is WIDTH consecutive words of one text. Every word covered by a window whose words
also start earlier (in a smaller doc_id, or earlier in the same text) is removed; windows are
judged on the input. The first occurrence stays.

1. Confirm. Each window names the least of its GRAM-word phrases by hash, so equal windows
   name equal phrases at equal places and only about one phrase in eight is named. A phrase is
   written in letters, one for each word, taken from the word's hash; phrases named at two
   places or more, in one text or several, are confirmed. Counts combine before their shuffle.
2. Compile. The confirmed phrases, whatever documents they come from, are dealt by hash to shards of
   about SHARD phrases; a task compiles its shard into an Aho-Corasick automaton.
3. Stream. All documents are streamed, each cut at the phrases that it names, and every piece goes
   to the one shard that may hold it. Occurrences come back as places in documents. A shard with
   many pieces is salted: several tasks compile it and share its pieces, so a phrase in a
   third of all documents is no hot spot.
4. Remove. Windows that name an occurrence are candidates, no others. They are grouped by hash
   to find the least doc_id that holds each, combined before the shuffle; a document keeps a candidate
   that it owns in its first place and loses all others.

Words, phrases and windows are compared by hashes. Letters have 60 // GRAM bits, and phrases that
only look alike cost time but remove nothing; windows have 64 bits: for n candidates a wrong match is
expected n**2 / 2**65 times, about 1e-5 for 2e7.

Null and empty texts have no words. A null doc_id is below all others; rows that share a
doc_id, or have none, are judged each for itself and do not take words from one another. Repeated rows and
ties so keep what is first in them. A text of any length is taken whole, at once. An empty table
gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import NULL_ID, Words, blocks, doc_key, minimizers, mixed, rolling, texts, tidy, written

WIDTH, GRAM = 20, 6
#: Phrases of one automaton and pieces that one task streams through it, about.
SHARD, PIECES = 1 << 14, 100_000
#: A shard is salted by its own size where it has this share of all pieces, so at most 10 000 are; the others by the mean.
_HEAVY = 1e-4
_TOTAL = -1
_FIRST_LETTER, _GAP = 0x100, 0x20
_U = np.uint64


class _Block:
    """The words of some texts, their windows, and the place of the phrase that each window names."""

    def __init__(self, values: list[bytes], width: int, gram: int) -> None:
        self.words, self.gram = Words(values), gram
        least = minimizers(rolling(self.words.hash, gram), width - gram + 1)
        self.starts = np.flatnonzero(np.arange(len(least)) + width <= self.words.stop[: len(least)])
        self.at = least[self.starts]
        self.owner = self.words.text[self.starts]
        self.windows = rolling(self.words.hash, width)

    def named(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place in it and letters of each phrase that is named, once for each place."""
        at = np.unique(self.at)
        bits = 60 // self.gram
        letters = self.words.hash >> _U(64 - bits)
        code = np.zeros(len(at), dtype=_U)
        for k in range(self.gram):
            code |= letters[at + k] << _U(bits * k)
        own = self.words.text[at]
        return own, at - self.words.first[own], code.view(np.int64)

    def found(self, places: list) -> np.ndarray:
        """Numbers of the windows whose phrase is at one of their text's places (null: none)."""
        hit = np.zeros(len(self.words.hash), bool)
        for d, own in enumerate(places):
            if own is not None and len(own):
                hit[self.words.first[d] + own] = True
        return np.flatnonzero(hit[self.at])

    def named_windows(self, which: np.ndarray) -> np.ndarray:
        """Hashes of windows by number, different for different texts."""
        return mixed(self.owner[which].astype(_U) + _U(1)) ^ self.windows[self.starts[which]]


def _first_of_each(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its equals."""
    order = np.argsort(values, kind="stable")
    first = np.ones(len(values), bool)
    first[order[1:]] = values[order[1:]] != values[order[:-1]]
    return first


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c, pa.int64()) for c in columns]


def _rows(docs: DataFrame) -> DataFrame:
    """doc, part (what a document's shuffle is dealt by), version (tells texts under one part apart) and text."""
    part = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    return docs.select(doc_key().alias("doc"), part.alias("part"), F.hash("text").cast("long").alias("version"), "text")


def confirmed(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(phrase, n): phrases named at two places or more, and one row _TOTAL with the number of all places."""

    def run(batches):
        for b in batches:
            values = texts(b.column(0))
            for first, end in blocks(values):
                phrase, n = np.unique(_Block(values[first:end], width, gram).named()[2], return_counts=True)
                yield pa.RecordBatch.from_arrays(_longs(np.append(phrase, _TOTAL), np.append(n, n.sum())), ["phrase", "n"])

    named = rows.select("text").mapInArrow(tidy(run), "phrase long, n long")
    return named.groupBy("phrase").agg(F.sum("n").alias("n")).filter("n > 1")


def pieces(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(phrase, part, place): all documents, cut at the phrases that they name. The high half of place is the version."""

    def run(batches):
        for b in batches:
            part, version = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            values = texts(b.column(2))
            for first, end in blocks(values):
                own, at, phrase = _Block(values[first:end], width, gram).named()
                place = (version[first:end][own] << 32) | at
                yield pa.RecordBatch.from_arrays(_longs(phrase, part[first:end][own], place), ["phrase", "part", "place"])

    return rows.select("part", "version", "text").mapInArrow(tidy(run), "phrase long, part long, place long")


def _text(phrases: np.ndarray, gram: int) -> str:
    """Phrases as one text, a letter for each word and a gap after each phrase."""
    bits = 60 // gram
    shifts = (np.arange(gram) * bits).astype(_U)
    letters = (phrases.view(_U)[:, None] >> shifts[None, :]) & _U((1 << bits) - 1)
    out = np.full((len(phrases), gram + 1), _GAP, dtype="<u2")
    out[:, :gram] = letters + _U(_FIRST_LETTER)
    return out.tobytes().decode("utf-16-le")


def compiled(phrases: list[np.ndarray], gram: int = GRAM) -> ahocorasick.Automaton:
    """The automaton of some phrases."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = _text(np.concatenate(phrases), gram)
    for k in range(0, len(text), gram + 1):
        automaton.add_word(text[k : k + gram])
    automaton.make_automaton()
    return automaton


def streamed(automaton: ahocorasick.Automaton, phrases: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Numbers of the pieces in which the automaton finds a phrase."""
    ends = np.fromiter((end for end, _ in automaton.iter(_text(phrases, gram))), np.int64)
    return ends // (gram + 1)


def occurrences(rows: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(part, places): where each document holds a confirmed phrase, found by the shards' automata."""
    known = written(confirmed(rows, width, gram), "phrases")
    # One row with two sums; the phrases stay where they are.
    sums = known.agg(F.count_if(F.col("phrase") >= 0).alias("phrases"), F.max(F.when(F.col("phrase") == _TOTAL, F.col("n"))).alias("pieces"), F.sum(F.when(F.col("phrase") >= 0, F.col("n"))).alias("held")).first()
    total, held = sums["pieces"] or 0, sums["held"] or 0
    shards = max(1, -(-(sums["phrases"] or 0) // SHARD))
    shard = F.pmod(F.xxhash64("phrase"), F.lit(shards)).alias("shard")
    mean = max(1, -(-total // (shards * PIECES)))
    known = known.filter(F.col("phrase") >= 0).select(shard, "phrase", "n")
    sizes = known.groupBy("shard").agg(F.sum("n").alias("held")).filter(F.col("held") >= max(PIECES, _HEAVY * held))
    heavy = F.broadcast(sizes.select("shard", F.ceil((F.col("held") + (total - held) / shards) / PIECES).alias("own")))
    salts = F.coalesce("own", F.lit(mean))
    null = F.lit(None).cast("long")
    to_compile = known.join(heavy, "shard", "left").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "phrase", null.alias("part"), null.alias("place"))
    to_stream = pieces(rows, width, gram).withColumn("shard", shard).join(heavy, "shard", "left").select("shard", F.pmod(F.xxhash64("part"), salts).alias("salt"), "phrase", "part", "place")

    def run(batches):
        group, waiting, automaton = None, [], None
        for b in batches:
            shard, salt, phrase = (b.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            is_piece = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            if not len(shard):
                continue
            new = (shard[1:] != shard[:-1]) | (salt[1:] != salt[:-1]) | (is_piece[1:] != is_piece[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(shard)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if (shard[x], salt[x]) != group:
                    group, waiting, automaton = (shard[x], salt[x]), [], None
                if not is_piece[x]:
                    waiting.append(phrase[x:y])
                    continue
                if waiting:
                    automaton, waiting = compiled(waiting, gram), []
                if automaton is not None:
                    hit = pa.array(x + streamed(automaton, phrase[x:y], gram))
                    yield pa.RecordBatch.from_arrays([b.column(3).take(hit), b.column(4).take(hit)], ["part", "place"])

    both = to_compile.unionAll(to_stream).repartition("shard", "salt").sortWithinPartitions("shard", "salt", F.col("part").isNotNull())
    return both.mapInArrow(tidy(run), "part long, place long").groupBy("part").agg(F.collect_list("place").alias("places"))


def _own_places(version: np.ndarray, places: list) -> list:
    """Each row's places, those of other texts under the same part left out."""
    out = []
    for v, p in zip(version.tolist(), places):
        if p is not None:
            p = np.asarray(p, dtype=np.int64)
            p = p[p >> 32 == v] & 0xFFFFFFFF
        out.append(p)
    return out


def owned_windows(flagged: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(owner, owned): the candidate windows of which each document is the least that holds them; those with no doc_id own all theirs.

    flagged has doc, version, text and places.
    """

    def run(batches):
        for b in batches:
            docs, version, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), texts(b.column(2))
            places = _own_places(version, b.column(3).to_pylist())
            for first, end in blocks(values):
                block = _Block(values[first:end], width, gram)
                which = block.found(places[first:end])
                which = which[_first_of_each(block.named_windows(which))]
                yield pa.RecordBatch.from_arrays(_longs(block.windows[block.starts[which]].view(np.int64), docs[first:end][block.owner[which]]), ["window", "doc"])

    held = flagged.filter(F.col("places").isNotNull()).select("doc", "version", "text", "places").mapInArrow(tidy(run), "window long, doc long")
    first = held.groupBy("window").agg(F.min("doc").alias("owner")).filter(F.col("owner") != NULL_ID)
    return first.groupBy("owner").agg(F.collect_list("window").alias("owned"))


def dedup_phrases(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and word after the last of each removed run) and kept_text.

    The texts cross one shuffle, by doc_id; all later steps read it.
    """
    rows = _rows(docs)
    flagged = rows.join(written(occurrences(rows, width, gram), "places"), "part", "left")
    both = flagged.join(owned_windows(flagged, width, gram), F.col("part") == F.col("owner"), "left").select("doc", "version", "text", "places", "owned")

    def run(batches):
        for b in batches:
            docs, version, values = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), texts(b.column(2))
            places, owned = _own_places(version, b.column(3).to_pylist()), b.column(4).to_pylist()
            for first, end in blocks(values):
                part = values[first:end]
                block = _Block(part, width, gram)
                words = block.words
                which = block.found(places[first:end])
                named = block.named_windows(which)
                held = [np.zeros(0, np.int64), *(np.asarray(o, dtype=np.int64) for o in owned[first:end] if o is not None)]
                sizes = [0 if o is None else len(o) for o in owned[first:end]]
                own = mixed(np.repeat(np.arange(len(part)), sizes).astype(_U) + _U(1)) ^ np.concatenate(held).view(_U)
                stays = (np.isin(named, own) | (docs[first:end][block.owner[which]] == NULL_ID)) & _first_of_each(named)
                lost = block.starts[which[~stays]]
                gone = np.zeros(len(words.hash) + 1, dtype=np.int32)
                gone[lost] += 1
                gone[lost + width] -= 1
                removed = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(removed)])
                n_lost = total[words.first + words.count] - total[words.first]
                kept, spans = [], []
                for d, v in enumerate(part):
                    text = v.split()
                    if not n_lost[d]:
                        kept.append(b" ".join(text).decode())
                        spans.append([])
                        continue
                    here = removed[words.first[d] : words.first[d] + words.count[d]]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], here.astype(np.int8), [0]]))).tolist()
                    spans.append([{"first": x, "end": y} for x, y in zip(edge[::2], edge[1::2])])
                    pieces, place = [], 0
                    for x, y in zip(edge[::2], edge[1::2]):
                        pieces += text[place:x]
                        place = y
                    kept.append(b" ".join(pieces + text[place:]).decode())
                arrays = [b.column(0).slice(first, end - first), pa.array(words.count, pa.int64()), pa.array(n_lost, pa.int64())]
                arrays += [pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc", "n_words", "n_removed", "spans", "kept_text"])

    done = both.mapInArrow(tidy(run), "doc long, n_words long, n_removed long, spans array<struct<first:long,end:long>>, kept_text string")
    doc_id = F.when(F.col("doc") != NULL_ID, F.col("doc")).cast(docs.schema["doc_id"].dataType)
    return done.select(doc_id.alias("doc_id"), "n_words", "n_removed", "spans", "kept_text")
