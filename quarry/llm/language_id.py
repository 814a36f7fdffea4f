"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Texts are lower-cased, every run of other characters than letters is one blank, and each
character is predicted from the ORDER - 1 before it. Every language has its own model, in
arrays sorted by the 64-bit hash of the character sequence, with a table of leading bits
that says where to look; it holds what the language's texts hold and no more. A text's
language is the one with the lowest cross-entropy per character; a text that scores worse
than calibration rows of that language by far is rejected.

Null text and text without a letter: `und`, score 0, rejected. Only text, and for training
lang and doc_id, matter; ties go to the language first in code point order; rows are judged
each for itself. Without any labelled row every text is `und`.

Training reads at most about `train_rows` whole texts of each language, of at most
`train_chars` characters each and `train_total` over all, drawn by a hash of doc_id over all rows; every
language has one at least. These bounds are parameters, so neither the model nor what the driver
collects grows with the corpus, but with its number of languages. Scoring reads all texts whole, of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import rolling, tidy, trimmed, written

ORDER = 4
TRAIN_ROWS, TRAIN_CHARS, TRAIN_TOTAL = 400, 100_000, 40_000_000
#: Characters that a text may hold: what is left for one never seen in training.
ALPHABET = 4096
#: A text is rejected beyond so many deviations of the calibration rows, for its length, if it
#: also lies so many nats a character above their median.
REJECT_AT, REJECT_NATS = 10.0, 1.5
#: Characters scored at once, and positions looked up at once.
_BATCH_CHARS, _SCORE_CHARS = 1 << 19, 1 << 19
_U = np.uint64
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in a row and the number of codes of each text.

    A text begins with one blank; one without letters is that blank alone.
    """
    low = [" " + v.lower() for v in values]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(v) for v in low])
    codes = np.where(letter_table()[codes], codes, 32)
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    keep = (codes != 32) | first
    keep[1:] |= codes[:-1] != 32
    return codes[keep].astype(_U), np.bincount(owner[keep], minlength=len(low))


class _Sorted:
    """Rows of values by 64-bit hash: a sorted array and where each leading part begins."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], np.ascontiguousarray(values[order])
        self.shift = _U(64 - max(8, len(hashes).bit_length() + 1))
        lead = (self.hashes >> self.shift).astype(np.int64)
        self.begin = np.searchsorted(lead, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.begin).max(initial=0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 where it is not."""
        lead = (wanted >> self.shift).astype(np.int64)
        at, end = self.begin[lead], self.begin[lead + 1]
        place = np.full(len(wanted), -1, dtype=np.int32)
        rows = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            if not len(rows):
                break
            here = at[rows]
            hit = self.hashes[here] == wanted[rows]
            place[rows[hit]] = here[hit]
            at[rows] += 1
            rows = rows[~hit & (at[rows] < end[rows])]
        return place


def _counts(codes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Distinct n-grams within texts: hash, hash of all but the last, of all but the first, count."""
    stop = np.repeat(np.cumsum(lengths), lengths)
    h = rolling(codes, n)
    ok = np.flatnonzero(np.arange(len(h)) + n <= stop[: len(h)])
    grams, first, count = np.unique(h[ok], return_index=True, return_counts=True)
    at = ok[first]
    if n == 1:
        return grams, np.zeros(len(grams), _U), np.zeros(len(grams), _U), count
    shorter = rolling(codes, n - 1)
    return grams, shorter[at], shorter[at + 1], count


class _Language:
    """The Kneser-Ney model of one language: log-probabilities and log backing-off weights in sorted hash arrays, one of each for every length."""

    def __init__(self, values: list[str], order: int) -> None:
        codes, lengths = symbols(values)
        grams = [_counts(codes, lengths, n) for n in range(1, order + 1)]
        self.log: list[_Sorted] = []
        self.weight: list[_Sorted] = []
        for n, (own, heads, tails, count) in enumerate(grams, start=1):
            if n < order:  # continuation counts: how many different characters come before
                left = np.unique(grams[n][2], return_counts=True)
                count = np.zeros(len(own), np.int64)
                count[np.searchsorted(own, left[0])] = left[1]
                count = np.maximum(count, 1)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones else 0.5
            contexts, place = np.unique(heads, return_inverse=True)
            total = np.bincount(place, count, len(contexts))
            weights = discount * np.bincount(place, minlength=len(contexts)) / total
            lower = np.exp(self._known(n - 1, tails)) if n > 1 else 1 / ALPHABET
            self.log.append(_Sorted(own, np.log(np.maximum(count - discount, 0) / total[place] + weights[place] * lower).astype(np.float32)))
            self.weight.append(_Sorted(contexts, np.log(weights).astype(np.float32)))

    def _known(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams that are known to be in the table."""
        return self.log[n - 1].values[self.log[n - 1].find(hashes)].astype(float)

    def logs(self, hashes: dict[int, np.ndarray], ends: np.ndarray, n: int) -> np.ndarray:
        """Log-probability of the character at each of `ends` given the n - 1 before it; hashes[n] has every n-gram's hash by its start."""
        table, start = self.log[n - 1], ends - n + 1
        place = table.find(hashes[n][start])
        out = table.values[place] if len(table.values) else np.zeros(len(ends), np.float32)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            if n == 1:
                out[missing] = self.weight[0].values[0] + np.float32(np.log(1 / ALPHABET))
            else:
                back = self.weight[n - 1]
                context = back.find(hashes[n - 1][start[missing]])
                weight = np.where(context >= 0, back.values[context], np.float32(0)) if len(back.values) else np.float32(0)
                out[missing] = weight + self.logs(hashes, ends[missing], n - 1)
        return out


class Model:
    """Kneser-Ney models of some languages, each with arrays of its own, for scoring many texts at once."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER) -> None:
        self.langs, self.order = sorted(samples), order
        self.own = [_Language(samples[x], order) for x in self.langs]

    def entropies(self, values: list[str], only: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (texts x languages, nats) and the number of characters scored; with `only`, of that language alone."""
        codes, lengths = symbols(values)
        sums = np.zeros((len(values), len(self.langs)))
        scored = np.maximum(lengths - 1, 0)
        if not len(self.langs) or not len(codes):
            return sums, scored
        stops = np.cumsum(lengths)
        starts = stops - lengths
        index = np.arange(len(codes)) - np.repeat(starts, lengths)
        owner = np.repeat(np.arange(len(values)), lengths)
        hashes = {n: rolling(codes, n) for n in range(1, self.order + 1)}
        for n in range(2, self.order + 1):
            ends = np.flatnonzero(index == n - 1) if n < self.order else np.flatnonzero(index >= n - 1)
            for a in range(0, len(ends), _SCORE_CHARS):
                part = ends[a : a + _SCORE_CHARS]
                # An n-gram says all that its last character's probability depends on: each is looked up once.
                _, first, back = np.unique(hashes[n][part - n + 1], return_index=True, return_inverse=True)
                for j, own in enumerate(self.own):
                    if only is not None and only != j:
                        continue
                    sums[:, j] -= np.bincount(owner[part], own.logs(hashes, part[first], n)[back], len(values))
        return sums / np.maximum(scored, 1)[:, None], scored


class Identifier:
    """A model with its calibration: mean and deviation of each language's own texts."""

    def __init__(self, rows: list[tuple[str, str]], order: int = ORDER) -> None:
        fitted: dict[str, list[str]] = {}
        held: dict[str, list[str]] = {}
        for i, (lang, text) in enumerate(rows):
            (held if i % 5 == 4 else fitted).setdefault(lang, []).append(text)
        for lang, own in held.items():
            fitted.setdefault(lang, own)
        self.model = Model(fitted, order)
        langs = self.model.langs
        self.mean, self.dev = np.zeros(len(langs)), np.ones(len(langs))
        for j, lang in enumerate(langs):
            own = held.get(lang) or fitted[lang]
            entropy, n = self.model.entropies(own, j)
            rows_with = n > 0
            if rows_with.any():
                e, n = entropy[rows_with, j], n[rows_with]
                self.mean[j] = np.median(e)
                self.dev[j] = max(float(np.sqrt(np.mean(((e - self.mean[j]) * np.sqrt(np.minimum(n, 400))) ** 2))), 0.5)

    def predict(self, values: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy per character and whether rejected."""
        langs = self.model.langs
        if not langs:
            return ["und"] * len(values), np.zeros(len(values)), np.zeros(len(values)), np.ones(len(values), bool)
        entropy, n = self.model.entropies(values)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(values)), best]
        scale = np.minimum(n, 60)[:, None]
        score = 1 / np.exp(np.clip((least[:, None] - entropy) * scale, -50, 0)).sum(1)
        far = (least - self.mean[best]) * np.sqrt(np.minimum(n, 400)) / self.dev[best]
        none = n == 0
        names = ["und" if no else langs[b] for b, no in zip(best, none)]
        unlike = (far > REJECT_AT) & (least - self.mean[best] > REJECT_NATS)
        return names, np.where(none, 0.0, score), least, none | unlike


def bucket(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo divisor; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, train_total: int = TRAIN_TOTAL) -> Identifier:
    """Fit on about train_rows texts of each language, among rows whose bucket(4) is not 2, of at most train_total characters over all languages and one text of each."""
    usable = docs.filter(F.col("lang").isNotNull() & (F.length("text") <= train_chars) & (bucket(4) != 2)).select("lang", "text", "doc_id")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(4), "doc_id"), 11).cast("double") * F.lit(2.0**-53)
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    langs = max(1, counts.count())
    drawn = usable.join(counts, "lang").withColumn("draw", draw).filter(F.col("draw") < train_rows / F.col("n"))
    # A language has about train_rows rows here.
    own = Window.partitionBy("lang").orderBy("draw", "text")
    before = F.coalesce(F.sum(F.length("text")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = drawn.select("lang", "text", "draw", before.alias("before"), F.row_number().over(own).alias("place")).filter((F.col("before") < train_total // langs) & (F.col("place") <= 2 * train_rows))
    rows = kept.orderBy("draw", "lang", "text").select("lang", "text").collect()
    found = Identifier([(r["lang"], r["text"]) for r in rows])
    del rows
    trimmed()
    return found


def _identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The columns of docs as c0, c1 and so on, with lang_pred, score, entropy and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(identifier)
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = names.index("text")

    def run(batches):
        own = shared.value
        for b in batches:
            values = ["" if t is None else t for t in b.column(at).to_pylist()]
            parts, first, size = [], 0, 0
            for i, v in enumerate(values):
                if size > _BATCH_CHARS:
                    parts.append(own.predict(values[first:i]))
                    first, size = i, 0
                size += len(v)
            if first < len(values):
                parts.append(own.predict(values[first:]))
            langs = [x for p in parts for x in p[0]]
            rest = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (1, 2, 3)]
            arrays = [*b.columns, pa.array(langs, pa.string()), pa.array(rest[0], pa.float64()), pa.array(rest[1], pa.float64()), pa.array(rest[2].astype(bool), pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, "lang_pred", "score", "entropy", "rejected"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, entropy double, rejected boolean")


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The columns of docs with lang_pred, score, entropy and rejected."""
    return _identified(docs, identifier).toDF(*docs.columns, "lang_pred", "score", "entropy", "rejected")


def accepted(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    n = len(docs.columns)
    return _identified(docs, identifier).filter("NOT rejected").select(*(f"c{i}" for i in range(n))).toDF(*docs.columns)
