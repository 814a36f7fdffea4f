"""Periodic runs of words: lags are counted, heavy words by FFT and light ones by pairs, and only likely lags are scanned.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length >= max(24, 3 q)
that no neighbouring word extends. It holds at least max(24 - q, 2 q) places i with word i equal to word i + q, all in a row, an
island. So for every lag the equal pairs of the text are counted, exactly: for words that are frequent by the inverse transform of the
sum of their indicators' power spectra, for rare ones by the differences of their places. The split between the two is
where the total cost is least. Only lags with enough pairs are scanned for islands, from places `need` apart, of which
every island long enough covers one. A stretch with a smaller period that divides q is not q's.

`runs_of` gives all runs of a list of word ids, `periodic_runs` a table of runs, `collapse` the texts without the words that a run
contains after its first q words.

Null and empty texts, and texts of fewer than 24 words, have no runs. Each row is handled for itself, so null ids, ties and repeated rows do not
matter; a text of any length is taken whole, in memory in proportion to its length. An empty table gives an empty result; other columns,
whatever their names, are kept by `collapse`, and the columns made here come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import texts, tidy

LEAST, TIMES = 24, 3
#: Cost of a transform for each point and doubling, against one pair's difference: measured once, sets no result.
_FFT_COST = 0.05
#: Hits of a lag that are looked at one by one without a closer look at all before.
_FEW = 3


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words, from 0."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def lag_counts(ids: np.ndarray, longest: int) -> np.ndarray:
    """For each lag 0..longest the number of places i with ids[i] == ids[i + lag]; lag 0 is left 0."""
    n = len(ids)
    counts = np.zeros(longest + 1, np.int64)
    freq = np.bincount(ids)
    order = np.argsort(ids, kind="stable")
    # Words by frequency: the heaviest k go to the transform where that is cheaper than their pairs.
    heavy = np.argsort(-freq, kind="stable")
    size = 1 << int(n + longest).bit_length()
    transform = _FFT_COST * size * size.bit_length()
    pairs = np.cumsum((freq[heavy] * (freq[heavy] - 1) // 2)[::-1])[::-1]
    k = int(np.argmin(np.append(pairs, 0) + transform * np.arange(len(heavy) + 1)))
    if k:
        power = np.zeros(size // 2 + 1)
        for w in heavy[:k]:
            mark = np.zeros(size)
            mark[:n] = ids == w
            f = np.fft.rfft(mark)
            power += f.real**2 + f.imag**2
        # Counts are whole numbers of at most n; the transform's error is far below a half.
        counts += np.rint(np.fft.irfft(power, size)[: longest + 1]).astype(np.int64)
        is_light = np.ones(len(freq), bool)
        is_light[heavy[:k]] = False
        order = order[is_light[ids[order]]]
    word = ids[order]
    for step in range(1, n):
        left = np.flatnonzero(word[step:] == word[:-step]) if step < len(word) else ()
        if not len(left):
            break
        lag = order[left + step] - order[left]
        counts += np.bincount(lag[lag <= longest], minlength=longest + 1)
    counts[0] = 0
    return counts


def _reach(ids: np.ndarray, place: int, lag: int, step: int, forward: bool) -> int:
    """The end (forward) or the start of the island of lag that holds place, looked at in blocks that double."""
    at = place
    last = len(ids) - lag
    while True:
        a, b = (at, min(last, at + step)) if forward else (max(0, at - step), at)
        if a == b:
            return at
        wrong = np.flatnonzero(ids[a:b] != ids[a + lag : b + lag])
        if len(wrong):
            return a + int(wrong[0]) if forward else a + int(wrong[-1]) + 1
        at, step = (b, 2 * step) if forward else (a, 2 * step)


def islands(ids: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, stop) of all stretches of `need` or more places i in a row with ids[i] == ids[i + lag]."""
    last = len(ids) - lag
    marks = np.arange(need - 1, last, need)
    hits = marks[ids[marks] == ids[marks + lag]]
    if len(hits) > _FEW:
        # Half of an island that covers a hit lies on one side of it.
        sides = []
        for way in (1, -1):
            side = hits
            for j in range(1, min((need - 1) // 2, 6) + 1):
                side = side[(side + way * j >= 0) & (side + way * j < last)]
                side = side[ids[side + way * j] == ids[side + way * j + lag]]
            sides.append(side)
        hits = np.unique(np.concatenate(sides))
    found, done = [], -1
    for place in hits.tolist():
        if place < done:
            continue
        start, stop = _reach(ids, place, lag, need, False), _reach(ids, place, lag, need, True)
        done = stop
        if stop - start >= need:
            found.append((start, stop))
    return found


def _prime_factors(q: int) -> list[int]:
    found, d = [], 2
    while d * d <= q:
        if q % d == 0:
            found.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return found + [q] * (q > 1)


def runs_of(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period. times must be 2 or more."""
    n = len(ids)
    longest = n // times
    if n < least or not longest:
        return []
    counts = lag_counts(ids, longest)
    lags = np.arange(longest + 1)
    needs = np.maximum(least - lags, (times - 1) * lags)
    found = []
    for q in np.flatnonzero((counts >= needs) & (lags > 0)).tolist():
        for start, stop in islands(ids, q, int(needs[q])):
            length = stop - start + q
            # With three periods in the stretch, a smaller period exists only if it divides q.
            shorter = any(np.array_equal(ids[start : start + length - q // f], ids[start + q // f : start + length]) for f in _prime_factors(q))
            if not shorter:
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repeated_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that some run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge)[:n] > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties go to the least start, then the least period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period of every run of every text (start and length in words)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [(i, r) for i, text in enumerate(texts(b.column(1))) for r in runs_of(word_ids(text.split()), least, times)]
            places = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(places), *(pa.array([r[k] for _, r in rows], pa.int64()) for k in range(3))], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, start long, length long, period long")


def _applied(docs: DataFrame, at_text: int, keep: list[int], names: list[str], made: dict[str, str], make) -> DataFrame:
    """The kept columns of docs (by place) and what make(words, ids, runs) gives for each text."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    fields = [plain.schema[i] for i in keep]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), *(f"made_{k} {t}" for k, t in made.items())])
    out_names = [f.name for f in fields] + [f"made_{k}" for k in made]
    kinds = [pa.string() if t == "string" else pa.int64() for t in made.values()]

    def run(batches):
        for b in batches:
            rows = []
            for text in b.column(at_text).to_pylist():
                words = b"".split() if text is None else text.encode().split()
                runs = runs_of(word_ids(words)) if len(words) >= LEAST else []
                rows.append(make(text, words, runs))
            columns = zip(*rows) if rows else [()] * len(made)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(pa.array(c, t) for c, t in zip(columns, kinds))], out_names)

    return plain.mapInArrow(tidy(run), schema).toDF(*names, *made)


def _kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    gone = repeated_words(len(words), runs)
    return b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def collapse(docs: DataFrame) -> DataFrame:
    """The columns of docs, texts with runs without their repeated words (words joined by one blank), and n_runs, n_dropped. Other texts stay as they are."""

    def make(text, words, runs):
        kept = _kept(words, runs).decode() if runs else text
        return kept, len(runs), int(repeated_words(len(words), runs).sum()) if runs else 0

    names = docs.columns
    at = names.index("text")
    others = [i for i in range(len(names)) if i != at]
    done = _applied(docs, at, others, [f"c{i}" for i in others], {"text": "string", "n_runs": "long", "n_dropped": "long"}, make)
    made = ["text", "n_runs", "n_dropped"]
    return done.toDF(*(f"c{i}" for i in others), *(f"made_{m}" for m in made)).select(*(f"c{i}" if i != at else "made_text" for i in range(len(names))), "made_n_runs", "made_n_dropped").toDF(*names, "n_runs", "n_dropped")


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run's start, length, period and exponent_milli, and digests of all runs and of the kept words."""

    def make(text, words, runs):
        best = strongest(runs)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return len(runs), *figures, hashlib.sha256(told).hexdigest(), hashlib.sha256(_kept(words, runs)).hexdigest()

    made = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}
    return _applied(docs.select("doc_id", "text"), 1, [0], ["doc_id"], made, make)
