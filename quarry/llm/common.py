"""What the training-data operators share: words, rolling hashes, minimizers and written tables.

Words are the runs of `[^\\x20\\x09-\\x0D]`; `bytes.split()` splits at just these six
characters, so words are always taken from the UTF-8 bytes of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.readers import BATCH_BYTES, BATCH_ROWS, small_batches, tidy, trimmed  # noqa: F401 - for every operator
from quarry.sources.sinks import stored as written  # noqa: F401 - every operator's way to write a table

#: Java form of a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a doc_id that is null wherever ids are compared.
NULL_ID = -(2**63)
#: Bytes of text that the array functions take at once; a longer text is taken alone, whole.
BLOCK_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 9, 10, 11, 12, 13]] = True


def doc_key(column: str = "doc_id") -> Column:
    """doc_id as a long that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 64-bit hash of doc_id and text: rows that share a doc_id but not their text differ."""
    return F.xxhash64(doc_key(doc_id), F.col(text))


def narrow_batches(spark: SparkSession) -> None:
    """Bounds the bytes alone of what goes to a Python worker at once: for rows without texts."""
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # noqa: BLE001 - a Spark without this setting has its row bound alone
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8; null gives an empty text."""
    return [b"" if x is None else x.encode() for x in column.to_pylist()]


def blocks(values: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, one row at least."""
    first, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > limit:
            yield first, i
            first, size = i, 0
        size += len(v) + 1
    if first < len(values):
        yield first, len(values)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising mix of 64-bit values, so that every bit depends on all."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            inverse = _U(pow(int(_BASE), -1, 2**64))
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE)]), dtype=_U)
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inverse)]), dtype=_U)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each `width` values in a row (mixed polynomial modulo 2**64)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    up, down = _POWERS.get(len(values))
    total = np.concatenate([[_U(0)], np.cumsum(values * up, dtype=_U)])
    return mixed((total[width:] - total[:n]) * down[:n])


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the values from each start to each stop."""
    up, down = _POWERS.get(len(values) + 1)
    total = np.concatenate([[_U(0)], np.cumsum(values * up[: len(values)], dtype=_U)])
    return mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))


class Words:
    """The words of some texts as arrays: hash of each, and where each text's words begin and end."""

    def __init__(self, values: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(values) + b"\n", dtype=np.uint8)
        starts_of_text = np.cumsum([0, *(len(v) + 1 for v in values[:-1])]) if values else np.zeros(0, int)
        inside = ~_WS[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        up, down = _POWERS.get(len(data) + 1)
        total = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], dtype=_U)])
        self.hash = mixed((total[end] - total[begin]) * down[begin])
        self.first = np.searchsorted(begin, starts_of_text)
        self.count = np.diff(np.concatenate([self.first, [len(begin)]]))
        #: For each word the end of its text's words.
        self.stop = np.repeat(self.first + self.count, self.count)
        self.text = np.repeat(np.arange(len(values)), self.count)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start of each window of `width` words that lies in one text, and its hash."""
        h = rolling(self.hash, width)
        ok = np.flatnonzero(np.arange(len(h)) + width <= self.stop[: len(h)])
        return ok, h[ok]


def minimizers(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of `span` grams in a row the position of its least gram, the leftmost of equals.

    The place within a window depends on the window's content alone, so equal windows agree.
    """
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    bits = _U(max(20, int(len(grams)).bit_length()))
    least = ((grams >> bits) << bits) | np.arange(len(grams), dtype=_U)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: n], least[span - width : span - width + n])
    return (least[:n] & ((_U(1) << bits) - _U(1))).astype(np.int64)
