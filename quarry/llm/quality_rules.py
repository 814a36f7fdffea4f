"""Quality rules: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains (0). Texts
with the same votes are alike to the model, so the corpus is counted by vote pattern: at
most 3**n_rules rows, whatever the number of documents. Expectation-maximisation runs on
that table and estimates, from how the rules agree alone, the share of good texts and how often
each rule's votes are right on good and on bad ones. The posterior probability of good
replaces all-must-pass: a text may stay despite the bad vote of a rule that is often wrong.

Null and empty texts have no words. Rows are judged each for itself, so nulls elsewhere, ties and
repeated rows do not matter; a text of any length is counted whole. An empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import tidy, written

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_letters", "n_upper", "n_distinct"]


def _repeat_words(words: list[bytes]) -> tuple[int, int]:
    """Words in 3-word windows found twice or more, and the number of different words."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    n = len(seen)
    if len(words) < 4:
        return 0, n
    if n >= 2**21:  # three ids no longer fit one long
        pairs = np.unique(ids[:-1] * n + ids[1:], return_inverse=True)[1][:-1]
        window = pairs * n + ids[2:]
    else:
        window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(words), dtype=bool)
    hit = np.zeros(len(window), dtype=bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    for shift in range(3):
        again[shift : shift + len(window)] |= hit
    return int(again.sum()), n


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_letters, n_upper, n_distinct."""
    text = text or ""
    data = text.encode()
    words = data.split()
    blanks = sum(data.count(c) for c in _BLANKS)
    seen: set[bytes] = set()
    dup = 0
    lines = data.split(b"\n")
    for line in lines:
        if line in seen:
            dup += bool(line.split(None, 1))
        else:
            seen.add(line)
    repeat, distinct = _repeat_words(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = len(text) - blanks - (len(data) - len(data.translate(None, _NOT_LETTER)))
    return (len(words), len(text) - blanks, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeat, len(lines), letters, upper, distinct)


_UPPER = bytes(range(65, 91))
#: ASCII characters that are neither blanks nor letters.
_NOT_LETTER = bytes(c for c in range(128) if not chr(c).isalpha() and c not in _BLANKS)


def add_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of text_counts (longs)."""
    names = _COUNTS + _MORE

    def run(batches):
        for b in batches:
            rows = [text_counts(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Name and vote of each rule over the counts: good, bad, or 0 between the two limits.

    Rules overlap, as their agreement is all that tells how far each can be believed. Texts of
    one line have no vote on their lines.
    """
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    chars = F.greatest(c("word_chars"), F.lit(1))
    letters, lines = c("n_letters") * 100, c("n_lines")
    return {
        "symbols": _vote(c("n_symbols") * 100 <= words * 5, c("n_symbols") * 100 > words * 20),
        "density": _vote(c("n_symbols") * 100 <= chars * 2, c("n_symbols") * 100 > chars * 6),
        "letters": _vote(letters >= chars * 92, letters < chars * 88),
        "repeats": _vote(c("n_repeat_words") * 100 <= words * 10, c("n_repeat_words") * 100 > words * 30),
        "variety": _vote(c("n_distinct") * 100 >= words * 40, c("n_distinct") * 100 < words * 20),
        "dup_lines": F.when(lines < 2, 0).otherwise(_vote(c("n_dup_lines") * 10 <= lines, c("n_dup_lines") * 10 > lines * 3)),
        "word_length": _vote((c("word_chars") * 2 >= words * 7) & (c("word_chars") * 2 <= words * 13), (c("word_chars") < words * 3) | (c("word_chars") > words * 7)),
        "shouting": _vote(c("n_upper") * 100 <= chars * 10, c("n_upper") * 100 > chars * 30),
        "length": _vote(c("n_words") >= 100, c("n_words") < 75),
        "lines": F.when(lines < 2, 0).otherwise(_vote(c("n_words") >= lines * 10, c("n_words") < lines * 8)),
    }


def log_odds(share: float, accuracy: np.ndarray) -> tuple[float, np.ndarray]:
    """Log odds of good before any vote, and what a bad and a good vote of each rule add."""
    on_good, on_bad = accuracy[:, 0], accuracy[:, 1]
    return float(np.log(share / (1 - share))), np.stack([np.log((1 - on_good) / on_bad), np.log(on_good / (1 - on_bad))], 1)


def fit(patterns: np.ndarray, weights: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good texts, accuracy[rule, on good or bad texts], posterior of each pattern).

    The first posterior of a pattern is the share of good votes in it. The M-step estimates
    from the posteriors the share of good texts and how often each rule's votes are right on
    good and on bad texts, one text right and one wrong added to each so that none is certain;
    the E-step multiplies the odds by each vote's likelihood ratio. An abstention says nothing.
    """
    patterns = np.asarray(patterns, dtype=int)
    n_votes = np.abs(patterns).sum(1)
    good = ((patterns > 0).sum(1) + 0.5) / (n_votes + 1)
    is_good, is_bad = (patterns > 0).astype(float), (patterns < 0).astype(float)
    share, accuracy = 0.5, np.full((patterns.shape[1], 2), 0.5)
    for _ in range(rounds if len(weights) else 0):
        before, w, v = good, weights * good, weights * (1 - good)
        share = (w.sum() + 1) / (weights.sum() + 2)
        accuracy = np.stack([(w @ is_good + 1) / (w @ (is_good + is_bad) + 2), (v @ is_bad + 1) / (v @ (is_good + is_bad) + 2)], 1)
        prior, add = log_odds(share, accuracy)
        good = 1 / (1 + np.exp(-np.clip(prior + is_bad @ add[:, 0] + is_good @ add[:, 1], -50, 50)))
        if np.abs(good - before).max() < 1e-9:
            break
    return share, accuracy, good


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, votes, quality (posterior probability) and kept.

    Each text is read once: the counts and votes are written to the shared folder.
    """
    counted = add_counts(docs)
    own = rules()
    code = sum(((v + 1) * 3**i for i, v in enumerate(own.values())), F.lit(0)).cast("int")
    voted = written(counted.withColumn("base_failed", base_failed()).withColumn("votes", code), "votes")
    # At most 3 ** n_rules rows, independent of the data's size.
    seen = voted.groupBy("votes").count().orderBy("votes").collect()
    codes = np.array([r["votes"] for r in seen], dtype=int)
    patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(own))], 1) if len(codes) else np.zeros((0, len(own)), int)
    share, accuracy, _ = fit(patterns, np.array([r["count"] for r in seen], dtype=float))
    prior, add = log_odds(share, accuracy)
    odds = F.lit(prior)
    for i, (bad, good) in enumerate(add.tolist()):
        vote = F.floor(F.col("votes") / 3**i) % 3
        odds = odds + F.when(vote == 0, bad).when(vote == 2, good).otherwise(0.0)
    judged = voted.withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 9))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
