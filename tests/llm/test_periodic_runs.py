"""Periodic runs against all lags of all places, and the counts of lags by both ways."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quarry.llm import periodic_runs as pr
from quarry.llm import queries


def brute_runs(w, least=24, times=3):
    out = []
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length = i - start + q
            i += 1
            if length >= max(least, times * q):
                part = w[start : start + length]
                if not any(part[d:] == part[:-d] for d in range(1, q)):
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(draw, n, letters):
    w = [draw.randrange(letters) for _ in range(n)]
    for _ in range(draw.randint(0, 3)):
        if n > 9:
            s = draw.randrange(n)
            p, e = draw.randint(1, max(1, (n - s) // 3)), draw.randint(s, n)
            for i in range(s, e):
                w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_all_lags(seed):
    draw = random.Random(seed)
    found = 0
    for _ in range(250):
        w = planted(draw, draw.randint(0, 170), draw.choice([1, 2, 3, 5, 50]))
        runs = pr.runs_of(np.array(w, np.int64))
        assert runs == brute_runs(w)
        marks = [any(s + q <= i < s + n for s, n, q in runs) for i in range(len(w))]
        assert pr.repeated_words(len(w), runs).tolist() == marks
        found += len(runs)
    assert found > 50


@pytest.mark.parametrize("cost", [1e-9, 0.05, 1e9])
def test_lags_are_counted_alike_by_transform_and_pairs(monkeypatch, cost):
    monkeypatch.setattr(pr, "_FFT_COST", cost)
    draw = np.random.default_rng(2)
    for n in (24, 100, 1500):
        w = np.unique(draw.zipf(1.4, n), return_inverse=True)[1]
        counts = pr.lag_counts(w, n // 3)
        assert counts[1:].tolist() == [int((w[:-q] == w[q:]).sum()) for q in range(1, n // 3 + 1)]


def test_a_very_long_text(spark):
    """A text above 2 MB: one period over most of it, found whole."""
    draw = random.Random(9)
    loop = [f"word{draw.randrange(5000)}" for _ in range(40_001)]
    words = [f"a{i}" for i in range(1000)] + (loop * 9)[:350_000] + ["end"]
    text = " ".join(words)
    assert len(text) > 2 << 20
    rows = pr.periodic_runs(spark.createDataFrame([(7, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in rows] == [(7, 1000, 350_000, 40_001)]
    kept = pr.collapse(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    assert kept["text"] == " ".join(words[: 1000 + 40_001] + ["end"]) and kept["n_dropped"] == 350_000 - 40_001


def expected(doc_id, text):
    w = [] if text is None else text.encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    figures = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *figures, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def test_op13_edge_rows(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    draw = random.Random(3)
    rows = [(i, " ".join(f"w{draw.randrange(40)}" for _ in range(draw.randint(1, 200)))) for i in ids]
    rows += [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (5, "x y " * 25), (5, "x y " * 25), (6, "b\x0bc\x0cd " * 20), (ids[0], ""), (ids[1], None), (-4, "one")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, start string")
    got = pr.run_digest(queries.with_planted_runs(df)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((expected(i, t) for i, t in rows), key=repr)
    assert pr.run_digest(queries.with_planted_runs(df.filter("false"))).count() == 0


def test_collapse_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b " * 20, 5, "x"), (2, "no  run", 6, "y"), (3, None, 7, None)], "doc_id long, text string, n_runs int, c0 string")
    assert [tuple(r) for r in pr.collapse(df).collect()] == [(1, "a b", 5, "x", 1, 38), (2, "no  run", 6, "y", 0, 0), (3, None, 7, None, 0, 0)]
    assert pr.collapse(df).columns == ["doc_id", "text", "n_runs", "c0", "n_runs", "n_dropped"]
    assert pr.periodic_runs(df.filter("false")).count() == 0
