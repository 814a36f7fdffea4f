"""Quantile summaries against sorted rows: bounds hold at every level, in every round, for every shape of group."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from quarry.llm import quantile_summary as qs
from quarry.llm import queries


def holds(s, rows):
    """The bounds of a summary are true for rows."""
    rows = np.sort(rows)
    below, upto = np.searchsorted(rows, s.x), np.searchsorted(rows, s.x, "right")
    assert s.n == len(rows) and s.x[0] == rows[0] and s.x[-1] == rows[-1] and (np.diff(s.x) > 0).all()
    assert (s.lt_lo <= below).all() and (below <= s.lt_hi).all() and (s.le_lo <= upto).all() and (upto <= s.le_hi).all()


@pytest.mark.parametrize("seed", range(6))
def test_hierarchy_bounds(seed):
    draw = np.random.default_rng(seed)
    shape = [lambda n: draw.integers(0, 10**9, n), lambda n: draw.integers(0, 7, n), lambda n: np.arange(n), lambda n: np.where(draw.random(n) < 0.99, 5, draw.integers(-50, 50, n))][seed % 4]
    rows = shape(30_000).astype(np.int64)
    parts = []
    for piece in np.array_split(rows, 5):
        h = qs.Hierarchy(0.02, 32)
        for a in range(0, len(piece), 100):
            h.add(piece[a : a + 100], np.ones(len(piece[a : a + 100]), np.int64))
        parts.append(h.result())
        holds(parts[-1], piece)
    top = qs.Hierarchy(0.02, 32)
    for s in parts:
        top.insert(s)
    s = qs.pruned(top.result(), 50)
    holds(s, rows)
    assert min(4, len(np.unique(rows))) <= len(s.x) <= 50
    gaps = s.lt_hi[1:] - s.le_lo[:-1]
    assert gaps.max() <= (2 * 0.02 + 1 / 49) * len(rows) + 2
    targets = -(-np.arange(1, 10) * len(rows) // 10)
    at, bound = qs.best_points(s, targets)
    ordered = np.sort(rows)
    below, upto = np.searchsorted(ordered, s.x[at]), np.searchsorted(ordered, s.x[at], "right")
    error = np.maximum(0, np.maximum(below + 1 - targets, targets - upto))
    assert (error <= bound).all() and (np.diff(s.x[at]) >= 0).all()


def test_local_errors_sum_to_the_bound():
    assert sum(1 / (qs.level_points(level, 0.0125) - 1) / 2 for level in range(1, 200)) <= 0.0125


def brute(rows, keys, parts, least):
    out = {}
    for k, g in rows.groupby(keys, dropna=False):
        xs = np.sort(np.repeat(g["v"].to_numpy(), g["w"].to_numpy()))
        if len(xs) >= least:
            out[tuple(None if pd.isna(x) else x for x in k)] = xs
    return out


def test_rounds_of_lanes_agree_with_sorted_rows(spark):
    draw = random.Random(5)
    rows = [("hot", i % 2, draw.randint(-10**6, 10**12), 1) for i in range(6000)]
    rows += [("tied", 0, draw.choice([1, 2, 2, 2, 3]), draw.randint(1, 5)) for _ in range(500)]
    rows += [(f"g{i}", 1, draw.randint(0, 9), 1) for i in range(300)] + [(None, 0, 7, 25), ("lone", 0, -3, 1)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "name string, b int, v long, w long").repartition(9)
    found = qs.summarise(df, ["name", "b"], "v", "w", error=0.02, max_points=40, block=64, fan=2)
    every = pd.DataFrame(rows, columns=["name", "b", "v", "w"])
    want = brute(every, ["name", "b"], 10, 1)
    got = {(r["name"], r["b"]): r for r in found.collect()}
    assert set(got) == set(want)
    for k, xs in want.items():
        r = got[k]
        assert r["n"] == len(xs) and min(4, len(set(xs))) <= len(r["x"]) <= min(len(xs), 40)
        if not r["level"]:
            assert r["x"] == sorted(set(xs)) and r["le_lo"] == np.searchsorted(xs, r["x"], "right").tolist()
    both = found.unionByName(qs.merged_batches(found, ["name"], 0.02, 40, 64).selectExpr("*", "-1 AS b"))
    answers = qs.quantiles(both, ["name", "b"], 10, 20)
    cells = df.groupBy("name", "b", "v").agg({"w": "sum"}).toDF("name", "b", "x", "weight")
    whole = cells.groupBy("name", "x").agg({"weight": "sum"}).toDF("name", "x", "weight").selectExpr("*", "-1 AS b")
    # A null key meets no other in a join, so exact ranks are asked for named groups.
    ranked = qs.with_rank_error(qs.exact_ranks(cells.unionByName(whole).filter("name IS NOT NULL"), answers.filter("name IS NOT NULL"), ["name", "b"]), 80).toPandas()
    want = brute(pd.concat([every, every.assign(b=-1)]), ["name", "b"], 10, 20)
    want = {k: v for k, v in want.items() if k[0] is not None}
    assert {(a, b) for a, b in zip(ranked["name"], ranked["b"])} == set(want)
    for k, g in ranked.groupby(["name", "b"]):
        xs, g = want[k], g.sort_values("i")
        t = -(-np.arange(1, 10) * len(xs) // 10)
        assert g["i"].tolist() == list(range(1, 10)) and g["target"].tolist() == t.tolist() and g["exact_x"].tolist() == xs[t - 1].tolist()
        assert g["n_below"].tolist() == np.searchsorted(xs, g["answer"]).tolist() and g["n_upto"].tolist() == np.searchsorted(xs, g["answer"], "right").tolist()
        assert g["within"].all() and (g["rank_error"] <= g["bound"]).all() and g["answer"].is_monotonic_increasing
    assert ranked["points"].max() == 40


def test_empty_nulls_and_other_columns(spark):
    schema = "grp string, b int, v long, w long, lane string, x string"
    assert qs.summarise(spark.createDataFrame([], schema), ["grp", "b"], "v", "w").count() == 0
    rows = [("a", 0, None, 1, "z", "y"), ("a", 0, 4, None, "z", "y"), ("a", 0, 4, 0, "z", "y"), ("a", 0, 5, 2, None, None)]
    found = qs.summarise(spark.createDataFrame(rows, schema), ["grp", "b"], "v", "w").collect()
    assert [(r["grp"], r["n"], r["x"], r["le_lo"]) for r in found] == [("a", 2, [5], [2])]
    unweighted = qs.summarise(spark.createDataFrame(rows, schema), ["grp"], "v").collect()
    assert [(r["n"], r["x"], r["le_lo"]) for r in unweighted] == [(3, [4, 5], [2, 3])]


def test_groups_that_span_batches():
    kinds, names = [pa.string()], ["k", "level", "n", *qs._ARRAYS]
    rows = [("a", 3), ("a", 1), ("b", 2), ("b", 2), ("b", 9), ("c", 0)] + [("d", i) for i in range(40)] + [("e", 1)]
    for size in (1, 2, 3, 7, 100):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = (pa.RecordBatch.from_arrays([pa.array([r[0] for r in p]), pa.array([r[1] for r in p], pa.int64()), pa.array([1] * len(p), pa.int64())], ["k", "x", "weight"]) for p in parts)
        out = [r for b in qs._folded(batches, kinds, names, True, 0.1, 16, 8) for r in b.to_pylist()]
        assert sorted((r["k"], r["n"]) for r in out) == [("a", 2), ("b", 3), ("c", 1), ("d", 40), ("e", 1)]
        assert {r["k"]: r["x"] for r in out if r["k"] != "d"} == {"a": [1, 3], "b": [2, 9], "c": [0], "e": [1]}
        assert all(len(r["x"]) <= 8 for r in out)


def test_op12_on_the_tables(spark):
    found = queries.op12_quantile_summary(spark, "/root/testdata/sf0.001").toPandas()
    clicks = pd.read_parquet("/root/testdata/sf0.001/clicks.parquet").dropna(subset=["client_id", "value"]).drop_duplicates("click_id")
    import zlib

    clicks["x"] = np.floor(100 * clicks["value"] + 0.5).astype("int64") + 1000 * np.array([zlib.crc32(str(i).encode()) % 8 for i in clicks["click_id"]])
    clicks["grp"] = clicks["client_id"].astype("int64").astype(str)
    sizes = clicks.groupby("grp").size()
    mine = found[(found["stream"] == "value") & (found["batch"] == -1)]
    assert set(mine["grp"]) == set(sizes[sizes >= 20].index) and found["within"].all() and (found["rank_error"] <= found["bound"]).all()
    for grp, g in mine.groupby("grp"):
        xs, g = np.sort(clicks.loc[clicks["grp"] == grp, "x"].to_numpy()), g.sort_values("i")
        assert g["exact_x"].tolist() == xs[g["target"] - 1].tolist() and g["n_below"].tolist() == np.searchsorted(xs, g["answer"]).tolist()
    assert set(found.loc[found["stream"] == "price", "batch"]) == set(range(-1, 8))


def test_op12_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Null ids, groups and amounts, rows twice, amounts that are no numbers, columns named like those made on the way."""
    clicks = [(i % 30, "2024-01-01 00:00:00", 5 if i % 3 else None, float(i % 30) if i % 7 else None) for i in range(90)] + [(None, None, 5, 1.0)] * 3 + [(900, None, 5, float("nan")), (901, None, 5, float("inf"))]
    rows = spark.createDataFrame(clicks, "click_id long, arrived_at string, client_id long, value double").selectExpr("click_id", "cast(arrived_at as timestamp_ntz) arrived_at", "client_id", "value", "'x' lane", "1 batch", "2L x", "'y' grp")
    rows.write.parquet(f"{tmp_path}/clicks.parquet")
    lines = spark.createDataFrame([(i % 4 if i % 5 else None, i % 3 if i % 11 else None, "z") for i in range(200)], "item_id long, vendor_id long, weight string")
    lines.write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame([(0, "B", 1.5), (0, "B", 1.5), (1, None, 2.0), (2, "B", None), (3, "C", 2.25)], "item_id long, brand string, price double").write.parquet(f"{tmp_path}/items.parquet")
    found = queries.op12_quantile_summary(spark, str(tmp_path)).toPandas()
    kept = {}
    for i, _, client, value in clicks:
        if client is not None and value is not None and np.isfinite(value):
            kept.setdefault(i, value)
    sizes = found[found["batch"] == -1].groupby(["stream", "grp"])["n"].first().to_dict()
    want = {("value", "5"): len(kept), ("price", "B"): sum(i % 5 > 0 and i % 4 == 0 for i in range(200)), ("price", "C"): sum(i % 5 > 0 and i % 4 == 3 for i in range(200))}
    assert sizes == {k: n for k, n in want.items() if n >= 20} and len(sizes) >= 2 and found["within"].all()


def test_op12_ranks_only_batches_with_answers(spark, monkeypatch):
    """Cells of batches of fewer than 20 rows stay behind; the whole's groups have all their rows."""
    tables, made = {}, queries.written
    monkeypatch.setattr(queries, "written", lambda rows, name, *more: tables.setdefault(name, made(rows, name, *more)))
    queries.op12_quantile_summary(spark, "/root/testdata/sf0.001")
    keys = ["stream", "grp", "batch"]
    n = tables["all-cells"].groupBy(*keys).agg({"weight": "sum"}).toDF(*keys, "n").toPandas()
    own = tables["cells"].groupBy(*keys).agg({"weight": "sum"}).toDF(*keys, "n").toPandas()
    assert (own["n"] < 20).any() and n.loc[n["batch"] >= 0, "n"].min() >= 20
    assert (n["batch"] >= 0).sum() == (own["n"] >= 20).sum() and n.loc[n["batch"] < 0, "n"].sum() == own["n"].sum()
