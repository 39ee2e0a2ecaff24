"""Near-duplicate vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from svloom.llm import multi_index
from svloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, similarity=0.9):
    """{position: (n_links, smallest id)} over (id, vector), all pairs."""
    vectors = [v if v and all(x is not None and np.isfinite(x) for x in v) and any(v) else None for _, v in rows]
    n = len(rows)
    linked = [[False] * n for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is not None and b is not None and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                linked[i][j] = linked[j][i] = float(a @ b) >= similarity * np.linalg.norm(a) * np.linalg.norm(b)
    top = list(range(n))
    for _ in range(n):
        new = [min([top[i], *(top[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == top:
            break
        top = new
    out = {}
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if top[j] == top[i] and rows[j][0] is not None]
        out[i] = (sum(linked[i]), min(ids) if ids else None)
    return out


def near(rng, x, cosine):
    aside = rng.standard_normal(len(x))
    aside -= aside @ x / (x @ x) * x
    return cosine * x / np.linalg.norm(x) + (1 - cosine**2) ** 0.5 * aside / np.linalg.norm(aside)


@pytest.fixture(scope="module")
def rows():
    """Chains and groups of near copies, exact copies, scaled ones, other lengths, and vectors that can't be compared."""
    rng = np.random.default_rng(3)
    found = []
    for _ in range(25):
        base = rng.standard_normal(12)
        found += [base, *(near(rng, base, c) for c in rng.uniform(0.86, 0.99, 4)), base * 3]
    hot = rng.standard_normal(12)
    found += [near(rng, hot, 0.995) for _ in range(60)] + [hot] * 30
    found = [[float(np.float32(x)) for x in v] for v in found]
    found += [v[:5] for v in found[:40]] + [[2.0], [5.0], [-1.0]]
    found += [None, [], [0.0] * 12, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [3e38] * 12, [1e-40] * 12]
    order = rng.permutation(len(found)).tolist()
    return [(k * 3 if k % 50 else None, found[j]) for k, j in enumerate(order)]


@pytest.mark.parametrize("settings", [{}, {"cell_rows": 4, "tile": 5, "recall": 1.0}])
def test_against_brute_force(spark, rows, settings):
    data = [(i, k, v) for k, (i, v) in enumerate(rows)]
    vectors = spark.createDataFrame(data, "vec_id long, `at.x` int, embedding array<float>").withColumns({"node": F.lit("n"), "VEC": F.lit(1), "n": F.lit(2)})
    got = multi_index.near_duplicates(vectors, **settings)
    assert got.columns == ["vec_id", "at.x", "node", "VEC", "n", "n_links", "component_id", "kept"]
    want = plain([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert {r["at.x"]: (r["n_links"], r["component_id"]) for r in got.collect()} == want
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.collect())


def test_recall(spark):
    """Links at just the limit, in random directions over a grid of many cells."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal((600, 32))
    found = np.concatenate([base, [near(rng, x, 0.9005) for x in base]])
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(found)], "vec_id long, embedding array<double>")
    got = multi_index.near_duplicates(vectors, recall=0.95, cell_rows=20)
    assert 0.93 * 1200 <= got.agg(F.sum("n_links")).first()[0] <= 1200


def test_grid():
    rng = np.random.default_rng(1)
    x = multi_index.unit(rng.standard_normal((500, 9)))
    grid = multi_index.learn(x, 50_000, 0.9)
    one, two = grid.halves(x)
    rows, cells = grid.visits(one, two)
    cost = one[:, :, None] + two[:, None, :]
    want = cost <= grid.limit + one.min(1)[:, None, None] + two.min(1)[:, None, None]
    got = np.zeros_like(want)
    got[rows, cells // len(grid.codes[1]), cells % len(grid.codes[1])] = True
    assert (got == want).all() and len(rows) == want.sum()
    a, b = np.meshgrid(np.arange(30), np.arange(30))
    goes = multi_index.forward(a, b)
    assert (goes ^ goes.T)[a != b].all()


def test_query_and_edges(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = plain([tuple(r) for r in table])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op12_embedding_dedup"](spark, SF).collect()}
    assert got == {table[k]["vec_id"]: v for k, v in want.items()}
    for data in ([], [(1, None)], [(1, [1.0, 2.0])]):
        small = multi_index.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
        assert [tuple(r) for r in small] == [(i, 0, i, True) for i, _ in data]
