from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from conftest import SF
from tickloom.llm import tile_join
from tickloom.llm.queries import ORACLES, QUERIES
from tools.compare import connect, diff

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows: list[tuple], threshold: float) -> list[tuple]:
    """All pairs in double precision, joined to groups."""
    good = [k for k, (_, x) in enumerate(rows) if x and all(c is not None and np.isfinite(c) for c in x) and any(x)]
    root, count = {k: k for k in good}, defaultdict(int)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {k: np.float32(rows[k][1]).astype(float) for k in good}
    unit = {k: (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()) for k, x in unit.items()}
    for i in good:
        for j in good:
            if i < j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                count[i] += 1
                count[j] += 1
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for k in good:
        if rows[k][0] is not None:
            ids[find(k)].append(rows[k][0])
    comp = {k: min(ids[find(k)], default=None) if k in root else rows[k][0] for k in range(len(rows))}
    return sorted((str(v), count[k], str(comp[k]), v == comp[k]) for k, (v, _) in enumerate(rows))


def got(df) -> list[tuple]:
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in df.collect())


def clustered(rng, n: int, dim: int, spread: float) -> np.ndarray:
    """A third near one centre, others near many, with copies; some pairs are close to the threshold."""
    centres = rng.normal(size=(12, dim))
    at = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 12, n))
    x = centres[at] + rng.normal(size=(n, dim)) * spread * rng.choice([0.2, 0.6, 1.0, 2.0], (n, 1))
    x[rng.integers(0, n, n // 8)] = x[0]
    return x * rng.choice([1e-3, 1.0, 50.0], (n, 1))


@pytest.mark.parametrize("dim,spread,threshold,group_rows", [(8, 0.35, 0.9, 40), (64, 0.3, 0.9, None), (3, 0.5, 0.97, 25)])
def test_against_all_pairs(spark, dim, spread, threshold, group_rows):
    rng = np.random.default_rng(dim)
    rows = [(int(k), x.tolist()) for k, x in zip(rng.permutation(400), clustered(rng, 400, dim, spread).astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(tile_join.near_duplicates(df, threshold, group_rows=group_rows)) == plain(rows, threshold)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [1.0, 0.0, 0.0]),
            (None, [1.0, 0.01]), (7, [1.0, 0.0]), (None, None), (10, [-1.0, 0.0]), (11, [1e-30, 0.0]), (12, [3e38, 0.0]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (-5, [0.0, -1.0]), (-5, [-1.0, -0.01])]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA + ", name int")
    assert got(tile_join.near_duplicates(df)) == plain(rows, 0.9)
    assert got(tile_join.near_duplicates(df.limit(0))) == []
    double = spark.createDataFrame([(1, [1e300, 1e300]), (2, [1e-300, 1.1e-300]), (3, [0.0, 1e-320])], "vec_id long, embedding array<double>")
    assert got(tile_join.near_duplicates(double)) == [("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True)]


@pytest.mark.parametrize("dim", [5, 64, 1500])
def test_bounds_hold_and_few_pairs_are_computed_again(dim):
    rng = np.random.default_rng(dim)
    u = tile_join.units(clustered(rng, 600, dim, 0.3))
    q, s, e = tile_join.quantised(u)
    about = tile_join._product(q.astype(np.float32), q.astype(np.float32)).astype(float) * s[:, None] * s
    exact = (q.astype(int) @ q.astype(int).T) * s[:, None] * s
    np.testing.assert_allclose(about, exact, rtol=1e-12)
    assert (np.abs(about - u @ u.T) <= e[:, None] + e + e[:, None] * e + 1e-12).all()
    group = tile_join.Group(u, np.ones(600, dtype=np.int64), 0.9)
    near = {(a, b) for v, w in group.near(group.u) for a, b in zip(v.tolist(), w.tolist())}
    assert near == set(zip(*(x.tolist() for x in np.nonzero(group.u @ group.u.T >= 0.9))))
    assert group.computed < 0.15 * 600 * 600


def test_a_clique_leaves_a_task_as_a_forest(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(1, 16)) + rng.normal(size=(900, 16)) * 0.02, rng.normal(size=(300, 16))])
    rows = [(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))]
    df = spark.createDataFrame(rows, SCHEMA)
    distinct = tile_join.classes(df)[1]
    sent = tile_join.links(distinct, 0.9, np.dtype("<f4"), group_rows=100).count()
    assert sent < 900 * 30
    out = {r.vec_id: r for r in tile_join.near_duplicates(df, group_rows=100).collect()}
    assert all(out[k].component_id == 0 and out[k].n_links >= 899 for k in range(900)) and len(out) == 1200


def test_groups_of_far_clusters(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(16)[:8]
    x = np.concatenate([c + rng.normal(size=(200, 16)) * 0.01 for c in centres])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x.astype(np.float32))], SCHEMA)
    found = tile_join.near_duplicates(df, group_rows=50)
    assert {r.n_links for r in found.collect()} == {199}


def test_query_against_sql(spark):
    con = connect(SF)
    assert diff(QUERIES["op12_embedding_near_dedup"](spark, SF), con.sql(ORACLES["op12_embedding_near_dedup"])) is None
    con.close()
