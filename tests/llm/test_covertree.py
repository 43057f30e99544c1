import numpy as np
import pytest

from lodequery.llm import covertree


def cloud(rng, n, dims, groups):
    base = rng.normal(size=(groups, dims))
    x = base[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.02, 0.1, 0.3], n)[:, None]
    return x * rng.uniform(0.1, 9, n)[:, None]


def plain(raw, threshold=0.98):
    u = raw / np.linalg.norm(raw, axis=1)[:, None]
    c = u @ u.T
    return [(i, j) for i in range(len(raw)) for j in range(i + 1, len(raw)) if c[i, j] >= threshold]


@pytest.mark.parametrize("n,dims,groups", [(1, 3, 1), (2, 2, 1), (60, 2, 3), (300, 8, 9), (400, 64, 40), (200, 16, 1)])
def test_pairs_against_brute_force(n, dims, groups):
    raw = cloud(np.random.default_rng(n), n, dims, groups)
    assert covertree.exact_pairs(raw) == plain(raw)


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(8)
    x = cloud(rng, 80, 16, 5)
    want = plain(x)
    sizes = np.array([1e200, 1e-200, 1.0, 1e150, 1e-160])[np.arange(80) % 5]
    assert covertree.exact_pairs(x * sizes[:, None]) == want and want
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x * sizes[:, None])]
    got = {r.vec_id: r.n_links for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: sum(i in p for p in want) for i in range(80)}


def test_tree_covers_with_halving_radii():
    points = covertree.unit(cloud(np.random.default_rng(5), 300, 6, 10))
    t = covertree.Tree(points)
    assert sorted(t.order.tolist()) == list(range(300))
    for k in range(len(t.center)):
        own = t.order[t.lo[k] : t.hi[k]]
        assert covertree.distances(points[own], points[[t.center[k]]]).max() <= t.radius[k] + 1e-12
        for c in t.kids[k]:
            assert t.radius[c] < t.radius[k] and t.lo[k] <= t.lo[c] and t.hi[c] <= t.hi[k]
        if len(t.kids[k]):
            assert t.center[t.kids[k][0]] == t.center[k]  # nested


@pytest.mark.parametrize("numbers,group,grid,pivots", [(1 << 18, 8, 16, 1 << 20), (1 << 9, 8, 16, 1 << 20), (1 << 8, 3, 1, 1 << 20), (1 << 8, 2, 2, 0)])
def test_table(spark, monkeypatch, numbers, group, grid, pivots):
    for name, value in (("BLOCK_NUMBERS", numbers), ("GROUP", group), ("GRID", grid), ("PIVOT_NUMBERS", pivots)):
        monkeypatch.setattr(covertree, name, value)
    rng = np.random.default_rng(7)
    raw = cloud(rng, 500, 4, 25).astype(np.float32)
    raw[100:140] = raw[100]
    labels = [int(x) for x in rng.integers(0, 3, 500)]
    rows = [(i, [float(v) for v in raw[i]], labels[i], "x") for i in range(500)]
    nan = float("nan")
    rows += [(600, None, 1, "x"), (601, [0.0] * 4, 1, "x"), (602, [nan, 1.0, 0.0, 0.0], 1, "x"), (603, [1.0, None, 0.0, 0.0], 1, "x"), (604, rows[0][1], None, "x"), (605, [float("inf"), 1.0, 0.0, 0.0], 1, "x"), (606, [], 1, "x"), (607, [1.0, 0.0], 1, "x"), (None, rows[0][1], labels[0], "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, kept string")
    links, parent = dict.fromkeys(range(608), 0), list(range(608))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in plain(raw.astype(float)):
        if labels[i] == labels[j]:
            links[i], links[j] = links[i] + 1, links[j] + 1
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    got = covertree.near_duplicates(table).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], find(r.vec_id), find(r.vec_id) == r.vec_id), r
    assert covertree.near_duplicates(table.limit(0)).count() == 0
