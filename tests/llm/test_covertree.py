"""Near-duplicate vectors against all pairs."""

import numpy as np

from marlstone.llm import covertree
from marlstone.llm.covertree import RADII, CoverTree, near_duplicates

SCHEMA = "vec_id long, embedding array<float>, label int, component string"


def brute(rows, cosine=0.9, width=8):
    good, units = [], []
    for k, v in rows:
        if k is not None and v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            good.append(k)
            units.append(x / np.sqrt(x @ x))
    m = np.array(units) @ np.array(units).T >= cosine
    least = list(range(len(good)))
    for i in range(len(good)):
        for j in range(i):
            if m[i, j]:
                a, b = least[i], least[j]
                least = [min(a, b) if x in (a, b) else x for x in least]
    order = {k: min(good[j] for j in range(len(good)) if least[j] == least[i]) for i, k in enumerate(good)}
    return {k: (int(m[i].sum()) - 1, order[k]) for i, k in enumerate(good)} | {k: (0, k) for k, _ in rows if k not in order}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [rng.normal(size=8) for _ in range(300)]
    rows += [centres[k % 12] + rng.normal(size=8) * (0.05 + 0.05 * (k % 6)) for k in range(500)]
    rows += [rows[5]] * 40 + [3 * rows[7]] * 2
    data = [(k, [float(x) for x in v]) for k, v in enumerate(np.array(rows).astype(np.float32))]
    n = len(data)
    data += [(n, None), (n + 1, [0.0] * 8), (n + 2, [float("nan")] + [1.0] * 7), (n + 3, [None] + [1.0] * 7), (n + 4, [1.0]), (n + 5, []), (n + 6, [float("inf")] + [1.0] * 7)]
    rng.shuffle(data)
    data = [(int(k), v) for k, v in data]
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in data], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(data)


def test_many_blocks_widths_and_repeated_rows(spark, monkeypatch):
    """Small blocks: pairs of blocks, split cells, gatherings; vectors of two lengths; rows that repeat and rows without an id."""
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "MOST_PIVOTS", 6)
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(9, 8))
    wide = [centres[k % 9] + rng.normal(size=8) * (0.02 + 0.06 * (k % 5)) for k in range(500)] + [rng.normal(size=8) for _ in range(200)]
    narrow = [rng.normal(size=3) for _ in range(60)]
    rows = [[float(x) for x in np.float32(v)] for v in wide + narrow]
    data = list(enumerate(rows))
    want = brute(data, width=8) | {k: v for k, v in brute(data, width=3).items() if k >= 700}
    assert sum(n for n, _ in brute(data, width=3).values()) > 20
    df = spark.createDataFrame([(k, v, 0, "x") for k, v in data] + [(None, rows[0], 0, "x")], SCHEMA)
    got = [r for r in near_duplicates(df).collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None) and [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]
    twice = near_duplicates(df.filter("vec_id < 3").union(df.filter("vec_id = 1"))).collect()
    assert len(twice) == 4 and sorted(r.n_links for r in twice if r.vec_id == 1) == [r.n_links for r in twice if r.vec_id == 1] and min(r.n_links for r in twice if r.vec_id == 1) >= 1


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tree_is_nested():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(200, 6)), np.repeat(rng.normal(size=(1, 6)), 50, 0) + 0.02 * rng.normal(size=(50, 6))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = CoverTree.build(x)
    assert sorted(tree.order) == list(range(250)) and len(tree.starts) == len(RADII) + 1
    for level, starts in enumerate(tree.starts):
        assert set(starts) <= set(tree.starts[-1])
        for lo, hi, radius in zip(starts, starts[1:], tree.radius[level], strict=False):
            d = np.linalg.norm(tree.points[lo:hi] - tree.points[lo], axis=1).max()
            assert abs(d - radius) < 1e-6 and (level == 0 or d <= RADII[level - 1] + 1e-4)
