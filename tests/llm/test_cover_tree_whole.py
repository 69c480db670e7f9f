"""Cover trees over odd vectors, groups of copies and many blocks, against all pairs."""

import numpy as np
import pytest

from sparkloom.llm import cover_tree


def _brute(x, cosine=0.95):
    x = np.asarray(x, float)
    x = x / np.abs(x).max(1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= cosine) & ~np.eye(len(u), dtype=bool)
    root = np.arange(len(u))
    while True:
        new = np.minimum(root, np.where(near, root[None], len(u)).min(1))
        if (new == root).all():
            return near.sum(1).tolist(), root.tolist()
        root = new


def _run(spark, x, kind="double", **more):
    df = spark.createDataFrame([(i, [float(v) for v in a], "x", 1, 2) for i, a in enumerate(x)], f"vec_id bigint, embedding array<{kind}>, point string, vector int, block int").repartition(3)
    got = {r.vec_id: r for r in cover_tree.near_vectors(df, **more).collect()}
    return [got[i].n_links for i in range(len(x))], [got[i].component_id for i in range(len(x))]


def test_doubles_of_any_range(spark):
    x = [[1e200, 1e200], [1e200, 1e200], [3e-310, 3e-310], [1.0, 1.0], [2.5, 2.5], [-1e300, 1e-300], [-1.0, 0.0], [5e-324, 0.0], [1e308, 1.0]]
    assert _run(spark, x) == _brute([[1, 1]] * 5 + [[-1, 0]] * 2 + [[1, 0]] * 2)


@pytest.mark.parametrize("shape", ["random", "clusters", "copies"])
def test_many_blocks(spark, shape, monkeypatch):
    for name, value in {"BLOCK": 50, "CELL": 12, "LEAF": 6, "SLICE_BYTES": 4096}.items():
        monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 16))
    if shape == "clusters":
        x = x[r.integers(0, 20, 600)] + r.normal(size=(600, 16)) * 0.2
    if shape == "copies":  # one group of near copies that fills many blocks, and one of equal vectors
        x[:300] = x[0] + r.normal(size=(300, 16)) * 0.005
        x[300:400] = x[300]
    x = x.astype(np.float32)
    assert _run(spark, x, "float") == _brute(x)


def test_whole_pairs_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 20)
    monkeypatch.setattr(cover_tree, "CELL", 400)
    compared = []
    old = cover_tree._compared
    monkeypatch.setattr(cover_tree, "_compared", lambda pairs, *a: (compared.append(pairs.count()), old(pairs, *a))[1])
    x = np.ones((300, 8)) + np.random.default_rng(1).normal(size=(300, 8)) * 0.01
    assert _run(spark, x) == _brute(x) and compared == [0]


def test_null_and_repeated_ids(spark):
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, 0.0]
    df = spark.createDataFrame([(7, a), (7, a), (None, a), (None, b), (9, a), (None, None), (3, [float("nan")] * 3)], "vec_id bigint, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in cover_tree.near_vectors(df).collect()), key=str)
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, None), (None, 0, None, None), (9, 3, 7, False), (None, 0, None, None), (3, 0, 3, True)], key=str)


def test_single_precision_never_decides_near_the_threshold():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = r.normal(size=(400, 64))
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    angle = np.arccos(0.95) + r.choice([-1e-7, -1e-9, 0, 1e-9, 1e-7], 400)
    y = np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * side
    got = cover_tree.at_least(x, y, 0.95, x.astype(np.float32), y.astype(np.float32))
    exact = np.einsum("id,jd->ij", x, y) >= 0.95
    differ = got != exact
    assert not (differ & (np.abs(x @ y.T - 0.95) > 1e-14)).any()
