"""Whitening and near-dedup of embeddings against brute force: nulls, non-finite entries, other lengths, copies, ties, clashing names, empty tables."""

import math
from collections import Counter

import numpy as np
import pytest

from factloom.llm import embedding_join, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, kept string"


def _table():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        v = rng.normal(0, 0.15, 6)
        rows.append([i, v, i % 4])
    for i in range(150, 190):  # near copies, in one label and across labels
        base = rows[i % 7][1]
        rows.append([i, base + rng.normal(0, 0.02, 6), (i % 7) % 4 if i % 3 else 3])
    rows += [[200 + i, rows[5][1], 1] for i in range(12)] + [[230, 2 * rows[5][1], 1], [231, rows[5][1], None], [231, rows[9][1], 1], [231, rows[9][1], 1]]
    rows = [[i, [float(np.float32(c)) for c in v], lab] for i, v, lab in rows]
    rows += [[300, None, 1], [301, [math.nan] * 6, 1], [302, [None, 1.0, 0.0, 0.0, 0.0, 0.0], 1], [303, [math.inf] * 6, 1], [304, [0.0] * 6, 1], [305, [], 1], [306, [1.0, 2.0], 1], [307, [1.0, 2.0], 1], [None, rows[5][1], 1], [None, None, None]]
    return [(*r, "n", "c", "k") for r in rows]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(_table(), SCHEMA).repartition(5)


def _good(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def test_op11(vectors):
    rows = [(r[0], [math.floor(64 * c) + 1_000_000 for c in r[1]]) for r in _table() if _good(r[1]) and len(r[1]) == 6]
    x = np.array([v for _, v in rows], object)
    n, s = len(x), x.sum(0)
    z = ((n * x - s) / n).astype(float)
    cov = z.T @ z / n
    values, axes = (a[..., ::-1] for a in np.linalg.eigh(cov))
    got = whitening.whiten(vectors).collect()
    assert len(got) == 6 * n and {r["n"] for r in got} == {n} and {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    want = Counter((i, k, int(((n * x[a] - s) ** 2).sum())) for a, (i, _) in enumerate(rows) for k in range(1, 7))
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == want
    for k in range(6):
        mine = sorted(((repr(r["vec_id"]), r["deviation"], r["whitened"]) for r in got if r["component"] == k + 1), key=lambda r: r[:2])
        theirs = sorted(((repr(i), int(((n * x[a] - s) ** 2).sum()), float(z[a] @ axes[:, k] / math.sqrt(values[k]))) for a, (i, _) in enumerate(rows)), key=lambda r: r[:2])
        a, b = np.array([r[2] for r in mine]), np.array([r[2] for r in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-10
        assert {round(r["explained"] / (values[k] / values.sum()), 9) for r in got if r["component"] == k + 1} == {1.0}
    assert {r["component"] for r in whitening.whiten(vectors, components=2).collect()} == {1, 2}


def test_op11_degenerate(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>"))
    assert make([]).collect() == [] and make([("a", None), ("b", [])]).collect() == []
    one = make([("a", [1.0, 2.0])]).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    line = make([(str(i), [float(i), float(i)]) for i in range(9)]).collect()
    assert {r["whitened"] for r in line if r["component"] == 2} == {None} and all(r["whitened"] is not None for r in line if r["component"] == 1)
    far = make([("a", [1e300, 0.0]), ("b", [-1e300, 0.5]), ("c", [3.0, 0.0])]).collect()
    assert {(r["vec_id"], r["deviation"]) for r in far} == {("a", None), ("b", None), ("c", 384**2 + 32**2)} and len(far) == 6


def test_op11_merge():
    rng = np.random.default_rng(1)
    x = rng.integers(10**6, 10**6 + 50, (500, 5))
    whole, parts = whitening.of(x), None
    for a in range(0, 500, 37):
        parts = whitening.merged(parts, whitening.of(x[a : a + 37]))
    assert whole.n == parts.n and list(whole.sums) == list(parts.sums) and np.allclose(whole.scatter, parts.scatter, rtol=1e-14)


def _brute(rows, threshold=0.93):
    n = len(rows)
    can = [_good(v) and any(v) and lab is not None and i is not None for i, v, lab, *_ in rows]
    unit = [np.array(v) / math.sqrt(sum(c * c for c in v)) if ok else None for (_, v, *_), ok in zip(rows, can, strict=True)]
    up = list(range(n))

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    links = [0] * n
    for a in range(n):
        for b in range(a):
            if can[a] and can[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)), key=lambda i: (rows[i][0], i))
                up[y] = x
    tops = [rows[top(a)][0] for a in range(n)]
    return Counter((r[0], k, t, r[0] is not None and t == r[0]) for r, k, t in zip(rows, links, tops, strict=True))


@pytest.mark.parametrize("tile", [4096, 9])
def test_op12(vectors, tile):
    got = embedding_join.join(vectors, tile=tile).collect()
    assert Counter(map(tuple, got)) == _brute(_table())
    assert sum(r["n_links"] for r in got) > 300


def test_op12_degenerate(spark, vectors):
    assert embedding_join.join(vectors.limit(0)).collect() == []
    got = embedding_join.join(spark.createDataFrame([("b", [1.0, 0.0], "x"), ("a", [2.0, 0.0], "x"), ("c", [0.0, 1.0], "x")], "vec_id string, embedding array<double>, label string")).collect()
    assert sorted(map(tuple, got)) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_op12_bounds():
    """The bounds hold for every pair, and most pairs need no second look."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (300, 64))
    x[150:] = x[:150] + rng.normal(0, 0.4, (150, 64)) * rng.random((150, 1))
    x[0] *= 1e150
    made = embedding_join.quantised(x)
    yes, looked = embedding_join.linked(made, made, 0.93)
    assert (yes == (made[0] @ made[0].T >= 0.93)).all() and 0 < looked < 600
    wide = embedding_join.quantised(rng.normal(0, 1, (4, 3000)))
    assert (embedding_join.product(wide[1], wide[1]) == wide[1].astype(int) @ wide[1].astype(int).T).all()
