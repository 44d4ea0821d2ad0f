import numpy as np

from tarnwell.llm import neighbours as nb

SCHEMA = "id long, embedding array<float>, rep long, hash string"


def brute(rows, k=5):
    ids = np.array([i for i, _ in rows])
    u = nb._unit(np.array([v for _, v in rows], dtype=float))
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    return {int(i): [int(j) for j in ids[np.lexsort((ids, -s[n]))[:k]] if j != i][:k] for n, i in enumerate(ids)}


def clustered(n, rng):
    centres = rng.standard_normal((n // 12, 64))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, 64))).astype(np.float32)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0, "clash") for i, v in rows], SCHEMA)


def test_recall_over_several_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(i), v) for i, v in zip(rng.permutation(3000) * 3, clustered(3000, rng), strict=True)]
    monkeypatch.setattr(nb, "BLOCK", 600)
    got = {}
    for r in nb.nearest(table(spark, rows)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(rows)
    hits = sum(len(got[i] & set(w)) for i, w in want.items())
    assert hits / sum(map(len, want.values())) > 0.97 and all(len(g) == 5 for g in got.values())


def test_copies_ties_and_unusable(spark):
    rng = np.random.default_rng(6)
    v = clustered(40, rng)
    rows = [(i, v[i]) for i in range(40)] + [(100 + i, v[0]) for i in range(9)] + [(-7, v[0])]
    odd = [(900, None), (901, [1.0] * 63), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [float("inf")] + [1.0] * 63)]
    near = nb.nearest(table(spark, rows + odd)).collect()
    got = {}
    for r in sorted(near, key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == brute(sorted(rows))
    assert got[-7] == [0, 100, 101, 102, 103] and got[108][:2] == [-7, 0]


def test_few_and_no_rows(spark):
    assert nb.nearest(table(spark, [])).count() == 0
    v = np.eye(64, dtype=np.float32)
    pairs = nb.neighbour_pairs(nb.nearest(table(spark, [(1, v[0]), (2, v[0] * 1e-30), (3, v[1])]))).collect()
    assert sorted((r.id_a, r.id_b) for r in pairs) == [(1, 2), (1, 3), (2, 3)]
    assert nb.nearest(table(spark, [(1, v[0])])).count() == 0
