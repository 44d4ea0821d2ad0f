import itertools
import math

import numpy as np
import pytest

from tarnwell.operators import search


def corpus(spark, rows):
    return spark.createDataFrame(rows, "id long, embedding array<float>")


def test_dense_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [0.0] * 8), (103, [float("nan")] * 8), (104, [float("inf")] + [0.0] * 7)]
    c = corpus(spark, rows)
    got = search.dense_topk(c.where("id % 10 = 0").withColumnRenamed("id", "qid"), c, 3, 8).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = u @ u[q]
        want = [i for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q][:3]
        assert [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == want
    assert {r.qid for r in got} == set(range(0, 60, 10))


def test_dense_topk_without_rows(spark):
    empty = corpus(spark, [])
    assert search.dense_topk(empty.withColumnRenamed("id", "qid"), empty, 3, 8).count() == 0
    some = corpus(spark, [(1, [1.0, 0.0])])
    assert search.dense_topk(some.withColumnRenamed("id", "qid"), some, 3, 2).count() == 0


def test_bm25_formula_and_repeats(spark):
    docs = [(1, "aspirin helps aspirin headaches"), (2, "nothing here"), (3, None), (4, "")]
    d = spark.createDataFrame(docs, "id long, text string")
    q = spark.createDataFrame([(7, "Aspirin, aspirin!"), (8, None)], "qid long, text string")
    got = search.bm25_scores(q, d).collect()
    avgdl = (4 + 2 + 0 + 0) / 4
    want = 2 * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 4 / avgdl))
    assert [(r.qid, r.id) for r in got] == [(7, 1)] and math.isclose(got[0].score, want)


def test_min_max_of_equal_scores_is_one(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 1, 1.0), (2, 2, 3.0)], "qid int, id int, s double")
    assert sorted((r.qid, r.id, r.n) for r in search.min_max(df, "qid", "s", "n").collect()) == [(1, 1, 1.0), (1, 2, 1.0), (2, 1, 0.0), (2, 2, 1.0)]


def test_mmr_matches_restatement(spark):
    vectors = {0: [0.9, 0.1], 1: [0.88, 0.12], 2: [0.1, 0.9], 3: None, 4: [0.0, 0.0]}
    query = [0.7, 0.7]
    rows = [(1, i, i + 1, "a", query, v) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "qid long, id long, rank int, section string, query array<double>, embedding array<double>")
    got = [r.id for r in search.mmr(df, 3).orderBy("place").collect()]

    def cos(a, b):
        n = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

    chosen = []
    while len(chosen) < 3:
        def value(i):
            v = vectors[i] or query
            near = [cos(v, vectors[j]) for j in chosen if vectors[j]]
            return 0.7 * cos(v, query) - 0.3 * max(near, default=0.0) if chosen else cos(v, query)
        chosen.append(max((i for i in vectors if i not in chosen), key=value))
    assert got == chosen


def test_mmr_falls_back_to_quota(spark):
    rows = [(1, i, i + 1, "ab"[i == 3], [1.0, 0.0], None) for i in range(4)]
    df = spark.createDataFrame(rows, "qid long, id long, rank int, section string, query array<double>, embedding array<double>")
    assert [r.id for r in search.mmr(df, 3).orderBy("place").collect()] == [0, 1, 3]


@pytest.mark.parametrize("labels,want", [("aabbb", "b"), ("aabbc", "a"), ("abcde", "vector")])
def test_knn_vote(spark, labels, want):
    rows = [(1, 1.0 - i / 10, x) for i, x in enumerate(labels)]
    assert search.knn_vote(spark.createDataFrame(rows, "qid long, sim double, label string")).collect()[0].label == want


def test_section_quota_and_step_back(spark):
    ranked = spark.createDataFrame([(1, i, s, i) for i, s in enumerate(["x", "x", "x", None, None, None, "y"], 1)], "qid long, id long, section string, rank int")
    assert [r.id for r in search.section_quota(ranked, 4).orderBy("place").collect()] == [1, 2, 4, 5]
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "qid long, id long, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "qid long, id long, rank int")
    assert [r.id for r in search.step_back_merge(a, b).orderBy("rank").collect()] == [5, 6, 7]
    assert list(itertools.islice((r.rank for r in search.step_back_merge(a, b).orderBy("rank").collect()), 3)) == [1, 2, 3]


def test_equal_vectors_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(2)
    same = rng.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, same) for i in rng.permutation(50).tolist()] + [(100 + i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(100)]
    c = corpus(spark, rows).coalesce(1)
    got = search.dense_topk(c.where("id in (3, 49, 120)").withColumnRenamed("id", "qid"), c, 5, 8).collect()
    ranked = {q: [r.id for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] for q in (3, 49, 120)}
    assert ranked[3] == [0, 1, 2, 4, 5] and ranked[49] == [0, 1, 2, 3, 4]
    x = np.array([v for _, v in rows], dtype=float)
    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[-80] / np.linalg.norm(x[-80]))
    assert ranked[120] == [i for _, i in sorted((-round(v, 9), i) for v, (i, _) in zip(s, rows, strict=True) if i != 120)][:5]
