import math
import random

from wordloom.llm import topk


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def rows(n, dims, seed):
    r = random.Random(seed)
    return [(i, [r.choice([0.0, r.gauss(0, 1), 0.5]) for _ in range(dims)]) for i in range(n)]


def check(spark, data):
    d = spark.createDataFrame([(i, v, 3) for i, v in data], "vec_id long, embedding array<double>, rank int").repartition(5)
    assert sorted(map(tuple, topk.topk_digest(d).collect())) == brute(data)


def test_exact_with_odd_vectors(spark):
    odd = [(100, None), (101, []), (200, [None] * 8), (300, [float("nan")] * 8), (301, [float("inf")] * 8), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (None, [0.1] * 8), (500, [0.0] * 8)]
    check(spark, [x for x in rows(700, 8, 1) if x[0] not in (100, 101, 200, 300, 301, 400, 401, 500)] + odd)


def test_lists_are_read_in_steps(spark, monkeypatch):
    monkeypatch.setattr(topk, "RESOLVE_SHARE", 64)
    monkeypatch.setattr(topk, "BLOCK", 512)
    check(spark, rows(2500, 12, 2) + [(5000 + i, [0.25] * 12) for i in range(40)])


def test_few_candidates_and_none(spark):
    check(spark, rows(4, 6, 3))
    check(spark, rows(1, 6, 3))
    assert topk.topk_digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_two_query_rows_of_one_id_and_different_lengths(spark):
    data = [(i, [float(i % 7), 1.0, i / 13]) for i in range(1, 13)] + [(i, [float(i % 5), i / 3]) for i in range(21, 33)] + [(100, [1.0, 2.0, 3.0]), (100, [2.0, 1.0])]
    check(spark, data)
    assert topk.topk_digest(spark.createDataFrame(data, "vec_id long, embedding array<double>")).count() == 20
