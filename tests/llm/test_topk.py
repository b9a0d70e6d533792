import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cotejo.llm import topk
from cotejo.llm.queries import TOPK_SQL, op6_topk


def brute(rows, k, every=5):
    """Every row is a candidate, but for those with the query's id; products that a long cannot hold are no scores."""
    good = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i]
            best = sorted(s for s in scores if -(1 << 63) <= -s[0] < 1 << 63)[:k]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.25, -0.5, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)] + [(2000, None), (2005, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2010, [float("nan")] * 6), (2015, [float("inf")] * 6), (None, [1.0] * 6), (2020, [9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("extra"))
    rows = [(i, v and list(v)) for i, v, _ in vectors.collect()]
    found = topk.top_k(vectors, F.col("vec_id") % 5 == 0)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()) == brute(rows, 5)


def test_few_and_none(spark):
    vectors = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    found = topk.top_k(vectors, F.col("vec_id") % 5 == 0).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id) for x in found) == [(0, 1, 5), (5, 1, 0)]
    assert topk.top_k(vectors.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def check(spark, rows):
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0)
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in found.collect()) == brute(rows, 5)


def test_rows_that_share_an_id_are_all_candidates(spark):
    check(spark, [(0, [1.0, 5.0]), (7, [5.0, 0.0]), (7, [-5.0, 0.0]), (7, [5.0, 0.0]), (5, [1.0, 1.0]), (5, [2.0, -1.0]), (9, [0.5, 0.0])])


def test_large_products_and_long_vectors(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randrange(1 << 20)) + r.random() for _ in range(3)]) for i in range(40)]
    check(spark, rows)
    check(spark, [*rows, (41, [9e6, 0.0, 0.0]), (50, [1e30, 0.0, 0.0]), (55, [3e9, 0.0, 1.0]), (60, [0.0, 1.0, 0.0]), (65, [1e-3, -1e300, 2.0]), (1, [1e12, 0.5, 0.0])])
    check(spark, [(0, [1.0, 0.0]), (9, [9e6, 0.0]), (2, [1.0, 1.0])])
    check(spark, [(i, [1e20 * i, 1.0]) for i in range(12)])


@pytest.mark.parametrize("kind", ["random", "flat", "equal", "one"])
def test_bounds_hold(kind):
    """No two vectors are nearer than their distances to the pivots prove."""
    r = np.random.default_rng(4)
    x = {"random": r.integers(-300, 300, (200, 12)), "flat": r.integers(-9, 9, (200, 3)) @ r.integers(-9, 9, (3, 12)), "equal": np.ones((20, 5), int), "one": np.ones((1, 5), int)}[kind].astype(float)
    pivots = topk.Pivots(topk.farthest(x, 8))
    along, off = pivots.placed(topk.distances(x, pivots.points))
    proved = np.sqrt(((along[:, None] - along) ** 2).sum(2) + (off[:, None] - off) ** 2)
    real = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    d = topk.distances(x, pivots.points)
    assert (proved <= real + 1e-3).all()
    assert (proved >= np.abs(d[:, None] - d).max(2) - 1e-3).all()


def test_far_blocks_are_left_out():
    """Of two far clusters only the one near the query is evaluated."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.integers(0, 20, (500, 8)) + 1000, r.integers(0, 20, (500, 8)) - 1000])
    pivots = topk.Pivots(topk.farthest(x.astype(float), 4))
    d = topk.distances(x.astype(float), pivots.points)
    best = topk.Best(1, 5, np.full(1, np.iinfo(np.int64).min))
    taken = [topk.search(best, pivots, np.array([0]), x[:1], d[:1], np.arange(a, a + 500), x[a : a + 500], d[a : a + 500]) for a in (0, 500)]
    scores = x @ x[0]
    wanted = sorted((-int(s), i) for i, s in enumerate(scores) if i)[:5]
    assert list(zip((-best.scores[0]).tolist(), best.ids[0].tolist())) == wanted
    assert taken[0] <= 500 and taken[1] == 0


def test_query_equals_sql(same):
    same(op6_topk, TOPK_SQL)
