"""Vector codes and centroids against plain Lloyd's steps in Python integers."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as t

from cotejo.llm import centroids, integers, vector_codes
from cotejo.llm.common import saved
from cotejo.llm.queries import clusters_sql, codes_sql, op12_vector_codes, op13_centroids

SCHEMA = t.StructType(
    [
        t.StructField("vec_id", t.LongType()), t.StructField("embedding", t.ArrayType(t.DoubleType())), t.StructField("label", t.IntegerType()),
        t.StructField("code", t.StringType()), t.StructField("_key", t.IntegerType()), t.StructField("x", t.IntegerType()),
    ]
)


def vectors(spark, rows):
    """A table of (vec_id, embedding, label) with columns that are named like the operators' own."""
    return spark.createDataFrame([(*r, "mine", 1, 2) for r in rows], SCHEMA)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(Fraction(x) * scale) for x in v]


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(x, entries):
    return min(range(len(entries)), key=lambda k: (apart(x, entries[k]), k))


def lloyd(points, entries, rounds):
    for _ in range(rounds):
        own = [nearest(x, entries) for x in points]
        groups = [[x for x, k in zip(points, own) if k == j] for j in range(len(entries))]
        entries = [[sum(c) // len(g) for c in zip(*g)] if g else e for g, e in zip(groups, entries)]
    return entries, [nearest(x, entries) for x in points]


def by_key(r):
    return (r[0] is None, r[0] or 0, r[1])


def plain_codes(rows):
    rows = sorted([r for r in rows if usable(r[1])], key=by_key)
    if not rows:
        return []
    width = -(-max(8, max(len(r[1]) for r in rows)) // 8) * 8
    x = [whole(r[1], 4096) + [0] * (width - len(r[1])) for r in rows]
    size = width // 8
    books, codes = [], []
    for p in range(8):
        parts = [v[p * size : (p + 1) * size] for v in x]
        entries, own = lloyd(parts, parts[:16], 6)
        books.append(entries)
        codes.append(own)
    errors = [sum(apart(v[p * size : (p + 1) * size], books[p][codes[p][i]]) for p in range(8)) for i, v in enumerate(x)]
    sums = {}
    for r, e in zip(rows, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    fit = lambda n: n if n < 1 << 63 else None
    of = {k: None if any(r[2] == k and e >= 1 << 63 for r, e in zip(rows, errors)) else fit(n) for k, n in sums.items()}
    return sorted(((r[0], "".join(f"{codes[p][i]:02x}" for p in range(8)), fit(errors[i]), of[r[2]], digest) for i, r in enumerate(rows)), key=repr)


def spot(key):
    return (1, "") if key is None else (0, hashlib.sha256(f"3:{key}".encode()).hexdigest())


def plain_clusters(rows):
    rows = sorted([r for r in rows if usable(r[1]) and len(r[1]) == 64], key=lambda r: (spot(r[0]), r[1]))
    x = [whole(r[1], 1024) for r in rows]
    entries, own = lloyd(x, x[:8], 10)
    d = [apart(v, entries[k]) for v, k in zip(x, own)]
    fit = lambda n: n if n < 1 << 63 else None
    total = lambda some: None if any(n >= 1 << 63 for n in some) else fit(sum(some))
    each = [total([n for n, k in zip(d, own) if k == j]) for j in range(len(entries))]
    hashes = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in entries]
    return sorted(((r[0], own[i], fit(d[i]), each[own[i]], total(d), hashes[own[i]]) for i, r in enumerate(rows)), key=repr)


def table(seed, n=300, dims=64, grid=None, groups=5):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    point = (lambda: [r.choice(grid) for _ in range(dims)]) if grid else (lambda: [c + r.gauss(0, 0.1) for c in r.choice(middle)])
    return [(i, point(), r.choice([1, 2, None])) for i in range(n)]


ODD = [
    (900, None, 1), (901, [None] * 64, 1), (902, [float("nan")] * 64, 1), (903, [float("inf")] + [0.0] * 63, 1), (904, [], 2), (905, [1.0, -1.0], 2),
    (7, [0.5] * 64, 1), (7, [-0.5] * 64, 2), (7, [-0.5] * 64, 2), (None, [0.25] * 64, None), (None, [0.125] * 64, 3),
]
CASES = {
    "groups": table(1), "ties": table(2, grid=[0.0, 1 / 1024, -1 / 4096]), "odd": [*table(3, n=60), *ODD], "copies": [(i, [0.5] * 64, 1) for i in range(80)],
    "few": table(4, n=5), "one": table(5, n=1), "none": [], "only unusable": ODD[:4], "huge": [*table(6, n=40), (500, [1e30] * 64, 1), (501, [-1e300] * 64, 1), (502, [3e7] * 64, 9)],
    "large": [(i, [x * 2e5 for x in v], k) for i, v, k in table(7, n=60)],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_equal_plain_steps(spark, name):
    out = vector_codes.compressed(vectors(spark, CASES[name]))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_codes(CASES[name])


@pytest.mark.parametrize("name", CASES)
def test_clusters_equal_plain_steps(spark, name):
    out = centroids.clustered(vectors(spark, CASES[name]))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == plain_clusters(CASES[name])


def test_many_labels_are_joined(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW", 1)
    out = vector_codes.compressed(vectors(spark, CASES["odd"]))
    assert sorted(map(tuple, out.collect()), key=repr) == plain_codes(CASES["odd"])


def test_bounds_spare_most_comparisons(spark):
    given = vectors(spark, table(8, n=2000, groups=16))
    state = saved(vector_codes.blocks(given, ["vec_id"], "embedding", 64))
    _, _, scanned = vector_codes.fitted(state, vector_codes.first_books(given, "vec_id", "embedding", 64), 64)
    assert scanned[-1] < scanned[0] / 2


def test_bounds_always_hold():
    r = np.random.default_rng(1)
    x = r.integers(-50, 50, (400, 8))
    book = vector_codes.Codebook(x[:16])
    codes, upper, lower = np.zeros(400, np.uint8), np.full(400, np.inf, np.float32), np.zeros(400, np.float32)
    for _ in range(8):
        vector_codes.reassigned(x, book, codes, upper, lower)
        d = integers.squared(x, book.entries)
        assert (codes == d.argmin(1)).all()
        own = d[np.arange(400), codes]
        d[np.arange(400), codes] = 1 << 60
        assert (upper.astype(float) ** 2 >= own).all() and (lower.astype(float) ** 2 <= d.min(1)).all()
        book = vector_codes.moved(book, vector_codes.summed(x, codes, 16))


def test_balls_go_whole_where_groups_lie_apart(spark):
    rows = table(9, n=3000, groups=8)
    made = saved(centroids.trees(vectors(spark, rows).select("vec_id", "embedding"), "vec_id", "embedding"))
    _, whole_balls = centroids.fitted(made, centroids.first_centroids(vectors(spark, rows), "vec_id", "embedding"))
    assert whole_balls[-1] > 1500


def test_trees_hold_their_rows():
    x = np.random.default_rng(2).integers(-900, 900, (777, 64))
    order, centres, radii, sums = centroids.grown(x)
    assert sorted(order) == list(range(777))
    nodes = [n for level in centroids.cuts(777) for n in level]
    assert len(nodes) == len(centres)
    for (a, b), centre, radius, total in zip(nodes, centres, radii, sums):
        assert (np.sqrt(((x[order[a:b]] - centre) ** 2).sum(1)) <= radius).all() and (x[order[a:b]].sum(0) == total).all()


def test_digits_of_numbers():
    for v in (0, 1, -1, 2**31, -(2**31) - 1, 10**40, -(10**40)):
        found = list(integers.digits(v))
        assert sum(d << (32 * p) for p, d in found) == v and all(abs(d) < 1 << 32 for _, d in found)


def test_queries_equal_sql(same):
    assert same(op12_vector_codes, codes_sql()) == same(op13_centroids, clusters_sql()) == 500
