import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotejo.llm import near_dedup, shingles
from cotejo.llm.graph import components
from cotejo.llm.queries import NEAR_SQL, op5_near_dedup


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent):
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in sets:
        for j in sets:
            a, b = sets[i], sets[j]
            if i < j and a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                top[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed, n):
    """Texts with many copies at all degrees of likeness, chains of edits among them."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(4):
        base = [word() for _ in range(r.choice([12, 60, 120]))]
        last = base
        for _ in range(n):
            copy = list(last if r.random() < 0.4 else base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(copy) + 1)
                copy[at : at + r.choice([0, 1, 4])] = [word() for _ in range(r.choice([0, 1]))]
            out.append(" ".join(copy))
            last = copy
    return out


def test_shingle_sets_equal_plain_ones():
    texts = [*families(1, 5), None, "", " \t", "One  two", "a b c d e", "A B C D E", "é b c d e f", " x   y z w v u"]
    sets = shingles.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(plain_set(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(np.intersect1d(sets[i], sets[j])) == len(plain_set(a) & plain_set(b))


def test_words_are_hashed_alike_in_pieces():
    texts = pa.array([*families(1, 5), None, "", " \t", "x" * 50, "One  two", "  a ", "é b c" * 30])
    whole = shingles.word_hashes(texts)
    for size in (1, 7, 64):
        pieces = shingles.word_hashes(texts, size)
        assert (pieces[0] == whole[0]).all() and (pieces[1] == whole[1]).all()


def test_long_texts_and_a_large_cluster(documents):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    long = [word() for _ in range(300_000)]
    other = [*long[:100_000], "changed", *long[100_000:]]
    base = [word() for _ in range(200)]
    rows = [(1, " ".join(long)), (2, " ".join(other)), *((10 + i, " ".join([*base[: i % 190], word(), *base[i % 190 + 1 :]])) for i in range(400))]
    found = {x.doc_id: x for x in near_dedup.classes(documents(rows), 85).collect()}
    assert found[1].component_id == found[2].component_id == 1 and found[1].n_shingles == len(plain_set(rows[0][1]))
    assert {found[10 + i].component_id for i in range(400)} == {10}


@pytest.mark.parametrize("n", [1, 3, 50, 2000])
def test_sketch_fills_all_bins_and_tells_similarity(n):
    items = shingles.mixed(np.arange(n).astype(np.uint64))
    out = shingles.sketch(items, 512)
    assert (out != ~np.uint64(0)).all()
    other = shingles.sketch(shingles.mixed(np.arange(n // 5, n).astype(np.uint64)), 512)
    assert abs((out == other).mean() - (n - n // 5) / n) < 0.08


@pytest.mark.parametrize("percent, seed", [(85, 1), (80, 2), (85, 3)])
def test_classes_equal_all_pairs(documents, percent, seed):
    texts = families(seed, 14)
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "One two"), (903, "one  TWO"), (904, "   "), (3, texts[3]), (None, texts[0])]
    wanted = brute(rows, percent)
    found = near_dedup.classes(documents(rows), percent).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == wanted
    assert [r.component_id for r in found if r.doc_id is None] == [None]


def test_rare_pairs_find_all_similar_pairs(spark, documents):
    """Every set alone in its component: the prefix join must propose all pairs that are similar enough."""
    texts = sorted(set(families(5, 16)))
    sets = near_dedup.full_sets(documents(list(enumerate(texts))), "text")
    nodes = sets.select("id", F.col("id").alias("component"))
    found = {tuple(sorted((r.a, r.b))) for r in near_dedup.rare_pairs(nodes, sets, 85)[0].collect()}
    plain = [plain_set(t) for t in texts]
    wanted = {(i, j) for i in range(len(plain)) for j in range(i + 1, len(plain)) if 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])}
    assert wanted <= found


def test_deduplicated_keeps_one_of_each_group(documents):
    rows = [(5, "a b c d e f g h"), (2, "a b c d e f g h"), (7, None), (8, ""), (None, "a b c d e f g h"), (9, "x y")]
    kept = near_dedup.deduplicated(documents(rows))
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 7, 8, 9]
    assert near_dedup.classes(documents(rows).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (203, 202)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200, 202: 202, 203: 202}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bands_follow_from_the_threshold():
    for percent in (80, 85, 95):
        assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.n_bands(percent) <= near_dedup.MISS * (1 + 1e-9)
        assert math.isfinite(near_dedup.n_bands(percent))


def test_query_equals_sql(same):
    same(op5_near_dedup, NEAR_SQL)
