"""The trained operators: held-out accuracy, and rows that hold nothing to learn from or score."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cotejo.llm import features, language_id, quality
from cotejo.llm.queries import op1_quality, op9_language


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_quality_of_held_out_documents(spark, small):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = op1_quality(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    for r in rows:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in known) >= 0.85 * len(known)
    assert all(p == 1 for p, y in known if y == 1)


def test_language_of_held_out_documents(spark, small):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op9_language(spark, small).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in out) >= 0.95 * len(out)


def prose(r, language):
    words = {"x": ["the", "and", "house", "with"], "y": ["der", "und", "haus", "mit"]}[language]
    return " ".join(r.choice(words) for _ in range(20))


def test_language_edges(spark):
    r = random.Random(1)
    rows = [(i, prose(r, "xy"[i % 2]), "xy"[i % 2]) for i in range(40)] + [(100, "the and with", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fitted(docs)
    assert model["names"] == ["x", "y"] and (model["weights"] == 0).mean() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !! 34"), (4, "the house and"), (5, "DER MIT" * 3000), (4, "the house and")], "doc_id long, text string")
    found = [(x.doc_id, x.lang_pred, x.score) for x in language_id.predicted(odd, model).collect()]
    assert [(i, p) for i, p, _ in sorted(found)] == [(1, "und"), (2, "und"), (3, "und"), (4, "x"), (4, "x"), (5, "y")]
    assert all(s == 0 for _, p, s in found if p == "und")
    nothing = language_id.fitted(docs.limit(0))
    assert {x.lang_pred for x in language_id.predicted(odd, nothing).collect()} == {"und"}
    assert language_id.predicted(odd.limit(0), model).count() == 0


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "One good text of words."), (2, "BAD!! BAD!! BAD!!"), (3, None), (4, ""), (None, "x"), (1, "One good text of words.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (9, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fitted(docs, labels, "doc_id", "quality", "text")
    rows = quality.scored(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    score = {r.doc_id: r.score for r in rows}
    assert score[1] > 0.9 and score[2] < 0.1 and score[3] == score[4] == pytest.approx(2 / 3)
    nothing = quality.fitted(docs, labels.limit(0), "doc_id", "quality", "text")
    assert {r.score for r in quality.scored(docs, nothing).collect()} == {0.5}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_votes_equal_all_cosines(spark):
    """Document frequencies, vectors, neighbours and votes, one document after the other."""
    r = random.Random(7)
    words = ["good", "Bad!!", "x1", "Some-word", "or,", "THE", "end.", "12"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 12))) for _ in range(60)] + ["", "good good", "good good"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("good" in t)) for i, t in enumerate(texts) if i % 2 and t], "doc_id long, quality int")
    model = quality.fitted(docs, labels, "doc_id", "quality", "text")
    counts = [features.style(pa.array([t]))[0] for t in texts]
    df = np.sum([c > 0 for c in counts], axis=0)
    vector = lambda c: np.log1p(c) * (np.log((1 + len(texts)) / (1 + df)) + 1)
    unit = lambda v: v / np.linalg.norm(v) if v.any() else v
    latent = lambda c: unit(unit(vector(c)) @ model["directions"])
    known = [(i, latent(counts[i]), int("good" in t)) for i, t in enumerate(texts) if i % 2 and t]
    found = {x.doc_id: x.score for x in quality.scored(docs, model).collect()}
    for i, c in enumerate(counts):
        if not c.any():
            assert found[i] == sum(y for *_, y in known) / len(known)
            continue
        near = sorted(((-round(float(latent(c) @ v), 9), j, y) for j, v, y in known))[: quality.NEIGHBOURS]
        weights = [max(-s, 1e-3) ** quality.POWER for s, *_ in near]
        # Rows of equal text and so of equal similarity may swap where rounding differs; all of them have one label.
        assert found[i] == pytest.approx(sum(w * y for w, (*_, y) in zip(weights, near)) / sum(weights), abs=1e-6)


def test_ties_go_to_the_first():
    alike = np.array([[1.0, 3.0, 2.0, 2.0, 2.0], [0.0, 0.0, 0.0, 0.0, 0.0]])
    assert quality.nearest(alike, 3).tolist() == [[1, 2, 3], [0, 1, 2]]


def test_training_equals_steps_one_by_one():
    """Follow-the-regularised-leader on a small set, a coordinate at a time."""
    r = np.random.default_rng(5)
    x, y, n = (r.random((12, 4)) * (r.random((12, 4)) < 0.6)), r.integers(0, 3, 12), 3
    rows = np.hstack([x, np.ones((12, 1))])
    z, g2 = [[0.0] * n for _ in range(5)], [[0.0] * n for _ in range(5)]

    def weight(f, c):
        l1 = language_id.L1 if f < 4 else 0.0
        if abs(z[f][c]) <= l1:
            return 0.0
        sign = 1 if z[f][c] > 0 else -1
        return -(z[f][c] - sign * l1) / ((language_id.BETA + g2[f][c] ** 0.5) / language_id.ALPHA + language_id.L2)

    order = np.random.default_rng(1)
    for _ in range(language_id.PASSES):
        for i in order.permutation(12):
            w = {(f, c): weight(f, c) for f in range(5) for c in range(n) if rows[i, f]}
            e = np.exp([sum(rows[i, f] * w[f, c] for f in range(5) if rows[i, f]) for c in range(n)])
            p = e / e.sum()
            for f in range(5):
                for c in range(n):
                    if rows[i, f]:
                        g = rows[i, f] * (p[c] - (y[i] == c))
                        z[f][c] += g - ((g2[f][c] + g * g) ** 0.5 - g2[f][c] ** 0.5) / language_id.ALPHA * w[f, c]
                        g2[f][c] += g * g
    sparse = [(np.flatnonzero(row), row[row != 0]) for row in x]
    assert np.allclose(language_id.trained(sparse, y, n, 4), [[weight(f, c) for c in range(n)] for f in range(5)])


def test_predictions_equal_plain_products(spark):
    r = random.Random(3)
    rows = [(i, prose(r, "xy"[i % 2]), "xy"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fitted(docs)
    for x in language_id.predicted(docs, model).collect():
        counts = features.grams([x.text])[0]
        v = np.log1p(counts) * model["idf"]
        logits = (v / np.linalg.norm(v)) @ model["weights"][:-1] + model["weights"][-1]
        p = np.exp(logits / model["temperature"])
        assert x.lang_pred == model["names"][int(p.argmax())] and x.score == pytest.approx(p.max() / p.sum())


@pytest.mark.parametrize("seed", range(4))
def test_pieces_of_a_text_count_as_the_whole(seed):
    r = random.Random(seed)
    words = ["Uno,", "dos", "dos", "ΟΔΟΣ", "İl", "é!!", "12-x", "...", "A", "ﬁn", "😀", "a" * 90]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\u00a0", " - ", ". "]) for _ in range(r.choice([3, 150, 1500]))) for _ in range(6)] + ["", "x" * 3000, " " * 3000, None]
    given = pa.array(texts, pa.string())
    counts = {
        "style": lambda size: features.by_pieces(features.short_style, features.long_style, given, features.STYLE, size),
        "grams": lambda size: features.by_pieces(lambda t: features.grams(t.to_pylist()), features.long_grams, given, features.GRAMS, size),
    }
    for count in counts.values():
        whole = count(1 << 20)
        assert all((count(size) == whole).all() for size in (7, 64, 1000))


def test_a_text_of_megabytes_counts_as_the_whole():
    r = random.Random(4)
    text = " ".join(r.choice(["Uno,", "dos", "été", "12", "fin."]) for _ in range(800_000))
    assert len(text) > 3 << 20
    assert (features.style(pa.array([text]))[0] == features.short_style(pa.array([text]))[0]).all()
    assert (language_id.gram_counts(pa.array([text]))[0] == features.grams([text])[0]).all()


def test_repeated_keys_are_learned_from_once(spark, monkeypatch):
    """Of a key that stands in thousands of rows one comes to the driver."""
    rows = [(1, f"text {i} of many", "x") for i in range(3000)] + [(2, "und ein Haus", "y"), (3, "das haus mit", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    collected = []
    real = features.counted_rows
    monkeypatch.setattr(features, "counted_rows", lambda *a: collected.append(real(*a)) or collected[-1])
    quality.fitted(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), "doc_id", "quality", "text")
    language_id.fitted(docs)
    assert [len(x) for x in collected] == [2, 3]


def test_features_do_not_depend_on_slices():
    r = random.Random(3)
    texts = ["".join(r.choice("aB1!é .\n|") for _ in range(r.randint(0, 60))) for _ in range(60)] + [None, "", "  ", " x", "word word word word"]
    for count in (lambda x: features.style(pa.array(x, pa.string())), features.grams):
        whole = count(texts)
        assert (whole == np.concatenate([count([t]) for t in texts])).all()


def test_repetition_is_counted():
    row = features.style(pa.array(["a a a a b"]))[0]
    assert row[2 * features.SHAPES] == 3


@pytest.mark.parametrize("each", [5, 1000])
def test_sample_is_bounded_and_fixed(spark, each):
    rows = spark.createDataFrame([(i, "ab"[i % 7 == 0]) for i in range(3000)], "k long, label string")
    first, again = (sorted(r.k for r in features.sampled(rows.repartition(n), "k", "label", each).collect()) for n in (2, 7))
    assert first == again and len(first) <= 3 * each
