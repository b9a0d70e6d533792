"""Language of texts by sparse multinomial logistic regression on character n-grams.

Features are TF-IDF values of hashed n-grams of one to three lower-cased letters, with
document frequencies counted over all rows there are to learn from.  The model is trained
with follow-the-regularised-leader (per-coordinate steps, elastic-net penalties) on a
bounded sample of those rows (``EACH`` of each language); a fifth of the sample is held
back to fit the temperature that scores are calibrated with.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import slices

#: Rows of each language that are fitted on, and passes over them.
EACH, PASSES = 600, 4
#: The steps' size and offset, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01

UNKNOWN = "und"


def softmax(x):
    import numpy as np

    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def weighed(row, idf):
    """The places and TF-IDF values of a row of sparse counts, of unit length."""
    import numpy as np

    at = np.array(row["at"], np.int64)
    v = np.log1p(np.array(row["n"], float)) * idf[at]
    return at, v / max(np.sqrt((v * v).sum()), 1e-12)


def trained(x: list, y, n: int, dims: int):
    """Weights (dims + 1, classes) by follow-the-regularised-leader on sparse rows (places, values); the last one is the intercept."""
    import numpy as np

    z, g2 = np.zeros((dims + 1, n)), np.zeros((dims + 1, n))
    penalty = np.append(np.full(dims, L1), 0)[:, None]

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * penalty[at]) / ((BETA + np.sqrt(g2[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) <= penalty[at], 0, w)

    order = np.random.default_rng(1)
    for _ in range(PASSES):
        for i in order.permutation(len(x)):
            at, v = np.append(x[i][0], dims), np.append(x[i][1], 1.0)
            w = weights(at)
            wrong = softmax(v @ w)
            wrong[y[i]] -= 1
            g = v[:, None] * wrong
            z[at] += g - (np.sqrt(g2[at] + g * g) - np.sqrt(g2[at])) / ALPHA * w
            g2[at] += g * g
    return weights(np.arange(len(z)))


def temperature(logits, y) -> float:
    """What logits are divided by so that held-back rows are likeliest."""
    import numpy as np

    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(-2, 2, 81))
    return float(min(tried, key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()))


def fitted(docs: DataFrame, key: str = "doc_id", label: str = "lang", text: str = "text") -> dict:
    """The model learned from the rows of docs that have a label.

    Of rows that share a key the one with the smallest language and text is learned from, so
    at most 1.5 * EACH rows of each language come to the driver, as sparse counts.
    """
    import numpy as np

    docs = docs.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(text).alias("_text"))
    df, n = features.frequencies(docs, "_text", gram_counts, features.GRAMS)
    idf = features.inverse(df, n)
    chosen = features.sampled(docs.select("_key", "_label"), "_key", "_label", EACH).select("_key").distinct()
    own = docs.join(F.broadcast(chosen), "_key", "left_semi").groupBy("_key").agg(F.min(F.struct("_label", "_text")).alias("_row")).select("_key", "_row.*")
    rows = features.counted_rows(own, ["_key", "_label"], "_text", gram_counts)
    rows = sorted((r for r in rows if r["at"]), key=lambda r: (str(r["_key"]), r["at"], r["n"]))
    names = sorted({r["_label"] for r in rows})
    if not names:
        return {"names": [], "idf": idf}
    x, y = [weighed(r, idf) for r in rows], np.array([names.index(r["_label"]) for r in rows])
    held = [i for i in range(len(y)) if i % 5 == 4]
    used = [i for i in range(len(y)) if i % 5 != 4]
    w = trained([x[i] for i in used], y[used], len(names), features.GRAMS)
    logits = np.array([v @ w[at] + w[-1] for at, v in (x[i] for i in held)]).reshape(len(held), len(names))
    return {"names": names, "idf": idf, "weights": w, "temperature": temperature(logits, y[held])}


def gram_counts(texts):
    return features.by_pieces(lambda part: features.grams(part.to_pylist()), features.long_grams, texts, features.GRAMS)


def predicted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every row of docs with lang_pred and score (its probability) added.

    A text that is null or has no letter, and any text where there was nothing to learn
    from, gets the language 'und' and the score 0.  Repeated rows stay; columns of docs with
    the names of added ones are left out.
    """
    import numpy as np
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for part in slices(batch, at):
                counts = gram_counts(part.column(at))
                names, best = [UNKNOWN] * len(counts), np.zeros(len(counts))
                if m["names"]:
                    p = softmax((features.tf_idf(counts, m["idf"]) @ m["weights"][:-1] + m["weights"][-1]) / m["temperature"])
                    lettered = counts.any(1)
                    names = [m["names"][k] if ok else UNKNOWN for k, ok in zip(p.argmax(1), lettered)]
                    best = np.where(lettered, p.max(1), 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(best, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, score double"])
    return docs.mapInArrow(run, schema)
