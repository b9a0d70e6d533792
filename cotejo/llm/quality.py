"""Quality scores by a vote of nearest labelled neighbours in a latent-semantic space.

A document's terms are the shapes of its words, pairs of neighbouring shapes, and how much
it repeats words (features.style).  Their TF-IDF vectors, with document frequencies counted
over all documents, are projected on the leading singular vectors of a bounded sample of
labelled rows (``EACH`` of each label).  Those rows' projections are broadcast; every
document is compared with all of them by blocked cosine products, and the ``NEIGHBOURS``
nearest vote with their label, weighted by a power of their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features
from .common import slices

#: Labelled rows of each label that are fitted on, latent dimensions, voters, and the power of their similarity.
EACH, DIMS, NEIGHBOURS, POWER = 1200, 32, 15, 8


def fitted(docs: DataFrame, labels: DataFrame, key: str, label: str, text: str) -> dict:
    """The model: idf, directions, and the labelled vectors with their labels.

    docs: all documents, whose terms are counted; labels: (key, label) of those to learn
    from.  Of rows that share a key the one with the smallest text is learned from, so at most
    1.5 * EACH rows of each label come to the driver.
    """
    import numpy as np

    df, n = features.frequencies(docs, text, features.style, features.STYLE)
    idf = features.inverse(df, n)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    share = known.agg(F.avg("_label")).first()[0]
    chosen = features.sampled(known, "_key", "_label", EACH)
    own = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    # A key may stand in any number of rows; one of them is learned from.
    own = own.join(F.broadcast(chosen), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text"))
    rows = features.counted_rows(own, ["_key", "_label"], "_text", features.style)
    rows.sort(key=lambda r: (r["_key"], r["at"], r["n"]))
    x = features.tf_idf(features.dense(rows, features.STYLE), idf)
    met = np.flatnonzero(x.any(0))
    directions = np.zeros((features.STYLE, min(DIMS, len(met))))
    directions[met] = np.linalg.eigh(x[:, met].T @ x[:, met])[1][:, ::-1][:, :DIMS]
    return {"idf": idf, "directions": directions, "vectors": unit(x @ directions), "labels": np.array([r["_label"] for r in rows], float), "share": 0.5 if share is None else float(share)}


def unit(x):
    import numpy as np

    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def nearest(alike, k: int):
    """The places of each row's k largest values, in order of place; of equal values the first."""
    import numpy as np

    least = np.partition(alike, -k, axis=1)[:, -k][:, None]
    above, equal = alike > least, alike == least
    chosen = above | equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True))
    return np.nonzero(chosen)[1].reshape(-1, k)


def votes(model: dict, counts):
    """The share of label 1 among each row's neighbours, by similarity; of a row without terms, the share among all that was learned from.

    Of equally similar neighbours those with the smaller keys vote.
    """
    import numpy as np

    if not len(model["labels"]):
        return np.full(len(counts), model["share"])
    own = unit(features.tf_idf(counts, model["idf"]) @ model["directions"])
    alike = own @ model["vectors"].T
    k = min(NEIGHBOURS, alike.shape[1])
    near = nearest(alike, k)
    weights = np.maximum(np.take_along_axis(alike, near, 1), 1e-3) ** POWER
    return np.where(counts.any(1), (weights * model["labels"][near]).sum(1) / weights.sum(1), model["share"])


def scored(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Every row of docs with score (0 to 1, higher: label 1 likelier) added.

    A null or empty text has no terms; its score is the share of label 1 among all labelled
    rows.  With nothing to learn from, every score is 0.5.  Repeated rows stay; a column of docs
    that is named score is left out.
    """
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                score = votes(known.value, features.style(part.column(at)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.mapInArrow(run, schema)
