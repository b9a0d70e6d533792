"""Centroid clustering by Lloyd's steps over ball trees.

Vectors of integers are packed into one metric tree for each ``TREE`` rows as they are read,
without a shuffle.  A node of a tree is a ball: a centre, the radius about it that holds its
rows, and their number and integer sum.  In a round the centroids are broadcast and each
tree is walked from its root: a centroid that is farther from the ball's centre than the
nearest one by more than twice the radius is nearest to none of the ball's rows (triangle
inequality).  A ball with one centroid left is assigned whole, by its number and sum; others
are opened, down to leaves whose rows are compared with the centroids left, in integers,
ties to the smaller number.

Trees are written once to the shared folder and only read after that; a task sends the
sums of its trees, whose number the centroids bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from . import integers
from .common import discarded, saved

#: What components are multiplied with, components of a vector, clusters, rounds.
SCALE, DIMS, CLUSTERS, ROUNDS = 1024, 64, 8, 10
#: Rows of a tree and, at most, of a leaf.
TREE, LEAF = 4096, 16


def cuts(n: int) -> list[list[tuple[int, int]]]:
    """The rows of each node of a tree of n rows, level by level; every node has two children until all have at most LEAF rows."""
    levels = [[(0, n)]]
    while max(b - a for a, b in levels[-1]) > LEAF:
        levels.append([x for a, b in levels[-1] for x in ((a, (a + b) // 2), ((a + b) // 2, b))])
    return levels


def grown(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the rows in their tree, and of its nodes, level by level, the centres, the radii and the sums.

    A node's rows are halved along the line from the row farthest from its centre to the row
    farthest from that one.
    """
    order, y = np.arange(len(x)), x.astype(np.float64)
    if not integers.fits(x):
        # Too large for balls in floating point: one leaf that is always opened.
        return order, np.zeros((1, x.shape[1])), np.array([np.inf]), x.sum(0)[None]
    centres, radii, sums = [], [], []
    levels = cuts(len(x))
    for depth, level in enumerate(levels):
        for a, b in level:
            own = y[order[a:b]]
            centre = own.mean(0) if b > a else np.zeros(x.shape[1])
            far = np.sqrt(((own - centre) ** 2).sum(1))
            centres.append(centre)
            radii.append(far.max(initial=0) * (1 + 1e-9) + 1e-6)
            sums.append(x[order[a:b]].sum(0))
            if depth + 1 < len(levels) and b - a > 1:
                one = own[far.argmax()]
                line = own[((own - one) ** 2).sum(1).argmax()] - one
                order[a:b] = order[a:b][np.argpartition(own @ line, (b - a) // 2)]
    return order, np.array(centres), np.array(radii), np.array(sums)


def trees(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """One row for each tree: ids and x (the rows in the tree's order), centres, radii, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TREE):
                part = batch.slice(at, TREE)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMS)
                x = integers.scaled(values, SCALE)
                order, centres, radii, sums = grown(x)
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0).take(pa.array(order)))
                made = [integers.packed(x[order]), centres.tobytes(), radii.tobytes(), integers.packed(sums)]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([m], pa.binary()) for m in made)], names=["ids", "x", "centres", "radii", "sums"])

    schema = t.StructType([t.StructField("ids", t.ArrayType(vectors.schema[key].dataType)), *(t.StructField(c, t.BinaryType()) for c in ("x", "centres", "radii", "sums"))])
    return vectors.select(key, vector).mapInArrow(run, schema)


class Walk:
    """One tree walked past some centroids: each row's cluster, each cluster's sum and number, and how many rows went with whole balls."""

    def __init__(self, tree: dict, centroids: np.ndarray):
        self.x = integers.unpacked(tree["x"], DIMS)
        self.sums = np.zeros((len(centroids), DIMS + 1), object)
        self.clusters = np.zeros(len(self.x), np.int32)
        self.whole = 0
        exact = integers.fits(self.x, centroids)
        levels = cuts(len(self.x)) if exact else [[(0, len(self.x))]]
        centres = np.frombuffer(tree["centres"]).reshape(-1, DIMS)
        radii, sums = np.frombuffer(tree["radii"]), integers.unpacked(tree["sums"], DIMS)
        active, left = np.zeros(1, int), np.ones((1, len(centroids)), bool)
        first = 0
        for depth, level in enumerate(levels):
            if exact:
                left &= self.possible(centres[first + active], radii[first + active], centroids, left)
            single = left.sum(1) == 1
            for node, k in zip(active[single], left[single].argmax(1)):
                a, b = level[node]
                self.sums[k, :-1] += sums[first + node]
                self.sums[k, -1] += b - a
                self.clusters[a:b] = k
                self.whole += b - a
            active, left = active[~single], left[~single]
            if depth + 1 < len(levels):
                first += len(level)
                active, left = np.repeat(2 * active, 2) + np.tile([0, 1], len(active)), np.repeat(left, 2, axis=0)
            else:
                self.opened([level[i] for i in active], left, centroids)

    @staticmethod
    def possible(centres: np.ndarray, radii: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Which centroids may be nearest to a row of each ball."""
        c = centroids.astype(np.float64)
        d = np.sqrt(np.maximum(0, (centres**2).sum(1)[:, None] - 2 * (centres @ c.T) + (c**2).sum(1)))
        # The expansion's rounding error is relative to the squares it subtracts.
        slack = 1e-6 * (1 + np.sqrt((centres**2).sum(1).max(initial=0)) + np.sqrt((c**2).sum(1).max(initial=0)))
        nearest = np.where(left, d, np.inf).min(1)
        return d <= (nearest + 2 * radii + slack)[:, None]

    def opened(self, leaves: list[tuple[int, int]], left: np.ndarray, centroids: np.ndarray) -> None:
        """Compares the rows of leaves with the centroids that they have left."""
        if not leaves:
            return
        sizes = [b - a for a, b in leaves]
        rows = np.concatenate([np.arange(a, b) for a, b in leaves])
        d = integers.squared(self.x[rows], centroids)
        if d.dtype == object:
            best = d.argmin(1)
        else:
            best = np.where(np.repeat(left, sizes, axis=0), d, np.iinfo(np.int64).max).argmin(1)
        self.clusters[rows] = best
        own = np.zeros((len(centroids), DIMS + 1), self.x.dtype)
        np.add.at(own[:, :-1], best, self.x[rows])
        np.add.at(own[:, -1], best, 1)
        self.sums += own


def walked(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(sums, n_whole) of each tree: packed sums and numbers of the clusters, and how many rows went with whole balls."""
    known = made.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.to_pylist():
                walk = Walk(tree, known.value)
                small = walk.x.dtype != object
                yield pa.RecordBatch.from_arrays([pa.array([integers.packed(walk.sums.astype(np.int64) if small else walk.sums)], pa.binary()), pa.array([walk.whole], pa.int64())], names=["sums", "n_whole"])

    return made.select("x", "centres", "radii", "sums").mapInArrow(run, "sums binary, n_whole long")


def assigned(made: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """(key, cluster, distance) of every row of the trees."""
    known = made.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, tree in enumerate(batch.to_pylist()):
                walk = Walk(tree, known.value)
                x, own = walk.x, known.value[walk.clusters]
                if not integers.fits(x, own):
                    x, own = x.astype(object), own.astype(object)
                distance = integers.as_longs(((x - own) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(walk.clusters, pa.int32()), distance], names=[key, "cluster", "distance"])

    schema = t.StructType([t.StructField(key, made.schema["ids"].dataType.elementType), t.StructField("cluster", t.IntegerType()), t.StructField("distance", t.LongType())])
    return made.mapInArrow(run, schema)


def first_centroids(vectors: DataFrame, key: str, vector: str) -> np.ndarray:
    """The vectors whose ids have the smallest hashes; rows without an id come behind all others, equal ids by their vectors."""
    spot = F.sha2(F.concat(F.lit("3:"), F.col(key).cast("string")), 256)
    rows = vectors.select(vector, spot.alias("_spot")).orderBy(F.col("_spot").asc_nulls_last(), vector).limit(CLUSTERS).collect()
    return integers.scaled(np.array([r[0] for r in rows], np.float64).reshape(-1, DIMS), SCALE)


def fitted(made: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, list[int]]:
    """The centroids after all rounds, and how many rows each round assigned with whole balls."""
    whole = []
    for _ in range(rounds if len(centroids) else 0):
        turn = saved(walked(made, centroids))
        sums = integers.totals(turn, "sums", (len(centroids), DIMS + 1))
        whole.append(turn.agg(F.sum("n_whole")).first()[0] or 0)
        discarded(turn)
        means = [[s // n for s in row] if n else list(old) for (*row, n), old in zip(sums.tolist(), centroids.tolist())]
        centroids = integers.narrowed(np.array(means, object).reshape(centroids.shape))
    return centroids, whole


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of DIMS components.

    Components are taken times SCALE and rounded down; distance is squared, and inertia its
    sum over the cluster and over all.

    Rows whose vector is null, of another length, or holds a null or a component that is not
    finite take no part.  Repeated rows and repeated keys stay, each a vector of its own;
    rows without a key come behind all others when the first centroids are chosen.  With fewer
    vectors than CLUSTERS there are as many centroids.  A distance or sum beyond 64 bits is
    null.  Other columns don't matter; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    given = vectors.where(integers.finite(F.col(vector)) & (F.size(vector) == DIMS)).select(F.col(key).alias("_key"), F.transform(vector, lambda x: x.cast("double")).alias("_vector"))
    made = saved(trees(given, "_key", "_vector"))
    centroids, _ = fitted(made, first_centroids(given, "_key", "_vector"))
    rows = saved(assigned(made, centroids, "_key"))
    discarded(made)
    # No more rows than there are centroids.
    sums = {r.cluster: r for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("of"), (F.count("distance") == F.count("cluster")).alias("known")).collect()}
    inertia = lambda own: int(sum(r.of for r in own)) if all(r.known for r in own) and sum(r.of for r in own) < integers.LONG else None
    every = inertia(sums.values())
    facts = [(k, inertia([sums[k]]) if k in sums else 0, every, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
