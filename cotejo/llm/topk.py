"""Exact top-k search by integer inner product, with a table of distances to pivots.

The distances of a query and of a candidate to all pivots say how far the two are apart at
least: one pivot proves |d(q, p) - d(x, p)|, and all together the largest distance that can be
proved, that of the two points which the distances fix above the pivots' plane if both stand
on one side of it (Pivots).  It bounds the inner product from above, as
2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2.  Candidates are evaluated in the order of that bound,
and evaluation stops where the bound falls below the k-th best score known, so results are
exact.

1. Every row's distances to the pivots are worked out once and saved beside the vector, in
   blocks of about ``BLOCK`` rows that have the same nearest pivot.
2. Queries are taken ``QUERIES`` at a time: a broadcast of bounded size, which all blocks are
   read past; no block is copied or shuffled for it.  A query's k-th best score among the
   rows that pivots were chosen from is where its search begins, and a task carries
   each query's best scores from block to block.
3. A block whose distances to some pivot all lie too far from the query's is left out
   whole; in others candidates are evaluated in bound order.

Pivots are a bounded choice of ``PIVOTS`` vectors out of a bounded sample of ``SAMPLE``; only
which bounds are tight depends on them, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import integers
from .common import saved

#: What components are multiplied with.
SCALE = 256
#: Rows of a block, queries at a time, pivots, the rows they are chosen from, and candidates evaluated at a time.
BLOCK, QUERIES, PIVOTS, SAMPLE, STEP = 1024, 16384, 48, 2048, 64
#: Queries of which the bounds of a block are worked out at a time.
QUERIES_AT_ONCE = 256
#: The sum of squares from which on a vector is long: it is compared with Python's integers, past the pivots.
LONG = float(1 << 62)


def usable(vectors: DataFrame, key: str, vector: str, is_query: Column) -> DataFrame:
    """(row, id, x, q, long): every row whose components are all finite, with a number of its own; x: the components as doubles."""
    x = F.transform(vector, lambda c: c.cast("double"))
    rows = vectors.where(F.col(key).isNotNull() & integers.finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), x.alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    size = F.aggregate("x", F.lit(0.0), lambda a, c: a + (c * SCALE) * (c * SCALE))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "x", "q", (size >= LONG).alias("long"))


def whole(x: Column) -> Column:
    return F.transform(x, lambda c: F.floor(c * SCALE).cast("long"))


def filled(lists, dims: int, kind: str):
    """An Arrow array of lists as a matrix; shorter lists are filled up with zeros."""
    import numpy as np

    offsets, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def matrix(rows: list, dims: int):
    """Numbers, ids and a matrix of the vectors of collected rows; shorter ones are filled up with zeros."""
    import numpy as np

    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r.v)] = r.v
    return np.array([r.row for r in rows], np.int64), np.array([r.id for r in rows], np.int64), out


def farthest(x, n: int):
    """At most n of the vectors, far from each other: each next one is the farthest from those chosen before."""
    import numpy as np

    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Pivots:
    """Where distances to pivots place a vector: its coordinates in the plane that holds all pivots, and its distance from the plane."""

    def __init__(self, points):
        import numpy as np

        self.points = points
        while len(self.points) > 1:
            self.corner = np.linalg.qr((self.points[1:] - self.points[0]).T)[1]
            size = np.zeros(len(self.points) - 1)
            size[: len(self.corner)] = np.abs(np.diag(self.corner))
            if (size > 1e-3 * size.max()).all():
                break
            # Pivots that lie nearly in the plane of those before them add nothing.
            self.points = self.points[np.append(True, size > 1e-3 * size.max())]
        self.gaps = ((self.points[1:] - self.points[:1]) ** 2).sum(1)

    def placed(self, d):
        import numpy as np

        square = d * d
        if len(self.points) < 2:
            return np.zeros((len(d), 0)), d[:, :1].sum(1)
        along = np.linalg.solve(self.corner.T, ((square[:, :1] + self.gaps - square[:, 1:]) / 2).T).T
        return along, np.sqrt(np.maximum(0, square[:, 0] - (along**2).sum(1)))


def distances(x, pivots):
    """Of each vector to each pivot."""
    import numpy as np

    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(1))
    return out


def placed(rows: DataFrame, pivots, dims: int) -> DataFrame:
    """rows with d, the distances to all pivots, and near, which pivot is the nearest."""
    import pyarrow as pa

    known = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                d = distances(filled(part.column("v"), dims, "f8"), known.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(1), pa.int32())], names=[*part.schema.names, "d", "near"])

    return rows.select("row", "id", "v", "q").mapInArrow(run, "row long, id long, v array<long>, q boolean, d array<double>, near int")


def products(x, q):
    """Exact inner products: in floating point while that is exact, or else in 64-bit integers."""
    import numpy as np

    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1] < 2.0**53:
        return (x.astype("f8") @ q.astype("f8")).astype(np.int64)
    return x @ q


class Best:
    """The k best (score, id) of each query that a task has met so far, and the score that its next one must reach."""

    def __init__(self, n: int, k: int, least):
        import numpy as np

        self.k, self.least = k, least.copy()
        self.scores = [np.empty(0, np.int64)] * n
        self.ids = [np.empty(0, np.int64)] * n

    def add(self, i: int, scores, ids) -> None:
        import numpy as np

        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        top = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[top], ids[top]
        if len(top) == self.k:
            self.least[i] = max(self.least[i], int(scores[top[-1]]))


def search(best: Best, pivots: Pivots, q_ids, q, q_d, ids, x, d) -> int:
    """Puts a block's candidates past all queries in bound order; returns how many products that took."""
    import numpy as np

    norms, q_norms = (x.astype("f8") ** 2).sum(1), (q.astype("f8") ** 2).sum(1)
    # Rounding is relative to the largest number there is, which may be a distance to a far pivot.
    slack = 1e-6 * (q_norms + norms.max() + d.max() ** 2 + (q_d**2).max(1)) + 1
    away = np.maximum(0, np.maximum(d.min(0) - q_d, q_d - d.max(0))).max(1, initial=0)
    hopeful = np.flatnonzero((q_norms + norms.max() - away**2) / 2 + slack >= best.least)
    along, off = pivots.placed(d)
    taken = 0
    for at in range(0, len(hopeful), QUERIES_AT_ONCE):
        own = hopeful[at : at + QUERIES_AT_ONCE]
        q_along, q_off = pivots.placed(q_d[own])
        apart = (q_along**2).sum(1)[:, None] + (along**2).sum(1) - 2 * q_along @ along.T + (q_off[:, None] - off) ** 2
        bounds = (q_norms[own][:, None] + norms - apart) / 2 + slack[own][:, None]
        for i, bound in zip(own, bounds):
            order = np.flatnonzero(bound >= best.least[i])
            order = order[np.argsort(-bound[order], kind="stable")]
            for start in range(0, len(order), STEP):
                part = order[start : start + STEP]
                part = part[bound[part] >= best.least[i]]
                if not len(part):
                    break
                taken += len(part)
                part = part[ids[part] != q_ids[i]]
                best.add(i, products(x[part], q[i]), ids[part])
    return taken


FOUND = "q_row long, query_id long, vec_id long, score long"


def found_batch(rows, ids, best: Best):
    """What a task has found, as an Arrow batch of FOUND."""
    import numpy as np
    import pyarrow as pa

    sizes = [len(x) for x in best.ids]
    every = lambda parts: pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, sizes)), pa.array(np.repeat(ids, sizes)), every(best.ids), every(best.scores)], names=["q_row", "query_id", "vec_id", "score"])


def turns_of(queries: DataFrame, n: int) -> list[DataFrame]:
    """n queries dealt into parts of about QUERIES."""
    parts = max(1, -(-n // QUERIES))
    turn = F.pmod(F.xxhash64("row", F.lit("turn")), F.lit(parts))
    return [queries.where(turn == i) for i in range(parts)] if n else []


def compared(queries: DataFrame, candidates: DataFrame, dims: int, k: int) -> DataFrame:
    """FOUND's rows from comparing some queries with all candidates, in Python's integers; scores beyond 64 bits are left out."""
    import numpy as np
    import pyarrow as pa

    rows = queries.select("row", "id", "x").orderBy("row").collect()
    q = integers.scaled(np.array([[*r.x, *[0.0] * (dims - len(r.x))] for r in rows], float).reshape(len(rows), dims), SCALE).astype(object)
    q_rows, q_ids = np.array([r.row for r in rows], np.int64), np.array([r.id for r in rows], np.int64)
    known = candidates.sparkSession.sparkContext.broadcast((q_rows, q_ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_rows, q_ids, q = known.value
        best = Best(len(q), k, np.full(len(q), np.iinfo(np.int64).min))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = integers.scaled(filled(part.column(1), dims, "f8"), SCALE).astype(object)
                for i in range(len(q)):
                    scores = x @ q[i]
                    fits = np.array([-integers.LONG <= s < integers.LONG for s in scores], bool) & (ids != q_ids[i])
                    best.add(i, scores[fits].astype(np.int64), ids[fits])
        yield found_batch(q_rows, q_ids, best)

    return candidates.select("id", "x").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query.

    Queries are the rows for which is_query holds; candidates are all rows but those with the
    query's own id.  Components are taken times SCALE and rounded down; score is the inner
    product.  Ties go to the smaller id.  Rows without id, without vector, or with a component
    that is null or not finite take no part; vectors of unequal length are filled up with
    zeros.  Rows that share an id are candidates, and queries, of their own.  A product that a
    long cannot hold is no score.  With fewer than k candidates all are returned; an empty table
    gives an empty result.

    Vectors whose sum of squares reaches LONG take no part in the search by pivots, whose
    bounds they would blunt: each is compared with every query, and as a query with every row.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = saved(usable(vectors, key, vector, is_query))
    dims, n_queries, n_long, n_long_queries = rows.agg(F.max(F.size("x")), F.count_if(F.col("q") & ~F.col("long")), F.count_if("long"), F.count_if(F.col("q") & F.col("long"))).first()
    dims = dims or 0
    short = rows.where(~F.col("long")).select("row", "id", whole(F.col("x")).alias("v"), "q")
    _, sample_ids, sample = matrix(short.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect(), dims)
    pivots = Pivots(farthest(sample.astype("f8"), PIVOTS))
    table = saved(placed(short, pivots.points, dims))
    sizes = {r.near: r["count"] for r in table.groupBy("near").count().collect()}
    parts = F.coalesce(*(F.when(F.col("near") == at, -(-n // BLOCK)) for at, n in sizes.items()), F.lit(1))
    blocks = saved(table.groupBy("near", F.pmod(F.xxhash64("row"), parts).alias("part")).agg(F.collect_list(F.struct("id", "v", "d")).alias("rows")).select("rows"))

    def best_of(chosen: DataFrame) -> DataFrame:
        """FOUND's rows from reading the blocks past some queries."""
        q_rows, q_ids, q = matrix(chosen.orderBy("row").collect(), dims)
        q_d = distances(q.astype("f8"), pivots.points)
        least = np.full(len(q), np.iinfo(np.int64).min)
        for i in range(len(q)):
            scores = products(sample[sample_ids != q_ids[i]], q[i])
            if len(scores) >= k:
                least[i] = np.partition(scores, -k)[-k]
        known = spark.sparkContext.broadcast((q_rows, q_ids, q, q_d, least))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_rows, q_ids, q, q_d, least = known.value
            best = Best(len(q), k, least)
            for batch in batches:
                for i in range(batch.num_rows):
                    block = batch.column(0)[i].values
                    ids = block.field("id").to_numpy(zero_copy_only=False)
                    search(best, pivots, q_ids, q, q_d, ids, filled(block.field("v"), dims, "i8"), filled(block.field("d"), len(pivots.points), "f8"))
            yield found_batch(q_rows, q_ids, best)

        return blocks.mapInArrow(run, FOUND)

    found = [best_of(turn) for turn in turns_of(table.where("q").select("row", "id", "v"), n_queries)]
    if n_long:
        long = rows.where("long")
        found += [compared(turn, long, dims, k) for turn in turns_of(rows.where("q and not long"), n_queries)]
        found += [compared(turn, rows, dims, k) for turn in turns_of(long.where("q"), n_long_queries)]
    every = reduce(DataFrame.unionAll, found if len(found) <= 2 else map(saved, found)) if found else spark.createDataFrame([], FOUND)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
