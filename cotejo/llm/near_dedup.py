"""Near-duplicate documents by fast similarity sketching.

1. Texts with equal shingle sets fall into one class, which its smallest id stands for;
   sets are equal if their sizes and two 64-bit sums over all of their shingles are.
2. Each class's set is sketched (shingles.sketch) and cut into bands; classes that agree in
   a band share a bucket.  The number of bands follows from the threshold, so that a pair
   at the threshold shares no bucket with a chance below ``MISS``.
3. In each bucket every class is compared with the smallest one only, on full sets.  That
   links most groups with as many pairs as members.
4. Other classes of a bucket that still are in different components are compared exactly
   without listing all pairs of a bucket: a prefix-filter join on their rarest shingles.
   Two sets as similar as asked must share one of their rarest shingles, at places and
   with sizes that bound the pair's overlap; the bound is part of the join's key, so that
   copies of one text whose edits differ do not meet at all.
5. Links are put together to components.

Nothing is capped: every pair of classes that shares a bucket and could reach the
threshold is compared, except pairs that are in one component already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import discarded, saved, slices
from .graph import components

#: Rows of a band, and the chance that a pair at the threshold shares no band.
ROWS, MISS = 4, 1e-8
#: Sets of one size band differ by this factor at most.
BAND = 1.03
#: Ids that are broadcast at most, to keep texts of which no set is needed out of a shuffle; more are joined by shuffling.
BROADCAST = 2_000_000


def n_bands(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS))


def sketches(docs: DataFrame, percent: int, text: str) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, bands); k1 and k2 together stand for the set."""
    import numpy as np
    import pyarrow as pa

    bands = n_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = shingles.shingle_sets(part.column(1))
                keys = [[int(x.sum().astype("i8")), int(np.bitwise_xor.reduce(shingles.mixed(x ^ shingles.STEP)).astype("i8"))] if len(x) else [0, 0] for x in sets]
                marks = [shingles.bands(x, bands, ROWS).astype("i8") if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(marks, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def full_sets(docs: DataFrame, text: str) -> DataFrame:
    """(id, items): sorted shingle hashes of every row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                sets = [x.astype("i8") for x in shingles.shingle_sets(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "items"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(run, "id long, items array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are as similar as asked."""
    import numpy as np
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            x, y = batch.column("x"), batch.column("y")
            xs, ys, xo, yo = (np.asarray(part) for part in (x.values, y.values, x.offsets, y.offsets))
            keep = []
            for i in range(batch.num_rows):
                p, q = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    return (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        .join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a")
        .where(small.cast("long") * 100 >= large.cast("long") * percent)
        .select("a", "b", "x", "y")
        .mapInArrow(run, "a long, b long")
    )


def overlap(percent: int, a, b):
    """The least overlap of two sets of these sizes that are as similar as asked."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - 1e-9)


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (a, b) of nodes (id, component) of different components that could be as similar as asked, and two saved tables they are read from."""
    t = percent / 100
    tokens = nodes.join(sets, "id").select("id", "component", F.size("items").alias("n"), F.explode("items").alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    # A token that no other node has can't be shared; it only shortens what can be.
    # Rarest first: a list is at most as long as its set.
    ranked = saved(
        tokens.join(common, "token")
        .groupBy("id", "component", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("items"))
        .select("id", "component", F.col("n").cast("long").alias("n"), F.col("items.token").alias("tokens"))
    )
    # left: how many tokens a set still has from a place on, its own included.
    left = (F.size("tokens") - F.col("place")).cast("long").alias("left")
    placed = ranked.select("id", "component", "n", "tokens", F.posexplode("tokens").alias("place", "token")).select("id", "component", "n", "token", left)
    band = lambda size: F.floor(F.log(size) / math.log(BAND))
    records = placed.where(F.col("left") >= F.ceil(F.col("n") * t - 1e-9))
    small = records.where(F.col("left") >= overlap(percent, F.col("n"), F.col("n"))).withColumn("band", band(F.col("n")))
    most = F.least(F.col("n"), F.floor(F.col("left") * (1 + t) / t + 1e-9) - F.col("n"))
    large = (
        records.withColumn("most", most)
        .where(F.col("most") >= F.ceil(F.col("n") * t - 1e-9))
        .withColumn("band", F.explode(F.sequence(band(F.greatest(F.lit(1), F.ceil(F.col("n") * t - 1e-9))), band(F.col("most")))))
    )
    key = ["token", "band"]
    counts = small.select(*key, "component").union(large.select(*key, "component")).groupBy(*key, "component").agg(F.count("*").alias("k"))
    mixed = saved(counts.groupBy(*key).agg(F.max_by("component", F.struct("k", "component")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts"))
    small = saved(small.join(mixed, key).select(*key, F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("left").alias("la"), (F.col("component") == F.col("major")).alias("main")))
    large = saved(large.join(mixed, key).select(*key, F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("left").alias("lb"), (F.col("component") == F.col("major")).alias("main_b")))
    fits = (
        (F.col("ca") != F.col("cb"))
        & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") * 100 >= F.col("nb") * percent)
        & (F.least("la", "lb") >= overlap(percent, F.col("na"), F.col("nb")))
    )
    on = lambda x, y: x.join(y, [x[k] == y[k] for k in key] + [fits]).select("a", "b")
    discarded(ranked, mixed)
    return on(small.where("not main"), large).union(on(small.where("main"), large.where("not main_b"))).distinct(), small, large


def classes(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """Of every row of docs: doc_id, n_shingles and component_id.

    docs: doc_id (a number) and text; other columns don't matter.  Links join documents
    with 100 * intersection >= percent * union of their sets of five-word shingles.
    component_id is the smallest doc_id that can be reached over links, the document's own
    included.  A text that is null or without words has an empty set and is linked with
    nothing.  Rows without doc_id have no component (null).  Rows that share a doc_id are
    one document.  An empty table gives an empty result.
    """
    marks = saved(sketches(docs, percent, text))
    same = ["n_shingles", "k1", "k2"]
    known = marks.where("n_shingles > 0 and doc_id is not null")
    reps = saved(known.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    rows = reps.select("rep", F.explode("bands").alias("bucket"))
    stars = rows.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last").select("bucket", "a")
    # Every class but the first of its bucket; classes that are alone in theirs are left out.
    members = saved(rows.join(stars, "bucket").where("rep > a").select("bucket", "a", F.col("rep").alias("b")))
    pairs = saved(members.select("a", "b").distinct())
    nodes = pairs.select("a").union(pairs.select("b")).distinct()
    if pairs.count() <= BROADCAST // 2:
        nodes = F.broadcast(nodes)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text))
    sets = saved(full_sets(whole.join(nodes, whole["doc_id"] == nodes["a"], "left_semi"), text))
    links = saved(confirmed(pairs, sets, percent))
    labels = components(links)

    # The first class of a bucket was compared with all others, so only these can lack a link among themselves.
    placed = members.join(labels, F.col("b") == F.col("node"), "left").select("bucket", "b", F.coalesce("component", "b").alias("component"))
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    loose = saved(placed.join(open_, "bucket").select(F.col("b").alias("id"), "component").distinct())
    discarded(members, labels)
    near, *read = rare_pairs(loose, sets, percent)
    more = saved(confirmed(near.join(pairs, ["a", "b"], "left_anti"), sets, percent))
    discarded(loose, pairs, sets, *read)
    labels = components(links.union(more))
    discarded(links, more)

    named = reps.join(labels, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("component", "rep").alias("component_id"))
    known = known.join(named, same).select("doc_id", "n_shingles", "component_id")
    rest = marks.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.union(rest)


def deduplicated(docs: DataFrame, percent: int = 80, text: str = "text") -> DataFrame:
    """The rows of docs that stay: one document of each component, the one with the smallest doc_id.

    Columns are those of docs.  Rows without doc_id stay, as do texts without words.
    """
    gone = classes(docs, percent, text).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
