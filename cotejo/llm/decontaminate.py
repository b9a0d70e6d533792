"""Benchmark items inside documents: size-partitioned MinHash containment search, DataFrame functions only.

1. Items and documents become sets of hashed five-word shingles.  A document keeps only
   shingles that some item has; no item's containment changes by that.
2. Documents and items are partitioned by the size of their sets, in powers of two.  In a
   pair of partitions an item that is contained as asked has a Jaccard similarity of at
   least some bound, which says how many MinHash values the pair compares, so that a match
   is missed with a chance below ``MISS``.  Where the document is more than
   ``2 ** FAR`` times as large as the item, that would take too many values, and every
   shingle of the item counts as one: nothing is missed.
3. Pairs that agree in a value are verified by the exact share of the item's shingles that
   the document has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .repeats import ID, with_order

WORDS = 5
#: Chance to miss a match, and how many powers of two documents may be larger than items for MinHash.
MISS, FAR = 1e-8, 2
#: Item shingles, and MinHash values of items, that are broadcast at most; more are joined by shuffling.
BROADCAST = 2_000_000


def shingled(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and shingle: the distinct shingles of each row, hashed; a text of fewer words has its whole sequence as one."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_w")).where(F.size("_w") > 0)
    at = lambda i: F.xxhash64(*(F.get("_w", i + k) for k in range(WORDS)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - WORDS, F.lit(0))), at)
    return rows.select(*keys, F.explode(F.array_distinct(runs)).alias("shingle"))


def size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) + 1e-12).cast("int")


def n_values(far: int, percent: int) -> int:
    """MinHash values for items whose documents are less than 2 ** (far + 1) times as large."""
    t = percent / 100
    least = t / (2 ** (max(far, 0) + 1) + 1 - t)
    return math.ceil(math.log(MISS) / math.log(1 - least))


def values(rows: DataFrame, n: int) -> DataFrame:
    """at and value: the first n MinHash values of each row's set."""
    signature = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_min(F.transform("shingles", lambda s: F.xxhash64(s, i))))
    return rows.select("*", F.posexplode(signature).alias("at", "value")).drop("shingles")


def matches(docs: DataFrame, items: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_shared, n_item, _cotejo_id): the items that documents contain.

    A document contains an item if it has at least ``percent`` of the item's distinct
    shingles; n_item is their number and n_shared how many of them it has.  Texts that are
    null or have no words contain nothing and are contained in nothing.  An item of fewer
    than five words is found only in documents of exactly the same words.  Documents without
    an id are told apart by their text; rows that share an id are one document, as are items
    that share an id.  Items without an id count as one.  Empty tables give an empty result.
    """
    docs = with_order(docs, key, text).select(ID, F.col(key).cast("long").alias(key), text)
    sets = (
        shingled(items.select(F.col(item_key).cast("long").alias("_item"), F.col(item_text).alias("_text")), ["_item"], "_text")
        .groupBy(F.col("_item").alias("item"))
        .agg(F.collect_set("shingle").alias("shingles"))
        .withColumn("n_item", F.size("shingles"))
        .withColumn("item_class", size_class(F.col("n_item")))
    )
    sets = saved(sets)
    least, total, n_sets = sets.agg(F.min("n_item"), F.sum("n_item"), F.count("*")).first()
    asked = saved(sets.select(F.explode("shingles").alias("shingle")).distinct())
    few = (total or 0) <= BROADCAST
    bounded = lambda df, each=1: F.broadcast(df) if few and each * n_sets <= BROADCAST else df
    own = (
        shingled(docs, [ID, key], text)
        .join(bounded(asked), "shingle", "left_semi")
        .groupBy(ID, key)
        .agg(F.collect_set("shingle").alias("shingles"))
        .where(F.size("shingles") * 100 >= percent * (least or 0))
        .withColumn("doc_class", size_class(F.size("shingles")))
    )
    own = saved(own)
    most = n_values(FAR, percent)
    item_values = values(sets.select("item", "item_class", "shingles"), most)
    doc_values = values(own.select(ID, "doc_class", "shingles"), most)
    apart = F.col("doc_class") - F.col("item_class")
    enough = F.coalesce(*(F.when(apart <= d, F.col("at") < n_values(d, percent)) for d in range(FAR + 1)), F.lit(False))
    near = doc_values.join(bounded(item_values, most), ["at", "value"]).where(enough).select(ID, "item")
    far = (
        own.select(ID, "doc_class", F.explode("shingles").alias("shingle"))
        .join(bounded(sets.select("item", "item_class", F.explode("shingles").alias("shingle"))), "shingle")
        .where(apart > FAR)
        .select(ID, "item")
    )
    pairs = near.union(far).distinct()
    shared = F.size(F.array_intersect("shingles", "item_shingles")).cast("long")
    return (
        pairs.join(own, ID)
        .join(bounded(sets.select("item", F.col("shingles").alias("item_shingles"), "n_item")), "item")
        .select(F.col(key), F.col("item").alias(item_key), shared.alias("n_shared"), F.col("n_item").cast("long").alias("n_item"), ID)
        .where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    )


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that contain no item; columns are those of docs."""
    found = matches(docs, items, percent, text, key).select(F.col(ID).alias("_found")).distinct()
    marked = with_order(docs, key, text)
    return marked.join(found, marked[ID] == found["_found"], "left_anti").drop(ID)
