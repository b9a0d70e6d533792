"""From raw documents to token ids: five stages, each of which calls one of the corpus operators.

Each stage takes what the one before it kept.  Between stages documents are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cotejo.llm import bpe, decontaminate, near_dedup, quality, repeats
from cotejo.llm.common import discarded, saved, table
from cotejo.llm.queries import tokenizer

#: Documents with a lower quality score go; near duplicates have this similarity in percent at least.
LEAST_QUALITY, ALIKE = 0.3, 80


def aside(docs: DataFrame, *names: str) -> DataFrame:
    """docs with columns renamed that an operator would put its own in the place of."""
    return docs.withColumnsRenamed({n: f"_own_{n}" for n in names})


def back(docs: DataFrame, columns: list[str], *names: str) -> DataFrame:
    return docs.drop(*names).withColumnsRenamed({f"_own_{n}": n for n in names}).select(*columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of labelled neighbours does not reject; texts without words stay."""
    model = quality.fitted(docs, table(spark, sf_dir, "labels"), "doc_id", "quality", "text")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    kept = quality.scored(aside(docs, "score"), model).where((F.col("score") >= LEAST_QUALITY) | blank)
    return back(kept, docs.columns, "score")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stood before in runs of three; those of which nothing is left go."""
    cut = repeats.without_repeated_lines(aside(docs, "n_units", "n_removed")).where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return back(cut, docs.columns, "n_units", "n_removed")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.deduplicated(docs, ALIKE)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and whether they decode to its text."""
    coded = bpe.encode_decode(docs, tokenizer())
    return coded.select("doc_id", "n_tokens", "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", token_ids),
]

#: SQL expresses neither the quality vote nor byte-pair merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        kept = saved(stage(spark, docs, sf_dir))
        if n:
            discarded(docs)
        docs = kept
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
