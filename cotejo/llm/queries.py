"""The corpus operators' queries over the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, decontaminate, language_id, near_dedup, pii, quality, repeats, secrets, topk, vector_codes, wrapper
from .common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labelled ones that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality.fitted(docs, labels.where(~held_out), "doc_id", "quality", "text")
    return quality.scored(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document contains."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


CONTAINED_SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), runs AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS run
  FROM words WHERE len(w) > 0
), items AS (
  SELECT id, run, count(*) OVER (PARTITION BY id) AS n_item FROM runs WHERE side = 'b'
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, i.n_item
FROM items i JOIN runs d ON d.side = 'd' AND d.run = i.run
GROUP BY d.id, i.id, i.n_item
HAVING count(*) * 100 >= 80 * i.n_item
"""


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in every document; counts and digest are those of the base patterns."""
    found = pii.spans(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), added)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that stood before, and how many those are."""
    return repeats.without_repeated_sentences(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_units", "n_removed")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document, at a similarity of 0.85."""
    return near_dedup.classes(table(spark, sf_dir, "documents"), percent=85).withColumn("kept", F.col("doc_id") == F.col("component_id"))


NEAR_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), runs AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS run
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), sides AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, s.b FROM reach r JOIN sides s ON s.a = r.other
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stood before in runs of three, and how many those are."""
    return repeats.without_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_units", "n_removed")


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line
  FROM documents
), solid AS (
  SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM lines
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
), runs AS (
  SELECT doc_id, pos AS first_pos,
         lead(pos, 2) OVER w AS last_pos,
         bare || chr(10) || lead(bare, 1) OVER w || chr(10) || lead(bare, 2) OVER w AS run
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), ranked AS (
  SELECT doc_id, first_pos, last_pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, first_pos) AS k
  FROM runs WHERE run IS NOT NULL
), covered AS (
  SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN ranked r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.first_pos AND r.last_pos AND r.k > 1
)
SELECT l.doc_id,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL), '') AS text,
       CASE WHEN max(length(l.line)) = 0 AND count(*) = 1 THEN 0 ELSE count(*) END AS n_units, count(c.pos) AS n_removed
FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos
GROUP BY l.doc_id
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.fitted(docs.where(~held_out))
    return language_id.predicted(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return wrapper.extracted(table(spark, sf_dir, "pages"))


# What the operator finds on pages like the synthetic ones: the article's blocks, whose references are of two kinds.
ARTICLES_SQL = r"""
WITH blocks AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;', '&'), '&amp', '&'), '\s+', ' ', 'g'))
  ), lambda b: b <> '') AS b FROM pages
)
SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, length(array_to_string(b, chr(10) || chr(10))) AS n_chars FROM blocks
"""


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in every document; counts and digest are those of the base patterns."""
    found = secrets.spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in secrets.KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"), added)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector, and the errors that codes make."""
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector, and the inertia of clusters."""
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def vectors_sql(scale: int, keep: str, number: str) -> str:
    """The kept vectors as integers, in doubles, with the number that starting rows are chosen by."""
    return f"""
v AS MATERIALIZED (
  SELECT {keep}, {number} AS rn, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)"""


SQUARED = "CAST(list_dot_product({a}, {a}) - 2 * list_dot_product({a}, {b}) + list_dot_product({b}, {b}) AS BIGINT)"


def codes_sql() -> str:
    """All rounds one after the other, each of two steps: every part's nearest entry, and the entries' means."""
    steps = [
        vectors_sql(4096, "vec_id, label", "row_number() OVER (ORDER BY vec_id) - 1"),
        "parts AS MATERIALIZED (SELECT rn, p, x[p * 8 + 1 : p * 8 + 8] AS y FROM v, range(8) AS t(p))",
        "c0 AS MATERIALIZED (SELECT p, rn AS k, y AS c FROM parts WHERE rn < 16)",
    ]
    for r in range(7):
        distance = SQUARED.format(a="y", b="c")
        steps.append(f"a{r} AS MATERIALIZED (SELECT p, rn, min({distance} * 16 + k) AS best FROM parts JOIN c{r} USING (p) GROUP BY p, rn)")
        if r < 6:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT p, k, list(m ORDER BY i) AS c FROM (
    SELECT p, best % 16 AS k, i, floor(sum(y[i]) / count(*)) AS m FROM a{r} JOIN parts USING (p, rn), range(1, 9) AS t(i) GROUP BY ALL
  ) GROUP BY p, k
), c{r + 1} AS MATERIALIZED (SELECT p, k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, k))""")
    return f"""WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error
  FROM a6 JOIN v USING (rn) GROUP BY rn, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, k, i)) FROM c6, range(1, 9) AS t(i)) AS codebooks_sha256
FROM coded"""


def clusters_sql() -> str:
    steps = [
        vectors_sql(1024, "vec_id", "row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1"),
        "c0 AS MATERIALIZED (SELECT rn AS k, x AS c FROM v WHERE rn < 8)",
    ]
    for r in range(11):
        distance = SQUARED.format(a="x", b="c")
        steps.append(f"a{r} AS MATERIALIZED (SELECT rn, min({distance} * 8 + k) AS best FROM v, c{r} GROUP BY rn)")
        if r < 10:
            steps.append(f"""m{r} AS MATERIALIZED (
  SELECT k, list(m ORDER BY i) AS c FROM (
    SELECT best % 8 AS k, i, floor(sum(x[i]) / count(*)) AS m FROM a{r} JOIN v USING (rn), range(1, 65) AS t(i) GROUP BY ALL
  ) GROUP BY k
), c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))""")
    return f"""WITH {", ".join(steps)}, hashes AS (
  SELECT k, sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c10, range(1, 65) AS t(i) GROUP BY k
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, best // 8 AS distance, CAST(sum(best // 8) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // 8) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a10 JOIN v USING (rn) JOIN hashes ON k = best % 8"""


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_quality, op2_decontamination, op3_pii, op4_substring_dedup, op5_near_dedup, op6_topk, op7_line_dedup,
        op8_bpe, op9_language, op10_html, op11_secrets, op12_vector_codes, op13_centroids,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": CONTAINED_SQL,
        "op5_near_dedup": NEAR_SQL,
        "op6_topk": TOPK_SQL,
        "op7_line_dedup": LINES_SQL,
        "op10_html": ARTICLES_SQL,
        "op12_vector_codes": codes_sql(),
        "op13_centroids": clusters_sql(),
    }
