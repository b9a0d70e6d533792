"""Queries over the synthetic tables, one for each operator of the library, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import diff, numbers
from ..functions import text as T
from ..operators import match, rollup
from ..streaming import sessions, tempo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The two dialects in DuckDB's SQL.


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_deaccent(x: str) -> str:
    return f"translate(translate({x}, {quoted(T.INVERTED)}, ''), {quoted(T.one_level()[0])}, {quoted(T.one_level()[1])})"


def sql_simplify(x: str) -> str:
    return rf"lower(translate(trim(regexp_replace({sql_deaccent(x)}, '\s+', ' ', 'g')), {quoted(T.DROPPED)}, ''))"


def sql_simplify_full(x: str) -> str:
    bare = f"translate(translate(strip_accents(translate({x}, {quoted(T.INVERTED)}, '')), {quoted(T.DROPPED_FULL)}, ''), {quoted(T.DASHES + T.SPACES)}, {quoted('-' * len(T.DASHES) + ' ' * len(T.SPACES))})"
    return rf"lower(trim(regexp_replace({bare}, '\s+', ' ', 'g')))"


def sql_distinguisher(x: str) -> str:
    return rf"regexp_extract({x}, '(?s).*( \([a-z0-9 \-()]+\))', 1)"


def sql_bare(x: str) -> str:
    return f"trim(rtrim(regexp_replace(regexp_replace({x}, '^- ', ''), ' -$', ''), '_'))"


def sql_segments(x: str) -> str:
    bare = r"trim(CASE WHEN ends_with(p, ')') THEN regexp_replace(p, '\([^(]*$', '') ELSE p END)"
    return f"list_concat([{x}], list_filter(list_transform(string_split({x}, ' - '), lambda p: {bare}), lambda p: p <> ''))"


def sql_first_title(x: str) -> str:
    return f"CASE WHEN strpos({x}, ' | ') > 0 THEN left({x}, strpos({x}, ' | ') - 1) ELSE {x} END"


def sql_capitalised(x: str) -> str:
    return f"upper(left({x}, 1)) || substr({x}, 2)"


# Normalising texts and titles.


@query(f"SELECT doc_id, {sql_deaccent('text')} AS deaccented FROM documents")
def deaccent_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.deaccent(F.col("text")).alias("deaccented"))


@query(f"SELECT doc_id, {sql_simplify('text')} AS simplified FROM documents")
def simplify_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.simplify(F.col("text")).alias("simplified"))


@query(f"SELECT doc_id, {sql_simplify_full('text')} AS simplified FROM documents")
def simplify_full_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.simplify_full(F.col("text")).alias("simplified"))


FILE = "p_brand || ' - ' || p_name || ' (' || lower(p_type) || ') - ' || CAST(1900 + p_size AS VARCHAR) || '.Mp3'"


def part_file() -> Column:
    """A file name made of a part: brand, name, type in brackets, and a year."""
    return F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" ("), F.lower("p_type"), F.lit(") - "), (1900 + F.col("p_size")).cast("string"), F.lit(".Mp3"))


@query(f"SELECT p_partkey, {sql_distinguisher(FILE)} AS remark, CASE WHEN {sql_distinguisher(FILE)} = {sql_distinguisher(sql_deaccent('p_name'))} THEN '' ELSE {sql_distinguisher(FILE)} END AS file_remark FROM part")
def distinguishers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", T.distinguisher(part_file()).alias("remark"), T.file_distinguisher(part_file(), F.col("p_name"), F.lit("none")).alias("file_remark"))


DECORATED = "CASE p_partkey % 4 WHEN 0 THEN '- ' || p_name WHEN 1 THEN p_name || ' -' WHEN 2 THEN '- ' || p_name || '__ -' ELSE p_name || '_' END"


def decorated_part() -> Column:
    name = F.col("p_name")
    k = F.col("p_partkey") % 4
    return F.when(k == 0, F.concat(F.lit("- "), name)).when(k == 1, F.concat(name, F.lit(" -"))).when(k == 2, F.concat(F.lit("- "), name, F.lit("__ -"))).otherwise(F.concat(name, F.lit("_")))


@query(
    f"SELECT p_partkey, {sql_bare('t')} AS bare, {sql_simplify_full(sql_bare('t'))} AS plain, starts_with(t, '- ') AS from_start, ends_with(t, ' -') AS to_end, "
    f"CASE WHEN ends_with(CASE WHEN starts_with(t, '- ') THEN t ELSE '- ' || t END, ' -') THEN CASE WHEN starts_with(t, '- ') THEN t ELSE '- ' || t END ELSE CASE WHEN starts_with(t, '- ') THEN t ELSE '- ' || t END || ' -' END AS both_marks, rtrim(t, '_') AS unvaried "
    f"FROM (SELECT p_partkey, {DECORATED} AS t FROM part)"
)
def bare_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    rows = read(spark, sf_dir, "part").select("p_partkey", decorated_part().alias("t"))
    return rows.select("p_partkey", T.bare_title(t).alias("bare"), T.simplify_full(T.bare_title(t)).alias("plain"), T.starts_segment(t).alias("from_start"), T.ends_segment(t).alias("to_end"), T.decorated(t).alias("both_marks"), T.without_variant(t).alias("unvaried"))


@query("SELECT doc_id, CASE WHEN length(regexp_replace(lower(lang || source), '[^a-z]', '', 'g')) >= 3 THEN left(regexp_replace(lower(lang || source), '[^a-z]', '', 'g'), 3) ELSE 'und' END AS code, CASE WHEN length(lang) >= 3 THEN left(lang, 3) ELSE 'und' END AS short_code FROM documents")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.language_code(F.concat("lang", "source")).alias("code"), T.language_code(F.col("lang")).alias("short_code"))


# Containment of passages in documents.


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", T.simplify(F.col("text")).alias("passage"))


def simple_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.simplify(F.col("text")).alias("simple"))


def passage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.containment(simple_docs(spark, sf_dir), passages(spark, sf_dir), "simple", "passage")


PAIRS = f"""WITH d AS (SELECT doc_id, {sql_simplify('text')} AS simple FROM documents), b AS (SELECT item_id, {sql_simplify('text')} AS passage FROM benchmark),
pairs AS (SELECT d.doc_id, b.item_id, b.passage FROM d JOIN b ON contains(d.simple, b.passage))"""
ASSIGNED = f"""{PAIRS}, assigned AS (SELECT doc_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(passage) DESC, item_id) AS k FROM pairs) WHERE k = 1)"""


@query(f"{PAIRS} SELECT doc_id, item_id FROM pairs")
def contain_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_pairs(spark, sf_dir).select("doc_id", "item_id")


@query(f"{ASSIGNED} SELECT doc_id, item_id FROM assigned")
def greedy_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.first_owner(passage_pairs(spark, sf_dir), ["doc_id"], [-F.length("passage"), F.col("item_id")], ["item_id"])


@query(f"{PAIRS} SELECT doc_id FROM d WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = d.doc_id)")
def unmatched_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unmatched(read(spark, sf_dir, "documents").select("doc_id"), passage_pairs(spark, sf_dir), "doc_id")


@query(f"{PAIRS} SELECT doc_id FROM d WHERE EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = d.doc_id)")
def matched_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id").join(passage_pairs(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_semi")


@query(f"{PAIRS} SELECT doc_id FROM d WHERE doc_id > 100 AND EXISTS (SELECT 1 FROM pairs WHERE pairs.doc_id = d.doc_id) ORDER BY doc_id LIMIT 1")
def next_matched_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.next_match(read(spark, sf_dir, "documents").select("doc_id"), passage_pairs(spark, sf_dir), 100, "doc_id", "doc_id")


@query(f"""{ASSIGNED} SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM assigned) AS unmatched, CAST(0 AS BIGINT) AS fuzzy, (SELECT count(DISTINCT item_id) FROM assigned) AS matched,
(SELECT count(*) FROM b) AS total, CAST(100 * (SELECT count(DISTINCT item_id) FROM assigned) // (SELECT count(*) FROM b) AS BIGINT) AS percent""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = greedy_assign(spark, sf_dir)
    return rollup.coverage(passages(spark, sf_dir), read(spark, sf_dir, "documents"), assigned, assigned.limit(0), "item_id", "doc_id")


# Titles of parts.


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and their words."""
    names = read(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    return names.select(F.explode(F.concat(F.array("name"), F.split("name", " "))).alias("title")).where("title <> ''").distinct()


TITLES = "titles AS (SELECT DISTINCT title FROM (SELECT lower(p_name) AS title FROM part UNION ALL SELECT unnest(string_split(lower(p_name), ' ')) FROM part) WHERE title <> '')"


@query(f"WITH {TITLES} SELECT p_partkey, title FROM (SELECT p_partkey, title, row_number() OVER (PARTITION BY p_partkey ORDER BY length(title) DESC, title) AS k FROM part JOIN titles ON contains(lower(p_name), title)) WHERE k = 1")
def greedy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    pairs = match.containment(parts, part_titles(spark, sf_dir), "name", "title")
    return match.first_owner(pairs, ["p_partkey"], [-F.length("title")], ["title"])


@query("WITH n AS (SELECT DISTINCT p_name AS x FROM part) SELECT a.x AS name, b.x AS title, CAST(levenshtein(a.x, b.x) AS INTEGER) AS distance FROM n a JOIN n b ON 5 * levenshtein(a.x, b.x) < length(b.x)")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "part").select(F.col("p_name").alias("x"))
    return match.fuzzy(names, names, "x", "x")


# RE2 has no \Q..\E with a backslash before letters only; regexp_escape does the same.
LITERAL = r"""regexp_matches(n.f, (CASE WHEN s THEN '(?:^|- )' ELSE '' END) || regexp_escape(bare) || (CASE WHEN e THEN '(?:$| -| \(| [\pN.\-]*\pN[\pN.\-]*(?: |$))' ELSE '' END))"""
TIERS = f"""WITH {TITLES}, plans AS (SELECT title, {sql_simplify_full(sql_bare('title'))} AS bare, starts_with(title, '- ') AS s, ends_with(title, ' -') AS e FROM (
  SELECT title FROM titles UNION SELECT '- ' || title FROM titles UNION SELECT title || ' -' FROM titles) WHERE {sql_simplify_full(sql_bare('title'))} <> ''),
n AS (SELECT DISTINCT p_type || ' - ' || p_name AS name, {sql_simplify_full("p_type || ' - ' || p_name")} AS f FROM part),
literal AS (SELECT name, title FROM n JOIN plans ON contains(n.f, bare) AND {LITERAL})"""


def marked_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.array(F.col("title"), F.concat(F.lit("- "), "title"), F.concat("title", F.lit(" -")))
    return part_titles(spark, sf_dir).select(F.explode(marked).alias("title")).distinct()


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.concat_ws(" - ", "p_type", "p_name").alias("name")).distinct()


@query(f"{TIERS} SELECT name, title FROM literal")
def boundary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.tiered(part_names(spark, sf_dir), marked_titles(spark, sf_dir), allow_fuzzy=False).select("name", "title")


@query(f"""{TIERS}, near AS (SELECT name, title, bare, list_min(list_transform({sql_segments('n.f')}, lambda p: levenshtein(p, bare))) AS d FROM n JOIN plans ON 1 = 1),
tiers AS (SELECT name, title, NULL AS distance FROM literal UNION ALL
  SELECT name, title, CAST(d AS INTEGER) FROM near WHERE 5 * d < length(bare) AND NOT EXISTS (SELECT 1 FROM literal l WHERE l.name = near.name AND l.title = near.title))
SELECT name, title, CASE WHEN distance IS NULL THEN 'exact' ELSE 'fuzzy ~' || CAST(distance AS VARCHAR) END AS tier FROM tiers""")
def match_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = match.ranked(match.tiered(part_names(spark, sf_dir), marked_titles(spark, sf_dir)))
    return found.select("name", "title", T.tier_label(F.col("distance")).alias("tier"))


@query(f"""WITH n AS (SELECT DISTINCT p_brand || ' - ' || p_name AS f, p_brand FROM part), t AS (SELECT DISTINCT p_name AS title, p_brand FROM part)
SELECT n.f AS name, t.title, CAST(list_min(list_transform({sql_segments('n.f')}, lambda p: levenshtein(p, t.title))) AS INTEGER) AS distance FROM n JOIN t ON n.p_brand = t.p_brand AND 5 * list_min(list_transform({sql_segments('n.f')}, lambda p: levenshtein(p, t.title))) < length(t.title)""")
def segment_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_brand", "p_name").distinct()
    names = parts.select("p_brand", F.concat_ws(" - ", "p_brand", "p_name").alias("name")).distinct()
    segments = names.select("p_brand", "name", F.explode(T.segments(F.col("name"))).alias("part"))
    near = segments.join(match.fuzzy(segments, parts, "part", "p_name", ("p_brand",)).withColumnRenamed("name", "part"), ["p_brand", "part"])
    return near.groupBy("name", "title").agg(F.min("distance").alias("distance"))


@query(f"SELECT stem, p_partkey, t FROM (SELECT p_partkey, t, {sql_simplify_full(sql_bare('t'))} AS stem, row_number() OVER (PARTITION BY {sql_simplify_full(sql_bare('t'))} ORDER BY p_partkey, t) AS k FROM (SELECT p_partkey, {DECORATED} AS t FROM part)) WHERE k = 1")
def stem_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", decorated_part().alias("t"))
    return match.first_of(rows, T.simplify_full(T.bare_title(F.col("t"))), ["p_partkey"])


@query(f"WITH {TITLES} SELECT a.title AS longer, b.title AS shorter FROM titles a JOIN titles b ON contains(a.title, b.title) AND length(a.title) > length(b.title)")
def name_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.contains_another(part_titles(spark, sf_dir).select(F.col("title").alias("name")))


GLOB = "WITH t AS (SELECT DISTINCT p_name AS title FROM part), n AS (SELECT DISTINCT p_name || ' (' || p_type || ')' AS name FROM part UNION SELECT DISTINCT p_name FROM part)"


@query(f"{GLOB} SELECT name, title FROM n JOIN t ON contains(lower(name), lower(title)) UNION ALL SELECT name, title FROM n JOIN t ON contains(lower(name), lower(title) || ' (')")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    names = parts.select(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("name")).union(parts.select("p_name")).distinct()
    return match.globbed(names, parts.select(F.col("p_name").alias("title")).distinct())


# The catalogue's join: brands are orchestras, parts are tracks, other spellings of them are files.

ORCHESTRA = "Brand#11"


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1900 + F.col("p_size")).cast("string")
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("orchestra"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("vocal"), F.lit("tango").alias("genre"), year.alias("year"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_brand").alias("orchestra"), F.concat_ws(" - ", "p_brand", "p_type", "p_name", (1900 + F.col("p_size")).cast("string"), F.lit("tango.mp3")).alias("file")).distinct()


CATALOGUE = f"""WITH t AS (SELECT p_partkey AS id, p_name AS name, p_type AS vocal, 'tango' AS g, CAST(1900 + p_size AS VARCHAR) AS y, {sql_simplify('p_name')} AS n1, {sql_simplify('p_type')} AS v FROM part),
f AS (SELECT DISTINCT p_brand || ' - ' || p_type || ' - ' || p_name || ' - ' || CAST(1900 + p_size AS VARCHAR) || ' - tango.mp3' AS file FROM part),
c AS (SELECT file, replace({sql_simplify('file')}, {sql_simplify(quoted(ORCHESTRA))}, '') AS fn FROM f),
pairs AS (SELECT * FROM t JOIN c ON contains(fn, n1) AND contains(fn, v) AND contains(fn, y) AND NOT contains(n1, g))"""


@query(f"{CATALOGUE} SELECT file, id, name, vocal FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY length(name) DESC, length(vocal) DESC, id) AS k FROM pairs) WHERE k = 1")
def catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as one orchestra's catalogue; catalogue_match_all has a catalogue for each."""
    one = F.lit(ORCHESTRA).alias("orchestra")
    rows, names = tracks(spark, sf_dir), files(spark, sf_dir)
    own = lambda df: df.select(one, *(c for c in df.columns if c != "orchestra"))
    return match.catalogue_assigned(own(rows), own(names)).drop("orchestra")


CATALOGUES = f"""WITH t AS (SELECT p_brand AS orchestra, p_partkey AS id, p_name AS name, p_type AS vocal, 'tango' AS g, CAST(1900 + p_size AS VARCHAR) AS y, {sql_simplify('p_name')} AS n1, {sql_simplify('p_type')} AS v FROM part),
f AS (SELECT DISTINCT p_brand AS orchestra, p_brand || ' - ' || p_type || ' - ' || p_name || ' - ' || CAST(1900 + p_size AS VARCHAR) || ' - tango.mp3' AS file FROM part),
c AS (SELECT orchestra, file, replace({sql_simplify('file')}, {sql_simplify('orchestra')}, '') AS fn FROM f),
pairs AS (SELECT * FROM t JOIN c USING (orchestra) WHERE contains(fn, n1) AND contains(fn, v) AND contains(fn, y) AND NOT contains(n1, g))"""


@query(f"{CATALOGUES} SELECT orchestra, file, id, name, vocal FROM (SELECT *, row_number() OVER (PARTITION BY orchestra, file ORDER BY length(name) DESC, length(vocal) DESC, id) AS k FROM pairs) WHERE k = 1")
def catalogue_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.catalogue_assigned(tracks(spark, sf_dir), files(spark, sf_dir))


# Display, filters and templates.


@query("SELECT p_partkey, concat_ws(' - ', p_brand, p_type, p_name, CASE WHEN y = '' THEN '????' ELSE y END, CASE WHEN g = '' THEN '????' ELSE g END) AS shown, CASE WHEN length(CAST(p_size AS VARCHAR)) >= 2 THEN CAST(p_size AS VARCHAR) ELSE lpad(CAST(p_size AS VARCHAR), 2, ' ') END AS popularity FROM (SELECT *, CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(1900 + p_size AS VARCHAR) END AS y, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'tango' END AS g FROM part)")
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.when(F.col("p_size") % 3 == 0, "").otherwise((1900 + F.col("p_size")).cast("string"))
    g = F.when(F.col("p_size") % 5 == 0, "").otherwise("tango")
    return read(spark, sf_dir, "part").select("p_partkey", rollup.display_name(F.col("p_brand"), F.col("p_type"), F.col("p_name"), y, g).alias("shown"), rollup.popularity_shown(F.col("p_size")).alias("popularity"))


@query("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(CAST(s_suppkey AS VARCHAR)), '1') OR contains(lower(s_name), '1') OR contains(lower(n_name), '1')")
def any_column_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name")
    return rows.where(rollup.any_column_has(rows.columns, "1"))


@query("""SELECT p_partkey, replace(replace(replace(replace('%gnr%%yer% %tit% {%can%}', '%tit%', p_name || ' (b)'), '%can%', regexp_replace(p_type, '^[^ ]* ', '')), '%gnr%', lower(left(regexp_replace(p_type, 'Arr\\. en ', '', 'i'), 1))), '%yer%', left(CAST(1900 + p_size AS VARCHAR), 4)) AS title FROM part""")
def template_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1900 + F.col("p_size")).cast("string")
    out = T.substituted(F.lit("%gnr%%yer% %tit% {%can%}"), F.col("p_name"), F.col("p_type"), F.col("p_type"), year, F.col("p_brand"), F.lit(" (b)"))
    return read(spark, sf_dir, "part").select("p_partkey", out.alias("title"))


REMARK_SQL = f"CASE WHEN {sql_distinguisher(FILE)} IN ({sql_distinguisher(sql_deaccent('p_name'))}, {sql_distinguisher(sql_deaccent('p_type'))}) THEN '' ELSE {sql_distinguisher(FILE)} END"


@query(f"""SELECT p_partkey, translate({sql_deaccent(f"p_brand || ' - ' || p_type || ' - ' || p_name || {REMARK_SQL} || ' - ' || CAST(1900 + p_size AS VARCHAR) || ' - ' || {sql_capitalised("'vals'")} || '.mp3'")}, '/\\?"', '') AS target, translate({FILE}, '/\\?"|', '') AS copy FROM part""")
def rename_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1900 + F.col("p_size")).cast("string")
    target = T.rename_target(part_file(), F.col("p_name"), F.col("p_type"), F.lit("vals"), year, F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", target.alias("target"), T.copy_name(part_file()).alias("copy"))


@query(f"SELECT p_partkey, {FILE} AS file, 'mp3' AS format, CAST(CASE WHEN 1770 + p_size > 1800 THEN 1770 + p_size END AS INTEGER) AS year FROM part")
def file_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", part_file().alias("file"), T.file_format(part_file()).alias("format"), numbers.year((1770 + F.col("p_size")).cast("string")).alias("year"))


# Rollups and status.

ORDERED_LINES = "(SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS s, CAST(l_quantity AS INTEGER) * 7 AS e FROM lineitem)"


@query(f"SELECT l_orderkey, string_agg(CASE WHEN s % 5 <> 0 THEN CAST(s // 60 AS VARCHAR) || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END, chr(10) ORDER BY l_linenumber, s) AS durations FROM {ORDERED_LINES} GROUP BY l_orderkey HAVING count(CASE WHEN s % 5 <> 0 THEN 1 END) > 0")
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_quantity").cast("int")
    value = F.when(s % 5 != 0, numbers.duration(s))
    rows = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rollup.lines(value, F.col("l_linenumber"), s).alias("durations"))
    return rows.where("durations <> ''")


@query(f"SELECT l_orderkey, CAST(max(abs((e % 3600) - 120)) AS INTEGER) AS deviation FROM {ORDERED_LINES} GROUP BY l_orderkey")
def duration_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(rollup.largest_deviation(F.lit("2:00"), numbers.duration(F.col("l_quantity").cast("int") * 7)).alias("deviation"))


@query(
    f"""WITH l AS (SELECT l_partkey, max(abs(CAST(l_quantity AS INTEGER) - 30)) AS dev FROM lineitem GROUP BY l_partkey),
p AS (SELECT p_partkey, p_size, p_type, 'b - ' || p_name || ' - tango.mp3' AS file, 'b - ' || p_name || ' - ' || CASE WHEN p_size % 2 = 0 THEN 'tango' ELSE 'vals' END AS shown, dev FROM part JOIN l ON l_partkey = p_partkey)
SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN '' ELSE 'NOGENREINFILENAME ' END) || (CASE WHEN dev >= 10 THEN 'TIMEDIFF=' || CAST(dev AS VARCHAR) || ' ' ELSE '' END) || (CASE WHEN p_size % 2 = 0 AND {sql_simplify("regexp_replace(regexp_replace(file, '[.][^.]*$', ''), ' [(][a-z0-9 -]+[)]', '', 'g')")} <> {sql_simplify("regexp_replace(shown, ' [(][a-z0-9 -]+[)]', '', 'g')")} THEN 'REALLYNEEDSRENAME ' ELSE '' END) || (CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'NEEDSTAGWRITE ' ELSE '' END) AS status FROM p"""
)
def status_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    genre = F.when(F.col("p_size") % 2 == 0, "tango").otherwise("vals")
    times = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(rollup.largest_deviation(F.lit("0:30"), numbers.duration(F.col("l_quantity").cast("int"))).alias("d"))
    rows = read(spark, sf_dir, "part").join(times, "p_partkey")
    none = F.array().cast("array<string>")
    flags = rollup.status(
        F.concat(F.lit("b - "), "p_name", F.lit(" - "), genre), genre, F.col("d"),
        F.array(F.concat(F.lit("b - "), "p_name", F.lit(" - tango.mp3"))), none, F.lit("Writer"), F.when(F.col("p_size") % 3 == 0, "Another").otherwise("Writer One"),
    )
    return rows.select("p_partkey", flags.alias("status"))


@query("SELECT p_brand, greatest(max(p_size), 0) AS popularity FROM part GROUP BY p_brand")
def popularity_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(rollup.most_popular(F.col("p_size")).alias("popularity"))


BODY = "replace(replace(replace(role || chr(10) || chr(10) || regexp_replace(text, '^\\s+|\\s+$', '', 'g') || chr(10) || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(13) || chr(10))"


@query(f"SELECT conv_id, string_agg({BODY}, '' ORDER BY turn) AS lyrics, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS preview FROM conversations GROUP BY conv_id")
def dialog_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.array_join(rollup.in_order(T.lyrics_body(F.col("role"), F.col("text")), F.col("turn")), "").alias("lyrics"), rollup.lines(F.concat(F.lit("["), "role", F.lit("] "), "text"), F.col("turn")).alias("preview"))


@query("SELECT conv_id, coalesce(arg_min(text, CASE WHEN role = 'assistant' THEN turn END), arg_min(text, turn), '') AS primary_text FROM conversations GROUP BY conv_id")
def primary_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(rollup.primary_name(rollup.in_language(F.col("role"), "assistant"), F.col("text"), F.col("turn")).alias("primary_text"))


@query("SELECT conv_id, turn, replace(replace(text, chr(10) || chr(10), '</p><p>'), chr(10), '<br/>') AS body FROM conversations")
def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", T.paragraphs(F.col("text")).alias("body"))


OUTCOME = "SELECT doc_id, CASE WHEN quality IS NOT DISTINCT FROM doc_id % 2 THEN 'unchanged' WHEN quality IS NOT NULL AND NOT (doc_id % 7 = 0) THEN 'skipped' ELSE 'written' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", rollup.upsert(F.col("quality"), (F.col("doc_id") % 2).cast("int"), F.col("doc_id") % 7 == 0).alias("outcome"))


@query(OUTCOME)
def upsert_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir)


@query(f"WITH o AS ({OUTCOME}) SELECT count(*) FILTER (outcome = 'written') AS written, count(*) FILTER (outcome = 'skipped') AS skipped, count(*) FILTER (outcome = 'unchanged') AS unchanged, CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS first_failure FROM o")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.write_report(outcomes(spark, sf_dir).withColumn("message", F.lit(None).cast("string")), order="doc_id")


@query("SELECT p_partkey, unnest(['title', 'artist', 'album_artist', 'genre', 'year', 'composer', 'date']) AS field, unnest([p_name || ' (b)', p_brand || ' - ' || p_type, p_brand, 'Vals', CAST(1900 + p_size AS VARCHAR), 'Writer', CAST(1900 + p_size AS VARCHAR)]) AS value FROM part")
def tag_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = (1900 + F.col("p_size")).cast("string")
    rows = read(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("name"), F.lit(" (b)").alias("remark"), F.col("p_brand").alias("orchestra"), F.col("p_type").alias("vocal"), F.lit("vals").alias("genre"), year.alias("year"),
        F.lit("Writer").alias("composer"), F.lit("").alias("author"), F.lit("").alias("label"), F.lit("").alias("old_album"),
    )
    return rollup.tag_fields(rows, "p_partkey")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", rollup.iso_date(F.col("o_orderdate")).alias("day"))


def sql_digits(x: str) -> str:
    return f"lpad(CAST(length(ltrim({x}, '0')) AS VARCHAR), 4, '0') || ltrim({x}, '0')"


@query(f"SELECT p_partkey, 'track ' || {sql_digits('CAST(p_partkey % 10 AS VARCHAR)')} || ' no ' || {sql_digits('CAST(p_partkey AS VARCHAR)')} AS key FROM part")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("Track "), (F.col("p_partkey") % 10).cast("string"), F.lit(" no "), F.col("p_partkey").cast("string"))
    return read(spark, sf_dir, "part").select("p_partkey", T.natural_key(name).alias("key")).orderBy("key")


# Events in order.

CODE = "CASE WHEN event_type = 'view' THEN 'T' WHEN event_type = 'click' THEN 'V' WHEN event_type = 'purchase' THEN 'M' ELSE '' END"


def event_code() -> Column:
    genre = F.when(F.col("event_type") == "view", "Tango").when(F.col("event_type") == "click", "vals").when(F.col("event_type") == "purchase", "Milonga").otherwise("break")
    return T.short_genre(genre)


@query(f"""WITH e AS (SELECT user_id, event_id, ts, {CODE} AS code, coalesce(lag({CODE}) OVER (PARTITION BY user_id ORDER BY ts, event_id), '') AS before FROM events),
k AS (SELECT user_id, event_id, code, row_number() OVER w AS n, list(code) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS codes FROM e WHERE code <> '' OR before <> '' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT *, CASE WHEN n < 30 THEN list_concat([''], codes) ELSE codes END AS history FROM k),
s AS (SELECT *, list_transform(list_filter(range(1, len(history) + 1), lambda i: history[i] = ''), lambda i: coalesce(history[i + 1], '')) AS starts FROM h)
SELECT user_id, event_id, array_to_string(starts[greatest(len(starts) - 5, 1) : len(starts)], '') AS sessions FROM s WHERE code <> ''""")
def genre_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.histories(read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], event_code())
    return rows.where("code <> ''").select("user_id", "event_id", sessions.shown(F.col("history")).alias("sessions"))


@query("SELECT event_id, user_id, text FROM (SELECT event_id, user_id, event_type || ' - x | ' || event_type AS text, lag(event_type || ' - x | ' || event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM text AND contains(text, '|')")
def dedupe_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("text", F.concat("event_type", F.lit(" - x | "), "event_type"))
    return sessions.valid(sessions.without_repeats(rows, "user_id", ["ts", "event_id"])).select("event_id", "user_id", "text")


#: Taps a 60 days for gaps in microseconds, as the events lie hours apart.
TAPS = 216000000000.0 * 24


@query(f"""WITH RECURSIVE t AS (SELECT user_id, epoch_us(ts) AS moment, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, CAST(1 AS BIGINT) AS k, CAST(1 AS BIGINT) AS n, moment AS last, CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS bpm, CAST(0 AS BIGINT) AS resets FROM t WHERE k = 1
UNION ALL SELECT user_id, k, CASE WHEN n = 0 THEN 1 WHEN off THEN 0 ELSE n + 1 END, CASE WHEN n > 0 AND off THEN 0 ELSE moment END, CASE WHEN n = 0 OR off THEN 0 ELSE total + b END, CASE WHEN n = 0 OR off THEN 0 ELSE b END, CASE WHEN n > 0 AND off THEN resets + 1 ELSE resets END
FROM (SELECT *, greatest(b, (total + b) / n) > 2 * least(b, (total + b) / n) AS off FROM (SELECT t.user_id, t.k, f.n, t.moment, f.total, f.resets, CASE WHEN t.moment = f.last THEN 220.0 ELSE least(220.0, CAST({TAPS} AS DOUBLE) / (t.moment - f.last)) END AS b FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)))
SELECT user_id, n AS taps, total AS total_bpm, bpm AS last_bpm, resets FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1""")
def tap_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return tempo.tempo(events, "user_id", F.unix_micros(F.col("ts").cast("timestamp")), ["ts", "event_id"], TAPS)


@query("SELECT user_id, max(mi) AS fastest FROM (SELECT user_id, least(220.0, 60000.0 / (1 + event_id % 997)) AS mi FROM events) GROUP BY user_id")
def instant_tempo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.max(numbers.instant_bpm((1 + F.col("event_id") % 997).cast("double"))).alias("fastest"))


# Differences of words.


@query()
def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the next one's of its type."""
    w = Window.partitionBy("p_type", "p_brand").orderBy("p_partkey")
    rows = read(spark, sf_dir, "part").withColumn("after", F.lead("p_name").over(w)).where("after is not null")
    return rows.select("p_partkey", diff.word_diff(F.col("p_name"), F.col("after")).alias("marked"))


@query(
    """WITH p AS (SELECT p_partkey, list_transform(string_split(p_name, ''), lambda c: ascii(c)) AS a, list_transform(string_split(p_type, ''), lambda c: ascii(c)) AS b FROM part)
SELECT p_partkey, CAST(list_reduce(
  list_prepend(list_transform(range(0, len(b) + 1), lambda j: CAST(0 AS INTEGER)), list_transform(a, lambda x: [x])),
  lambda above, x: list_prepend(CAST(0 AS INTEGER), list_transform(range(1, len(b) + 1), lambda j: list_max(
    list_transform(range(1, j + 1), lambda k: CASE WHEN b[k] = x[1] THEN greatest(above[k + 1], above[k] + 1) ELSE above[k + 1] END))))
)[len(b) + 1] AS INTEGER) AS shared FROM p"""
)
def lcs_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters each part's name has in common, in order, with its type's."""
    return read(spark, sf_dir, "part").select("p_partkey", diff.lcs_length(F.split("p_name", ""), F.split("p_type", "")).alias("shared"))


from . import files as _files  # noqa: E402, F401  (these register their queries here)
from . import jobs, more, ordered  # noqa: E402, F401
