"""The kept index and the job that writes all, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.operators import jobs
from cotejo.sources import index


def listing(spark, rows):
    return spark.createDataFrame(rows, "path long, modified long, name string")


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(3)
    words = ["mala", "junta", "el", "día", "que", "me", "quieras", "tango", "negro", "y"]
    return [(i, i % 7, " ".join(r.choice(words) for _ in range(r.randint(1, 5))) + ".mp3") for i in range(200)]


TITLES = ["Mala junta", "dia que me", "y", "", "  ", "Quieras", "nothing of it", "el", "mala", "ang"]


def normal(x):
    return x.lower().replace("í", "i").strip()


def plain(rows, titles):
    return sorted({(t, i) for i, _, n in rows for t in titles if normal(t) and normal(t) in normal(n.removesuffix(".mp3"))})


def matched(spark, name):
    return sorted(map(tuple, index.matches(spark, name, spark.createDataFrame([(t,) for t in TITLES * 2], "title string")).collect()))


def test_index_is_refreshed_by_what_has_changed(spark, library):
    index.built(spark, "library_one", listing(spark, library))
    assert index.version(spark, "library_one") == 1 and matched(spark, "library_one") == plain(library, TITLES)
    # Some files go, some change, some are new; a file that is read but has not changed would be found out by its name.
    now = [(i, m + (i % 10 == 0), "mala y tango.mp3" if i % 10 == 0 else n) for i, m, n in library if i % 9] + [(900 + i, 1, "el tango que.mp3") for i in range(5)]
    asked = []

    def read(rows):
        asked.extend(r.path for r in rows.collect())
        return rows.join(listing(spark, now).select("path", "name"), "path")

    index.refreshed(spark, "library_one", listing(spark, now).select("path", "modified"), read)
    assert sorted(asked) == sorted(i for i, _, _ in now if i % 10 == 0 or i >= 900)
    assert index.version(spark, "library_one") == 2 and matched(spark, "library_one") == plain(now, TITLES)
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("library_one")] == [f"library_one_{k}_v2" for k in ("counts", "files", "keys")]
    index.refreshed(spark, "library_one", listing(spark, []).select("path", "modified"), read)
    assert matched(spark, "library_one") == []
    index.dropped(spark, "library_one", 3)


def test_index_is_read_where_it_is(spark, library):
    """The index's keys are not exchanged: titles are dealt as the table's buckets are."""
    index.built(spark, "library_two", listing(spark, library))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.matches(spark, "library_two", spark.createDataFrame([(t,) for t in TITLES], "title string"))
        lines = found._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(i for i, x in enumerate(lines) if "library_two_keys" in x and "Scan parquet" in x)
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for x in reversed(lines[:at]):
        own = len(x) - len(x.lstrip(" :+-"))
        if own < depth:
            above.append(x)
            depth = own
    assert not any("Exchange" in x for x in above) and "Bucketed: true" in lines[at]
    index.dropped(spark, "library_two", 1)


def test_outcomes_follow_the_documents_in_order(spark):
    r = random.Random(4)
    rows = [(d, p, r.choice("xyz"), {0: None, 1: "x", 2: "old"}[p % 3]) for p in range(40) for d in sorted(r.sample(range(9), r.randint(1, 5)))]
    table = spark.createDataFrame(rows, "doc long, path long, value string, old string")
    for overwrite in (False, True):
        has, wanted = {p: old for _, p, _, old in rows}, {}
        for d, p, value, _ in sorted(rows):
            if has[p] == value:
                wanted[d, p] = "unchanged"
            elif has[p] is not None and not overwrite:
                wanted[d, p] = "skipped"
            else:
                has[p], wanted[d, p] = value, "written"
        assert {(x.doc, x.path): x.outcome for x in jobs.outcomes(table, overwrite).collect()} == wanted


def test_the_whole_job(spark):
    documents = spark.createDataFrame([(1, "Malena_"), (2, "- Malena"), (3, "Sur -"), (4, "Nada"), (5, "Yuyo verde")], "doc long, title string")
    files = spark.createDataFrame([(10, "Troilo - Malena - 1942"), (11, "Demare - Malena (1951)"), (12, "Troilo - Sur"), (13, "Sur, de nuevo"), (14, "Berón - Yuio verde")], "path long, name string")
    translations = spark.createDataFrame([(1, 0, "SPA", "letra"), (1, 1, None, "otra"), (2, 0, "spa", "never"), (3, 0, "eng", "words"), (5, 0, " spa ", "verde")], "doc long, pos int, language string, text string")
    tags = spark.createDataFrame([(11, "letra\n\notra"), (14, "own")], "path long, old string")
    found = jobs.written(documents, files, translations, tags).first()
    assert (found.jobs, found.targets, found.without) == (3, 4, 1)
    assert found.line == "Lyrics: 1 written, 1 skipped (already tagged), 1 unchanged, 1 titles have no Spanish lyrics."
    assert jobs.written(documents, files, translations, tags, overwrite=True).first().written == 2
    assert jobs.written(documents, files, translations, tags, allow_fuzzy=False).first().targets == 3
    assert jobs.written(documents.where("doc = 3"), files, translations, tags).first().line == "Lyrics: nothing to write — 1 titles have no Spanish lyrics."
    assert jobs.written(documents.where("doc = 4"), files, translations, tags).first().line == "Lyrics: nothing to write."
    assert jobs.written(documents, files.withColumn("path", F.col("path").cast("string")), translations, tags.withColumn("path", F.col("path").cast("string")), part="1").first().targets == 4


def test_texts_do_not_go_to_every_file(spark, monkeypatch):
    """What is dealt by file are hashes; titles and names are matched once for both reports."""
    documents = spark.createDataFrame([(1, "Malena"), (2, "Sur")], "doc long, title string")
    files = spark.createDataFrame([(i, "Troilo - Malena") for i in range(20)] + [(99, "Sur")], "path long, name string")
    translations = spark.createDataFrame([(1, 0, "spa", "letra" * 1000)], "doc long, pos int, language string, text string")
    tags = spark.createDataFrame([(3, "letra" * 1000), (4, "own")], "path long, old string")
    seen, matched, real, tiered = [], [], jobs.outcomes, jobs.match.tiered
    monkeypatch.setattr(jobs, "outcomes", lambda rows, overwrite: seen.append(rows) or real(rows, overwrite))
    monkeypatch.setattr(jobs.match, "tiered", lambda *a: matched.append(a) or tiered(*a))
    found = jobs.written(documents, files, translations, tags).first()
    assert (found.jobs, found.targets, found.without, found.written, found.skipped, found.unchanged) == (2, 21, 1, 18, 1, 1)
    assert all(len(r.value) == 16 for rows in seen for r in rows.collect()) and len(matched) == 1


def test_targets_are_counted_by_name(spark):
    """However many files have a name, one row of it meets the documents."""
    documents = spark.createDataFrame([(1, "Malena"), (2, "Sur")], "doc long, title string")
    files = spark.createDataFrame([(i, "Troilo - Malena") for i in range(50)] + [(99, "Sur"), (100, "Nada")], "path long, name string")
    matches = jobs.named(documents, files)
    assert sorted((r.doc, r.name) for r in matches.collect()) == [(1, "Troilo - Malena"), (2, "Sur")]
    assert sorted(map(tuple, jobs.counted(matches, files).collect())) == [(1, 50), (2, 1)]
