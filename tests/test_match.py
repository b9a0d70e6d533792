"""Linking titles and files, against direct comparison of all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.operators import match, rollup

CASES = [
    ("- Nada", "Demare - Nada - Berón - 1944", False, False, "literal"),
    ("- Nada", "Canaro - Enamorada - 1936", False, False, None),
    ("Intima -", "Di Sarli - Intimamente - 1938", False, False, None),
    ("Poema -", "Canaro - Poema (instrumental) - 1935", False, False, "literal"),
    ("Poema -", "Poemas - Poema - 1935", False, False, "literal"),
    ("Nada", "Canaro - Nada mas - 1936", False, False, "literal"),
    ("Nada", "Canaro - Nada mas - 1936", True, False, None),
    ("Una carta -", "014 - Una carta", False, False, "literal"),
    ("Cielo", "Cielo+10093_RP", False, False, "literal"),
    ("Cielo", "Cielo+10093_RP", True, False, "literal"),
    ("Cielo", "Cielo+2do+premio", True, False, None),
    ("Nostalgias", "Charlo - Nostalgia - 1936", False, True, 1),
    ("Nostalgias", "Canaro - Milonga sentimental - 1933", False, True, None),
    ("Malena", "Troilo - Malena - Fiorentino", False, True, "literal"),
    ("", "anything", False, True, None),
]


@pytest.mark.parametrize("title, name, always, fuzzy, wanted", CASES)
def test_tiers(spark, title, name, always, fuzzy, wanted):
    names, titles = spark.createDataFrame([(name,)], "name string"), spark.createDataFrame([(title,)], "title string")
    found = match.tiered(names, titles, always, fuzzy).collect()
    assert [("literal" if r.distance is None else r.distance) for r in found] == ([] if wanted is None else [wanted])


@pytest.mark.parametrize("few", [0, 1000])
def test_containment_equals_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(match, "FEW", few)
    r = random.Random(3)
    make = lambda n: " ".join("".join(r.choice("abc") for _ in range(r.randint(1, 3))) for _ in range(n))
    names = [make(r.randint(1, 9)) for _ in range(60)] + ["", None, "x"]
    titles = [make(r.randint(1, 4)) for _ in range(60)] + ["", None, "x", "a"]
    found = match.containment(spark.createDataFrame([(n,) for n in names], "n string"), spark.createDataFrame([(t,) for t in titles], "t string"), "n", "t").collect()
    wanted = sorted((n, t) for n in names for t in titles if n is not None and t is not None and t in n)
    assert sorted((x.n, x.t) for x in found) == wanted


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_equals_all_pairs(spark):
    r = random.Random(5)
    titles = ["".join(r.choice("abcd ") for _ in range(r.randint(1, 24))) for _ in range(60)]
    names = list(titles[:20])
    for t in titles:
        n = list(t)
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(n) + 1)
            n[k : k + r.randint(0, 1)] = [r.choice("abcd ")] * r.randint(0, 1)
        names.append("".join(n))
    found = match.fuzzy(spark.createDataFrame([(n,) for n in [*names, None, ""]], "n string"), spark.createDataFrame([(t,) for t in [*titles, None, ""]], "t string"), "n", "t").collect()
    wanted = {(n, t, d) for n in [*names, ""] for t in titles if 5 * (d := distance(n, t)) < len(t)}
    assert {(x.name, x.title, x.distance) for x in found} == wanted and len(found) == len(wanted)
    halves = [spark.createDataFrame([(len(x) % 2, x) for x in some], "half int, n string") for some in (names, titles)]
    within = match.fuzzy(*halves, "n", "n", ("half",)).collect()
    assert sorted((x.name, x.title, x.distance) for x in within) == sorted((n, t, d) for n, t, d in wanted if n in names and len(n) % 2 == len(t) % 2)


def test_first_owner_equals_handing_out_in_order(spark):
    r = random.Random(7)
    pairs = [(f"f{f}", t, len(str(t))) for f in range(40) for t in range(30) if r.random() < 0.2]
    found = match.first_owner(spark.createDataFrame(pairs, "file string, track int, n int"), ["file"], [-F.col("n"), F.col("track")], ["track"]).collect()
    pool, owned = {f for f, _, _ in pairs}, {}
    for t in sorted({t for _, t, _ in pairs}, key=lambda t: (-len(str(t)), t)):
        for f in sorted(pool & {f for f, x, _ in pairs if x == t}):
            owned[f] = t
            pool.discard(f)
    assert {x.file: x.track for x in found} == owned


def test_catalogue_join_rules(spark):
    tracks = spark.createDataFrame(
        [(1, "Uno | Otro", "Roberto", "tango", "1941-02"), (2, "Tango bravo", "", "Tango", ""), (3, "Bahía", "Orq Uno", "vals", "1950"), (4, "Nada", "Roberto", "", "1941")],
        "id int, name string, vocal string, genre string, year string",
    )
    files = spark.createDataFrame([(f,) for f in ("Orq - Roberto - Otro - 1941.mp3", "Orq - Tango bravo.mp3", "Orq - Tango bravo - tango.mp3", "Orq Uno - Bahia - 1950 vals.mp3", "Roberto nada 1941.mp3", "Roberto nada 1942.mp3")], "file string")
    found = {(r.id, r.file) for r in match.catalogue_pairs(tracks, files, "Orq").collect()}
    assert found == {(1, "Orq - Roberto - Otro - 1941.mp3"), (2, "Orq - Tango bravo - tango.mp3"), (3, "Orq Uno - Bahia - 1950 vals.mp3"), (4, "Roberto nada 1941.mp3")}
    assert {(r.file, r.id) for r in match.catalogue_assigned(tracks, files, "Orq").collect()} == {(f, i) for i, f in found}


def test_catalogue_join_of_all_orchestras(spark):
    tracks = spark.createDataFrame(
        [("Orq", 1, "Uno", "Roberto", "", "1941"), ("Otra", 2, "Uno", "Roberto", "", "1941"), ("Otra", 3, "La otra noche", "Orq", "", "1950"), ("Otra", 4, "Ay", "", "", ""), (None, 5, "Uno", "", "", "")],
        "orchestra string, id int, name string, vocal string, genre string, year string",
    )
    rows = [("Orq", "Orq - Roberto - Uno - 1941"), ("Otra", "Otra - Roberto - Uno - 1941"), ("Otra", "Otra - Orq - La otra noche - 1950"), ("Otra", "La ay"), ("Orq", "La ay"), (None, "Uno")]
    files = spark.createDataFrame(rows, "orchestra string, file string")
    found = {(r.orchestra, r.id, r.file) for r in match.catalogue_assigned(tracks, files).collect()}
    alone = set()
    for o in ("Orq", "Otra"):
        mine = match.catalogue_assigned(tracks.where(F.col("orchestra") == o).drop("orchestra"), files.where(F.col("orchestra") == o).select("file"), o)
        alone |= {(o, r.id, r.file) for r in mine.collect()}
    assert found == alone and {("Orq", 1, rows[0][1]), ("Otra", 2, rows[1][1]), ("Otra", 4, "La ay")} <= found


def test_catalogue_fuzzy_takes_the_singer_out(spark):
    tracks = spark.createDataFrame([("A", 1, "Nostalgias (a)", "Charlo"), ("A", 2, "Malena", ""), ("B", 3, "Melenas", "")], "orchestra string, id int, name string, vocal string")
    files = spark.createDataFrame([("A", "f1", "Nostalgia Charlo (1936)"), ("A", "f2", "Melena"), ("A", "f3", "Milonga"), ("B", "f4", "Nostalgia Charlo")], "orchestra string, file string, title string")
    found = {tuple(r) for r in match.catalogue_fuzzy(tracks, files).collect()}
    assert found == {("A", 1, "f1", 1), ("A", 2, "f2", 1)}


def test_overlapping_occurrences(spark):
    count = lambda a, b: spark.range(1).select(match.occurrences(F.lit(a), F.lit(b)).alias("n")).first().n
    assert count("aaa", "aa") == 2
    assert count("tango", "vals") == 0
    assert count("ab", "") == 3


def test_status(spark):
    s = lambda *a: F.array(*map(F.lit, a)).cast("array<string>")
    out = rollup.status(F.lit("O - V - N - 1941 - tango"), F.lit("Tango"), F.lit(60), s("O - V - N (a) - 1941 - TANGO.mp3"), s("x.mp3"), F.lit("Comp"), F.lit("Other"))
    assert spark.range(1).select(out.alias("x")).first().x == "NOGENREINFILENAME TIMEDIFF=60 FUZZY NEEDSTAGWRITE "
    bare = rollup.status(F.lit("n"), F.lit("vals"), F.lit(None).cast("int"), s("a.mp3"), s(), F.lit("C"), F.lit(None).cast("string"))
    assert spark.range(1).select(bare.alias("x")).first().x == "NOGENREINFILENAME "


def test_report_line(spark):
    rows = spark.createDataFrame([(0, "written", None), (1, "failed", "late"), (2, "failed", "later"), (3, "unsupported", None)], "pos int, outcome string, message string")
    report = rollup.write_report(rows)
    assert report.first().first_failure == "late"
    assert report.select(rollup.report_line("Write all").alias("x")).first().x == "Write all: 1 written, 1 skipped (already tagged), 2 failed — late."


def test_counts(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1)], "name string, distance int")
    assert tuple(rollup.match_counts(rows).first()) == (2, 1)
    assert [r.name for r in rows.where(rollup.holds(F.col("name"), "B")).collect()] == ["b"]
    names = spark.createDataFrame([("Épica",), ("E\u0301PICA",), ("epica",), ("x",), (None,)], "name string")
    held = lambda *how: {r.name for r in names.where(rollup.any_column_has(["name"], *how)).collect()}
    assert held("épi") == {"Épica"}
    assert held("épi", "UNICODE_CI") == {"Épica", "E\u0301PICA"}
    assert held("épi", "UNICODE_CI_AI") == held("EPI", "UNICODE_CI_AI") == {"Épica", "E\u0301PICA", "epica"}
    docs = spark.createDataFrame([("x",), ("y",), ("z",)], "file string")
    lyrics = spark.createDataFrame([("x", ""), ("y", "eng"), ("z", "SPA")], "file string, language string")
    assert rollup.without_translation(docs, lyrics).first()["without"] == 1


def test_tracks_that_are_alike_are_matched_once(spark, monkeypatch):
    rows = [("Troilo", i, "Malena", "Fiorentino", "tango", "1942") for i in range(30, 5, -1)] + [("Troilo", 3, "Sur", "Rivero", "tango", "1948")]
    tracks = spark.createDataFrame(rows, "orchestra string, id long, name string, vocal string, genre string, year string")
    files = spark.createDataFrame([("Troilo", "x malena fiorentino 1942.mp3"), ("Troilo", "sur rivero 1948.mp3")], "orchestra string, file string")
    given, real = [], match.catalogue_pairs
    monkeypatch.setattr(match, "catalogue_pairs", lambda t, *a: given.append(t) or real(t, *a))
    found = match.catalogue_assigned(tracks, files).select("file", "id").collect()
    assert sorted(map(tuple, found)) == [("sur rivero 1948.mp3", 3), ("x malena fiorentino 1942.mp3", 6)]
    assert given[0].count() == 2


def test_near_titles_of_tracks_that_are_alike_are_matched_once(spark, monkeypatch):
    rows = [("Troilo", i, "Malena", "Fiorentino") for i in range(20)]
    tracks = spark.createDataFrame(rows, "orchestra string, id long, name string, vocal string")
    files = spark.createDataFrame([("Troilo", "a.mp3", "Molena"), ("Troilo", "b.mp3", "Fiorentino Melena"), ("Troilo", "c.mp3", "Sur")], "orchestra string, file string, title string")
    given, real = [], match.fuzzy
    monkeypatch.setattr(match, "fuzzy", lambda names, titles, *a: given.append(titles) or real(names, titles, *a))
    found = match.catalogue_fuzzy(tracks, files)
    wanted = {("Troilo", i, f) for i in range(20) for f in ("a.mp3",)}
    assert wanted <= {(r.orchestra, r.id, r.file) for r in found.collect()}
    assert given[0].count() == 1
