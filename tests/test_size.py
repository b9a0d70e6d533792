"""What must not grow faster than the tables: files that are opened, and sorts that work out what they compare."""

import glob

from pyspark.sql import functions as F

from cotejo.operators import match, order
from cotejo.plans import files, more, ordered
from cotejo.sources import index


def test_catalogues_go_many_to_a_file(spark, small, monkeypatch, tmp_path):
    made = str(tmp_path / "catalogues")
    monkeypatch.setattr(files, "scratch", lambda _: made)
    found = files.catalogue_files(spark, small)
    parts = spark.read.parquet(f"{small}/part.parquet").count()
    assert found.count() == parts
    assert len(glob.glob(f"{made}/*.txt")) <= parts // files.TRACKS + 1


def test_orders_are_columns(spark, small, monkeypatch):
    """A sort works out an expression again for every comparison."""
    given = []
    real = order.ranged
    monkeypatch.setattr(order, "ranged", lambda rows, *keys: given.append((rows, keys)) or real(rows, *keys))
    for query in (ordered.natural_places, ordered.locale_places):
        query(spark, small)
        rows, keys = given.pop()
        # A column of the rows is shown by its name alone.
        assert {str(k) for k in keys} <= {f"Column<'{c}'>" for c in rows.columns}


def test_next_matches_goes_through_ranges_and_matches_once(spark):
    """A frame that ends with its range is gone through again for every row, and ranges are sampled by working out their rows."""
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b

    rows = spark.range(3000)
    found = order.next_matches(rows, rows.where("id % 7 = 0").mapInArrow(seen, "id long"), "id", "id")
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.id: r.next for r in found.collect()} == {i: None if i >= 2996 else i // 7 * 7 + 7 for i in range(3000)}
    assert worked.value == 429


def test_names_are_normalised_once_each(spark, monkeypatch):
    """A test of a normal form is moved below what makes names distinct, to all files and documents there are."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def lowered(x):
        worked.add(1)
        return x.lower()

    monkeypatch.setattr(match.T, "simplify_full", lowered)
    k = F.col("id").cast("string")
    names = spark.range(600).select(F.concat(F.lit("Canaro - Poema "), F.right(k, F.lit(1))).alias("name"))
    titles = spark.range(600).select(F.concat(F.lit("- Poema "), F.right(k, F.lit(1))).alias("title")).distinct()
    assert match.tiered(names, titles, allow_fuzzy=False).count() == 10
    assert worked.value == 20


def test_index_keys_a_name_once(spark, monkeypatch):
    """Keys are those of different names, however many files have each; files that share a name go in parts."""
    names = [f"el tango {x} de mala junta.mp3" for x in ("negro", "viejo", "del sur")]
    titles = spark.createDataFrame([("tango viejo",), ("a junta",), ("ju",), ("nothing",)], "title string")
    made = {}
    for copies, at_most in ((1, 200), (90, 200), (90, 20)):
        monkeypatch.setattr(index, "PATHS", at_most)
        files = [(i, 0, n) for i, n in enumerate(names * copies)]
        index.built(spark, "library_three", spark.createDataFrame(files, "path long, modified long, name string"))
        kept = index.table(spark, "library_three", "keys")
        made[copies, at_most] = kept.count()
        assert kept.agg(F.max(F.size("paths"))).first()[0] <= 2 * at_most
        found = sorted(map(tuple, index.matches(spark, "library_three", titles).collect()))
        assert found == sorted((t, i) for i, _, n in files for t in ("tango viejo", "a junta", "ju") if t in n)
        index.dropped(spark, "library_three", index.version(spark, "library_three"))
    assert made[1, 200] == made[90, 200] < made[90, 20] <= 5 * made[1, 200]


def test_index_goes_through_a_listing_once(spark):
    """A refresh asks for the listing once, however often it needs it."""
    worked = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            worked.add(b.num_rows)
            yield b

    files = spark.range(100).select(F.col("id").alias("path"), F.lit(0).cast("long").alias("modified"), F.lit("mala junta.mp3").alias("name"))
    index.built(spark, "library_four", files)
    listing = files.select("path", (F.col("path") % 3).alias("modified")).mapInArrow(seen, "path long, modified long")
    index.refreshed(spark, "library_four", listing, lambda rows: rows.join(files.select("path", "name"), "path"))
    assert worked.value == 100
    assert index.table(spark, "library_four", "files").where("modified = path % 3").count() == 100
    index.dropped(spark, "library_four", 2)


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_grows_with_titles_is_not_broadcast(spark, monkeypatch):
    """Sizes that Spark goes by are those of files, a hundredth of what keys unfold to."""
    monkeypatch.setattr(match, "FEW", 0)
    names = spark.createDataFrame([("A", "el tango malena fiorentino", "x")], "o string, n string, more string")
    titles = spark.createDataFrame([("A", "tango malena fiorentino", 1)], "o string, t string, id int")
    for most, broadcasts in ((match.KEYS, True), (0, False)):
        monkeypatch.setattr(match, "KEYS", most)
        given = []
        monkeypatch.setattr(match, "stored", lambda df, given=given: given.append(joins(df)) or df)
        for within in ((), ("o",)):
            found = match.containment(names if within else names.drop("o"), titles, "n", "t", within)
            assert found.count() == 1
            assert broadcasts or "Broadcast" not in joins(found)
        assert any("Broadcast" in x for x in given) == broadcasts


def test_exact_files_of_a_catalogue_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(match, "FEW", 0)
    monkeypatch.setattr(match, "KEYS", 0)
    tracks = spark.createDataFrame([("Troilo", 1, "Toda mi vida", "Fiorentino", "tango", "1942")], "orchestra string, id long, name string, vocal string, genre string, year string")
    files = spark.createDataFrame([("Troilo", "x toda mi vida fiorentino 1942.mp3")], "orchestra string, file string")
    found = match.catalogue_assigned(tracks, files)
    assert "Broadcast" not in joins(found)
    assert found.first().id == 1


def test_exact_files_do_not_wait_for_near_ones(spark, small, monkeypatch):
    monkeypatch.setattr(match, "fuzzy", None)
    assert more.catalogue_exact(spark, small).count() > 0


def test_near_files_are_not_broadcast(spark):
    tracks = spark.createDataFrame([("A", 1, "Nostalgias", "Charlo")], "orchestra string, id long, name string, vocal string")
    files = spark.createDataFrame([("A", "f1", "Nostalgia Charlo")], "orchestra string, file string, title string")
    assert "Broadcast" not in joins(match.fuzzy(files, tracks, "title", "name", ("orchestra",)))
    found = match.catalogue_fuzzy(tracks, files)
    assert "Broadcast" not in joins(found)
    assert [tuple(r) for r in found.collect()] == [("A", 1, "f1", 1)]


def test_what_exact_files_leave_is_not_broadcast(spark, small, monkeypatch):
    """Tracks and files that are left go without those that have a match, which are as many as the library's files."""
    given, real = [], match.catalogue_fuzzy
    monkeypatch.setattr(match, "catalogue_fuzzy", lambda tracks, files: given.extend((joins(tracks), joins(files))) or real(tracks, files))
    assert more.catalogue_coverage(spark, small).count() == 1
    assert len(given) == 2 and not any("Broadcast" in x for x in given)
