"""Normalising and composing names."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from cotejo.functions import numbers
from cotejo.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "function, given, wanted",
    [
        (T.simplify_full, "Muñeca brava", "muneca brava"),
        (T.simplify_full, "Di_Sarli___Bahia_Blanca", "di sarli bahia blanca"),
        (T.simplify_full, "Nena (a)", "nena (a)"),
        (T.simplify_full, "Aroma+de+amor – 1", "aroma de amor - 1"),
        (T.simplify_full, "   ", ""),
        (T.simplify_full, "¿Qué… «ế»?", "que… e"),
        (T.simplify, "Nena (a)", "nena a"),
        (T.simplify, "A .  b", "a  b"),
        (T.simplify, "di_sarli+x; y:", "di_sarli+x; y:"),
        (T.deaccent, "¡ế ª ﬁ!", "ê ª f"),
        (T.distinguisher, "El once (a) x (b c).mp3", " (b c)"),
        (T.distinguisher, "El once (A)", ""),
        (T.bare_title, "Uno__ -", "Uno"),
        (T.bare_title, "- Nada", "Nada"),
        (T.bare_title, "- - x", "- x"),
        (T.second_title, "A | B", "B"),
        (T.second_title, "A", ""),
        (T.first_title, "A | B", "A"),
        (T.language_code, "en", "und"),
        (T.language_code, "pt-BR", "ptb"),
        (T.language_code, " ", "spa"),
        (T.crlf, "a\r\nb\rc\nd", "a\r\nb\r\nc\r\nd"),
        (T.extension, "a.b.Mp3", ".Mp3"),
        (T.extension, "none", "none"),
        (T.stem, "a.b.mp3", "a.b"),
        (T.file_format, "x.M4B", "mp4"),
        (T.file_format, "x.txt", None),
        (T.short_genre, "Tangon", "M"),
        (T.short_genre, "un Tango", "T"),
        (T.short_genre, "Foxtrot", ""),
        (T.genre_initial, "Arr. en Vals", "v"),
        (T.capitalised, "vals cruzado", "Vals cruzado"),
        (T.after_first_word, "Juan de Dios", "de Dios"),
        (T.after_first_word, "Solo", "Solo"),
        (T.paragraphs, "a\nb\n\nc", "a<br/>b</p><p>c"),
        (T.copy_name, 'a/b\\c?d"e|f', "abcdef"),
        (T.message_artist, "A - b | Tango", "A"),
        (T.message_genre, "A - b | Tango", "Tango"),
        (numbers.seconds, "3:05", 185),
        (numbers.seconds, "x", None),
        (numbers.year, "1955-06", 1955),
        (numbers.year, "?", None),
        (numbers.year, "1799", None),
    ],
)
def test_function(spark, function, given, wanted):
    assert value(spark, function(F.lit(given))) == wanted


def test_lyrics_body(spark):
    assert value(spark, T.lyrics_body(F.lit("Poema"), F.lit("\n  line one\nline two  \n"))) == "Poema\r\n\r\nline one\r\nline two\r\n\r\n"


def test_template_fields_are_filled_in_order(spark):
    out = T.substituted(F.lit("%gnr%%yer% %tit% {%can%} %orq% %date%"), F.lit("A | B"), F.lit("Jorge Ortiz"), F.lit("Arr. en Vals"), F.lit("1941-02"), F.lit("Rodolfo Biagi"), F.lit(" (x)"))
    assert value(spark, out) == "v1941 A (x) {Ortiz} Biagi 1941-02"
    inserted = T.substituted(F.lit("%title%"), F.lit("%date%"), F.lit(""), F.lit(""), F.lit("1900"), F.lit(""), F.lit(""))
    assert value(spark, inserted) == "1900"


def test_rename_target_takes_the_part_that_the_file_has(spark):
    args = [F.lit(x) for x in ("old b name (x).MP3", "Á a | b Name", "Sólo", "vals", "1941-02", "Orq")]
    assert value(spark, T.rename_target(args[0], F.lit("Zeta | b name"), *args[2:])) == "Orq - Solo - b name (x) - 1941 - Vals.mp3"


def test_all_level_folding_equals_unicode(spark):
    sources, targets = T.all_levels()
    assert all(unicodedata.normalize("NFD", s)[0] == t for s, t in zip(sources, targets))
    assert len(T.one_level()[0]) > 1000


def test_natural_key(spark):
    names = ["b10", "B9", "a", "b 2", "b010", "b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_key(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["a", "b", "b 2", "B9", "b010", "b10"]


@pytest.mark.parametrize("collation", [T.BY_LOCALE, T.UNACCENTED])
def test_natural_order_of_a_locale(spark, collation):
    names = ["Zeta", "Épica", "É 10", None, "nz", "e 9", "ñandú", "Arbola", "Árbol"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_order(F.col("n"), collation).asc_nulls_last(), "n").collect()
    assert [r.n for r in rows] == ["Árbol", "Arbola", "e 9", "É 10", "Épica", "ñandú", "nz", "Zeta", None]


def test_accents_before_case(spark):
    names = ["resumé", "Resume", "résumé", "resume"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(T.natural_order(F.col("n")), "n").collect()
    assert [r.n for r in rows] == ["Resume", "resume", "resumé", "résumé"]


def test_numbers(spark):
    assert value(spark, numbers.duration(F.lit(185))) == "3:05"
    assert value(spark, numbers.instant_bpm(F.lit(0.0))) == 220.0
    assert value(spark, numbers.instant_bpm(F.lit(500.0))) == 120.0
    assert value(spark, numbers.percent(F.lit(2), F.lit(3))) == 66
    assert value(spark, numbers.percent(F.lit(2), F.lit(0))) == 0
