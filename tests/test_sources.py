"""Readers, exports and differences, on files made here."""

import datetime
import random
import socket
import threading
import time
import tracemalloc
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from cotejo.functions import diff
from cotejo.sources import catalogue, library, messages, sinks

CATALOGUE = """<discography orchestra="Orq &amp; Co" source="made">
<track name="Uno | Otro" vocal="Ana" year="1956--1958" genre="Arr. en Vals" composer="C" author="A" label="L" duration="2:59" popularity="7"/>
<track name="¿Qué?" vocal="Instrumental" year="?" genre="tango" popularity="x"/>
<track name="Largo nombre" vocal="" year="" genre=""/></discography>"""


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.xml").write_text(CATALOGUE)
    (tmp_path / "bad.xml").write_text("<discography><track name='x'")
    rows = catalogue.tracks(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.name, r.orchestra, r.popularity, r.composer) for r in rows] == [(0, "Uno | Otro", "Orq & Co", 7, "C"), (1, "¿Qué?", "Orq & Co", 0, ""), (2, "Largo nombre", "Orq & Co", 0, "")]
    order = catalogue.tracks(spark, str(tmp_path)).orderBy(*catalogue.in_catalogue_order()).collect()
    assert [r.pos for r in order] == [2, 0, 1]


def test_translations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<lyrics><translation name="N" translator="T" author="A" year="1">one\n\ntwo</translation><translation lang="eng" name="M" author="A"><![CDATA[ <b> ]]></translation></lyrics>')
    rows = catalogue.translations(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.name, r.language, r.translator) for r in rows] == [("N", "", "T"), ("M", "eng", "A")]
    assert rows[0].contents == "one\n\ntwo" and rows[1].contents.strip() == "<b>"
    (tmp_path / "bad.xml").write_text("<lyrics><translation name=")
    assert catalogue.translations(spark, str(tmp_path), strict=False).count() == 2


def test_library(spark, tmp_path):
    for f in ("x/Di_Sarli - Uno.mp3", "x/y/b.FLAC", "z.m4a", "notes.txt", ".hidden/c.mp3"):
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes(b"1")
    index = library.indexed(spark, str(tmp_path))
    found = library.taggable(index).collect()
    assert [r.relative_path for r in found] == ["x/Di_Sarli - Uno.mp3", "x/y/b.FLAC", "z.m4a"]
    assert found[0].normalized_base_name == "di sarli - uno" and found[1].format == "flac"
    assert library.skipped(index).first().skipped == 1


def test_exports(spark, tmp_path):
    rows = [("O & 'P' \"Q\" <R", 0, 0, "a & b.mp3", "120"), ("O & 'P' \"Q\" <R", 0, 1, 'b "x".mp3', "121"), ("O & 'P' \"Q\" <R", 1, 0, "c.mp3", "12.5"), ("S", 2, 0, "d.mp3", "")]
    rows = spark.createDataFrame(rows, "orchestra string, track_pos int, file_pos int, file string, bpm string")
    sinks.write_tempo(rows, str(tmp_path / "bpm"))
    found = {}
    for p in (tmp_path / "bpm").glob("*/part*"):
        document = ElementTree.fromstring(p.read_text().strip().encode())
        found[document.get("orchestra")] = [(x.get("name"), x.get("bpm")) for x in document]
    assert found == {"O & 'P' \"Q\" <R": [('b "x".mp3', "121"), ("a & b.mp3", "120")], "S": []}
    lyrics = spark.createDataFrame([("a", 0, "T", "x\n\ny"), ("a", 1, "U", "z"), ("b", 0, "T", "w")], "file string, pos int, name string, contents string")
    assert [r.html for r in sinks.pages(lyrics).collect()] == ["<h3>T</h3><p>x</p><p>y</p>\n<h4>U</h4><p>z</p>"]


def test_renames_and_copies(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "c"), ("d", "c"), ("e", "f")], "old string, new string")
    assert {(r.old, r.allowed) for r in sinks.renames(rows).collect()} == {("a", False), ("b", False), ("d", False), ("e", True)}
    day = lambda n: datetime.datetime(2020, 1, n)
    sources = spark.createDataFrame([("1", "a?", day(3), False), ("2", "b", day(5), False), ("3", "c", day(3), True), ("4", "d", day(3), False)], "file string, name string, modified timestamp, alternative boolean")
    there = spark.createDataFrame([("a", day(4)), ("b", day(4))], "name string, modified timestamp")
    assert {r.file for r in sinks.copies(sources, there).collect()} == {"2", "4"}
    assert {r.file for r in sinks.copies(sources, there, force=True, alternatives=True).collect()} == {"1", "2", "3", "4"}


def test_lyrics_folder_and_catalogue_file(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("10.xml", "9.XML", "b.txt", ".hidden.xml", "sub/8.xml"):
        (tmp_path / name).write_text("<lyrics/>")
    assert [r.file for r in library.lyrics_files(spark, str(tmp_path)).collect()] == ["9.XML", "10.xml"]
    assert library.catalogue_file(spark, str(tmp_path)).first().path.endswith("/10.xml")
    assert sorted(r.file for r in library.listing(spark, str(tmp_path), "*.xml", recursive=False).collect()) == ["10.xml"]
    assert sorted(r.file for r in library.listing(spark, str(tmp_path), "*.xml").collect()) == ["10.xml", "8.xml"]


def test_malformed_translations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<lyrics><translation lang="spa">x</translation></lyrics>')
    (tmp_path / "b.xml").write_text('<lyrics><translation lang="spa">x</translation')
    with pytest.raises(Exception):
        catalogue.translations(spark, str(tmp_path)).collect()
    assert {r.file.rsplit("/", 1)[1] for r in catalogue.translations(spark, str(tmp_path), strict=False).collect()} == {"a.xml"}


def test_batches_are_sent_once_even_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sent = []
    send = lambda rows, n: sent.append((n, sorted(r.value for r in rows.collect())))

    def run():
        query = sinks.send_batches(spark.readStream.text(str(tmp_path / "in")), send, str(tmp_path / "check"))
        query.processAllAvailable()
        query.stop()

    (tmp_path / "in" / "1").write_text("a\nb")
    run()
    # As after a run that ended before its batch was committed: the batch is replayed.
    for name in ("0", ".0.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    run()
    (tmp_path / "in" / "2").write_text("c")
    run()
    assert sent == [(0, ["a", "b"]), (1, ["c"])]


def test_socket_messages(spark):
    with socket.create_server(("127.0.0.1", 0)) as server:
        threading.Thread(target=lambda: server.accept()[0].sendall(b"A - B | tango\n"), daemon=True).start()
        stream = messages.parsed(messages.socket_messages(spark, "127.0.0.1", server.getsockname()[1]))
        query = stream.writeStream.format("memory").queryName("told").start()
        for _ in range(300):
            if rows := spark.table("told").collect():
                break
            time.sleep(0.1)
        query.stop()
    assert [(r.artist, r.code) for r in rows] == [("A", "T")] and rows[0].at > 0


MESSAGES = [("A - B | tango", "A.jpg"), ("", ""), (None, "x"), ("Ñ \U0001f3b5", None), (None, None), ("x" * 70000, "y")]


def test_framed_messages(spark):
    rows = spark.createDataFrame(MESSAGES, "text string, image string").select("*", messages.framed(F.col("text"), F.col("image")).alias("frame"))
    back = rows.select("text", "image", "frame", *(c.alias(n) for n, c in messages.unframed(F.col("frame"), ["one", "two"]).items())).collect()
    assert [(r.one, r.two) for r in back] == [(r.text, r.image) for r in back] == MESSAGES
    wanted = lambda t: b"\xff\xff\xff\xff" if t is None else len(t.encode("utf-16-be")).to_bytes(4, "big") + t.encode("utf-16-be")
    assert [bytes(r.frame) for r in back] == [wanted(t) + wanted(i) for t, i in MESSAGES]


def test_messages_that_are_cut_off(spark):
    whole = (6).to_bytes(4, "big") + "abc".encode("utf-16-be")
    frames = [bytearray(whole[:n]) for n in range(len(whole) + 1)] + [bytearray(b"\x7f\xff\xff\xffab"), None]
    rows = spark.createDataFrame([(f,) for f in frames], "frame binary")
    back = rows.select(*(c.alias(n) for n, c in messages.unframed(F.col("frame"), ["one", "two"]).items())).collect()
    assert [(r.one, r.two) for r in back] == [("abc" if f is not None and bytes(f) == whole else None, None) for f in frames]


def test_a_file_without_a_folder_fails_alone(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/none/a", bytearray(b"1")), (f"{tmp_path}/b", bytearray(b"2"))], "path string, content binary")
    found = {r.path.rsplit("/", 1)[1]: r.outcome.split(":")[0] for r in sinks.replace_files(rows).collect()}
    assert found == {"a": "failed", "b": "written"} and [p.name for p in tmp_path.iterdir()] == ["b"]


def test_replace_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"old")
    rows = spark.createDataFrame([(f"file:{tmp_path}/a", bytearray(b"new"))], "path string, content binary")
    assert sinks.replace_files(rows).first().outcome == "written"
    assert (tmp_path / "a").read_bytes() == b"new" and len(list(tmp_path.iterdir())) == 1


#: Pairs of texts and their differences, worked out by hand from the rules.
DIFFERENCES = [
    ("one two three", "one too three", "one {+too +}[-two -]three"),
    ("Uno", "uno", "{+u+}[-U-]no"),
    ("", "", ""),
    ("", "q r", "{+q r+}"),
    ("q r", "", "[-q r-]"),
    ("a b c", "a c d", "a [-b -]c{+ d+}"),
    ("one two", "one  two", "one{+ +} two"),
    ("one\ttwo", "one two", "one[-\t-]{+ +}two"),
    ("Hello World", "hello big world", "{+h+}[-H-]ello {+big w+}[-W-]orld"),
    (" a", "a", "[- -]a"),
    ("a b", "b a", "{+b +}a[- b-]"),
    ("12 a", "13 a", "1[-2-]{+3+} a"),
]


@pytest.mark.parametrize("old, new, wanted", DIFFERENCES)
def test_differences(old, new, wanted):
    assert diff.marked(diff.differences(old, new), diff.MARKS) == wanted


def test_differences_give_both_texts_back():
    r = random.Random(1)
    for _ in range(300):
        old, new = ("".join(r.choice(["a", "B", "b", " ", ", ", "1", "é"]) for _ in range(r.randint(0, 9))) for _ in range(2))
        parts = diff.differences(old, new)
        assert "".join(t for k, t in parts if k != "+") == old or old.lower() != old
        assert "".join(t for k, t in parts if k != "-") == new
        assert all(x[0] != y[0] for x, y in zip(parts, parts[1:]))


def test_alignments_are_longest():
    r = random.Random(2)

    def longest(a, b):
        return 0 if not a or not b else longest(a[1:], b[1:]) + 1 if a[0] == b[0] else max(longest(a[1:], b), longest(a, b[1:]))

    for _ in range(60):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2))
        assert sum(k == "=" for k, _, _ in diff.aligned(a, b)) == longest(a, b)


def test_word_diff(spark):
    marked = lambda a, b, **o: spark.range(1).select(diff.word_diff(F.lit(a), F.lit(b), **o).alias("x")).first().x
    assert marked("one two three", "one too three") == "one {+too +}[-two -]three"
    assert marked("a<b", "a<c", as_html=True) == 'a&lt;<font style="background-color:#99CCFF;color:black">c</font><font style="background-color:#FF9999;color:black">b</font>'
    words = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert spark.range(1).select(diff.list_diff(words("a", "B", "c"), words("a", "b", "c")).alias("x")).first().x == "a{+b+}[-B-]c"
    assert spark.range(1).select(diff.list_diff(words(), words("x", "y")).alias("x")).first().x == "{+xy+}"
    length = spark.range(1).select(diff.lcs_length(F.array(*map(F.lit, "abcbdab")), F.array(*map(F.lit, "bdcaba"))).alias("n")).first().n
    assert length == 4


def whole_table(a, b):
    """The alignment read off the whole table of common lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(("=", i, j))
        elif i and (not j or best[i - 1][j] >= best[i][j - 1]):
            i -= 1
            out.append(("-", i, -1))
        else:
            j -= 1
            out.append(("+", -1, j))
    return out[::-1]


def test_alignment_equals_that_of_the_whole_table():
    r = random.Random(12)
    for _ in range(1500):
        a, b = ([r.choice("abcd") for _ in range(r.choice([0, 1, 3, 9, 30]))] for _ in range(2))
        assert diff.aligned(a, b) == whole_table(a, b)
        assert diff.common(a, b) == sum(k == "=" for k, *_ in whole_table(a, b))


def test_long_texts_need_little_memory():
    """Two texts of 20,000 words: the whole table would have 400 million cells."""
    r = random.Random(13)
    old = [f"w{r.randrange(3000)}" for _ in range(20_000)]
    new = [w if r.random() < 0.9 else f"n{r.randrange(99)}" for w in old if r.random() < 0.95]
    tracemalloc.start()
    steps = diff.aligned(old, new)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(k == "=" for k, *_ in steps) >= 16_000 and most < 60 << 20
    assert [old[i] for k, i, _ in steps if k != "+"] == old and [new[j] for k, _, j in steps if k != "-"] == new
