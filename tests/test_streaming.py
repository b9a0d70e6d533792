"""Folds over events, in batches and in streams, against sequential simulations."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from cotejo.sources import messages, sinks
from cotejo.streaming import ordered, sessions, tempo


def taps(seed, n):
    r, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += r.choice([400, 500, 520, 480, 500, 2000, 0, 150])
        out.append(t)
    return out


def simulated(times):
    s = (0, 0, 0.0, 0.0, 0)
    for t in times:
        s = tempo.step(s, t, 60000.0)
    return s


def test_tempo_fold_equals_simulation(spark):
    rows = [(k, t, i) for k in range(6) for i, t in enumerate(taps(k, 60))]
    random.Random(1).shuffle(rows)
    found = tempo.tempo(spark.createDataFrame(rows, "key long, at long, i int"), "key", F.col("at"), ["i"]).collect()
    assert {r.key: (r.taps, r.total_bpm, r.last_bpm, r.resets) for r in found} == {k: (s[0], s[2], s[3], s[4]) for k in range(6) for s in [simulated(taps(k, 60))]}
    assert any(r.resets for r in found)


def history_of(codes):
    h = [""]
    for c in codes:
        if c or h[-1]:
            h.append(c)
        if len(h) > 30:
            h.pop(0)
    return h


def test_histories_equal_simulation(spark):
    r = random.Random(2)
    codes = [r.choice(["T", "T", "V", "M", "", ""]) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, c string").withColumn("key", F.lit(1))
    found = sessions.histories(rows, "key", ["i"], F.col("c")).select("i", "c", "history", sessions.shown(F.col("history")).alias("shown"), sessions.previous(F.col("history"), 0).alias("now")).collect()

    def previous(h, skip):
        for i in range(len(h) - 1, -1, -1):
            if h[i] == "":
                if skip == 0:
                    return h[i + 1] if i + 1 < len(h) else ""
                skip -= 1
        return ""

    for x in found:
        h = history_of(codes[: x.i + 1])
        assert x.history == h
        assert x.shown == "".join(previous(h, k) for k in range(5, -1, -1)) and x.now == previous(h, 0)


MESSAGES = ["A - b | Tango", "A - b | Tango", "no bar", "B - c | Vals", "x | break", "y | break", "C - d | Milonga", "z" * 300 + " | Tango", "z" * 300 + " | Tango"]


def test_repeats_and_validity(spark):
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate(MESSAGES)], "key long, at long, text string")
    kept = sessions.valid(sessions.without_repeats(rows, "key", ["at"])).orderBy("at").collect()
    assert [r.at for r in kept] == [0, 3, 4, 5, 6, 7, 8]


def test_parsed(spark):
    rows = messages.parsed(spark.createDataFrame([("A - b | Tango",), ("x | pause",)], "text string")).collect()
    assert [(r.artist, r.display, r.code) for r in rows] == [("A", "A - b", "T"), ("x | pause", "x", "")]


def test_images(spark):
    rows = spark.createDataFrame([("Ána",), ("Bob",)], "artist string")
    images = spark.createDataFrame([("Ana.jpg",), ("default.jpg",)], "file string")
    assert {r.artist: r.image for r in sessions.with_images(rows, images).collect()} == {"Ána": "Ana.jpg", "Bob": "default.jpg"}
    assert {r.image for r in sessions.with_images(rows, images.limit(0)).collect()} == {None}


@pytest.fixture(scope="module")
def keeping(spark):
    return ordered.with_rocksdb(spark)


def at_second(i):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i)


def streamed(spark, tmp_path, schema, arrivals, make):
    """The rows that a stream writes, each arrival a run of its own that goes on from the checkpoint."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for rows in arrivals:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


TAP = "key long, at timestamp, id long"


def test_tempo_stream_takes_late_taps_where_they_belong(keeping, tmp_path):
    seconds = [0, 1, 2, 3, 10, 11, 12, 12, 13, 14, 30, 31, 32, 33, 40, 41, 42]
    rows = [(1, at_second(x), i) for i, x in enumerate(seconds)]
    random.Random(3).shuffle(rows)
    early, late = [r for r in rows if r[2] % 3], [r for r in rows if not r[2] % 3]
    arrivals = [early, late, [(2, at_second(50), 99), (None, at_second(500), None)]]
    found = streamed(keeping, tmp_path, TAP, arrivals, lambda s: tempo.tempo_stream(s, "100 seconds", scale=6e7))
    s = (0, 0, 0.0, 0.0, 0)
    for x in sorted(seconds):
        s = tempo.step(s, int(at_second(x).replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**6, 6e7)
    last = max((r for r in found if r.key == 1), key=lambda r: r.n)
    assert (last.taps, last.total_bpm, last.last_bpm, last.resets, last.n) == (s[0], s[2], s[3], s[4], len(seconds))
    assert {r.key for r in found} == {1, 2}


def test_display_stream(keeping, tmp_path):
    rows = [(1, at_second(i), i, m) for i, m in enumerate(MESSAGES)]
    end = [(None, at_second(900), None, None)]
    found = streamed(keeping, tmp_path, "key long, at timestamp, id long, text string", [rows[4:] + rows[:2], rows[2:4], end], lambda s: sessions.display_stream(s, "60 seconds"))
    assert sorted((r.id, r.sessions) for r in found) == [(0, "T"), (3, "T"), (6, "TM"), (7, "TM"), (8, "TM")]


def test_rows_behind_the_watermark_are_left_out(keeping, tmp_path):
    arrivals = [[(1, at_second(0), 1), (1, at_second(100), 2)], [(1, at_second(1), 3)], [(None, at_second(900), None)]]
    found = streamed(keeping, tmp_path, TAP, arrivals, lambda s: tempo.tempo_stream(s, "10 seconds"))
    assert max(r.n for r in found) == 2


def test_idle_keys_lose_their_state(keeping, tmp_path):
    def fold(key, state, rows):
        return (state[0] + len(rows),), [(key[0], state[0] + len(rows))]

    arrivals = [[(1, at_second(0), 1)], [(2, at_second(100), 2)], [(1, at_second(200), 3)], [(None, at_second(900), None)]]
    for idle, wanted in ((None, 2), (datetime.timedelta(seconds=20), 1)):
        found = streamed(keeping, tmp_path / str(wanted), TAP, arrivals, lambda s: ordered.folded(s, "key", "at", ["id"], fold, (0,), "n long", "key long, n long", "5 seconds", idle))
        assert max(r.n for r in found if r.key == 1) == wanted


def test_keys_share_buckets(keeping, tmp_path, monkeypatch):
    """Calls to the state go by buckets, not keys; large ids and nulls stay as they are beside each other."""
    monkeypatch.setattr(ordered, "BUCKETS", 2)
    calls, big = str(tmp_path / "calls"), (1 << 60) + 1
    real = ordered.Ordered.handleInputRows

    def counted(self, key, rows, timerValues):
        with open(calls, "a") as f:
            f.write("x")
        return real(self, key, rows, timerValues)

    def fold(key, state, rows):
        return (state[0] + len(rows),), [(key[0], r[1], state[0] + i) for i, r in enumerate(rows)]

    monkeypatch.setattr(ordered.Ordered, "handleInputRows", counted)
    rows = [(big + k, at_second(i), None if (i + k) % 5 == 0 else big + i) for k in range(20) for i in range(6)]
    random.Random(4).shuffle(rows)
    found = streamed(keeping, tmp_path, TAP, [rows, [(None, at_second(900), None)]], lambda s: ordered.folded(s, "key", "at", ["id"], fold, (0,), "n long", "key long, id long, n long", "5 seconds"))
    assert sorted((r.key, r.n, r.id or 0) for r in found) == [(big + k, i, 0 if (i + k) % 5 == 0 else big + i) for k in range(20) for i in range(6)]
    with open(calls) as f:
        assert len(f.read()) <= 4


def test_tempo_needs_no_array_of_a_keys_taps(spark):
    taps = spark.range(30000).select((F.col("id") % 3 % 2).alias("k"), (F.col("id") * 300 + F.col("id") % 7).alias("t"), "id")
    found = tempo.tempo(taps, "k", F.col("t"), ["id"])
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    wanted = {}
    for i in range(30000):
        k = i % 3 % 2
        wanted[k] = tempo.step(wanted.get(k, (0, 0, 0.0, 0.0, 0)), i * 300 + i % 7, 60000.0)
    assert {r.k: (r.taps, r.total_bpm, r.last_bpm, r.resets) for r in found.collect()} == {k: (s[0], *s[2:]) for k, s in wanted.items()}


def test_older_generations_and_replays_change_nothing(spark, tmp_path):
    path = str(tmp_path / "results")
    batches = [[(1, 2, "a"), (2, 1, "b")], [(1, 1, "old"), (2, 3, "c"), (2, 3, "d")], [(1, 2, "e"), (None, 1, "f")]]
    for n in (0, 1, 2, 1, 0):
        sinks.keep_batch(spark.createDataFrame(batches[n], "key long, generation int, value string"), n, path)
    found = sinks.newest_results(spark, path, "key", "generation").collect()
    assert sorted((r.key or 0, r.value) for r in found) == [(0, "f"), (1, "a"), (1, "e"), (2, "c"), (2, "d")]


@pytest.mark.parametrize("n_keys", [1, 3, 200])
def test_histories_in_ranges_equal_those_of_whole_keys(spark, n_keys):
    """Ranges cut a key's events anywhere; a hot key has most of them."""
    r = random.Random(n_keys)
    rows = [(0 if r.random() < 0.6 else r.randrange(n_keys), i, r.choice(["T", "V", "M", "", ""])) for i in range(1500)]
    table = spark.createDataFrame(rows, "key long, i int, c string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = sessions.histories_in_ranges(table, "key", ["i"], F.col("c")).select("key", "i", "code", "history").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    wanted = sessions.histories(table, "key", ["i"], F.col("c")).select("key", "i", "code", "history").collect()
    assert sorted(found) == sorted(wanted)
    assert sessions.histories_in_ranges(table.limit(0), "key", ["i"], F.col("c")).count() == 0


@pytest.mark.parametrize("n_keys", [1, 3, 200])
def test_repeats_in_ranges_equal_those_of_whole_keys(spark, n_keys):
    r = random.Random(n_keys)
    texts = ["a | x", "b | y", "é" * 124, "é" * 125, "z" * 250]
    rows = [(None if r.random() < 0.1 else 0 if r.random() < 0.6 else r.randrange(n_keys), i, r.choice(texts)) for i in range(1500)]
    table = spark.createDataFrame(rows, "key long, i int, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = sessions.without_repeats_in_ranges(table, "key", ["i"])
        assert found.columns == ["key", "i", "text"]
        found = {r.i for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {r.i for r in sessions.without_repeats(table, "key", ["i"]).collect()} and len(found) < 1500
    assert sessions.without_repeats_in_ranges(table.limit(0), "key", ["i"]).count() == 0


def test_repeats_without_a_text(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "a"), (1, 3, None), (2, 4, "a")], "key int, i int, text string")
    assert sorted(r.i for r in sessions.without_repeats_in_ranges(rows, "key", ["i"]).collect()) == [0, 2, 3, 4]
