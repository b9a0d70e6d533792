import corpus_pipeline
from corpus_pipeline import STAGES
from pyspark.sql import functions as F

from cotejo.llm import bpe, quality, repeats
from cotejo.llm.queries import tokenizer


def test_run_equals_brute_force(spark, small):
    """Each stage's decisions by plain Python over all documents, except the vote, whose scores are the operator's own."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = quality.fitted(docs, spark.read.parquet(f"{small}/labels.parquet"), "doc_id", "quality", "text")
    kept = {r.doc_id: r.text for r in quality.scored(docs, model).where(f"score >= {corpus_pipeline.LEAST_QUALITY}").collect()}
    met: set = set()
    for i in sorted(kept):
        units, runs = repeats.line_runs(kept[i])
        own, covered = set(), set()
        for h, a, b in runs:
            if h in met or h in own:
                covered.update(range(a, b + 1))
            own.add(h)
        met |= own
        if covered:
            kept[i] = "\n".join(line for k, line in enumerate(kept[i].split("\n")) if k not in covered)
    kept = {i: t for i, t in kept.items() if t.strip()}

    def plain_set(text, lower):
        words = lower(text).split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    sets = {i: plain_set(t, lambda x: x.encode().lower()) for i, t in kept.items()}
    top = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= corpus_pipeline.ALIKE * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = {k: min(a, b) if v in (a, b) else v for k, v in top.items()}
    kept = {i: t for i, t in kept.items() if top[i] == i}
    items = [plain_set(r.text, str.lower) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(100 * len(x & plain_set(t, str.lower)) >= 80 * len(x) for x in items)}
    encoder = bpe.Encoder(bpe.load(tokenizer()))
    wanted = {i: list(memoryview(encoder.encode(t)).cast("I")) for i, t in kept.items()}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: r.ids for r in rows} == wanted and len(rows) == len(wanted)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_odd_rows_and_columns(spark, small):
    rows = [(1, "A good text. " * 4, "en", "s", 52, "x"), (2, None, None, None, None, None), (None, "Another text of a few words.", "en", None, 28, "y"), (4, "", "en", "s", 0, "z"), (5, "Long " * 30000 + ".", "en", "s", 150001, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").withColumns({"n_units": F.lit("own"), "_gone": F.lit(1)})
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        assert out.count() == 5 and {(r.score, r.n_units) for r in out.collect()} == {(r[-1], "own") for r in rows}, name
        assert stage(spark, docs.limit(0), small).count() == 0
    last = STAGES[-1][1](spark, docs, small).collect()
    assert len(last) == 5 and all(r.round_trip for r in last)


def test_first_stage_drops_junk_only(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    kept = STAGES[0][1](spark, docs, small)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert all(i in ids for i, q in labels.items() if q == 1)
    assert sum(i not in ids for i, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())
    assert kept.where(F.col("text").isNull()).count() == 0
