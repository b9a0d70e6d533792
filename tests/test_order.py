"""Places, neighbours and next matches over ranges, against one sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from cotejo.functions import diff
from cotejo.operators import order
from cotejo.plans import ordered

ROWS = [(i, random.Random(i).choice("aab")) for i in random.Random(1).sample(range(5000), 1200)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, kind string").repartition(5)


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_places(spark, rows):
    found = order.placed(table(spark, rows), F.col("kind"), F.col("id").desc())
    wanted = sorted(rows, key=lambda r: (r[1], -r[0]))
    assert found.columns == ["id", "kind", "place"]
    assert sorted((r.place, r.id) for r in found.collect()) == [(i + 1, r[0]) for i, r in enumerate(wanted)]


@pytest.mark.parametrize("share", [0, 1, 50, 4999])
def test_next_matches(spark, share):
    ids = sorted(i for i, _ in ROWS)
    hits = [i for i in ids if i % 5000 < share]
    matched = spark.createDataFrame([(i,) for i in hits * 2] + [(None,)], "id long")
    found = {r.id: r.next for r in order.next_matches(table(spark, ROWS), matched, "id", "id").collect()}
    assert found == {i: next((h for h in hits if h > i), None) for i in ids}


def test_previous(spark):
    found = {r.id: (r.before_id, r.before_kind) for r in order.with_previous(table(spark, ROWS), ["id", "kind"], F.col("kind"), F.col("id")).collect()}
    wanted = sorted((k, i) for i, k in ROWS)
    assert found == {i: (b[1], b[0]) if b else (None, None) for b, (k, i) in zip([None, *wanted], wanted)}
    assert order.with_previous(table(spark, []), ["id"], F.col("id")).count() == 0


@pytest.mark.parametrize("name", ["natural_places", "locale_places", "next_matches", "events_before"])
def test_no_task_has_all_rows(spark, small, name):
    plan = getattr(ordered, name)(spark, small)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


def test_documents_are_compared_whole(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    begins, wanted = {}, {}
    for i in sorted(texts):
        key = texts[i][:40].lower()
        if key in begins:
            wanted[i] = begins[key]
        begins[key] = i
    found = ordered.document_diffs(spark, small).collect()
    assert {r.doc_id: r.before_doc_id for r in found} == wanted and len(wanted) > 5
    for r in found:
        assert r.marked == diff.marked(diff.differences(texts[r.before_doc_id], texts[r.doc_id]), diff.MARKS)
        parts = diff.differences(texts[r.before_doc_id], texts[r.doc_id])
        assert "".join(t for k, t in parts if k != "+") == texts[r.before_doc_id] and "".join(t for k, t in parts if k != "-") == texts[r.doc_id]
