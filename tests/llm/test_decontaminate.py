import random

from cotejo.llm import decontaminate
from cotejo.llm.queries import CONTAINED_SQL, op2_decontamination


def runs(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def make(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(r.choice([3, 5, 8, 30, 90, 200])))) for k in range(30)]
    docs = []
    for i in range(80):
        body = [word() for _ in range(r.choice([0, 5, 300, 3000]))]
        for k in r.sample(range(30), r.choice([0, 1, 2, 12])):
            part = items[k][1].split()
            if r.random() < 0.5:
                part[r.randrange(len(part))] = word()
            if r.random() < 0.3:
                part = part[: int(len(part) * r.choice([0.7, 0.85, 0.95]))]
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((i, " ".join(body)))
    return docs, items


def test_matches_equal_all_pairs(spark, documents):
    docs, items = make(1)
    docs += [(500, None), (501, ""), (502, items[0][1].upper()), (None, items[1][1])]
    items += [(90, None), (91, " ")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.matches(documents(docs), table).collect()}
    wanted = {(i, k, len(runs(a) & runs(b)), len(runs(b))) for i, a in docs for k, b in items if runs(b) and 100 * len(runs(a) & runs(b)) >= 80 * len(runs(b))}
    assert found == wanted and len(found) > 40


def test_decontaminated(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = documents([(1, "x one two three four five six y"), (2, "clean"), (3, None), (None, "One two three four five six"), (None, "else")])
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [(0, "else"), (2, "clean")] and kept.count() == 3
    assert decontaminate.decontaminated(docs, items.limit(0)).count() == 5
    assert decontaminate.matches(docs.limit(0), items).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    """Rows that share an id are one document; columns that are named like the operator's own don't matter and stay."""
    names = "doc_id long, text string, shingle string, item string, n_item int, at int, _item int, doc_class int"
    text = "x one two three four five six y"
    docs = spark.createDataFrame([(1, text, "s", "i", 5, 6, 7, 8), (1, text, "s", "i", 5, 6, 7, 8), (2, "clean text", "s", "i", 5, 6, 7, 8)], names)
    items = spark.createDataFrame([(1, "one two three four five six", "t"), (1, "one two three four five six", "t")], "item_id long, text string, n_shared string")
    assert [(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontaminate.matches(docs, items).collect()] == [(1, 1, 2, 2)]
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "clean text", "s", "i", 5, 6, 7, 8)]


def test_main_path_has_no_python(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = decontaminate.matches(documents([(1, "x")]), items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_sql(same):
    assert same(op2_decontamination, CONTAINED_SQL) > 0
