"""One text of some megabytes beside short ones: every operator takes it whole."""

import random

import pytest

from cotejo.llm import bpe, decontaminate, language_id, pii, quality, repeats, wrapper
from cotejo.llm.queries import tokenizer


@pytest.fixture(scope="module")
def long():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    sentences = [" ".join(r.choices(words, k=r.randint(5, 12))) + "." for _ in range(40_000)]
    return sentences


@pytest.fixture(scope="module")
def docs(documents, long):
    return documents([(1, "\n".join(long)), (2, "One short text."), (3, " ".join(long[20_000:20_010]) + " a@b.org"), (4, "\n".join(long[-5:]))])


def test_repeats(docs, long):
    for removed in (repeats.without_repeated_sentences, repeats.without_repeated_lines):
        found = {r.doc_id: r for r in removed(docs).collect()}
        assert found[1].n_removed == found[2].n_removed == 0 and found[1].text.count("\n") == len(long) - 1
        assert found[4].n_removed == 5 and found[4].text == ""
    assert {r.doc_id: r.n_removed for r in repeats.without_repeated_sentences(docs).collect()}[3] >= 9


def test_items_at_its_end(spark, docs, long):
    items = spark.createDataFrame([(7, " ".join(long[-3:]))], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.matches(docs, items).collect()) == [1, 4]


def test_spans_at_its_end(documents, long):
    text = "\n".join(long) + " a@b.org"
    found = pii.spans(documents([(1, text)]), ["doc_id"]).first()
    assert [tuple(s) for s in found.spans] == [("email", len(text) - 7, len(text))]


def test_tokens(docs, long):
    found = {r.doc_id: r.decoded for r in bpe.encode_decode(docs, tokenizer()).collect()}
    assert found[1] == "\n".join(long)


def test_models(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    model = quality.fitted(docs, labels, "doc_id", "quality", "text")
    assert all(0 <= r.score <= 1 for r in quality.scored(docs, model).collect())
    known = language_id.fitted(docs.selectExpr("doc_id", "text", "if(doc_id = 2, 'x', 'y') as lang"))
    assert {r.doc_id: r.lang_pred for r in language_id.predicted(docs, known).collect()}[1] in ("x", "y")


def test_article(spark, long):
    page = "<article>" + "".join(f"<p>{s}</p>" for s in long) + "</article><footer>f</footer>"
    found = wrapper.extracted(spark.createDataFrame([(1, "http://h/1", page)], "page_id long, url string, html string")).first()
    assert found.text == "\n\n".join(long) and found.n_chars == len(found.text)
