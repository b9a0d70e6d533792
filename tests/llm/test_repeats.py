import random
import re

import pytest

from cotejo.llm import repeats
from cotejo.llm.queries import LINES_SQL, op7_line_dedup

LINE_TEXTS = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "b\nc\nd\ne"), (4, "a\nb\nc\na\nb\nc\n"), (5, ""), (6, None), (7, "a\nb"), (8, "a \n\n b\nc\t\nz"), (None, "q\nr\ns"), (9, "q\nr\ns"), (2, "x\na\nb\nc\ny"), (10, "a\nb\nc")]


def brute(rows, cut):
    """Removes units by going through documents in order."""
    met, out = {}, {}
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        units, runs = cut(t) if t else ([], [])
        own, covered = set(), set()
        for h, a, b in runs:
            if h in met or h in own:
                covered.update(range(a, b + 1))
            own.add(h)
        met |= dict.fromkeys(own)
        out[i, t] = len(covered)
    return out


def test_lines(documents):
    found = repeats.without_repeated_lines(documents(LINE_TEXTS)).collect()
    assert len(found) == len(LINE_TEXTS)
    text = {r.doc_id: r.text for r in found}
    assert text == {1: "a\nb\nc\nd", 2: "x\ny", 3: "e", 4: "", 5: "", 6: None, 7: "a\nb", 8: "z", None: "", 9: "q\nr\ns", 10: ""}
    assert {r.score for r in found} == {"extra"}


def random_texts(unit, end, seed):
    r = random.Random(seed)
    units = [unit(r) for _ in range(40)]
    out = []
    for i in range(40):
        at = r.randrange(35)
        own = [unit(r) for _ in range(r.randint(0, 4))]
        out.append((i, end.join([*own, *(units[at : at + r.randint(0, 6)]), *([unit(r)] if r.random() < 0.5 else [])])))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_one_pass_in_order(documents, seed):
    rows = random_texts(lambda r: r.choice("abcdefgh") * r.randint(1, 3), "\n", seed)
    found = repeats.without_repeated_lines(documents(rows)).collect()
    assert {(r.doc_id): r.n_removed for r in found} == {i: n for (i, _), n in brute(rows, repeats.line_runs).items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_sentences_equal_one_pass_in_order(documents, seed):
    rows = random_texts(lambda r: " ".join(r.choice(["uno", "dos", "tres", "ocho"]) for _ in range(r.choice([2, 12, 40]))) + ".", " ", seed)
    found = repeats.without_repeated_sentences(documents(rows)).collect()
    assert {(r.doc_id): r.n_removed for r in found} == {i: n for (i, _), n in brute(rows, repeats.sentence_runs).items()}


def plain_removed(rows):
    """Of texts of short sentences: how many sentences stand in a run of three that stood before; by listing all runs."""
    split = {i: [" ".join(x.lower().split()) for x in re.findall(r"[^.]+[.]", t)] for i, t in rows}
    places = sorted((tuple(s[k : k + 3]), i, k) for i, s in split.items() for k in range(len(s) - 2))
    later = {(i, k + d) for (run, i, k), (before, *_) in zip(places[1:], places) if run == before for d in range(3)}
    return {i: sum((i, k) in later for k in range(len(s))) for i, s in split.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_short_sentences_equal_all_runs(documents, seed):
    """Runs of three short sentences count whatever their length; the cut here is the test's own."""
    rows = random_texts(lambda r: " ".join(r.choice(["uno", "dos", "tres"]) for _ in range(r.choice([1, 2, 4]))) + ".", " ", seed)
    found = repeats.without_repeated_sentences(documents(rows)).collect()
    assert {r.doc_id: r.n_removed for r in found} == plain_removed(rows)
    assert sum(r.n_removed for r in found) > 0


def test_units_cover_the_text():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice(["a ", "word ", ". ", "! ", "\n", ".", "é", "  "]) for _ in range(r.randint(0, 80)))
        for cut in (repeats.line_runs, repeats.sentence_runs):
            units, _ = cut(text)
            assert "".join(text[a:b] for a, b in units) == text


def test_passages_of_fifty_words_are_found(documents):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for length in (3, 9, 17, 26, 51):
        passage = " ".join(" ".join(word() for _ in range(min(length, 51 - k))) + "." for k in range(0, 51, length))
        rows = [(1, f"{word()} {word()}. {passage} {word()}."), (2, f"{word()}. {passage} {word()} {word()}."), (3, " ".join(word() + "." for _ in range(60)))]
        found = {x.doc_id: x for x in repeats.without_repeated_sentences(documents(rows)).collect()}
        assert found[1].n_removed == found[3].n_removed == 0
        assert passage[:100] not in found[2].text and len(found[2].text.split()) < 25


def test_passages_inside_of_sentences_are_found(documents):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    for _ in range(8):
        passage = " ".join(word() for _ in range(55))
        rows = [(k, " ".join([*(word() for _ in range(r.randint(0, 40))), passage, *(word() for _ in range(r.randint(0, 40)))])) for k in range(3)]
        found = {x.doc_id: x for x in repeats.without_repeated_sentences(documents(rows)).collect()}
        assert found[0].n_removed == 0
        assert all(passage not in found[k].text and found[k].n_removed for k in (1, 2))


def test_empty_table(documents):
    assert repeats.without_repeated_lines(documents([(1, "a")]).limit(0)).count() == 0
    assert repeats.without_repeated_sentences(documents([(1, "a")]).limit(0)).count() == 0


def test_query_equals_sql(same):
    same(op7_line_dedup, LINES_SQL)
