import hashlib
import random
import re
import string

import pytest

from cotejo.llm import secrets
from cotejo.llm.queries import op11_secrets

#: The base patterns as they are agreed, with what must be how long.
AGREED = {
    "assign": (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


def plain(text):
    spans = [(k, m.start(), m.end()) for k, (p, g, n) in AGREED.items() for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return sorted(spans, key=lambda s: (s[1], list(AGREED).index(s[0])))


def drawn(r, n, letters=string.ascii_letters + string.digits):
    return "".join(r.choice(letters) for _ in range(n))


def mixtures(seed):
    r = random.Random(seed)
    parts = ["password", "PassWd", "secret", "toKen", "token", "API_KEY", "apikey", "api__key", "=", ":", " ", "  ", '"', "'", "\n", "é", "😀", "AKIA", "AKIAAKIA", ".", "-", "/", "deadbeef", "0123456789abcdef", "g", "ſecret"]
    return ["".join(r.choice([*parts, drawn(r, r.randint(1, 30)), drawn(r, r.randint(1, 30), "0123456789abcdef"), "AKIA" + drawn(r, r.randint(10, 20), string.ascii_uppercase)]) for _ in range(r.randint(0, 14))) for _ in range(1500)]


def test_base_spans_equal_plain_matching():
    for text in mixtures(1):
        assert secrets.base(text) == plain(text), text


CLEAN = """The secret of a good soup is patience, and the password to my heart is chocolate.
session_handler_configuration_factory = make_session_handler(application_settings.session_lifetime_in_seconds)
from authentication.bearer.token_validation_service import BearerTokenValidationService
auth: /usr/local/lib/python/site-packages/application/authentication_provider_settings.json
def private_key_file_path(certificate_directory_name): return certificate_directory_name
signature algorithm: https://www.example.com/documentation/signature-algorithm-overview.html
"""


def code(r):
    return f"{CLEAN}client.authorize(bearer, {drawn(r, 28)!r})\n"


def test_novel_strings_in_sensitive_context_are_found(spark, documents):
    r = random.Random(2)
    keys = [drawn(r, 32) for _ in range(6)]
    lines = [f"Authorization: Bearer {keys[0]}", f"private_key('{keys[1]}')", f"export PWD {keys[2]}", f"credentials.add( {keys[3]} )", f"session id is {keys[4]}", f"auth => {keys[5]}"]
    rows = [(i, CLEAN + line + "\n" + CLEAN) for i, line in enumerate(lines)]
    for r_, key in zip(sorted(secrets.spans(documents(rows)).collect(), key=lambda x: x.doc_id), keys):
        text = dict(rows)[r_.doc_id]
        assert [text[s.start : s.end] for s in r_.spans] == [key] and r_.spans[0].kind == "novel" and r_.spans[0].novelty >= 22 and r_.base == []


def test_names_and_words_are_left_alone(spark, documents):
    found = secrets.spans(documents([(i, CLEAN) for i in range(5)])).collect()
    assert [r.spans for r in found] == [[]] * 5


def test_random_strings_without_context_are_left_alone(documents):
    r = random.Random(3)
    assert secrets.spans(documents([(1, f"checksum {drawn(r, 40)}\nthe secret\n{drawn(r, 40)}")])).first().spans == []


def test_copies_of_a_text_do_not_teach_its_secret(spark, documents):
    r = random.Random(4)
    key = drawn(r, 30, string.ascii_letters)
    found = secrets.spans(documents([(i, f"bearer {key}") for i in range(40)])).collect()
    assert all([s.kind for s in x.spans] == ["novel"] for x in found)


def test_dictionary_learns_from_all_texts(spark, documents):
    rows = [(i, f"auth{i}: frobnicator_wibble_{i} {n}") for i, n in enumerate(["alpha", "beta", "gamma", "delta"])]
    assert b"frobnicator" in secrets.learned(documents(rows), "text")
    assert b"frobnicator" not in secrets.learned(documents(rows[:2]), "text")


def test_base_spans_stay_and_others_keep_clear_of_them(documents):
    r = random.Random(5)
    text = f"token = \"{drawn(r, 40, '0123456789abcdef')}\" and auth {drawn(r, 30)} AKIA{drawn(r, 16, string.ascii_uppercase)}"
    row = secrets.spans(documents([(1, text)])).first()
    assert [tuple(s)[:3] for s in row.base] == plain(text) and [s.kind for s in row.spans] == ["assign", "hex", "novel", "access"]


def test_odd_rows(spark, documents):
    long = "password " * 200_000 + "token=abcdefgh"
    rows = [(1, None), (2, ""), (2, ""), (None, "token: abcdefg"), (3, long), (4, "a" * 3_000_000), (5, "auth " + "x1" * 400_000), (6, "secret" + " " * 500_000)]
    found = secrets.spans(documents(rows).withColumnRenamed("score", "base"))
    assert found.columns == ["doc_id", "text", "base", "spans"]
    by = sorted(((r.doc_id or 0, [tuple(s)[:3] for s in r.base]) for r in found.select("doc_id", "base").collect()))
    assert by == sorted((i or 0, plain(x)) for i, x in rows)
    assert secrets.spans(documents([])).count() == 0


def test_redaction(documents):
    text = "a token=abcdefgh1 b auth " + drawn(random.Random(6), 30) + " c"
    rows = secrets.redacted(documents([(1, text), (2, None), (3, "plain")])).orderBy("doc_id").collect()
    assert [(r.text, r.score) for r in rows] == [("a [assign] b auth [novel] c", "extra"), (None, "extra"), ("plain", "extra")]


@pytest.mark.parametrize("fixture", [0])
def test_query_has_base_digests(spark, small, fixture):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = op11_secrets(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = plain(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in own) for k in AGREED)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == [f"{k}:{a}:{b}" for k, a, b in own] and len(spans) == len(own) + r.n_added
