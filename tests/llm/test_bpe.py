import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cotejo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0  abcZ'sÀé09९²!?́😀漢<|endoftext|> '"


def texts():
    r = random.Random(1)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) + "<|endoftext|>" * (r.random() < 0.2) + "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 9))) for _ in range(1500)]
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 14))) for _ in range(400)]
    return [*out, *(" ".join(r.choices(words, k=80)) for _ in range(20)), "a" * 3000, "ab" * 700 + "  x", "it's we'll", "word, word. word.", " ", "", "x" * 95, "x" * 97]


def test_ids_and_text_equal_the_library():
    model, library = bpe.Encoder(bpe.load(PATH)), Tokenizer.from_file(PATH)
    for x in texts():
        ids = list(memoryview(model.encode(x)).cast("I"))
        assert ids == library.encode(x, add_special_tokens=False).ids, x
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False), x


def test_scan_and_heap_merge_alike():
    model = bpe.load(PATH)
    r = random.Random(2)
    for _ in range(300):
        parts = [model["single"][r.choice(b"etaoinshr ")] for _ in range(r.randint(2, 60))]
        assert bpe.merge_short(list(parts), model["ranks"], model["wholes"]) == bpe.merge_long(list(parts), model["ranks"], model["wholes"])


def test_rows(documents, spark):
    docs = documents([(1, "hello world"), (2, None), (3, ""), (None, "x"), (1, "hello world")])
    rows = bpe.encode_decode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in rows) == [(0, 1, "x"), (1, 2, "hello world"), (1, 2, "hello world"), (2, 0, ""), (3, 0, "")]
    assert rows[0].score == "extra"
    digest = bpe.digests(docs, PATH).where("doc_id = 2").first()
    assert digest.ids_sha256 == digest.decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|><|endoftext|> b"])
def test_special_strings_are_one_id(text):
    ids = list(memoryview(bpe.Encoder(bpe.load(PATH)).encode(text)).cast("I"))
    assert ids.count(50256) == text.count("<|endoftext|>")
