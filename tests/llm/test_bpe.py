import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rankloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "a", " ", "  a", " \n x\n\n", "a\tb  c\r\n d ", "don't we'll I'D 's", "<|endoftext|>x <|endoftext|> ", "日本語テキスト 中文，标点。", "🙂🙂 emoji‍ x", "x" * 300 + " y", "ab" * 2000,
        "²³½ ١٢٣", "́combining é", "tab\t\tend ", "\n", "a \n b", "a\n b", "a\x1cb \x85c", "नमस्ते दुनिया", "ﬁ ǅ ß İ", "a" * 64, "b" * 65, " " * 70]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.ByteBPE(PATH)


def noise(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice("ab c\n\té²1 '.,!Ⅷs tñ ́日<|>\x1f") for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_and_texts_equal_the_library(own, reference):
    texts = HARD + noise(1500)
    ids = own.encode_texts(texts)
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids] == want
    decoded = own.decode_all(np.concatenate(ids), np.array([len(x) for x in ids]))
    assert decoded == [reference.decode(w, skip_special_tokens=False) for w in want] == [own.decode(w) for w in want]


def test_long_and_short_trees_agree(own):
    rng = random.Random(2)
    pieces = ["".join(rng.choice("thequickbrownfxaei") for _ in range(rng.randint(1, 64))).encode() for _ in range(300)]
    assert own.merge_many(pieces, 64) == [own.merge_long(p) for p in pieces]


def test_small_memo_and_stretches(own, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 5)
    monkeypatch.setattr(bpe, "STRETCH", 11)
    fresh, texts = bpe.ByteBPE(PATH), HARD + noise(200, 1)
    for at in range(0, len(texts), 20):
        part = texts[at : at + 20]
        assert [x.tolist() for x in fresh.encode_texts(part)] == [e.ids for e in reference.encode_batch(part, add_special_tokens=False)]


def test_bytes_that_are_no_text(own, reference):
    ids = [int(i) for i in own.byte_ids[[0xE2, 0x82, 0x41, 0xFF]]]
    assert own.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_operator(documents, clashing, reference):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(1, "a"), (1000, None), (1001, "long words here " * 20_000)]
    found = {r.doc_id: r for r in bpe.encode_decode(clashing(documents(rows)), PATH).collect()}
    for i, t in rows:
        assert found[i].ids == reference.encode(t or "", add_special_tokens=False).ids and found[i].decoded == (t or "")
    assert bpe.encode_decode(documents([(1, "a")]).where("doc_id > 1"), PATH).count() == 0


def test_digests(documents):
    import hashlib

    row = bpe.token_digests(bpe.encode_decode(documents([(7, None)]), PATH)).first()
    assert tuple(row) == (7, 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())


def test_null_and_repeated_ids(documents):
    rows = [(None, "alpha"), (None, None), (1, "alpha beta"), (1, "alpha beta"), (1, "other")]
    got = sorted((str(r.doc_id), r.decoded) for r in bpe.encode_decode(documents(rows), PATH).collect())
    assert got == sorted((str(i), t or "") for i, t in rows)
