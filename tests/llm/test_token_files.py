import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rankloom.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["", "A", " ", "İstanbul ΣΑΣ", "<|STARTOFTEXT|> x <|endoftext|>y", "Don't WE'LL I'd 's. It's.", "日本語。", "a\x1cb \x85c", "ÀÉ. ÿß! ªº² ª º ,", "é, x", "x." * 50, "word " * 5000]


def want(texts):
    tok = Tokenizer.from_file(PATH)
    return [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library(monkeypatch):
    monkeypatch.setattr(T, "MEMO", 50)
    rng, encoder = random.Random(4), T.PieceEncoder(PATH)
    assert encoder.mirrors
    letters = "abçc \n\tÉé²1ª '.,!Ⅷs tñ ́日<|>TΣ\xa0"
    texts = HARD + ["".join(rng.choice(k) for _ in range(rng.randint(0, 40))) for _ in range(800) for k in (letters, "ab rélvstmd''.!1²_ \nTS")]
    texts += [chr(c) + chr(d) + "a" for c in range(300) for d in (32, 97, 39, 0x301, c)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        flat, counts = encoder.encode(part)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want(part)


def test_files_with_other_rules_go_to_the_library_whole():
    other = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tok = T.PieceEncoder(other), Tokenizer.from_file(other)
    flat, counts = encoder.encode(HARD)
    assert not encoder.mirrors
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [e.ids for e in tok.encode_batch(HARD, add_special_tokens=False)]


def test_round_trip(documents, clashing, tmp_path, spark):
    rows = [(i * 3 % 1000 + 1, t) for i, t in enumerate(HARD * 5)] + [(5000, None), (4, "repeated"), (4, "repeated id"), (4, "repeated"), (None, "no id"), (None, "none")]
    files = T.write_token_files(clashing(documents(rows)), PATH, f"file://{tmp_path}/out", length=32, rows=4)
    found = sorted(map(tuple, T.read_token_files(spark, files).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    ids = [x + [1] for x in want([t or "" for _, t in rows])]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((str(r[0]), r[2], r[3]) for r in found) == sorted((str(i), len(x), crc(x)) for (i, _), x in zip(rows, ids))
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()


def test_random_access(documents, tmp_path):
    rows = [(i, f"number {i} of the words") for i in range(40)]
    (tmp_path / "out").mkdir()
    (tmp_path / "out/part-000000-lost.arrow").write_text("of an attempt that died")
    files = T.write_token_files(documents(rows), PATH, f"file://{tmp_path}/out", length=16, rows=3)
    assert {p.name.split(".")[0] for p in (tmp_path / "out").iterdir()} == {f["uri"].rsplit("/", 1)[1] for f in files}
    flat = [i for f in files for k in range(-(-f["n_tokens"] // 16)) for i, m in zip(*T.TokenShard(f["uri"]).sequence(k)) if m]
    assert flat == [i for x in want([t for _, t in rows]) for i in x + [1]]
    ids, mask = T.TokenShard(files[0]["uri"]).sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata


def test_empty_table(documents, tmp_path, spark):
    files = T.write_token_files(documents([(1, "a")]).where("doc_id > 1"), PATH, f"file://{tmp_path}/out")
    assert files == [] and T.read_token_files(spark, files).count() == 0


def test_ranges_divide_repeated_ids():
    bounds = (np.array([1, 5, 5, 5, 9]), np.array([3, -4, 0, 8, 1]))
    keys = [(0, 9), (1, 2), (1, 3), (4, 0), (5, -9), (5, -4), (5, 0), (5, 7), (5, 9), (9, 0), (9, 1), (10, -9)]
    want = [sum(b <= k for b in zip(*bounds)) for k in keys]
    assert T.place(bounds, *(np.array(x) for x in zip(*keys))).tolist() == want
