import random

import numpy as np

from rankloom.llm import langid as L

WORDS = {"aa": "lorem ipsum dolor amet sit", "bb": "der die das und nicht", "cc": "привет мир это слова"}


def rows(n=240, seed=0):
    rng = random.Random(seed)
    langs = sorted(WORDS)
    out = []
    for i in range(n):
        g = langs[i % 3]
        out.append((i, " ".join(rng.choice(WORDS[g].split()) for _ in range(rng.randint(5, 60))), g, "s"))
    return out


def model(documents):
    return L.train_languages(documents(rows()), sample=200, bits=12)


def test_held_out_accuracy_and_edges(documents, clashing):
    m = model(documents)
    assert m.languages == ["aa", "bb", "cc"] and 0 < m.temperature and 0 <= m.threshold <= 1
    fresh = [(i, t, g, s) for i, t, g, s in rows(90, seed=9)]
    odd = [(1000, None, None, None), (1001, "", None, None), (1002, "12 .. 345!", None, None), (1003, "Der " * 500_000, "bb", "s"), (1003, "lorem", "aa", "s")]
    docs = clashing(documents(fresh + odd)).withColumnRenamed("score", "score_")
    found = L.predict_languages(docs, m, ["doc_id", "lang"]).collect()
    assert len(found) == len(fresh) + len(odd)
    for r in found:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == r.lang and 0.3 < r.score <= 1


def test_averages_by_hand(documents):
    m = model(documents)
    texts = ["lorem und мир", "a", "Die das! nicht 1", "x y"]
    got = m.logits(texts)
    for t, z in zip(texts, got):
        at, share = L.counted(t, m.bits)
        assert np.allclose(z, (m.scores[at] * share[:, None]).sum(axis=0) + m.bias, atol=1e-4)


def test_pieces_count_each_subword_once(monkeypatch):
    text = "lorem ipsum привет " * 40
    whole = L.counted(text, 12)
    monkeypatch.setattr(L, "PIECE", 50)
    cut = L.counted(text, 12)
    assert np.array_equal(whole[0], cut[0]) and np.allclose(whole[1], cut[1])


def test_training_is_repeatable(documents):
    a, b = model(documents), L.train_languages(documents(rows(), partitions=5), sample=200, bits=12)
    assert np.array_equal(a.scores, b.scores) and a.threshold == b.threshold


def test_nothing_to_learn(documents):
    m = L.train_languages(documents([(1, "text", None, None), (2, "123", "aa", None)]), bits=10)
    found = L.predict_languages(documents([(1, "text")]), m, ["doc_id"]).first()
    assert (found.lang_pred, found.score) == ("und", 0.0)
    empty = documents([(1, "a")]).where("doc_id > 1")
    assert L.train_languages(empty, bits=10).languages == [] and L.predict_languages(empty, m, ["doc_id"]).count() == 0


def test_strangers_are_rejected(documents):
    m = model(documents)
    _, score, rejected = m.predict(["zzz qqq xxx kkk www yyy", "lorem ipsum dolor amet sit lorem ipsum"])
    assert score[0] < score[1] and not rejected[1]


def plain_shares(text, bits):
    """Subwords as they are described: every 2, 3 and 4 bytes from each place, letters alone, hashed one by one."""
    from collections import Counter

    low = b" " + bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in text.lower().encode()) + b"   "
    counts = Counter()
    for at in range(len(low) - 3):
        for n, factor, add in ((2, 2246822519, 1), (3, 3266489917, 2), (4, 668265263, 3)):
            value = int.from_bytes(low[at : at + n], "big")
            counts[((value * factor + add) * 2654435761 % (1 << 32)) >> (32 - bits)] += 1
    return {b: n / sum(counts.values()) for b, n in counts.items()}


def test_subwords_one_by_one():
    for text in ("", "a", "Lorem ipsum, 12 dolor!", "Привет мир", "x" * 50, "ß²½ Ⅷ"):
        at, share = L.counted(text, 12)
        want = plain_shares(text, 12)
        assert dict(zip(at.tolist(), share.tolist())).keys() == want.keys() and np.allclose([want[b] for b in at.tolist()], share)


def test_numerals_are_no_letters(documents):
    m = model(documents)
    found, score, _ = m.predict(["²", "½ Ⅷ ³", "12", "² a", None, "ª"])
    assert found[:3] == ["und"] * 3 and found[4] == "und" and "und" not in (found[3], found[5]) and score[0] == 0


def test_repeated_and_null_ids(documents):
    data = [(1, f"lorem ipsum {i}", "aa", "s") for i in range(200)] + [(None, f"der die {i}", "bb", "s") for i in range(200)] + [(3, "dolor amet", "aa", "s")] * 50
    a, b = (L.train_languages(documents(data, partitions=p), sample=60, bits=10) for p in (2, 7))
    assert np.array_equal(a.scores, b.scores) and a.threshold == b.threshold


def test_calibration_holds_out_every_fifth_row_of_a_language():
    """However few rows there are, and no language loses its only ones."""
    rows = [(g, *L.counted(f"{g} {w} {w} text {i}", 10)) for g, w, n in (("aa", "lorem", 12), ("bb", "ipsum", 3)) for i in range(n)]
    model = L.train_sgd(rows, 10)
    assert model.languages == ["aa", "bb"] and model.predict(["bb ipsum ipsum text"])[0] == ["bb"]


def test_many_languages_take_bounded_memory():
    import tracemalloc

    model = L.LanguageModel([f"l{i:03d}" for i in range(200)], np.random.default_rng(1).normal(size=(1 << 10, 200)).astype(np.float32), np.zeros(200), 10)
    text = "some words of a text " * 20_000
    tracemalloc.start()
    whole = model.logits([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    small = L.LanguageModel(model.languages[:3], model.scores[:, :3], np.zeros(3), 10)
    assert peak < 150_000_000 and np.allclose(whole[0, :3], small.logits([text])[0], atol=1e-5)
