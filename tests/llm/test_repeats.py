import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm.repeats import KEY, least, levels, repeated_windows, windows, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, length):
    """(n_words, n_removed, kept words) of each text, windows as tuples."""
    texts = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def check(docs, rows, length, shortest):
    got = {r.doc_id: r for r in without_repeats(docs, length, shortest).collect()}
    for i, (n, removed, kept) in enumerate(plain(rows, length)):
        r = got[i]
        assert (r.n_words, r.n_removed) == (n, removed), rows[i]
        assert r.kept == kept if removed else r.kept is None
        assert removed or r.digest == hashlib.sha256(kept.encode()).hexdigest()
    assert len(got) == len(rows)


@pytest.mark.parametrize("length, shortest", [(35, 10), (7, 2), (4, 10), (1, 1)])
def test_against_counted_windows(spark, documents, clashing, length, shortest):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 2)))
    some = lambda n: [word() for _ in range(n)]
    passage, rows = some(length + 5), ["", None, "one", " \t\n ", "a " * 200, "a b " * 100, "a b " * 100]
    for _ in range(40):
        parts = [some(rng.randint(0, 60))]
        if rng.random() < 0.5:
            cut = rng.randint(0, 8)
            parts += [passage[cut:], some(rng.randint(0, 9)), passage[: len(passage) - cut]]
        rows.append(rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    rows += rows[-3:]
    check(clashing(documents(list(enumerate(rows)), partitions=5)), rows, length, shortest)


def test_a_hot_passage_and_hot_copies(spark, documents):
    rng = random.Random(1)
    passage, copy = " ".join(f"p{i}" for i in range(40)), " ".join(f"c{i}" for i in range(50))
    rows = [f"{rng.random()} {passage} {rng.random()}" for _ in range(300)] + [copy] * 300 + [" ".join(f"{rng.random()}" for _ in range(40)) for _ in range(60)]
    check(documents(list(enumerate(rows)), partitions=7), rows, 35, 10)


def test_no_candidates_survive_a_level(spark, documents):
    rows = [" ".join(f"w{i}-{d}" if i % 12 == 0 else f"w{i}" for i in range(60)) for d in range(3)]  # 11 words repeat, 18 never
    docs = documents(list(enumerate(rows)))
    found, lost = repeated_windows(docs)
    assert lost.count() == 0 and found.count() == 3
    check(docs, rows, 35, 10)


def test_null_ids_and_no_rows(spark, documents):
    text = " ".join(map(str, range(36)))
    got = without_repeats(documents([(None, text), (None, text), (None, None), (7, "x")])).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (1, 0), (36, 36), (36, 36)]
    assert without_repeats(documents([(1, "x")]).limit(0)).count() == 0


def test_lengths_double():
    assert levels(35, 10) == [9, 18, 35] and levels(8, 10) == [8]
    for n in range(1, 200):
        own = levels(n, 5)
        assert own[-1] == n and all(a < b <= 2 * a for a, b in zip(own, own[1:]))


def test_windows_and_their_least():
    words = np.array([random.Random(i % 5).getrandbits(64) for i in range(40)], np.uint64)
    for n in (1, 2, 3, 7, 35):
        h = windows(words, n, 0)
        assert len(h) == 41 - n and len(set(h.tolist())) == min(5, len(h))
        assert (h[:-5] == h[5:]).all()
    h = np.array([3, 1, 1, 2, 0, 5, 0], np.uint64)
    assert least(h, 3).tolist() == [1, 1, 4, 4, 4]


def test_copies_are_read_once(spark, documents):
    text = " ".join(map(str, range(50)))
    rows, lost = repeated_windows(documents([(i, text) for i in range(20)]))
    assert [(r.copies, r.kept) for r in lost.collect()] == [(20, "")] and rows.select(*KEY).distinct().count() == 1
    assert rows.select(F.size("hs").alias("n")).first().n < 16  # a fraction of the 42 short windows
