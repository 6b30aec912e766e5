import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import quality as Q


def texts(n=400, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioutnslr") for _ in range(rng.randint(2, 9)))
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(8, 200))]
        good = i % 4 != 0
        if good:
            text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9))
        else:
            text = [" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join(words[:2] * len(words))][rng.randrange(3)]
        out.append((i, text, int(good)))
    return out


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame([(i, y) for i, _, y in rows] or [(0, None)], "doc_id long, quality int")


def test_held_out_scores(documents, labels, clashing):
    data = texts()
    docs = clashing(documents([(i, t) for i, t, _ in data]).withColumnRenamed("n_chars", "chars"))
    model = Q.train_quality(docs, labels([r for r in data if r[0] % 3 != 1]).unionByName(labels([])))
    found = {r.doc_id: r.score for r in Q.score_quality(docs, model, ["doc_id"]).collect()}
    held = [(found[i], y) for i, _, y in data if i % 3 == 1]
    assert np.mean([(s >= 0.5) == y for s, y in held]) >= 0.95 and all(0 <= s <= 1 for s in found.values())


def test_density_by_hand():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (200, 3)), rng.normal(1, 2, (300, 3))])
    y = np.repeat([0.0, 1.0], [200, 300])
    m = Q.QDA.fit(x, y, 0.1)
    z = (x - m.centre) / m.scale
    pooled = np.cov(z[y == 0].T, bias=True) * 0.4 + np.cov(z[y == 1].T, bias=True) * 0.6
    dens = []
    for k, share in ((0, 0.4), (1, 0.6)):
        own = z[y == k]
        s = 0.1 + 0.9 * 3 / (3 + len(own))
        cov = (1 - s) * np.cov(own.T, bias=True) + s * (0.5 * pooled + 0.5 * np.eye(3) * np.trace(pooled) / 3) + 1e-6 * np.eye(3)
        d = z - own.mean(axis=0)
        dens.append(np.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert np.allclose(m.difference(x), dens[1] - dens[0])


def test_edges(documents, labels, clashing):
    data = texts(200)
    model = Q.train_quality(documents([(i, t) for i, t, _ in data]), labels(data))
    odd = documents([(1, None), (2, ""), (3, "x" * 2_000_000), (4, "same"), (4, "same"), (5, "\n\n\n"), (None, "é" * 100)])
    found = Q.score_quality(odd, model, ["doc_id", "text"]).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2)}) == 1 and len({r.score for r in found if r.doc_id == 4}) == 1
    empty = odd.where("doc_id > 10")
    assert Q.score_quality(empty, model, ["doc_id"]).count() == 0


def test_one_class_or_no_labels(documents, labels, spark):
    docs = documents([(i, "text here") for i in range(30)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score_quality(docs, Q.train_quality(docs, none), ["doc_id"]).agg(F.max("score")).first()[0] == 0.5
    ones = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    assert Q.score_quality(docs, Q.train_quality(docs, ones), ["doc_id"]).agg(F.min("score")).first()[0] == 1.0


def test_repeated_labels_and_order(documents, labels, spark):
    data = texts(200)
    docs = documents([(i, t) for i, t, _ in data])
    twice = labels(data).unionByName(labels(data)).unionByName(spark.createDataFrame([(0, 0), (None, 1)], "doc_id long, quality int"))
    a, b = Q.train_quality(docs, labels(data)), Q.train_quality(docs.repartition(5), twice)
    assert np.allclose(a.means, b.means) and a.slope == b.slope


def plain_statistics(text):
    """The statistics as they are described, by counting over the whole text."""
    import math
    from collections import Counter

    raw = text.encode("utf-8", "replace")
    kind = lambda f: sum(n for b, n in Counter(raw).items() if f(b))
    marks = {c for c in range(33, 127) if not chr(c).isalnum()} - set(b",.:;!?|'\"-()")
    counts = [
        kind(lambda b: 65 <= b <= 90), kind(lambda b: 97 <= b <= 122), kind(lambda b: b >= 128), kind(lambda b: 48 <= b <= 57), kind(lambda b: b in (9, 11, 12, 13, 32)),
        kind(lambda b: b == 10), kind(lambda b: b in b".,:;"), kind(lambda b: b in b"!?"), kind(lambda b: b in marks), kind(lambda b: b in b"|<>"),
    ]
    n, words = max(1, sum(counts)), text.split()
    w = max(1, len(words))
    pairs = list(zip(words, words[1:]))
    shares = [sum(map(len, words)) / w + 0.1, sum(len(x) > 14 for x in words) / w + 1e-3, 1.01 - len(set(words)) / w, 1.01 - len(set(pairs)) / w, sum(a == b for a, b in pairs) / w + 1e-3, sum(x.isupper() for x in words) / w + 1e-3]
    lines = text.split("\n")
    worst = [0.0] * 4
    for line in (x for x in lines if len(x) >= 24):
        own = line.split()
        got = (sum(line.count(c) for c in "%$#&*|") / len(line), line.count("!") / len(line), sum(x.isupper() for x in own) / max(1, len(own)), 1 - len(set(own)) / len(own) if len(own) > 20 else 0)
        worst = [max(a, b) for a, b in zip(worst, got)]
    return [math.log(c / n + 1e-3) for c in counts] + [math.log1p(len(words))] + [math.log(x) for x in shares] + [math.log1p(len(lines) / w * 20)] + [math.log(x + 1e-2) for x in worst]


def test_statistics_of_the_whole_text(monkeypatch):
    rng = random.Random(3)
    odd = ["", " ", "ÉCOLE école 12 !! | <b>", "A" * 100, "word " * 3000, "a b\nc d " * 50 + "%$#" * 30, " x" * 999]
    odd += ["".join(rng.choice("ab cdE1!\n|.é ") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    for piece in (1 << 20, 7):
        monkeypatch.setattr(Q, "PIECE", piece)
        for t in odd:
            assert np.allclose(Q.statistics(t), plain_statistics(t)), t


def test_few_rows_of_a_class(documents, labels):
    """No least number of rows: with three bad ones among many, or one of each, the classes still come apart."""
    data = texts(200)
    rare = [r for r in data if r[2]] + [r for r in data if not r[2]][:3]
    for chosen in (rare, [r for r in data if r[2]][:1] + [r for r in data if not r[2]][:1]):
        docs = documents([(i, t) for i, t, _ in chosen])
        scores = {r.doc_id: r.score for r in Q.score_quality(docs, Q.train_quality(docs, labels(chosen)), ["doc_id"]).collect()}
        assert min(scores[i] for i, _, y in chosen if y) > max(scores[i] for i, _, y in chosen if not y)


def test_repeated_ids_are_cut_alike(documents, labels):
    data = [(1, f"good words of text number {i} here", 1) for i in range(300)] + [(2, "BAD!! " * (i + 1), 0) for i in range(300)]
    models = [Q.train_quality(documents([(i, t) for i, t, _ in data], partitions=p), labels([(1, "", 1), (2, "", 0)]), sample=100) for p in (2, 7)]
    assert np.array_equal(models[0].means, models[1].means) and models[0].slope == models[1].slope


def test_distinct_counts_and_bounded_memory():
    import tracemalloc

    rng, counts = np.random.default_rng(3), Q.Distinct()
    given = [rng.integers(0, 5000, 1000).astype(np.uint64) for _ in range(200)]
    for part in given:
        counts.add(part)
    assert len(counts) == len(np.unique(np.concatenate(given))) and len(Q.Distinct()) == 0
    text = " ".join(f"w{i}" for i in range(1_000_000))
    tracemalloc.start()
    Q.statistics(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 * len(text)
