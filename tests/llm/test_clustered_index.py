import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import clustered_index
from rankloom.llm.clustered_index import Lists, bisected, build_index, fitted, ordered, ratio, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, doc, score) by scoring every document."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(rng, n):
    words = [f"w{i}" for i in range(60)] + ["été", "中文"]
    rows = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 40))).replace("w1 ", "W1, ")) for i in range(n)]
    return rows + [(n + i, rows[i % 7][1]) for i in range(30)] + [(n + 40, None), (n + 41, ""), (n + 42, " .,-"), (n + 43, "w0 " * 3000), (None, rows[3][1]), (None, rows[3][1]), (5, "w3 w4")]


ITEMS = [(1, "w0 w1 w2"), (2, "W59 é été"), (3, None), (4, ""), (5, "nowhere to be found"), (6, " ".join(f"w{i}" for i in range(60))), (7, "中文 中文"), (7, "w7")]


@pytest.mark.parametrize("shard_docs, cells, k", [(8192, 64, 50), (40, 4, 5), (3, 1, 3)])
def test_against_scoring_every_document(spark, documents, clashing, shard_docs, cells, k):
    rng = random.Random(shard_docs)
    rows = made(rng, 300)
    docs = clashing(documents(rows, partitions=6))
    queries = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    index, n = build_index(docs, shard_docs=shard_docs, most_cells=cells, cluster=8)
    assert n == sum(bool(terms(t)) for _, t in rows)
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in search(index, n, queries, k=k, cluster=8).collect()]
    assert sorted(got, key=str) == plain(rows, ITEMS, k)


def test_no_documents_and_no_queries(spark, documents):
    queries = spark.createDataFrame(ITEMS, "item_id long, text string")
    index, n = build_index(documents([(1, "a")]).limit(0))
    assert n == 0 and search(index, n, queries).count() == 0
    index, n = build_index(documents([(1, "w0 w1")]))
    assert n == 1 and search(index, n, queries.limit(0)).count() == 0


def test_an_index_serves_more_than_one_search(spark, documents):
    rows = made(random.Random(2), 50)
    index, n = build_index(documents(rows), shard_docs=20)
    for items in (ITEMS[:2], ITEMS[5:6]):
        got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in search(index, n, spark.createDataFrame(items, "item_id long, text string")).collect()]
        assert sorted(got, key=str) == plain(rows, items, 50)


def topics(rng, n):
    """Documents of two topics in turn, as (term, doc) postings."""
    pairs = [(t, d) for d in range(n) for t in {rng.randint(0, 30) + 31 * (d % 2) for _ in range(12)}]
    return tuple(np.array(x) for x in zip(*pairs))


def test_bisection_parts_topics():
    term, doc = topics(random.Random(3), 200)
    second, d1, d2 = bisected(term, doc, 200)
    halves = [set((np.flatnonzero(second == s) % 2).tolist()) for s in (False, True)]
    assert second.sum() == 100 and all(len(h) == 1 for h in halves)
    assert (d1 + d2 == np.bincount(term)).all() and (d2 == np.bincount(term[second[doc]], minlength=62)).all()


def gaps(term, doc, place):
    out = 0.0
    for t in set(term.tolist()):
        own = np.sort(place[doc[term == t]])
        out += np.log2(np.diff(own, prepend=-1)).sum()
    return out


def test_order_costs_less_and_keeps_every_document():
    term, doc = topics(random.Random(4), 256)
    order = ordered(term, doc, 256, 16)
    place = np.argsort(order)
    assert sorted(order.tolist()) == list(range(256)) and gaps(term, doc, place) < 0.9 * gaps(term, doc, np.arange(256))
    assert ordered(np.zeros(0, int), np.zeros(0, int), 5, 2).tolist() and sorted(ordered(np.zeros(0, int), np.zeros(0, int), 5, 2).tolist()) == list(range(5))


def test_the_upper_tree_sends_topics_apart():
    rng = random.Random(5)
    docs = [np.unique([rng.randint(0, 30) + 100 * (d % 2) for _ in range(12)]) for d in range(64)]
    tree = fitted(docs, 2)
    sides = [tree[0][d].sum() > 0 for d in docs]
    assert tree.shape == (3, clustered_index.BUCKETS) and len(set(sides[::2])) == 1 and set(sides[::2]) != set(sides[1::2])
    assert fitted([], 1).tolist() == np.zeros((1, clustered_index.BUCKETS)).tolist()


def test_clusters_that_cannot_reach_are_left():
    n, cluster = 1000, 10
    lists = Lists(np.arange(n), np.zeros(n, bool), np.full(n, 100), cluster)
    lists.add(b"rare", np.arange(500, 520), np.full(20, 9))
    lists.add(b"common", np.arange(n), np.ones(n, int))
    places, scores = lists.best([b"rare", b"common"], [100, 1], 0, 5)
    assert places.tolist() == [500, 501, 502, 503, 504] and lists.visited < 10
    want = 100 * int(ratio(np.array([9]), np.array([100]))[0]) + int(ratio(np.array([1]), np.array([100]))[0])
    assert scores.tolist() == [want] * 5
    assert lists.best([b"common"], [1], 10**12, 5)[0].tolist() == []
