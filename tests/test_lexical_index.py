"""The stored inverted index: the same with and without pruning, fewer postings read, built once."""

import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import lexical as L
from rankloom.operators import lexical_index as I
from rankloom.sources import scratch


def made(rng, entries=120, terms=30):
    """(entry, code, term, weight): weights of both signs, many ties, codes with several entries."""
    return [(e, e // 2 if e % 5 else None, f"t{t}", rng.choice([0.5, 1.0, 2.0, -1.0, rng.random()])) for e in range(entries) for t in rng.sample(range(terms), rng.randint(1, 6))]


def brute(rows, queries, k):
    best = {}
    for q, terms, weights in queries:
        scores = {}
        for e, c, t, w in rows:
            if t in terms:
                scores[e, c] = scores.get((e, c), 0.0) + sum(x for s, x in zip(terms, weights) if s == t) * w
        for (e, c), x in scores.items():
            best[q, c] = max(best.get((q, c), -1e300), round(x, 6))
    out = set()
    for q in {q for q, _ in best}:
        own = sorted(((-s, c) for (p, c), s in best.items() if p == q))[:k]
        out |= {(q, c, -s, rank) for rank, (s, c) in enumerate(own)}
    return out


@pytest.mark.parametrize("block", [1000, 17, 5])
@pytest.mark.parametrize("prune", [True, False])
def test_equal_to_adding_up_everything(spark, block, prune):
    rng = random.Random(block)
    rows = [r for r in made(rng) if r[1] is not None]
    queries = [(i, [f"t{t}" for t in rng.sample(range(34), 4)], [rng.choice([1.0, 0.25, -2.0]) for _ in range(4)]) for i in range(40)]
    found = L.match(spark.createDataFrame(queries, "query long, terms array<string>, weights array<double>"), spark.createDataFrame(rows, "entry long, code long, term string, weight double"), 3, block=block, prune=prune)
    got, want = {tuple(r) for r in found.select("query", "code", "score", "rank").collect()}, brute(rows, queries, 3)
    assert {(q, c, rank) for q, c, _, rank in got} == {(q, c, rank) for q, c, _, rank in want}
    assert sorted(s for *_, s, _ in got) == pytest.approx(sorted(s for *_, s, _ in want))


def test_pruning_reads_fewer_postings():
    rng = random.Random(1)
    entries = [(e, ["common", *(["rare"] if 300 <= e < 310 else [])], [rng.random() / 10, *([5.0] if 300 <= e < 310 else [])]) for e in range(4000)]
    table = pa.table({"code": pa.array([e for e, *_ in entries], pa.int64()), "terms": [t for _, t, _ in entries], "weights": [w for *_, w in entries]})
    rows = pa.Table.from_batches([b.cast(pa.schema([f.with_nullable(True) for f in b.schema])) for b in I._block_rows(0, table, 64)])
    block, whole = I.Block(rows), I.Block(rows)
    ids = [block.terms.to_pylist().index(t) for t in ("rare", "common")]
    import numpy as np

    a, b = block.best(np.array(ids), np.ones(2), 5), whole.best(np.array(ids), np.ones(2), 5, prune=False)
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
    assert whole.read == 4010 and block.read <= 16 * 64 + 10


def test_other_blocks_are_asked_only_if_they_can_reach(spark):
    rows = [(e, e, "w", 10.0 if e < 20 else 0.1) for e in range(400)] + [(e, e, f"own{e % 7}", 1.0) for e in range(400)]
    index = L.stored_index(spark.createDataFrame(rows, "entry long, code long, term string, weight double"), f"indexes/test-{uuid.uuid4().hex}", block=50)
    queries = spark.createDataFrame([(1, ["w"]), (2, ["own3", "nowhere"]), (3, ["nowhere"])], "query long, terms array<string>")
    found = I.bounds(index, queries, "once").collect()
    assert {r["query"] for r in found} == {1, 2} and len({r.block for r in found}) == index.blocks == 8
    got = L.match(queries, index, 4, "once").orderBy("query", "rank").collect()
    assert [(r["query"], r.code) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 3), (2, 10), (2, 17), (2, 24)]


def test_bm25_of_text_in_blocks(spark):
    rng = random.Random(3)
    texts = [(i, i // 2, " ".join(rng.choices("alpha beta gamma delta epsilon zeta eta".split(), [40, 20, 10, 5, 3, 2, 1], k=rng.randint(0, 12)))) for i in range(150)]
    entries = spark.createDataFrame(texts, "entry long, code long, text string")
    queries = L.query_terms(spark.createDataFrame([(0, "Alpha eta"), (1, "zeta zeta"), (2, ""), (3, None)], "query long, text string"))
    ways = [sorted(map(tuple, L.match(queries, L.lexical_index(entries), 10, "once", block=b, prune=p).collect())) for b, p in ((1000, False), (1000, True), (20, True))]
    assert ways[0] and ways[0] == ways[1] == ways[2]


def test_nothing_indexed_and_built_once(spark):
    schema, name = "entry long, code long, term string, weight double", f"indexes/test-{uuid.uuid4().hex}"
    queries = spark.createDataFrame([(1, ["a"])], "query long, terms array<string>")
    assert L.match(queries, spark.createDataFrame([], schema), 3, "once").count() == 0
    rows = spark.createDataFrame([(1, 1, "a", 1.0)], schema)
    index = L.stored_index(rows, name)
    again = L.stored_index(rows.where(F.lit(False)), name)
    assert index == again and scratch.exists(spark, f"{index.root}/lists/_SUCCESS")
    assert L.match(queries, again, 3, "once").count() == 1
