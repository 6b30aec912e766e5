"""The stored vector index: the same as comparing everything, few blocks opened, built once."""

import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.operators import vector_index as I
from rankloom.operators import vectors as V
from rankloom.sources import scratch


def rows(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")


def brute(queries, index, k, decimals, exclude):
    out = set()
    for q, v in queries:
        sims = [(-round(float(np.dot(v, w)), decimals), i) for i, w in index if not (exclude and i == q)]
        out |= {(q, rank, i) for rank, (_, i) in enumerate(sorted(sims)[:k])}
    return out


@pytest.mark.parametrize("seed, block, decimals, exclude", [(0, 7, 6, True), (1, 25, 1, False), (2, 10_000, 6, False), (3, 3, 0, True)])
def test_equal_to_comparing_everything(spark, seed, block, decimals, exclude):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, 6)) * 3
    vectors = np.round(np.concatenate([c + rng.normal(size=(30, 6)) / 4 for c in centres] + [np.zeros((2, 6)), np.ones((4, 6))]), 3)
    index = rows(spark, vectors)
    found = V.nearest(index, index, 6, decimals=decimals, exclude_self=exclude, block=block)
    assert {(r["query"], r["rank"], r["id"]) for r in found.collect()} == brute(list(enumerate(vectors)), list(enumerate(vectors)), 6, decimals, exclude)


def test_far_cells_are_not_opened(spark):
    rng = np.random.default_rng(4)
    centres = np.eye(8) * 10
    index = rows(spark, np.concatenate([c + rng.normal(size=(50, 8)) / 10 for c in centres]))
    stored = V.stored_index(index, f"indexes/test-{uuid.uuid4().hex}", block=50)
    queries = V.indexable(rows(spark, centres)).withColumn("known", F.lit(None).cast("double"))
    first = I.visits(stored, queries, 6, True)
    total = int(stored.blocks.sum())
    assert 8 <= total <= 20 and first.select("id").distinct().count() == 8
    known = I.search(stored, V.indexable(rows(spark, centres)), 5).where("rank = 4").select(F.col("query").alias("id"), F.col("sim").alias("known"))
    later = I.visits(stored, queries.drop("known").join(known, "id").select("id", "v", "known"), 6, False)
    assert first.count() + later.count() <= 2 * total < 8 * total  # every block for every query would be 8 * total
    assert I.visits(stored, queries, 6, False).count() + first.count() == 8 * total  # nothing known: all


def test_index_rows_travel_once(spark):
    """Only queries are shuffled in a search: no exchange stands above a scan of the index."""
    index = V.stored_index(rows(spark, np.eye(4)), f"indexes/test-{uuid.uuid4().hex}", block=2)
    plan = I._answered(index, I.visits(index, V.indexable(rows(spark, np.eye(4))).withColumn("known", F.lit(None).cast("double")), 6, True), 3, 6, False)._jdf.queryExecution().toString()
    assert "blocks" not in plan and "parquet" not in plan.lower()


def test_built_once_and_whole_or_not_at_all(spark):
    built, name = [], f"indexes/test-{uuid.uuid4().hex}"
    index = rows(spark, np.eye(3))

    def build(half):
        built.append(half)
        I.build_index(V.indexable(index), half)

    path = scratch.stored(spark, name, build)
    assert scratch.stored(spark, name, build) == path and len(built) == 1 and scratch.exists(spark, f"{path}/blocks/_SUCCESS")
    with pytest.raises(ZeroDivisionError):
        scratch.stored(spark, f"{name}-failed", lambda half: 1 / 0)
    assert not scratch.exists(spark, f"{scratch.shared_folder(spark)}/{name}-failed")


def test_no_rows(spark):
    none, some = rows(spark, np.eye(3)).limit(0), rows(spark, np.eye(3))
    assert V.nearest(some, none, 3).count() == 0 and V.nearest(none, some, 3).count() == 0


def test_stamp_follows_files(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    one = scratch.stamp(spark, str(tmp_path / "t"))
    assert one == scratch.stamp(spark, str(tmp_path / "t")) != scratch.stamp(spark, str(tmp_path / "t"), block=3)
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "t"))
    assert scratch.stamp(spark, str(tmp_path / "t")) != one


def test_routing_hands_on_bounded_batches():
    """Queries that ask every block of a large index are not copied for all of them at once."""
    rng, cells = np.random.default_rng(5), 120
    index = I.VectorIndex("", "bigint", rng.normal(size=(cells, 64)), np.full(cells, 9.0), np.full(cells, 9.0), np.where(np.arange(cells) % 2, 1, 2))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(list(rng.normal(size=(1000, 64)))), pa.array([None] * 1000, pa.float64())], ["id", "v", "known"])
    out = list(I.routed(index, iter([batch]), 6, False))
    assert max(b.nbytes for b in out) < 10_000_000 and sum(b.num_rows for b in out) > 1000 * 175
    best = index.bounds(I.matrix(batch.column(1)), 6).argmax(axis=1)
    got = {x for b in out for x in zip(*(b.column(i).to_pylist() for i in (2, 0, 1)))}
    assert got == {(q, c, s) for q in range(1000) for c in range(cells) if c != best[q] for s in range(index.blocks[c])}


def best(vectors, queries, own, k, decimals):
    sims = np.round(queries @ vectors.T, decimals) + 0.0
    out = []
    for q, row in enumerate(sims):
        places = [c for c in np.lexsort((np.arange(len(row)), -row)) if c != own[q]][:k]
        out += [(q, int(c), row[c]) for c in places]
    return out


@pytest.mark.parametrize("name, decimals", [("spread", 6), ("copies", 6), ("hot", 6), ("coarse", 0), ("scales", 6), ("tiny", 6), ("huge", 2), ("zeros", 6)])
def test_candidates_hold_the_best(monkeypatch, name, decimals):
    """What products in single precision leave out is not among the best, whatever the lengths and ties."""
    monkeypatch.setattr(I, "TILE", 100)
    monkeypatch.setattr(I, "QUERIES", 16)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(730, 12))
    if name == "copies":
        v[300:] = v[np.arange(430) % 300]
    elif name == "hot":
        v[::2] = v[0]
    elif name == "coarse":
        v = np.floor(v)
    elif name == "scales":
        v *= 10.0 ** rng.integers(-6, 7, size=(730, 1))
    elif name == "tiny":
        v *= 1e-170
    elif name == "huge":
        v[5:9] *= 1e151
    elif name == "zeros":
        v[100:400] = 0
    own = np.where(np.arange(60) % 4 == 3, np.nan, np.arange(60))
    ids, queries, qids = pa.array(np.arange(730) * 2), v[:60], pa.array([60_000 + q if np.isnan(i) else 2 * q for q, i in enumerate(own)])

    def found(least):
        out = I.similar(I.Block(ids, v), qids, pa.array(list(queries)), pa.array(least, from_pandas=True), 5, decimals, True)
        return sorted(zip(*(out[c].to_pylist() for c in ("query", "id", "sim"))))

    want = sorted((qids[q].as_py(), 2 * c, s) for q, c, s in best(v, queries, own, 5, decimals))
    got = found(np.full(60, np.nan))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], rtol=1e-9, atol=0)
    third = {q: sorted((s for x, _, s in got if x == q), reverse=True)[2] for q, _, _ in got}
    known = {q: s if q % 14 else -np.inf for q, s in third.items()}  # but of every seventh query
    reach, some = {x for x in got if x[2] >= known[x[0]]}, set(found(np.array([known[q.as_py()] for q in qids])))
    assert reach <= some <= set(got) and (name == "huge" or reach == some)  # lengths of 1e151 beside 1 leave room for rounding


def test_few_pairs_are_compared_in_doubles(monkeypatch):
    """A product and a look at it a pair: no sort and no rounding of what can't be among the best, also beside copies."""
    rng, pairs = np.random.default_rng(7), []
    v = rng.normal(size=(20_000, 16))
    v[10_000:] = v[:10_000]
    monkeypatch.setattr(I, "best_rows", lambda sims, k, f=I.best_rows: pairs.append(sims.size) or f(sims, k))
    out = I.similar(I.Block(pa.array(np.arange(20_000)), v), pa.array(np.arange(300)), pa.array(list(v[:300])), pa.nulls(300, pa.float64()), 10, 6, True)
    assert out.num_rows == 3000 and sum(pairs) == 0


def test_later_visits_return_what_reaches_the_known(spark):
    """Rows below a query's k-th similarity so far are not handed on to be ranked."""
    vectors = np.array([[1.0, 0], [0.9, 0], [0.5, 0], [0.2, 0]])
    index = V.stored_index(rows(spark, vectors), f"indexes/test-{uuid.uuid4().hex}")
    queries = V.indexable(rows(spark, vectors[:1])).withColumn("known", F.lit(0.9))
    found = I._answered(index, I.visits(index, queries, 6, True), 3, 6, False).collect()
    assert sorted(r["id"] for r in found) == [0, 1]
