import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rankloom.llm import near_copies as N
from tests.llm.test_simhash import plain_fingerprint


def plain_set(text, width=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_labels(sets):
    label = list(range(len(sets)))
    for i, j in combinations(range(len(sets)), 2):
        if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    return label


def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeioutnslr") for _ in range(7))
    rows, passage = [], " ".join(word() for _ in range(60))
    for i in range(40):
        words = [word() for _ in range(rng.randint(60, 300))]
        rows.append((i, " ".join(words)))
        for k, edits in enumerate((1, 2, 4, 9)):
            v = list(words)
            for _ in range(edits):
                v[rng.randrange(len(v))] = word()
            rows.append((100 * (k + 1) + i, " ".join(v)))
    return rows + [(900 + i, f"{passage} {' '.join(word() for _ in range(40))}") for i in range(30)]


def test_the_stage_drops_planted_near_copies(spark, documents, clashing):
    rows = planted()
    label = plain_labels([plain_set(t) for _, t in rows])
    want = sorted(min(rows[j][0] for j in range(len(rows)) if label[j] == x) for x in set(label))
    docs = clashing(documents(rows))
    found = pipeline.drop_near(spark, docs, "")
    assert found.columns == docs.columns and sorted(r.doc_id for r in found.collect()) == want
    fps = [plain_fingerprint(t) for _, t in rows]
    far = [(i, j) for i, j in combinations(range(len(rows)), 2) if jaccard(plain_set(rows[i][1]), plain_set(rows[j][1])) >= 0.8 and (fps[i] ^ fps[j]).bit_count() > 3]
    assert len(far) > 10  # pairs that three-word fingerprints of radius 3 leave in


def test_small_blocks_give_the_same(documents):
    docs = documents(planted())
    ids = lambda **x: sorted(r.doc_id for r in N.drop_near_duplicates(docs, **x).collect())
    assert ids(block=3, weight=200) == ids()


def test_rows_that_repeat(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(7, text, 1), (7, text, 2), (7, text + " more", 3), (None, text + " tail", 4), (7, "another text under the id", 5), (None, "null id", 6), (9, None, 7), (8, "", 8), (10, " ", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").withColumns({c: F.lit(3) for c in ("id", "key", "hit", "row", "fp", "kept", "stays", "_bucket")})
    found = sorted((r.doc_id is None, r.doc_id, r.extra) for r in N.drop_near_duplicates(docs).collect() if r.doc_id is not None)
    assert [x[1] for x in found] == [7, 7, 8] and {x[2] for x in found} - {1, 2, 3} == {5, 8}
    assert [r.extra for r in N.drop_near_duplicates(docs).collect() if r.doc_id is None] == [6]


def test_shingle_sets():
    text = "a b c d e f g a b c d e f g h"
    assert len(N.shingle_set(text)) == len(plain_set(text)) and len(N.shingle_set(" \t")) == 0 and len(N.shingle_set("one two")) == 1
    assert N.shingle_set("one two") != N.shingle_set("one")
    rng = random.Random(2)
    for _ in range(200):
        a, b = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert len(np.intersect1d(N.shingle_set(a), N.shingle_set(b))) == len(plain_set(a) & plain_set(b))


def test_bands_propose_what_is_similar():
    rng = random.Random(5)
    missed = 0
    for _ in range(300):
        own = [rng.getrandbits(64) for _ in range(90)]
        a, b = (np.unique(np.array(own[:80] + [rng.getrandbits(64) for _ in range(10)], np.uint64)) for _ in range(2))
        missed += not np.any(N.band_keys(a) == N.band_keys(b))
    assert missed == 0


def test_very_many_equal_rows(documents, spark):
    """A null id and an empty text, over and over: one row stays, and so do all texts beside it."""
    from rankloom.llm.near_copies import drop_near_duplicates

    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (2, text + " w60"), (3, "other words of its own here")])
    docs = docs.unionByName(spark.range(5000).selectExpr("cast(null as long) doc_id", "'' text", "'en' lang", "'s' source", "0L n_chars"))
    assert sorted((r.doc_id or 0) for r in drop_near_duplicates(docs).collect()) == [0, 1, 3]


def test_rows_of_no_bucket_meet_no_join_for_a_hot_one(spark, tmp_path):
    """One hot bucket: the rows without a bucket are told apart by a filter, and every bucket keeps all its rows."""
    rows = [(i, 7 if i < 600 else 8 if i < 603 else i) for i in range(3000)]
    spread = spark.createDataFrame(rows, "fp long, group long")
    shared = spark.createDataFrame([(7, 600), (8, 3)], "group long, rows long")
    found = N.in_buckets(spread, shared, 30_000)
    assert sorted(map(tuple, found.select("fp", "group", "rows").collect())) == [(i, g, 600 if g == 7 else 3) for i, g in rows[:603]]
    assert "LeftAnti" not in found._jdf.queryExecution().toString()
