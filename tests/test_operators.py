"""Hand-made cases: ties, empty groups, missing rows, and what SQL can't say."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import bands as B
from rankloom.operators import checks as K
from rankloom.operators import corpus as C
from rankloom.operators import curves as V
from rankloom.operators import evaluation as E
from rankloom.operators import fusion as U
from rankloom.operators import prior as P
from rankloom.operators import rerank as R
from rankloom.operators import training as O
from rankloom.operators import vectors as X
from rankloom.operators.ranking import rank_by, restrict


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def lists(spark, *rows):
    return frame(spark, rows, "record_id long, source string, rank int, code string, score double")


def test_ranks_break_ties_by_code(spark):
    df = frame(spark, [(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "q long, code string, score double")
    assert [r.code for r in rank_by(df, ["q"], [F.desc("score"), F.col("code")]).orderBy("rank").collect()] == ["c", "a", "b"]


def test_restrict_closes_gaps(spark):
    df = frame(spark, [(1, 0, "a"), (1, 1, "x"), (1, 2, "b")], "record_id long, rank int, code string")
    known = frame(spark, [("a",), ("b",)], "code string")
    assert [(r.rank, r.code) for r in restrict(df, known, ["record_id"]).orderBy("rank").collect()] == [(0, "a"), (1, "b")]


def test_fusion_by_hand(spark):
    df = lists(spark, (1, "x", 0, "a", 9.0), (1, "x", 1, "b", 8.0), (1, "y", 0, "b", 7.0), (1, "y", 1, "c", 6.0))
    got = {r.code: (r.rank, r.score, r.sources) for r in U.fuse(df, {"x": 1.0, "y": 2.0}, rrf_k=10).collect()}
    assert got["b"] == (0, round(1 / 12 + 2 / 11, 9), {"x": 1, "y": 0}) and got["c"][0] == 1 and got["a"][0] == 2
    assert [r.score for r in U.combine(df, {"y": 1.0}).orderBy("rank").collect()] == [7.0, 6.0]
    with pytest.raises(Exception, match="no weight for source y"):
        U.fuse(df, {"x": 1.0}).collect()
    assert U.subsets(["a", "b"]) == [("a",), ("b",), ("a", "b")]


def test_weight_zero_keeps_codes(spark):
    df = lists(spark, (1, "x", 0, "a", 1.0), (1, "y", 0, "b", 1.0))
    assert [(r.code, r.score > 0) for r in U.fuse(df, {"x": 1.0, "y": 0.0}).orderBy("rank").collect()] == [("a", True), ("b", False)]


def neighbours(spark):
    return frame(spark, [(0, i, s, i - 1) for i, s in ((1, 0.9), (2, 0.5), (3, -0.2), (4, -0.3), (5, -0.4))], "query long, id long, sim double, rank int")


def test_harvest_clips_and_keeps_zero_scores(spark):
    subjects = frame(spark, [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "a")], "id long, code string")
    assert {r.code: r.score for r in X.harvest(neighbours(spark), subjects, 3).collect()} == {"a": 1.4, "b": 0.5, "c": 0.0}


def test_fill_stops_at_the_neighbour_that_is_enough(spark):
    subjects = frame(spark, [(1, "a"), (2, "b"), (2, "c"), (3, "d"), (4, "e")], "id long, code string")
    got = X.fill(neighbours(spark), subjects, 1, 3).orderBy("rank").collect()
    assert [(r.code, r.phase) for r in got] == [("a", 0), ("b", 1), ("c", 1)]
    assert got[1].score == got[2].score == round(0.9 - 1e-6, 6)


def test_nearest_against_all_pairs(spark):
    rng = random.Random(0)
    rows = [(i, [rng.choice((-1.0, 0.0, 1.0)) for _ in range(4)]) for i in range(60)]
    df = frame(spark, rows, "id long, vector array<float>")
    want = set()
    for q, v in rows:
        scored = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in rows if i != q)[:5]
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(scored)}
    got = X.nearest(df, df, 5, exclude_self=True, block=9)
    assert {tuple(r) for r in got.select("query", "id", "sim", "rank").collect()} == want


def test_evaluation_edges(spark):
    gold = frame(spark, [(1, "a"), (1, "b"), (1, "a"), (2, "c"), (3, "z")], "record_id long, code string")
    pred = frame(spark, [(1, 0, "a"), (1, 1, "x"), (3, 0, "q"), (9, 0, "a")], "record_id long, rank int, code string")
    hits = E.record_hits(gold, pred, (1, 2, 2))
    assert {(r.record_id, r.k): (r.hits, r.gold) for r in hits.collect()} == {(1, 1): (1, 2), (1, 2): (1, 2), (2, 1): (0, 1), (2, 2): (0, 1), (3, 1): (0, 1), (3, 2): (0, 1)}
    m = {r.k: r for r in E.micro(hits, []).collect()}
    assert m[1].precision == pytest.approx(1 / 3) and m[1].recall == 0.25 and m[1].records == 3
    bands = frame(spark, [("a", "head"), ("c", "tail")], "code string, band string")
    by = {(r.band, r.k): r for r in E.by_band(gold, pred, bands, ["head", "torso", "tail", "zero"], (1,)).collect()}
    assert by["torso", 1].assignments == 0 and by["zero", 1].assignments == 2
    assert sum(r.precision for r in by.values()) == pytest.approx(m[1].precision)


def test_official_rounds_half_even(spark):
    hits = frame(spark, [(1, 1, 5, 32)], "record_id long, hits long, k int, gold long")
    assert E.official(hits, []).first().recall == 0.0312


def test_dominant_prefix(spark):
    shares = frame(spark, [("a", 0.3), ("b", 0.3), ("c", 0.4)], "type string, share double")
    assert sorted(r.type for r in E.dominant(shares, ["type"]).collect()) == ["a", "c"]


def test_bands_and_bounds(spark):
    counts = frame(spark, [(0,), (1,), (9,), (10,), (100,), (101,), (5000,)], "n long")
    assert [r.b for r in counts.select("n", B.band_of(F.col("n")).alias("b")).orderBy("n").collect()] == ["zero", "tail", "tail", "torso", "torso", "head", "head"]
    gold = frame(spark, [(1, 1), (1, 2), (2, 2), (2, 3)], "record_id long, code long")
    frozen = frame(spark, [(1, "tail", 1)], "code long, band string, count long")
    grown = frame(spark, [(1, 5), (2, 1)], "code long, count long")
    assert tuple(B.zero_shot_bound(gold, frozen, grown).first()) == (2, 3, 1, 2, 1, 1, 0.25)
    layer = {r.code: r.position for r in B.output_layer(gold).collect()}
    assert layer == {1: 0, 2: 1, 3: 2}
    words = frame(spark, [(i, f"gnd:{i * 7919 % 5000:04d}") for i in range(5000)], "record_id long, code string")
    layer = B.output_layer(words).orderBy("code").collect()
    assert [r.position for r in layer] == list(range(5000))


def test_merge_keeps_first_seen_order(spark):
    rows = frame(spark, [("r", 1, "x", ["b", "a"]), ("r", 2, "x", ["c", "a"]), ("s", 3, "y", ["d"]), ("s", 4, "z", [])], "id string, seq int, kind string, subjects array<string>")
    got = {r.id: r for r in C.merge(rows, "id", "seq", ["kind"], "subjects").collect()}
    assert got["r"].subjects == ["b", "a", "c"] and not got["r"].conflict and got["s"].conflict and got["s"].kind == "y"
    assert (got["r"].copies, got["r"].recovered, got["s"].copies, got["s"].recovered) == (2, 1, 2, 0)


def plain_merge(rows):
    out = {}
    for key, kind, own in rows:
        first = out.setdefault(key, [kind, dict.fromkeys(own or []), 0, False, 0])
        first[2] += 1
        first[3] |= kind != first[0]
        added = [c for c in dict.fromkeys(own or []) if c not in first[1]]
        first[4] += len(added)
        first[1] |= dict.fromkeys(added)
    return {k: (kind, list(own), n, conflict, late) for k, (kind, own, n, conflict, late) in out.items()}


def test_merge_in_order_of_arrival_over_files(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(9)]), rng.choice(["x", None]) if i % 9 == 0 else "x", rng.choice([None, [], [rng.randint(0, 9) for _ in range(3)]])) for i in range(400)]
    schema = "id int, kind string, subjects array<int>"
    for i in range(4):
        spark.createDataFrame(rows[100 * i : 100 * (i + 1)], schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
    read = spark.read.schema(schema).parquet(*(str(tmp_path / f"part{i}") for i in (2, 0, 3, 1)))
    merged = C.merge(C.arrival(read), "id", "arrived", ["kind"], "subjects")
    assert {r.id: (r.kind, r.subjects, r.copies, r.conflict, r.recovered) for r in merged.collect()} == plain_merge(rows)
    want = plain_merge(rows)
    assert tuple(C.merge_stats(merged).first()) == (400, len(want), sum(w[2] > 1 for w in want.values()), sum(w[4] for w in want.values()))


def test_merge_of_nothing_and_of_a_hot_key(spark):
    schema = "id int, seq long, subjects array<long>"
    assert C.merge(frame(spark, [], schema), "id", "seq", [], "subjects").count() == 0
    hot = spark.range(20000).select(F.lit(1).alias("id"), F.col("id").alias("seq"), F.array(F.col("id") % 5).alias("subjects"))
    assert tuple(C.merge(hot, "id", "seq", [], "subjects").first()) == (1, [0, 1, 2, 3, 4], 20000, False, 4)


def test_load_refuses_copies_in_conflict(spark):
    rows = frame(spark, [(1, 1, "x", [1]), (1, 2, "y", [2]), (2, 3, "x", [3])], "id int, seq int, kind string, subjects array<int>")
    held, words = frame(spark, [("dev", 2)], "split string, id int"), frame(spark, [(1,)], "code int")
    merged = C.merge(rows, "id", "seq", ["kind"], "subjects")
    with pytest.raises(Exception, match="record 1 appears more than once"):
        C.assembled_load(merged, held, words, "id")[2].collect()
    assert [r.id for r in C.assembled_load(merged.where("id = 2"), held.where("id = 7"), words, "id")[2].collect()] == [2]


def test_quotas_and_starvation(spark):
    cells = frame(spark, [("a", 90), ("b", 9), ("c", 1)], "cell string, n long")
    rows = [r.asDict() for r in C.quotas(cells, ["cell"], 10).orderBy("cell").collect()]
    assert [r["quota"] for r in rows] == [8, 1, 1]
    many = frame(spark, [("a", 40), ("b", 40), (None, 1), ("d", 1), ("e", 1), ("f", 0)], "cell string, n long")
    assert {r.cell: r.quota for r in C.quotas(many, ["cell"], 6).collect()} == {"a": 2, "b": 1, None: 1, "d": 1, "e": 1, "f": 0}
    assert {r.cell: r.quota for r in C.quotas(many, ["cell"], 5).collect()} == {"a": 3, "b": 2, None: 0, "d": 0, "e": 0, "f": 0}  # more cells than places
    assert [r.quota for r in C.quotas(cells, ["cell"], 1000).orderBy("cell").collect()] == [90, 9, 1]


def test_duplicates_need_another_key(spark):
    q = frame(spark, [(1, "t", "x"), (2, "t", "y"), (3, None, None)], "id long, title string, abstract string")
    i = frame(spark, [(1, "t", "x"), (9, "t", "y"), (3, "", "")], "id long, title string, abstract string")
    assert [r.id for r in C.duplicated_from(q, i, "id", ["title", "abstract"]).collect()] == [2]


def test_qualifiers(spark):
    got = frame(spark, [("A,B",), ("A, B",), ("A,",), ("A,B,C",), ("A",)], "t string").select(T.base_term(F.col("t")).alias("b"), T.qualifier_of(F.col("t")).alias("q")).collect()
    assert [(r.b, r.q) for r in got] == [("A", "B"), ("A, B", None), ("A,", None), ("A", "B,C"), ("A", None)]
    with pytest.raises(ValueError):
        T.render_term(F.lit("x"), "other")


def test_tokens_and_clip(spark):
    row = spark.createDataFrame([("Ünï ² x_1, 日本 a-b",)], "t string").select(T.tokens(F.col("t")).alias("ts"), T.clipped(F.col("t"), 4).alias("c"), T.clipped(F.col("t"), 0).alias("all")).first()
    assert row.ts == ["ünï", "²", "x_1", "日本", "a", "b"] and row.c == "Ünï […]" and row["all"].startswith("Ünï ²")


def test_rerank_and_choices(spark):
    cand = frame(spark, [(1, i, c, 1.0 - i / 10) for i, c in enumerate("abcde")], "record_id long, rank int, code string, score double")
    model = frame(spark, [(1, "a", 0.1), (1, "b", 0.9), (1, "c", 0.9), (1, "d", 0.5)], "record_id long, code string, model double")
    assert [r.code for r in R.rerank(cand, model).orderBy("rank").collect()] == ["b", "c", "d", "a"]
    assert [r.code for r in R.rerank(cand, model, "fuse", weight=0.0).orderBy("rank").collect()] == ["a", "b", "c", "d"]
    chosen = frame(spark, [(1, "d", 0), (1, "b", 1)], "record_id long, code string, at int")
    got = R.apply_choices(cand, chosen, 4).orderBy("rank").collect()
    assert [r.code for r in got] == ["d", "b", "a", "c", "e"] and [round(r.score, 1) for r in got] == [1.0, 0.9, 0.8, 0.7, 0.6]


def test_confidence_routing_and_positions(spark):
    recs = frame(spark, [(i,) for i in range(10)], "record_id long")
    cand = frame(spark, [(i, 0, "a", float(i // 3)) for i in range(9)], "record_id long, rank int, code string, score double")
    conf = R.confidence(recs, cand)
    assert {r.record_id: r.confidence for r in conf.collect()}[9] == 0.0
    assert sorted(r.record_id for r in R.route(conf, 0.3).collect()) == [0, 1, 2]
    values = [(i, random.Random(i).choice((0.0, 0.5, 0.5, 1.0, 1e-9))) for i in range(200)]
    placed = R.global_position(frame(spark, values, "record_id long, confidence double"), "confidence")
    want = {i: n for n, (i, _) in enumerate(sorted(values, key=lambda v: (-v[1], v[0])))}
    assert {r.record_id: r.position for r in placed.collect()} == want


def test_parse_responses(spark):
    texts = ["x [1] then [\"a\", \"b\"] ok", "[]", "none", None, "[broken [\"c\"]", '["a", 1]']
    got = [r.p for r in frame(spark, [(t,) for t in texts], "t string").select(R.parse_response("t").alias("p")).collect()]
    assert got == [["a", "b"], [], None, None, ["c"], None]


def test_coverage_keeps_whole_ties(spark):
    conf = frame(spark, [(i, c) for i, c in enumerate((0.9, 0.5, 0.5, 0.5, 0.1))], "record_id long, confidence double")
    out = frame(spark, [(i, i % 2, i % 3, 2) for i in range(5)], "record_id long, hits_p long, hits_r long, gold long")
    got = {r.requested: r.records for r in V.coverage_curve(conf, out, (1.0, 0.4, 0.0)).collect()}
    assert got == {1.0: 5, 0.4: 4, 0.0: 1}


def test_published_rank_statistics(spark):
    """Four systems, one adjacent swap."""
    df = frame(spark, [("a", 0.4724, 0.5298), ("b", 0.4702, 0.5337), ("c", 0.4149, 0.4961), ("d", 0.4063, 0.4926)], "name string, x double, y double")
    assert V.spearman(df, "x", "y").first().rho == pytest.approx(0.8) and V.kendall(df, "name", "x", "y").first().tau == pytest.approx(2 / 3)
    flat = frame(spark, [("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 3.0)], "name string, x double, y double")
    assert V.spearman(flat, "x", "y").first().rho is None and V.kendall(flat, "name", "x", "y").first().tau is None
    assert V.spearman(df.limit(2), "x", "y").first().rho is None


def test_prior_boost_and_fit(spark):
    cand = frame(spark, [(1, "a", 1.0), (1, "b", 0.5), (2, "a", 0.3)], "record_id long, code string, score double")
    groups = frame(spark, [("b", "g")], "code string, group string")
    dist = frame(spark, [(1, "g", 1.0), (2, "g", 1.0)], "id long, group string, p double")
    got = {(r.record_id, r.code): r.score for r in P.boost(cand, dist, groups, 2.0).collect()}
    assert got == {(1, "a"): 1.0, (1, "b"): 1.5, (2, "a"): 0.3}
    rng = random.Random(0)
    rows = [(i, [rng.gauss(2 if i % 2 else -2, 1), rng.gauss(0, 1)]) for i in range(200)]
    vectors = frame(spark, rows, "id long, vector array<double>")
    truth = frame(spark, [(i, "odd") for i in range(1, 200, 2)] + [(i, "all") for i in range(200)], "record_id long, group string")
    head = {r.group: r for r in P.fit_head(vectors, truth, ["odd", "all", "none"]).collect()}
    assert head["odd"].coefficients[0] > 1 and (head["all"].intercept, head["none"].intercept) == (20.0, -20.0)
    dist = P.distributions(vectors, spark.createDataFrame(list(head.values())))
    assert all(abs(r.s - 1) < 1e-9 for r in dist.groupBy("id").agg(F.sum("p").alias("s")).collect())


def test_fitted_head_is_the_optimum(spark):
    """The fit minimises C * log loss + half the squared coefficients: its gradient vanishes."""
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1), rng.gauss(0, 2)]) for i in range(120)]
    hit = [i for i, v in rows if v[0] + 0.3 * v[1] + rng.gauss(0, 1) > 0]
    head = P.fit_head(frame(spark, rows, "id long, vector array<double>"), frame(spark, [(i, "g") for i in hit], "record_id long, group string"), ["g"], c=0.5).first()
    w, b = head.coefficients, head.intercept
    err = [(1 / (1 + math.exp(-(sum(a * x for a, x in zip(w, v)) + b))) - (i in hit), v) for i, v in rows]
    assert all(abs(0.5 * sum(e * v[k] for e, v in err) + w[k]) < 1e-2 for k in (0, 1)) and abs(sum(e for e, _ in err)) < 1e-2


def test_batches_never_repeat_a_positive(spark):
    pairs = frame(spark, [(i, f"c{i % 5}") for i in range(60)], "record_id long, positive string")
    got = O.batches(pairs, 8, seed=3).collect()
    assert len(got) == 60 and got and sorted(map(tuple, got)) == sorted(map(tuple, O.batches(pairs.repartition(3), 8, seed=3).collect()))
    groups = {}
    for r in got:
        groups.setdefault(r.batch, []).append(r.positive)
    assert all(len(g) == len(set(g)) <= 8 for g in groups.values())


def test_batches_in_the_order_of_a_walk():
    """Against walking past every pair that has to wait."""

    def walked(positives, size):
        out, todo, number, taken = {}, list(range(len(positives))), 0, set()
        while todo:
            held = []
            for i in todo:
                if positives[i] in taken:
                    held.append(i)
                    continue
                out[i] = number
                taken.add(positives[i])
                if len(taken) == size:
                    number, taken = number + 1, set()
            if len(held) == len(todo):
                number, taken = number + 1, set()
            todo = held
        return [out[i] for i in range(len(positives))]

    rng = random.Random(2)
    for n in (0, 1, 5, 40, 200):
        for kinds in (1, 3, 10, 100):
            positives = [rng.randrange(kinds) for _ in range(n)]
            for size in (1, 2, 7, 32):
                assert O.filled(positives, size) == walked(positives, size)
    assert len(O.filled([0] * 50_000 + list(range(50_000)), 32)) == 100_000


def test_vectors_of_any_key_and_refusals(spark):
    rows = [(f"r{i}", [float(i % 3), float(i % 5)]) for i in range(20)]
    df = frame(spark, rows, "id string, vector array<double>")
    got = {(r["query"], r["rank"]): r["id"] for r in X.nearest(df, df, 3, exclude_self=True).collect()}
    for q, v in rows:
        best = sorted((-sum(a * b for a, b in zip(v, u)), i) for i, u in rows if i != q)[:3]
        assert [got[q, k] for k in range(3)] == [i for _, i in best]
    for bad in ([1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], None):
        with pytest.raises(Exception, match="no finite vector for r99"):
            X.nearest(df, df.unionByName(frame(spark, [("r99", bad)], "id string, vector array<double>")), 3).collect()


def test_lexical_blocks_and_keys(spark):
    from rankloom.operators import lexical as L

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn".split()) for _ in range(n))
    entries = frame(spark, [(i, f"c{i // 2:02d}", text(3)) for i in range(40)], "entry long, code string, text string")
    queries = frame(spark, [(f"q{i}", text(i % 7)) for i in range(30)] + [("none", "zz"), ("null", None)], "query string, text string")
    found = [sorted(map(tuple, L.match(L.query_terms(queries), L.lexical_index(entries), 5, "once", **b).collect())) for b in ({}, {"block": 4}, {"block": 4, "prune": False})]
    assert found[0] == found[1] and found[0]
    names = {r["query"] for r in L.without_hits(queries, L.match(L.query_terms(queries), L.lexical_index(entries), 5, "once")).collect()}
    assert names == {"none", "null", *(f"q{i}" for i in range(0, 30, 7))}
    weights = queries.where("text <> ''").select("query", F.create_map(F.lit("ab"), F.lit(2.0), F.lit("cd"), F.lit(0.5)).alias("w"))
    learned = entries.select("entry", "code", F.create_map(F.lit("ab"), F.col("entry").cast("double")).alias("w"))
    top = L.match(L.sparse_terms(weights, "query", "w"), L.lexical_index(learned, "w"), 1).collect()
    assert {(r.code, r.score) for r in top} == {("c19", 78.0)}


def test_refusals(spark):
    with pytest.raises(K.Refused, match="1"):
        K.require_none(K.repeated_ids(frame(spark, [(1,), (1,)], "id long"), "id"), "repeated")
    K.require_none(K.repeated_ids(frame(spark, [(1,), (2,)], "id long"), "id"), "repeated")
    texts = frame(spark, [(1, "a"), (2, "b")], "i int, t string")
    assert K.input_revision(texts, "i", "t") == K.input_revision(texts.repartition(2), "i", "t") != K.input_revision(texts.withColumn("i", -F.col("i")), "i", "t")
    assert K.fingerprint({"b": 1, "a": 2}) == K.fingerprint({"a": 2, "b": 1}) and len(K.fingerprint({})) == 12


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no sample tables")
def test_sample_queries_feed_starved_cells(spark):
    from rankloom.plans.corpora import SIZE, cell_shares, quotas, stratified_sample

    sf = "/root/testdata/sf0.01"
    n = {(r.source, r.lang): r["count"] for r in spark.read.parquet(f"{sf}/documents.parquet").groupBy("source", "lang").count().collect()}
    exact = {c: k * SIZE / sum(n.values()) for c, k in n.items()}
    want = {c: int(s) for c, s in exact.items()}
    for c in sorted(exact, key=lambda c: (-round(exact[c] - want[c], 9), c))[: SIZE - sum(want.values())]:
        want[c] += 1
    starved = [c for c in sorted(want) if not want[c]]
    for c in starved:
        want[max(want, key=lambda o: (want[o], o))] -= 1
        want[c] += 1
    assert starved and {(r.source, r.lang): r.quota for r in quotas(spark, sf).collect()} == want
    assert {(r.source, r.lang): r["count"] for r in stratified_sample(spark, sf).groupBy("source", "lang").count().collect()} == want
    assert {(r.source, r.lang): r["sample"] for r in cell_shares(spark, sf).collect()} == want
