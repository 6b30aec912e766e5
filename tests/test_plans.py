import json
from dataclasses import dataclass, field

import pytest

from rankloom.functions import provenance as G
from rankloom.operators.checks import Refused
from rankloom.plans.predict import Inputs, Settings, predict


@dataclass
class Part:
    enabled: bool = False
    weight: float = 1.0


@dataclass
class Config:
    name: str = ""
    size: int = 1
    part: Part = field(default_factory=Part)


def test_configurations_are_closed():
    assert G.build(Config, {"name": "x", "part": {"weight": 2}}) == Config("x", 1, Part(False, 2))
    for bad in ({"nme": 1}, {"part": {"wight": 1}}, {"size": "1"}, {"size": True}, {"part": 3}):
        with pytest.raises(G.ConfigError):
            G.build(Config, bad)


def test_differences_skip_disabled_sections():
    a, b = {"p": {"enabled": False, "w": 1}, "k": 1}, {"p": {"enabled": False, "w": 2}, "k": 2}
    assert G.differences({"a": a, "b": b}) == {"k": {"a": 1, "b": 2}}
    assert G.longest_prefix("org/e5-large", {"e5": ("q", "p"), "e5-large": ("Q", "P")}) == ("Q", "P") and G.longest_prefix("x", {"e5": ("q", "p")}) == ("", "")


def test_stage_store(spark, tmp_path):
    store, calls = G.StageStore(spark, str(tmp_path / "s")), []
    make = lambda: calls.append(1) or spark.range(3)
    assert store.memo("v", {"a": 1}, make).count() == store.memo("v", {"a": 1}, make).count() == 3 and len(calls) == 1
    with pytest.raises(Refused):
        store.load("v", {"a": 2})
    assert not (tmp_path / "s/v" / store.path("v", {"a": 2}).rsplit("/", 1)[1]).exists()


def test_revisions_and_attestation(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    one = G.data_revision(spark, [str(tmp_path / "a.txt"), str(tmp_path / "missing.txt")])
    assert one == G.data_revision(spark, [str(tmp_path / "a.txt")]) and len(one) == 12
    (tmp_path / "a.txt").write_text("b")
    two = G.data_revision(spark, [str(tmp_path / "a.txt")])
    assert one != two
    index = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    held = spark.createDataFrame([("dev", 2), ("dev", 9), ("test", 3), ("none", 8)], "split string, id long")
    doc = json.loads(json.dumps(G.attest(index, held, "id", two, str(tmp_path / "gone"))))
    assert doc["overlaps"] == {"dev": 1, "test": 1, "none": 0} and sorted(r.id for r in G.require_alignment(spark, doc, two).collect()) == [2, 3]
    with pytest.raises(Refused):
        G.require_alignment(spark, doc, one)


def test_receipts(tmp_path):
    r = G.Receipts(str(tmp_path / "r"))
    with pytest.raises(Refused):
        r.require_plan({"k": 1})
    r.fix_plan({"k": 1})
    r.require_plan({"k": 1})
    with pytest.raises(Refused):
        r.require_plan({"k": 2})
    with pytest.raises(Refused):
        r.require_read()
    r.require_unread()
    r.require_read()
    with pytest.raises(Refused):
        r.require_unread()
    r.require_unread("a bug in the writer")


def inputs(spark):
    docs = [(i, [1.0 if j == i % 4 else 0.1 for j in range(4)]) for i in range(12)]
    queries = spark.createDataFrame([(100, "red apple", [1.0, 0.1, 0.1, 0.1]), (101, "blue sea", [0.1, 1.0, 0.1, 0.1])], "record_id long, text string, vector array<double>")
    codes = spark.createDataFrame([(c,) for c in range(4)], "code long")
    return Inputs(
        queries, codes, documents=spark.createDataFrame(docs, "id long, vector array<double>"),
        subjects=spark.createDataFrame([(i, i % 4) for i in range(12)] + [(0, 99)], "id long, code long"),
        labels=spark.createDataFrame([(c, [1.0 if j == c else 0.0 for j in range(4)]) for c in range(4)], "id long, vector array<double>"),
        entries=spark.createDataFrame([(0, 0, "apple"), (1, 1, "sea"), (2, 2, "apple pie"), (3, 99, "apple")], "entry long, code long, text string"),
    )


def test_predict_end_to_end(spark):
    own = inputs(spark)
    plain = predict(own, Settings(neighbours=3, top_k=4, candidates=4, output=4)).orderBy("record_id", "rank").collect()
    ranks = {q: [r.code for r in plain if r.record_id == q] for q in (100, 101)}
    assert ranks[100][0] == 0 and ranks[101][0] == 1 and all(99 not in r and len(r) == len(set(r)) for r in ranks.values())
    scores = spark.createDataFrame([(q, c, float(c)) for q in (100, 101) for c in range(4)], "record_id long, code long, model double")
    own.model_scores = scores
    turned = predict(own, Settings(neighbours=3, top_k=4, candidates=4, output=4, rerank_mode="replace")).where("record_id = 100").orderBy("rank").collect()
    assert [r.code for r in turned] == sorted(ranks[100], reverse=True)
    own.model_scores = None
    own.answers = spark.createDataFrame([(100, f'I say ["{ranks[100][2]}"]'), (101, '["77"]')], "record_id long, response string")
    judged = predict(own, Settings(neighbours=3, top_k=4, candidates=4, output=4, route_share=1.0)).orderBy("record_id", "rank").collect()
    assert [r.code for r in judged if r.record_id == 100][0] == ranks[100][2] and [r.code for r in judged if r.record_id == 101] == ranks[101]


def test_a_record_is_not_its_own_neighbour(spark):
    own = inputs(spark)
    own.queries = spark.createDataFrame([(0, "x", [1.0, 0.1, 0.1, 0.1])], "record_id long, text string, vector array<double>")
    own.subjects = spark.createDataFrame([(0, 3), (4, 0)], "id long, code long")
    got = predict(own, Settings(weights={"knn": 1.0}, neighbours=1, top_k=1, output=1)).collect()
    assert [r.code for r in got] == [0]


def test_pins_and_receipts(tmp_path):
    assert G.pinned("m", None, {"m": "r1"}) == G.pinned("m", "r1", {"m": "r1"}) == "r1"
    for name, revision in (("m", "r2"), ("other", None)):
        with pytest.raises(G.ConfigError):
            G.pinned(name, revision, {"m": "r1"})
    own = G.Receipts(tmp_path.as_uri() + "/r")
    digest = own.fix_plan({"k": 5})
    with pytest.raises(Refused):
        own.receipt({})
    own.require_unread()
    own.require_unread("a second look")
    assert own.receipt({"n": 1}) == {"plan": digest, "reads": [{"justification": ""}, {"justification": "a second look"}], "facts": {"n": 1}}


def test_prompts_by_revision(spark):
    from pyspark.sql import functions as F

    from rankloom.operators import rerank as R

    df = spark.createDataFrame([("t", [(0, "c", "l")])], "text string, offered array<struct<rank: int, code: string, label: string>>")
    assert df.select(R.prompt("1", F.col("text"), F.col("offered")).alias("p")).first().p == "Record:\nt\n\nCandidates:\n1. c l"
    with pytest.raises(ValueError):
        R.prompt("9", F.col("text"), F.col("offered"))


def test_pairs_differ_in_the_adapter_alone():
    base = {"name": "u", "model": "m", "adapter": None, "index": {"size": 3}, "fusion": {"k": 60}}
    tuned = base | {"name": "t", "adapter": "a"}
    G.require_pairs([(base, tuned), (base | {"name": "u2", "model": "n"}, tuned | {"model": "n"})], ["index", "fusion"])
    bad = {
        "names an adapter": (tuned, tuned), "one configuration twice": (base, base), "two models": (base, tuned | {"model": "n"}),
        "index.size: 3 and 4": (base, tuned | {"index": {"size": 4}}), "fusion": (base, tuned | {"fusion": {}}),
    }
    for told, pair in bad.items():
        with pytest.raises(Refused, match=told):
            G.require_pairs([pair], ["index", "fusion"])
    with pytest.raises(Refused, match="differ"):
        G.require_pairs([(base, tuned), (base | {"index": {"size": 9}}, tuned | {"index": {"size": 9}})], ["index", "fusion"])


def test_negatives_by_name(spark, tmp_path):
    from rankloom.sources import files

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "record_id long, rank int, code string")
    assert files.write_negatives(rows, str(tmp_path), "small", "train", 2).endswith("/small-train-2")
    assert files.read_negatives(spark, str(tmp_path), "small", "train", 2).count() == 2
    for names in (("small", "dev", 2), ("small", "train", 3), ("large", "train", 2)):
        with pytest.raises(Refused):
            files.read_negatives(spark, str(tmp_path), *names)
    with pytest.raises(Refused):
        files.write_negatives(rows, str(tmp_path), "small", "train", 1)
    with pytest.raises(ValueError):
        files.negatives_path(str(tmp_path), "../x", "train", 1)


def test_scoring_passes_are_replayed_or_refused(spark, tmp_path):
    store, calls = G.StageStore(spark, str(tmp_path / "s")), []
    cand = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "record_id long, code string")

    def score(df):
        calls.append(1)
        return df.selectExpr("record_id", "code", "0.5 * record_id as model")

    with pytest.raises(Refused):
        store.scores({"m": 1}, "dev", 2)
    for refresh in (False, False, True):
        assert sorted(r.model for r in store.replayed({"m": 1}, "dev", 2, cand, score, refresh).collect()) == [0.5, 0.5, 1.0]
    assert len(calls) == 2 and store.scores({"m": 1}, "dev", 2).count() == 3
    with pytest.raises(Refused):
        store.replayed({"m": 1}, "dev", 2, cand.unionByName(spark.createDataFrame([(3, "z")], cand.schema)), score)
    with pytest.raises(Refused):
        store.scores({"m": 1}, "dev", 3)
