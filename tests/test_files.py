"""Readers and writers round trip, and the streaming pieces."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from rankloom.operators.checks import Refused
from rankloom.sources import files as S
from rankloom.streaming import windows


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_records(spark, tmp_path):
    text = 'id,type,lang,title,abstract,subjects\n1,Book,http://x/iso639/eng/,"A ""quoted""\ntitle",,gnd:1  gnd:2\n2,Thesis,ger,T,"a, b",\n'
    rows = {r.id: r for r in S.read_records(spark, put(tmp_path / "r.csv", text)).collect()}
    assert rows["1"].title == 'A "quoted"\ntitle' and rows["1"].abstract == "" and rows["1"].lang == "eng" and rows["1"].subjects == ["gnd:1", "gnd:2"] and rows["2"].subjects == []
    S.write_records(S.read_records(spark, str(tmp_path / "r.csv")), str(tmp_path / "out"))
    assert {r.id: r.title for r in S.read_records(spark, str(tmp_path / "out")).collect()} == {k: r.title for k, r in rows.items()}


def test_vocabulary(spark, tmp_path):
    entry = {"Code": "gnd:1", "Name": "N", "Classification Name": "C", "Alternate Name": ["x"], "Definition": None}
    listed = S.read_vocabulary(spark, put(tmp_path / "l.json", json.dumps([entry]))).collect()
    keyed = S.read_vocabulary(spark, put(tmp_path / "d.json", json.dumps({"gnd:1": entry}))).collect()
    assert listed == keyed and listed[0].asDict() == {"code": "gnd:1", "name": "N", "group": "C", "group_number": "", "alternates": ["x"], "related": [], "definition": ""}


def test_maps_and_bands(spark, tmp_path):
    path = put(tmp_path / "m.json", json.dumps({"schema": 1, "translations": {"a": "b"}}))
    assert [tuple(r) for r in S.read_string_map(spark, path, "translations").collect()] == [("a", "b")]
    assert S.read_string_map(spark, str(tmp_path / "no.json"), optional=True).count() == 0
    with pytest.raises(Exception):
        S.read_string_map(spark, str(tmp_path / "no.json")).collect()
    bands = put(tmp_path / "b.json", json.dumps({"labels": {"head": {"x": 200}, "tail": {"y": 1, "z": 2}}}))
    assert sorted(map(tuple, S.read_bands(spark, bands).collect())) == [("head", "x", 200), ("tail", "y", 1), ("tail", "z", 2)]


def test_jsonld(spark, tmp_path):
    graph = {"@graph": [{"@id": "a"}, {"@id": "b", "title": ["T  1", "T2"], "abstract": "x\n y", "language": "http://l/deu", "@type": "bibo:Book", "dcterms:subject": [{"@id": "gnd:1"}, {"@id": "other:2"}, {"@id": "gnd:1"}]}]}
    row = S.read_jsonld(spark, put(tmp_path / "rec1.jsonld", json.dumps(graph))).first()
    assert row.asDict() == {"id": "rec1", "type": "Book", "lang": "deu", "title": "T 1 T2", "abstract": "x y", "subjects": ["gnd:1"]}


def test_turtle_and_qualifiers(spark, tmp_path):
    e = unicodedata.normalize("NFD", "é")
    text = f'gnd:1 a skos:Concept ;\n  skos:prefLabel "Bad (Ort)"@de ;\n  skos:prefLabel "Second"@de .\ngnd:2 a skos:Concept ;\n  skos:prefLabel "Café (\\"Bar\\")"@de .\ngnd:3 a skos:Concept ;\n  skos:prefLabel "x"@en .\n'
    labels = S.read_turtle_labels(spark, put(tmp_path / "v.ttl", text))
    assert sorted(map(tuple, labels.collect())) == [("gnd:1", "Bad (Ort)"), ("gnd:2", 'Café ("Bar")')]
    entries = spark.createDataFrame([("gnd:1", "Bad Ort"), ("gnd:2", f'Caf{e} "Bar"')], "code string, name string")
    assert sorted(map(tuple, S.recovered_qualifiers(entries, labels).collect())) == [("gnd:1", "Ort"), ("gnd:2", '"Bar"')]


def test_trees_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("r1", "Book", "de"), ("r2", "Book", "en")], "record_id string, type string, lang string")
    ranks = spark.createDataFrame([(r, i, f"gnd:{i}") for r in ("r1", "r2") for i in range(4)], "record_id string, rank int, code string")
    assert S.write_submission(ranks, cells, str(tmp_path / "out"), length=4) == 2
    assert json.loads((tmp_path / "out/Book/de/r1.json").read_text()) == {"dcterms:subject": ["gnd:0", "gnd:1", "gnd:2", "gnd:3"]}
    back = S.read_submission_tree(spark, str(tmp_path / "out")).select("record_id", "rank", "code")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ranks.collect()))
    with pytest.raises(Refused):
        S.write_submission(ranks.where("rank < 3"), cells, str(tmp_path / "bad"), length=4)
    assert S.write_gold_tree(ranks.where("rank < 2"), cells, str(tmp_path / "gold")) == 2
    gold = {r.record_id: (r.type, r.lang, r.subjects) for r in S.read_gold_tree(spark, str(tmp_path / "gold")).collect()}
    assert gold == {"r1": ("Book", "de", ["gnd:0", "gnd:1"]), "r2": ("Book", "en", ["gnd:0", "gnd:1"])}
    put(tmp_path / "gold/Book/de/r3.jsonld", json.dumps({"@graph": [{"@id": "x"}, {"dcterms:subject": {"@id": "gnd:9"}}]}))
    put(tmp_path / "gold/Book/de/r4.jsonld", json.dumps({"@graph": [{"@id": "x"}]}))
    assert {r.record_id: r.subjects for r in S.read_gold_tree(spark, str(tmp_path / "gold")).collect()}.get("r3") == ["gnd:9"]
    assert S.read_gold_tree(spark, str(tmp_path / "gold")).count() == 3


def test_screens(spark, tmp_path):
    doc = {"schema": "s/1", "split": "dev", "index": {"documents": 8}, "rows": [{"encoder": "e", "micro": {"r10": 0.5}}]}
    path = put(tmp_path / "s.json", json.dumps(doc))
    assert [tuple(r) for r in S.read_screens(spark, path, "s/1").collect()] == [("dev", 8, "e", "r10", 0.5)]
    with pytest.raises(Refused):
        S.read_screens(spark, path, "s/2")


def test_log_grows_by_new_keys(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, "record_id long, response string")
    S.append_new(log, rows((1, "a"), (1, "b"), (2, "c")), ["record_id"])
    S.append_new(log, rows((2, "again"), (3, "d")), ["record_id"])
    assert sorted(r.record_id for r in spark.read.json(log).collect()) == [1, 2, 3]


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 0{i % 3}:10:00", "click", float(i)) for i in range(9)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.hourly(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, windows.hourly(events).collect()))
    answers = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).select(F.col("value").cast("long").alias("record_id"), F.lit("r").alias("response"))
    for n in range(2):
        windows.log_responses(answers, str(tmp_path / "log"), str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 9


def test_prediction_documents_and_broken_files(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text('{"split": "dev", "predictions": {"r1": ["a", "b"], "r2": []}}')
    bad.write_text('{"predictions": ')
    assert sorted(map(tuple, S.read_predictions(spark, str(good)).collect())) == [("dev", "r1", 0, "a"), ("dev", "r1", 1, "b")]
    with pytest.raises(Exception, match="prediction document"):
        S.read_predictions(spark, str(bad))
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.read_json_tolerant(spark, str(tmp_path), "split string").collect()}
    assert rows["good.json"].value.split == "dev" and not rows["good.json"].broken and rows["bad.json"].broken and rows["bad.json"].value is None
    assert S.read_document(spark, str(good)) == good.read_text()


def test_vocabulary_and_cache_files(spark, tmp_path):
    entries = spark.createDataFrame([("b", "B, x", ["s"]), ("a", "A", [])], "code string, name string, alternates array<string>")
    stats = S.write_vocabulary(entries, spark.createDataFrame([("b", "x")], "code string, qualifier string"), str(tmp_path / "v"))
    assert tuple(stats.first()) == (2, 1)
    back = spark.read.schema("key string, value string").json(str(tmp_path / "v/entries")).collect()
    assert {r.key for r in back} == {"a", "b"} and '"name":"B, x"' in {r.key: r.value for r in back}["b"]
    rows = spark.createDataFrame([(f"k{i}", str(i)) for i in range(50)], "key string, value string")
    texts = []
    for parts in (1, 4):
        S.write_sorted_map(rows.repartition(parts), str(tmp_path / f"c{parts}"))
        texts.append("".join(p.read_text() for p in sorted((tmp_path / f"c{parts}").glob("part-*"))))
    assert texts[0] == texts[1] and texts[0].startswith('{"key":"k0"')
    S.write_projection(entries, ["code", "alternates"], str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("b", "s"), ("a", None)}
    log = str(tmp_path / "log")
    assert S.read_log(spark, log, "id long, at long", "at").count() == 0
    S.append_new(log, spark.createDataFrame([(2, 5), (1, 3)], "id long, at long"), ["id"])
    S.append_new(log, spark.createDataFrame([(1, 9), (3, 4)], "id long, at long"), ["id"])
    assert [r.id for r in S.read_log(spark, log, "id long, at long", "at").collect()] == [1, 3, 2]


def test_heads_and_predictions(spark, tmp_path):
    head = spark.createDataFrame([("g", [1.0, 2.0], 0.5)], "group string, coefficients array<double>, intercept double")
    S.write_prior(head, str(tmp_path / "head"))
    assert S.read_prior(spark, str(tmp_path / "head")).collect() == head.collect()
    with pytest.raises(Refused):
        S.read_prior(spark, str(tmp_path / "none"))
    S.write_predictions(spark.createDataFrame([("r", 1, "b"), ("r", 0, "a")], "record_id string, rank int, code string"), "dev", str(tmp_path / "p"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "p")).select("split", "record_id", "codes").collect()] == [("dev", "r", ["a", "b"])]
