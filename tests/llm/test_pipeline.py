import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from rankloom.llm.bpe import loaded
from rankloom.llm.mixing import mix_sources
from rankloom.llm.quality import score_quality, train_quality
from tests.llm.test_near_copies import plain_labels, plain_set


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice("aeioutnslr") for _ in range(rng.randint(2, 9)))
    rows, labels = [], []
    for i in range(160):
        words = [word() for _ in range(rng.randint(20, 120))]
        good = i % 4 != 0
        text = ". ".join(" ".join(words[j : j + 9]).capitalize() for j in range(0, len(words), 9)) if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 5}" if i % 2 else "hot", len(text)))
        labels.append((i, int(good), 0))
    good = [r for r in rows if r[0] % 4]
    rows += [(500 + i, r[1].upper() if i == 3 else r[1], *r[2:]) for i, r in enumerate(good[:12]) if i != 3]
    rows += [(600 + i, r[1] + " tail", *r[2:]) for i, r in enumerate(good[20:40])]
    rows += [(700, None, "en", None, 0), (701, "", None, "s1", 0)]
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root)


def test_stages_against_plain_python(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    labels = spark.read.parquet(f"{tables}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = train_quality(docs, labels)
    rows = {r.doc_id: r for r in docs.collect()}
    scored = {r.doc_id: r.score for r in score_quality(docs, model, ["doc_id"]).collect()}
    kept = {i for i in rows if scored[i] >= 0.5}
    assert all((i in kept) == (i % 4 != 0) for i in range(160))
    newest = {}
    for i in sorted(kept):
        newest[(rows[i].text or "").lower()] = i
    kept = set(newest.values())
    ids = sorted(kept)
    label = plain_labels([plain_set(rows[i].text) for i in ids])
    kept = {min(i for i, x in zip(ids, label) if x == y) for y in set(label)}
    mixed = {r.doc_id: r for r in mix_sources(docs.where(F.col("doc_id").isin(*kept))).collect()}
    found = pipeline.run(spark, tables).collect()
    copies = {}
    for r in found:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= kept
    for i in kept:
        if mixed[i]["size"]:
            assert abs(copies.get(i, 0) * mixed[i]["size"] - mixed[i].taken) <= mixed[i]["size"] / 2
    import public_tokenizers

    bpe = loaded(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(r.n_tokens == len(bpe.encode_texts([rows[r.doc_id].text or ""])[0]) for r in found)


def test_columns_of_any_name_keep_their_values(spark, tables):
    names = ("score", "src", "source_size", "row", "id", "key", "hit", "n", "p", "maybe", "fp", "x", "y", "h", "epochs", "text_sha256", "_bucket", "kept", "lang_pred", "a.b")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    wide = docs.withColumns({c: F.concat_ws(c, F.col("doc_id").cast("string"), F.lit("")) for c in names})
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, wide, tables)
        assert found.columns == wide.columns, name
        for r in found.collect():
            assert all(r[c] == f"{r.doc_id}{c}" for c in names), name
    assert {*pipeline.STAGES[-1][1](spark, wide, tables).columns} == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_ids_that_repeat_or_miss(spark, tables):
    text = "The quick words of this sentence are not like others at all here. "
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (1, "Quite another text under the same id, which has to stay as it is. " * 3, "en", "a", 1), (None, "Nobody gave this one an id, and yet it is clean and long enough. ", "en", None, 1), (None, text.lower(), "de", "b", 2), (9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    once = sorted((r.doc_id or 0, r.text or "") for r in stages["exact_dedup"](spark, docs, tables).collect())
    assert once == sorted((i or 0, t or "") for i, t in {(1, rows[0][1]), (1, rows[2][1]), (None, rows[3][1]), (9, None)})
    near = sorted((r.doc_id or 0, r.text or "") for r in stages["near_dedup"](spark, docs, tables).collect())
    assert near == once
    assert {r.doc_id for r in stages["mix"](spark, docs, tables).collect()} <= {1, None, 9}


def test_stages_keep_the_columns_and_take_an_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, tables).columns == docs.columns, name
        assert stage(spark, docs.where("doc_id < 0"), tables).count() == 0, name
    assert 4 <= len(pipeline.STAGES) <= 5
