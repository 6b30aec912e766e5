"""Lists that meet by record: no language or cell is one task's, and rows that lie by record are not moved again."""

import shutil

from pyspark.sql import functions as F

from rankloom.operators import fusion as U
from rankloom.operators import rerank as R
from rankloom.operators.ranking import marked
from rankloom.plans import retrievals
from rankloom.sources import roles

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_not_shuffled_by_language_or_twice(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(retrievals.rerank_replace(spark, SF))
        assert "SortMergeJoin [type" not in text and "SortMergeJoin [lang" not in text and "hashpartitioning(record_id" in text
        assert not [x for x in text.split("\n") if "Exchange hashpartitioning(record_id" in x and ", code#" in x and "score" in x]
        after = [x for x in text.split("\n") if "Exchange" in x or "Generate inline" in x]
        assert "Generate inline" in after[0]  # all work on candidates follows without an exchange
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_id_that_repeats_has_one_list_of_hashed_codes(spark, tmp_path):
    for name in ("customer", "lineitem", "part"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    twice = orders.where("o_orderkey = 10").withColumn("o_custkey", (F.col("o_custkey") + 1) % 100)
    orders.unionByName(twice).write.parquet(str(tmp_path / "orders.parquet"))
    counts = {r["source"]: r["n"] for r in roles.popularity_rankings(spark, str(tmp_path)).where("record_id = 10").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts["hash"] == 30 and counts["lang"] == 60


def test_marked(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (None, 5), (2, None), (3, 5)], "record_id long, code long")
    pairs = spark.createDataFrame([(1, 5), (1, 5), (None, 5), (2, None)], "record_id long, code long")
    assert sorted((r.record_id or 0, r.code or 0, r.hit) for r in marked(rows, pairs, "hit").collect()) == [(0, 5, False), (1, 5, True), (1, 6, False), (2, 0, False), (3, 5, False)]


def test_carried_scores_are_the_joined_ones(spark):
    own = retrievals.fused(spark, SF).drop("sources")
    one, two = (R.rerank(a, b, "fuse", input_k=40, output_k=30) for a, b in ((own, retrievals.model_scores(own)), (retrievals.scored(spark, SF), None)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_gold_of_records_without_a_ranking_counts(spark):
    rankings = spark.createDataFrame([(1, "a", 0, 5, 1.0), (1, "a", 1, 6, 0.5)], "record_id long, source string, rank int, code long, score double")
    gold = spark.createDataFrame([(1, 5), (9, 5), (9, 6), (9, 6)], "record_id long, code long")
    assert [round(r.recall, 6) for r in U.sweep(rankings, gold, [({"a": 1.0}, 60)], k=1).collect()] == [0.333333]


def test_merge_counts_need_no_lists_and_no_sort(spark):
    """merge_stats aggregates numbers in place: no struct with a file's name is compared, nothing is sorted."""
    from rankloom.plans import corpora

    text = plan(corpora.merge_stats(spark, SF))
    assert "SortAggregate" not in text and "collect_list" not in text


def test_an_order_of_arrival_is_one_number(spark, tmp_path):
    from rankloom.operators import corpus as C

    for i, name in enumerate("ba"):
        spark.range(100 * i, 100 * i + 100, 1, 1).write.parquet(str(tmp_path / f"{name}.parquet"))
    own = C.arrival(spark.read.parquet(*(str(tmp_path / f"{n}.parquet") for n in "ba")))
    assert dict(own.dtypes)["arrived"] == "bigint"
    assert [r.id for r in own.orderBy("arrived").collect()] == [*range(100, 200), *range(100)]


def test_lines_are_counted_in_parts_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(roles, "PART_LINES", 1000)
    monkeypatch.setattr(roles, "PART_RECORDS", 20)
    own = roles.training_counts(spark, SF)
    dealt = [x for x in plan(own).split("\n") if "Exchange hashpartitioning" in x]
    assert len(dealt) == 3 and all("REPARTITION_BY_NUM" in x for x in dealt)  # lines and their records by record, then by language and code
    assert own.rdd.getNumPartitions() >= 6 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert roles.gold(spark, SF).rdd.getNumPartitions() == roles.dev_parts(spark, SF) == 8


def test_gold_meets_rankings_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(roles, "PART_RECORDS", 20)
    text = plan(retrievals.hard_negatives(spark, SF))
    for x in text.split("\n"):
        assert "Exchange hashpartitioning(record_id" not in x or ", 8)" in x or "REPARTITION_BY_NUM" in x


def test_records_without_type_or_language(spark, tmp_path):
    import duckdb

    for name in ("lineitem", "part"):
        shutil.copy(f"{SF}/{name}.parquet", tmp_path / f"{name}.parquet")
    lost = lambda c, key: F.when(F.col(key) % 50 != 0, F.col(c))
    for name, c, key in (("customer", "c_mktsegment", "c_custkey"), ("orders", "o_orderpriority", "o_orderkey")):
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn(c, lost(c, key)).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    con = duckdb.connect()
    for name in ("customer", "orders"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("lineitem", "part"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute("WITH " + roles.POPULARITY_SQL + " SELECT record_id, source, rank, code FROM rankings").fetchall()
    got = roles.popularity_rankings(spark, str(tmp_path)).select("record_id", "source", "rank", "code").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_columns_of_a_batch_by_first_places(spark):
    import random

    from rankloom.operators import training as O

    deal = random.Random(3)
    rows = [(r % 3, r, p, [deal.randrange(30) for _ in range(8)]) for r in range(40) for p in deal.sample(range(30), 2)]
    rows = [(b, r, p, next(n for _, x, _, n in rows if x == r)) for b, r, p, _ in rows]
    got = {r["batch"]: r["columns"] for r in O.batch_columns(spark.createDataFrame(rows, "batch int, record_id long, positive long, negatives array<long>")).collect()}
    for b in range(3):
        own = sorted((r, p, n) for x, r, p, n in rows if x == b)
        assert got[b] == list(dict.fromkeys([p for _, p, _ in own] + [c for _, _, n in own for c in n]))
    text = plan(retrievals.batch_columns(spark, SF))
    assert "collect_list(struct(record_id" not in text and "positive" not in text.split("collect_list(")[1].split(")")[0]


def test_candidates_get_names_in_parts_that_follow_their_number(spark, monkeypatch):
    monkeypatch.setattr(roles, "PART_RECORDS", 20)
    monkeypatch.setattr(R.offers, "__defaults__", (0,))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(retrievals.prompt_lengths(spark, SF)).split("Generate inline")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [code" not in text and "ShuffledHashJoin [code" in text  # candidates are not sorted by code
    dealt = [x for x in text.split("\n") if "Exchange hashpartitioning" in x]
    assert len(dealt) >= 2 and all(", 8), REPARTITION_BY_NUM" in x for x in dealt)  # by code and by record, eight parts


def test_offers_of_few_and_of_many_names_agree(spark):
    import random

    deal = random.Random(5)
    rows = [(r, i, c) for r in range(300) for i, c in enumerate([7, *deal.sample(range(8, 60), 5)])] + [(None, 0, 7), (900, 0, 99), (901, 0, None)]  # 7 is offered to all
    names = [(c, None if c == 9 else f"n{c}") for c in range(50)] + [(8, "again"), (None, "none")]
    want = {r: sorted(((i, c, n) for x, i, c in rows if x == r for k, n in names if k == c), key=lambda o: (o[0], o[2] or "")) for r in range(300)} | {None: [(0, 7, "n7")]}
    own, held = spark.createDataFrame(rows, "record_id long, rank int, code long"), spark.createDataFrame(names, "code long, label string")
    for few in (0, 1000):
        assert {x.record_id: [tuple(o) for o in x.offered] for x in R.offers(own, held, 6, few).collect()} == want


def test_prompts_of_records_without_type_or_names_are_those_of_the_sql(spark, tmp_path):
    import duckdb

    from rankloom.plans import SQL

    con = duckdb.connect()
    shutil.copy(f"{SF}/lineitem.parquet", tmp_path / "lineitem.parquet")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name, c, key, each in (("customer", "c_mktsegment", "c_custkey", 50), ("orders", "o_orderpriority", "o_orderkey", 50), ("part", "p_name", "p_partkey", 3)):
        lost = F.when(F.col(key) % each != 0, F.col(c))
        spark.read.parquet(f"{SF}/{name}.parquet").withColumn(c, lost).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    sql = SQL["prompt_lengths"]
    assert [tuple(r) for r in retrievals.prompt_lengths(spark, str(tmp_path)).collect()] == con.execute(sql).fetchall()
    spark.read.parquet(f"{SF}/part.parquet").withColumn("p_name", F.lit(None).cast("string")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "part.parquet"))
    con.execute(f"create or replace view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    assert [tuple(r) for r in retrievals.prompt_lengths(spark, str(tmp_path)).collect()] == con.execute(sql).fetchall()
