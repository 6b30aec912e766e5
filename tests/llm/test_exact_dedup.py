import hashlib

from pyspark.sql import functions as F

from rankloom.llm import shared as S
from rankloom.llm.exact_dedup import drop_exact_copies, exact_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 60_000
ROWS = [(1, "Same Text"), (2, "same text"), (3, "other"), (4, None), (5, ""), (6, "ÉCOLE"), (7, "école"), (8, "École"), (9, LONG), (10, LONG.upper()), (11, LONG + "x"),
        (12, "a" * 300 + "b"), (13, "a" * 300 + "c"), (3, "other"), (-5, "same text")] + [(100 + i, "copied often") for i in range(200)]


def plain(rows):
    norm = [(i, (t or "").translate(FOLD)) for i, t in rows]
    groups, taken, out = {}, set(), []
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    for i, t in norm:  # a row a row; one of those with the largest id stays
        stays = i == max(groups[t]) and t not in taken
        taken |= {t} if stays else set()
        out.append((i, max(groups[t]), len(groups[t]), stays, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_against_plain_python(documents, clashing):
    assert sorted(tuple(r) for r in exact_dedup(clashing(documents(ROWS)), hash_unique=True).collect()) == plain(ROWS)


def test_one_bucket_changes_nothing(documents):
    assert sorted(tuple(r) for r in exact_dedup(documents(ROWS), prefix_chars=1, hash_unique=True).collect()) == plain(ROWS)


def test_every_repeated_row_is_returned(documents):
    rows = [(1, "Abc"), (1, "abc"), (1, "Abc"), (2, "abc"), (3, "z"), (3, "z")]
    found = [tuple(r) for r in exact_dedup(documents(rows), hash_unique=True).collect()]
    assert sorted(found) == plain(rows) and len(found) == 6 and sum(r[3] for r in found) == 2


def test_a_hot_row_meets_no_single_task(documents, spark):
    docs = documents([(1, "a"), (2, "A"), (7, "b")]).unionByName(spark.range(20_000).selectExpr("cast(null as long) doc_id", "'' text", "'en' lang", "'s' source", "0L n_chars"))
    found = exact_dedup(docs)
    counts = {(r.doc_id, r.kept): r["count"] for r in found.groupBy("doc_id", "kept").count().collect()}
    assert counts == {(1, False): 1, (2, True): 1, (7, True): 1, (None, False): 19_999, (None, True): 1}
    sizes = found.groupBy(F.spark_partition_id()).count().collect()
    kept = drop_exact_copies(docs)
    assert kept.count() == 3 and max(r["count"] for r in sizes) < 20_000


def test_unique_content_is_not_read(documents):
    found = {r.doc_id: r.full_hash for r in exact_dedup(documents([(1, "a"), (2, "b"), (3, "b")])).collect()}
    assert found[1] is None and found[2] == found[3] is not None


def test_rows_that_stay(documents, clashing):
    docs = clashing(documents(ROWS))
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in plain(ROWS) if r[3])


def test_filter_lets_every_key_through(spark):
    keys = spark.range(0, 400_000, 3).selectExpr("id as k")
    for most in (15, 30):
        marked = S.KeyFilter(keys, "k", most).marked(spark.range(400_000).selectExpr("id as k"), F.col("k"), "hit")
        got = {tuple(r) for r in marked.groupBy(F.col("k") % 3 == 0, "hit").count().collect()}
        assert (True, True, 133_334) in got and not any(k and not hit for k, hit, _ in got)
        passed = sum(n for k, hit, n in got if hit and not k)
        assert passed < 40_000 if most == 30 else passed > 200_000
    assert not S.KeyFilter(keys.where("k < 0"), "k").marked(keys, F.col("k"), "hit").where("hit").count()


def test_rows_that_repeat_and_names_that_clash(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (1, "a", "y"), (1, "b", "z"), (None, "c", "n"), (None, "c", "n"), (None, "d", "n")]
    names = ("row", "id", "n", "p", "maybe", "bucket", "bitmap", "_slot", "times", "hash", "full_hash", "keep_id", "a.b", "id_")
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string").withColumns({c: F.lit(i) for i, c in enumerate(names)})
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    found = sorted(tuple(r) for r in kept.collect() if r.doc_id is not None)
    assert [r[1] for r in found] == ["a", "b"] and all(r[3:] == tuple(range(len(names))) for r in found)
    assert sorted(r.text for r in kept.collect() if r.doc_id is None) == ["c", "d"]


def test_null_ids(documents):
    rows = [(None, "x"), (None, "x"), (3, "x"), (None, "alone")]
    found = {tuple(r)[:4] for r in exact_dedup(documents(rows)).collect()}
    assert found == {(None, 3, 3, False), (3, 3, 3, True), (None, None, 1, True)}


def test_empty_table(documents, spark):
    empty = documents([(1, "a")]).where("doc_id > 1")
    assert exact_dedup(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_no_python_in_the_plan(documents):
    plan = exact_dedup(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
