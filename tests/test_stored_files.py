"""Digests by ranges, trees that appear whole, receipts that one reader gets."""

import hashlib
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rankloom.functions import provenance as G
from rankloom.operators.checks import Refused
from rankloom.sources import digests as D
from rankloom.sources import files


def plain(data, chunk, fan):
    level = [hashlib.sha256(data[i : i + chunk]).hexdigest() for i in range(0, max(1, len(data)), chunk)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def test_digests_depend_on_bytes_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 100)
    monkeypatch.setattr(D, "FAN", 3)
    sizes = [0, 1, 99, 100, 101, 300, 301, 2750]
    datas = {f"f{n}": os.urandom(n) for n in sizes}
    for name, data in datas.items():
        (tmp_path / name).write_bytes(data)
    for each in (1, 100, 250, 10_000):
        found = {r["name"].rsplit("/", 1)[-1]: (r["size"], r.digest) for r in D.file_digests(spark, [str(tmp_path)], each).collect()}
        assert found == {name: (len(d), plain(d, 100, 3)) for name, d in datas.items()}
    assert D.file_digests(spark, [str(tmp_path / "missing")]).count() == 0


def test_a_sparse_file_of_three_gigabytes(spark, tmp_path):
    with open(tmp_path / "big", "wb") as out:
        out.truncate(3 << 30)
        out.seek((2 << 30) + 5)
        out.write(b"x")
    one = G.data_revision(spark, [str(tmp_path / "big")])
    with open(tmp_path / "big", "r+b") as out:
        out.seek((2 << 30) + 5)
        out.write(b"y")
    assert len(one) == 12 and one != G.data_revision(spark, [str(tmp_path / "big")])


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_a_failed_job_leaves_the_old_tree(spark, tmp_path):
    cells = spark.createDataFrame([(i, "t", "en") for i in range(6)], "record_id long, type string, lang string")
    gold = spark.createDataFrame([(i, f"c{i}") for i in range(6)], "record_id long, code string")
    assert files.write_gold_tree(gold, cells, str(tmp_path / "tree")) == 6
    before = tree(tmp_path / "tree")
    bad = gold.withColumn("code", F.when(F.col("record_id") == 5, F.raise_error(F.lit("broken"))).otherwise(F.col("code")))
    with pytest.raises(Exception, match="broken"):
        files.write_gold_tree(bad, cells, str(tmp_path / "tree"))
    assert tree(tmp_path / "tree") == before and [p.name for p in tmp_path.iterdir()] == ["tree"]
    assert files.write_gold_tree(gold.where("record_id < 2"), cells, str(tmp_path / "tree")) == 2 and len(tree(tmp_path / "tree")) == 2


def test_of_ten_concurrent_reads_one_succeeds(tmp_path):
    def read(_):
        try:
            G.Receipts(str(tmp_path / "r")).require_unread()
            return True
        except Refused:
            return False

    with ThreadPoolExecutor(10) as pool:
        assert sum(pool.map(read, range(10))) == 1
    with ThreadPoolExecutor(10) as pool:
        list(pool.map(lambda i: G.Receipts(str(tmp_path / "r")).require_unread(f"reason {i}"), range(10)))
    assert sorted(r["justification"] for r in G.Receipts(str(tmp_path / "r")).reads()) == sorted(["", *(f"reason {i}" for i in range(10))])
