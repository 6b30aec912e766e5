"""Entries of JSON files by ranges of bytes, against whole-file parsing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rankloom.sources import files
from rankloom.sources.json_parts import _cut, json_entries, structure


def value(rng, depth=0):
    text = lambda: "".join(rng.choice('ab"\\{}[],: é中\n') for _ in range(rng.randint(0, 6)))
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 4:
        return [text(), rng.randint(-9, 9), None, "\\" * rng.randint(0, 5)][kind]
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {text(): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def parts(data, length):
    """All ranges cut one by one, each started by what a scan of everything before it gives."""
    import numpy as np

    out = []
    for start in range(0, len(data), length):
        marks, kinds, quotes = structure(np.frombuffer(data[:start], np.uint8), 0, 0)
        depth = sum((k in b"{[") - (k in b"}]") for k in kinds.tolist())
        out += [e.decode() for e in _cut(Bytes(data), len(data), start, length, quotes % 2, depth) if e.strip()]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_ranges_of_any_length(seed):
    rng = random.Random(seed)
    whole = [value(rng) for _ in range(rng.randint(0, 6))] if seed % 2 else {f"k{i}\\\"": value(rng) for i in range(rng.randint(0, 6))}
    data = json.dumps(whole, ensure_ascii=seed % 3 == 0, indent=rng.choice([None, 1])).encode()
    for length in (1, 2, 3, 7, 30, 10_000):
        found = parts(data, length)
        again = [json.loads(e) for e in found] if seed % 2 else {k: v for e in found for k, v in json.loads("{" + e + "}").items()}
        assert again == whole, (length, data)


def test_several_tasks_read_one_file(spark, tmp_path):
    rng = random.Random(1)
    whole = {f"code {i}, \"x\"": {"n": value(rng)} for i in range(500)}
    (tmp_path / "m.json").write_text(json.dumps(whole, ensure_ascii=False), encoding="utf-8")
    found = json_entries(spark, str(tmp_path / "m.json"), 512)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert {k: v for r in rows for k, v in json.loads("{" + r.value + "}").items()} == whole and len(rows) == 500
    assert len({r.task for r in rows}) > 3 and all(r.keyed for r in rows)


def test_readers_on_empty_and_listed_files(spark, tmp_path):
    for name, text in (("e.json", "{}"), ("l.json", "[ ]"), ("n.json", "")):
        (tmp_path / name).write_text(text)
        assert files.read_vocabulary(spark, str(tmp_path / name)).count() == 0
    (tmp_path / "s.json").write_text('{"a, b": "x}", "c": "\\"y\\""}')
    assert sorted(map(tuple, files.read_string_map(spark, str(tmp_path / "s.json")).collect())) == [("a, b", "x}"), ("c", '"y"')]
