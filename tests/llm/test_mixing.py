import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm.mixing import mix_sources, mixed_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORDS.findall(text or ""))


def targets(rows):
    """Shares by weight; the excess over three times a source's words goes to the others until none is above."""
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / max(1, sum(weight[f] for f in free)) for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return sizes, target
        capped |= over


def rows():
    out = [(i, "w " * (i % 17 + 1), "en", f"s{i % 7}") for i in range(300)]
    out += [(1000 + i, "hot word\tpair\n" * 3, "en", "hot") for i in range(400)]
    out += [(2000, None, "en", "s1"), (2001, "", "en", "empty"), (2002, "x " * 40_000, "en", None), (2003, " \t\n ", "en", None), (5, "w w", "en", "s5"), (5, "w w", "en", "s5")]
    return out


def test_targets_and_budgets(documents, clashing):
    data = rows()
    found = mix_sources(clashing(documents(data))).collect()
    assert len(found) == len(data)
    sizes, target = targets(data)
    of, taken = {(i, size(t)): s for i, t, _, s in data}, Counter()
    for r in found:
        s = of[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == int(target[s] + 1e-9)


def test_reruns_agree(documents):
    one, two = (sorted(map(tuple, mix_sources(documents(rows(), partitions=p)).collect())) for p in (2, 5))
    assert one == two


def test_no_words_and_no_rows(documents):
    assert [(r.taken, r.target) for r in mix_sources(documents([(1, None), (2, " ")])).collect()] == [(0, 0.0), (0, 0.0)]
    assert mix_sources(documents([(1, "a")]).where("doc_id > 1")).count() == 0


def test_documents_of_the_mix(documents, clashing):
    data = rows()
    docs = clashing(documents(data)).withColumn("src", F.col("source")).withColumn("epochs", F.lit(9))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = mixed.collect()
    assert all(r.src == r.source and (r.epochs, r.key) == (9, 7) for r in taken)
    copies, plan = Counter(r.doc_id for r in taken), {r.doc_id: r for r in mix_sources(docs).collect()}
    for i, r in plan.items():
        if r["size"] and i != 5:
            assert abs(copies[i] * r["size"] - r.taken) <= r["size"] / 2
    words, target = defaultdict(int), targets(data)[1]
    for r in taken:
        words[r.source] += size(r.text)
    for s, w in target.items():
        assert abs(words[s] - w) <= 40_000 if s is None else abs(words[s] - w) <= 20


def test_ids_that_repeat_or_miss(documents):
    data = [(1, f"w{i} " * 4, "en", "a") for i in range(50)] + [(2, "same " * 4, "en", "b")] * 50 + [(None, f"v{i} " * 4, "en", "c") for i in range(100)]
    docs = documents(data)
    sizes, target = targets(data)
    planned, mixed = Counter(), Counter()
    for r in mix_sources(docs).collect():
        planned[{1: "a", 2: "b", None: "c"}[r.doc_id]] += r.taken
    for r in mixed_documents(docs).collect():
        mixed[r.source] += size(r.text)
    for s in sizes:
        assert planned[s] == int(target[s] + 1e-9) and abs(mixed[s] - target[s]) <= 2.5


def test_many_sources_are_not_broadcast(documents):
    one, two = (sorted(map(tuple, mixed_documents(documents(rows()), few=few).collect()), key=str) for few in (100_000, 1))
    assert one == two


def test_native(documents):
    plan = mix_sources(documents(rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
