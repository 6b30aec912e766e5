import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from rankloom.llm import simhash as S


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    """pairs of (id, fingerprint)."""
    label = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for (i, f), (j, g) in combinations(pairs, 2):
            if (f ^ g).bit_count() <= 3 and label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    return label


def texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(400)) for _ in range(12)]
    out = list(base)
    for b in base:
        w = b.split()
        for _ in range(4):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            out.append(" ".join(v))
    return out + [None, "", "one", "One", "two words", "three little words", "x" * 50_000, "Aé É " * 30]


def test_fingerprints(documents):
    rows = list(enumerate(texts()))
    found = {r.doc_id: r.fp % (1 << 64) for r in S.fingerprints(documents(rows)).collect()}
    assert found == {i: plain_fingerprint(t) for i, t in rows}


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 7)
    assert all(S.fingerprint(t) == plain_fingerprint(t) for t in texts())


def test_masks_cover_every_pair_within_the_radius():
    for radius, bits in ((1, 8), (2, 10), (3, 12)):
        masks = S.covering_masks(radius, bits)
        for n in range(radius + 1):
            assert all(any(m & sum(1 << b for b in d) == 0 for m in masks) for d in combinations(range(bits), n))
    masks, rng = S.covering_masks(), random.Random(1)
    for _ in range(5000):
        flip = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(m & flip == 0 for m in masks)


@pytest.mark.parametrize("block", [4, 2048])
def test_components(documents, clashing, block):
    rows = list(enumerate(texts())) + [(3, texts()[3])]
    found = {r.doc_id: r.component_id for r in S.simhash_components(clashing(documents(rows)), block=block).collect()}
    assert found == plain_components([(i, plain_fingerprint(t)) for i, t in dict(rows).items()])
    assert len(set(found.values())) < len(found) - 20


def test_clusters_of_chained_fingerprints(spark):
    """Chains, stars and a dense bucket, straight from fingerprints, with blocks smaller than the buckets."""
    rng, fps = random.Random(5), set()
    at = rng.getrandbits(64)
    for _ in range(60):  # a chain: neighbours differ in three bits
        fps.add(at)
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
    hub = rng.getrandbits(64)
    fps |= {hub ^ (1 << a) ^ (1 << b) for a, b in combinations(range(20), 2)}
    fps |= {rng.getrandbits(64) for _ in range(50)}
    pairs = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in pairs], "fp long, rep long")
    parts = {r.node: r.component for r in S.connected_components(S.similarity_forest(df, len(pairs), block=16)).collect()}
    want = plain_components(pairs)
    assert {i: parts.get(i, i) for i, _ in pairs} == want


def test_forest_is_small():
    rng = np.random.default_rng(0)
    u, v = rng.integers(0, 500, 20_000), rng.integers(0, 500, 20_000)
    a, b = S.forest(u, v)
    assert len(a) == 499 and set(b) == {0}


def test_empty_and_null_ids(documents):
    empty = documents([(1, "a")]).where("doc_id > 1")
    assert S.simhash_components(empty).count() == 0
    found = S.simhash_components(documents([(None, "a b c d"), (4, "a b c d"), (None, "else")])).collect()
    assert sorted((r.component_id is None, r.component_id or 0) for r in found) == [(False, 4), (False, 4), (True, 0)]
