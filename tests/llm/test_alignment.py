import bisect
import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rankloom.llm import alignment
from rankloom.llm.alignment import Aligner, Stripes, align, pair_counts, stretches

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, it's quick.\nTwo  spaces and a tab\there ", " leading", "", None, "a", " ", "  ", "ünïcödé naïve 王小明 和 朋友", "x y  z 　w",
    "block ▁ mark", "▁", "<|endoftext|> and <s> </s> <unk> <0x41>", "emoji 👩‍👩‍👧 done", "123 4567 89.10", "The quick brown fox, it's quick.", "é \x00 \x1c \x85   end",
    "word " * 3000, "q" * 5000, "a b" * 400 + "\r\n  x",
]


def plain(texts):
    """(n_a, n_b, groups, links) of each text by whole-text encoding, None for texts without tokens; and counts of id pairs."""
    sides = Aligner(*PATHS)
    a, b = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    out, counts = [], Counter()
    for text in texts:
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        spelled = [[t[i] for i in own] for t, own in zip(sides.bytes_of, ids)]
        if not text or any(b"".join(s) != f" {text}".encode() for s in spelled):
            out.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in spelled]
        spans = [list(zip([0, *e], e, own)) for e, own in zip(ends, ids)]
        shut = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in shut]
        for side, own in enumerate(spans):
            for _, end, i in own:
                groups[bisect.bisect_left(shut, end)][side].append(i)
        links, at = [], 0
        for lo, hi, i in spans[0]:
            while spans[1][at][1] <= lo:
                at += 1
            k = at
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((i, spans[1][k][2]))
                k += 1
        counts.update(links)
        out.append((len(ids[0]), len(ids[1]), len(shut), groups, links))
    return out, counts


def check(got, texts, digest=False):
    want, counts = plain(texts)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        numbers = (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum)
        if w is None:
            assert numbers == (0,) * 6 and r.groups == "", texts[i]
            continue
        n_a, n_b, n_groups, groups, links = w
        assert numbers == (n_a, n_b, n_groups, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)), texts[i]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert r.groups == (hashlib.sha256(text.encode()).hexdigest() if digest else text)
    return counts, best


def test_against_whole_text_encoding(spark, documents, clashing):
    docs = clashing(documents(list(enumerate(TEXTS))))
    counts, best = check({r.doc_id: r for r in align(docs, *PATHS).collect()}, TEXTS)
    found = {(r.a_id, r.b_id): (r["count"], r.best) for r in pair_counts(docs, *PATHS).collect()}
    assert found == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_narrow_stripes_many_blocks_and_nothing_remembered(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCKS", 1)
    rows = [f"{t} {i}" for i, t in enumerate(["the hot word the", "a cold one", "the the the"] * 7)]
    docs = documents(list(enumerate(rows)), partitions=6)
    check({r.doc_id: r for r in align(docs, *PATHS, stripe_cells=1, teams=3).collect()}, rows)


def test_digest_is_of_the_groups(spark, documents):
    docs = documents(list(enumerate(TEXTS[:8])))
    texts, digests = ({r.doc_id: r.groups for r in align(docs, *PATHS, groups=g).collect()} for g in ("text", "digest"))
    assert digests == {i: hashlib.sha256(t.encode()).hexdigest() if t else "" for i, t in texts.items()}


def test_repeated_rows_null_ids_and_no_rows(spark, documents):
    rows = [(1, "same words"), (1, "same words"), (None, "same words"), (None, None)]
    got = sorted((r.n_a, r.count_sum) for r in align(documents(rows), *PATHS).collect())
    assert [g[0] for g in got] == [0, 2, 2, 2] and len({g for g in got[1:]}) == 1
    assert align(documents([(1, "x")]).limit(0), *PATHS).count() == 0


def test_stretches_are_the_text():
    texts = [t for t in TEXTS if t]
    parts, first = stretches(pa.array(texts))
    joined = [b"".join(own) for own in np.split(np.array(parts.to_pylist(), object), first[1:])]
    assert joined == [f" {t}".encode() for t in texts]


def test_forgetting(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    sides = Aligner(*PATHS)
    for parts in ([b" a", b" b"], [b" c", b" d"], [b" d", b" e", b" f", b" g"]):
        place = sides.places(parts)
        counts, *_ = sides.held()
        assert place.tolist() == list(range(len(place))) and (counts[place, :3] == 1).all()


@pytest.mark.parametrize("cells", [1, 100_000, 8_000_000, 10**12])
def test_every_id_has_one_row(cells):
    s = Stripes(50_256, 32_000, cells)
    ids = np.arange(s.n_b)
    assert len(set(zip((ids % s.n).tolist(), (ids // s.n).tolist()))) == s.n_b and (ids // s.n).max() < s.rows
