import random
import re

import pytest

from rankloom.llm import pii

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    digits = lambda s: re.sub(r"\D", "", s)
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15],
    ]


FIXED = ["", "mail a.b+c@d-e.co.uk now", "x@y a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 010.001.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999.", "+49 30 123456 und +1"]


@pytest.mark.parametrize("letters", ["a.@-1 ", "12.3 ", "0123456789 -", "+1 ().-2345678", "a@b.c+1-2 %_é"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    texts = FIXED + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert all(pii.base_spans(t) == plain(t) for t in texts)


def test_linear_on_hostile_texts():
    import time

    began = time.time()
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "a@b." * 100_000, "+1" + "(" * 300_000):
        pii.base_spans(t)
    assert time.time() - began < 30


def corpus():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(20)) + " common words here") for i in range(200)]
    for i in range(6):  # the term `gardener` appears only near this address; `common` everywhere
        rows.append((1000 + i, f"{word()} {word()} common gardener jane@farm.example {word()} {word()}"))
    rows += [(2000 + i, f"{word()} common 10.0.0.{i} {word()}") for i in range(5)]
    return rows + [(3000, None), (3001, ""), (3002, "long " * 50_000 + "+1 (555) 010-9999"), (1000, rows[200][1])]


def test_terms_that_disclose(documents, clashing):
    rows = corpus()
    found = {r.doc_id: r for r in pii.find_personal(clashing(documents(rows))).collect()}
    text = dict(rows)
    for i in range(1000, 1006):
        at = text[i].index("gardener")
        assert found[i].terms == found[i].removed == f"term:{at}:{at + 8}"
        clean = pii.sanitise(text[i], f"{found[i].base},{found[i].terms}", found[i].removed)
        assert "gardener" not in clean and "[email]" in clean and "common" in clean
    assert all(not r.terms for i, r in found.items() if not 1000 <= i < 1006)
    for i, t in rows:
        spans = plain(t or "")
        assert found[i].base == ",".join(f"{k}:{a}:{b}" for k, s in zip(KINDS, spans) for a, b in s)
        assert [found[i][f"n_{k}"] for k in KINDS] == [len(s) for s in spans]


def test_shares_against_plain_counts(documents):
    """Every flagged pair has the share that counts by hand give; pairs below the threshold stay out."""
    import math

    rows = corpus()[:200] + [(500 + i, f"{w} both jane@farm.example x") for i, w in enumerate(("apple", "bread", "cider", "dates"))] + [(600, "both alone")]
    found = pii.find_personal(documents(rows), generalise=0.5)
    terms = {r.doc_id: r.terms for r in found.collect() if r.terms}
    share = math.log2(len(rows) * 4 / (4 * 5)) / math.log2(len(rows) / 4)
    assert share >= 0.5 and set(terms) == {500, 501, 502, 503}
    assert not any(r.terms for r in pii.find_personal(documents(rows), generalise=share + 0.01, remove=1).collect())


def test_counts_survive_flushing(documents, spark):
    docs = documents([(i, f"alpha beta{'x' * (i % 3)} gamma") for i in range(30)])
    terms = spark.createDataFrame([("alpha",), ("betax",), ("absent",)], "t string")
    assert {r.t: r.df_t for r in pii.term_counts(docs, terms, "text", flush=1).collect()} == {"alpha": 30, "betax": 10}


def test_terms_are_marked_wherever_they_stand(documents):
    """Also far from the mention, and on their own nowhere else; each pair stays with its own entity."""
    rows = corpus()[:200] + [(1000 + i, f"{w} gardener jane@farm.example " + "common " * 100 + "Gardener again") for i, w in enumerate(("apple", "bread", "cider"))]
    rows += [(None, rows[-1][1]), (2000, "x joe@farm.example common")]
    found = pii.find_personal(documents(rows)).collect()
    for r in found:
        text = dict(rows)[r.doc_id]
        want = [m.span() for m in re.finditer("gardener", text, re.I)] if text and "jane@" in text else []
        assert r.terms == ",".join(f"term:{a}:{b}" for a, b in want), r
    assert sum("term" in r.terms for r in found) == 4


def test_places_and_terms_agree():
    rng = random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("abcdABCD éÉßİ1_² .") for _ in range(rng.randint(0, 80)))
        every = [(m.group().lower(), *m.span()) for m in re.finditer(r"[^\W\d_]+", text)]
        terms = sorted(pii.distinct_terms(text))
        assert terms == sorted({t for t, _, _ in every})
        for some in (terms, terms[::2]):
            assert not some or pii.places(text, some) == [x for x in every if x[0] in some]


def test_dense_addresses_stay_small(documents):
    import tracemalloc

    text = " ".join(f"user{i % 50}@host{i}.example name" for i in range(30_000))
    found = pii.base_spans(text)
    tracemalloc.start()
    n = sum(1 for _ in pii.surroundings(text, found, 120))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found[0]) == 30_000 and n >= 60_000 and peak < 60_000_000


def test_empty_table(documents):
    assert pii.find_personal(documents([(1, "a")]).where("doc_id > 1")).count() == 0


def test_sanitise_overlaps_and_nulls():
    assert pii.sanitise(None, "") == "" and pii.sanitise("abcdef", "email:1:4,term:2:5") == "a[email]ef"


def test_copies_change_no_share(documents):
    """A term that never occurs without its entity keeps its share of 1 when its documents are copied."""
    rows = corpus()[:200] + [(1000 + 100 * k + i, f"{w} gardener jane@farm.example") for i, w in enumerate(("apple", "bread", "cider")) for k in range(20)]
    found = [r for r in pii.find_personal(documents(rows)).collect() if r.doc_id >= 1000]
    assert len(found) == 60 and all(r.terms == r.removed == "term:6:14" for r in found)


def test_short_names_disclose_too(documents):
    """Names of two letters and more, in any script; one letter is none unless it is asked for."""
    names = ("Kim", "Lee", "王小明", "李四", "Z")
    rows = corpus()[:200] + [(1000 + 10 * k + i, f"{w} {name} p{k}@farm.example") for k, name in enumerate(names) for i, w in enumerate(("apple", "bread", "cider"))]
    marked = lambda **how: {dict(rows)[r.doc_id].split()[1] for r in pii.find_personal(documents(rows), **how).collect() if r.terms and r.doc_id >= 1000}
    assert marked() == {"Kim", "Lee", "王小明", "李四"} and marked(least=1) == set(names) and marked(least=4) == set()


def test_places_take_linear_time():
    import time

    words = [f"w{''.join(chr(97 + int(d)) for d in str(i))}" for i in range(80_000)]
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert len(pii.places(" ".join(words[:n]), words[:n])) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_a_page_of_addresses_and_hot_rows(documents, spark):
    """Many entities under the same few surroundings, and one row very often."""
    page = " ".join(f"ref u{i}@host.example" for i in range(2000))
    rows = corpus()[:100] + [(900 + i, f"{w} {page}") for i, w in enumerate(("apple", "bread", "cider"))]
    docs = documents(rows).unionByName(spark.range(5000).selectExpr("cast(null as long) doc_id", "'' text", "'en' lang", "'s' source", "0L n_chars"))
    found = pii.find_personal(docs)
    assert found.count() == len(rows) + 5000 and found.where("n_email = 2000").count() == 3
