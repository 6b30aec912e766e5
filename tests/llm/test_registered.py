"""Every registered query of the text operators on the smallest sample tables, against plain Python, the libraries, or SQL."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
from rankloom.llm import html_text, registry
from tests.llm.test_alignment import check
from tests.llm.test_pii import KINDS, plain
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def found(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def held_out(doc_id, by, at):
    return zlib.crc32(str(doc_id).encode()) % by == at


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {*registry.QUERIES, "pipeline"} <= names and len(registry.QUERIES) == 13


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    order = lambda df: df.sort_values(list(df.columns)).reset_index(drop=True)
    got, want = order(got), order(want)
    assert got.shape == want.shape and len(got)
    for c in got.columns:
        assert np.allclose(got[c], want[c]) if got[c].dtype.kind == "f" else got[c].tolist() == want[c].tolist(), c


def test_op1(spark, docs):
    rows = found(spark, "op1_language")
    assert len(rows) == len(docs) and all(r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    known = {d.lang for d in docs.values()}
    for r in rows:
        assert (r.lang_pred in known) if any(c.isalpha() for c in docs[r.doc_id].text or "") else r.lang_pred == "und"
    out = [r for r in rows if r.held_out and r.lang_pred != "und" and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in out]) > 0.9


def test_op2(spark, docs):
    prints = {i: plain_fingerprint(d.text) for i, d in docs.items()}
    want = plain_components(sorted(prints.items()))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found(spark, "op2_simhash")} == {(i, f"{f:016x}", want[i]) for i, f in prints.items()}


def test_op3(spark, docs):
    rows = found(spark, "op3_quality")
    assert len(rows) == len(docs) and all(r.held_out == held_out(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in out]) > 0.9


def test_op4(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = found(spark, "op4_main_text")
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, html_text.main_text(pages[r.page_id].html), len(r.text))
        assert not re.search(r"<[a-z/]|  |\\n\\n\\n", r.text) and r.text == r.text.strip()


def test_op8(spark, docs):
    tok, start = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0
    for r in sorted(found(spark, "op8_token_files"), key=lambda r: r.start):
        ids = tok.encode(docs.get(r.doc_id).text or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op9(spark, docs):
    tok, sha = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = found(spark, "op9_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        ids = tok.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_op10(spark, docs):
    rows = found(spark, "op10_personal_data")
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain(docs[r.doc_id].text or "")
        base = ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans) for a, b in own)
        assert [r[f"n_{k}"] for k in KINDS] == [len(own) for own in spans] and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans == base or r.spans.startswith(f"{base}," if base else "term:")
        assert all(s.startswith("term:") for s in r.spans.split(",")[base.count(",") + bool(base):] if s)


def test_op11(spark, docs):
    class Named:
        def __init__(self, row):
            self.__dict__ = row.asDict() | {"groups": row.groups_sha256}

    ids = sorted(docs)
    got = {r.doc_id: Named(r) for r in found(spark, "op11_alignment")}
    assert sorted(got) == ids
    check({i: got[d] for i, d in enumerate(ids)}, [docs[d].text for d in ids], digest=True)
