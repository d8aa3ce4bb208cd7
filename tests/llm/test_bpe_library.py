"""op2 against the tokenizers library: its query on whole tables, and every code point."""

from __future__ import annotations

import hashlib

import pytest

from nichefold.llm import bpe
from nichefold.llm import queries as llm_queries
from nichefold.llm.q2_bpe import vocabulary

library = pytest.importorskip("tokenizers")
ROWS = [(1, None), (2, ""), (2, "same id"), (2, "same id"), (None, "İΣΑΣ ǅ ꟋꟌ \U00010d50"), (4, "long " * 40_000), (5, "\U00011382\U000113c9 a̖̕ <|endoftext|>x")]


@pytest.fixture(scope="module")
def reference():
    return library.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def tok():
    with open(vocabulary(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


def test_every_code_point(reference, tok):
    """Each alone between letters, doubled, and between combining marks."""
    form = "a{0}a {0}{0} 1{0} a̕{0}̖b"
    texts = [" ".join(form.format(chr(c)) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 256)]
    for a, t, want in zip(range(0, 0x110000, 256), texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(memoryview(tok.encode(t)).cast("I")) == want.ids, hex(a)


def digests(reference, text):
    ids = reference.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(reference.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_query_on_all_documents(spark, small, reference):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm_queries.queries()["op2_bpe"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert got == {r.doc_id: digests(reference, r.text) for r in docs}


def test_query_on_odd_rows(spark, tmp_path, reference):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in llm_queries.queries()["op2_bpe"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, *digests(reference, t)) for d, t in ROWS), key=repr)


def test_clashing_name(spark):
    df = spark.createDataFrame([(1, "one two", "mine")], "doc_id long, text string, ids string")
    r = bpe.tokenise(df, vocabulary()).first()
    assert r.asDict().keys() == {"doc_id", "text", "ids", "ids_1"}
    assert r.ids == "mine"
    assert len(r.ids_1) == 2
