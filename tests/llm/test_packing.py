"""op11 against a slow packer and the tokenizers library."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from nichefold.llm import packing, q11_packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def run(docs, **options):
    return packing.pack(docs, public_tokenizers.path(q11_packing.RANKS), public_tokenizers.PATTERN, q11_packing.SPECIAL, q11_packing.END, **options)


def slow_windows(pieces, windows, until):
    """Windows by the rule, over a plain list of (place, document, start, length) searched from end to end; what is left."""
    out, n = [], len(pieces)
    while sum(p[3] for p in pieces) >= until:
        total = sum(p[3] for p in pieces)
        first = max(pieces, key=lambda p: (p[3], -p[0]))
        size = min(next((w for w in windows if w >= first[3]), windows[-1]), 1 << (total.bit_length() - 1))
        pieces.remove(first)
        if first[3] > size:
            pieces.append((n, first[1], first[2] + size, first[3] - size))
            n += 1
        inside, gap = [(first[1], first[2], min(first[3], size))], size - min(first[3], size)
        while gap:
            fit = [p for p in pieces if p[3] <= gap]
            p = max(fit, key=lambda p: (p[3], -p[0])) if fit else min(pieces, key=lambda p: (p[3], p[0]))
            pieces.remove(p)
            took = min(gap, p[3])
            if took < p[3]:
                pieces.append((n, p[1], p[2] + took, p[3] - took))
                n += 1
            inside.append((p[1], p[2], took))
            gap -= took
        out.append((size, inside))
    return out


def slow_pack(lengths, shortest, longest):
    """{document: pieces (start, length, window, offset)} of documents of one task."""
    windows = packing.tiers(shortest, longest)
    made, pieces = [], []
    for doc, n in enumerate(lengths):
        made += [(longest, [(doc, at, longest)]) for at in range(0, n - longest + 1, longest)]
        if n % longest:
            pieces.append((len(pieces), doc, n - n % longest, n % longest))
    made += slow_windows(pieces, windows, shortest)
    rest = sorted(pieces, key=lambda p: (-p[3], p[0]))
    made += slow_windows([(i, *p[1:]) for i, p in enumerate(rest)], packing.tiers(1, longest), 1)
    out = []
    for size, inside in made:
        offset = 0
        for doc, start, n in inside:
            out.append((doc, start, n, size, offset))
            offset += n
        assert offset == size
    return sorted(out)


def whole(rows, ids):
    """Checks that every id lies in one piece, that sequences are full and gapless, and pieces' checksums."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[d])
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == rs[0].window <= packing.LONGEST and at & (at - 1) == 0
        assert len({(r.window, r.step) for r in rs}) == 1


def test_query_over_all_documents(spark, small, tokenizer):
    rows = q11_packing.query(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    whole(rows, {d.doc_id: ids_of(tokenizer, d.text) for d in docs})


def test_slow_packer_packs_the_same(spark, tokenizer):
    texts = ["word " * n for n in (5, 900, 40, 41, 300, 3000, 7, 7, 7, 0, 130, 64, 2047, 255, 1, 600)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    ids = {i: ids_of(tokenizer, t) for i, t in enumerate(texts)}
    for shortest, longest in ((256, 2048), (64, 512), (8, 8), (1, 2048)):
        rows = run(docs, shortest=shortest, longest=longest).collect()
        got = sorted((r.doc_id, r.start, r.length, r.window, r.offset) for r in rows)
        assert got == slow_pack([len(ids[i]) for i in range(len(texts))], shortest, longest)
        whole(rows, ids)


def test_many_tasks_and_chunks(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 16)
    monkeypatch.setattr(packing, "POOLED", 3)
    monkeypatch.setattr(packing, "STEP_WINDOWS", 2)
    texts = ["so many words " * (i * 37 % 211) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows = run(docs).collect()
    whole(rows, {i: ids_of(tokenizer, t) for i, t in enumerate(texts)})
    steps: dict = {}
    for r in rows:
        if r.offset == 0:
            steps.setdefault(r.window, {}).setdefault(r.step, []).append(r)
    n = len({r.step for r in rows})
    assert n == -(-sum(r.length for r in rows) // (2048 * 2))
    for per in steps.values():
        sizes = [len(per.get(s, [])) for s in range(n)]
        assert max(sizes) - min(sizes) <= 1


def test_odd_rows(spark, tokenizer):
    long = "x" * 300_000 + " " * 100_000 + "é😀" * 20_000
    rows = [(1, "a b", "z"), (2, None, None), (3, "", "z"), (4, "<|endoftext|> and <|endoftext|>", "z"), (5, long, "z"), (6, "same", "z"), (7, "same", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `sequence_id` string").withColumn("start", F.lit(1)).withColumn("a.b", F.lit(2))
    out = run(docs).collect()
    whole(out, {r[0]: ids_of(tokenizer, r[1]) for r in rows})
    twice = run(docs.filter("doc_id = 6").unionByName(docs.filter("doc_id = 6"))).collect()
    assert sum(r.length for r in twice) == 2 * len(ids_of(tokenizer, "same"))
    assert run(docs.limit(0)).collect() == []
    named = run(docs.select(F.concat(F.lit("n"), "doc_id").alias("name"), F.col("text").alias("body")), id_col="name", text_col="body").collect()
    assert {r.doc_id for r in named} == {f"n{i}" for i in range(1, 8)}
    nameless = run(docs.select(F.lit(None).cast("long").alias("doc_id"), "text")).collect()
    assert sum(r.length for r in nameless) == sum(r.length for r in out)


def test_ranks_are_the_vocabulary(tokenizer):
    """Every seventh code point beside letters, numbers, signs and spaces is split and encoded as by the tokenizers library."""
    with open(public_tokenizers.path(q11_packing.RANKS), "rb") as f:
        ids = packing.Ids(f.read(), public_tokenizers.PATTERN, q11_packing.SPECIAL, q11_packing.END)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}b 1{chr(c)}2 .{chr(c)}! {chr(c)}  {chr(c)}\n{chr(c)}" for c in points[at : at + 20_000]]
        want = tokenizer.encode_batch(texts, add_special_tokens=False)
        assert all(ids(t)[:-1].tolist() == w.ids for t, w in zip(texts, want, strict=True))


def test_windows_are_powers_of_two():
    with pytest.raises(ValueError, match="powers of two"):
        packing.tiers(100, 2048)
    assert packing.tiers(256, 2048) == [256, 512, 1024, 2048]
