"""op4: every column against a file put together byte by byte, sample by sample."""

from __future__ import annotations

import hashlib
import zlib

from nichefold.llm import q4_media

SAMPLE, PER_CHUNK, KEY_EVERY, RATE = q4_media.media.SAMPLE, q4_media.media.PER_CHUNK, q4_media.media.KEY_EVERY, q4_media.media.TIMESCALE


def n4(x: int) -> bytes:
    return x.to_bytes(4, "big")


def n2(x: int) -> bytes:
    return x.to_bytes(2, "big")


def slow_box(kind: str, *parts: bytes) -> bytes:
    body = b""
    for p in parts:
        body += p
    return n4(8 + len(body)) + kind.encode() + body


def slow_file(payload: bytes) -> tuple[bytes, int]:
    """The stored form of a payload, and where its samples begin."""
    n = len(payload) // SAMPLE
    chunks = [payload[i : i + PER_CHUNK * SAMPLE] for i in range(0, len(payload), PER_CHUNK * SAMPLE)]
    runs, before = [], None
    for number, c in enumerate(chunks, 1):
        if len(c) // SAMPLE != before:
            before = len(c) // SAMPLE
            runs.append((number, before))
    keys = [i + 1 for i in range(n) if i % KEY_EVERY == 0]
    unity = [0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000]
    whole = n4(0)  # version and flags
    kind = slow_box("ftyp", b"isom", n4(512), b"isomiso2mp41")

    def index(first: int) -> bytes:
        entry = slow_box(q4_media.media.CODEC.decode(), bytes(6), n2(1), bytes(8), n2(1), n2(8), n2(0), n2(0), n4(RATE << 16))
        at, places = first, []
        for c in chunks:
            places.append(at)
            at += len(c)
        table = slow_box(
            "stbl",
            slow_box("stsd", whole, n4(1), entry),
            slow_box("stts", whole, n4(1), n4(n), n4(SAMPLE)),
            slow_box("stss", whole, n4(len(keys)), *map(n4, keys)),
            slow_box("stsc", whole, n4(len(runs)), *[n4(a) + n4(k) + n4(1) for a, k in runs]),
            slow_box("stsz", whole, n4(SAMPLE), n4(n)),
            slow_box("stco", whole, n4(len(places)), *map(n4, places)),
        )
        source = slow_box("dinf", slow_box("dref", whole, n4(1), n4(12) + b"url " + n4(1)))
        sound = slow_box("minf", slow_box("smhd", whole, bytes(4)), source, table)
        inner = slow_box("mdia", slow_box("mdhd", whole, n4(0), n4(0), n4(RATE), n4(len(payload)), n2(0x55C4), n2(0)), slow_box("hdlr", whole, n4(0), b"soun", bytes(12), b"\0"), sound)
        head = slow_box("tkhd", n4(7), n4(0), n4(0), n4(1), n4(0), n4(len(payload)), bytes(8), n2(0), n2(0), n2(256), n2(0), *map(n4, unity), n4(0), n4(0))
        film = slow_box("mvhd", whole, n4(0), n4(0), n4(RATE), n4(len(payload)), n4(0x10000), n2(256), bytes(10), *map(n4, unity), bytes(24), n4(2))
        return slow_box("moov", film, slow_box("trak", head, inner))

    start = len(kind) + len(index(0)) + 8
    return kind + index(start) + slow_box("mdat", payload), start


def test_all_columns(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9001, None), (9002, ""), (9003, "x" * 64), (9004, "é" * 200_000), (9005, "x" * (SAMPLE * PER_CHUNK)), (9006, "x" * (SAMPLE * PER_CHUNK + 1))], "doc_id long, text string")
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q4_media.query(spark, str(tmp_path)).collect()}
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        raw = (d.text or "").encode()
        payload = raw
        while not payload or len(payload) % 64:
            payload += b"\0"
        stored, start = slow_file(payload)
        n = len(payload) // SAMPLE
        ranges = b""
        for key in range(0, n, KEY_EVERY):
            ranges += (start + key * SAMPLE).to_bytes(8, "little") + (start + min(n, key + KEY_EVERY) * SAMPLE).to_bytes(8, "little")
        keys = -(-n // KEY_EVERY)
        feature = f"{q4_media.media.CODEC.decode()}|soun|{len(payload) / RATE:.6f}|{n}|{keys}|{hashlib.sha256(ranges).hexdigest()[:16]}"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, keys)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want[:6], d.doc_id
        assert (r.feature, r.n_keyframes) == want[6:], d.doc_id
