"""Damaged files, clashing column names and ids of other types."""

from __future__ import annotations

import gzip
import os
import struct

import pytest
from pyspark.sql import functions as F

from nichefold.llm import language, line_dedup, media, quality_model, warc

u = lambda *x: b"".join(i.to_bytes(4, "big") for i in x)


def movie(stsz, stsc, stco, stss=b"", data=b"x" * 64):
    tables = [media.full(b"stsz", stsz), media.full(b"stsc", stsc), media.full(b"stco", stco), *([media.full(b"stss", stss)] if stss else [])]
    stbl = media.box(b"stbl", media.full(b"stsd", u(1), media.box(b"avc1", bytes(8))), *tables)
    return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl)))) + media.box(b"mdat", data)


@pytest.mark.parametrize(
    "data",
    [
        b"no media",
        movie(u(1, 2**32 - 1), u(1, 1, 1, 1), u(1, 0)),  # more samples than the file can hold
        movie(u(0, 2**32 - 1), u(1, 1, 1, 1), u(1, 0)),
        movie(u(8, 4), u(2, 1, 1, 1, 1, 1, 1), u(2, 0, 8)),  # runs that don't ascend
        movie(u(8, 4), u(2, 1, 1, 1, 9, 1, 1), u(2, 0, 8)),  # a run of a chunk that isn't there
        movie(u(8, 4), u(2, 3, 1, 1, 1, 1, 1), u(3, 0, 8, 16)),
        movie(u(8, 4), u(1, 1, 2**32 - 1, 1), u(1, 2**32 - 1)),  # beyond the file
        movie(u(8, 4), u(1, 1, 4, 1), u(1, 0), u(1, 0)),  # a sync sample 0
        movie(u(8, 4), u(1, 1, 4, 1), u(1, 0), u(1, 5)),
        movie(u(8, 4), u(1, 1, 4, 1), u(1, 0), u(2, 3, 1)),
        movie(u(8, 4), u(1, 1, 4, 1), u(1, 0), u(2**32 - 1, 1)),
        movie(u(8, 4), u(1, 1, 3, 1), u(1, 0)),  # a sample without a chunk
        movie(u(8, 4), u(1, 1, 4, 1), u(0)),
    ],
)
def test_media_that_is_damaged(data):
    info = media.probe(data)
    assert info["status"].startswith("broken")
    assert info["n_samples"] is None


def test_media_nested_without_end():
    data = b""
    for _ in range(3000):
        data = media.box(b"moov", data)
    assert media.probe(data)["status"] == "no track"


def test_media_chunks_out_of_order():
    info = media.probe(movie(u(8, 4), u(1, 1, 2, 1), u(2, 40, 8), u(2, 1, 4)))
    assert (info["status"], info["keyframes"]) == ("ok", [{"start": 8, "end": 56}, {"start": 16, "end": 24}])


def test_media_prefers_a_track_with_samples():
    data = media.write_track(bytes(128))
    empty = media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", media.full(b"stsz", u(0, 0))))))
    assert media.probe(media.box(b"moov", empty) + data)["status"] != "ok" or media.probe(media.box(b"moov", empty) + data)["n_samples"] == 2


def test_describe_beside_a_status_column(spark):
    df = spark.createDataFrame([("mine", bytearray(media.write_track(bytes(64))))], "status string, content binary")
    r = media.describe(df, "content").first()
    assert (r.status, r.status_1, r.n_samples) == ("mine", "ok", 1)


def record(i, size=30000):
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", str(i))], os.urandom(size))


def ids(path, wanted=True):
    return [(f["warc-record-id"], None if b is None else len(b)) for f, b in warc.read_archive(str(path), lambda f: wanted)]


@pytest.mark.parametrize("wanted", [True, False])
def test_warc_cut_in_its_last_record(tmp_path, wanted):
    data = [record(i) for i in range(3)]
    size = 30000 if wanted else None
    for name, whole in (("members", b"".join(map(warc.member, data))), ("plain", b"".join(data)), ("gzip", b"".join(map(gzip.compress, data)))):
        for cut in (4 if name == "members" else 60, 2000, 15000, 29900):
            (tmp_path / name).write_bytes(whole[:-cut])
            assert ids(tmp_path / name, wanted) == [("0", size), ("1", size)], (name, cut)


def test_warc_damaged_member_is_left_out(tmp_path):
    data = [warc.member(record(i)) for i in range(3)]
    data[1] = data[1][:9000] + bytes([data[1][9000] ^ 255]) + data[1][9001:]
    (tmp_path / "a").write_bytes(b"".join(data))
    assert ids(tmp_path / "a") == [("0", 30000), ("2", 30000)]


def test_warc_members_of_both_kinds(tmp_path):
    data = [record(i) for i in range(4)]
    for order in ((0, 1, 0, 1), (1, 0, 1, 0)):
        (tmp_path / "a").write_bytes(b"".join(warc.member(d) if k else gzip.compress(d) for k, d in zip(order, data, strict=True)))
        assert ids(tmp_path / "a") == [(str(i), 30000) for i in range(4)]


@pytest.mark.parametrize("length", ["many", "", "-1", "1.5", "²"])
def test_warc_length_that_is_no_number(tmp_path, length):
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: 1\r\nContent-Length: " + length.encode() + b"\r\n\r\nabc\r\n\r\n"
    for name, pack in (("plain", bytes), ("members", warc.member), ("gzip", gzip.compress)):
        (tmp_path / name).write_bytes(pack(record(0)) + pack(bad) + pack(record(2)))
        assert ids(tmp_path / name) == [("0", 30000)]


def test_warc_places_that_arrow_does_not_know():
    with pytest.raises(ValueError, match="can't be read"):
        warc.open_fs("nowhere://bucket/x")


def test_warc_tail_is_checked():
    one = warc.member(record(0, 10))
    assert struct.unpack("<I", one[16:20])[0] == len(one)


def test_identify_beside_its_own_names(spark):
    df = spark.createDataFrame([(i, t, c, "mine") for i, (t, c) in enumerate([("the and of with", "en"), ("der die und nicht", "de")] * 5)], "doc_id long, text string, lang string, score string")
    model = language.learn(df.withColumn("n_", F.lit(1)).withColumn("share_", F.lit(0)), F.lit(True))
    r = language.identify(df, model, ["doc_id", "score"]).orderBy("doc_id").first()
    assert (r.score, r.lang_pred) == ("mine", "en")
    assert 0 <= r.score_1 <= 1


def test_language_learns_from_many_codes(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 3)
    df = spark.createDataFrame([(i, "abc def " * 3, f"x{i % 6}") for i in range(60)], "doc_id long, text string, lang string")
    assert language.learn(df, F.lit(True)).families


def test_quality_with_odd_names(spark):
    df = spark.createDataFrame([(1, "some text", 5.0)], "score long, text string, f double")
    out = quality_model.score_documents(df, spark.createDataFrame([], "score long, quality int"), F.lit(True), id_col="score")
    assert out.columns == ["score", "score_1"]
    assert out.first()[:] == (1, 0.5)


def test_lines_with_string_ids(spark):
    line = "a line that is long enough"
    rows = [("b", f"{line}\nown b"), ("a", f"{line}\nown a"), (None, f"own of null\n{line}"), ("10", line), ("9", line)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"10": line, "9": "", "a": "own a", "b": "own b", None: "own of null"}
