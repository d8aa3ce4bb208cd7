"""Header values that would break a record's head."""

from __future__ import annotations

import pytest

from nichefold.llm import q10_warc, warc

URLS = [
    "http://a.example/one\r\n\r\nbody",
    "http://a.example/two\r\nWARC-Type: revisit\r\nContent-Length: 0",
    "\n\n http://a.example/three ",
    "http://a.example/four\x00\x0b\x0c\x1c\x7f",
    "",
    None,
    "http://a.example/é 😀 \u0085end",
    "http://a.example/%0D%0A",
]


def test_values_stay_in_their_line():
    for u in URLS:
        if u is not None:
            v = warc.header_value(u)
            assert not set(v) & set(map(chr, [*range(32), 127]))
            assert warc.parse_fields(warc.record([("WARC-Target-URI", u)], b""))["warc-target-uri"] == v
    assert warc.header_value("  a b\n") == "%20%20a b%0A"
    assert warc.header_value("http://a.example/x?y=%20z") == "http://a.example/x?y=%20z"


@pytest.mark.parametrize("length_told", [True, False])
def test_rows_in_are_rows_out(spark, tmp_path, monkeypatch, length_told):
    if not length_told:
        import gzip

        monkeypatch.setattr(warc, "member", lambda r, level=1: gzip.compress(r))
        assert not warc._tells_length(warc.member(b"x" * 99))
    pages = spark.createDataFrame([(i, u, f"<p>{'text ' * 30}{i % 3}</p>") for i, u in enumerate(URLS)], "page_id long, url string, html string")
    warc.register(spark)
    where = f"file://{tmp_path}/w"
    q10_warc.records(pages).coalesce(1).write.format("warc").mode("append").save(where)
    back = {r.record_id: r for r in spark.read.format("warc").load(where).collect()}
    assert len(back) == len(URLS)
    for i, u in enumerate(URLS):
        r = back[f"<urn:page:{i}>"]
        assert r.warc_type == ("response" if i < 3 else "revisit")
        assert r.target_uri == (None if u is None else warc.header_value(u))
        assert i >= 3 or r.payload.decode() == f"<p>{'text ' * 30}{i % 3}</p>"


def test_query_over_such_pages(spark, tmp_path):
    pages = spark.createDataFrame([(i, u, "x" * 200 if i % 2 else f"{i}" * 150) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in q10_warc.query(spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(URLS)))
    assert [got[i].refers_to for i in range(len(URLS))] == [None, None, None, 1, None, 1, None, 1]

