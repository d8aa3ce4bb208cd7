"""The training-data operators against brute force, other libraries and odd tables."""

from __future__ import annotations

import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from nichefold.llm import bpe, html_text, language, line_dedup, media, minhash, mixing, quality_model, quality_rules, warc
from nichefold.llm import queries as llm_queries
from nichefold.llm.q2_bpe import vocabulary

WS = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, None, 0),
    (3, " \n\t\n", "en", "s", 4),
    (3, "same id\nother text of some length", "en", "s", 9),
    (None, "a document without an id\nline that is long enough", "de", "s", 9),
    (4, "one two three four five six seven eight nine ten eleven\nline that is long enough", "en", None, 9),
    (4, "one two three four five six seven eight nine ten eleven\nline that is long enough", "en", None, 9),
    (5, "Zwei Wörter " * 30000, "de", "t", 9),
]


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return c


def texts(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(llm_queries.oracle_sql()))
def test_against_sql(spark, duck, small, tmp_path, name):
    out = str(tmp_path / "out")
    llm_queries.queries()[name](spark, small).write.parquet(out)
    want = duck.sql(llm_queries.oracle_sql()[name])
    columns = ", ".join(sorted(want.columns))
    duck.sql(f"CREATE OR REPLACE TABLE w AS SELECT {columns} FROM ({llm_queries.oracle_sql()[name]})")
    duck.sql(f"CREATE OR REPLACE TABLE g AS SELECT {columns} FROM '{out}/*.parquet'")
    assert duck.sql("SELECT count(*) FROM w").fetchall() == duck.sql("SELECT count(*) FROM g").fetchall()
    assert duck.sql("SELECT * FROM w EXCEPT ALL SELECT * FROM g LIMIT 3").fetchall() == []


def test_queries_are_there():
    assert {int(n[2:].split("_")[0]) for n in llm_queries.queries()} == set(range(1, 11))


# ---- 1 mixing ----


def test_share_out():
    sizes, weights = {"a": 10, "b": 100, "c": 1000}, {"a": 5, "b": 2, "c": 1}
    t = mixing.share_out(sizes, weights)
    assert t["a"] == 30
    assert t["b"] == 300
    assert sum(t.values()) == pytest.approx(1110)
    assert mixing.weights_of(["b", None, "a", "c"]) == {"a": 5, "b": 2, "c": 1, None: 5}
    assert mixing.weighted_targets({}) == {}
    assert mixing.share_out({"a": 0, "b": 0}, {"a": 5, "b": 2}) == {"a": 0, "b": 0}


def test_flow_overlaps_and_repeats():
    f = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 25})
    assert sum(f.values()) == 50
    assert max(f.values()) <= 20  # all once before any a third time
    f = mixing.route({("a",): 10, ("b",): 10}, {"a": 5, "b": 99})
    assert f == {("a",): 5, ("b",): 30}


def test_mix_hits_targets(spark, docs):
    mix = mixing.Mix(docs, mixing.one_source(), "doc_id", "text", mixing.weighted_targets)
    rows = mix.copies(docs, "n").select("source", "n", mixing.word_count(F.col("text")).alias("size"))
    got = {r.source: r for r in rows.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("took"), F.max("n").alias("most"), F.max("size").alias("big")).collect()}
    size = Counter()
    for r in docs.collect():
        size[r.source] += len([w for w in (r.text or "").split() if w])
    assert dict(size) == mix.source_size
    for s, r in got.items():
        assert r.most <= 3
        assert abs(r.took - mix.quotas[s]) <= max(0.05 * mix.quotas[s], r.big / 2)
    again = mixing.Mix(docs.repartition(9), mixing.one_source(), "doc_id", "text", mixing.weighted_targets)
    assert sorted(map(repr, again.cuts)) == sorted(map(repr, mix.cuts))


def test_mix_overlapping_sources(spark):
    rows = spark.range(3000).select("id", F.lit("w " * 7).alias("text"), F.when(F.col("id") % 3 == 0, F.array(F.lit("a"))).when(F.col("id") % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b"))).alias("m"))
    mix = mixing.Mix(rows, F.col("m"), "id", "text", lambda sizes: {"a": 7000, "b": 3500})
    assert mix.copies(rows, "n").agg(F.sum(F.col("n") * 7)).first()[0] == pytest.approx(10500, abs=14)


def test_mix_odd_tables(spark, odd, empty):
    assert mixing.mix_documents(empty).count() == 0
    mixed = mixing.mix_documents(odd.withColumn("copies", F.lit("mine")).withColumn("m_", F.lit(1)))
    assert {r.copies for r in mixed.collect()} == {"mine"}


# ---- 2 BPE ----


@pytest.fixture(scope="module")
def tok():
    with open(vocabulary(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read())


@pytest.fixture(scope="module")
def reference():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary())


def test_bpe_equals_library(tok, reference, docs):
    random.seed(0)
    some = [t or "" for _, t in texts(docs)]
    some += ["", "  ", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ", "éa it's WE'LL they'd 123½Ⅷ", "日本語" * 40, "a" * 700, "👍👍!!", "ß ﬁ \x00\x1c\x85 x"]
    some += ["".join(random.choice("abcdetinsuo'é ") for _ in range(60)) for _ in range(400)]
    for t in some:
        want = reference.encode(t, add_special_tokens=False).ids
        ids = tok.encode(t)
        assert list(memoryview(ids).cast("I")) == want
        assert tok.decode(ids) == reference.decode(want, skip_special_tokens=False)


def test_automaton_by_hand():
    # Symbols 0 a, 1 b; merges aa -> 2, ab -> 3, (aa)(ab) -> 4.
    auto = bpe.Automaton([0, 1], [(0, 0, 2), (0, 1, 3), (2, 3, 4)], 5)
    assert not auto.arc(auto.dest[0], 0)  # a a is always merged
    assert auto.arc(auto.dest[2], 0)  # aa a stays
    assert not auto.arc(auto.dest[0], 2)  # a aa can't arise, merging goes from the left
    assert not auto.arc(auto.dest[2], 3)  # aa ab merges on
    with pytest.raises(ValueError, match="one each"):
        bpe.Automaton([0, 1], [(0, 1, 2), (0, 1, 2)], 3)


def test_bpe_odd_tables(odd, empty):
    out = bpe.tokenise(odd, vocabulary(), ids_name="ids")
    assert out.columns == [*odd.columns, "ids"]
    assert sorted(len(r.ids) for r in out.collect())[:3] == [0, 0, 0]
    assert bpe.tokenise(empty, vocabulary()).count() == 0


# ---- 3 near duplicates ----


def near_truth(rows):
    """Class of each row by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    return sorted((d, min(m), len(m)) for m in groups.values() for d in m)


def near_rows(seed=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    common = rng.choices(words, k=60)
    for _ in range(30):
        base = rng.choices(words, k=rng.choice([3, 6, 60, 300]))
        if rng.random() < 0.5:
            base = common + base
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w)))
            n += 1
    base = rng.choices(words, k=150)
    for _ in range(150):  # one large group of near copies, some of them too far
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(150)] = rng.choice(words)
        rows.append((n, " ".join(w)))
        n += 1
    return rows + [(n + i, rows[-1][1]) for i in range(40)] + [(n + 50, ""), (n + 51, "")]


def test_near_classes_equal_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_classes(df).collect())
    assert got == near_truth(rows)
    kept = sorted(r.doc_id for r in minhash.keep_one(df).collect())
    assert kept == sorted({c for _, c, _ in got})


def test_bucket_blocks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rows = near_rows(3)
    got = sorted((r.doc_id, r.class_id, r.class_size) for r in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_truth(rows)


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 200).astype(np.uint64)
    b = np.concatenate((a[:150], rng.integers(0, 2**63, 50).astype(np.uint64)))
    w1, w2 = rng.random(200) * 4, rng.random(200) * 4
    plain = weighted = 0.0
    for i in range(30):
        x = np.concatenate((a + np.uint64(i), b + np.uint64(i)))
        s = minhash.signatures(x, np.repeat([0, 1], 200), 2)
        assert np.isfinite(s).all()
        plain += (s[0] == s[1]).mean() / 30
        y = np.concatenate((a + np.uint64(i), a + np.uint64(i)))
        s = minhash.signatures(y, np.repeat([0, 1], 200), 2, np.concatenate((w1, w2)))
        weighted += (s[0] == s[1]).mean() / 30
    assert plain == pytest.approx(150 / 250, abs=0.03)
    assert weighted == pytest.approx(np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum(), abs=0.03)


def test_signatures_do_not_depend_on_company():
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 900)]
    together = minhash.signatures(np.concatenate(sets), np.repeat(np.arange(4), [len(s) for s in sets]), 4)
    for i, s in enumerate(sets):
        assert np.array_equal(minhash.signatures(s, np.zeros(len(s), int), 1)[0], together[i])


def test_near_odd_tables(odd, empty):
    got = {(r.doc_id, r.class_size) for r in minhash.near_classes(odd).collect()}
    assert (1, 1) in got
    assert (4, 2) in got
    assert minhash.near_classes(odd).count() == len(ODD)
    kept = minhash.keep_one(odd.withColumn("node_", F.lit(0)))
    assert kept.columns == [*odd.columns, "node_"]
    assert kept.count() == len(ODD) - 1
    assert minhash.near_classes(empty).count() == 0
    assert minhash.keep_one(empty).count() == 0


# ---- 4 media ----


@pytest.mark.parametrize("n", [0, 1, 64, 1000, 16384, 16385, 70001])
def test_media_round_trip(n):
    payload = media.pad(bytes(i % 251 for i in range(n)))
    assert len(payload) == max(64, -(-n // 64) * 64)
    stored = media.write_track(payload)
    assert media.read_track(stored) == payload
    info = media.probe(stored)
    assert (info["status"], info["codec"], info["n_samples"]) == ("ok", "raw ", len(payload) // 64)
    assert info["duration"] == pytest.approx(len(payload) / 8000)
    key = info["keyframes"]
    assert b"".join(stored[k["start"] : k["end"]] for k in key) == payload
    for cut in (1, len(payload) + 4, len(stored) // 2):
        assert media.probe(stored[:-cut])["status"] != "ok"


def test_media_given_sizes_and_64_bit_offsets():
    u = lambda *x: b"".join(i.to_bytes(4, "big") for i in x)
    data = b"AAABBCCCC"
    ftyp = media.box(b"ftyp", b"isom", u(0))

    def moov(at):
        stbl = media.box(
            b"stbl", media.full(b"stsd", u(1), media.box(b"avc1", bytes(8))), media.full(b"stsz", u(0, 3, 3, 2, 4)), media.full(b"stsc", u(2), u(1, 1, 1), u(2, 2, 1)),
            media.full(b"co64", u(2), at.to_bytes(8, "big"), (at + 5).to_bytes(8, "big")), media.full(b"stss", u(2, 1, 3)),
        )
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", u(0, 0, 10, 30), bytes(4)), media.full(b"hdlr", u(0), b"vide", bytes(13)), media.box(b"minf", stbl))))

    start = len(ftyp) + len(moov(0)) + 8
    gap = data[:3] + b"xx" + data[3:]
    stored = ftyp + moov(start) + media.box(b"mdat", gap)
    assert media.read_track(stored) == data
    info = media.probe(stored)
    assert (info["codec"], info["handler"], info["duration"], info["n_keyframes"]) == ("avc1", "vide", 3.0, 2)


def test_media_column(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no media")), (3, bytearray(media.write_track(bytes(64))))], "id int, content binary")
    status = [r.status for r in media.describe(df, "content").orderBy("id").collect()]
    assert (status[0], status[1].split(":")[0], status[2]) == ("empty", "broken", "ok")
    assert [r.n_samples for r in media.describe(df, "content").orderBy("id").collect()] == [None, None, 1]
    assert media.describe(df.limit(0), "content").count() == 0


def test_media_query(spark, small, docs):
    got = {r.doc_id: r for r in llm_queries.queries()["op4_media"](spark, small).collect()}
    for d, t in texts(docs):
        raw = (t or "").encode()
        p = media.pad(raw)
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


# ---- 5 line dedup ----


def lines_truth(rows):
    rank = lambda d: (d is None, d)
    holders = defaultdict(set)
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(d)
    return [(d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or len(holders[key(x)]) < 2 or d == min(holders[key(x)], key=rank))) for d, t in rows]


@pytest.mark.parametrize("parts", ["1", "3", "40"])
def test_lines_equal_brute_force(spark, parts):
    rng = random.Random(5)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "  Ünïcode LINE é  ", "ünïcode line é"]
    rows = [(i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500 + i, "the hot line everywhere\nown line of %d" % i) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(texts(line_dedup.dedup_lines(df)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == sorted(lines_truth(rows))


def test_bitmaps():
    for drop, n in (([0], 1), ([7], 9), ([8], 9), ([1, 3, 15], 40)):
        assert [i for i, k in enumerate(line_dedup.keeps(line_dedup.pack(drop), n)) if not k] == drop


def test_lines_odd_tables(odd, empty):
    got = line_dedup.dedup_lines(odd.withColumn("bitmap", F.lit(1)).withColumn("d_", F.lit(2)))
    assert got.columns == [*odd.columns, "bitmap", "d_"]
    assert sorted(map(repr, texts(got))) == sorted(map(repr, [(d, t or "") for d, t in lines_truth([r[:2] for r in ODD])]))
    assert line_dedup.dedup_lines(empty).count() == 0


# ---- 6 quality classifier, 7 language ----


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((800, quality_model.N_FEATURES))
    y = ((x[:, 3] > 0.5) ^ (x[:, 5] > 0.7)).astype(float)
    f = quality_model.fit(x[:600], y[:600])
    assert ((f.score(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    t = 3
    one = x[5]
    node = 0
    for _ in range(quality_model.DEPTH):
        node = 2 * node + 1 + int(one[f.feature[t, node]] > f.threshold[t, node])
    sub = quality_model.Forest(0.0, f.feature[t : t + 1], f.threshold[t : t + 1], f.leaf[t : t + 1])
    assert sub.margin(one[None])[0] == f.leaf[t, node - (2**quality_model.DEPTH - 1)]
    assert quality_model.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality_model.fit(x[:50], np.ones(50)).score(x[:1])[0] > 0.99


def test_quality_held_out(spark):
    small = "/root/testdata/sf0.01"
    rows = llm_queries.queries()["op6_quality_classifier"](spark, small).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_odd_tables(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_model.score_documents(odd, none, F.lit(True)).collect()
    assert [r.score for r in out] == [0.5] * len(ODD)
    some = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (3, None)], "doc_id long, quality int")
    assert quality_model.score_documents(odd, some, F.lit(True)).count() == len(ODD)
    assert quality_model.score_documents(empty, some, F.lit(True)).count() == 0


def test_language_held_out(spark, small, docs):
    rows = llm_queries.queries()["op7_language"](spark, small).collect()
    lang = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == lang[r.doc_id][0] for r in rows if r.held_out]
    assert np.mean(held) > 0.97


def test_language_families_and_odd_tables(spark, odd, empty):
    rows = [("der die das und nicht mit von " * 4, "de"), ("the and of with from that " * 4, "en"), ("el la los que con para una " * 4, "es"), ("le la les des que avec pour " * 4, "fr"), ("xqz zqx qqx " * 4, "tlh")]
    df = spark.createDataFrame([(i * 10 + j, t, c) for i in range(6) for j, (t, c) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.learn(df, F.lit(True))
    assert [n for n, _ in model.families] == ["germanic", "only tlh", "romance"]
    got = {r.text: r.lang_pred for r in language.identify(df, model, ["text"]).collect()}
    assert got == dict(rows)
    out = {r.text: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame([(None,), (" 12 !",), ("und",)], "text string"), model, ["text"]).collect()}
    assert out[None] == out[" 12 !"] == ("und", 0)
    assert language.learn(empty, F.lit(True)).predict(np.zeros((2, language.SIZE)))[0] == ["und", "und"]
    assert language.identify(odd, model, ["doc_id"]).count() == len(ODD)
    single = language.learn(df.filter("lang = 'en'"), F.lit(True))
    assert {r.lang_pred for r in language.identify(df, single, ["doc_id"]).collect()} == {"en"}


# ---- 8 HTML ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
<article class="post"><h1>Ti &amp; tle</h1><p>One<br>two   <b>three<p>Fo&eacute;ur &lt;x&gt;<ul><li>a<li>b</ul><form>f</form>%s<section class="comments"><p>hi</p></section></article>
<aside>side</aside><footer>foot</footer></body></html>"""
MAIN = "Ti & tle\nOne two three\nFoéur <x>\na\nb"


def test_main_text():
    assert html_text.main_text(PAGE % "") == MAIN
    assert html_text.main_text(None) == html_text.main_text("") == ""
    assert html_text.main_text("plain &amp; simple") == "plain & simple"
    assert html_text.main_text("<main><div>x</div> <p>y") == "x\ny"
    assert html_text.main_text('<body><p>a</p><p class="x" hidden>b</p><p>c <i>d</i>e') == "a\nc de"
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"
    assert html_text.main_text('<article><p title="a > b">c</p><p x="unclosed>d</p></article>').startswith("c")


def test_templates_by_host(spark):
    box = "<div><span>Subscribe to %s</span></div>"
    pages = [(i, f"https://H.example/{i}", (PAGE % (box % "all")).replace("Fo", f"Fo{i}")) for i in range(20)]
    pages += [(100 + i, f"https://o.example/{i}", PAGE % (box % i)) for i in range(20)]
    pages += [(200, None, None), (201, "no url", ""), (202, "https://H.example/z", "<article><p>own")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df.withColumn("host_", F.lit(1))).collect()}
    assert got[3] == MAIN.replace("Fo", "Fo3")
    assert got[103] == MAIN + "\nSubscribe to 3"
    assert got[200] == got[201] == ""
    assert got[202] == "own"
    assert html_text.extract(df.limit(0)).count() == 0


def test_templates_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BROADCAST_HASHES", -1)
    pages = [(i, "https://h.example/", f"<article><p>text {i}</p><div>again</div></article>") for i in range(9)]
    got = {r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {f"text {i}" for i in range(9)}


def test_repeated_passages_stay(spark):
    pages = [(i, "https://h.example/", "<article><h1>Same</h1><p>the same passage everywhere</p></article>") for i in range(30)]
    got = {r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {"Same\nthe same passage everywhere"}


def test_html_query_on_all_pages(spark, small):
    import html as entities
    import re

    got = {r.page_id: (r.text, r.n_chars) for r in llm_queries.queries()["op8_html"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = "\n".join(x for x in (" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if x)
        assert got[r.page_id] == (want, len(want))


# ---- 9 quality rules ----


def test_rules_odd_tables(spark, odd, empty):
    rows = {(r.doc_id, r.n_words): r for r in quality_rules.quality_table(odd).collect()}
    assert rows[1, 0].base_failed
    assert not rows[1, 0].kept
    assert rows[5, 60000].n_repeat_words == 60000
    assert quality_rules.quality_table(empty).count() == 0
    assert quality_rules.quality_filter(empty).count() == 0
    kept = quality_rules.quality_filter(odd.withColumn("st", F.lit(1)).withColumn("model", F.lit(2)))
    assert kept.columns == [*odd.columns, "st", "model"]


def test_rules_filter_agrees_with_table(docs):
    table = quality_rules.quality_table(docs)
    assert sorted(r.doc_id for r in quality_rules.quality_filter(docs).collect()) == sorted(r.doc_id for r in table.filter("kept").collect())


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    got = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(grams)
        assert got[i] == len({k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(5)})


def test_rules_know_junk(spark, small):
    rows = {r.doc_id: r.kept for r in llm_queries.queries()["op9_quality_rules"](spark, small).collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    n = {d.doc_id: len((d.text or "").split()) for d in spark.read.parquet(f"{small}/documents.parquet").collect()}
    right = [rows[r.doc_id] == bool(r.quality) for r in labels if n[r.doc_id] >= 10]
    assert np.mean(right) > 0.9


# ---- 10 WARC ----


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    rows = [(f"<urn:{i}>", "response" if i % 3 else "revisit", f"http://h/{i}", None if i % 3 else "<urn:1>", bytearray(os.urandom(i * 700)) if i % 3 else None, i * 700) for i in range(40)]
    df = spark.createDataFrame(rows, "record_id string, warc_type string, target_uri string, refers_to string, payload binary, payload_length long")
    where = str(tmp_path / "w")
    df.repartition(3).write.format("warc").mode("append").save(where)
    back = spark.read.format("warc").load(where)
    got = {r.record_id: r for r in back.collect()}
    assert len(got) == 40
    for i, r in enumerate(rows):
        g = got[r[0]]
        assert (g.warc_type, g.target_uri, g.refers_to, g.payload_length) == (r[1], r[2], r[3], r[5])
        assert bytes(g.payload) == bytes(r[4] or b"")
        assert g.payload_sha256 == hashlib.sha256(bytes(r[4] or b"")).hexdigest()
    some = back.filter((F.col("warc_type") == "revisit") & F.col("target_uri").startswith("http://h/3")).select("record_id")
    assert sorted(r[0] for r in some.collect()) == ["<urn:30>", "<urn:33>", "<urn:36>", "<urn:39>", "<urn:3>"]
    assert back.filter(F.col("refers_to").isNull()).count() == 26
    df.limit(2).write.format("warc").mode("overwrite").save(where)
    assert spark.read.format("warc").load(where).count() == 2
    df.limit(0).write.format("warc").mode("append").save(str(tmp_path / "none"))
    assert spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def test_warc_skips_what_is_refused(tmp_path, monkeypatch):
    data = [warc.record([("WARC-Type", t)], os.urandom(30000)) for t in ("request", "response")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.member(d) for d in data))
    (tmp_path / "b.warc").write_bytes(b"".join(data))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data))
    (tmp_path / "d.warc").write_bytes(data[0] + data[1][:-100])
    for name in "abc":
        path = next(str(p) for p in tmp_path.iterdir() if p.name[0] == name)
        found = list(warc.read_archive(path, lambda f: f["warc-type"] == "response"))
        assert [(f["warc-type"], None if b is None else len(b)) for f, b in found] == [("request", None), ("response", 30000)]
    assert len(list(warc.read_archive(str(tmp_path / "d.warc"), lambda f: True))) == 1


def test_warc_query_odd_pages(spark, tmp_path):
    rows = [(1, "u", None), (2, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99), (9, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (8, "u", "y" * 100), (11, None, "é" * 60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in llm_queries.queries()["op10_warc"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None), (8, 100, "response", None), (8, 100, "response", None), (9, 100, "revisit", 8), (None, 100, "revisit", 8), (11, 120, "response", None)], key=repr)


# ---- pipeline ----


def test_pipeline_equals_brute_force(spark, small, docs, tok):
    import corpus_pipeline as cp

    stages = [docs]
    for _, f in cp.STAGES[:-1]:
        out = f(spark, stages[-1], small)
        assert out.columns == docs.columns
        stages.append(spark.createDataFrame(out.collect(), docs.schema))
    kept, deduped, near, mixed = stages[1:]
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_table(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, k in verdict.items() if k)
    assert sorted(texts(deduped)) == sorted(lines_truth(texts(kept)))
    assert all(r.n_chars == len(r.text) for r in deduped.collect())
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c, _ in near_truth(texts(deduped))})
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3
    size = defaultdict(int)
    took = defaultdict(int)
    for r in near.collect():
        size[r.source] += len(r.text.split())
        took[r.source] += len(r.text.split()) * copies[r.doc_id]
    want = mixing.weighted_targets(dict(size))
    big = max(len(r.text.split()) for r in near.collect())
    assert all(abs(took[s] - want[s]) <= max(0.1 * want[s], big / 2) for s in size)
    final = cp.STAGES[-1][1](spark, mixed, small).collect()
    by_id = dict(texts(mixed))
    assert len(final) == mixed.count()
    assert all(np.array(r.ids, dtype="<u4").tobytes() == tok.encode(by_id[r.doc_id]) for r in final)


def test_pipeline_odd_tables(spark, odd, empty, small):
    import corpus_pipeline as cp

    for df in (odd, empty):
        for _, f in cp.STAGES:
            df = f(spark, df, small)
            df = spark.createDataFrame(df.collect(), df.schema)
