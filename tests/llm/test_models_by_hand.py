"""op6 and op7 against slow versions of their methods: loops over documents, bins, nodes and pairs of languages."""

from __future__ import annotations

import math
import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from nichefold.llm import language
from nichefold.llm import quality_model as Q
from nichefold.llm import queries as llm_queries


def features(text: str | None) -> list[float]:
    b = (text or "").encode()
    share = lambda test: sum(map(test, b)) / max(1, len(b))
    kinds = ["#*$%&", "|", "!", ".,;:", "?", "<>/\\", "{}[]()", "@_~^", "\"'`", "=+-"]
    out = [share(lambda c, k=k: chr(c) in k) for k in kinds]
    out += [share(lambda c: 65 <= c <= 90), share(lambda c: 97 <= c <= 122), share(lambda c: 48 <= c <= 57), share(lambda c: c >= 128), share(lambda c: c in b" \t\n\x0b\x0c\r")]
    w = b.split()
    if not w:
        return out + [0.0] * 17
    n = [len(x) for x in w]
    mean = sum(n) / len(n)
    lines = b.split(b"\n")
    full = [x for x in lines if x.strip()]
    part = lambda test: sum(map(test, w)) / len(w)
    out += [math.log1p(len(w)), math.log1p(len(b)), mean, (sum((x - mean) ** 2 for x in n) / len(n)) ** 0.5, math.log1p(max(n))]
    out += [part(lambda x: len(x) <= 1), part(lambda x: len(x) <= 3), part(lambda x: len(x) >= 10), len(set(w)) / len(w), len(set(w)) / len(w) ** 0.5]
    out += [sum(a == c for a, c in zip(w, w[1:], strict=False)) / len(w), len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) / max(1, len(w) - 2)]
    out += [part(bytes.isupper), part(bytes.istitle), math.log1p(len(lines)), len(set(full)) / max(1, len(full))]
    return [*out, sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in full) / max(1, len(full))]


def slow_boosting(x, y, rows):
    """Scores of rows by trees grown node by node: at each the split of best gain over bin edges, first feature and edge on ties."""
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1])) for j in range(d)]
    base = math.log(np.clip(y.mean(), 1e-3, 1 - 1e-3) / (1 - np.clip(y.mean(), 1e-3, 1 - 1e-3)))
    margin, scores = np.full(n, base), np.full(len(rows), base)
    for _ in range(Q.TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)

        def grow(mine, theirs, depth, g=g, h=h):
            if depth == Q.DEPTH:
                value = Q.RATE * g[mine].sum() / (h[mine].sum() + Q.PENALTY)
                margin[mine] += value
                scores[theirs] += value
                return
            best = (1e-6, None, None)
            total = g[mine].sum() ** 2 / (h[mine].sum() + Q.PENALTY)
            for j in range(d):
                for e in edges[j]:
                    left = mine[x[mine, j] <= e]
                    if len(left) < Q.LEAST_ROWS or len(mine) - len(left) < Q.LEAST_ROWS:
                        continue
                    gl, hl = g[left].sum(), h[left].sum()
                    gr, hr = g[mine].sum() - gl, h[mine].sum() - hl
                    gain = gl * gl / (hl + Q.PENALTY) + gr * gr / (hr + Q.PENALTY) - total
                    if gain > best[0] + 1e-12:
                        best = (gain, j, e)
            _, j, e = best
            if j is None:  # nothing splits: all go on together
                grow(mine, theirs, depth + 1)
                return
            grow(mine[x[mine, j] <= e], theirs[rows[theirs, j] <= e], depth + 1)
            grow(mine[x[mine, j] > e], theirs[rows[theirs, j] > e], depth + 1)

        grow(np.arange(n), np.arange(len(rows)), 0)
    return 1 / (1 + np.exp(-np.clip(scores, -30, 30)))


def made_documents():
    rng = random.Random(1)
    words = "the of and a quick Brown fox jumps over lazy dog, and runs. Then it sleeps again NOW!".split()
    docs, labels = [], []
    for i in range(70):
        good = rng.random() < 0.6
        text = "\n".join(" ".join(rng.choice(words) + ("" if good or rng.random() < 0.6 else rng.choice("#$|!")) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 4)))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good if rng.random() < 0.93 else not good), 0))
    docs += [(100, None, None, None, 0), (101, "", "en", "s", 0), (102, "long " * 30_000, "en", "s", 0)]
    return docs, labels + [(101, 0, 0)]


def test_quality_query_by_hand(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Q, "TREES", 4)
    docs, labels = made_documents()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    x = np.array([features(t) for _, t, *_ in docs], dtype=np.float32).astype(np.float64)
    assert np.array([Q.statistics((t or "").encode()) for _, t, *_ in docs]) == pytest.approx(np.array([features(t) for _, t, *_ in docs]))
    quality = {d: q for d, q, _ in labels}
    learn = [k for k, r in enumerate(docs) if r[0] in quality and zlib.crc32(str(r[0]).encode()) % 5]
    want = slow_boosting(x[learn], np.array([float(quality[docs[k][0]]) for k in learn]), x)
    got = {r.doc_id: r for r in llm_queries.queries()["op6_quality_classifier"](spark, str(tmp_path)).collect()}
    for k, r in enumerate(docs):
        assert got[r[0]].score == pytest.approx(want[k], abs=1e-5)
        assert got[r[0]].predicted == int(got[r[0]].score >= 0.3)
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)


def slow_grams(text: str):
    """Counts of hashed pairs and triples of letters; anything else is one gap between words."""
    m = 1 << 32
    letters = [0] + [ord(c) if c.isalpha() else 0 for c in text.lower()] + [0]
    kept = [letters[0]] + [c for before, c in zip(letters, letters[1:], strict=False) if c or before]
    if len(kept) < 3:
        return None
    pair = [(a * 0x9E3779B1 ^ (b * 0x85EBCA77) % m) % m for a, b in zip(kept, kept[1:], strict=False)]
    triple = [((p * 0xC2B2AE3D) % m ^ (c * 0x27D4EB2F) % m) % m for p, c in zip(pair, kept[2:], strict=False)]
    out = [0] * language.SIZE
    for h in pair + triple:
        h ^= h >> 15
        out[(h * 0x2C1B3C6D) % m >> 20] += 1
    return out


@pytest.mark.parametrize("text", ["Hello, wörld  again!", "a", "ab", "1 2 3", "", " x ", "ДА нет", "naïve café " * 50])
def test_grams_by_hand(text):
    got, want = language.grams(text), slow_grams(text)
    assert (got is None) == (want is None)
    assert want is None or got.tolist() == want


def test_predictions_by_hand():
    rng = np.random.default_rng(2)
    langs = ["de", "en", "es", "fr", "nl", "tlh"]
    centre = rng.random((6, language.SIZE)) ** 8
    y = np.repeat(langs, 15).tolist()
    x = language.scale(rng.poisson(np.repeat(centre, 15, axis=0) * 5).astype(np.float32))
    model = language.fit(x, y)
    test = language.scale(rng.poisson(np.repeat(centre, 4, axis=0) * 1.5).astype(np.float32))
    names, sure = model.predict(test)
    assert [f for f, _ in model.families] == ["germanic", "only tlh", "romance"]
    sigmoid = lambda v: 1 / (1 + math.exp(-4 * v))
    for row, name, s in zip(test, names, sure, strict=True):
        m = row @ model.weights + model.bias
        f = max(range(3), key=lambda k: m[k])
        codes = model.families[f][1]
        votes, odds = dict.fromkeys(codes, 0.0), {c: 1.0 for c in codes}
        for a, b in combinations(codes, 2):
            p = sigmoid(m[model.pairs[a, b]])
            votes[a] += (p >= 0.5) + p / 1000
            votes[b] += (p < 0.5) + (1 - p) / 1000
            odds[a], odds[b] = min(odds[a], p), min(odds[b], 1 - p)
        best = max(codes, key=votes.get)
        assert name == best
        assert s == pytest.approx(sigmoid(m[f]) * odds[best], rel=1e-4)


def test_machines_are_near_their_minimum():
    """Squared hinge of equal weight on both sides and a small penalty: no small move helps."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 6)).astype(np.float32)
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(60) > 0.4, 1, -1).astype(np.float32)
    w, b = language.fit_svm(x, y, rounds=3000)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w, b):
        return float((weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + 0.5e-4 * w @ w)

    at = loss(w, b)
    for _ in range(50):
        assert loss(w + 0.01 * rng.standard_normal(6), b + 0.01 * rng.standard_normal()) > at - 1e-6


def test_language_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t, c, "s", 0) for i, (t, c) in enumerate([("the cat and the dog with that", "en"), ("der Hund und die Katze nicht", "de"), ("el perro y la gata con los", "es")] * 12)]
    rows += [(100, None, "en", None, 0), (101, "12 34!", None, "s", 0), (102, "the dog " * 40_000, None, "s", 0), (None, "die Katze", "de", "s", 0), (5, "the dog", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = llm_queries.queries()["op7_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred == by[101].lang_pred == "und"
    assert by[102].lang_pred == "en"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
