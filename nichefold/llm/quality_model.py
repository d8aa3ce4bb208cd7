"""A quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics of each whole text are computed once, in Arrow batches.  The trees are fitted on the driver with numpy on at most about
SAMPLE labelled rows (a hash of the id picks them, so reruns agree) and flattened into arrays of complete binary trees, which
all rows then walk together, one level at a time, without branching.

Defined cases: null text counts as empty and is scored like any other; rows without label, or with a null id, are scored but
not learned from; without labelled rows the score is 0.5, with labels of one kind their share; repeated label rows count as often as
they occur, also where documents' ids repeat; whole texts count, of any length; equal texts have equal scores; an empty table gives an empty table; other
columns of either table, whatever their names, aren't read; an id column that is itself called score leaves the score a numbered name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import free_names, materialise, ship

#: Labelled rows that the trees are fitted on, in expectation.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 80, 4, 0.15, 64, 10, 1.0
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
GROUPS = (b"#*$%&", b"|", b"!", b".,;:", b"?", b"<>/\\", b"{}[]()", b"@_~^", b"\"'`", b"=+-")


def _masks() -> np.ndarray:
    """A row for each kind of byte."""
    rows = [[c in g for c in range(256)] for g in GROUPS]
    rows.append([chr(c).isupper() and c < 128 for c in range(256)])
    rows.append([chr(c).islower() and c < 128 for c in range(256)])
    rows.append([48 <= c < 58 for c in range(256)])
    rows.append([c >= 128 for c in range(256)])
    rows.append([c in b" \t\n\x0b\x0c\r" for c in range(256)])
    return np.array(rows, dtype=np.float64)


KINDS = _masks()
N_FEATURES = len(KINDS) + 17


def statistics(text: bytes | None) -> list[float]:
    """The features of a text: shares of kinds of bytes, and how its words and lines vary and repeat."""
    from operator import eq

    b = text or b""
    n = len(b)
    hist = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    shares = (KINDS @ hist / max(1, n)).tolist()
    words = b.split()
    k = len(words)
    if not k:
        return [*shares, *[0.0] * (N_FEATURES - len(shares))]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=k)
    lines = b.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    distinct = len(set(words))
    return [
        *shares,
        float(np.log1p(k)),
        float(np.log1p(n)),
        float(lengths.mean()),
        float(lengths.std()),
        float(np.log1p(lengths.max())),
        float((lengths <= 1).mean()),
        float((lengths <= 3).mean()),
        float((lengths >= 10).mean()),
        distinct / k,
        distinct / k**0.5,
        sum(map(eq, words, words[1:])) / k,
        len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, k - 2),
        sum(map(bytes.isupper, words)) / k,
        sum(map(bytes.istitle, words)) / k,
        float(np.log1p(len(lines))),
        len(set(full)) / max(1, len(full)),
        sum(x.rstrip().endswith((b".", b"!", b"?", b'"')) for x in full) / max(1, len(full)),
    ]


@dataclass
class Forest:
    """Complete binary trees in arrays: split feature and threshold by tree and inner node, value by tree and leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        trees, inner = self.feature.shape
        if not trees:
            return out
        t = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), trees), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.threshold[t, node])
        return out + self.leaf[t, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for logistic loss, grown level by level on histograms of binned features."""
    n, d = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    nothing = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not n:
        return nothing
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    nothing.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return nothing
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    feature, threshold, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    margin = np.full(n, nothing.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            at = node - first
            gs, hs, cs = np.zeros((3, d, width, BINS))
            for j in range(d):
                cell = at * BINS + binned[:, j]
                for out, w in ((gs, g), (hs, h), (cs, None)):
                    out[j] = np.bincount(cell, weights=w, minlength=width * BINS).reshape(width, BINS)
            left_g, left_h, left_c = (np.cumsum(a, axis=2)[:, :, :-1] for a in (gs, hs, cs))
            all_g, all_h, all_c = (a.sum(axis=2, keepdims=True) for a in (gs, hs, cs))
            gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            gain[(left_c < LEAST_ROWS) | (all_c - left_c < LEAST_ROWS)] = -1
            for j, e in enumerate(edges):
                gain[j, :, len(e) :] = -1
            flat = gain.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(axis=1)
            good = flat[np.arange(width), best] > 1e-6
            for w in np.flatnonzero(good):
                j, b = divmod(int(best[w]), BINS - 1)
                feature[t, first + w], threshold[t, first + w] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = RATE * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + PENALTY)
        margin += leaf[t][at]
    return Forest(nothing.base, feature, threshold, leaf)


def _features(batches):
    import pyarrow as pa

    for b in batches:
        made = np.array([statistics(x.as_py()) for x in b.column(1)], dtype=np.float32).reshape(-1, N_FEATURES)
        yield pa.record_batch([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], names=["id", "f"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)


def bucket(id_: Column, n: int) -> Column:
    """crc32 of an id's text, modulo n; null for a null id."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(n).cast("long"))


def chosen(id_: Column, share: float | Column, seed: int = 7) -> Column:
    """Whether a hash of the id falls into that share of all hashes."""
    upto = F.floor(share * F.lit(float(1 << 53))) if isinstance(share, Column) else F.lit(int(share * (1 << 53)))
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_), 11) < upto


def score_documents(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, score) of every row of docs, learned from labels of the ids for which may_learn (a condition on column id) holds."""
    spark = docs.sparkSession
    ship(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    body = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    table = materialise(body.mapInArrow(_features, f"id {id_type}, f array<float>"), "features")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).filter(F.col("y").isNotNull() & may_learn)
    total = marks.count()
    marks = marks.filter(chosen(F.col("id"), min(1.0, SAMPLE / max(1, total))))
    rows = table.join(marks, "id").select("f", "y").toArrow().combine_chunks()
    x = _matrix(rows.column("f").combine_chunks()) if rows.num_rows else np.zeros((0, N_FEATURES))
    order = np.lexsort((rows.column("y").to_numpy(), *x.T)) if len(x) else np.zeros(0, dtype=np.int64)  # rows come in any order
    score_name = free_names([id_col], ["score"])[0]
    forest = spark.sparkContext.broadcast(fit(x[order], rows.column("y").to_numpy()[order] if len(x) else np.zeros(0)))

    def score(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(forest.value.score(_matrix(b.column(1))))], names=[id_col, score_name])

    return table.mapInArrow(score, f"`{id_col}` {id_type}, `{score_name}` double")
