"""Language identification in two steps: first the family, then one of its languages.

A text is a vector of hashed letter pairs and triples, word edges included.  One linear support vector machine per family finds the
family; within it a machine for each pair of languages votes, so the closely related are separated by what tells just those two
apart.  All are fitted on the driver on at most about SAMPLE texts, equally many per language where there are enough; a hash of
the id picks them.

Defined cases: null text, or text without a letter, is "und" with score 0; codes that no family lists are a family of their own; with
nothing to learn from all is "und", with one language all is that; each language is learned from at least one text in expectation, however
many there are (languages are taken to be a catalogue, which the driver holds); whole texts count, of any length; equal texts, in repeated rows too, have equal predictions; votes that tie go by confidence, then
by code; an empty table gives an empty table; where a table brings columns named as those that are added, the added get a number.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import free_names, ship
from nichefold.llm.quality_model import chosen

#: Texts that the machines are fitted on, in expectation, over all languages and of one.
SAMPLE, PER_LANGUAGE = 4_000, 1_000
SIZE = 4096
UNKNOWN = "und"
#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt rm ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu se",
    "celtic": "br cy ga gd",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tk tr tt ug uz",
    "semitic": "am ar he mt",
    "sinitic": "yue zh",
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


@cache
def _letters() -> np.ndarray:
    import sys

    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter pairs and triples; None if there is no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(_letters()[c], c, 0)
    c = np.concatenate(([0], c, [0])).astype(np.uint32)
    keep = c != 0
    keep[1:] |= keep[:-1]
    keep[0] = True
    c = c[keep]
    if len(c) < 3:
        return None
    pair = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA77)
    triple = pair[:-1] * np.uint32(0xC2B2AE3D) ^ c[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate((pair, triple))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount(h >> np.uint32(32 - 12), minlength=SIZE)


def scale(counts: np.ndarray) -> np.ndarray:
    """Rows of square roots of counts, of length 1."""
    x = np.sqrt(counts, dtype=np.float32)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both sides of equal weight, by accelerated gradient descent."""
    mean = x.mean(axis=0)
    x = x - mean
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (2 * (size * 1.1 + 1) + penalty)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    pw, pb, t = w, b, 1.0
    for _ in range(rounds):
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = w + (t - 1) / s * (w - pw), b + (t - 1) / s * (b - pb)
        miss = np.maximum(0, 1 - y * (x @ vw + vb)) * y * weight
        pw, pb, t = w, b, s
        w = vw + step * (2 * (x.T @ miss) - penalty * vw)
        b = vb + step * 2 * float(miss.sum())
    return w, float(b - mean @ w)


@dataclass
class Model:
    """Weights of all machines in one matrix; which columns tell families, and which pairs of languages."""

    weights: np.ndarray
    bias: np.ndarray
    families: list[tuple[str, list[str]]]
    pairs: dict[tuple[str, str], int]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row, and how sure: the product of both steps' confidences."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        m = x @ self.weights + self.bias
        k = len(self.families)
        family = m[:, :k].argmax(axis=1) if k > 1 else np.zeros(len(x), dtype=np.int64)
        sure = 1 / (1 + np.exp(-4 * m[np.arange(len(x)), family])) if k > 1 else np.ones(len(x))
        names = np.empty(len(x), dtype=object)
        for f, (_, langs) in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes = np.zeros((len(rows), len(langs)))
            for (i, a), (j, b) in combinations(enumerate(langs), 2):
                p = 1 / (1 + np.exp(-4 * m[rows, self.pairs[a, b]]))
                votes[:, i] += (p >= 0.5) + p / 1000  # confidences settle ties of votes
                votes[:, j] += (p < 0.5) + (1 - p) / 1000
            best = votes.argmax(axis=1)
            names[rows] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                against = [np.minimum.reduce([self._odds(m, rows, langs, i, j) for j in range(len(langs)) if j != i]) for i in range(len(langs))]
                sure[rows] *= np.array(against)[best, np.arange(len(rows))]
        return names.tolist(), np.clip(sure, 0, 1)

    def _odds(self, m: np.ndarray, rows: np.ndarray, langs: list[str], i: int, j: int) -> np.ndarray:
        a, b = sorted((i, j))
        p = 1 / (1 + np.exp(-4 * m[rows, self.pairs[langs[a], langs[b]]]))
        return p if i < j else 1 - p


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    by_family: dict[str, list[str]] = {}
    for code in known:
        by_family.setdefault(FAMILY_OF.get(code, f"only {code}"), []).append(code)
    families = sorted(by_family.items())
    of = np.array([FAMILY_OF.get(code, f"only {code}") for code in langs])
    lang = np.array(langs)
    machines, pairs = [], {}
    if len(families) > 1:
        machines += [fit_svm(x, np.where(of == name, 1, -1).astype(np.float32)) for name, _ in families]
    k = len(families)
    machines += [(np.zeros(SIZE, dtype=np.float32), 0.0)] * (k - len(machines))
    for _, codes in families:
        for a, b in combinations(codes, 2):
            rows = (lang == a) | (lang == b)
            pairs[a, b] = len(machines)
            machines.append(fit_svm(x[rows], np.where(lang[rows] == a, 1, -1).astype(np.float32)))
    weights = np.stack([w for w, _ in machines], axis=1) if machines else np.zeros((SIZE, 0), np.float32)
    return Model(weights.astype(np.float32), np.array([b for _, b in machines], dtype=np.float32), families, pairs)


def _sample_rows(batches):
    import pyarrow as pa

    for b in batches:
        made = [grams(x.as_py()) for x in b.column(0)]
        keep = [i for i, g in enumerate(made) if g is not None]
        packed = [np.minimum(made[i], 0xFFFFFFFF).astype("<u4").tobytes() for i in keep]
        yield pa.record_batch([pa.array(packed, pa.binary()), b.column(1).take(pa.array(keep, pa.int64()))], names=["g", "lang"])


def learn(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of docs whose language is given and for which may_learn holds."""
    ship(docs.sparkSession)
    base = docs.filter(F.col(lang_col).isNotNull() & may_learn)
    counts = {r[0]: r[1] for r in base.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row a language
    if not counts:
        return fit(np.zeros((0, SIZE), np.float32), [])
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    shares = F.create_map(*[F.lit(x) for code, n in counts.items() for x in (code, min(1.0, each / n))])
    share = F.try_element_at(shares, F.col(lang_col).cast("string"))
    rows = base.filter(chosen(F.col(id_col), share)).select(text_col, F.col(lang_col).cast("string").alias("lang")).mapInArrow(_sample_rows, "g binary, lang string").toArrow()
    order = sorted(zip(rows.column("lang").to_pylist(), rows.column("g").to_pylist(), strict=True))  # rows come in any order
    x = np.empty((len(order), SIZE), dtype=np.float32)
    for i, (_, g) in enumerate(order):
        x[i] = scale(np.frombuffer(g, dtype="<u4")[None, :])[0]
    return fit(x, [lang for lang, _ in order])


def identify(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns carry of docs, with lang_pred and score of each text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    from pyspark.sql.types import StructType

    lang, score = free_names(carry, ["lang_pred", "score"])
    schema = StructType([*docs.select(*carry).schema.fields, *StructType.fromDDL(f"`{lang}` string, `{score}` double").fields])
    n = len(carry)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            langs, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at in range(0, b.num_rows, 512):
                made = [grams(x.as_py()) for x in b.column(n)[at : at + 512]]
                rows = [i for i, g in enumerate(made) if g is not None]
                if rows:
                    found, sure = shared.value.predict(scale(np.stack([made[i] for i in rows]).astype(np.float32)))
                    for i, code in zip(rows, found, strict=True):
                        langs[at + i] = code
                    scores[at + np.array(rows)] = sure
            yield pa.record_batch([*b.columns[:n], pa.array(langs), pa.array(scores)], names=schema.names)

    return docs.select(*carry, text_col).mapInArrow(run, schema)
