"""Encoders of texts and image patches.

The hash encoder needs no weights.  The pretrained ones take theirs from a factory that workers import: it makes the model once a task, from
whatever libraries and weights are where the job runs.
"""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.functions.exprs import stable_hash, stable_hashes
from nichefold.functions.workers import ship

BUCKETS, STATS, SIDES = 256, 27, 48
#: Words of a text, by the white space of text_buckets; words whose bucket a worker keeps.
WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
WORDS_KEPT = 200_000


def text_buckets(text: Column) -> Column:
    """The bucket of each word of a lower-cased text: its code points weighted by position, which any engine repeats."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    code = lambda w: F.aggregate(F.transform(F.split(w, ""), lambda c, i: F.ascii(c).cast("long") * (i * 37 + 11)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.transform(words, lambda w: (code(w) % BUCKETS).cast("long"))


def hash_text(rows: DataFrame, dim: int, text_col: str = "text", seed: int = 0) -> DataFrame:
    """rows with vec: bucket counts of the words by a fixed random matrix of numbers in (-1, 1)."""
    cell = lambda b, d: (stable_hash(b * dim + d, seed).cast("double") / 1073741823.5) - 1.0
    vec = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda d: F.aggregate("buckets_", F.lit(0.0), lambda acc, b: acc + cell(b, d)))
    return rows.withColumn("buckets_", text_buckets(F.col(text_col))).withColumn("vec", vec).drop("buckets_")


def patch_stats(patch: np.ndarray) -> np.ndarray:
    """Per channel: mean, deviation, median, least, most, quartiles and mean absolute slopes; padded to SIDES."""
    p = patch.astype(np.float64)
    c = p.reshape(-1, p.shape[-1])
    slope = [np.abs(np.diff(p, axis=a)).mean(axis=(0, 1)) if p.shape[a] > 1 else np.zeros(p.shape[-1]) for a in (0, 1)]
    parts = [c.mean(0), c.std(0), np.median(c, 0), c.min(0), c.max(0), *np.percentile(c, [25, 75], axis=0), *slope]
    out = np.zeros(SIDES)
    flat = np.concatenate(parts)[:SIDES]
    out[: len(flat)] = flat
    return out


class HashEncoder:
    """Statistics of patches by a fixed Gaussian matrix; plain: the statistics themselves.  Texts: the numbers of hash_text, for long texts.

    Sums over words are of whole numbers, so texts of the same words have equal vectors.
    """

    normalised = False

    def __init__(self, dim: int = 512, seed: int = 0, plain: bool = False):
        self.projection = np.eye(SIDES, dim) if plain else np.random.default_rng(seed).standard_normal((SIDES, dim))
        self.cells = stable_hashes(np.arange(BUCKETS * dim, dtype=np.int64), seed).reshape(BUCKETS, dim)
        self.known: dict[str, int] = {}

    def bucket(self, word: str) -> int:
        """A word's bucket as text_buckets has it; those met lately are kept."""
        if word not in self.known:
            if len(self.known) >= WORDS_KEPT:
                self.known.clear()
            self.known[word] = sum(ord(c) * (i * 37 + 11) for i, c in enumerate(word)) % BUCKETS
        return self.known[word]

    def encode_text(self, texts: list[str | None]) -> np.ndarray:
        bags = [np.bincount([self.bucket(w) for w in WORD.findall((t or "").lower())], minlength=BUCKETS) if t else np.zeros(BUCKETS, dtype=np.int64) for t in texts]
        counts = np.stack(bags).astype(np.int64) if bags else np.zeros((0, BUCKETS), dtype=np.int64)
        return counts @ self.cells / 1073741823.5 - counts.sum(axis=1, keepdims=True)

    def encode_image(self, patches: np.ndarray) -> np.ndarray:
        return np.stack([patch_stats(p) for p in patches]) @ self.projection


class Pretrained:
    """A pretrained encoder by name, whose model a factory makes on first use, once a worker; text is refused where the model has none.

    factory: "module:function" that the worker imports and calls, or a function.  Its model has encode_image(uint8 [n, h, w, 3]) and, if it knows
    text, encode_text(list of str), each giving rows of numbers.
    """

    def __init__(self, name: str, has_text: bool, normalised: bool, batch_size: int = 64, factory: str | Callable | None = None):
        self.name, self.has_text, self.normalised, self.batch_size, self.factory = name, has_text, normalised, batch_size, factory
        self.model = None

    def load(self):
        if self.model is None:
            if self.factory is None:
                raise RuntimeError(f"encoder {self.name} has no weights here: give it a factory, 'module:function'")
            make = self.factory
            if isinstance(make, str):
                module, _, function = make.partition(":")
                make = getattr(importlib.import_module(module), function)
            self.model = make()
        return self.model

    def _rows(self, call, inputs) -> np.ndarray:
        out = np.concatenate([np.asarray(call(inputs[i : i + self.batch_size]), dtype=np.float64) for i in range(0, len(inputs), self.batch_size)])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8) if self.normalised else out

    def encode_image(self, patches: np.ndarray) -> np.ndarray:
        return self._rows(self.load().encode_image, patches)

    def encode_text(self, texts: list[str]) -> np.ndarray:
        if not self.has_text:
            raise NotImplementedError(f"{self.name} encodes images only")
        return self._rows(self.load().encode_text, texts)


def _make(name: str, has_text: bool, normalised: bool) -> Callable:
    return lambda batch_size=64, factory=None, **_: Pretrained(name, has_text, normalised, batch_size, factory)


REGISTRY: dict[str, Callable] = {
    **dict.fromkeys(("biomedclip", "bmc"), _make("biomedclip", True, True)),
    "plip": _make("plip", True, True),
    **dict.fromkeys(("uni2", "uni2-h", "uni"), _make("uni2", False, False)),
    **dict.fromkeys(("gigapath", "prov-gigapath"), _make("gigapath", False, False)),
    **dict.fromkeys(("hash", "random", "fallback"), lambda dim=512, seed=0, plain=False, **_: HashEncoder(dim, seed, plain)),
}


def register(name: str, factory: Callable) -> None:
    REGISTRY[name] = factory


def get_encoder(name: str, **options):
    if name.lower() not in REGISTRY:
        raise ValueError(f"unknown encoder {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name.lower()](**options)


def encode_patches(patches: DataFrame, name: str, scale: str, numbers: str = "float", **options) -> DataFrame:
    """(cell_id, encoder, scale, embedding) of patches (cell_id, h, w, px binary); the model is made once a task and fails loudly.

    numbers: "float", as embeddings are stored, or "double", which keeps what a model computes.
    """
    if numbers not in ("float", "double"):
        raise ValueError(f"numbers are float or double, not {numbers}")
    id_type = dict(patches.dtypes)["cell_id"]
    ship(patches.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = get_encoder(name, **options)
        kind = pa.float32() if numbers == "float" else pa.float64()
        for b in batches:
            if not b.num_rows:
                continue
            cubes = [np.frombuffer(p.as_py(), dtype=np.uint8).reshape(h, w, 3) for h, w, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)]
            out = np.asarray(model.encode_image(np.stack(cubes)), dtype=kind.to_pandas_dtype())
            n = b.num_rows
            yield pa.record_batch([b.column(0), pa.array([name] * n), pa.array([scale] * n), pa.array(list(out), pa.list_(kind))], names=["cell_id", "encoder", "scale", "embedding"])

    return patches.select("cell_id", "h", "w", "px").mapInArrow(run, f"cell_id {id_type}, encoder string, scale string, embedding array<{numbers}>")


def encode_texts(texts: DataFrame, name: str, text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """texts with vec, by an encoder that knows text; keep_text: with the text itself."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    ship(texts.sparkSession)
    rows = texts if keep_text else texts.select(*[c for c in texts.columns if c != text_col], text_col)
    at, kept = rows.columns.index(text_col), len(rows.columns) - (not keep_text)
    schema = StructType([*rows.schema.fields[:kept], StructField("vec", ArrayType(DoubleType()))])

    def run(batches) -> Iterator:
        import pyarrow as pa

        model = get_encoder(name, **options)
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([*b.columns[:kept], pa.array(list(model.encode_text(b.column(at).to_pylist())), pa.list_(pa.float64()))], names=schema.names)

    return rows.mapInArrow(run, schema)
