"""Patches from slide tiles, and stain normalisation (Macenko) on pixel rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.functions.quantiles import exact_quantiles
from nichefold.functions.workers import ship
from nichefold.operators.sampling import uniform_subset
from nichefold.sources.stage import stage

#: Centres that one task cuts from a tile.
TOGETHER = 500
#: Bytes of pixels, about, that go into one row batch.
PIXELS = 300_000


def _patch(rows: DataFrame) -> str:
    return f"cell_id {dict(rows.dtypes)['cell_id']}, h int, w int, px binary"


def resize(patch: np.ndarray, size: int) -> np.ndarray:
    """Bilinear, about pixel centres."""
    h, w = patch.shape[:2]
    if (h, w) == (size, size):
        return patch
    y = np.clip((np.arange(size) + 0.5) * h / size - 0.5, 0, h - 1)
    x = np.clip((np.arange(size) + 0.5) * w / size - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = patch.astype(np.float64)
    out = (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy
    return np.rint(out).astype(np.uint8)


def extract_patches(tiles: DataFrame, centres: DataFrame, tile: int, window: int, out_size: int | None = None) -> DataFrame:
    """(cell_id, h, w, px): a square window about each centre, zero where the slide ends.

    tiles: tx, ty, h, w, px (rows of RGB bytes).  centres: cell_id, px, py.  A tile meets the windows that overlap it, some hundred at a time, and
    only the pieces cut from it are dealt by cell; the slide is never whole anywhere, nor a tile dealt with every cell.
    """
    half = window // 2
    left, top = (F.rint(c).cast("int") - half for c in ("px", "py"))
    rows = centres.select("cell_id", left.alias("left"), top.alias("top"))
    span = lambda c: F.sequence(F.floor(F.col(c) / tile).cast("int"), F.floor((F.col(c) + window - 1) / tile).cast("int"))
    rows = rows.withColumn("tx", F.explode(span("left"))).withColumn("ty", F.explode(span("top")))
    part = F.pmod(F.xxhash64("cell_id"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_") / TOGETHER)))
    crowd = rows.groupBy("tx", "ty").agg(F.count("*").alias("n_"))
    groups = rows.join(crowd, ["tx", "ty"]).groupBy("tx", "ty", part.alias("part")).agg(F.collect_list(F.struct("cell_id", "left", "top")).alias("cells"))
    met = groups.join(tiles, ["tx", "ty"]).select("tx", "ty", "h", "w", "px", F.col("cells.cell_id").alias("ids"), F.col("cells.left").alias("lefts"), F.col("cells.top").alias("tops"))
    ids = dict(rows.dtypes)["cell_id"]
    ship(tiles.sparkSession)

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            for r in range(b.num_rows):
                tx, ty, h, w = (b.column(i)[r].as_py() for i in range(4))
                img = np.frombuffer(b.column(4)[r].as_buffer(), np.uint8).reshape(h, w, 3)
                who, lefts, tops = (b.column(i)[r].values for i in (5, 6, 7))
                made = []
                for x0, y0 in zip(lefts.to_pylist(), tops.to_pylist(), strict=True):
                    ox, oy = tx * tile - x0, ty * tile - y0
                    sx, sy = max(0, -ox), max(0, -oy)
                    piece = img[sy : max(sy, window - oy), sx : max(sx, window - ox)]
                    made.append((max(0, ox), max(0, oy), piece.shape[0], piece.shape[1], piece.tobytes()))
                yield pa.record_batch([who, *(pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(),) * 4 + (pa.binary(),), strict=True))], names=["cell_id", "ox", "oy", "h", "w", "px"])

    pieces = met.mapInArrow(cut, f"cell_id {ids}, ox int, oy int, h int, w int, px binary")
    # A window that overlaps no tile is all zero.
    all_ = pieces.unionByName(rows.select("cell_id", *[F.lit(0).alias(c) for c in ("ox", "oy", "h", "w")], F.lit(b"").alias("px")).distinct())

    def build(batches):
        import pyarrow as pa

        def emit(cell, out):
            made = resize(out, out_size) if out_size else out
            return pa.record_batch([cell, pa.array([made.shape[0]], pa.int32()), pa.array([made.shape[1]], pa.int32()), pa.array([made.tobytes()])], names=["cell_id", "h", "w", "px"])

        now = out = None
        for b in batches:
            for r in range(b.num_rows):
                cell = b.column(0)[r : r + 1]
                if now is None or cell[0] != now[0]:
                    if now is not None:
                        yield emit(now, out)
                    now, out = cell, np.zeros((window, window, 3), np.uint8)
                ox, oy, h, w = (b.column(i)[r].as_py() for i in range(1, 5))
                out[oy : oy + h, ox : ox + w] = np.frombuffer(b.column(5)[r].as_py(), np.uint8).reshape(h, w, 3)
        if now is not None:
            yield emit(now, out)

    return all_.repartition("cell_id").sortWithinPartitions("cell_id").mapInArrow(build, f"cell_id {ids}, h int, w int, px binary")


def density(c: Column) -> Column:
    """Optical density of a colour value."""
    return -F.log((c.cast("double") + 1.0) / 256.0)


def stain_profile(pixels: DataFrame, beta: float = 0.15, alpha: float = 1.0, least: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Stain vectors (3 x 2, hematoxylin first) and their 99th percentiles of concentration, from rows (r, g, b).

    Rows near white are left out, unless fewer than ``least`` would remain.  The cluster sums covariances and percentiles; the driver
    solves 3 x 3 problems.
    """
    od = stage(pixels, "pixels").select(*[density(F.col(c)).alias(c) for c in "rgb"])
    dark = od.filter((F.col("r") >= beta) & (F.col("g") >= beta) & (F.col("b") >= beta))
    if dark.count() >= least:
        od = dark
    cov = np.array([x for x in od.agg(*[F.covar_samp(i, j) for i in "rgb" for j in "rgb"]).first()]).reshape(3, 3)
    v = np.linalg.eigh(cov)[1][:, [2, 1]]
    v = v * np.where(v[0] < 0, -1, 1)
    along = lambda k: sum((F.col(c) * float(v[i, k]) for i, c in enumerate("rgb")), F.lit(0.0))
    lo, hi = exact_quantiles(od.select(F.atan2(along(1), along(0)).alias("a")), "a", [alpha / 100, 1 - alpha / 100])
    he = np.stack([v @ [np.cos(t), np.sin(t)] for t in (lo, hi)], axis=1)
    he = he / (np.linalg.norm(he, axis=0, keepdims=True) + 1e-8)
    if he[0, 0] < he[0, 1]:
        he = he[:, ::-1]
    solve = np.linalg.pinv(he)
    amount = lambda k: sum((F.col(c) * float(solve[k, i]) for i, c in enumerate("rgb")), F.lit(0.0))
    return he, np.array([exact_quantiles(od.select(amount(k).alias("a")), "a", [0.99])[0] for k in (0, 1)])


def normalise_stain(patches: DataFrame, source: tuple[np.ndarray, np.ndarray], reference: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Patches with the source's stains scaled and turned into the reference's, clipped and cut to whole numbers."""
    solve, scale, ref = np.linalg.pinv(source[0]), reference[1] / (source[1] + 1e-8), reference[0]

    ship(patches.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for p in b.column(3):
                od = -np.log((np.frombuffer(p.as_py(), np.uint8).reshape(-1, 3).astype(np.float64) + 1) / 256)
                made = 256 * np.exp(-(ref @ ((solve @ od.T) * scale[:, None])).T)
                out.append(np.clip(made, 0, 255).astype(np.uint8).tobytes())
            yield pa.record_batch([*b.columns[:3], pa.array(out, pa.binary())], names=["cell_id", "h", "w", "px"])

    return patches.select("cell_id", "h", "w", "px").mapInArrow(run, _patch(patches))


def pixel_rows(patches: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """(r, g, b) of all pixels of patches, or of a uniform sample of so many patches."""
    ship(patches.sparkSession)
    if sample is not None:
        patches = patches.join(F.broadcast(uniform_subset(patches.select("cell_id"), "cell_id", sample, seed)), "cell_id", "left_semi")  # drawn by ids alone

    def made(held):
        import pyarrow as pa

        v = np.concatenate(held).reshape(-1, 3).astype(np.int32)
        return pa.record_batch([pa.array(v[:, i].copy()) for i in range(3)], names=["r", "g", "b"])

    def run(batches):
        for b in batches:
            held, size = [], 0
            for p in b.column(0):
                held.append(np.frombuffer(p.as_buffer(), np.uint8))
                size += len(held[-1])
                if size >= PIXELS:
                    yield made(held)
                    held, size = [], 0
            if held:
                yield made(held)

    return patches.select("px").mapInArrow(run, "r int, g int, b int")
