"""Nearest neighbours in many dimensions: an exact join that leaves out what distances to pivots rule out.

Rows lie in the cell of their nearest pivot, and a cell's rows in rings by their distance from it, a few thousand rows a block.  Each row first meets its own block;
its K-th neighbour there bounds how far others can be, and by the triangle inequality only cells and rings within that bound can hold nearer ones.  Rows go
to those blocks alone.  Equal vectors ask once, and no more of them than can be anyone's neighbours answer, so copies cost nothing.

A task holds some ASK rows of neighbouring cells and what is nearest to them so far; the blocks that any of them asks are streamed past.  So a row is shuffled once for each
such task at most, not for each block that it asks, and a bound shrinks as nearer rows are found.  Most distances are ruled out in single precision, by a
limit that allows for its rounding; those that are left are worked out in full.

How much is left out depends on the data: vectors in clusters meet a small share of all, vectors without any structure in many dimensions
nearly all.  The result is exact either way.  Pivots and rings, at most MAX_PIVOTS x RINGS rows, are held on the driver and broadcast.

Defined cases: null vectors and those with a null or NaN are left out; vectors of different widths are an error; ties go by id; fewer rows than k + 1 have
all others as neighbours; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichefold.functions.arrays import matrix
from nichefold.functions.exprs import id_number, stable_hash
from nichefold.functions.workers import ship
from nichefold.sources.stage import stage

MAX_PIVOTS, RINGS = 4096, 64
#: Rows of a block that are met at a time, rows that a task asks for, and of those how many at a time; a task asks for LEAST rows or more, unless all are fewer.
BLOCK, ASK, AT_ONCE, LEAST = 2000, 25_000, 256, 250
#: Distances worked out in full at a time, and rows of a batch of results.
PAIRS, ROWS = 1 << 16, 1000


@dataclass
class Rings:
    """Pivots, and of each ring its cell, its number, how many rows it has and their distances from the pivot."""

    pivots: np.ndarray
    cell: np.ndarray
    number: np.ndarray
    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def reach(self, x: np.ndarray, cell: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ring) of the rings that may hold something within the bound of a row.

        Of a row in cell i, what lies in cell j is at least (d_j^2 - d_i^2) / (2 d_ij) away, and at least as far as the row is from the ring.
        """
        d = np.sqrt(squares(x, self.pivots))
        between = np.sqrt(squares(self.pivots, self.pivots))
        own = d[np.arange(len(x)), cell][:, None]
        blur = self.blur(x)
        slack = bound[:, None] + blur
        with np.errstate(divide="ignore", invalid="ignore"):
            far = ((d * d - own * own) / (2 * between[cell]) > slack) & (between[cell] > blur)
        at = self.cell
        near = ~far[:, at] & (d[:, at] - slack <= self.high) & (d[:, at] + slack >= self.low)
        return np.nonzero(near)

    def blur(self, x: np.ndarray) -> float:
        """What rounding may do to distances of rows from pivots."""
        return 1e-6 * math.sqrt(max((x * x).sum(axis=1).max(initial=0), (self.pivots * self.pivots).sum(axis=1).max()))

    def bound(self, x: np.ndarray, k: int) -> np.ndarray:
        """How far the k-th nearest row can be at most, by any one cell that has so many rows."""
        cells = np.unique(self.cell)
        held = self.cell == cells[:, None]
        full = held @ self.rows >= k
        high = np.where(held, self.high, 0).max(axis=1)
        if not full.any():
            return np.full(len(x), np.inf)
        return (np.sqrt(squares(x, self.pivots[cells[full]])) + high[full]).min(axis=1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all of b."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


class Nearest:
    """The k nearest of rows x that were met so far, ties by id.  limit: squared distances beyond which nothing is looked for."""

    def __init__(self, x: np.ndarray, k: int, bound: np.ndarray):
        self.x, self.k = x, k
        self.limit = bound * bound * (1 + 1e-9)
        self.n = np.zeros(len(x), dtype=np.int64)
        self.d2 = np.full((len(x), k), np.inf)
        self.ids: np.ndarray | None = None
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def meet(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, centre: np.ndarray) -> None:
        """These rows of x meet all of y, which lies about centre."""
        for at in range(0, len(y), BLOCK):
            self._near(rows, ids[at : at + BLOCK], y[at : at + BLOCK], centre)
            if 2 * self.waiting > self.k * len(self.x):  # ranked now and then, as that takes longer than to find them
                self.rank()

    def _near(self, rows: np.ndarray, ids: np.ndarray, y: np.ndarray, centre: np.ndarray) -> None:
        apart = y - centre
        norm = (apart * apart).sum(axis=1)
        top, wide = norm.max(), np.column_stack([apart, norm])
        kinds: dict = {}
        for at in range(0, len(rows), AT_ONCE):
            few = rows[at : at + AT_ONCE]
            x = self.x[few] - centre
            own = (x * x).sum(axis=1)
            kind = np.float32 if max(top, own.max()) < 1e30 else np.float64
            if kind not in kinds:
                kinds[kind] = wide.astype(kind).T
            s = np.column_stack([-2 * x, np.ones(len(x))]).astype(kind) @ kinds[kind]  # squared distances less x's own
            eps = np.finfo(kind).eps
            loose = 2 * eps * (y.shape[1] + 8) * (own + top)
            limit = self.limit[few]
            cut = limit * (1 + 4 * eps) - own + loose
            with np.errstate(over="ignore"):
                hit = s <= cut.astype(kind)[:, None]
                if len(y) > self.k and np.count_nonzero(hit) > 4 * self.k * len(few):
                    border = np.partition(s, self.k - 1, axis=1)[:, self.k - 1]
                    hit = s <= np.minimum(cut, border + 3 * loose).astype(kind)[:, None]
            i, j = np.divmod(np.flatnonzero(hit), len(y))
            for p in range(0, len(i), PAIRS):
                u, v = i[p : p + PAIRS], j[p : p + PAIRS]
                d2 = ((self.x[few[u]] - y[v]) ** 2).sum(axis=1)
                near = d2 <= limit[u]
                self.found.append((few[u[near]], d2[near], ids[v[near]]))
                self.waiting += len(d2)

    def rank(self) -> None:
        """What was found since is ranked with what was there."""
        if not self.found:
            return
        i, d2, ids = (np.concatenate(c) for c in zip(*self.found, strict=True))
        self.found, self.waiting = [], 0
        if self.ids is None:
            self.ids = np.zeros((len(self.x), self.k), dtype=ids.dtype)
        rows = np.unique(i)
        r, c = np.nonzero(np.arange(self.k) < self.n[rows][:, None])
        i, d2, ids = np.concatenate([rows[r], i]), np.concatenate([self.d2[rows[r], c], d2]), np.concatenate([self.ids[rows[r], c], ids])
        order = np.argsort(d2, kind="stable")
        order = order[np.argsort(i[order].astype(np.uint16 if len(self.x) <= 1 << 16 else np.int64), kind="stable")]
        if ((i[order][1:] == i[order][:-1]) & (d2[order][1:] == d2[order][:-1])).any():
            order = np.lexsort((np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids, d2, i))
        i, d2, ids = i[order], d2[order], ids[order]
        start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=np.int64)
        place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
        best = place < self.k
        i, place = i[best], place[best]
        self.d2[i, place], self.ids[i, place] = d2[best], ids[best]
        np.maximum.at(self.n, i, place + 1)
        full = rows[self.n[rows] == self.k]
        self.limit[full] = np.minimum(self.limit[full], self.d2[full, self.k - 1])


def _usable(vec: Column) -> Column:
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))


def _in_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rows (id, first, vec) with cell and r, the nearest pivot and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                x = matrix(part.column(2), shared.value.shape[1])
                cell = squares(x, shared.value).argmin(axis=1)
                r = np.sqrt(((x - shared.value[cell]) ** 2).sum(axis=1))
                yield pa.record_batch([*part.columns, pa.array(cell.astype(np.int64)), pa.array(r)], names=["id", "first", "vec", "cell", "r"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {types['id']}, first boolean, vec {types['vec']}, cell long, r double")


def _home(rows: DataFrame, k: int) -> DataFrame:
    """(id, cell, group, vec, bound) of the first of equal rows: how far the k-th nearest is in the row's own block, infinite where that has fewer.  Any k rows will do, so blocks are taken BLOCK or so rows at a time."""
    types = dict(rows.dtypes)
    rows = rows.select("ring", "piece", "id", "first", "cell", "group", "vec").repartition("ring", "piece").sortWithinPartitions("ring", "piece", "id")
    names = ["id", "cell", "group", "vec", "bound"]

    def asked(parts):
        import pyarrow as pa

        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        x, asks = matrix(b.column(6)), np.flatnonzero(b.column(3).to_numpy(zero_copy_only=False))
        near = Nearest(x[asks], k, np.full(len(asks), np.inf))
        near.meet(np.arange(len(asks)), np.arange(len(x)), x, x.mean(axis=0))
        near.rank()
        mine = b.take(pa.array(asks))
        return pa.record_batch([*(mine.column(c) for c in (2, 4, 5, 6)), pa.array(np.where(near.n == k, np.sqrt(near.d2[:, k - 1]), np.inf))], names=names)

    def run(batches):
        now, parts = None, []
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(2)], axis=1)
            for cut in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1) if len(key) else []:
                if parts and (tuple(key[cut[0]]) != now or sum(p.num_rows for p in parts) >= BLOCK):
                    yield asked(parts)
                    parts = []
                now = tuple(key[cut[0]])
                for at in range(0, len(cut), BLOCK):
                    if sum(p.num_rows for p in parts) >= BLOCK:
                        yield asked(parts)
                        parts = []
                    parts.append(b.slice(cut[at], min(BLOCK, len(cut) - at)))
        if parts:
            yield asked(parts)

    return rows.mapInArrow(run, f"id {types['id']}, cell long, group int, vec {types['vec']}, bound double")


def _asked(askers: DataFrame, rings: Rings) -> DataFrame:
    """(group, ring, n): how many of a task's askers may find something in a ring, where any may."""
    shared = askers.sparkSession.sparkContext.broadcast(rings)

    def run(batches):
        import pyarrow as pa

        to, total = shared.value, {}
        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                group = part.column(0).to_numpy()
                i, j = to.reach(matrix(part.column(2), to.pivots.shape[1]), part.column(1).to_numpy(), part.column(3).to_numpy())
                for g in np.unique(group):
                    total[g] = total.get(g, 0) + np.bincount(j[group[i] == g], minlength=len(to.number))
        for g, n in total.items():
            some = np.flatnonzero(n)
            yield pa.record_batch([pa.array(np.full(len(some), g), pa.int32()), pa.array(to.number[some]), pa.array(n[some])], names=["group", "ring", "n"])

    return askers.select("group", "cell", "vec", "bound").mapInArrow(run, "group int, ring long, n long").groupBy("group", "ring").agg(F.sum("n").alias("n"))


def _meet(holders: DataFrame, askers: DataFrame, rings: Rings, groups: int, k: int) -> DataFrame:
    """(q, near): the k nearest holders of each asker, nearest first.  holders: group, ring, id, vec; askers: group, id, cell, bound, vec."""
    shared = askers.sparkSession.sparkContext.broadcast(rings)
    kind, none = dict(holders.dtypes)["id"], F.lit(0).cast("long")
    ask = askers.select("group", F.lit(0).alias("side"), none.alias("ring"), "id", "cell", "bound", "vec")
    rows = ask.unionByName(holders.select("group", F.lit(1).alias("side"), "ring", "id", none.alias("cell"), F.lit(0.0).alias("bound"), "vec"))
    rows = rows.repartitionById(groups, "group").sortWithinPartitions("group", "side", "ring")

    class Task:
        def __init__(self, parts):
            import pyarrow as pa

            b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            self.ids, self.cell = b.column(3), b.column(4).to_numpy()
            self.near = Nearest(matrix(b.column(6), shared.value.pivots.shape[1]), k, b.column(5).to_numpy())
            self.blur = shared.value.blur(self.near.x)
            self.own, self.at = np.sqrt(((self.near.x - shared.value.pivots[self.cell]) ** 2).sum(axis=1)), None

        def reached(self, ring: int) -> np.ndarray:
            """The rows that may find something in a ring, by what they have found; see Rings.reach."""
            to = shared.value
            at = np.searchsorted(to.number, ring)
            if to.cell[at] != self.at:
                self.at, pivot = to.cell[at], to.pivots[to.cell[at]][None]
                self.far, self.between = np.sqrt(squares(self.near.x, pivot))[:, 0], np.sqrt(squares(to.pivots, pivot))[:, 0][self.cell]
            slack = np.sqrt(self.near.limit) + self.blur
            with np.errstate(divide="ignore", invalid="ignore"):
                out = ((self.far**2 - self.own**2) / (2 * self.between) > slack) & (self.between > self.blur)
            return np.flatnonzero(~out & (self.far - slack <= to.high[at]) & (self.far + slack >= to.low[at]))

        def meet(self, ring: int, b) -> None:
            rows = self.reached(ring)
            if len(rows):
                self.near.meet(rows, b.column(3).to_numpy(zero_copy_only=False), matrix(b.column(6), self.near.x.shape[1]), shared.value.pivots[self.at])

        def lists(self):
            import pyarrow as pa

            self.near.rank()
            for at in range(0, len(self.ids), ROWS):
                n = self.near.n[at : at + ROWS]
                if self.near.ids is None:
                    return
                there = np.arange(k) < n[:, None]
                nbr = pa.array(self.near.ids[at : at + ROWS][there], type=self.ids.type)
                each = pa.StructArray.from_arrays([pa.array(self.near.d2[at : at + ROWS][there]), nbr], names=["d2", "nbr"])
                yield pa.record_batch([self.ids.slice(at, ROWS), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), each)], names=["q", "near"])

    def run(batches):
        now, parts, task = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in range(3)], axis=1)
            for cut in np.split(np.arange(len(key)), np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1) if len(key) else []:
                group, side, ring = key[cut[0]]
                if group != now:
                    if task is not None:
                        yield from task.lists()
                    now, parts, task = group, [], None
                if side == 0:
                    parts.append(b.slice(cut[0], len(cut)))
                    continue
                if task is None:
                    task, parts = Task(parts), []
                task.meet(ring, b.slice(cut[0], len(cut)))
        if task is not None:
            yield from task.lists()

    return rows.mapInArrow(run, f"q {kind}, near array<struct<d2: double, nbr: {kind}>>")


class Join:
    """The steps of the join over rows (id, vec); ``pairs`` is how many distances it takes at most, ``sent`` how many rows go to the tasks that ask."""

    def __init__(self, rows: DataFrame, k: int, pivots: int | None = None):
        self.k, self.most = k, k + 1  # a row finds itself, too
        ship(rows.sparkSession)
        same = Window.partitionBy("key").orderBy("id")
        kind = "float" if dict(rows.dtypes)["vec"] == "array<float>" else "double"
        self.keyed = stage(rows.filter(_usable(F.col("vec"))).select("id", F.col("vec").cast(f"array<{kind}>").alias("vec")).withColumn("key", F.md5(F.col("vec").cast("string").cast("binary"))), "keyed")
        few = self.keyed.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= self.most)
        held = stage(few.select("id", (F.col("place") == 1).alias("first"), "vec", "key"), "holders")
        self.firsts = held.filter("first").select("key", F.col("id").alias("q"))
        n = held.filter("first").count()
        self.pairs = self.sent = 0
        if not n:
            self.found = None
            return
        want = min(MAX_PIVOTS, pivots or max(1, round(math.sqrt(n))))
        drawn = held.filter("first").withColumn("h", stable_hash(id_number(held, "id"))).orderBy("h", "id").limit(want)
        centres = np.array([r.vec for r in drawn.select("vec").collect()], dtype=np.float64)  # at most MAX_PIVOTS
        self.found = self._find(held, centres, n)

    def _find(self, held: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
        spark = held.sparkSession
        cells = stage(_in_cells(held.select("id", "first", "vec").repartition(2 * spark.sparkContext.defaultParallelism, "id"), centres), "in-cells")
        sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("r", [i / RINGS for i in range(1, RINGS)]).alias("cuts"))
        rings = F.least(F.lit(RINGS), F.ceil(F.col("n") / BLOCK))
        sizes = stage(sizes.select("cell", "cuts", rings.alias("rings"), F.ceil(F.col("n") / (rings * BLOCK)).cast("long").alias("pieces")), "rings")  # a row a pivot
        place = F.size(F.filter("cuts", lambda c: c < F.col("r")))
        ring = F.col("cell") * RINGS + F.floor(place * F.col("rings") / RINGS)
        rows = cells.join(F.broadcast(sizes), "cell").select("id", "first", "vec", "cell", "r", ring.alias("ring"), F.pmod(F.xxhash64("id"), "pieces").alias("piece"))
        rows = stage(rows, "blocks")
        per = sorted(rows.groupBy("ring").agg(F.count("*"), F.min("r"), F.max("r"), F.sum(F.col("first").cast("long"))).collect())  # at most MAX_PIVOTS x RINGS
        number, held_rows, low, high, asking = (np.array(c) for c in zip(*per, strict=True))
        to = Rings(centres, number // RINGS, number, held_rows, low, high)
        group, parts = dealt(to, asking, min(ASK, max(1, min(n, LEAST), n // (2 * spark.sparkContext.defaultParallelism))))
        groups = int((group + parts).max())
        table = spark.createDataFrame(list(zip(number.tolist(), group.tolist(), parts.tolist(), strict=True)), "ring long, group0 int, parts int")
        mine = (F.col("group0") + F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts"))).cast("int").alias("group")
        askers = _bounded(_home(rows.join(F.broadcast(table), "ring").select(*rows.columns, mine), self.most), to, self.most)
        askers = stage(askers.repartitionById(groups, "group"), "askers")
        asked = stage(_asked(askers, to), "asked")
        times = spark.createDataFrame(list(zip(number.tolist(), held_rows.tolist(), strict=True)), "ring long, rows long")
        self.pairs, self.sent = (int(v or 0) for v in asked.join(F.broadcast(times), "ring").agg(F.sum(F.col("n") * F.col("rows")), F.sum("rows")).first())
        holders = rows.select("ring", "id", "vec").join(asked.select("group", "ring"), "ring")
        return _meet(holders, askers, to, groups, self.most)

    def result(self) -> DataFrame | None:
        """(id, nbr, d2, rnk)."""
        if self.found is None:
            return None
        rows = self.keyed.select("id", "key").join(self.firsts.join(self.found, "q"), "key")
        others = F.slice(F.filter("near", lambda s: s["nbr"] != F.col("id")), 1, self.k)
        return rows.select("id", F.posexplode(others).alias("p", "s")).select("id", "s.nbr", "s.d2", (F.col("p") + 1).cast("int").alias("rnk"))


def dealt(to: Rings, asking: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, parts): the tasks whose askers a ring's are, some ``most`` each, of cells that lie near one another."""
    d = squares(to.pivots, to.pivots[: max(1, round(math.sqrt(len(to.pivots))))])
    cell = to.cell
    order = np.lexsort((to.number, d.min(axis=1)[cell], d.argmin(axis=1)[cell]))
    before = np.cumsum(asking[order]) - asking[order]
    first, parts = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    first[order] = before // most
    parts[order] = np.where(asking[order] > most, (before + asking[order] - 1) // most - before // most + 1, 1)
    return first, parts


def _bounded(askers: DataFrame, to: Rings, k: int) -> DataFrame:
    """askers with a bound by whole cells where their own block has none."""
    shared = askers.sparkSession.sparkContext.broadcast(to)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, AT_ONCE):
                part = b.slice(at, AT_ONCE)
                bound = part.column(4).to_numpy().copy()
                if np.isinf(bound).any():
                    free = np.isinf(bound)
                    bound[free] = shared.value.bound(matrix(part.column(3), shared.value.pivots.shape[1])[free], k)
                yield pa.record_batch([*part.columns[:4], pa.array(bound)], names=part.schema.names)

    return askers.mapInArrow(run, askers.schema)


def feature_knn(items: DataFrame, k: int, id_col: str = "item_id", vec_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """(item_id, nbr_id, d2, rnk): the k nearest other items of each, by Euclidean distance, ties by id."""
    rows = items.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    found = Join(rows, k, pivots).result()
    kind = dict(rows.dtypes)["id"]
    if found is None:
        return items.sparkSession.createDataFrame([], f"item_id {kind}, nbr_id {kind}, d2 double, rnk int")
    return found.select(F.col("id").alias("item_id"), F.col("nbr").alias("nbr_id"), "d2", "rnk")
