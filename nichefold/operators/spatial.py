"""Neighbourhoods in the plane: nearest neighbours and radius joins on a grid, composition, niches, tiles and pixels."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichefold.config import LINEAGES, NICHES, UNKNOWN
from nichefold.functions.exprs import id_number, stable_unit
from nichefold.functions.workers import spread as over_tasks
from nichefold.operators.vectors import mean_vectors
from nichefold.sources.stage import stage

#: Points that a grid square and its eight neighbours hold on average in the first round, as a multiple of k.
CROWD = 4.0
#: Points that a square may hold in the first round, as a multiple of k + 1.
CROWDED = 16
#: Points of a square that a task reads where squares may be crowded, and hash slots that crowded squares are told of in.
SPAN, SLOTS = 2000, 1 << 16
#: Points that a task looks for neighbours of in the first round.
SEEK = 50_000


def _square(c: str, width: float) -> Column:
    return F.floor(F.col(c) / F.lit(width)).cast("long")


def _touching(rows: DataFrame, width: float) -> DataFrame:
    """rows once for each of the nine squares at and about their own, gx and gy."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    rows = rows.select("*", F.explode(near).alias("o"))
    return rows.select("*", (_square("x", width) + F.col("o.i")).alias("gx"), (_square("y", width) + F.col("o.j")).alias("gy")).drop("o")


def _slot() -> Column:
    return F.pmod(F.xxhash64("gx", "gy"), F.lit(SLOTS))


def _crowd(rows: DataFrame) -> DataFrame:
    """(slot, parts): into how many parts the rows of crowded squares are dealt; at most SLOTS rows, whatever the points."""
    sizes = rows.groupBy("gx", "gy").agg(F.count("*").alias("n")).filter(F.col("n") > SPAN)
    return sizes.groupBy(_slot().alias("slot")).agg(F.ceil(F.max("n") / SPAN).alias("parts"))


def _dealt(rows: DataFrame, crowd: DataFrame, key: str | None) -> DataFrame:
    """rows with the part of their square that they belong to, by key; without a key, once for each part."""
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    part = F.pmod(F.xxhash64(key), parts) if key else F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    return rows.withColumn("slot", _slot()).join(F.broadcast(crowd), "slot", "left").withColumn("part", part)


def _pairs(left: DataFrame, right: DataFrame, width: float, spread: bool = False, by_right: bool = False, keep: tuple[str, ...] = (), tasks: int = 1, crowded: bool = False) -> DataFrame:
    """Pairs of points in touching squares, with squared distances: an equi-join on the square, dealt over tasks however few bytes the points have, as the work is in their pairs.

    The left's points stay in their squares and the right's go to nine; gx, gy and part place a pair, and all pairs of a point lie in one task, so what is worked out for each point needs no shuffle.
    crowded: squares may hold many points of the left, which are then dealt over tasks.  spread: the right's squares may be crowded; then each point of the left looks at nine, and the left's rows of such a square are dealt over several tasks, each of which gets all of the right's; by_right: the right's
    are dealt, SPAN or so to a task, and the left's, which are few then, repeated.  keep: other columns of the right that pairs carry.
    """
    square = [_square("x", width).alias("gx"), _square("y", width).alias("gy")]
    nbr = [F.col("cell_id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny")]
    if spread:
        a, b = _touching(left.select("cell_id", "x", "y"), width), right.select(*nbr, *square, *keep)
        crowd = _crowd(b)
        a, b = (_dealt(a, crowd, None), _dealt(b, crowd, "nbr_id")) if by_right else (_dealt(a, crowd, "cell_id"), _dealt(b, crowd, None))
    else:
        a, b = left.select("cell_id", "x", "y", *square), _touching(right, width).select(*nbr, "gx", "gy", *keep)
        if crowded:
            crowd = _crowd(a)
            a, b = _dealt(a, crowd, "cell_id"), _dealt(b, crowd, None)
    at = ["gx", "gy", "part"] if spread or crowded else ["gx", "gy"]
    met = over_tasks(a, *at, least=tasks).join(over_tasks(b, *at, least=tasks).hint("merge"), at)
    d2 = (F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny"))
    return met.select("cell_id", "nbr_id", d2.alias("d2"), *keep, *([] if spread else at))


def radius_edges(points: DataFrame, radius: float) -> DataFrame:
    """(cell_id, nbr_id, d2) of other points within the radius, bounds included."""
    return _within(points, points, radius)


def _within(points: DataFrame, others: DataFrame, radius: float, keep: tuple[str, ...] = ()) -> DataFrame:
    return _pairs(points, others, float(radius), spread=True, keep=keep).filter((F.col("cell_id") != F.col("nbr_id")) & (F.col("d2") <= float(radius) * float(radius)))


def _first_width(points: DataFrame, width: float, most: float) -> float:
    """A width, from the given one down, at which no square holds more than so many points."""
    for _ in range(60):
        fullest = points.groupBy(_square("x", width).alias("gx"), _square("y", width).alias("gy")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if fullest <= most:
            break
        width /= 4 if fullest > 4 * most else 2
    return width


def knn_edges(points: DataFrame, k: int, store=None) -> DataFrame:
    """(cell_id, nbr_id, d2, rnk): the k nearest other points, ties by id.

    Points look in their own and touching grid squares; a point is done when its k-th neighbour is no farther than a square is wide, since
    nothing nearer can lie beyond.  The rest look again with wider squares, until the squares cover everything.  The first squares are so
    small that the fullest holds at most CROWDED * (k + 1) points, and of points at one place only the k + 1 of the least ids can be
    anyone's neighbours.  In wider squares, where the few that are left may meet a whole cluster, the cluster's points are dealt over tasks.  store(df) writes and reads back a round's result.
    """
    return _nearest(points.select("cell_id", "x", "y"), k, store)


def _nearest(points: DataFrame, k: int, store=None, tell: list[Column] | None = None) -> DataFrame:
    """knn_edges, of which each round keeps only what is done; tell: aggregates of a point's neighbours and their other columns, to be kept instead, as a row a point that has neighbours."""
    store = store or stage
    keep = tuple(c for c in points.columns if c not in ("cell_id", "x", "y"))
    ids = dict(points.dtypes)["cell_id"]
    n, x0, x1, y0, y1 = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not n:
        none = points.sparkSession.createDataFrame([], f"cell_id {ids}, nbr_id {ids}, d2 double, rnk int")
        return none.join(points.select(F.col("cell_id").alias("nbr_id"), *keep), "nbr_id").groupBy("cell_id").agg(*tell) if tell else none
    spread = max(x1 - x0, y1 - y0)
    area = max(x1 - x0, spread * 1e-3) * max(y1 - y0, spread * 1e-3)
    width = math.sqrt(CROWD * (k + 1) / 9 * area / n) or 1.0
    need = min(k, n - 1)
    there = Window.partitionBy("x", "y").orderBy("cell_id")
    targets = store(points.withColumn("at_", F.row_number().over(there)).filter(F.col("at_") <= k + 1).drop("at_"))
    width = max(_first_width(targets, width, CROWDED * (k + 1)), spread * 1e-12)
    todo, out = points.select("cell_id", "x", "y"), None
    unique = points.select("cell_id").distinct().count() == n
    while True:
        last = width > spread
        near = _pairs(todo, targets, width, False, False, keep, n // SEEK, targets.count() < n) if out is None else _pairs(todo, targets, width, True, True, keep)
        near = near.filter("cell_id <> nbr_id")
        if not last:  # what lies farther makes no point sure
            near = near.filter(F.col("d2") <= width * width)
        each = [*(c for c in ("gx", "gy", "part") if c in near.columns and unique), "cell_id"]  # rows that share an id may lie in several squares
        found = near.withColumn("rnk", F.row_number().over(Window.partitionBy(*each).orderBy("d2", "nbr_id"))).filter(F.col("rnk") <= k)
        if tell:
            found = found.groupBy(*each).agg(F.max("rnk").alias("n_"), *tell)
        elif not last:
            found = found.withColumn("n_", F.max("rnk").over(Window.partitionBy(*each)))
        found = found if last else found.filter(F.col("n_") >= need)
        done = store(found.drop("n_", "gx", "gy", "part", *(() if tell else keep)))
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        whose = done.select("cell_id") if tell else done.filter(F.col("rnk") == need).select("cell_id")
        todo = store(todo.join(whose, "cell_id", "left_anti"))
        if todo.isEmpty():
            return out
        width *= 2 if not done.isEmpty() else 8


def composition(points: DataFrame, edges: DataFrame, types: DataFrame, lineages: list[str] = LINEAGES) -> DataFrame:
    """frac_<lineage> of each point's neighbours; unknown ones count below the line, points without neighbours have 0."""
    kinds = edges.join(types.select(F.col("cell_id").alias("nbr_id"), "cell_type"), "nbr_id")
    return _shares(points, kinds.groupBy("cell_id").agg(*_fractions(lineages)))


def knn_composition(points: DataFrame, k: int, types: DataFrame, lineages: list[str] = LINEAGES) -> DataFrame:
    """composition by knn_edges: neighbours are counted where they are found, and no edge is shuffled or written."""
    named = types.select("cell_id", F.coalesce("cell_type", F.lit(UNKNOWN)).alias("cell_type"))
    typed = stage(points.select("cell_id", "x", "y").join(named, "cell_id", "left"), "typed")
    return _shares(points, _nearest(typed, k, tell=_fractions(lineages, "cell_type")))


def radius_composition(points: DataFrame, radius: float, types: DataFrame, lineages: list[str] = LINEAGES) -> DataFrame:
    """composition by the other points within the radius: pairs are counted where they are found, and none is shuffled."""
    typed = stage(points.select("cell_id", "x", "y").join(types.select("cell_id", "cell_type"), "cell_id"), "typed")
    return _shares(points, _within(points, typed, radius, ("cell_type",)).groupBy("cell_id").agg(*_fractions(lineages)))


def _fractions(lineages: list[str], of: str = "*") -> list[Column]:
    n = F.count(of)
    return [F.when(n > 0, F.count_if(F.col("cell_type") == t) / n).alias(f"frac_{t}") for t in lineages]


def _shares(points: DataFrame, fracs: DataFrame) -> DataFrame:
    return points.select("cell_id").join(fracs, "cell_id", "left").fillna(0.0)


def niche_labels(comp: DataFrame, th: dict[str, float], priority: list[str] = NICHES) -> DataFrame:
    """niche_<name> booleans, which may overlap, and niche_label: the first that holds in order of priority."""
    f = lambda t: F.col(f"frac_{t}")
    rules = {
        "bcell_rich": f("B_cell") >= th["bcell_rich"],
        "tcell_rich": f("T_cell") >= th["tcell_rich"],
        "myeloid_rich": f("Myeloid") >= th["myeloid_rich"],
        "vascular": (f("Endothelial") >= th["vascular"]) & (f("Fibroblast") > 0),
        "immune_rich": f("T_cell") + f("B_cell") + f("Myeloid") >= th["immune_rich"],
        "tumor_immune_interface": (f("Epithelial") >= th["interface_epi"]) & (f("T_cell") + f("Myeloid") >= th["interface_imm"]),
    }
    out = comp.select("*", *[c.alias(f"niche_{n}") for n, c in rules.items()])
    label = F.lit("none")
    for n in reversed(priority):
        label = F.when(F.col(f"niche_{n}"), n).otherwise(label)
    return out.withColumn("niche_label", label)


def neighbour_average(vectors: DataFrame, edges: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(cell_id, embedding): the mean of a point's own and its neighbours' vectors, of whatever width they are; uneven ones are an error."""
    own = vectors.select("cell_id", F.col("cell_id").alias("nbr_id"))
    near = edges.select("cell_id", "nbr_id").unionByName(own)
    rows = near.join(vectors.select(F.col("cell_id").alias("nbr_id"), F.col(vec_col).alias("v")), "nbr_id")
    return mean_vectors(rows.select("cell_id", "nbr_id", "v"), "cell_id", "v", "embedding", combine=False)


def grid_tiles(points: DataFrame, tile: float) -> DataFrame:
    """points with the number of their tile: counted from the least x and y, column by column."""
    box = points.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    rows = points.crossJoin(F.broadcast(box))
    tx, ty = F.floor((F.col("x") - F.col("x0")) / tile), F.floor((F.col("y") - F.col("y0")) / tile)
    return rows.withColumn("tile", (tx * (F.floor((F.col("y1") - F.col("y0")) / tile) + 1) + ty).cast("long")).drop("x0", "y0", "y1")


def outside_buffer(points: DataFrame, folds: DataFrame, fold: int, buffer: float) -> DataFrame:
    """Training points of a fold: those of other folds that lie farther than the buffer from every test point."""
    rows = points.join(folds, "cell_id")
    test, train = rows.filter(F.col("fold") == fold), rows.filter(F.col("fold") != fold)
    close = _pairs(train, test, float(buffer), spread=True).filter(F.col("d2") <= float(buffer) * float(buffer)).select("cell_id").distinct()
    return train.join(close, "cell_id", "left_anti")


def buffered_folds(points: DataFrame, folds: DataFrame, buffer: float) -> DataFrame:
    """(cell_id, skip): for each point, the other folds of which a test point lies within the buffer."""
    rows = points.select("cell_id", "x", "y").join(folds, "cell_id")
    near = _pairs(rows, rows, float(buffer), spread=True).filter(F.col("d2") <= float(buffer) * float(buffer))
    return near.join(folds.select(F.col("cell_id").alias("nbr_id"), "fold"), "nbr_id").groupBy("cell_id").agg(F.collect_set(F.col("fold").cast("int")).alias("skip"))


def to_pixels(points: DataFrame, micron_per_pixel: float) -> DataFrame:
    return points.select("cell_id", (F.col("x") / micron_per_pixel).alias("px"), (F.col("y") / micron_per_pixel).alias("py"))


def to_pixels_affine(points: DataFrame, m: list[list[float]], invert: bool = False) -> DataFrame:
    """Homogeneous 3 x 3 transform with perspective division; invert: by the inverse matrix."""
    if invert:
        import numpy as np

        m = np.linalg.inv(np.array(m)).tolist()
    row = lambda r: F.col("x") * float(m[r][0]) + F.col("y") * float(m[r][1]) + float(m[r][2])
    return points.select("cell_id", (row(0) / row(2)).alias("px"), (row(1) / row(2)).alias("py"))


def _nearest_centre(rows: DataFrame, centres: list[tuple[Column, Column]]) -> tuple[DataFrame, Column]:
    """rows with the squared distance of x and y from each centre, and the place, from 0, of the nearest, ties to the first; all of it compiled code."""
    d2 = lambda x, y: (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    far = [f"far{i}_" for i in range(len(centres))]
    place = F.lit(len(far) - 1)
    for i in reversed(range(len(far) - 1)):
        later = F.least(*far[i + 1 :]) if len(far) > i + 2 else F.col(far[i + 1])
        place = F.when(F.col(far[i]) <= later, F.lit(i)).otherwise(place)
    return rows.select("*", *[d2(*c).alias(f) for f, c in zip(far, centres, strict=True)]), place


def kmeans_regions(points: DataFrame, k: int = 5, seed: int = 0, starts: int = 10, rounds: int = 30, unit: float = 1e-3) -> DataFrame:
    """(cell_id, fold): regions by k-means on coordinates, the best of several starts, numbered by their centres from left to right.

    All starts go side by side, a job a round.  Coordinates count in whole units, so sums are exact.  A start draws points far from those it has: each next one with a
    chance in proportion to its squared distance.  Rounds end when no centre moves; a region that loses its points keeps its centre.  Where fewer than k
    places differ there are as many regions.  Centres, starts x k of them, are held on the driver.
    """
    spark = points.sparkSession
    whole = lambda c: F.round(F.col(c) / unit).cast("long")
    rows = stage(over_tasks(points.select("cell_id", whole("x").alias("x"), whole("y").alias("y")), "cell_id"), "regions")
    number = id_number(rows, "cell_id")
    held: list[list[tuple]] = [[] for _ in range(starts)]
    for j in range(k):
        picks = []
        for s, mine in enumerate(held):
            far = F.least(*[((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).cast("double") for x, y in mine], F.lit(math.inf)) if mine else F.lit(1.0)
            wait = F.when(far > 0, -F.log(stable_unit(number, seed + s * k + j)) / far)
            picks.append(F.min_by(F.struct("x", "y"), F.when(wait.isNotNull(), F.struct(wait.alias("w"), F.col("cell_id")))).alias(f"s{s}"))
        for mine, pick in zip(held, rows.agg(*picks).first(), strict=True):
            if pick is not None:
                mine.append((pick.x, pick.y))
    centres = [[(float(x), float(y)) for x, y in mine] for mine in held]
    if not centres[0]:
        return rows.select("cell_id", F.lit(0).alias("fold"))
    n_places = len(centres[0])  # as many in all starts: k, or as many as differ
    names = [(f"cx{i}_", f"cy{i}_") for i in range(n_places)]
    sums: dict[int, dict[int, tuple]] = {}
    for _ in range(rounds):
        table = spark.createDataFrame([(s, *(v for c in mine for v in c)) for s, mine in enumerate(centres)], "s int, " + ", ".join(f"{x} double, {y} double" for x, y in names))
        met, place = _nearest_centre(rows.crossJoin(F.broadcast(table)), [(F.col(x), F.col(y)) for x, y in names])
        met = met.groupBy("s", place.alias("c")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n"))
        sums = {s: {} for s in range(starts)}
        for r in met.collect():  # starts x k rows
            sums[r.s][r.c] = (r.x, r.y, r.n)
        new = [[(sums[s][i][0] / sums[s][i][2], sums[s][i][1] / sums[s][i][2]) if i in sums[s] else c for i, c in enumerate(mine)] for s, mine in enumerate(centres)]
        if new == centres:
            break
        centres = new
    tight = [sum(Fraction(x * x + y * y, n) for x, y, n in sums[s].values()) for s in range(starts)]  # the higher, the nearer points are to their centres
    best = sorted(centres[tight.index(max(tight))])
    near, fold = _nearest_centre(rows, [(F.lit(x), F.lit(y)) for x, y in best])
    return near.select("cell_id", fold.cast("int").alias("fold"))
