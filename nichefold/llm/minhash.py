"""Near-duplicate documents by DartMinHash signatures.

Signatures.  A text is the weighted set of hashes of its five-word shingles.  The plane over each element
(weight across, time up) is cut into cells; a hash of element and cell says how many darts fall into a cell (a Poisson count of its area) and where,
and a dart counts if it lands within the element's weight.  Each dart also draws one of COORDS coordinates, and a coordinate keeps
its earliest dart.  Cells are thrown in order of time until all coordinates are filled, so a text costs about
COORDS * ln(COORDS) darts whatever its length, and two texts agree on a coordinate with the probability of their weighted Jaccard similarity.

Join.  Coordinates are hashed in BANDS bands; texts that share a band meet in its bucket.  Equal texts are one node from the start.
A bucket with several nodes ties each to its hub (the least node, in one of four orders that differ by band), never all pairs.  A node is
first checked, exactly and on whole shingle sets, against the hub it shares most bands with; its other hubs only where they are
still in another component.  Buckets whose nodes aren't all connected then compare what stands apart with the rest, in blocks of bounded size: first by
whole signatures alone, which leaves the nodes that have a likely partner in another component, at most a row for each that came in; only
those get their shingle sets, are checked exactly in the same blocks, and one link for two components is reported.  A bucket that is crowded is dealt over
several tasks, by the hash of its nodes, before anything is joined to it.  So texts of similarity THRESHOLD or more are linked directly or through others, but for
pairs that share no band, (1 - 0.8^6)^42 or 3 in 10^6 at the threshold, or whose signatures agree in less than LIKELY, 1 in 10^8, and fewer above.
Components come from label propagation with pointer jumping on node tables; nothing but counts reaches the driver.

Defined cases: null text, or text without words, has no shingles and resembles nothing, itself included; texts of fewer than five words
are one shingle of all their words; texts of any length are read whole; rows of equal text are one class, with equal ids or not; ids are of any type that has an
order, and the least stands for its class; a null id is never the id of a class unless all ids of it are null; nodes are 64-bit hashes of texts; an empty
table gives an empty table; extra columns pass through ``keep_one`` whatever their names, and aren't read by ``near_classes``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import free_name, give_back, materialise, ship

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 42, 6
COORDS = BANDS * ROWS
#: Signature agreement below which a pair isn't looked at: six standard errors under the threshold.
LIKELY = 0.65
#: Rows of a bucket that meet in one task at a time, and that one task reads of it.
BLOCK, SPAN = 250, 250
#: Orders of nodes, by the band's number: a node's rank is its bits flipped by one of these.
ORDERS = (0, 0x5DEECE66D1CE4E5B, -0x61C8864680B583EB, 0x1B873593CC9E2D51)
FIRST_CELL = -12
WORDS_KEPT = 200_000


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Words(dict):
    """Hashes of words seen so far."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = Words()


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word windows, in order, repeats included."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=n)
    size = min(size, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - size + 1 + i]
    return mix(out)


@cache
def _poisson(area: float) -> np.ndarray:
    """The distribution function of a Poisson count, as far as doubles tell."""
    import math

    top = int(area + 12 * math.sqrt(area) + 24)
    k = np.arange(top)
    logs = k * math.log(area) - area - np.cumsum(np.log(np.maximum(k, 1)))
    return np.cumsum(np.exp(logs))


def _cell(k: int) -> tuple[float, float]:
    """Bounds in time of the k-th cell: doubling, from [0, 2^FIRST_CELL)."""
    return (0.0 if k == 0 else 2.0 ** (FIRST_CELL + k - 1)), 2.0 ** (FIRST_CELL + k)


def signatures(elements: np.ndarray, owner: np.ndarray, n: int, weights: np.ndarray | None = None, coords: int = COORDS) -> np.ndarray:
    """The earliest dart of each coordinate for n weighted sets, as its time; owner says whose each element is.

    Every set needs an element of positive weight.  Weights are 1 where none are given.
    """
    best = np.full((n, coords), np.inf)
    flat = best.ravel()
    active = np.zeros(n, dtype=bool)
    active[owner] = True
    mass = np.bincount(owner, weights=weights, minlength=n)
    for k in range(64 - FIRST_CELL):
        low, high = _cell(k)
        if not active.any():
            break
        on = active[owner]
        e, o = elements[on], owner[on]
        w = None if weights is None else weights[on]
        nu, left, right = 0, 0.0, 1.0
        while len(e):
            rows = np.arange(len(e)) if w is None else np.flatnonzero(w > left)
            if not len(rows):
                break
            cdf = _poisson((right - left) * (high - low))
            cell = np.uint64((nu << 8 | k) * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
            h = mix(e[rows] ^ cell)
            count = np.searchsorted(cdf, _unit(h), side="right")
            thrown = np.repeat(np.arange(len(rows)), count)
            if len(thrown):
                nth = (np.arange(len(thrown)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
                dart = mix(h[thrown] + (nth + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
                time = low + (high - low) * _unit(dart)
                place = mix(dart ^ np.uint64(0xA0761D6478BD642F))
                if w is not None:
                    inside = left + (right - left) * _unit(mix(place)) < w[rows][thrown]
                    thrown, time, place = thrown[inside], time[inside], place[inside]
                at = o[rows][thrown] * coords + (place % np.uint64(coords)).astype(np.int64)
                np.minimum.at(flat, at, time)
            if w is None:
                break
            nu, left, right = nu + 1, right, 2 * right
        expected = mass * high / coords
        may = active & (expected > 2)
        if may.any():
            ids = np.flatnonzero(may)
            active[ids[np.isfinite(best[ids]).all(axis=1)]] = False
    return best


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    bits = mix(sig.view(np.uint64)).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def short(sig: np.ndarray) -> np.ndarray:
    """32 bits of each coordinate: enough to tell whether two agree."""
    return (mix(sig.view(np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sign(batches):
    import pyarrow as pa

    def emit(ids, nodes, sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sig = signatures(np.concatenate(sets), owner, len(sets))
        keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(sig).ravel()), BANDS).cast(pa.list_(pa.int64()))
        return pa.record_batch([pa.array(ids), pa.array(nodes, pa.int64()), keys], names=["id", "node", "bands"])

    for b in batches:
        id_type = b.schema.field(0).type
        ids, nodes, sets, held = [], [], [], 0
        for i, node, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
            s = np.unique(shingles(text.as_py()))
            if not len(s):
                continue
            ids.append(i.as_py())
            nodes.append(node)
            sets.append(s)
            held += len(s)
            if held > 60_000 or len(sets) >= 200:
                yield emit(pa.array(ids, id_type), nodes, sets)
                ids, nodes, sets, held = [], [], [], 0
        if sets:
            yield emit(pa.array(ids, id_type), nodes, sets)
        give_back()


def _shingle_sets(batches):
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, 200):
            sets = [np.unique(shingles(x.as_py())) for x in b.column(1)[at : at + 200]]
            sig = short(signatures(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets)))
            yield pa.record_batch([b.column(0)[at : at + 200], pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([len(x) for x in sets], pa.int32())], names=["node", "s", "sig", "size"])
        give_back()


def similar(a: bytes, b: bytes, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted shingle sets have at least that Jaccard similarity."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    small, large = sorted((len(x), len(y)))
    if small < threshold * large - 1e-9:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _check(batches):
    import pyarrow as pa

    for b in batches:
        ok = [similar(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3), strict=True)]
        yield pa.record_batch([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])
        give_back()


def _order(band: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ORDERS]), (band % len(ORDERS) + 1).cast("int"))


class NearDuplicates:
    """The steps of the join over a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        spark = docs.sparkSession
        ship(spark)
        id_type = docs.schema[id_col].dataType.simpleString()
        self.body = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("node"), F.col(text_col).cast("binary").alias("text"))
        self.signed = materialise(self.body.mapInArrow(_sign, f"id {id_type}, node long, bands array<long>"), "signed")
        self.nodes = materialise(self.signed.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")

    def banded(self) -> DataFrame:
        """(key, band, node): a row for each band of each different text."""
        one = self.signed.select("node", "bands").distinct()
        return one.select("node", F.posexplode("bands").alias("band", "key"))

    def hubs(self) -> tuple[DataFrame, DataFrame]:
        """The nodes of buckets that hold several (key, band, node, hub), and in how many bands a node has a hub (node, hub, shared)."""
        rows = self.banded().withColumn("r", F.col("node").bitwiseXOR(_order(F.col("band"))))
        buckets = rows.groupBy("key", "band").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
        buckets = materialise(buckets.select("key", F.col("band").alias("at"), F.col("lo").bitwiseXOR(_order(F.col("band"))).alias("hub"), "n"), "buckets")
        members = materialise(self.dealt(self.banded(), buckets).filter("band = at").select("key", "band", "node", "hub"), "members")
        ties = members.filter("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
        return members, materialise(ties, "ties")

    @staticmethod
    def as_pairs(ties: DataFrame) -> DataFrame:
        return ties.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    def shingle_sets(self, nodes: DataFrame) -> DataFrame:
        """(node, s, sig, size): shingle sets and signatures of these nodes; texts move once, and one row stands for all copies of a text."""
        chosen = nodes.join(self.nodes.select("node", F.col("id").alias("first")), "node")
        rows = self.body.join(chosen, (self.body["node"] == chosen["node"]) & self.body["id"].eqNullSafe(chosen["first"]), "left_semi")
        return materialise(rows.select("node", "text").mapInArrow(_shingle_sets, "node long, s binary, sig binary, size int").dropDuplicates(["node"]), "shingle-sets")

    @staticmethod
    def links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts are similar, by their whole shingle sets."""
        plain = sets.select("node", "s")
        left = pairs.join(plain.toDF("a", "sa"), "a")
        both = left.join(plain.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
        return materialise(both.mapInArrow(_check, "a long, b long"), "links")

    @staticmethod
    def components(links: DataFrame) -> DataFrame:
        """(node, label): the least node of its component for every node that has a link."""
        both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
        while True:
            heard = both.join(labels.toDF("b", "label"), "b").groupBy("a").agg(F.min("label").alias("heard"))
            near = labels.join(heard.toDF("node", "heard"), "node").select("node", "label", F.least("label", "heard").alias("next"))
            jump = labels.toDF("next", "far")
            step = near.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("moved"))
            done = materialise(step, "labels")
            labels = done.select("node", F.col("next").alias("label"))
            if done.filter("moved").isEmpty():
                return labels

    @staticmethod
    def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose nodes are in different components; a node without a link is its own."""
        named = lambda c: labels.toDF(c, f"l{c}")
        rows = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
        return rows.filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")

    @staticmethod
    def dealt(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """rows (key, node, ..) joined to one row a bucket (key, n, ..) by key; a crowded bucket's rows over several tasks, by their nodes."""
        parts, one = F.ceil(F.col("n") / SPAN).cast("long"), F.lit(1).cast("long")
        crowded = materialise(buckets.filter(F.col("n") > SPAN).select("key", parts.alias("parts")), "crowded")  # joined as its size tells
        left = rows.join(crowded, "key", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", one))).drop("parts")
        right = buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > SPAN, parts).otherwise(one) - 1)))
        return left.join(right, ["key", "part"]).drop("part")

    @classmethod
    def open_links(cls, members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (a, b) across components within buckets, one for two components and block.

        A bucket's nodes of the least label, most of a large group, don't meet each other: the others, in blocks, meet all nodes, in blocks.
        """
        rows = members.select("key", "band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = materialise(rows, "bucket-labels")
        by_label = rows.groupBy("key", "label").agg(F.count("*").alias("c"))
        whole = by_label.groupBy("key").agg(F.min("label").alias("lo"), F.min_by("c", "label").alias("own"), F.sum("c").alias("n")).filter("own < n")
        whole = materialise(whole.select("key", "lo", "n", (F.col("n") - F.col("own")).alias("m")), "split-buckets")
        blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        place = lambda c: F.pmod(F.xxhash64("node"), F.col(c).cast("long")).cast("int")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = cls.dealt(rows, whole).select("key", "band", "node", "label", "lo", blocks("n").alias("nb"), blocks("m").alias("mb"))
        rows = materialise(rows, "open-buckets")
        apart = rows.filter("label <> lo").select("key", "band", place("mb").alias("i"), each("nb").alias("j"), F.lit(0).alias("side"), "node", "label")
        rest = rows.select("key", "band", each("mb").alias("i"), place("nb").alias("j"), F.lit(1).alias("side"), "node", "label")
        order = ["key", "i", "j"]
        met = apart.unionByName(rest)
        signed = met.join(sets.select("node", "sig", "size"), "node").select(*order, "band", "side", "node", "label", "sig", "size")
        kind = "key long, i int, j int, band int, side int, node long, label long"
        likely = materialise(signed.repartition(*order).sortWithinPartitions(*order).mapInArrow(_likely_nodes, kind), "likely-nodes")
        full = likely.join(sets, "node").select(*order, "band", "side", "node", "label", "sig", "s")
        found = full.repartition(*order).sortWithinPartitions(*order).mapInArrow(_cross_links, "a long, b long")
        return materialise(found.distinct(), "open-links")

    def classes(self) -> DataFrame:
        """(node, id, copies, label): every different text with its least id, its number of rows and its component."""
        members, ties = self.hubs()
        best = ties.groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("m")).select("node", F.col("m.hub").alias("hub"))
        pairs = materialise(self.as_pairs(best), "best-pairs")
        sets = self.shingle_sets(members.select("node").distinct())
        links = self.links(pairs, sets)
        labels = self.components(links)
        rest = materialise(self.across(self.as_pairs(ties), labels).join(pairs, ["a", "b"], "left_anti"), "other-pairs")
        for more in (lambda: self.links(rest, sets), lambda: self.open_links(members, labels, sets)):
            found = more()
            if not found.isEmpty():
                links = links.unionByName(found)
                labels = self.components(links)
        return self.nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _likely(band: int, left: list, right: list, sizes: np.ndarray):
    """For each row (node, label, signature, ..) of the left, the rows of the right that may be similar and are in another component.

    A pair that shares an earlier band is left to that band's bucket.
    """
    lb = np.array([r[1] for r in right])
    sb = np.frombuffer(b"".join(r[2] for r in right), dtype=np.uint32).reshape(len(right), COORDS)
    for row, size in left:
        near = np.flatnonzero((lb != row[1]) & (np.minimum(sizes, size) >= THRESHOLD * np.maximum(sizes, size) - 1e-9))
        if not len(near):
            continue
        same = sb[near] == np.frombuffer(row[2], dtype=np.uint32)
        near, same = (x[np.count_nonzero(same, axis=1) >= LIKELY * COORDS] for x in (near, same))
        if len(near):
            near = near[same.reshape(len(near), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
        if len(near):
            yield row, near


def _with_partners(band: int, sides: tuple[list, list]):
    """The rows (node, label, signature, size) of the two sides that have a likely partner on the other, as (side, node, label)."""
    if not sides[0] or not sides[1]:
        return
    met = np.zeros(len(sides[1]), dtype=bool)
    for row, near in _likely(band, [(r, r[3]) for r in sides[0]], sides[1], np.array([r[3] for r in sides[1]])):
        met[near] = True
        yield 0, row[0], row[1]
    for i in np.flatnonzero(met):
        yield 1, sides[1][i][0], sides[1][i][1]


def _compare(band: int, sides: tuple[list, list]):
    """Links between rows (node, label, signature, set) of the two sides, one for two labels."""
    if not sides[0] or not sides[1]:
        return
    sets = [np.frombuffer(r[3], dtype=np.uint64) for r in sides[1]]
    sizes = np.array([len(x) for x in sets])
    linked: set[tuple[int, int]] = set()
    for row, near in _likely(band, [(r, len(r[3]) // 8) for r in sides[0]], sides[1], sizes):
        mine = np.frombuffer(row[3], dtype=np.uint64)
        every = np.concatenate([sets[j] for j in near])
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        both = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes[near]) - sizes[near])
        for j in near[both >= THRESHOLD * (len(mine) + sizes[near] - both) - 1e-9]:
            other = sides[1][j]
            two = (min(row[1], other[1]), max(row[1], other[1]))
            if two not in linked:
                linked.add(two)
                yield min(row[0], other[0]), max(row[0], other[0])


def _by_block(batches):
    """(key, i, j), band and the two sides of each block pair; rows come sorted by it."""
    group, now, sides = None, 0, ([], [])
    for part in (b.slice(at, BLOCK) for b in batches for at in range(0, b.num_rows, BLOCK)):
        for key, i, j, band, side, *row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if (key, i, j) != group:
                if group is not None:
                    yield group, now, sides
                group, now, sides = (key, i, j), band, ([], [])
            sides[side].append(row)
    if group is not None:
        yield group, now, sides
    give_back()


def _likely_nodes(batches):
    import pyarrow as pa

    names, kinds = ["key", "i", "j", "band", "side", "node", "label"], [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    out: list = []
    emit = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    for group, band, sides in _by_block(batches):
        out += [(*group, band, *x) for x in _with_partners(band, sides)]
        if len(out) > 10_000:
            yield emit()
            out = []
    if out:
        yield emit()


def _cross_links(batches):
    """Links across components of each block pair."""
    import pyarrow as pa

    for _, band, sides in _by_block(batches):
        found = np.array(list(_compare(band, sides)), dtype=np.int64).reshape(-1, 2)
        if len(found):
            yield pa.record_batch([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) for every row: the least id of its class of near duplicates, and the rows in the class."""
    join = NearDuplicates(docs, id_col, text_col)
    nodes = join.classes()
    whole = nodes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = materialise(nodes.join(whole, "label").select("node", "class_id", "class_size"), "classes")
    rows = docs.select(F.col(id_col), F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text_col)).alias("node"))
    out = rows.join(by_node, "node", "left")
    return out.select(id_col, F.coalesce("class_id", id_col).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each class the document of the least id stays, with its columns as they are.

    Of several rows with that id and class, one stays.  Rows without words stay.
    """
    join = NearDuplicates(docs, id_col, text_col)
    nodes = join.classes()
    whole = nodes.groupBy("label").agg(F.min("id").alias("class_id"), F.min_by("node", F.struct("id", "node")).alias("node"))
    node, keep = free_name(docs, "node_"), free_name(docs, "keep_")
    kept = materialise(whole.select(F.col("node").alias(node), F.col("class_id").alias(keep)), "kept")
    rows = docs.withColumn(node, F.when(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text_col)))
    empty = rows.filter(F.col(node).isNull()).drop(node)
    stay = rows.join(kept, node).filter(F.col(id_col).eqNullSafe(F.col(keep))).drop(keep)
    return stay.dropDuplicates([node]).select(*docs.columns).unionByName(empty)
