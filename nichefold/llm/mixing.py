"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to.  A small flow
network routes each pattern's words to the quotas of its sources; using a pattern once is free, each
further pass costs more than the last, so repeats arise only where a quota needs them and are spread
evenly.  A pattern's flow then says how many full passes its documents get and how many words of one more.

The part of a pass is filled with documents in order of a seeded hash.  Large documents are
settled first and small ones, a quarter of the pattern's words, then make up what whole large documents
leave over; so a mix is off by about half a small document.  Where the order is cut is found by narrowing hash
prefixes with counts on the cluster: per round, at most 64 sums a pattern and size group reach the driver.  The result
is a tiny table of cuts, and a document's copies follow from its own pattern, size and hash alone.

Bounds: sources and the patterns that occur are a catalogue, of which the driver holds a row each and a row for each size class (at most 64 a
pattern); what is broadcast is no larger.  More than MOST_PATTERNS patterns are refused rather than mixed wrongly.  Defined cases: null text or no words is
size 0, takes 0; texts of any length are read whole; the null source is a source; rows with equal ids get equal decisions, other ties of the seeded hash
fall together; repeated rows count as often as they occur; an empty table gives an empty mix; extra columns pass through, whatever their names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nichefold.llm.common import SPACE_CLASS, free_name, materialise

WEIGHTS = (5, 2, 1)
MAX_PASSES = 3
#: Marginal costs of a document's first, second and third pass.
PASS_COSTS = (0, 1, 3)
SEED = 20260131
BITS, ROUND_BITS = 60, 6
SMALL_SHARE = 0.25
MOST_PATTERNS = 50_000


def word_count(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE_CLASS), "")), F.lit(0)).cast("long")


def weights_of(sources: list[str | None], cycle: tuple[int, ...] = WEIGHTS) -> dict[str | None, int]:
    """The cycle of weights over sources in code point order, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def share_out(sizes: dict, weights: dict, passes: int = MAX_PASSES) -> dict:
    """Targets by weight that add up to all sizes, each at most ``passes`` times its source's size.

    What a source can't take is shared again among those below their limit, by weight, until none is above.
    """
    targets = dict.fromkeys(sizes, 0.0)
    full: set = set()
    while True:
        rest = float(sum(sizes.values())) - sum(passes * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        total = sum(weights[s] for s in open_)
        targets.update({s: rest * weights[s] / total for s in open_} if total else {})
        above = {s for s in open_ if targets[s] > passes * sizes[s]}
        targets.update({s: float(passes * sizes[s]) for s in above})
        if not above:
            return targets
        full |= above


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flows on arcs (from, to, capacity, cost >= 0) of a maximal flow of least cost, by shortest augmenting paths with potentials."""
    to, cap, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, k, p in ((a, b, c, w), (b, a, 0, -w)):
            out[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(p)
    height = [0] * n
    while True:
        far, via, heap = [None] * n, [-1] * n, [(0, source)]
        far[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in out[x]:
                y = to[e]
                if cap[e] > 0 and (far[y] is None or d + cost[e] + height[x] - height[y] < far[y]):
                    far[y] = d + cost[e] + height[x] - height[y]
                    via[y] = e
                    heapq.heappush(heap, (far[y], y))
        if far[sink] is None:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        height = [h + (f if f is not None else 0) for h, f in zip(height, far, strict=True)]
        room, x = None, sink
        while x != source:
            e = via[x]
            room = cap[e] if room is None else min(room, cap[e])
            x = to[e ^ 1]
        x = sink
        while x != source:
            e = via[x]
            cap[e] -= room
            cap[e ^ 1] += room
            x = to[e ^ 1]


def route(capacity: dict[tuple, int], quotas: dict, costs: tuple[int, ...] = PASS_COSTS) -> dict[tuple, int]:
    """Words to take from each pattern: the flow from patterns, used up to len(costs) times, to the quotas of their sources."""
    patterns, sources = list(capacity), list(quotas)
    first = {s: 2 + len(patterns) + i for i, s in enumerate(sources)}
    arcs = [(0, 2 + i, capacity[p], c) for i, p in enumerate(patterns) for c in costs]
    arcs += [(2 + i, first[s], len(costs) * capacity[p], 0) for i, p in enumerate(patterns) for s in p]
    arcs += [(first[s], 1, round(quotas[s]), 0) for s in sources]
    flow = min_cost_flow(2 + len(patterns) + len(sources), arcs, 0, 1)
    return {p: sum(flow[i * len(costs) : (i + 1) * len(costs)]) for i, p in enumerate(patterns)}


@dataclass
class Cut:
    """What a size group of a pattern gets: ``passes`` full passes and one more for hashes up to ``last``."""

    pattern: tuple
    upto: int | None  # sizes of the small group end here; None for the large group
    passes: int
    last: int  # -1: none


def _cuts(items: DataFrame, wanted: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """Where the hash order of each (pattern number p, group g) is cut so that the words before come nearest to wanted.

    items: p int, g int, u long (BITS bits), size long.  Returns (last hash that is in, words that are in).
    """
    state = {k: [0, 0, w] for k, w in wanted.items() if w > 0}  # prefix, words before it, wanted
    done: dict[tuple[int, int], tuple[int, int]] = {k: (-1, 0) for k, w in wanted.items() if w <= 0}
    spark, shift = items.sparkSession, BITS
    while state:
        shift -= ROUND_BITS
        here = F.broadcast(spark.createDataFrame([(*k, v[0]) for k, v in state.items()], "p int, g int, prefix long"))
        inside = items.join(here, ["p", "g"]).filter(F.shiftright("u", shift + ROUND_BITS) == F.col("prefix"))
        sums: dict = {}
        for r in inside.groupBy("p", "g", F.shiftright("u", shift).alias("b")).agg(F.sum("size").alias("s"), F.min("u").alias("lo"), F.max("u").alias("hi")).collect():
            sums.setdefault((r.p, r.g), []).append((r.b, r.s, r.lo, r.hi))
        for k in list(state):
            _, before, want = state[k]
            last = -1 if before == 0 and k not in done else done.get(k, (-1, 0))[0]
            for b, s, lo, hi in sorted(sums.get(k, [])):
                if before + s <= want:
                    before, last = before + s, hi
                    continue
                if lo == hi:  # one hash: in if that comes nearer
                    if before + s - want < want - before:
                        before, last = before + s, hi
                    done[k] = (last, before)
                    del state[k]
                else:
                    state[k] = [b, before, want]
                    done[k] = (last, before)
                break
            else:
                done[k] = (last, before)
                del state[k]
    return done


class Mix:
    """A mix of docs over sources.

    memberships: a column, array of the sources a row belongs to (deduplicated and sorted).  quotas: words wanted of each source,
    made from {source: words} by ``quotas_of``.
    """

    def __init__(self, docs: DataFrame, members: Column, id_col: str, text_col: str, quotas_of, seed: int = SEED):
        self.seed, self.id_col, self.text_col, self.members = seed, id_col, text_col, members
        self.sizes = materialise(docs.select(F.col(id_col).alias("id"), members.alias("m"), word_count(F.col(text_col)).alias("size")), "sizes")
        kinds = materialise(self.sizes.groupBy("m", self._log("size").alias("c")).agg(F.sum("size").alias("s"), F.count("*").alias("n")), "patterns")
        if (n := kinds.select("m").distinct().count()) > MOST_PATTERNS:
            raise ValueError(f"{n} patterns of sources are no catalogue; group sources first")
        found = kinds.collect()
        self.capacity: dict[tuple, int] = {}
        classes: dict[tuple, dict[int, int]] = {}
        self.source_size: dict = {}
        for r in found:
            p = tuple(r.m)
            self.capacity[p] = self.capacity.get(p, 0) + r.s
            classes.setdefault(p, {})[r.c] = r.s
            for s in p:
                self.source_size[s] = self.source_size.get(s, 0) + r.s
        self.quotas = quotas_of(self.source_size)
        self.flow = route(self.capacity, self.quotas)
        self.cuts = self._find_cuts(classes)

    @staticmethod
    def _log(size: Column | str) -> Column:
        """Bits of a size: the size class of a document."""
        return F.length(F.bin(F.col(size) if isinstance(size, str) else size))

    def _u(self, id_: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), id_), 64 - BITS)

    def _find_cuts(self, classes: dict) -> list[Cut]:
        spark = self.sizes.sparkSession
        patterns = sorted(self.capacity, key=repr)
        if not patterns:
            return []
        upto, part, passes, small = {}, {}, {}, {}
        for i, p in enumerate(patterns):
            c, f = self.capacity[p], self.flow[p]
            passes[i], part[i] = divmod(f, c) if c else (0, 0)
            run = 0
            for k in sorted(classes[p]):
                run += classes[p][k]
                upto[i], small[i] = k, run
                if run >= SMALL_SHARE * c:
                    break
        names = spark.createDataFrame([(list(p), i, upto[i]) for i, p in enumerate(patterns)], "m array<string>, p int, upto int")
        items = self.sizes.join(F.broadcast(names), self.sizes["m"].eqNullSafe(names["m"]))
        items = materialise(items.select("p", F.when(self._log("size") <= F.col("upto"), 0).otherwise(1).alias("g"), self._u(F.col("id")).alias("u"), "size").filter("size > 0"), "mix-items")
        large = _cuts(items, {(i, 1): round(part[i] * (1 - small[i] / self.capacity[p])) if self.capacity[p] else 0 for i, p in enumerate(patterns)})
        rest = _cuts(items, {(i, 0): min(small[i], part[i] - large[i, 1][1]) for i in range(len(patterns))})
        return [Cut(p, upto[i] if g == 0 else None, passes[i], (rest if g == 0 else large)[i, g][0]) for i, p in enumerate(patterns) for g in (0, 1)]

    def copies(self, docs: DataFrame, name: str, size: Column | None = None) -> DataFrame:
        """docs with the number of times each row is taken as column ``name``."""
        spark = docs.sparkSession
        m, n, cut = free_name(docs, "m_"), free_name(docs, "n_"), free_name(docs, "cut_")
        rows: dict[tuple, list] = {}
        for c in self.cuts:
            rows.setdefault(c.pattern, [None, None])[0 if c.upto is not None else 1] = c
        table = spark.createDataFrame([(list(p), a.upto, a.passes, a.last, b.last) for p, (a, b) in rows.items()], f"`{m}` array<string>, upto int, passes int, small long, large long")
        table = table.select(m, F.struct("upto", "passes", "small", "large").alias(cut))
        rows_ = docs.withColumn(m, self.members).withColumn(n, word_count(F.col(self.text_col)) if size is None else size)
        joined = rows_.join(F.broadcast(table.withColumnRenamed(m, f"{m}k")), F.col(m).eqNullSafe(F.col(f"{m}k")), "left")
        last = F.when(self._log(n) <= F.col(f"{cut}.upto"), F.col(f"{cut}.small")).otherwise(F.col(f"{cut}.large"))
        times = F.when((F.col(n) > 0) & F.col(cut).isNotNull(), F.col(f"{cut}.passes") + (self._u(F.col(self.id_col)) <= last).cast("int")).otherwise(0)
        return joined.withColumn(name, times).select(*docs.columns, name)


def weighted_targets(sizes: dict) -> dict:
    """The corpus's quotas: weights 5, 2, 1 over its sources, 100% of all words, at most three passes."""
    return share_out(sizes, weights_of(list(sizes))) if sizes else {}


def one_source(source: str = "source") -> Column:
    return F.array(F.col(source).cast("string"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs that the weighted mix takes, a row for each copy, with their columns as they are."""
    mix = Mix(docs, one_source(source_col), id_col, text_col, weighted_targets)
    n = free_name(docs, "copies")
    return mix.copies(docs, n).filter(F.col(n) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
