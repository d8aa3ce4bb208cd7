"""Communities of a weighted graph that lies in an edge table: weights of neighbour graphs, modularity, and the Leiden method in rounds of joins.

Weights are whole numbers, so gains are exact and no result depends on order or partitioning.  A level moves nodes to neighbouring communities while that gains,
refines each community into well connected parts grown from single nodes, and contracts the parts to the nodes of the next level, which starts from the communities.

All nodes of a round choose their best move at once.  A community is left or joined in a round, as the best of the moves that touch it says, but not both, so no move
loses what it goes towards; and each counts on the worst that the others of its source and target can do.  Where this lets none pass, moves that share no
community are taken.  Either way the sum of gains is a lower bound of what the round gains, so modularity never falls.  A level ends when few nodes would move;
the last one, which contracts no further, when none would.

Defined cases: nodes are whole numbers; an edge may be given in either direction, and more than once, and its weights add up; edges of no or negative weight are left out; a node's edge to itself counts for its
size; ties go to the smaller community and node; a graph without edges has no communities.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nichefold.sources.stage import stage

#: Steps of a bisection; weights a unit of fuzzy membership.
STEPS, UNIT = 64, 1 << 20
#: A level ends early, to be taken up by the next one, when fewer than one in so many nodes would move.
REST = 50


# ---- weights of a neighbour graph ----


def memberships(near: DataFrame, k: int, item: str = "item_id", nbr: str = "nbr_id", d2: str = "d2") -> DataFrame:
    """(item, nbr, w): how much each neighbour belongs to an item's surroundings: 1 up to the nearest that isn't a copy, and falling so that all add up to log2(k).

    k counts the item itself.  The scale of each item is found by STEPS bisections.
    """
    lists = near.groupBy(item).agg(F.sort_array(F.collect_list(F.struct(F.sqrt(d2).alias("d"), F.col(nbr).alias("n")))).alias("s"))  # k - 1 of each
    ds = lists.select(item, "s", F.transform("s", lambda x: x["d"]).alias("ds"))
    rho = F.coalesce(F.get(F.filter("ds", lambda d: d > 0), F.lit(0)), F.lit(0.0))
    ds = ds.withColumn("over", F.transform("ds", lambda d: F.greatest(d - rho, F.lit(0.0))))
    total = lambda sigma: F.aggregate("over", F.lit(0.0), lambda a, o: a + F.exp(-o / sigma))
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(math.inf).alias("hi"), F.lit(1.0).alias("mid"))

    def step(a: Column, _: Column) -> Column:
        high = total(a["mid"]) > math.log2(k)
        lo, hi = F.when(high, a["lo"]).otherwise(a["mid"]), F.when(high, a["mid"]).otherwise(a["hi"])
        mid = F.when(high, (a["lo"] + a["mid"]) / 2).when(a["hi"] == math.inf, a["mid"] * 2).otherwise((a["mid"] + a["hi"]) / 2)
        return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"))

    mean = F.aggregate("ds", F.lit(0.0), lambda a, d: a + d) / F.size("ds")
    sigma = F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["mid"], mean * 1e-3)
    each = ds.withColumn("sigma", sigma).select(item, F.explode(F.arrays_zip("s", "over")).alias("e"), "sigma")
    return each.select(item, F.col("e.s.n").alias(nbr), F.when(F.col("e.over") > 0, F.exp(-F.col("e.over") / F.col("sigma"))).otherwise(1.0).alias("w"))


def fuzzy_union(members: DataFrame, item: str = "item_id", nbr: str = "nbr_id") -> DataFrame:
    """(src, dst, w): the weight a + b - ab of each pair, src before dst, of which one or both belong to the other's surroundings."""
    pair = members.groupBy(F.least(item, nbr).alias("src"), F.greatest(item, nbr).alias("dst")).agg(F.sum("w").alias("s"), F.when(F.count("*") == 2, F.min("w") * F.max("w")).otherwise(0.0).alias("p"))
    return pair.select("src", "dst", (F.col("s") - F.col("p")).alias("w"))


def whole_weights(edges: DataFrame) -> DataFrame:
    """edges with weights as whole numbers of UNIT."""
    return edges.select("src", "dst", F.round(F.col("w") * UNIT).cast("long").alias("w"))


# ---- modularity ----


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row q: the share of weight within communities less what sizes alone would give.  communities: node, community."""
    c = communities.select(F.col("node"), "community")
    ends = edges.join(c.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    within = ends.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("m"))
    sizes = ends.select(F.explode(F.array("a", "b")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("k"))
    spread = sizes.agg(F.sum(F.col("k").cast("double") * F.col("k")).alias("kk"))
    m = F.col("m").cast("double")
    return within.crossJoin(spread).select((F.col("inside") / m - F.lit(float(resolution)) * F.col("kk") / (4 * m * m)).alias("q"))


# ---- Leiden ----


#: Types of products' factors: sums over the graph, and weights of a node.
TOTAL, FACTOR = "decimal(20,0)", "decimal(17,0)"


def big(x: int) -> Column:
    return F.lit(str(x)).cast(TOTAL)


@dataclass
class Graph:
    """nodes: i, k (its weight, ends of edges to itself included), c (its community).  links: i, j, w in both directions, without edges to itself."""

    nodes: DataFrame
    links: DataFrame
    total: int  # of all k
    gamma: Fraction

    def gain(self, to: Column, own: Column, k: Column, size: Column, own_size: Column) -> Column:
        """Half of what leaving a community for another adds to total x weight within - gamma x squared sizes, in whole numbers."""
        return big(self.gamma.denominator * self.total) * (to - own).cast(FACTOR) - (self.gamma.numerator * k).cast(FACTOR) * (size - own_size + k).cast(TOTAL)


def graph_of(edges: DataFrame, resolution: float) -> Graph:
    rows = edges.filter("w > 0").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").cast("long").alias("w"))
    rows = stage(rows, "edges")
    links = stage(rows.filter("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("e"), "w").select("e.i", "e.j", "w"), "links")
    ends = rows.select(F.explode(F.array("a", "b")).alias("i"), "w")
    nodes = stage(ends.groupBy("i").agg(F.sum("w").alias("k")).withColumn("c", F.col("i")), "nodes")
    return Graph(nodes, links, nodes.agg(F.sum("k")).first()[0] or 0, Fraction(resolution).limit_denominator(1000))


def _sized(nodes: DataFrame, c: str) -> DataFrame:
    """nodes with size and n: the weight and number of nodes in their community of column c."""
    nodes = nodes.drop("size", "n")
    return nodes.join(nodes.groupBy(c).agg(F.sum("k").alias("size"), F.count("*").alias("n")), c)


def _proposals(g: Graph, c: str, within: str | None) -> DataFrame:
    """(i, k, a, b, gain) of nodes that gain by going from community a to b, their best one.

    within: only nodes that are alone move, only to communities inside the same one of that column, and both are well connected: their weight with the rest
    of that one is what sizes alone would give, or more.
    """
    whose = [F.col(within).alias("whose")] if within else []
    there = g.nodes.select(F.col("i").alias("j"), F.col(c).alias("to"), F.col("size").alias("to_size"), *whose)
    me = g.nodes.select("i", "k", F.col(c).alias("a"), F.col("size").alias("own_size"), "n", *([F.col(within).alias("mine"), "whole"] if within else []))
    # links are shuffled by node once, for their sums and all that follows
    met = g.links.join(there, "j").repartition("i").groupBy("i", "to").agg(F.sum("w").alias("w"), F.first("to_size").alias("to_size"), *([F.first("whose").alias("whose")] if within else []))
    rows = met.join(me, "i")
    if within:
        rows = rows.filter("whose = mine").withColumn("own", F.lit(0).cast("long"))
        enough = big(g.gamma.denominator * g.total) * F.col("out").cast(FACTOR) >= (g.gamma.numerator * F.col("own_size")).cast(FACTOR) * (F.col("whole") - F.col("own_size")).cast(TOTAL)
        fit = rows.filter("to <> a").groupBy("a").agg(F.sum("w").alias("out"), F.first("own_size").alias("own_size"), F.first("whole").alias("whole")).filter(enough).select("a")
        rows = rows.filter("n = 1").join(fit, "a", "left_semi").join(fit.withColumnRenamed("a", "to"), "to", "left_semi")
    else:
        rows = rows.withColumn("own", F.coalesce(F.sum(F.when(F.col("to") == F.col("a"), F.col("w"))).over(Window.partitionBy("i")), F.lit(0)))
    rows = rows.filter("to <> a").withColumn("gain", g.gain(F.col("w"), F.col("own"), F.col("k"), F.col("to_size"), F.col("own_size"))).filter("gain > 0")
    best = rows.groupBy("i").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to")).alias("best"), F.first("k").alias("k"), F.first("a").alias("a"))
    return best.select("i", "k", "a", F.col("best.to").alias("b"), (-F.col("best.loss")).alias("gain"))


def _safe(g: Graph, moves: DataFrame) -> DataFrame:
    """(i, b): moves from communities whose best move leaves to communities whose best move comes, which gain whatever the others of their source and target do."""
    rank = F.struct((-F.col("gain")).alias("loss"), F.col("i").alias("who"))
    zero = F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("a").alias("t"), F.lit(True).alias("leaves"), F.col("k").alias("out"), zero.alias("into")), F.struct(F.col("b").alias("t"), F.lit(False).alias("leaves"), zero.alias("out"), F.col("k").alias("into")))
    sides = moves.select(rank.alias("r"), F.explode(ends).alias("e")).groupBy("e.t").agg(F.min_by("e.leaves", F.struct("r", "e.leaves")).alias("leaves"), F.sum("e.out").alias("out"), F.sum("e.into").alias("into"))
    rows = moves.join(sides.filter("leaves").select(F.col("t").alias("a"), "out"), "a").join(sides.filter("NOT leaves").select(F.col("t").alias("b"), "into"), "b")
    return rows.filter(2 * F.col("gain") > (g.gamma.numerator * F.col("k")).cast(FACTOR) * (F.col("into") + F.col("out") - 2 * F.col("k")).cast(TOTAL)).select("i", "b")


def _alone(moves: DataFrame) -> DataFrame:
    """(i, b): the moves that are best, ties to the smaller node, of all that touch their two communities."""
    rank = F.struct((-F.col("gain")).alias("loss"), F.col("i").alias("who"))
    top = moves.select(F.explode(F.array("a", "b")).alias("t"), rank.alias("r")).groupBy("t").agg(F.min("r").alias("r")).select("t", "r.who")
    rows = moves.join(top.select(F.col("t").alias("a"), F.col("who").alias("x")), "a").join(top.select(F.col("t").alias("b"), F.col("who").alias("y")), "b")
    return rows.filter("x = i AND y = i").select("i", "b")


def _rounds(g: Graph, c: str, within: str | None = None, rest: int = 0) -> int:
    """Moves nodes between the communities of column c until no more than rest of them gain by a move; the number of rounds."""
    g.nodes = stage(_sized(g.nodes, c), "nodes")
    turn = 0
    while True:
        moves = stage(_proposals(g, c, within), "moves")
        if moves.count() <= rest:
            return turn
        for pick in (_safe(g, moves), _alone(moves)):
            nodes = g.nodes.join(pick, "i", "left").withColumn("moved", F.col("b").isNotNull()).withColumn(c, F.coalesce("b", c)).drop("b")
            nodes = stage(_sized(nodes, c), "nodes")
            if not nodes.filter("moved").isEmpty():
                break
        g.nodes = nodes.drop("moved")
        turn += 1


def _contract(g: Graph, c: str, part: str) -> Graph:
    """The graph whose nodes are the parts, in their communities."""
    nodes = stage(g.nodes.groupBy(F.col(part).alias("i")).agg(F.sum("k").alias("k"), F.first(c).alias("c")), "nodes")
    of = g.nodes.select(F.col("i").alias("x"), F.col(part).alias("p"))
    links = g.links.join(of.select(F.col("x").alias("i"), F.col("p").alias("pi")), "i").join(of.select(F.col("x").alias("j"), F.col("p").alias("pj")), "j")
    return Graph(nodes, stage(links.filter("pi <> pj").groupBy(F.col("pi").alias("i"), F.col("pj").alias("j")).agg(F.sum("w").alias("w")), "links"), g.total, g.gamma)


def _connected(g: Graph) -> DataFrame:
    """(i, c): communities cut into what hangs together, each named by its least node."""
    of = g.nodes.select("i", "c")
    inside = stage(g.links.join(of, "i").join(of.select(F.col("i").alias("j"), F.col("c").alias("d")), "j").filter("c = d").select("i", "j"), "inside")
    label = stage(g.nodes.select("i", F.col("i").alias("l")), "labels")
    while True:
        near = inside.join(label.select(F.col("i").alias("j"), "l"), "j").groupBy("i").agg(F.min("l").alias("m"))
        new = label.join(near, "i", "left").select("i", F.least("l", F.coalesce("m", "l")).alias("l"), F.col("l").alias("was"))
        hop = new.select(F.col("i").alias("l"), F.col("l").alias("further"))
        new = stage(new.join(hop, "l", "left").select("i", F.least("l", F.coalesce("further", "l")).alias("l"), "was"), "labels")
        if not new.filter("l <> was").limit(1).count():
            return new.select("i", F.col("l").alias("c"))
        label = new.drop("was")


def leiden(edges: DataFrame, resolution: float = 1.0, trace: list | None = None) -> DataFrame:
    """(node, community) of edges (src, dst, w long); a community is named by its least node.

    trace: gets (nodes, sum of total x weight within - gamma x squared sizes) after each level, for those who want to see that it never falls.
    """
    g = graph_of(edges, resolution)
    members = g.nodes.select(F.col("i").alias("node"), F.col("i").alias("i"))
    n, last = g.nodes.count(), False
    while n:
        _rounds(g, "c", rest=0 if last else n // REST)
        if trace is not None:
            trace.append((n, _quality(g)))
        g.nodes = stage(g.nodes.withColumn("part", F.col("i")).withColumn("whole", F.col("size")), "nodes")
        _rounds(g, "part", "c", rest=0 if last else n // REST)
        smaller = _contract(g, "c", "part")
        m = smaller.nodes.count()
        if m == n:
            if last:
                break
            last = True
            g.nodes = g.nodes.drop("part", "whole")
            continue
        members = stage(members.join(g.nodes.select("i", "part"), "i").select("node", F.col("part").alias("i")), "members")
        g, n, last = smaller, m, False
    found = members.join(_connected(g), "i").select("node", "c") if n else members.select("node", F.col("i").alias("c"))
    names = found.groupBy("c").agg(F.min("node").alias("community"))
    return stage(found.join(names, "c").select("node", "community"), "communities")


def _quality(g: Graph) -> int:
    """Total x weight within communities, less gamma x squared sizes."""
    of = g.nodes.select("i", "c")
    cut = g.links.join(of, "i").join(of.select(F.col("i").alias("j"), F.col("c").alias("d")), "j").filter("c <> d").agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    sizes = g.nodes.groupBy("c").agg(F.sum("k").cast(FACTOR).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    return g.gamma.denominator * g.total * (g.total - cut) - g.gamma.numerator * int(sizes)
