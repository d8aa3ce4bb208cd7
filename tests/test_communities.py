"""Graph weights, modularity and Leiden's method against slow versions."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from fractions import Fraction

import pytest

from nichefold.operators import communities as C


class Slow:
    """The method over dictionaries: nodes i with weight k and community c; links i -> j -> w."""

    def __init__(self, k, links, c, total, gamma):
        self.k, self.links, self.c, self.total, self.gamma = k, links, c, total, gamma

    @classmethod
    def of(cls, edges, resolution):
        w = defaultdict(int)
        for a, b, x in edges:
            if x > 0:
                w[min(a, b), max(a, b)] += x
        k, links = defaultdict(int), defaultdict(dict)
        for (a, b), x in w.items():
            k[a] += x
            k[b] += x
            if a != b:
                links[a][b] = links[b][a] = x
        return cls(dict(k), links, {i: i for i in k}, sum(k.values()), Fraction(resolution).limit_denominator(1000))

    def quality(self, c):
        size = defaultdict(int)
        for i in self.k:
            size[c[i]] += self.k[i]
        cut = sum(w for i in self.links for j, w in self.links[i].items() if c[i] != c[j])
        return self.gamma.denominator * self.total * (self.total - cut) - self.gamma.numerator * sum(s * s for s in size.values())

    def moves(self, c, within):
        size, n, whole, out = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
        for i in self.k:
            size[c[i]] += self.k[i]
            n[c[i]] += 1
            whole[self.c[i]] += self.k[i]
        den, num = self.gamma.denominator, self.gamma.numerator
        if within:
            whose = {c[i]: self.c[i] for i in self.k}
            for i in self.k:
                for j, w in self.links[i].items():
                    if c[i] != c[j] and self.c[i] == self.c[j]:
                        out[c[i]] += w
            fit = {p for p in out if den * self.total * out[p] >= num * size[p] * (whole[whose[p]] - size[p])}
        for i in self.k:
            to = defaultdict(int)
            for j, w in self.links[i].items():
                to[c[j]] += w
            own = to.pop(c[i], 0)
            if within:
                if n[c[i]] > 1 or c[i] not in fit:
                    continue
                to = {t: w for t, w in to.items() if t in fit and whose[t] == self.c[i]}
                own = 0
            gains = [(den * self.total * (w - own) - num * self.k[i] * (size[t] - size[c[i]] + self.k[i]), -t) for t, w in to.items()]
            if gains and max(gains)[0] > 0:
                yield i, c[i], -max(gains)[1], max(gains)[0]

    def rounds(self, c, within, rest):
        while True:
            moves = list(self.moves(c, within))
            if len(moves) <= rest:
                return
            touch, into, out = defaultdict(list), defaultdict(int), defaultdict(int)
            for i, a, b, g in moves:
                touch[a].append((-g, i, True))
                touch[b].append((-g, i, False))
                out[a] += self.k[i]
                into[b] += self.k[i]
            leaves = {t: min((g, i, leave) for g, i, leave in rows)[2] for t, rows in touch.items()}
            go = [(i, b) for i, a, b, g in moves if leaves[a] and not leaves[b] and 2 * g > self.gamma.numerator * self.k[i] * (into[b] + out[a] - 2 * self.k[i])]
            if not go:
                go = [(i, b) for i, a, b, g in moves if min(touch[a])[1] == i == min(touch[b])[1]]
            before = self.quality(c)
            c.update(go)
            assert self.quality(c) > before

    def contract(self, part):
        k, links, c = defaultdict(int), defaultdict(lambda: defaultdict(int)), {}
        for i in self.k:
            k[part[i]] += self.k[i]
            c[part[i]] = self.c[i]
            for j, w in self.links[i].items():
                if part[i] != part[j]:
                    links[part[i]][part[j]] += w
        return Slow(dict(k), links, c, self.total, self.gamma)


def pieces(nodes, links, c):
    """Connected pieces of communities by their least node."""
    out = {}
    for i in sorted(nodes):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += [j for j in links[x] if c[j] == c[i]]
    return out


def slow_leiden(edges, resolution):
    g = Slow.of(edges, resolution)
    member, last = {i: i for i in g.k}, False
    while g.k:
        n = len(g.k)
        rest = 0 if last else n // C.REST
        g.rounds(g.c, False, rest)
        part = {i: i for i in g.k}
        g.rounds(part, True, rest)
        smaller = g.contract(part)
        if len(smaller.k) == n:
            if last:
                break
            last = True
            continue
        member = {x: part[i] for x, i in member.items()}
        g, last = smaller, False
    c = pieces(g.k, g.links, g.c)
    found = {x: c[i] for x, i in member.items()}
    least = {}
    for x in sorted(found):
        least.setdefault(found[x], x)
    return {x: least[f] for x, f in found.items()}


def random_graph(n, groups, inside, between, seed):
    rnd = random.Random(seed)
    return [(i, j, rnd.randint(1, 9)) for i in range(n) for j in range(i) if rnd.random() < (inside if i % groups == j % groups else between)]


def run(spark, edges, resolution, trace=None):
    df = spark.createDataFrame(edges, "src long, dst long, w long").repartition(3)
    return {r.node: r.community for r in C.leiden(df, resolution, trace).collect()}


@pytest.mark.parametrize(("edges", "resolution"), [
    (random_graph(60, 4, 0.5, 0.03, 1), 1.0),
    ([(i, j, 3) for c in range(4) for i in range(5 * c, 5 * c + 5) for j in range(5 * c, i)] + [(4, 5, 1), (9, 10, 1), (14, 15, 1), (20, 20, 7), (7, 7, 2)], 0.5),
])
def test_leiden_is_the_slow_method(spark, edges, resolution):
    trace: list = []
    got = run(spark, edges, resolution, trace)
    assert got == slow_leiden(edges, resolution)
    assert [q for _, q in trace] == sorted(q for _, q in trace)
    g = Slow.of(edges, resolution)
    assert g.quality(got) >= trace[-1][1] > g.quality({i: i for i in g.k})
    assert pieces(g.k, g.links, got) == got  # each community hangs together, and is named by its least node
    if len(edges) < 60:
        assert sorted(set(got.values())) == [0, 5, 10, 15, 20]


def test_slow_method_on_many_graphs():
    """The rounds' bound holds: quality rises in each (asserted inside), communities hang together, no single move gains at the end."""
    for seed in range(40):
        edges = random_graph(40, 2 + seed % 5, 0.4, 0.05 * (seed % 3), seed)
        got = slow_leiden(edges, 0.5 + seed % 3 / 2)
        g = Slow.of(edges, 0.5 + seed % 3 / 2)
        assert pieces(g.k, g.links, got) == got


def test_odd_graphs(spark):
    assert run(spark, [], 1.0) == {}
    assert run(spark, [(5, 5, 3)], 1.0) == {5: 5}
    odd = [(1, 2, 2), (2, 1, 2), (1, 2, 1), (3, 4, 5), (2, 3, -1), (9, 8, 0)]
    assert run(spark, odd, 1.0) == slow_leiden(odd, 1.0) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_memberships(spark):
    near = [(1, 2, 1.0), (1, 3, 4.0), (1, 4, 9.0), (2, 1, 1.0), (2, 3, 1.0), (2, 4, 1.0), (3, 1, 0.0), (3, 2, 0.0), (3, 4, 4.0), (4, 1, 0.0), (4, 2, 0.0), (4, 3, 0.0)]
    got = {(r.item_id, r.nbr_id): r.w for r in C.memberships(spark.createDataFrame(near, "item_id long, nbr_id long, d2 double"), 4).collect()}
    assert got[1, 2] == 1.0
    assert sum(got[1, n] for n in (2, 3, 4)) == pytest.approx(math.log2(4))
    assert got[1, 3] == pytest.approx(got[1, 4] ** 0.5)  # exp(-1 / s) and exp(-2 / s)
    assert [got[2, n] for n in (1, 3, 4)] == [1.0, 1.0, 1.0]
    assert got[3, 1] == got[3, 2] == got[3, 4] == 1.0
    assert [got[4, n] for n in (1, 2, 3)] == [1.0, 1.0, 1.0]
    pair = {(r.src, r.dst): r.w for r in C.fuzzy_union(spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25), (1, 3, 0.75)], "item_id long, nbr_id long, w double")).collect()}
    assert pair == {(1, 2): pytest.approx(0.625), (1, 3): 0.75}


def test_modularity(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1)], "src long, dst long, w long")
    halves = spark.createDataFrame([(i, i // 4) for i in range(1, 7)], "node long, community int")
    assert C.modularity(edges, halves).first().q == pytest.approx(6 / 7 - 0.5)
    assert C.modularity(edges, halves, 0.5).first().q == pytest.approx(6 / 7 - 0.25)


def test_links_are_shuffled_by_node_once(spark):
    """The sums of a round's links lie with their nodes: nothing is shuffled by node and community, and then by node again."""
    edges = spark.createDataFrame([(i, (i * 7 + 1) % 40, 1 + i % 3) for i in range(40)], "src long, dst long, w long")
    g = C.graph_of(edges, 1.0)
    g.nodes = C._sized(g.nodes, "c")
    plan = C._proposals(g, "c", None)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not any("to#" in line for line in shuffles), shuffles
