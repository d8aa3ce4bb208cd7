"""The same results in plain SQL, written from the definitions: dense matrices, brute-force pairs, one window a metric."""

from __future__ import annotations

import numpy as np

from nichefold.config import KS, LINEAGES, METHODS, NICHES, PROMPTS, QUERY_SET, variant_specs
from nichefold.functions.exprs import LEAP
from nichefold.operators.plots import TYPE_COLORS
from nichefold.plans.fixtures import ALIASES, MARKERS, SETTINGS, SMALL_POOL, STATE_GENES

S = SETTINGS


def h(x: str, seed: int = 0) -> str:
    n = f"(CAST({x} AS BIGINT) + {1 + seed * 1000003})"
    a = f"(({n} * 48271) % 2147483647)"
    return f"((({a} * {a}) % 2147483647 + {n}) * 69621 % 2147483647)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def r11(x: str) -> str:
    """For means of values that have six decimals themselves, whose sixth would often be a tie."""
    return f"(floor(({x}) * 1e11 + 0.5) / 1e11)"


def values(rows) -> str:
    lit = lambda v: "NULL" if v is None else repr(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_Q = [(f"q{i:03d}", t, f, lab, task, "neighborhood" if task == "niche" else "cell", sp, ALIASES.get(lab) if f == "gene" else None) for i, (t, f, lab, task, sp) in enumerate(QUERY_SET)]
_niche_score = " ".join(
    f"WHEN '{n}' THEN {e}"
    for n, e in {
        "bcell_rich": "f.frac_B_cell",
        "tcell_rich": "f.frac_T_cell",
        "myeloid_rich": "f.frac_Myeloid",
        "vascular": "f.frac_Endothelial",
        "immune_rich": "f.frac_T_cell + f.frac_B_cell + f.frac_Myeloid",
        "tumor_immune_interface": "f.frac_Epithelial * (f.frac_T_cell + f.frac_Myeloid)",
    }.items()
)

CTE: dict[str, str] = {
    "cells": "SELECT c_custkey AS cell_id, c_acctbal AS x, (c_custkey * 7919 % 10007) / 10.0::DOUBLE AS y FROM customer",
    "counts": "SELECT o_custkey AS cell_id, CAST(substr(p_brand, 7) AS INT) AS gene, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2",
    "totals": "SELECT cell_id, sum(cnt) AS total FROM counts GROUP BY 1",
    "lognorm": "SELECT cell_id, gene, ln(1 + cnt * (SELECT median(total) FROM totals WHERE total > 0) / total) AS v FROM counts JOIN totals USING (cell_id)",
    "dense": "SELECT c.cell_id, g.gene, coalesce(l.v, 0) AS v FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM counts) g LEFT JOIN lognorm l ON l.cell_id = c.cell_id AND l.gene = g.gene",
    "gstats": "SELECT gene, avg(v) AS mu, CASE WHEN stddev_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sd FROM dense GROUP BY 1",
    "z": "SELECT cell_id, gene, (v - mu) / sd AS z FROM dense JOIN gstats USING (gene)",
    "markers": f"SELECT * FROM ({values((i, t, g) for i, (t, gs) in enumerate(MARKERS.items()) for g in gs)}) AS m(lineage_ord, lineage, gene)",
    "mscores": "SELECT cell_id, lineage_ord, lineage, avg(z) AS score FROM z JOIN markers USING (gene) GROUP BY ALL",
    "ranked_types": "SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, lineage_ord) AS r FROM mscores",
    "types": f"SELECT a.cell_id, CASE WHEN a.score > {S.type_threshold} AND a.score - b.score >= {S.type_margin} THEN a.lineage ELSE 'unknown' END AS cell_type, a.score AS cell_type_score, a.score - b.score AS cell_type_margin FROM ranked_types a JOIN ranked_types b ON a.cell_id = b.cell_id AND a.r = 1 AND b.r = 2",
    "pscore": f"SELECT cell_id, avg(z) AS proliferation_score FROM z WHERE gene IN ({', '.join(map(str, STATE_GENES))}) GROUP BY 1",
    "state": f"SELECT *, proliferation_score >= (SELECT quantile_cont(proliferation_score, {S.proliferation_quantile}) FROM pscore) AS is_proliferating FROM pscore",
    "pairs": "SELECT a.cell_id, b.cell_id AS nbr_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM cells a JOIN cells b ON a.cell_id <> b.cell_id",
    "knn": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, nbr_id) AS rnk FROM pairs) WHERE rnk <= {S.k}",
    "near": f"SELECT * FROM pairs WHERE d2 <= {S.radius * S.radius}",
    **{
        name: "SELECT c.cell_id, " + ", ".join(f"coalesce(avg((t.cell_type = '{x}')::INT::DOUBLE), 0) AS frac_{x}" for x in LINEAGES) + f" FROM cells c LEFT JOIN {edges} e ON e.cell_id = c.cell_id LEFT JOIN types t ON t.cell_id = e.nbr_id GROUP BY 1"
        for name, edges in (("comp", "knn"), ("radius_comp", "near"))
    },
    "niches": f"""SELECT *, CASE {' '.join(f"WHEN niche_{n} THEN '{n}'" for n in NICHES)} ELSE 'none' END AS niche_label FROM (SELECT *,
        frac_B_cell >= {S.niche['bcell_rich']} AS niche_bcell_rich, frac_T_cell >= {S.niche['tcell_rich']} AS niche_tcell_rich, frac_Myeloid >= {S.niche['myeloid_rich']} AS niche_myeloid_rich,
        frac_Endothelial >= {S.niche['vascular']} AND frac_Fibroblast > 0 AS niche_vascular, frac_T_cell + frac_B_cell + frac_Myeloid >= {S.niche['immune_rich']} AS niche_immune_rich,
        frac_Epithelial >= {S.niche['interface_epi']} AND frac_T_cell + frac_Myeloid >= {S.niche['interface_imm']} AS niche_tumor_immune_interface FROM comp)""",
    **{
        f"{p}{name}": sql
        for p, size in (("", S.pool_size), ("small_", SMALL_POOL))
        for name, sql in {
            "quota": f"SELECT cell_type AS s, CASE WHEN sum(count(*)) OVER () <= {size} THEN count(*) ELSE least(count(*), greatest(1, CAST(round_even({float(size)} * count(*) / sum(count(*)) OVER (), 0) AS BIGINT))) END AS q FROM types GROUP BY 1",
            "pool": f"SELECT cell_id, cell_type, row_number() OVER (ORDER BY cell_id) - 1 AS pool_idx FROM (SELECT cell_id, cell_type, row_number() OVER (PARTITION BY cell_type ORDER BY {h('cell_id', S.seed)}, cell_id) AS r FROM types) JOIN {p}quota ON s = cell_type WHERE r <= q",
        }.items()
    },
    "qs": f"SELECT * FROM ({values(_Q)}) AS q(query_id, query_text, target_field, target_label, task_type, level, split, gene)",
    "cuts": f"SELECT gene, greatest(quantile_cont(v, {S.gene_quantile}), 1e-9) AS cut FROM dense JOIN pool USING (cell_id) GROUP BY 1",
    "rel": "SELECT query_id, pool_idx AS item_id, CASE target_field WHEN 'cell_type' THEN p.cell_type = target_label WHEN 'cell_state' THEN s.is_proliferating WHEN 'gene' THEN coalesce(d.v >= c.cut, FALSE) ELSE CASE target_label "
    + " ".join(f"WHEN '{n}' THEN f.niche_{n}" for n in NICHES)
    + " END END AS rel FROM pool p CROSS JOIN qs JOIN state s ON s.cell_id = p.cell_id JOIN niches f ON f.cell_id = p.cell_id LEFT JOIN dense d ON d.cell_id = p.cell_id AND d.gene = qs.gene LEFT JOIN cuts c ON c.gene = qs.gene",
    "oscores": f"SELECT query_id, pool_idx AS item_id, CASE target_field WHEN 'cell_type' THEN m.score WHEN 'cell_state' THEN s.proliferation_score WHEN 'gene' THEN coalesce(d.v, 0) ELSE CASE target_label {_niche_score} END END AS score FROM pool p CROSS JOIN qs JOIN state s ON s.cell_id = p.cell_id JOIN comp f ON f.cell_id = p.cell_id LEFT JOIN mscores m ON m.cell_id = p.cell_id AND m.lineage = target_label LEFT JOIN dense d ON d.cell_id = p.cell_id AND d.gene = qs.gene",
    "rscores": f"SELECT query_id, pool_idx AS item_id, {h('pool_idx * 64 + CAST(substr(query_id, 2) AS BIGINT)')} / 2147483647.0::DOUBLE AS score FROM pool CROSS JOIN qs",
    # Scores of ties must tie in both engines, so they are compared on six decimals.
    "pscores": f"SELECT 'oracle' AS baseline, query_id, item_id, {r6('score')} AS score FROM oscores UNION ALL SELECT 'random', query_id, item_id, {r6('score')} FROM rscores",
    "unit": "SELECT vec_id AS item_id, label, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))), 1e-8)) AS u FROM embeddings",
    "dims": "SELECT item_id, label, unnest(u) AS v, generate_subscripts(u, 1) AS d FROM unit",
    "means": "SELECT label, d, avg(v) AS m FROM dims GROUP BY ALL",
    "cent": "SELECT label, d, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY label)), 1e-8) AS q FROM means",
    "cos": "SELECT c.label AS query_id, i.item_id, i.label AS item_label, sum(c.q * i.v) AS score FROM dims i JOIN cent c ON c.d = i.d GROUP BY ALL",
    "vpairs": "SELECT a.vec_id AS item_id, b.vec_id AS nbr_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id <> b.vec_id",
    "vnear": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY d2, nbr_id)::INT AS rnk FROM vpairs) WHERE rnk <= {S.k}",
    "vsets": f"SELECT item_id, ns, ds, list_transform(ds, lambda d: greatest(d - coalesce(list_filter(ds, lambda e: e > 0)[1], 0), 0)) AS over FROM (SELECT item_id, list(nbr_id ORDER BY d2, nbr_id) AS ns, list(sqrt(d2) ORDER BY d2, nbr_id) AS ds FROM vnear WHERE rnk < {S.k} GROUP BY 1)",
    "vscale": f"""SELECT item_id, 0 AS step, 0.0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1.0::DOUBLE AS mid FROM vsets UNION ALL
        SELECT item_id, step + 1, CASE WHEN p > log2({S.k}) THEN lo ELSE mid END, CASE WHEN p > log2({S.k}) THEN mid ELSE hi END, CASE WHEN p > log2({S.k}) THEN (lo + mid) / 2 WHEN hi = 'inf'::DOUBLE THEN mid * 2 ELSE (mid + hi) / 2 END
        FROM (SELECT b.*, list_sum(list_transform(over, lambda o: exp(-o / mid))) AS p FROM vscale b JOIN vsets USING (item_id) WHERE step < 64)""",
    "vmembers": "SELECT item_id, n AS nbr_id, CASE WHEN o > 0 THEN exp(-o / greatest(mid, mean * 1e-3)) ELSE 1.0::DOUBLE END AS w FROM (SELECT item_id, unnest(ns) AS n, unnest(over) AS o, list_avg(ds) AS mean FROM vsets) JOIN vscale USING (item_id) WHERE step = 64",
    "vweights": "SELECT least(item_id, nbr_id) AS src, greatest(item_id, nbr_id) AS dst, sum(w) - CASE WHEN count(*) = 2 THEN min(w) * max(w) ELSE 0 END AS w FROM vmembers GROUP BY ALL",
    "vends": "SELECT w, a.label AS a, b.label AS b FROM vweights JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst",
    "escores": f"SELECT 'biomedclip' AS baseline, query_id, item_id, {r6('score')} AS score FROM cos UNION ALL SELECT 'random', query_id, item_id, {r6(h('item_id * 64 + query_id') + ' / 2147483647.0::DOUBLE')} FROM cos",
    "erel": "SELECT query_id, item_id, query_id = item_label AS rel FROM cos",
}


def _metrics(scores: str, rel: str, by: str = "baseline, query_id") -> str:
    within = lambda k: f"sum(CASE WHEN rk <= {k} THEN r ELSE 0 END)"
    cols = [f"CASE WHEN {within(k)} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS \"hit@{k}\"" for k in KS]
    cols += [f"{r6(f'{within(k)} / {k}.0::DOUBLE')} AS \"P@{k}\"" for k in KS]
    cols += [f"{r6(f'coalesce({within(k)}::DOUBLE / nullif(sum(r), 0), 0)')} AS \"R@{k}\"" for k in KS]
    cols += [f"{r6(f'coalesce({within(k)} / {k}.0::DOUBLE / nullif(avg(r::DOUBLE), 0), 0)')} AS \"enrich@{k}\"" for k in KS]
    cols += [
        f"{r6('coalesce(sum(CASE WHEN r = 1 THEN hits / rk::DOUBLE ELSE 0 END) / nullif(sum(r), 0), 0)')} AS \"mAP\"",
        f"{r6('coalesce(1.0::DOUBLE / min(CASE WHEN r = 1 THEN rk END), 0)')} AS \"MRR\"",
        f"{r6('coalesce(sum(CASE WHEN r = 1 AND rk <= 10 THEN 1 / log2(rk + 1.0::DOUBLE) ELSE 0 END) / nullif(sum(CASE WHEN rk <= least(10, tot) THEN 1 / log2(rk + 1.0::DOUBLE) ELSE 0 END), 0), 0)')} AS \"nDCG@10\"",
        "sum(r)::BIGINT AS n_relevant",
        f"{r6('avg(r::DOUBLE)')} AS base_rate",
    ]
    return f"""SELECT {by}, {', '.join(cols)} FROM (SELECT *, sum(r) OVER (PARTITION BY {by} ORDER BY rk) AS hits, sum(r) OVER (PARTITION BY {by}) AS tot FROM (
        SELECT {by}, s.item_id, rel::INT AS r, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, s.item_id) AS rk FROM {scores} s JOIN {rel} USING (query_id, item_id))) GROUP BY {by}"""


CTE["pool_metrics"] = _metrics("pscores", "rel")
CTE["emb_metrics"] = _metrics("escores", "erel")
CTE["per_query"] = "SELECT m.*, task_type, split FROM pool_metrics m JOIN qs USING (query_id)"
_ORDER = list(CTE)


def with_(final: str, *extra: tuple[str, str]) -> str:
    """final with the CTEs that it needs, found by name; extra ones may stand for known ones of their name."""
    import re

    known = CTE | dict(extra)
    need: set[str] = set()

    def add(text: str) -> None:
        for n in known:
            if n not in need and re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", text):
                need.add(n)
                add(known[n])

    add(final)
    names = [n for n in [*_ORDER, *(e[0] for e in extra if e[0] not in CTE)] if n in need]
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n]})" for n in names) + "\n" if names else "") + final


def _regions(k: int = 5, starts: int = 10, rounds: int = 30) -> str:
    """k-means on coordinates in thousandths: draws, rounds, and the best start's regions by their centres from left to right."""
    d2 = lambda c: f"(x - {c}.x) * (x - {c}.x) + (y - {c}.y) * (y - {c}.y)"
    near = f"list_position(list_transform(cs, lambda c: {d2('c')}), list_min(list_transform(cs, lambda c: {d2('c')})))"
    point = "{'x': x::DOUBLE, 'y': y::DOUBLE}"
    wait = lambda j: f"-ln(({h(f'cell_id + (s * {k} + {j}) * 1000003')} + 0.5::DOUBLE) / 2147483647.0::DOUBLE)"
    ctes = [
        ("kp", "SELECT cell_id, round(x / 0.001)::BIGINT AS x, round(y / 0.001)::BIGINT AS y FROM cells"),
        ("kc0", f"SELECT s, [arg_min({point}, {wait(0)})] AS cs FROM kp, range({starts}) AS r(s) GROUP BY s"),
        *[(f"kc{j}", f"SELECT s, list_append(cs, arg_min({point}, {wait(j)} / far)) AS cs FROM (SELECT *, list_min(list_transform(cs, lambda c: {d2('c')})) AS far FROM kp, kc{j - 1}) WHERE far > 0 GROUP BY s, cs") for j in range(1, k)],
        ("kround", f"SELECT 0 AS step, s, cs FROM kc{k - 1} UNION ALL SELECT step + 1, s, ["
            + ", ".join(f"{{'x': coalesce(sum(x) FILTER (c = {i}) / count(*) FILTER (c = {i}), cs[{i}].x), 'y': coalesce(sum(y) FILTER (c = {i}) / count(*) FILTER (c = {i}), cs[{i}].y)}}" for i in range(1, k + 1))
            + f"] FROM (SELECT step, s, cs, x, y, {near} AS c FROM kround, kp WHERE step < {rounds}) GROUP BY step, s, cs"),
        ("ktight", f"SELECT s, sum(q) AS q FROM (SELECT s, c, (sum(x)::DOUBLE * sum(x)::DOUBLE + sum(y)::DOUBLE * sum(y)::DOUBLE) / count(*) AS q FROM (SELECT s, x, y, {near} AS c FROM kround, kp WHERE step = {rounds - 1}) GROUP BY s, c) GROUP BY s"),
        ("kbest", f"SELECT list_sort(cs) AS cs FROM kround JOIN (SELECT s FROM ktight ORDER BY round(q / (SELECT max(q) FROM ktight), 9) DESC, s LIMIT 1) USING (s) WHERE step = {rounds}"),
    ]
    return with_(f"SELECT cell_id, ({near} - 1)::INT AS fold FROM kp, kbest", *ctes)


REPORT = ["hit@1", "P@5", "R@5", "R@10", "mAP", "MRR", "nDCG@10", "enrich@10"]


def _means(prefix: str = "", how=r6) -> str:
    return ", ".join(f"{how(f'avg({prefix}"{c}")')} AS \"{c}\"" for c in REPORT)


def _even(x: str) -> str:
    return f"(round_even(({x}) * 1e4, 0) / 1e4)"


BOOT = 5000
_boot = f"SELECT b::INT AS b, ({h('b * n + p')}) % n AS i FROM range({BOOT}) AS r(b), (SELECT count(DISTINCT query_id)::BIGINT AS n FROM emb_metrics) AS c, range((SELECT count(DISTINCT query_id) FROM emb_metrics)) AS s(p)"
_vals = "SELECT baseline, query_id, \"mAP\" AS value, dense_rank() OVER (ORDER BY query_id) - 1 AS i FROM emb_metrics"
_boots = "SELECT baseline, b, sum(value) / count(*) AS m FROM draws JOIN vals USING (i) GROUP BY ALL"
_diffs = "SELECT o.baseline, r.query_id, r.value - o.value AS value, r.i FROM vals r JOIN vals o ON r.query_id = o.query_id AND r.baseline = 'biomedclip' AND o.baseline <> 'biomedclip'"
_dboots = "SELECT baseline, b, sum(value) / count(*) AS m FROM draws JOIN diffs USING (i) GROUP BY ALL"
_P = "least(1.0, 2 * least(avg((m <= 0)::INT::DOUBLE), avg((m >= 0)::INT::DOUBLE)))"
_draws = (("draws", _boot), ("vals", _vals))
_bucket = "(CAST(list_sum(list_transform(range(1, length(w) + 1), lambda i: unicode(substr(w, i, 1)) * ((i - 1) * 37 + 11))) AS BIGINT) % 256)"
TEXT_DIM = 16
_cell = f"(({h(f'b * {TEXT_DIM} + d')})::DOUBLE / 1073741823.5 - 1.0)"
_prompts = "SELECT query_id, t, replace(p, '{}', query_text) AS text FROM qs, (" + values((i, p) for i, p in enumerate(PROMPTS)) + ") AS x(t, p)"
_words = "SELECT query_id, t, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM prompts"
_pvec = f"SELECT query_id, t, d, sum({_cell}) AS v FROM (SELECT query_id, t, {_bucket} AS b FROM pwords), range({TEXT_DIM}) AS r(d) GROUP BY ALL"
_punit = "SELECT query_id, t, d, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY query_id, t)), 1e-8) AS u FROM pvec"
_pmean = "SELECT query_id, d, avg(u) AS m FROM punit GROUP BY ALL"
_ztexts = "SELECT 'plain' AS kind, query_id, 0 AS t, query_text AS text FROM qs UNION ALL SELECT 'prompt', query_id, t, text FROM prompts"
_zwords = "SELECT kind, query_id, t, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS w FROM ztexts"
_zvec = " UNION ALL ".join(
    f"SELECT '{e}' AS enc, kind, query_id, t, d, sum(({h('b * 64 + d', seed)})::DOUBLE / 1073741823.5 - 1.0) AS v FROM (SELECT kind, query_id, t, {_bucket} AS b FROM zwords), range(64) AS r(d) GROUP BY ALL" for e, seed in (("biomedclip", 0), ("plip", 1))
)
_zunit = "SELECT enc, kind, query_id, t, d, v, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY enc, kind, query_id, t)), 1e-8) AS u FROM zvec"
_zq = (
    "SELECT b.baseline, query_id, d, CASE WHEN b.kind = 'plain' THEN any_value(v) ELSE avg(u) END AS q FROM zunit JOIN (VALUES ('biomedclip', 'biomedclip', 'plain'), ('biomedclip_nbhd', 'biomedclip', 'plain'), "
    "('plip', 'plip', 'plain'), ('neighborhood', 'biomedclip', 'plain'), ('biomedclip_prompt', 'biomedclip', 'prompt'), ('plip_prompt', 'plip', 'prompt')) AS b(baseline, enc, kind) USING (enc, kind) GROUP BY b.baseline, b.kind, query_id, d"
)
#: Cells that have vectors, their place in the pool, and their neighbours among themselves.
_vcells = "SELECT cell_id, x, y, row_number() OVER (ORDER BY cell_id) - 1 AS item_id FROM cells WHERE cell_id IN (SELECT vec_id FROM embeddings)"
_vpairs = "SELECT a.cell_id, b.cell_id AS nbr_id, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.cell_id) AS rnk FROM vcells a JOIN vcells b ON a.cell_id <> b.cell_id"
_vknn = f"SELECT cell_id, nbr_id FROM ({_vpairs}) WHERE rnk <= {S.k} UNION ALL SELECT cell_id, cell_id FROM vcells"
_vdims = "SELECT c.cell_id, item_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM vcells c JOIN embeddings ON vec_id = c.cell_id"
_zitems = (
    "SELECT unnest(['biomedclip', 'biomedclip_prompt']) AS baseline, item_id, d, v FROM vdims UNION ALL SELECT 'biomedclip_nbhd', item_id, 65 - d, v FROM vdims UNION ALL SELECT unnest(['plip', 'plip_prompt']), item_id, d, -v FROM vdims "
    "UNION ALL SELECT 'neighborhood', c.item_id, d, avg(v) FROM vknn k JOIN vcells c ON c.cell_id = k.cell_id JOIN vdims n ON n.cell_id = k.nbr_id GROUP BY ALL"
)
_mraw = (
    "SELECT cell_id, 0 AS ord, d, v FROM vd WHERE d <= 3 UNION ALL SELECT cell_id, 1, d - 3, v FROM vd WHERE d BETWEEN 4 AND 6 UNION ALL SELECT cell_id, 3, d, v FROM vd UNION ALL SELECT cell_id, 3, d + 64, v * v FROM vd"
).replace("vd", "(SELECT c.cell_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM vcells c JOIN embeddings ON vec_id = c.cell_id)")
_mnear = f"SELECT cell_id, nbr_id FROM ({_vpairs}) WHERE rnk <= 3 UNION ALL SELECT cell_id, cell_id FROM vcells"
_mixed = "SELECT cell_id, ord, d, v FROM mraw UNION ALL SELECT n.cell_id, ord + CASE ord WHEN 0 THEN 2 ELSE 1 END, d, avg(v) FROM mnear n JOIN mraw r ON r.cell_id = n.nbr_id WHERE ord IN (0, 3) GROUP BY n.cell_id, ord, d"
HAVE = [f"{e}_{s}" for e in ("biomedclip", "plip", "uni2") for s in ("medium", "neighborhood", "medium_nbravg")] + ["conch_medium"]
_specs = values((s, b) for s, bs in variant_specs().items() for b in bs)
_folds = f"SELECT vec_id AS item_id, (row_number() OVER (ORDER BY {h('vec_id')}, vec_id) - 1) % 5 AS fold FROM embeddings"
_feat = "SELECT e.vec_id AS item_id, fold, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, (label = 3)::INT::DOUBLE AS y FROM embeddings e JOIN folds f ON f.item_id = e.vec_id"
_train = "SELECT t.fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, sum(a * a) - count(*) * avg(a) * avg(a) + 1 AS saa, sum(b * b) - count(*) * avg(b) * avg(b) + 1 AS sbb, sum(a * b) - count(*) * avg(a) * avg(b) AS sab, sum(a * y) - count(*) * avg(a) * avg(y) AS say, sum(b * y) - count(*) * avg(b) * avg(y) AS sby FROM feat f JOIN (SELECT DISTINCT fold FROM feat) t ON f.fold <> t.fold GROUP BY 1"
_tile = "SELECT cell_id, CAST(floor((x - (SELECT min(x) FROM cells)) / 500.0) * (floor(((SELECT max(y) FROM cells) - (SELECT min(y) FROM cells)) / 500.0) + 1) + floor((y - (SELECT min(y) FROM cells)) / 500.0) AS BIGINT) AS tile FROM cells"
_cfold = f"SELECT cell_id, (row_number() OVER (ORDER BY {h('cell_id')}, cell_id) - 1) % 5 AS fold FROM cells"
_display = values((m, i, label) for i, (m, label) in enumerate(METHODS.items()))
AFFINE = [[0.9, 0.1, 5.0], [-0.1, 0.9, -3.0], [0.0001, 0.0, 1.0]]
_fracs = ", ".join(f"{r6(f'frac_{t}')} AS frac_{t}" for t in LINEAGES)
_niche_cols = ", ".join(f"niche_{n}" for n in NICHES)

LATEX = (
    [r"\begin{table}[t]", r"\centering", rf"\caption{{Bootstrap means with 95\% intervals over queries, {BOOT} rounds.}}", r"\begin{tabular}{lcc}", r"\toprule", r"Method & mAP & enrich@10 \\", r"\midrule"],
    [r"\bottomrule", r"\end{tabular}", r"\end{table}"],
)
_star = "CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 5e-2 THEN '*' ELSE 'ns' END"


def _significance() -> tuple[tuple[str, str], ...]:
    """CTEs up to ``sig``: intervals of three methods and stars against the first of them."""
    ms = {"m": "mAP", "n": "nDCG@10", "e": "enrich@10"}
    parts = [("sdraws", _boot)]
    long = " UNION ALL ".join(f"SELECT '{k}' AS k, CASE baseline WHEN 'biomedclip' THEN 'cellseek' ELSE baseline END AS baseline, query_id, \"{m}\" AS value FROM emb_metrics UNION ALL SELECT '{k}', 'oracle', query_id, \"{m}\" + 0.125 FROM emb_metrics WHERE baseline = 'biomedclip'" for k, m in ms.items())
    parts += [
        ("slong", long),
        ("svals", "SELECT *, dense_rank() OVER (ORDER BY query_id) - 1 AS i FROM slong"),
        ("sboots", "SELECT k, baseline, b, sum(value) / count(*) AS m FROM sdraws JOIN svals USING (i) GROUP BY ALL"),
        ("sci", "SELECT k, baseline, avg(value) AS mean FROM slong GROUP BY ALL"),
        ("sq", "SELECT k, baseline, printf('%.3f [%.2f,%.2f]', any_value(mean), quantile_cont(m, 0.025), quantile_cont(m, 0.975)) AS txt FROM sboots JOIN sci USING (k, baseline) GROUP BY ALL"),
        ("sdiff", "SELECT r.k, r.value - o.value AS value, r.i FROM svals r JOIN svals o ON r.k = o.k AND r.query_id = o.query_id AND r.baseline = 'cellseek' AND o.baseline = 'random'"),
        ("sp", f"SELECT k, {_P} AS p FROM (SELECT k, b, sum(value) / count(*) AS m FROM sdraws JOIN sdiff USING (i) GROUP BY ALL) GROUP BY 1"),
    ]
    cols = ", ".join(f"max(CASE WHEN k = '{k}' THEN txt END) AS \"{m}\", max(CASE WHEN k = '{k}' AND q.baseline = 'random' THEN {_star} END) AS \"{m}_sig\"" for k, m in ms.items())
    parts.append(("sig", f"SELECT q.baseline, ord, method, {cols} FROM sq q JOIN sp USING (k) JOIN (" + _display + ") AS m(baseline, ord, method) ON m.baseline = q.baseline GROUP BY q.baseline, ord, method"))
    return tuple(parts)


_sig = _significance()


def _newton(train: str, test: str, rounds: int = 30) -> tuple[tuple[str, str], ...]:
    """CTEs up to ``logit`` (f, item_id, query_id, score): two weighted logistic models on two features for each f, by Newton's method.

    train and test say which rows (f, item_id) of ``plane`` each model learns from and scores.
    """
    sums = ", ".join(
        f"sum({e}) AS {n}"
        for n, e in {"ga": "w * (p - y) * a", "gb": "w * (p - y) * b", "gc": "w * (p - y)", "haa": "w * p * (1 - p) * a * a", "hbb": "w * p * (1 - p) * b * b", "hcc": "w * p * (1 - p)", "hab": "w * p * (1 - p) * a * b", "hac": "w * p * (1 - p) * a", "hbc": "w * p * (1 - p) * b"}.items()
    )
    step = f"SELECT k, f, q, wa, wb, c, {sums} FROM (SELECT nw.*, a, b, y, CASE WHEN y > 0 THEN pw ELSE 1 END / (n * 2.0::DOUBLE) AS w, 1 / (1 + exp(-(wa * a + wb * b + c))) AS p FROM nw JOIN zr USING (f, q) JOIN pwt USING (f, q) WHERE k < {rounds}) GROUP BY k, f, q, wa, wb, c"
    full = f"SELECT k, f, q, wa, wb, c, ga + 0.002 * wa AS g1, gb + 0.002 * wb AS g2, gc + 0.002 * c AS g3, haa + 0.002 AS h1, hab AS h2, hac AS h3, hbb + 0.002 AS h4, hbc AS h5, hcc + 0.002 AS h6 FROM ({step})"
    det = "(h1 * (h4 * h6 - h5 * h5) - h2 * (h2 * h6 - h3 * h5) + h3 * (h2 * h5 - h3 * h4))"
    return (
        ("plane", "SELECT vec_id AS item_id, embedding[1]::DOUBLE * 10 AS x1, embedding[2]::DOUBLE * 10 AS x2, (label < 3)::INT::DOUBLE AS y1, (label % 2 = 0)::INT::DOUBLE AS y2 FROM embeddings"),
        ("tr", train),
        ("te", test),
        ("mo", "SELECT f, avg(x1) AS m1, stddev_samp(x1) + 1e-6 AS s1, avg(x2) AS m2, stddev_samp(x2) + 1e-6 AS s2 FROM tr JOIN plane USING (item_id) GROUP BY f"),
        ("zr", "SELECT f, q, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, CASE q WHEN 'low' THEN y1 ELSE y2 END AS y FROM tr JOIN plane USING (item_id) JOIN mo USING (f), (VALUES ('low'), ('even')) AS v(q)"),
        ("pwt", "SELECT f, q, count(*)::DOUBLE AS n, least(1000.0, greatest(1.0, (count(*) - sum(y)) / (sum(y) + 1e-6))) AS pw FROM zr GROUP BY f, q"),
        (
            "nw",
            f"SELECT 0 AS k, f, q, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb, 0.0::DOUBLE AS c FROM pwt UNION ALL SELECT k + 1, f, q, wa - ((h4 * h6 - h5 * h5) * g1 + (h3 * h5 - h2 * h6) * g2 + (h2 * h5 - h3 * h4) * g3) / {det}, "
            f"wb - ((h3 * h5 - h2 * h6) * g1 + (h1 * h6 - h3 * h3) * g2 + (h2 * h3 - h1 * h5) * g3) / {det}, c - ((h2 * h5 - h3 * h4) * g1 + (h2 * h3 - h1 * h5) * g2 + (h1 * h4 - h2 * h2) * g3) / {det} FROM ({full})",
        ),
        ("logit", f"SELECT f, item_id, q AS query_id, wa * (x1 - m1) / s1 + wb * (x2 - m2) / s2 + c AS score FROM te JOIN plane USING (item_id) JOIN mo USING (f) JOIN nw USING (f) WHERE k = {rounds}"),
    )


#: Text vectors of eight labels.
WORDS = np.stack([np.cos(np.arange(8) * 0.7), np.sin(np.arange(8) * 0.7)], axis=1)


#: Steps of Adam that two engines take alike: over hundreds, at this rate, it magnifies their last digits.
STEPS = 50


def _adam(rows: str, start: list[float], parts: list[tuple[str, str]], sums: list[str], epochs: int = STEPS, lr: float = 0.05, decay: float = 1e-3) -> str:
    """Parameters t0.. by f and step k, by Adam from a start.

    rows: a CTE of training rows by f.  parts: (name, expression) of what a row's gradient is made of, each from those before.  sums: a row's share of
    each parameter's gradient.
    """
    n = len(start)
    inner = f"SELECT * FROM ad JOIN {rows} USING (f) WHERE k < {epochs}"
    for name, expression in parts:
        inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
    state = ", ".join(f"{c}{i}" for c in "tmv" for i in range(n))
    total = f"SELECT k, f, {state}, " + ", ".join(f"sum({e}) + {decay} * t{i} AS d{i}" for i, e in enumerate(sums)) + f" FROM ({inner}) GROUP BY k, f, {state}"
    moved = "SELECT k + 1 AS k, f, " + ", ".join(f"t{i}" for i in range(n)) + ", " + ", ".join(f"0.9 * m{i} + 0.1 * d{i} AS m{i}, 0.999 * v{i} + 0.001 * d{i} * d{i} AS v{i}" for i in range(n)) + f" FROM ({total})"
    new = ", ".join(f"t{i} - {lr} * (m{i} / (1 - 0.9::DOUBLE ** k)) / (sqrt(v{i} / (1 - 0.999::DOUBLE ** k)) + 1e-8)" for i in range(n))
    rest = ", ".join(f"{c}{i}" for c in "mv" for i in range(n))
    first = ", ".join(f"{v!r}::DOUBLE AS t{i}" for i, v in enumerate(start)) + ", " + ", ".join(f"0.0::DOUBLE AS {c}{i}" for c in "mv" for i in range(n))
    return f"SELECT 0 AS k, f, {first} FROM (SELECT DISTINCT f FROM {rows}) UNION ALL SELECT k, f, {new}, {rest} FROM ({moved})"


_plane_rows = "SELECT vec_id AS item_id, label, fold, embedding[1]::DOUBLE * 10 AS x1, embedding[2]::DOUBLE * 10 AS x2 FROM embeddings JOIN folds ON item_id = vec_id"
_scale = "SELECT f, count(*)::DOUBLE AS n, avg(x1) AS m1, stddev_samp(x1) + 1e-6 AS s1, avg(x2) AS m2, stddev_samp(x2) + 1e-6 AS s2 FROM ot GROUP BY f"


def _cosine_map() -> tuple[tuple[str, str], ...]:
    """CTEs up to ``oscore``: a linear map of two features to two numbers by cosine loss, from numpy's start, and cosines with the words."""
    start = np.random.default_rng(0).uniform(-(2**-0.5), 2**-0.5, 6).tolist()
    p = ["a * t0 + b * t2 + t4", "a * t1 + b * t3 + t5"]
    parts = [("p1", p[0]), ("p2", p[1]), ("sz", "greatest(sqrt(p1 * p1 + p2 * p2), 1e-6)"), ("uy", "(p1 * y1 + p2 * y2) / sz")]
    parts += [(f"g{i}", f"-(y{i} - p{i} / sz * uy) / sz / n") for i in (1, 2)]
    words = values((i, float(v[0]), float(v[1])) for i, v in enumerate(WORDS))
    return (
        ("folds", _folds),
        ("words", f"SELECT * FROM ({words}) AS w(label, y1, y2)"),
        ("op", _plane_rows),
        ("ot", "SELECT f, op.* FROM op JOIN (SELECT DISTINCT fold AS f FROM folds) g ON fold <> f WHERE label < 8"),
        ("onum", _scale),
        ("oz", "SELECT f, n, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, y1, y2 FROM ot JOIN onum USING (f) JOIN words USING (label)"),
        ("ad", _adam("oz", start, parts, ["a * g1", "a * g2", "b * g1", "b * g2", "g1", "g2"])),
        ("olast", f"SELECT o.item_id, w.label AS q, w.y1, w.y2, {p[0]} AS p1, {p[1]} AS p2 FROM (SELECT item_id, fold AS f, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM op JOIN onum ON f = fold) o JOIN ad ON ad.f = o.f AND k = {STEPS}, words w"),
        ("oscore", "SELECT item_id, CAST(q AS VARCHAR) AS query_id, (p1 * y1 + p2 * y2) / greatest(sqrt(p1 * p1 + p2 * p2), 1e-6) AS score FROM olast"),
    )


def _network(hidden: int = 3, dropout: float = 0.0) -> tuple[tuple[str, str], ...]:
    """CTEs up to ``oscore``: one hidden layer on two features, two queries jointly, from numpy's start; units drop by hashes of item, step and unit."""
    rng = np.random.default_rng(0)
    start = np.concatenate([rng.uniform(-(fan**-0.5), fan**-0.5, k) for k, fan in ((2 * hidden, 2), (hidden, 2), (hidden * 2, hidden), (2, hidden))]).tolist()
    w1 = lambda i, j: f"t{i * hidden + j}"
    b1 = lambda j: f"t{2 * hidden + j}"
    w2 = lambda j, q: f"t{3 * hidden + 2 * j + q}"
    b2 = lambda q: f"t{5 * hidden + q}"
    units, queries = range(hidden), range(2)
    layer = [(f"h{j}", f"a * {w1(0, j)} + b * {w1(1, j)} + {b1(j)}") for j in units]
    drawn = [("draw", h(f"{h('item_id')} + (k + 1)::BIGINT * {LEAP}"))] if dropout else []
    kept = lambda j: f"h{j} > 0 AND ({h(f'draw + {j * LEAP}')} + 0.5::DOUBLE) / 2147483647.0::DOUBLE >= {dropout}" if dropout else f"h{j} > 0"
    share = f" * (1 / {1 - dropout!r}::DOUBLE)" if dropout else ""
    drawn += [(f"m{j}_", f"CASE WHEN {kept(j)} THEN 1.0::DOUBLE{share} ELSE 0.0 END") for j in units] if dropout else []
    out = lambda j, learning: f"h{j} * m{j}_" if learning and dropout else f"greatest(h{j}, 0)"
    logits = lambda learning: [(f"z{q}", " + ".join(f"{out(j, learning)} * {w2(j, q)}" for j in units) + f" + {b2(q)}") for q in queries]
    forward = [*layer, *logits(False)]
    parts = [*layer, *drawn, *logits(True), *((f"p{q}", f"1 / (1 + exp(-z{q}))") for q in queries), *((f"g{q}", f"(p{q} * (1 - y{q} + pw{q} * y{q}) - pw{q} * y{q}) / (n * 2)") for q in queries)]
    back = lambda j: " + ".join(f"g{q} * {w2(j, q)}" for q in queries)
    parts += [(f"e{j}", f"({back(j)}) * m{j}_" if dropout else f"CASE WHEN h{j} > 0 THEN {back(j)} ELSE 0 END") for j in units]
    sums = [f"{x} * e{j}" for x in "ab" for j in units] + [f"e{j}" for j in units] + [f"{out(j, True)} * g{q}" for j in units for q in queries] + [f"g{q}" for q in queries]
    weight = lambda q: f"least(1000.0, greatest(1.0, (count(*) - sum(y{q})) / (sum(y{q}) + 1e-6))) AS pw{q}"
    scored = f"SELECT item_id, k, a, b, ad.* EXCLUDE (f, k) FROM (SELECT item_id, fold AS f, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b FROM op JOIN onum ON f = fold) o JOIN ad ON ad.f = o.f AND k = {STEPS}"
    for name, expression in forward:
        scored = f"SELECT *, {expression} AS {name} FROM ({scored})"
    return (
        ("folds", _folds),
        ("op", _plane_rows),
        ("ot", "SELECT f, op.*, (label < 3)::INT::DOUBLE AS y0, (label % 2 = 0)::INT::DOUBLE AS y1 FROM op JOIN (SELECT DISTINCT fold AS f FROM folds) g ON fold <> f"),
        ("onum", _scale),
        ("opw", f"SELECT f, {weight(0)}, {weight(1)} FROM ot GROUP BY f"),
        ("oz", "SELECT f, n, item_id, pw0, pw1, (x1 - m1) / s1 AS a, (x2 - m2) / s2 AS b, y0, y1 FROM ot JOIN onum USING (f) JOIN opw USING (f)"),
        ("ad", _adam("oz", start, parts, sums)),
        ("olast", scored),
        ("oscore", "SELECT item_id, 'low' AS query_id, z0 AS score FROM olast UNION ALL SELECT item_id, 'even', z1 FROM olast"),
    )


_oof = _newton("SELECT g.fold AS f, i.item_id FROM folds i JOIN (SELECT DISTINCT fold FROM folds) g ON i.fold <> g.fold", "SELECT fold AS f, item_id FROM folds")
_transfer = _newton("SELECT 1 AS f, vec_id AS item_id FROM embeddings WHERE vec_id % 2 = 0", "SELECT 1 AS f, vec_id AS item_id FROM embeddings WHERE vec_id % 2 = 1")
_vtile = lambda w: f"CAST(floor((x - (SELECT min(x) FROM vcells)) / {w}) * (floor(((SELECT max(y) FROM vcells) - (SELECT min(y) FROM vcells)) / {w}) + 1) + floor((y - (SELECT min(y) FROM vcells)) / {w}) AS BIGINT)"
_scheme = (
    f"SELECT 'random' AS scheme, NULL::DOUBLE AS buffer, cell_id AS item_id, x, y, (row_number() OVER (ORDER BY {h('cell_id')}, cell_id) - 1) % 5 AS fold FROM vcells"
    + "".join(f" UNION ALL SELECT '{n}', {b}, cell_id, x, y, {h(_vtile(w))} % 5 FROM vcells" for n, b, w in (("grid500", "NULL", 500.0), ("grid500_buffer", "150.0", 500.0), ("grid1000_buffer", "150.0", 1000.0)))
)
_schemes = (
    ("vcells", _vcells),
    ("sf", _scheme),
    *_newton(
        "SELECT a.scheme || ':' || g.fold AS f, a.item_id FROM sf a JOIN (SELECT DISTINCT scheme, fold FROM sf) g ON g.scheme = a.scheme AND g.fold <> a.fold WHERE a.buffer IS NULL OR NOT EXISTS (SELECT 1 FROM sf t WHERE t.scheme = a.scheme AND t.fold = g.fold AND (t.x - a.x) * (t.x - a.x) + (t.y - a.y) * (t.y - a.y) <= a.buffer * a.buffer)",
        "SELECT scheme || ':' || fold AS f, item_id FROM sf",
    ),
    ("sscores", f"SELECT split_part(f, ':', 1) AS scheme, query_id, item_id, {r6('score')} AS score FROM logit"),
    ("srel", "SELECT 'low' AS query_id, item_id, y1 > 0 AS rel FROM plane UNION ALL SELECT 'even', item_id, y2 > 0 FROM plane"),
)
_dot = lambda a, b: f"list_dot_product({a}, {b})"

def _conjugate(name: str, mat: str, rhs: str, rounds: int) -> str:
    """Solutions w of A w = b by conjugate gradients: A (lists of rows) by f in one CTE, b by f and t in another; the last k of each is the solution."""
    step = f"SELECT {name}.*, list_transform(A, lambda row: {_dot('row', 'p')}) AS ap FROM {name} JOIN {mat} USING (f) WHERE k < {rounds} AND rs > 1e-26"
    moved = f"SELECT k, f, t, p, rs, list_transform(list_zip(w, p), lambda z: z[1] + al * z[2]) AS w2, list_transform(list_zip(r, ap), lambda z: z[1] - al * z[2]) AS r2 FROM (SELECT *, rs / {_dot('p', 'ap')} AS al FROM ({step}))"
    return (
        f"SELECT 0 AS k, f, t, list_transform(b, lambda v: 0.0::DOUBLE) AS w, b AS r, b AS p, {_dot('b', 'b')} AS rs FROM {rhs} UNION ALL "
        f"SELECT k + 1, f, t, w2, r2, list_transform(list_zip(r2, p), lambda z: z[1] + {_dot('r2', 'r2')} / rs * z[2]), {_dot('r2', 'r2')} FROM ({moved})"
    )


_ridge = (
    ("folds", _folds),
    ("rx", "SELECT e.vec_id AS item_id, fold, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings e JOIN folds f ON f.item_id = e.vec_id"),
    ("rlong", "SELECT item_id, fold, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM rx"),
    ("rg", "SELECT DISTINCT fold AS f FROM folds"),
    ("rmean", "SELECT f, i, avg(v) AS m FROM rg JOIN rlong ON fold <> f GROUP BY f, i"),
    ("rcen", "SELECT f, item_id, r.i, v - m AS v FROM rg JOIN rlong r ON fold <> f JOIN rmean USING (f, i)"),
    ("rgram", "SELECT a.f, a.i, b.i AS j, sum(a.v * b.v) + CASE WHEN a.i = b.i THEN 1 ELSE 0 END AS s FROM rcen a JOIN rcen b ON a.f = b.f AND a.item_id = b.item_id GROUP BY a.f, a.i, b.i"),
    ("rmat", "SELECT f, list(row ORDER BY i) AS A FROM (SELECT f, i, list(s ORDER BY j) AS row FROM rgram GROUP BY f, i) GROUP BY f"),
    ("rmy", "SELECT f, t, avg((label = t)::INT::DOUBLE) AS my FROM rg JOIN rx ON fold <> f, range(10) AS r(t) GROUP BY f, t"),
    ("rb", "SELECT f, t, list(s ORDER BY i) AS b FROM (SELECT c.f, t, c.i, sum(c.v * ((label = t)::INT::DOUBLE - my)) AS s FROM rcen c JOIN rx USING (item_id) JOIN rmy y ON y.f = c.f GROUP BY c.f, t, c.i) GROUP BY f, t"),
    ("cg", _conjugate("cg", "rmat", "rb", 300)),
    ("cw", "SELECT f, t, arg_max(w, k) AS w FROM cg GROUP BY f, t"),
    ("rmx", "SELECT f, list(m ORDER BY i) AS mx FROM rmean GROUP BY f"),
)
_z = lambda v, by: f"({v} - avg({v}) OVER w) / CASE WHEN stddev_pop({v}) OVER w > 0 THEN stddev_pop({v}) OVER w ELSE 1 END"
#: Expression predicted out of fold from six blocks of features, and what follows from it.
_predicted = (
    ("vcells", _vcells),
    ("vknn", _vknn),
    ("vdims", _vdims),
    ("pavg", "SELECT c.item_id, d, avg(v) AS v FROM vknn k JOIN vcells c ON c.cell_id = k.cell_id JOIN vdims n ON n.cell_id = k.nbr_id GROUP BY c.item_id, d"),
    (
        "praw",
        # Of the six blocks one is the first reversed and one negated, and one the average negated: ridge on copies is ridge on one times the root of their number.
        "SELECT item_id, 0 AS b, d, v FROM vdims UNION ALL SELECT item_id, 1, d, v FROM pavg UNION ALL SELECT item_id, 2, d, v * v FROM vdims",
    ),
    ("punits", "SELECT item_id, b * 64 + d AS i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY item_id, b)), 1e-8) AS v FROM praw"),
    ("pstd", f"SELECT item_id, i, {_z('v', 'i')} * sqrt(3.0::DOUBLE - (i - 1) // 64) AS v FROM punits WINDOW w AS (PARTITION BY i)"),
    ("pfold", f"SELECT item_id, (row_number() OVER (ORDER BY {h('item_id')}, item_id) - 1) % 5 AS fold FROM vcells"),
    ("pg", "SELECT DISTINCT fold AS f FROM pfold"),
    ("prow", "SELECT item_id, list(v ORDER BY i) AS x FROM pstd GROUP BY item_id"),
    ("pcol", "SELECT f, i, list(v ORDER BY item_id) AS c FROM pstd JOIN pfold USING (item_id) JOIN pg ON fold <> f GROUP BY f, i"),
    ("pmat", f"SELECT f, list(row ORDER BY i) AS A FROM (SELECT a.f, a.i, list({_dot('a.c', 'b.c')} + CASE WHEN a.i = b.i THEN 1 ELSE 0 END ORDER BY b.i) AS row FROM pcol a JOIN pcol b ON a.f = b.f GROUP BY a.f, a.i) GROUP BY f"),
    ("pdense", "SELECT c.item_id, g.gene, coalesce(l.v, 0) AS v FROM vcells c CROSS JOIN (SELECT DISTINCT gene FROM lognorm JOIN vcells USING (cell_id)) g LEFT JOIN lognorm l ON l.cell_id = c.cell_id AND l.gene = g.gene"),
    ("pz", f"SELECT item_id, gene, {_z('v', 'gene')} AS z FROM pdense WINDOW w AS (PARTITION BY gene)"),
    ("py", "SELECT f, gene AS t, list(z ORDER BY item_id) AS y FROM pz JOIN pfold USING (item_id) JOIN pg ON fold <> f GROUP BY f, gene"),
    ("prhs", f"SELECT c.f, t, list({_dot('c.c', 'y')} ORDER BY i) AS b FROM pcol c JOIN py USING (f) GROUP BY c.f, t"),
    ("pcg", _conjugate("pcg", "pmat", "prhs", 200)),
    ("pw", "SELECT f, t, arg_max(w, k) AS w FROM pcg GROUP BY f, t"),
    ("pred", f"SELECT r.item_id, t AS gene, {_dot('x', 'w')} AS v FROM prow r JOIN pfold USING (item_id) JOIN pw ON pw.f = fold"),
    ("pmark", "SELECT item_id, lineage_ord, lineage, avg(v) AS score FROM pred JOIN markers USING (gene) GROUP BY ALL"),
    ("pranked", "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, lineage_ord) AS r FROM pmark"),
    ("ptype", f"SELECT a.item_id, CASE WHEN a.score > {S.type_threshold} AND a.score - b.score >= {S.type_margin} THEN a.lineage ELSE 'unknown' END AS cell_type FROM pranked a JOIN pranked b ON a.item_id = b.item_id AND a.r = 1 AND b.r = 2"),
    ("pstate", f"SELECT item_id, avg(v) AS s FROM pred WHERE gene IN ({', '.join(map(str, STATE_GENES))}) GROUP BY 1"),
    ("pcomp", "SELECT c.item_id, " + ", ".join(f"avg((t.cell_type = '{x}')::INT::DOUBLE) AS frac_{x}" for x in LINEAGES) + " FROM vknn k JOIN vcells c ON c.cell_id = k.cell_id JOIN vcells n ON n.cell_id = k.nbr_id JOIN ptype t ON t.item_id = n.item_id WHERE k.cell_id <> k.nbr_id GROUP BY 1"),
)
_hexid = lambda c: f"CAST('0x' || substr(md5({c}), 1, 11) AS BIGINT)"
_byte = f"CAST(floor(({h('cell_id * 3 + i % 7', 5)} + 0.5) / 2147483647.0::DOUBLE * (40 + (i * 29) % 200)) AS INT)"
_pix = f"SELECT cell_id, i, i % 3 AS ch, (i // 3) % 8 AS col, i // 24 AS r, {_byte} AS v FROM cells, range(192) AS t(i)"
#: Stain vectors and their strongest concentrations, before and after.
STAIN_SOURCE = (np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]]), np.array([1.9, 1.2]))
STAIN_TARGET = (np.array([[0.56, 0.22], [0.72, 0.80], [0.41, 0.56]]), np.array([1.5, 1.0]))


def _stain() -> str:
    solve, scale, ref = np.linalg.pinv(STAIN_SOURCE[0]), STAIN_TARGET[1] / (STAIN_SOURCE[1] + 1e-8), STAIN_TARGET[0]
    od = "SELECT cell_id, i // 3 AS px, " + ", ".join(f"max(CASE WHEN ch = {c} THEN -ln((v + 1) / 256.0::DOUBLE) END) AS o{c}" for c in range(3)) + " FROM pix GROUP BY ALL"
    conc = "SELECT cell_id, px, " + ", ".join("(" + " + ".join(f"({float(solve[k, c])!r}) * o{c}" for c in range(3)) + f") * {float(scale[k])!r} AS c{k}" for k in range(2)) + f" FROM ({od})"
    out = " UNION ALL ".join(f"SELECT cell_id, px * 3 + {c} AS i, CAST(floor(least(255.0, greatest(0.0, 256 * exp(-(({float(ref[c, 0])!r}) * c0 + ({float(ref[c, 1])!r}) * c1))))) AS BIGINT) AS v FROM conc" for c in range(3))
    return f"WITH cells AS ({CTE['cells']}), pix AS ({_pix}), conc AS ({conc}) SELECT cell_id, sum(v)::BIGINT AS total, sum(v * (i % 97))::BIGINT AS weighted FROM ({out}) GROUP BY 1"


def _stain_fit(rounds: int = 24) -> str:
    """Stain vectors by squaring the covariance of densities until one direction is left, angles between percentiles, and concentrations by normal equations."""
    square = {"rr": "rr * rr + rg * rg + rb * rb", "rg": "rr * rg + rg * gg + rb * gb", "rb": "rr * rb + rg * gb + rb * bb", "gg": "rg * rg + gg * gg + gb * gb", "gb": "rg * rb + gg * gb + gb * bb", "bb": "rb * rb + gb * gb + bb * bb"}
    power = lambda name, m, start: (
        f"{name}p AS (SELECT 0 AS k, rr, rg, rb, gg, gb, bb FROM {m} UNION ALL SELECT k + 1, rr / t, rg / t, rb / t, gg / t, gb / t, bb / t FROM (SELECT *, rr + gg + bb AS t FROM (SELECT k, {', '.join(f'{e} AS {n}' for n, e in square.items())} FROM {name}p WHERE k < {rounds}))), "
        f"{name} AS (SELECT p / sqrt(p * p + q * q + s * s) AS a, q / sqrt(p * p + q * q + s * s) AS b, s / sqrt(p * p + q * q + s * s) AS c FROM (SELECT rr * {start[0]} + rg * {start[1]} + rb * {start[2]} AS p, rg * {start[0]} + gg * {start[1]} + gb * {start[2]} AS q, rb * {start[0]} + gb * {start[1]} + bb * {start[2]} AS s FROM {name}p WHERE k = {rounds}))"
    )
    last = lambda name: f"(SELECT a * CASE WHEN a < 0 THEN -1 ELSE 1 END AS a, b * CASE WHEN a < 0 THEN -1 ELSE 1 END AS b, c * CASE WHEN a < 0 THEN -1 ELSE 1 END AS c FROM {name})"
    ctes = [
        f"cells AS ({CTE['cells']})",
        f"pix AS ({_pix})",
        "od AS (SELECT " + ", ".join(f"max(CASE WHEN ch = {k} THEN -ln((v + 1) / 256.0::DOUBLE) END) AS {n}" for k, n in enumerate("rgb")) + " FROM pix GROUP BY cell_id, i // 3)",
        "dark AS (SELECT * FROM od WHERE r >= 0.15 AND g >= 0.15 AND b >= 0.15)",
        "m1 AS (SELECT " + ", ".join(f"covar_samp({x[0]}, {x[1]}) AS {x}" for x in ("rr", "rg", "rb", "gg", "gb", "bb")) + " FROM dark)",
        power("e1", "m1", (0.6, 0.5, 0.4)),
        f"f1 AS {last('e1')}",
        "top AS (SELECT a * (rr * a + rg * b + rb * c) + b * (rg * a + gg * b + gb * c) + c * (rb * a + gb * b + bb * c) AS l FROM f1, m1)",
        "m2 AS (SELECT rr - l * a * a AS rr, rg - l * a * b AS rg, rb - l * a * c AS rb, gg - l * b * b AS gg, gb - l * b * c AS gb, bb - l * c * c AS bb FROM m1, f1, top)",
        power("e2", "m2", (0.7, -0.5, 0.3)),
        f"f2 AS {last('e2')}",
        "ang AS (SELECT atan2(r * f2.a + g * f2.b + dark.b * f2.c, r * f1.a + g * f1.b + dark.b * f1.c) AS t FROM dark, f1, f2)",
        "lim AS (SELECT unnest([0, 1]) AS j, unnest([quantile_cont(t, 0.01), quantile_cont(t, 0.99)]) AS t FROM ang)",
        "raw AS (SELECT j, f1.a * cos(t) + f2.a * sin(t) AS x, f1.b * cos(t) + f2.b * sin(t) AS y, f1.c * cos(t) + f2.c * sin(t) AS z FROM lim, f1, f2)",
        "unitv AS (SELECT j, x / (sqrt(x * x + y * y + z * z) + 1e-8) AS x, y / (sqrt(x * x + y * y + z * z) + 1e-8) AS y, z / (sqrt(x * x + y * y + z * z) + 1e-8) AS z FROM raw)",
        "he AS (SELECT CAST(row_number() OVER (ORDER BY x DESC, j) - 1 AS INT) AS stain, x, y, z FROM unitv)",
        "n AS (SELECT p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, p.x * p.x + p.y * p.y + p.z * p.z AS pp, p.x * q.x + p.y * q.y + p.z * q.z AS pq, q.x * q.x + q.y * q.y + q.z * q.z AS qq FROM he p, he q WHERE p.stain = 0 AND q.stain = 1)",
        "conc AS (SELECT (qq * u - pq * w) / (pp * qq - pq * pq) AS c0, (pp * w - pq * u) / (pp * qq - pq * pq) AS c1 FROM (SELECT n.*, px * r + py * g + pz * b AS u, qx * r + qy * g + qz * b AS w FROM dark, n))",
        "tops AS (SELECT unnest([0, 1]) AS stain, unnest([quantile_cont(c0, 0.99), quantile_cont(c1, 0.99)]) AS v FROM conc)",
    ]
    return "WITH RECURSIVE " + ", ".join(ctes) + f" SELECT stain, {r6('x')} AS r, {r6('y')} AS g, {r6('z')} AS b, {r6('v')} AS top FROM he JOIN tops USING (stain)"


def _statistics() -> str:
    flat = ["avg(v)", "stddev_pop(v)", "median(v)", "min(v)::DOUBLE", "max(v)::DOUBLE", "quantile_cont(v, 0.25)", "quantile_cont(v, 0.75)"]
    parts = [f"SELECT cell_id, {3 * k + 1} + ch AS d, {e} AS v FROM pix GROUP BY cell_id, ch" for k, e in enumerate(flat)]
    for k, (dr, dc) in enumerate(((1, 0), (0, 1)), len(flat)):
        parts.append(f"SELECT a.cell_id, {3 * k + 1} + a.ch AS d, avg(abs(b.v - a.v)) AS v FROM pix a JOIN pix b ON b.cell_id = a.cell_id AND b.ch = a.ch AND b.r = a.r + {dr} AND b.col = a.col + {dc} GROUP BY a.cell_id, a.ch")
    return f"WITH cells AS ({CTE['cells']}), pix AS ({_pix}) SELECT cell_id, d::BIGINT AS d, floor(v * 1e3 + 0.5) / 1e3 AS v FROM (" + " UNION ALL ".join(parts) + ")"


SQL: dict[str, str] = {
    "cell_qc_filter": with_("SELECT c_custkey AS cell_id, total AS transcript_counts, abs(c_acctbal) AS cell_area FROM customer JOIN totals ON cell_id = c_custkey WHERE total >= 1000 AND abs(c_acctbal) >= 100"),
    "align_left_anti": with_("SELECT cell_id FROM cells WHERE cell_id NOT IN (SELECT cell_id FROM counts WHERE gene <= 3)"),
    "panel_intersection": "SELECT lineage, gene FROM (" + values((t, g) for t, gs in MARKERS.items() for g in gs) + ") AS m(lineage, gene) WHERE gene IN (SELECT CAST(substr(p_brand, 7) AS INT) FROM part WHERE p_size < 40 AND CAST(substr(p_brand, 7) AS INT) % 2 = 1)",
    "panel_dropped": "SELECT lineage, gene FROM (" + values((t, g) for t, gs in MARKERS.items() for g in gs) + ") AS m(lineage, gene) WHERE gene NOT IN (SELECT CAST(substr(p_brand, 7) AS INT) FROM part WHERE p_size < 40 AND CAST(substr(p_brand, 7) AS INT) % 2 = 1)",
    "library_totals": with_("SELECT cell_id, total FROM totals"),
    "lognorm_expression": with_(f"SELECT cell_id, gene, {r6('v')} AS v FROM lognorm"),
    "gene_stats": with_(f"SELECT gene, {r6('mu')} AS mu, {r6('sd')} AS sd FROM gstats"),
    "zscore_dense": with_(f"SELECT cell_id, gene, {r6('z')} AS z FROM z"),
    "marker_scores": with_(f"SELECT cell_id, lineage, {r6('score')} AS score FROM mscores"),
    "wide_scores": with_("SELECT cell_id, " + ", ".join(f"{r6(f'max(CASE WHEN lineage = {chr(39)}{t}{chr(39)} THEN score END)')} AS score_{t}" for t in LINEAGES) + " FROM mscores GROUP BY 1"),
    "cell_types": with_(f"SELECT cell_id, cell_type, {r6('cell_type_score')} AS cell_type_score, {r6('cell_type_margin')} AS cell_type_margin FROM types"),
    "cell_type_counts": with_("SELECT cell_type, count(*) AS n FROM types GROUP BY 1"),
    "proliferation_flag": with_(f"SELECT cell_id, {r6('proliferation_score')} AS proliferation_score, is_proliferating FROM state"),
    "dataset_stats": with_(
        "SELECT 'dataset' AS stat, 'dataset' AS value UNION ALL SELECT 'sample', 'sample' UNION ALL SELECT 'n_cells_raw', CAST((SELECT count(*) FROM cells) AS VARCHAR) UNION ALL SELECT 'n_cells_qc', CAST((SELECT count(*) FROM qc) AS VARCHAR)"
        " UNION ALL SELECT 'n_genes_panel', CAST((SELECT count(DISTINCT gene) FROM counts) AS VARCHAR) UNION ALL SELECT 'median_transcripts', CAST((SELECT median(total) FROM qc) AS VARCHAR)"
        " UNION ALL SELECT 'n_proliferating', CAST((SELECT count(*) FROM state JOIN qc USING (cell_id) WHERE is_proliferating) AS VARCHAR)"
        + "".join(f" UNION ALL SELECT 'n_{t}', CAST((SELECT count(*) FROM types JOIN qc USING (cell_id) WHERE cell_type = '{t}') AS VARCHAR)" for t in [*LINEAGES, "unknown"])
        + "".join(f" UNION ALL SELECT 'n_niche_{n}', CAST((SELECT count(*) FROM niches JOIN qc USING (cell_id) WHERE niche_{n}) AS VARCHAR)" for n in NICHES),
        ("qc", f"SELECT cell_id, total FROM totals WHERE total >= {S.min_counts}"),
    ),
    "knn_edges": with_(f"SELECT cell_id, nbr_id, {r6('d2')} AS d2, rnk::INT AS rnk FROM knn"),
    "knn_composition": with_(f"SELECT cell_id, {_fracs} FROM comp"),
    "niche_labels": with_(f"SELECT cell_id, {_niche_cols}, niche_label FROM niches"),
    "radius_edges": with_(f"SELECT cell_id, nbr_id, {r6('d2')} AS d2 FROM near"),
    "radius_composition": with_(f"SELECT cell_id, {_fracs} FROM radius_comp"),
    "neighbor_average": with_(
        f"SELECT cell_id, d, {r6('avg(v)')} AS v FROM (SELECT e.cell_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM (SELECT cell_id, nbr_id FROM knn WHERE rnk <= 5 UNION ALL SELECT cell_id, cell_id FROM cells) e JOIN embeddings ON vec_id = nbr_id) GROUP BY ALL"
    ),
    "grid_folds": with_(f"SELECT cell_id, tile, CAST({h('tile')} % 5 AS INT) AS fold FROM tiles", ("tiles", _tile)),
    "fold_sizes": with_("SELECT fold::INT AS fold, count(*) AS n FROM cfold GROUP BY 1", ("cfold", _cfold)),
    "buffer_exclusion": with_(
        "SELECT a.cell_id FROM cells a JOIN cfold f ON f.cell_id = a.cell_id AND f.fold <> 0 WHERE NOT EXISTS (SELECT 1 FROM cells b JOIN cfold g ON g.cell_id = b.cell_id AND g.fold = 0 WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 400.0)",
        ("cfold", _cfold),
    ),
    "scale_pixels": with_(f"SELECT cell_id, {r6('x / 0.363788')} AS px, {r6('y / 0.363788')} AS py FROM cells"),
    "affine_pixels": with_(f"SELECT cell_id, {r6('(x * 0.9 + y * 0.1 + 5.0) / (x * 0.0001 + y * 0.0 + 1.0)')} AS px, {r6('(x * -0.1 + y * 0.9 + -3.0) / (x * 0.0001 + y * 0.0 + 1.0)')} AS py FROM cells"),
    "stratified_pool": with_("SELECT cell_id, cell_type, pool_idx FROM small_pool"),
    "kfold_assign": with_("SELECT item_id, fold::INT AS fold FROM folds", ("folds", _folds)),
    "uniform_subset": with_(f"SELECT cell_id FROM cells ORDER BY {h('cell_id', 3)}, cell_id LIMIT 50"),
    "l2_normalize": with_(f"SELECT item_id, d, {r6('v')} AS v FROM dims"),
    "cosine_scores": with_(f"SELECT query_id, item_id, {r6('score')} AS score FROM cos"),
    "cosine_topk": with_(f"SELECT query_id, item_id, {r6('score')} AS score, rnk::INT AS rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rnk FROM cos) WHERE rnk <= 15"),
    "kmeans_regions": _regions(),
    "feature_knn": with_(f"SELECT item_id, nbr_id, {r6('d2')} AS d2, rnk FROM vnear"),
    "neighbour_weights": with_(f"SELECT src, dst, {r6('w')} AS w FROM vweights"),
    "graph_modularity": with_(f"SELECT {r6('sum(CASE WHEN a = b THEN w ELSE 0 END) / sum(w) - 0.5 * (SELECT sum(k * k) FROM (SELECT sum(w) AS k FROM (SELECT a AS c, w FROM vends UNION ALL SELECT b, w FROM vends) GROUP BY c)) / (4 * sum(w) * sum(w))')} AS q FROM vends"),
    "component_spectrum": with_(
        f"SELECT count(*) FILTER (g = h) AS n_components, {r6('sum(c) FILTER (g = h)')} AS total, {r6('sum(c * c)')} AS squared FROM zcov",
        ("zcut", "SELECT cell_id, gene, z - avg(z) OVER (PARTITION BY gene) AS z FROM (SELECT cell_id, gene, least(z, 10) AS z FROM z)"),
        ("zcov", "SELECT a.gene AS g, b.gene AS h, avg(a.z * b.z) AS c FROM zcut a JOIN zcut b USING (cell_id) GROUP BY ALL"),
    ),
    "hash_text_features": with_(f"SELECT query_id, {_bucket} AS bucket, count(*) AS n FROM (SELECT query_id, unnest(regexp_split_to_array(lower(query_text), '\\s+')) AS w FROM qs) GROUP BY ALL"),
    "prompt_ensemble": with_(f"SELECT query_id, d, {r6('m / greatest(sqrt(sum(m * m) OVER (PARTITION BY query_id)), 1e-8)')} AS v FROM pmean", ("prompts", _prompts), ("pwords", _words), ("pvec", _pvec), ("punit", _punit), ("pmean", _pmean)),
    "zero_shot_scores": with_(
        f"SELECT z.baseline, query_id, item_id, {r6('sum(q * v) / greatest(sqrt(sum(q * q)), 1e-8) / greatest(sqrt(sum(v * v)), 1e-8)')} AS score FROM zq z JOIN zitems i ON i.baseline = z.baseline AND i.d = z.d + 1 GROUP BY ALL",
        ("prompts", _prompts), ("ztexts", _ztexts), ("zwords", _zwords), ("zvec", _zvec), ("zunit", _zunit), ("zq", _zq), ("vcells", _vcells), ("vknn", _vknn), ("vdims", _vdims), ("zitems", _zitems),
    ),
    "mixed_blocks": with_(
        f"SELECT cell_id, (row_number() OVER (PARTITION BY cell_id ORDER BY ord, d))::BIGINT AS d, {r6('v / greatest(sqrt(sum(v * v) OVER (PARTITION BY cell_id, ord)), 1e-8)')} AS v FROM mixed",
        ("vcells", _vcells), ("mraw", _mraw), ("mnear", _mnear), ("mixed", _mixed),
    ),
    "feature_variants": f"SELECT spec, count(*) AS n_blocks FROM ({_specs}) AS s(spec, block) GROUP BY 1 HAVING bool_and(block IN ({', '.join(repr(b) for b in HAVE)}))",
    "assemble_blocks": f"SELECT vec_id AS item_id, 192 AS n, {r6('embedding[1]::DOUBLE')} AS first, {r6('2 * embedding[1]::DOUBLE')} AS second, {r6('3 * embedding[64]::DOUBLE')} AS last FROM embeddings",
    "query_set": with_("SELECT query_id, query_text, target_field, target_label, task_type, level, split FROM qs"),
    "query_set_counts": with_("SELECT task_type, split, count(*) AS n FROM qs GROUP BY ALL"),
    "relevance": with_("SELECT query_id, item_id, rel FROM rel"),
    "oracle_scores": with_(f"SELECT query_id, item_id, {r6('score')} AS score FROM oscores"),
    "random_scores": with_(f"SELECT query_id, item_id, {r6('score')} AS score FROM rscores"),
    "rank_metrics": with_("SELECT * FROM emb_metrics"),
    "metrics_per_query": with_("SELECT * FROM pool_metrics"),
    "metrics_main": with_(f"SELECT baseline, {_means(how=_even)} FROM per_query GROUP BY 1"),
    "metrics_by_split": with_(f"SELECT baseline, split, {_means()} FROM per_query GROUP BY ALL"),
    "metrics_by_task": with_(f"SELECT baseline, task_type, {_means()} FROM per_query GROUP BY ALL"),
    "metrics_grouping_sets": with_(f"SELECT baseline, split, task_type, {_means()} FROM per_query GROUP BY GROUPING SETS ((baseline), (baseline, split), (baseline, task_type))"),
    "metrics_ablation": with_(f"SELECT baseline, {_means(how=_even)} FROM emb_metrics WHERE baseline <> 'random' GROUP BY 1"),
    "majority_vote": with_("SELECT cluster, cell_type, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cell_type) AS r FROM (SELECT cell_id % 12 AS cluster, cell_type, count(*) AS n FROM types GROUP BY ALL)) WHERE r = 1"),
    "agreement_matrix": with_(f"SELECT cell_type, niche_label, n, {r6('n / sum(n) OVER (PARTITION BY cell_type)')} AS share FROM (SELECT cell_type, niche_label, count(*) AS n FROM types JOIN niches USING (cell_id) GROUP BY ALL)"),
    "bootstrap_ci": with_(f"SELECT baseline, {r11('avg(v.value)')} AS mean, {r11('any_value(lo)')} AS lo, {r11('any_value(hi)')} AS hi FROM vals v JOIN (SELECT baseline, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM boots GROUP BY 1) USING (baseline) GROUP BY 1", *_draws, ("boots", _boots)),
    "paired_bootstrap": with_(
        f"SELECT d.baseline, {r11('avg(d.value)')} AS diff, {r11('any_value(lo)')} AS lo, {r11('any_value(hi)')} AS hi, {r11('any_value(p)')} AS p_value, any_value(CASE WHEN p < 1e-3 THEN '***' WHEN p < 1e-2 THEN '**' WHEN p < 5e-2 THEN '*' ELSE 'ns' END) AS sig FROM diffs d JOIN (SELECT baseline, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, {_P} AS p FROM dboots GROUP BY 1) USING (baseline) GROUP BY 1",
        *_draws, ("diffs", _diffs), ("dboots", _dboots),
    ),
    "significance_table": with_("SELECT method, " + ", ".join(f'"{m}"' + (f', "{m}_sig"') for m in ("mAP", "nDCG@10", "enrich@10")) + " FROM sig", *_sig),
    "latex_lines": with_(
        "SELECT CAST(row_number() OVER (ORDER BY part, ord) - 1 AS INT) AS line, tex FROM (SELECT * FROM (" + values((0, i, x) for i, x in enumerate(LATEX[0])) + ") AS a(part, ord, tex) UNION ALL SELECT * FROM (" + values((2, i, x) for i, x in enumerate(LATEX[1])) + ") AS b(part, ord, tex)"
        " UNION ALL SELECT 1, ord, CASE WHEN baseline = 'cellseek' THEN '\\textbf{' || method || '}' ELSE method END || ' & ' || " + " || ' & ' || ".join(f"\"{m}\" || CASE WHEN coalesce(\"{m}_sig\", 'ns') = 'ns' THEN '' ELSE '\\textsuperscript{{' || \"{m}_sig\" || '}}' END" for m in ("mAP", "enrich@10")) + " || ' \\\\' FROM sig)",
        *_sig,
    ),
    "ridge_oof_2d": with_(
        f"SELECT item_id, {r6('my + (say * sbb - sby * sab) / (saa * sbb - sab * sab) * (a - ma) + (sby * saa - say * sab) / (saa * sbb - sab * sab) * (b - mb)')} AS score FROM feat JOIN train USING (fold)",
        ("folds", _folds), ("feat", _feat), ("train", _train),
    ),
    "csc_counts": "SELECT o_custkey AS cell_id, 'brand' || g AS gene, cnt FROM (SELECT o_custkey, CAST(substr(p_brand, 7) AS INT) AS g, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE g <= 22",
    "pixel_size": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 7) / 8.0::DOUBLE + 0.125 ELSE 0.363788 END AS um FROM events",
    "expression_r2": with_(f"SELECT {r6('1 - sum((v - g) * (v - g)) / sum((v - m) * (v - m))')} AS r2 FROM (SELECT v, 0.5 * v + 0.1 AS g, avg(v) OVER (PARTITION BY gene) AS m FROM lognorm)"),
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stain_density": f"SELECT {r6('avg(-ln(((o_orderkey * 31) % 256 + 1.0) / 256.0))')} AS r, {r6('avg(-ln(((o_orderkey * 17) % 256 + 1.0) / 256.0))')} AS g, {r6('covar_samp(-ln(((o_orderkey * 31) % 256 + 1.0) / 256.0), -ln(((o_orderkey * 17) % 256 + 1.0) / 256.0))')} AS rg FROM orders",
    "logistic_oof_2d": with_(f"SELECT item_id, query_id, {r6('score')} AS score FROM logit", ("folds", _folds), *_oof),
    "transfer_2d": with_(f"SELECT item_id, query_id, {r6('score')} AS score FROM logit", *_transfer),
    "scheme_scores_2d": with_("SELECT scheme, query_id, item_id, score FROM sscores", *_schemes),
    "scheme_report_2d": with_(
        f"SELECT scheme, {r6('avg(e)')} AS overall, {r6(chr(34) + 'low' + chr(34))} AS cell_type, {r6('even')} AS niche, 0.0::DOUBLE AS gene_marker, 0.0::DOUBLE AS cell_state FROM (SELECT scheme, \"enrich@10\" AS e, max(CASE WHEN query_id = 'low' THEN \"enrich@10\" END) OVER (PARTITION BY scheme) AS low, max(CASE WHEN query_id = 'even' THEN \"enrich@10\" END) OVER (PARTITION BY scheme) AS even FROM sm) GROUP BY scheme, low, even",
        *_schemes, ("sm", _metrics("sscores", "srel", "scheme, query_id")),
    ),
    "ridge_oof": with_(
        f"SELECT item_id, cw.t::INT AS target, CASE WHEN my > 0 THEN {r6('my + ' + _dot('w', 'list_transform(list_zip(x, mx), lambda z: z[1] - z[2])'))} ELSE 0.0 END AS score FROM rx JOIN cw ON cw.f = rx.fold JOIN rmx ON rmx.f = rx.fold JOIN rmy ON rmy.f = cw.f AND rmy.t = cw.t",
        *_ridge,
    ),
    "label_purity": with_(
        f"SELECT {r6('any_value(purity)')} AS purity, {r6('sum(p * ln(n * t / (na * nb))) / ((-sum(p * ln(na / t)) - sum(p * ln(nb / t))) / 2)')} AS nmi FROM (SELECT *, n / t AS p FROM lcounts), (SELECT sum(mx) / sum(s) AS purity FROM (SELECT cluster, max(n) AS mx, sum(n) AS s FROM lcounts GROUP BY 1))",
        ("lcounts", "SELECT cell_type, cluster, n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY cell_type) AS na, sum(n) OVER (PARTITION BY cluster) AS nb FROM (SELECT cell_type, floor(cell_type_score * 4) + cell_id % 2 AS cluster, count(*)::DOUBLE AS n FROM types GROUP BY ALL)"),
    ),
    "cells_csv": with_(f"SELECT CAST(cell_id AS VARCHAR) AS cell_id, {r6('x')} AS x_centroid, {r6('y')} AS y_centroid, 7.0::DOUBLE AS transcript_counts, {r6('abs(x)')} AS cell_area, 'a,b' AS region FROM cells"),
    "string_id_folds": with_(
        f"SELECT cell_id, CAST((row_number() OVER (ORDER BY {h(_hexid('cell_id'))}, cell_id) - 1) % 5 AS INT) AS fold, nbr_id FROM sc JOIN (SELECT CAST(cell_id AS VARCHAR) AS cell_id, arg_min(CAST(nbr_id AS VARCHAR), (d2, CAST(nbr_id AS VARCHAR))) AS nbr_id FROM pairs GROUP BY 1) USING (cell_id)",
        ("sc", "SELECT CAST(cell_id AS VARCHAR) AS cell_id FROM cells"),
    ),
    "string_id_pool": with_(
        f"SELECT cell_id, cell_type, row_number() OVER (ORDER BY cell_id) - 1 AS pool_idx FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY {h(_hexid('cell_id'))}, cell_id) AS r, count(*) OVER (PARTITION BY cell_type) AS len, count(*) OVER () AS n FROM sc) WHERE n <= 300 OR r <= least(len, greatest(1, round_even(300.0::DOUBLE * len / n, 0)))",
        ("sc", "SELECT CAST(cell_id AS VARCHAR) AS cell_id, CASE WHEN x > 5000 THEN 'far' ELSE 'near' END AS cell_type FROM cells"),
    ),
    "boundaries_csv": with_(f"SELECT CAST(cell_id AS VARCHAR) AS cell_id, 3::BIGINT AS n, {r6('x')} AS x0, {r6('y + 2')} AS y1 FROM cells"),
    "queries_csv": with_("SELECT query_id, query_text, target_field, target_label, task_type, level, split FROM qs"),
    "processed_tables": with_(
        f"SELECT 'cells' AS part, count(*) AS n, {r6('sum(y)')} AS total FROM cells UNION ALL SELECT 'expression', count(*), {r6('sum(cnt)')} FROM counts UNION ALL SELECT 'genes', count(*), sum(gene)::DOUBLE FROM (SELECT DISTINCT gene FROM counts)"
    ),
    "stored_scores": with_("SELECT baseline, query_id, item_id, score FROM escores"),
    "stored_embeddings": f"SELECT vec_id AS cell_id, generate_subscripts(embedding, 1) AS d, unnest(list_transform(embedding, lambda v: {r6('v::DOUBLE * 3')})) AS v FROM embeddings",
    "rounded_report": f"SELECT o_orderkey, {_even('(o_orderkey * 7919 % 100003) / 32768.0::DOUBLE')} AS value FROM orders",
    "pyramid_levels": "SELECT event_id, CAST(4096 >> least(event_id % 7, event_id % 5) AS INT) AS h, CAST(8192 >> least(event_id % 7, event_id % 5) AS INT) AS w FROM events",
    "chosen_variant": "SELECT * FROM (VALUES (0, 'cellseek_all'), (1, 'cellseek_full'), (2, NULL)) AS v(i, spec)",
    "settings_table": "SELECT * FROM ("
    + values([("dataset", "tissue"), ("sample", "s1"), ("seed", "3"), ("min_counts", "12"), ("k", "7"), ("use", "radius"), ("radius", "50.0"), ("pool_size", "9"), ("stratify", "False"), ("ks", "(1, 2)"), ("ndcg_k", "10"), ("type_margin", "0.1"), ("vascular", "0.2"), ("bcell_rich", "0.15"), ("tables", "out/tables")])
    + ") AS v(field, value)",
    "fetched_file": "SELECT i, i = 0 AS fetched, 5000::BIGINT AS size, FALSE AS part_left FROM (VALUES (0), (1)) AS v(i)",
    "encoder_registry": "SELECT * FROM (VALUES ('biomedclip', 'biomedclip', TRUE, TRUE), ('bmc', 'biomedclip', TRUE, TRUE), ('plip', 'plip', TRUE, TRUE), ('uni', 'uni2', FALSE, FALSE), ('uni2', 'uni2', FALSE, FALSE), ('uni2-h', 'uni2', FALSE, FALSE), "
    "('gigapath', 'gigapath', FALSE, FALSE), ('prov-gigapath', 'gigapath', FALSE, FALSE), ('hash', 'hash', TRUE, FALSE), ('random', 'hash', TRUE, FALSE), ('fallback', 'hash', TRUE, FALSE)) AS v(name, encoder, has_text, unit)",
    "patch_statistics": _statistics(),
    "stain_applied": _stain(),
    "pixel_sample": f"WITH cells AS ({CTE['cells']}), pix AS ({_pix}), few AS (SELECT cell_id FROM cells ORDER BY {h('cell_id', 5)}, cell_id LIMIT 40) SELECT count(*) // 3 AS n, " + ", ".join(f"sum(CASE WHEN ch = {c} THEN v ELSE 0 END)::BIGINT AS {n}" for c, n in enumerate("rgb")) + " FROM pix JOIN few USING (cell_id)",
    "patch_crops": "WITH w AS (SELECT c_custkey AS cell_id, (c_custkey * 37) % 260 - 16 + dx AS gx, (c_custkey * 53) % 260 - 16 + dy AS gy, ch, (dy * 32 + dx) * 3 + ch AS j FROM customer, range(32) AS a(dx), range(32) AS b(dy), range(3) AS c(ch)), "
    "v AS (SELECT cell_id, j, CASE WHEN gx BETWEEN 0 AND 255 AND gy BETWEEN 0 AND 255 THEN (((gy % 64) * 64 + gx % 64) * 3 + ch + (gx // 64) * 7 + (gy // 64) * 13) % 251 ELSE 0 END AS v FROM w) "
    "SELECT cell_id, 32 AS h, 32 AS w, sum(v)::BIGINT AS total, sum(v * (j % 97))::BIGINT AS weighted FROM v GROUP BY 1",
    "tiff_levels": "SELECT * FROM (VALUES ('a.tif', 0, 96, 80, 0.25::DOUBLE, TRUE), ('a.tif', 1, 48, 40, 0.25, TRUE), ('b.tif', 0, 70, 64, 0.363788, TRUE), ('b.tif', 1, 35, 32, 0.363788, TRUE), ('c.tif', 0, NULL, NULL, 0.363788, FALSE)) AS v(file, level, h, w, um, ok)",
    "tiff_tiles": "WITH f AS (SELECT * FROM (VALUES ('a.tif', 48, 40), ('b.tif', 35, 32)) AS v(file, fh, fw)), px AS (SELECT file, y // 32 AS ty, x // 32 AS tx, least(32, fh - y // 32 * 32) AS h, least(32, fw - x // 32 * 32) AS w, y % 32 AS iy, x % 32 AS ix, c, (y * 7 + x * 11 + c) % 251 AS v FROM f, range(64) AS a(y), range(64) AS b(x), range(3) AS d(c) WHERE y < fh AND x < fw) "
    "SELECT file || ' 1 ' || ty || ' ' || tx AS tile, h::INT AS h, w::INT AS w, sum(v)::BIGINT AS total, sum(v * (((iy * w + ix) * 3 + c) % 97))::BIGINT AS weighted FROM px GROUP BY ALL",
    "celltype_map": with_(
        f"SELECT cell_id, {r6('x')} AS x, {r6('y')} AS y, layer, color, cell_type || ' (' || count(*) OVER (PARTITION BY cell_type) || ')' AS label FROM cells JOIN types USING (cell_id) JOIN (" + values((t, i, TYPE_COLORS[t]) for i, t in enumerate([*LINEAGES, "unknown"])) + ") AS c(cell_type, layer, color) USING (cell_type)"
    ),
    "niche_map": with_(f"SELECT cell_id, {r6('x')} AS x, {r6('y')} AS y, niche_tcell_rich::INT AS layer, CASE WHEN niche_tcell_rich THEN '#d62728' ELSE '#e8e8e8' END AS color FROM cells JOIN niches USING (cell_id)"),
    "query_heatmap": with_(
        f"SELECT query_id, item_id, {r6('x')} AS x, {r6('y')} AS y, score, rel, row_number() OVER w <= 20 AS is_top, count(*) OVER (PARTITION BY query_id) - row_number() OVER w AS z, FROM (SELECT * FROM escores WHERE baseline = 'biomedclip') JOIN erel USING (query_id, item_id) LEFT JOIN cells ON cell_id = item_id WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, item_id) QUALIFY x IS NOT NULL"
    ),
    "retrieval_examples": with_(
        "SELECT query_id, item_id, CAST(r // 8 AS INT) AS grid_row, CAST(r % 8 AS INT) AS grid_col, printf('#%d %.3f', r + 1, score) AS title, CASE WHEN rel THEN 'green' ELSE 'red' END AS color FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS r FROM escores WHERE baseline = 'biomedclip') JOIN erel USING (query_id, item_id) WHERE r < 16"
    ),
    "feature_scaling": f"WITH x AS (SELECT vec_id AS item_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT item_id, d, {r6('(v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w > 0 THEN stddev_pop(v) OVER w ELSE 1 END')} AS v, 'population' AS kind FROM x WINDOW w AS (PARTITION BY d) UNION ALL SELECT item_id, d, {r6('(v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-6)')}, 'sample' FROM x WINDOW w AS (PARTITION BY d)",
    "hdf5_counts": "SELECT 'cell' || o_custkey AS cell_id, 'brand' || g AS gene, cnt FROM (SELECT o_custkey, CAST(substr(p_brand, 7) AS INT) AS g, sum(l_quantity) AS cnt FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE g <= 22 AND o_custkey % 3 = 0",
    "openvocab_oof_2d": with_(f"SELECT item_id, query_id, {r6('score')} AS score FROM oscore", *_cosine_map()),
    "resized_crops": "WITH w AS (SELECT c_custkey AS cell_id, (c_custkey * 37) % 260 - 16 + dx AS gx, (c_custkey * 53) % 260 - 16 + dy AS gy, ch, (dy // 2 * 16 + dx // 2) * 3 + ch AS j FROM customer, range(32) AS a(dx), range(32) AS b(dy), range(3) AS c(ch)), "
    "v AS (SELECT cell_id, j, CAST(round_even(avg(CASE WHEN gx BETWEEN 0 AND 255 AND gy BETWEEN 0 AND 255 THEN (((gy % 64) * 64 + gx % 64) * 3 + ch + (gx // 64) * 7 + (gy // 64) * 13) % 251 ELSE 0 END), 0) AS BIGINT) AS v FROM w GROUP BY ALL) "
    "SELECT cell_id, 16 AS h, 16 AS w, sum(v)::BIGINT AS total, sum(v * (j % 97))::BIGINT AS weighted FROM v GROUP BY 1",
    "predicted_expression": with_(
        f"SELECT query_id, c.item_id, {r6(f'CASE target_field WHEN {chr(39)}cell_type{chr(39)} THEN m.score WHEN {chr(39)}cell_state{chr(39)} THEN s.s WHEN {chr(39)}gene{chr(39)} THEN coalesce(p.v, 0) ELSE CASE target_label {_niche_score} END END')} AS score FROM vcells c CROSS JOIN qs "
        "LEFT JOIN pmark m ON m.item_id = c.item_id AND m.lineage = target_label LEFT JOIN pstate s ON s.item_id = c.item_id LEFT JOIN pred p ON p.item_id = c.item_id AND p.gene = qs.gene LEFT JOIN pcomp f ON f.item_id = c.item_id",
        *_predicted,
    ),
    "mlp_oof_2d": with_(f"SELECT item_id, query_id, {r6('score')} AS score FROM oscore", *_network()),
    "mlp_dropout_2d": with_(f"SELECT item_id, query_id, {r6('score')} AS score FROM oscore", *_network(3, 0.1)),
    "stain_profile": _stain_fit(),
}
