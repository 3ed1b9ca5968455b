"""The other way to translocation chains: adjacency by breakpoint rates instead of fixed neighbours, and its own search."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.functions.stats import fisher_combine
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators.groups import map_groups
from karyoflux.operators.intervals import join_overlapping
from karyoflux.operators.variants import breakpoints, inter, nodes

STAT = "STAT_ADJACENCY"


def rates(sv: DataFrame, genome: DataFrame) -> DataFrame:
    """(sample_id, chrom, n_bp, mu): breakpoints a megabase of each chromosome, drawn to the sample's mean where there are few."""
    n = breakpoints(inter(sv)).groupBy("sample_id", "chrom").agg(F.count("*").alias("n_bp"))
    total = n.groupBy("sample_id").agg(F.sum("n_bp").alias("all_bp"))
    size = genome.select("chrom", "size", F.sum("size").over(Window.partitionBy(F.lit(1))).alias("genome"))
    g = total.crossJoin(F.broadcast(size)).join(n, ["sample_id", "chrom"], "left").withColumn("n_bp", F.coalesce("n_bp", F.lit(0)))
    mean = F.col("all_bp") / (F.col("genome") / 1e6)
    weight = F.least(F.col("n_bp") / 10, F.lit(1.0))
    return g.select("sample_id", "chrom", "n_bp", (weight * F.col("n_bp") / (F.col("size") / 1e6) + (1 - weight) * mean).alias("mu"))


def stat_edges(sv: DataFrame, genome: DataFrame, alpha: float = 0.01, max_distance: int = 10_000_000) -> DataFrame:
    """Pairs of nodes of a chromosome closer than chance at the chromosome's rate: p = 1 - (1 - 2 mu)^d under alpha.

    The p-value grows with distance, so the condition is a bound on the distance and the pairs are a band join.
    """
    n = nodes(sv).select("sample_id", "chrom", "pos").join(rates(sv, genome).select("sample_id", "chrom", "mu"), ["sample_id", "chrom"])
    base = F.log1p(-2 * F.col("mu") / 1e6)
    n = n.withColumn("bound", F.least(F.lit(float(max_distance)), F.lit(math.log1p(-alpha)) / base))
    other = nodes(sv).select("sample_id", "chrom", F.col("pos").alias("to_pos"))
    gap = F.col("to_pos") - F.col("pos")
    reach = (F.col("pos") + 1, F.col("pos") + F.floor("bound"))
    j = join_overlapping(n, other, ["sample_id", "chrom"], reach, (F.col("to_pos"), F.col("to_pos")))
    j = j.withColumn("distance", gap).withColumn("pvalue", -F.expm1(F.col("distance") * base)).where(F.col("pvalue") < alpha)
    return j.select("sample_id", "chrom", "pos", "to_pos", "distance", "pvalue")


def graph(sv: DataFrame, genome: DataFrame, cnv: DataFrame | None = None, alpha: float = 0.01) -> DataFrame:
    """Edges with pvalue; bridges reach breakpoints inside the lost segment only."""
    null = F.lit(None).cast("double")
    edges = cp.translocation_edges(sv).withColumn("pvalue", null)
    if cnv is not None:
        edges = edges.unionByName(cp.bridge_edges(sv, cnv, padding=0).withColumn("pvalue", null))
    s = stat_edges(sv, genome, alpha).select(
        "sample_id", cp.node_name(F.col("chrom"), F.col("pos")).alias("from_node"), cp.node_name(F.col("chrom"), F.col("to_pos")).alias("to_node"), F.lit(STAT).alias("edge_type"), F.lit(None).cast("long").alias("sv_no"),
        "distance", F.lit(1.0).alias("evidence_strength"), F.array(F.lit(2).cast("long"), F.ascii("chrom").cast("long"), F.col("pos"), F.col("to_pos")).alias("place"), "pvalue",
    )
    return edges.withColumn("place", F.transform("place", lambda x: x.cast("long"))).unionByName(s)


def search(edges: list[tuple[str, str, str, int | None]], min_chromosomes: int, min_translocations: int, max_paths: int, max_depth: int) -> list[dict]:
    """Chains by plain last-in search; a start's quota counts accepted chains, one for each set of nodes.

    Starts come in the order in which the variants (the translocations among the edges) name their ends. Steps that leave too few
    nodes for the translocations that a chain needs lead to none and aren't taken.
    """
    number: dict[str, int] = {}
    for a, b, _, _ in edges:
        number.setdefault(a, len(number))
        number.setdefault(b, len(number))
    order = list(number)
    chromosome = [n.split(":")[0] for n in order]
    on_chromosome = {c: 1 << i for i, c in enumerate(dict.fromkeys(chromosome))}
    around: list[list[tuple[int, int, int, int, str, int | None]]] = [[] for _ in order]
    for a, b, kind, sv_no in edges:
        i, j = number[a], number[b]
        tra = int(kind == cp.TRA)
        around[i].append((j, 1 << j, on_chromosome[chromosome[j]], tra, kind, sv_no))
        around[j].append((i, 1 << i, on_chromosome[chromosome[i]], tra, kind, sv_no))
    back = [edges_of[::-1] for edges_of in around]
    out: list[dict] = []
    seen: set[int] = set()
    for start in dict.fromkeys(number[x] for a, b, kind, _ in edges if kind == cp.TRA for x in (a, b)):
        accepted = 0
        path, steps = [start], []
        state = [(1 << start, on_chromosome[chromosome[start]], 0)]  # nodes, chromosomes and translocations of the path
        pending = [iter(back[start])] if max_paths > 0 else []
        while pending:
            nodes, places, n = state[-1]
            for step in pending[-1]:
                node, bit, place, tra, _, _ = step
                if nodes & bit:
                    continue
                key, left = nodes | bit, max_depth - len(path) - 1
                if n + tra + left < min_translocations:
                    continue
                if n + tra >= min_translocations and len(path) + 1 >= min_translocations and (places | place).bit_count() >= min_chromosomes and key not in seen:
                    seen.add(key)
                    accepted += 1
                    own, taken = [*path, node], [*steps, step]
                    names = list(dict.fromkeys([chromosome[p] for p in own]))
                    out.append({
                        "chain_id": len(out) + 1, "nodes": [order[p] for p in own], "edge_types": [t[4] for t in taken], "sv_nos": sorted({t[5] for t in taken} - {None}), "chromosomes": names, "n_chromosomes": len(names),
                        "n_translocations": n + tra,
                    })
                    if accepted >= max_paths:
                        pending = []
                        break
                if left:
                    path.append(node)
                    steps.append(step)
                    state.append((key, places | place, n + tra))
                    pending.append(iter(back[node]))
                    break
            else:
                pending.pop()
                path.pop()
                state.pop()
                if steps:
                    steps.pop()
    return out


def chains(edges: DataFrame, min_chromosomes: int = 3, min_translocations: int = 3, max_paths: int = 100, max_depth: int = 10, cnv: DataFrame | None = None) -> DataFrame:
    """The chains of every sample's graph; with cnv also their stability and n_inter, as of chromoplexy.chains()."""
    schema = "sample_id string, chain_id long, nodes array<string>, edge_types array<string>, sv_nos array<long>, chromosomes array<string>, n_chromosomes long, n_translocations long"
    return cp.search_groups(edges, lambda found: search(found, min_chromosomes, min_translocations, max_paths, max_depth), schema, cnv)


def evaluate(chain: DataFrame, edges: DataFrame, cnv: DataFrame | None = None) -> DataFrame:
    """Chains with stability, combined p of their rate edges and class by five criteria."""
    steps = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.array_sort(F.array(F.element_at("nodes", i), F.element_at("nodes", i + 1))))
    x = chain.select("sample_id", "chain_id", F.explode(steps).alias("ends"))
    e = edges.where(F.col("edge_type") == STAT).groupBy("sample_id", F.array_sort(F.array("from_node", "to_node")).alias("ends")).agg(F.min("pvalue").alias("p"))
    p = x.join(e, ["sample_id", "ends"]).where("p > 0 AND p < 1").groupBy("sample_id", "chain_id").agg(F.sum(F.log("p")).alias("logs"), F.count("*").alias("k"))
    c = chain.join(p.select("sample_id", "chain_id", fisher_combine(F.col("logs"), F.col("k")).alias("chain_pvalue")), ["sample_id", "chain_id"], "left")
    if cnv is not None and "cn_stability_score" not in c.columns:
        c = c.join(cp.stability(chain, cnv), ["sample_id", "chain_id"], "left")
    elif cnv is None:
        c = c.withColumn("cn_stability_score", F.lit(1.0)).withColumn("max_cn_deviation", F.lit(0.0))
    count = lambda kind: F.size(F.filter("edge_types", lambda t: t == kind))
    c = c.withColumn("n_deletion_bridges", count(cp.BRIDGE)).withColumn("n_stat_adjacency", count(STAT))
    tests = [F.col("n_chromosomes") >= 3, F.col("n_translocations") >= 3, F.col("cn_stability_score") >= 0.7, F.coalesce(F.col("chain_pvalue") < 0.01, F.lit(False)), F.col("n_deletion_bridges") > 0]
    met = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    kind = F.when(tests[3] & (met >= 4), cp.LIKELY).when(met >= 3, cp.POSSIBLE).when(met >= 2, cp.UNLIKELY).otherwise(cp.NOT)
    return c.withColumn("classification", kind)


def detect(sv: DataFrame, genome: DataFrame, cnv: DataFrame | None = None, **limits) -> DataFrame:
    edges = graph(sv, genome, cnv)
    return evaluate(chains(edges, cnv=cnv, **limits).drop("n_inter"), edges, cnv)


def match_chains(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """One-to-one matches (sample_id, chain_a, chain_b, jaccard) of two methods' chains (sample_id, chain_id, sv_nos) by the Jaccard
    similarity of their variants over `least`.

    In each sample the first chain of a takes the first free chain of b that is similar enough, and so on; the order is that of
    combined_score, greatest first, where there is one, then of chain_id. Only chains that share a variant are compared.
    """

    def side(d: DataFrame, n: int) -> DataFrame:
        score = F.col("combined_score") if "combined_score" in d.columns else F.lit(0.0)
        return d.select("sample_id", F.lit(n).alias("side"), F.coalesce(-score, F.lit(float("inf"))).alias("score"), "chain_id", F.array_distinct("sv_nos").alias("svs"))

    def greedy(rows: list[tuple]) -> list[tuple]:
        """Variants are bits of words, so that a chain meets all chains of the other side in one step of numpy."""
        bit: dict[int, int] = {}
        sides: tuple[list[tuple], list[tuple]] = ([], [])
        for r in rows:
            sides[r[1]].append((r[3], [bit.setdefault(v, len(bit)) for v in r[4] or ()]))
        if not all(sides):
            return []
        words = len(bit) // 64 + 1

        def packed(svs: list[int]) -> list[int]:
            own = [0] * words
            for k in svs:
                own[k >> 6] |= 1 << (k & 63)
            return own

        others = np.array([packed(svs) for _, svs in sides[1]], np.uint64)
        size, free = np.array([len(svs) for _, svs in sides[1]], np.int64), np.ones(len(others), bool)
        keep = []
        for chain, svs in sides[0]:
            both = np.bitwise_count(others & np.array(packed(svs), np.uint64)).sum(1, dtype=np.int64)
            # size + len(svs) - both is 0 only where both chains have no variant
            similar = both / np.maximum(size + len(svs) - both, 1)
            fits = np.flatnonzero(free & (both > 0) & (similar > least))
            if len(fits):
                free[fits[0]] = False
                keep.append((rows[0][0], chain, sides[1][fits[0]][0], float(similar[fits[0]])))
        return keep

    return map_groups(side(a, 0).unionByName(side(b, 1)), ["sample_id"], ["side", "score", "chain_id"], greedy, "sample_id string, chain_a long, chain_b long, jaccard double")


def compare_methods(samples: DataFrame, rate: DataFrame, fixed: DataFrame, rate_edges: DataFrame | None = None, fixed_edges: DataFrame | None = None) -> DataFrame:
    """A row for every sample of samples: chains, likely and possible calls of the rate-based and the fixed method, adjacency edges of
    their graphs if given, chains they share, chains that only one has, and shared over all."""

    def side(d: DataFrame, n: str) -> DataFrame:
        kind = F.col("classification")
        return d.groupBy("sample_id").agg(F.count("*").alias(f"{n}_total_chains"), F.count_if(kind == cp.LIKELY).alias(f"{n}_likely"), F.count_if(kind == cp.POSSIBLE).alias(f"{n}_possible"))

    out = samples.select("sample_id").distinct()
    parts = [side(rate, "rate"), side(fixed, "fixed"), match_chains(rate, fixed).groupBy("sample_id").agg(F.count("*").alias("n_shared"))]
    for name, kind, e in (("rate", STAT, rate_edges), ("fixed", cp.ADJACENT, fixed_edges)):
        if e is not None:
            parts.append(e.groupBy("sample_id").agg(F.count_if(F.col("edge_type") == kind).alias(f"{name}_adjacency_edges")))
    for part in parts:
        out = out.join(part, "sample_id", "left")
    out = out.na.fill(0)
    only = {f"n_{n}_only": F.col(f"{n}_total_chains") - F.col("n_shared") for n in ("rate", "fixed")}
    out = out.withColumns(only)
    every = F.col("n_shared") + F.col("n_rate_only") + F.col("n_fixed_only")
    return out.withColumn("jaccard", F.when(every > 0, F.col("n_shared") / every).otherwise(0.0))
