"""Clustered shattering: interleaved variants, their clusters, statistics and rule classes.

Intervals [pos1 - 1, pos2 + 1] of two variants of one chromosome interleave if they overlap and neither holds the other. A
chromosome's cluster is every component of that graph that has the chromosome's greatest size; equal ones are pooled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.functions.nulls import with_equal_shares_p, with_gaps_p
from karyoflux.functions.tails import binomial_two_sided
from karyoflux.operators.groups import map_groups
from karyoflux.operators.intervals import join_overlapping
from karyoflux.operators.segments import longest_runs, segments_of
from karyoflux.operators.variants import inter, intra
from karyoflux.runtime import materialize

KEYS = ["sample_id", "chrom"]


def interleaving_pairs(sv: DataFrame) -> DataFrame:
    """(sample_id, chrom, a, b): pairs of variants that interleave, through position bins."""
    s = intra(sv).select("sample_id", F.col("chrom1").alias("chrom"), "sv_id", "pos1", "pos2")
    a = s.select("sample_id", "chrom", F.col("sv_id").alias("a"), F.col("pos1").alias("a1"), F.col("pos2").alias("a2"))
    b = s.select("sample_id", "chrom", F.col("sv_id").alias("b"), F.col("pos1").alias("b1"), F.col("pos2").alias("b2"))
    # of two that interleave the second starts in the first, or at most two bases behind its end
    j = join_overlapping(a, b, KEYS, (F.col("a1"), F.col("a2") + 2), (F.col("b1"), F.col("b1")))
    return j.where("a1 < b1 AND a2 < b2").select("sample_id", "chrom", "a", "b")


def sweep(pos1: list[int], pos2: list[int]) -> list[int]:
    """For each interval a number that those of its component share, in one sweep over the sorted ends, without any pairs.

    Open intervals lie on a stack of groups in order of start. What still is open and started behind an interval when that one
    ends interleaves with it, so the groups above its own join it; each group is joined once, which makes the sweep linear.
    """
    n = len(pos1)
    starts = sorted(range(n), key=lambda k: (pos1[k], -pos2[k], k))
    rank = [0] * n
    for r, k in enumerate(starts):
        rank[k] = r
    parent, still_open, stack, at = list(range(n)), [0] * n, [], 0

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in sorted(range(n), key=lambda k: (max(pos1[k], pos2[k]), -rank[k])):
        while at < n and pos1[starts[at]] <= max(pos1[k], pos2[k]) + 2:
            stack.append(starts[at])
            still_open[starts[at]] = 1
            at += 1
        own = find(k)
        while stack[-1] != own:
            top = stack.pop()
            parent[top] = own
            still_open[own] += still_open[top]
        still_open[own] -= 1
        if not still_open[own]:
            stack.pop()
    return [find(k) for k in range(n)]


def crossings(pos1: list[int], pos2: list[int]) -> list[int]:
    """For each interval how many others it interleaves with, by counting in one pass over starts, without any pairs.

    Later ones start inside it (or at most two bases behind) and end behind it; earlier ones end inside it and start before it. Each
    is a difference of two counts of intervals that start by some place and end by another, which a Fenwick tree over the ends
    answers in log n steps.
    """
    n = len(pos1)
    starts, ends = sorted(pos1), sorted(set(pos2))
    tree, found = [0] * (len(ends) + 1), [0] * n
    # (start bound, 1 if it is included, end bound, interval, sign): intervals that start by the bound and end under the end bound
    asked: list[tuple[int, int, int, int, int]] = []
    for k, (s, e) in enumerate(zip(pos1, pos2, strict=True)):
        if e + 2 >= s:  # else nothing can cross it
            asked += [(e + 2, 1, e + 1, k, -1), (s, 1, e + 1, k, 1), (s, 0, e, k, 1), (s, 0, s - 2, k, -1)]
            found[k] = bisect_right(starts, e + 2) - bisect_right(starts, s)
    asked.sort()
    order, at = sorted(range(n), key=lambda k: pos1[k]), 0
    for start, included, end, k, sign in asked:
        while at < n and (pos1[order[at]] < start or included and pos1[order[at]] == start):
            i = bisect_left(ends, pos2[order[at]]) + 1
            while i <= len(ends):
                tree[i] += 1
                i += i & -i
            at += 1
        i = bisect_left(ends, end)
        while i:
            found[k] += sign * tree[i]
            i -= i & -i
    return found


def _by_chromosome(sv: DataFrame, of: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """of applied to the variants (sample_id, chrom, sv_id, pos1, pos2) within each chromosome of each sample."""
    return map_groups(intra(sv).select("sample_id", F.col("chrom1").alias("chrom"), "sv_id", "pos1", "pos2"), KEYS, [], of, schema)


def components(sv: DataFrame) -> DataFrame:
    """(sample_id, chrom, sv_id, component, n, top): the component (its least variant) of every variant within a chromosome, its
    size, and the greatest size on the chromosome."""

    def of(rows: list[tuple]) -> list[tuple]:
        found = sweep([r[3] for r in rows], [r[4] for r in rows])
        least: dict[int, str] = {}
        sizes: dict[int, int] = {}
        for r, g in zip(rows, found, strict=True):
            least[g] = min(least.get(g, r[2]), r[2])
            sizes[g] = sizes.get(g, 0) + 1
        top = max(sizes.values())
        return [(r[0], r[1], r[2], least[g], sizes[g], top) for r, g in zip(rows, found, strict=True)]

    return _by_chromosome(sv, of, "sample_id string, chrom string, sv_id string, component string, n long, top long")


def degrees(sv: DataFrame) -> DataFrame:
    """(sample_id, chrom, sv_id, degree): how many variants of its chromosome each one interleaves with."""
    of = lambda rows: [(*r[:3], n) for r, n in zip(rows, crossings([r[3] for r in rows], [r[4] for r in rows]), strict=True)]
    return _by_chromosome(sv, of, "sample_id string, chrom string, sv_id string, degree long")


def members(sv: DataFrame, min_size: int = 1) -> DataFrame:
    """The variants of each chromosome's cluster, with its size."""
    m = components(sv).where((F.col("n") == F.col("top")) & (F.col("n") >= min_size)).select(*KEYS, "sv_id", "n")
    return m.join(intra(sv).select("sample_id", "sv_id", "pos1", "pos2", "strand1", "strand2", "svtype"), ["sample_id", "sv_id"])


def clusters(sv: DataFrame, min_size: int = 1, m: DataFrame | None = None) -> DataFrame:
    """A row for each sample's chromosome with a cluster: its size, bounds, and counts by type over the pooled components.

    Here and below m is the table of members(sv), if it is there already.
    """
    count = lambda t: F.count_if(F.col("svtype") == t)
    return (members(sv) if m is None else m).where(F.col("n") >= min_size).groupBy(*KEYS).agg(
        F.max("n").alias("cluster_size"), F.min(F.least("pos1", "pos2")).alias("start"), F.max(F.greatest("pos1", "pos2")).alias("end"),
        count("DEL").alias("number_del"), count("DUP").alias("number_dup"), count("h2hINV").alias("number_h2hinv"), count("t2tINV").alias("number_t2tinv"),
    )


def cluster_summary(sv: DataFrame, cnv: DataFrame, min_size: int = 1, m: DataFrame | None = None) -> DataFrame:
    """Clusters with oscillating segments in the cluster's region and on the whole chromosome."""
    if m is None:
        m = materialize(members(sv), "members")
    c = clusters(sv, min_size, m)
    region = longest_runs(segments_of(c, cnv)).select(*KEYS, F.col("n_segments").alias("number_cnv_segments"), F.col("osc2").alias("osc2_cluster"), F.col("osc3").alias("osc3_cluster"))
    whole = longest_runs(cnv).select(*KEYS, F.col("osc2").alias("osc2_chr"), F.col("osc3").alias("osc3_chr"))
    return c.join(region, KEYS, "left").join(whole, KEYS, "left")


def chromosome_counts(sv: DataFrame, genome: DataFrame) -> DataFrame:
    """Variants within each chromosome of each sample; zero where there are none."""
    n = intra(sv).groupBy("sample_id", F.col("chrom1").alias("chrom")).agg(F.count("*").alias("n_svs"))
    frame = sv.select("sample_id").distinct().crossJoin(F.broadcast(genome.select("chrom")))
    return frame.join(n, KEYS, "left").withColumn("n_svs", F.coalesce("n_svs", F.lit(0)))


def sides(sv: DataFrame) -> DataFrame:
    """Interchromosomal variants, one row for each side: chrom, pos, strands."""
    s = inter(sv)
    one = s.select("sample_id", "sv_id", F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), F.col("chrom2").alias("other"), "strand1", "strand2")
    two = s.select("sample_id", "sv_id", F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos"), F.col("chrom1").alias("other"), "strand1", "strand2")
    return one.unionByName(two)


def join_counts(sv: DataFrame, min_size: int = 1, m: DataFrame | None = None) -> DataFrame:
    """Counts of join types in each cluster with and without the translocations that end in it, and the chi-square against ¼ each."""
    if m is None:
        m = materialize(members(sv), "members")
    c = clusters(sv, min_size, m)
    t = sides(sv).join(c.select(*KEYS, "start", "end"), KEYS).where("pos BETWEEN start AND end")
    pair = F.concat("strand1", "strand2")
    t = t.groupBy(*KEYS).agg(F.countDistinct("sv_id").alias("number_tra"), *[F.count_if(pair == p).alias(f"t_{n}") for n, p in (("del", "+-"), ("h2hinv", "++"), ("t2tinv", "--"), ("dup", "-+"))])
    c = c.join(t, KEYS, "left").na.fill(0, ["number_tra", "t_del", "t_h2hinv", "t_t2tinv", "t_dup"])
    for n in ("del", "h2hinv", "t2tinv", "dup"):
        c = c.withColumn(f"join_{n}", F.col(f"number_{n}") + F.col(f"t_{n}"))
    total = sum((F.col(f"join_{n}") for n in ("h2hinv", "t2tinv", "dup")), F.col("join_del"))
    c = c.withColumn("cluster_size_including_tra", total)
    expected = F.col("cluster_size_including_tra") / 4.0
    chi = sum(((F.col(f"join_{n}") - expected) * (F.col(f"join_{n}") - expected) / expected for n in ("h2hinv", "t2tinv", "dup")), (F.col("join_del") - expected) * (F.col("join_del") - expected) / expected)
    return c.withColumn("joins_chi2", chi).drop("t_del", "t_h2hinv", "t_t2tinv", "t_dup")


def _gaps(breaks: DataFrame) -> DataFrame:
    """n_breaks, n_gaps, mean_gap and the exponential distance D of the gaps between distinct breaks (KEYS, pos); needs 6 breaks."""
    w = Window.partitionBy(*KEYS).orderBy("pos")
    g = breaks.distinct().withColumn("gap", F.col("pos") - F.lag("pos").over(w)).withColumn("n_breaks", F.count("*").over(Window.partitionBy(*KEYS)))
    g = g.where("gap > 0 AND n_breaks >= 6")
    g = g.withColumn("n", F.count("*").over(Window.partitionBy(*KEYS))).withColumn("mean_gap", F.sum("gap").over(Window.partitionBy(*KEYS)) / F.col("n"))
    g = g.where("n >= 5").withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("gap", "pos")))
    cdf = 1 - F.exp(-F.col("gap") / F.col("mean_gap"))
    d = F.greatest(F.max(F.col("i") / F.col("n") - cdf), F.max(cdf - (F.col("i") - 1) / F.col("n")))
    return g.groupBy(*KEYS).agg(F.max("n_breaks").alias("n_breaks"), F.max("n").alias("n_gaps"), F.max("mean_gap").alias("mean_gap"), d.alias("ks_d"))


def linked_sides(sv: DataFrame, c: DataFrame, margin: int = 10_000) -> DataFrame:
    """Sides of translocations that count for a chromosome: those within margin of its cluster, or all of them where there are none."""
    t = sides(sv).join(c.select(*KEYS, "start", "end"), KEYS).withColumn("near", F.col("pos").between(F.col("start") - margin, F.col("end") + margin))
    t = t.withColumn("any_near", F.bool_or("near").over(Window.partitionBy(*KEYS)))
    return t.where(F.col("near") | ~F.col("any_near"))


def cluster_gaps(sv: DataFrame, m: DataFrame | None = None) -> DataFrame:
    """Gaps between the breakpoints of each cluster, translocation ends inside it included."""
    if m is None:
        m = materialize(members(sv), "members")
    own = m.select(*KEYS, F.explode(F.array("pos1", "pos2")).alias("pos"))
    t = sides(sv).join(clusters(sv, m=m).select(*KEYS, "start", "end"), KEYS).where("pos BETWEEN start AND end").select(*KEYS, "pos")
    return _gaps(own.unionByName(t))


def chromosome_gaps(sv: DataFrame, m: DataFrame | None = None) -> DataFrame:
    return _gaps(linked_sides(sv, clusters(sv, m=m)).select(*KEYS, "pos"))


def inter_joins(sv: DataFrame, margin: int = 10_000, m: DataFrame | None = None) -> DataFrame:
    """Chromosomes that each cluster is linked to by two or more translocation ends near their own clusters, with join counts.

    Counted are the linked chromosomes' cluster variants and the translocations between them and the cluster's chromosome.
    """
    if m is None:
        m = materialize(members(sv), "members")
    c = clusters(sv, m=m)
    t = sides(sv).join(c.select(*KEYS, "start", "end"), KEYS).where(F.col("pos").between(F.col("start") - margin, F.col("end") + margin)).drop("start", "end", "pos")
    far = sides(sv).select("sample_id", "sv_id", F.col("chrom").alias("other"), F.col("pos").alias("far_pos"))
    links = t.join(far, ["sample_id", "sv_id", "other"])
    w = links.groupBy("sample_id", "chrom", "other").agg(F.count("*").alias("n"), F.min("far_pos").alias("lo"), F.max("far_pos").alias("hi"))
    o = c.select("sample_id", F.col("chrom").alias("other"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    chosen = w.join(o, ["sample_id", "other"]).where((F.col("n") >= 2) & ((F.col("lo") >= F.col("o_start") - margin) | (F.col("hi") <= F.col("o_end") + margin)))
    pair = F.concat("strand1", "strand2")
    kind = F.when(pair == "+-", "DEL").when(pair == "-+", "DUP").when(pair == "++", "h2hINV").when(pair == "--", "t2tINV")
    own = chosen.select("sample_id", "chrom", "other").join(m.select("sample_id", F.col("chrom").alias("other"), "svtype"), ["sample_id", "other"]).select("sample_id", "chrom", "svtype")
    tra = links.join(chosen.select("sample_id", "chrom", "other"), ["sample_id", "chrom", "other"]).select("sample_id", "chrom", kind.alias("svtype"))
    counts = own.unionByName(tra).groupBy(*KEYS).agg(*[F.count_if(F.col("svtype") == t).alias(f"inter_number_{n}") for n, t in (("del", "DEL"), ("h2hinv", "h2hINV"), ("t2tinv", "t2tINV"), ("dup", "DUP"))])
    text = F.concat("other", F.lit(":"), F.col("o_start").cast("string"), F.lit("-"), F.col("o_end").cast("string"))
    names = chosen.groupBy(*KEYS).agg(F.array_join(F.sort_array(F.collect_list("other")), "_").alias("inter_other_chroms"), F.array_join(F.sort_array(F.collect_list(text)), ";").alias("inter_other_chroms_coords_all"))
    return counts.join(names, KEYS)


def criteria(sv: DataFrame, cnv: DataFrame, genome: DataFrame) -> DataFrame:
    """One row for each sample's chromosome, clusters or not: all counts and p-values the rules need.

    Gaps are held against a seeded null table of the exponential law, which depends on sizes alone; joins against equal shares and
    the enrichment with chromosome lengths as weights have exact tests.
    """
    m = materialize(members(sv), "members")
    s = cluster_summary(sv, cnv, m=m)
    joins = ["join_del", "join_h2hinv", "join_t2tinv", "join_dup"]
    j = join_counts(sv, m=m).select(*KEYS, "number_tra", "cluster_size_including_tra", *joins)
    g = cluster_gaps(sv, m).withColumn("of", F.lit("pval_exp_cluster")).unionByName(chromosome_gaps(sv, m).withColumn("of", F.lit("pval_exp_chr")))
    p_of = lambda name: F.max(F.when(F.col("of") == name, F.col("p"))).alias(name)  # noqa: E731  one row each
    g = with_gaps_p(materialize(g, "gaps"), "ks_d", "n_gaps", "p").groupBy(*KEYS).agg(p_of("pval_exp_cluster"), p_of("pval_exp_chr"))
    near = linked_sides(sv, clusters(sv, m=m))
    hits = near.groupBy(*KEYS).agg(F.countDistinct("sv_id").alias("n_here"), F.bool_or("near").alias("windowed"))
    total = inter(sv).groupBy("sample_id").agg(F.count("*").alias("n_inter"))
    weights = genome.select("chrom", (F.col("size") / F.sum("size").over(Window.partitionBy(F.lit(1)))).alias("weight"))
    hits = hits.join(total, "sample_id").join(F.broadcast(weights), "chrom").withColumn("n_all", F.when(F.col("windowed"), F.col("n_here")).otherwise(F.col("n_inter")))
    hits = hits.select(*KEYS, binomial_two_sided(F.col("n_here"), F.col("n_all"), F.col("weight")).alias("chr_breakpoint_enrichment"))
    n = sv.groupBy("sample_id").agg(F.count("*").alias("number_svs_sample"))
    x = inter_joins(sv, m=m)
    x = with_equal_shares_p(x, ["inter_number_del", "inter_number_h2hinv", "inter_number_t2tinv", "inter_number_dup"], "inter_pval_fragment_joins")
    out = s.join(with_equal_shares_p(j, joins, "pval_fragment_joins").drop(*joins), KEYS)
    for other in (g, hits, x):
        out = out.join(other, KEYS, "left")
    frame = sv.select("sample_id").distinct().crossJoin(F.broadcast(genome.select("chrom")))
    out = frame.join(out, KEYS, "left").join(n, "sample_id")
    return out.withColumn("cluster_size", F.coalesce("cluster_size", F.lit(0)))


def scores(c: DataFrame) -> DataFrame:
    """The five component scores, their weighted sum and its category."""
    n = F.coalesce("cluster_size_including_tra", "cluster_size")
    size = F.when(n >= 10, 1.0).when(n >= 6, 0.6).when(n >= 3, 0.3).otherwise(0.1)
    osc = F.when(F.col("osc2_cluster") >= 4, 1.0).when(F.col("osc3_cluster") >= 4, 0.8).when(F.col("osc2_cluster") >= 2, 0.4).otherwise(0.0)
    joins = F.when(F.col("pval_fragment_joins") > 0.05, 1.0).when(F.col("pval_fragment_joins") > 0.01, 0.5).otherwise(0.0)
    clus = F.when(F.col("pval_exp_cluster") < 0.05, 1.0).when(F.col("pval_exp_chr") < 0.05, 0.7).when(F.col("pval_exp_cluster") < 0.1, 0.5).otherwise(0.0)
    enr = F.when(F.col("chr_breakpoint_enrichment") < 0.001, 1.0).when(F.col("chr_breakpoint_enrichment") < 0.01, 0.7).when(F.col("chr_breakpoint_enrichment") < 0.05, 0.4).otherwise(0.0)
    c = c.withColumns({"cluster_score": size, "cn_oscillation_score": osc, "fragment_joins_score": joins, "clustering_score": clus, "enrichment_score": enr})
    total = 0.20 * F.col("cluster_score") + 0.25 * F.col("cn_oscillation_score") + 0.20 * F.col("fragment_joins_score") + 0.20 * F.col("clustering_score") + 0.15 * F.col("enrichment_score")
    c = c.withColumn("confidence_score", total)
    return c.withColumn("confidence_category", F.when(F.col("confidence_score") >= 0.7, "High").when(F.col("confidence_score") >= 0.4, "Moderate").otherwise("Low"))


def _classes(n: Column, tra: Column, osc: Column, p: Column, p2: Column, clustered: Column) -> Column:
    joins = p > 0.05
    high1 = (n >= 6) & (osc >= 7) & joins & clustered
    high2 = (n >= 3) & (F.coalesce(tra, F.lit(0)) >= 4) & (osc >= 7) & (F.coalesce(p2, p) > 0.05)
    low = (n >= 6) & osc.between(4, 6) & joins & clustered
    return F.when(high1 | high2, "High confidence").when(low, "Low confidence").otherwise("Not chromothripsis")


def classify(c: DataFrame) -> DataFrame:
    """Scored criteria with their class: two ways to high confidence and one to low; nulls fail every test."""
    n = F.col("cluster_size")
    osc = F.coalesce("osc2_cluster", "osc3_cluster")
    clustered = F.coalesce(F.col("pval_exp_cluster") < 0.05, F.lit(False)) | F.coalesce(F.col("chr_breakpoint_enrichment") < 0.05, F.lit(False))
    return scores(c).withColumn("classification", _classes(n, F.col("number_tra"), osc, F.col("pval_fragment_joins"), F.col("inter_pval_fragment_joins"), clustered))


def ordered(c: DataFrame) -> DataFrame:
    """c with its place in the sample, by class, then score; in that order."""
    rank = F.when(F.col("classification") == "High confidence", 1).when(F.col("classification") == "Low confidence", 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(rank, F.desc("confidence_score"), "chrom"))
    return c.withColumn("place", place).orderBy("sample_id", "place")


def diagnose(c: DataFrame, joins_p: float = 0.05, clustering_p: float = 0.05) -> DataFrame:
    """Why each chromosome with a cluster is or isn't called: which tests it meets, which classes are in reach, what stands in the way,
    and the class by what is in reach (final_classification)."""
    n, p, p2 = F.col("cluster_size"), F.col("pval_fragment_joins"), F.col("inter_pval_fragment_joins")
    two, three = F.col("osc2_cluster"), F.col("osc3_cluster")
    no = lambda x: F.coalesce(x, F.lit(False))
    meets = {
        "meets_size_high1": no(n >= 6), "meets_size_high2": no(n >= 3), "meets_tra": no(F.col("number_tra") >= 4), "meets_oscillation_high": no(two >= 7) | no(three >= 7), "meets_oscillation_low": no(two.between(4, 6)) | no(three.between(4, 6)),
        "meets_joins": no(p > joins_p), "meets_inter_joins": F.when(p2.isNotNull(), p2 > joins_p).otherwise(no(p > joins_p)), "meets_clustering": no(F.col("pval_exp_cluster") < clustering_p) | no(F.col("chr_breakpoint_enrichment") < clustering_p),
    }
    d = classify(c.where(n > 0)).withColumns(meets)
    d = d.withColumns({
        "could_be_high1": F.col("meets_size_high1") & F.col("meets_oscillation_high") & F.col("meets_joins") & F.col("meets_clustering"),
        "could_be_high2": F.col("meets_size_high2") & F.col("meets_tra") & F.col("meets_oscillation_high") & F.col("meets_inter_joins"),
        "could_be_low": F.col("meets_size_high1") & F.col("meets_oscillation_low") & F.col("meets_joins") & F.col("meets_clustering"),
    })
    final = F.when(F.col("could_be_high1") | F.col("could_be_high2"), "High confidence").when(F.col("could_be_low"), "Low confidence").otherwise("Not chromothripsis")
    number = lambda x: F.coalesce(F.format_string("%.3f", x), F.lit("NA"))
    shown = F.coalesce(two, three)
    by_inter = F.col("meets_tra") & p2.isNotNull()
    # The wording of reasons.
    joins = F.when(by_inter, F.when(~F.col("meets_inter_joins"), F.concat(F.lit("Fragment joins FAILED (intra+TRA p="), number(p2), F.lit(f", need >{joins_p:.2f})")))).otherwise(
        F.when(~F.col("meets_joins"), F.concat(F.lit("Fragment joins FAILED (p="), F.when(p.isNull(), "NA").otherwise(number(p)), F.lit(f", need >{joins_p:.2f})")))
    )
    oscillation = F.when(~F.col("meets_oscillation_high") & ~F.col("meets_oscillation_low"), F.concat(F.lit("CN oscillations insufficient ("), F.coalesce(shown.cast("string"), F.lit("NA")), F.lit(", need >=4)"))).when(
        ~F.col("meets_oscillation_high"), F.concat(F.lit("CN oscillations="), shown.cast("string"), F.lit(" (in low conf range 4-6, not high >=7)"))
    )
    size = F.when(~F.col("meets_size_high1"), F.concat(F.lit("Too few intrachromosomal SVs ("), n.cast("string"), F.lit(", need >=6)")))
    clustering = F.when(~F.col("meets_clustering"), F.lit("Clustering tests FAILED (both p>=0.05)"))
    return d.withColumns({"blocking_reasons": F.array_join(F.array_compact(F.array(joins, oscillation, size, clustering)), "; "), "final_classification": final})


def summarize(c: DataFrame) -> DataFrame:
    """A row a sample: chromosomes by class, the best score, and the chromosomes called, in order of score."""
    kind = F.col("classification")
    by_score = lambda k: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(kind == k, F.struct((-F.col("confidence_score")).alias("s"), "chrom")))), lambda x: x["chrom"]), ",")
    return classify(c).groupBy("sample_id").agg(
        F.count_if(kind == "High confidence").alias("n_high"), F.count_if(kind == "Low confidence").alias("n_low"), F.count_if(kind == "Not chromothripsis").alias("n_not"),
        F.max("confidence_score").alias("max_score"), by_score("High confidence").alias("high_chromosomes"), by_score("Low confidence").alias("low_chromosomes"),
    )
