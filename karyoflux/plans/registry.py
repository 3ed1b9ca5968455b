"""All registered queries of the library's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyoflux.functions import ranked, stats
from karyoflux.functions.nulls import equal_shares, with_equal_shares_p, with_gaps_p
from karyoflux.functions.tails import binomial_two_sided, correlation_pvalue
from karyoflux.model import CHROM_SIZES, genome_table
from karyoflux.operators import chromoanasynthesis as cs
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators import chromothripsis as ct
from karyoflux.operators import cohort, genes, integrate, layouts, rate_chains, repair, segments, survival, variants
from karyoflux.plans import oracle, oracle_tests, rules
from karyoflux.runtime import materialize, scratch
from karyoflux.sources import fixtures as fx
from karyoflux.sources import fasta, vcf

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits) + F.lit(0.0)), columns, df)


def longs(df: DataFrame) -> DataFrame:
    """Counts as 64-bit integers."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


# -- tables -----------------------------------------------------------------------------------------------------------------
@query
def sv_table(s, d):
    return fx.sv(s, d)


@query
def cnv_table(s, d):
    return longs(fx.cnv(s, d))


@query
def canonical_sv(s, d):
    return variants.size_filter(variants.correct_types(variants.canonical(fx.sv(s, d))), 5000)


@query
def breakpoint_unpivot(s, d):
    return longs(variants.breakpoints(fx.sv(s, d)))


@query
def breakpoint_nodes(s, d):
    return longs(variants.nodes(fx.sv(s, d)))


@query
def qc_metrics(s, d):
    return rounded(variants.qc_metrics(fx.sv(s, d), fx.cnv(s, d)), "inter_rate", "mean_segment", "small_rate")


@query
def quality_warnings(s, d):
    return variants.quality_warnings(fx.sv(s, d), fx.cnv(s, d))


@query
def overlap_rate(s, d):
    return rounded(variants.overlap_rate(fx.sv(s, d)), "overlap_rate")


@query
def flag_clustered_breakpoints(s, d):
    c = variants.local_clusters(fx.sv(s, d), 200_000)
    return c.withColumn("sv_ids", F.array_join("sv_ids", ","))


@query
def germline_filter(s, d):
    return variants.without_local_clusters(fx.sv(s, d), 200_000)


@query
def merge_segments(s, d):
    return longs(segments.merge_adjacent(fx.cnv(s, d)))


@query
def cn_oscillation(s, d):
    return longs(segments.longest_runs(fx.cnv(s, d)))


@query
def linear_positions(s, d):
    return layouts.arcs(fx.sv(s, d), genome_table(s)).select("sample_id", "sv_id", "x1", "x2", "span", "curvature")


@query
def region_clip(s, d):
    return longs(segments_in_window(s, d))


def segments_in_window(s, d):
    return variants.clip_segments(fx.cnv(s, d), "1", 5_000_000, 12_000_000)


# -- clustered shattering ---------------------------------------------------------------------------------------------------
@query
def ct_interleaving_pairs(s, d):
    return ct.interleaving_pairs(fx.sv(s, d))


@query
def ct_components(s, d):
    return ct.components(fx.sv(s, d)).drop("top")


@query
def ct_cluster_summary(s, d):
    return longs(ct.cluster_summary(fx.sv(s, d), fx.cnv(s, d)))


@query
def ct_chromosome_counts(s, d):
    return longs(ct.chromosome_counts(fx.sv(s, d), genome_table(s)))


@query
def ct_join_counts(s, d):
    return rounded(ct.join_counts(fx.sv(s, d)), "joins_chi2")


@query
def ct_breakpoint_gaps(s, d):
    return rounded(longs(ct.cluster_gaps(fx.sv(s, d))), "mean_gap", "ks_d")


@query
def ct_gap_tests(s, d):
    """Gaps of each cluster with their p under the exponential law."""
    return rounded(with_gaps_p(ct.cluster_gaps(fx.sv(s, d)), "ks_d", "n_gaps", "pvalue").select("sample_id", "chrom", "n_gaps", "ks_d", "pvalue"), "ks_d", "pvalue")


@query
def ct_join_tests(s, d):
    """Join counts of each cluster with their exact p under equal shares."""
    j = ["join_del", "join_h2hinv", "join_t2tinv", "join_dup"]
    x = with_equal_shares_p(ct.join_counts(fx.sv(s, d)), j, "pvalue")
    return rounded(x.select("sample_id", "chrom", *j, F.log("pvalue").alias("log_pvalue")), "log_pvalue", digits=9)


@query
def equal_shares_null(s, d):
    """The exact null of every cluster size up to that of all variants of a sample, at most 60."""
    n = fx.sv(s, d).groupBy("sample_id").agg(F.count("*").alias("k")).agg(F.least(F.max("k"), F.lit(60)).alias("k"))
    x = equal_shares(n.select(F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("n")))
    return rounded(x.select("n", "squares", F.log("pvalue").alias("log_pvalue")), "log_pvalue", digits=9)


@query
def ct_enrichment_tests(s, d):
    """Exact binomial tests of the ends of each sample's translocations on each chromosome, by chromosome length."""
    n = ct.sides(fx.sv(s, d)).groupBy("sample_id", "chrom").agg(F.countDistinct("sv_id").alias("n_here"))
    total = variants.inter(fx.sv(s, d)).groupBy("sample_id").agg(F.count("*").alias("n_all"))
    g = genome_table(s).withColumn("weight", F.col("size") / F.lit(float(sum(CHROM_SIZES["hg19"]))))
    x = n.join(total, "sample_id").join(F.broadcast(g.select("chrom", "weight")), "chrom")
    return rounded(x.withColumn("pvalue", binomial_two_sided(F.col("n_here"), F.col("n_all"), F.col("weight"))).drop("weight"), "pvalue", digits=9)


@query
def ct_degrees(s, d):
    return ct.degrees(fx.sv(s, d))


@query
def ct_inter_joins(s, d):
    return ct.inter_joins(fx.sv(s, d))


def _criteria(s, d):
    return ct.criteria(fx.sv(s, d), fx.cnv(s, d), genome_table(s))


@query
def ct_classification(s, d):
    p = ["pval_fragment_joins", "pval_exp_cluster", "pval_exp_chr", "chr_breakpoint_enrichment", "inter_pval_fragment_joins"]
    c = longs(ct.classify(_criteria(s, d)))
    return rounded(c.withColumns({n: F.col(n) + 1e-10 for n in p}), *p, "confidence_score")  # exact p of few joins lie halfway between two roundings


@query
def ct_diagnostics(s, d):
    return ct.diagnose(_criteria(s, d)).select("sample_id", "chrom", "could_be_high1", "could_be_high2", "could_be_low", "final_classification", "blocking_reasons")


@query
def ct_sample_summary(s, d):
    return rounded(ct.summarize(_criteria(s, d)), "max_score")


# -- translocation chains ---------------------------------------------------------------------------------------------------
@query
def cp_deletion_bridges(s, d):
    return rounded(longs(cp.deletion_bridges(fx.sv(s, d), fx.cnv(s, d))), "confidence")


@query
def cp_adjacency_edges(s, d):
    return rounded(cp.adjacency_edges(fx.sv(s, d)).drop("place", "sv_no", "edge_type"), "evidence_strength")


@query
def cp_edges(s, d):
    return rounded(cp.graph(fx.sv(s, d), fx.cnv(s, d)).drop("place"), "evidence_strength")


@query
def cp_adjacency_list(s, d):
    return cp.adjacency_list(cp.graph(fx.sv(s, d))).select("sample_id", "node", F.size("neighbors").cast("long").alias("n_neighbors"), F.array_join(F.array_sort(F.transform("neighbors", lambda x: x["to"])), ",").alias("neighbors"))


def _chains(s, d):
    return cp.detect(fx.sv(s, d), fx.cnv(s, d))


def _searched(s, d):
    """Chains with the statistical test off, under which the small cohort has likely calls."""
    return cp.detect(fx.sv(s, d), fx.cnv(s, d), statistical=False, likely=4, possible=3)


def _sure(s, d):
    """_searched(), written for what reads them more than once."""
    return materialize(_searched(s, d), "chains")


@query
def cp_chains(s, d):
    return _chains(s, d)


@query
def cp_chain_diagnostics(s, d):
    return cp.diagnose(_chains(s, d))


def _events(s, d, chains=None):
    e = cp.events(_searched(s, d), fx.sv(s, d), together=True) if chains is None else cp.events(chains, fx.sv(s, d))
    return materialize(e, "events")


@query
def cp_events(s, d):
    return _events(s, d)


@query
def cp_event_edges(s, d):
    c = _sure(s, d)
    return cp.event_edges(c, cp.collapse(c))


@query
def cp_chain_context(s, d):
    c = _sure(s, d)
    return cp.local_variation(c, fx.cnv(s, d)).join(cp.bridge_enrichment(c, cp.deletion_bridges(fx.sv(s, d), fx.cnv(s, d))), ["sample_id", "chain_id"])


def _detail(s, d, chains=None):
    e = _events(s, d, chains)
    b = cp.event_breakpoints(e)
    return e, b, genes.at_breakpoints(b, fx.gene(s, d))


@query
def cp_event_genes(s, d):
    e, _, g = _detail(s, d)
    return genes.event_genes(e, g)


@query
def cp_gene_events(s, d):
    return genes.gene_events(_detail(s, d)[2])


@query
def cp_gene_hits(s, d):
    points = variants.breakpoints(fx.sv(s, d)).where("bp_no = 1").select("sample_id", "sv_id", "chrom", "pos")
    return genes.at_breakpoints(points, fx.gene(s, d)).select("sample_id", "sv_id", "chrom", "pos", "symbol", "distance_to_breakpoint", "is_driver")


@query
def mu_rates(s, d):
    return rounded(rate_chains.rates(fx.sv(s, d), genome_table(s)), "mu", digits=9)


@query
def stat_adjacency_edges(s, d):
    return rounded(rate_chains.stat_edges(fx.sv(s, d), genome_table(s)), "pvalue", digits=9)


@query
def cp_rate_chains(s, d):
    return rate_chains.detect(fx.sv(s, d), genome_table(s), fx.cnv(s, d))


@query
def cp_method_comparison(s, d):
    sv, cnv, g = fx.sv(s, d), fx.cnv(s, d), genome_table(s)
    # both are read for their counts and for their matches
    rate, fixed = (materialize(c.select("sample_id", "chain_id", "sv_nos", "classification", *more), n) for c, n, more in ((rate_chains.detect(sv, g, cnv), "rate", []), (_chains(s, d), "fixed", ["combined_score"])))
    return rate_chains.compare_methods(sv, rate, fixed, rate_chains.graph(sv, g, cnv), cp.graph(sv, cnv))


def _few(s, d, every):
    """A part of the translocations: graphs of some ten nodes, whose simple paths can all be listed."""
    return variants.inter(fx.sv(s, d)).where(F.col("sv_no") % every == 0)


_ALL_PATHS = 1_000_000  # more paths than such graphs have, so that no quota ends a search


@query
def cp_chains_small(s, d):
    """The variants of each chain, where no cap of the search binds."""
    c = cp.chains(cp.graph(_few(s, d, 4), fx.cnv(s, d)), max_paths=_ALL_PATHS)
    return c.select("sample_id", F.array_join(F.col("sv_nos").cast("array<string>"), ",").alias("variants"))


@query
def cp_rate_chains_small(s, d):
    """The nodes of each chain of the rate-based search, where no cap binds."""
    c = rate_chains.chains(rate_chains.graph(_few(s, d, 3), genome_table(s), fx.cnv(s, d)), max_paths=_ALL_PATHS)
    return c.select("sample_id", F.array_join(F.array_sort("nodes"), ",").alias("nodes"))


# -- gradients --------------------------------------------------------------------------------------------------------------
@query
def cs_windows(s, d):
    return rounded(longs(cs.windows(fx.cnv(s, d))), "gradient_correlation", "slope", "variation_score", "cn_mean")


@query
def cs_window_tests(s, d):
    """Rank correlation of copy number and place of each window, with its p."""
    w = cs.windows(fx.cnv(s, d)).select("sample_id", "chrom", "win_size", "start_idx", "n_segments", "gradient_correlation")
    p = correlation_pvalue(F.col("gradient_correlation"), F.col("n_segments"))
    return rounded(longs(w.withColumn("pvalue", p)), "gradient_correlation", "pvalue", digits=9)


@query
def cs_candidates(s, d):
    """Windows with a gradient."""
    return longs(cs.candidates(fx.cnv(s, d)).select("sample_id", "chrom", "win_size", "start_idx", "n_segments"))


@query
def cs_topology(s, d):
    """Regions laid out from the variants, with what lies in them and how it is linked."""
    end = F.expr("pos1 + 500000 + (sv_no * 7919 % 4000) * 1000 - 1")
    r = fx.sv(s, d).where("sv_no div 6 % 3 = 2").select("sample_id", F.col("sv_no").cast("int").alias("region_id"), F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), end.alias("end"))
    return longs(cs.topology(r, fx.sv(s, d)))


@query
def oscillation_permutations(s, d):
    return rounded(longs(segments.oscillation_test(fx.cnv(s, d), times=200)), "pvalue")


@query
def cs_regions(s, d):
    return cs.detect(fx.sv(s, d), fx.cnv(s, d))


# -- together ---------------------------------------------------------------------------------------------------------------
def _calls(s, d):
    """The calls of the three modules, for what reads them once."""
    return ct.classify(_criteria(s, d)), _searched(s, d), cs.detect(fx.sv(s, d), fx.cnv(s, d))


def _modules(s, d):
    """The calls of the three modules, each made once and written for all that reads them."""
    return materialize(ct.classify(_criteria(s, d)), "clusters"), _sure(s, d), materialize(cs.detect(fx.sv(s, d), fx.cnv(s, d)), "regions")


def _locations(s, d, modules=None):
    return integrate.locations(*(modules or _modules(s, d)))


@query
def mechanism_locations(s, d):
    return _locations(s, d, _calls(s, d))


@query
def called_overlaps(s, d):
    """Overlaps of the calls that the three modules make."""
    return integrate.overlaps(_locations(s, d))


@query
def called_sample_class(s, d):
    modules = _modules(s, d)
    loc = _locations(s, d, modules)
    return longs(integrate.sample_class(_summary(s, d, modules), loc, integrate.overlaps(loc)))


@query
def called_complexity(s, d):
    modules = _modules(s, d)
    loc = _locations(s, d, modules)
    return integrate.complexity(_summary(s, d, modules), loc, integrate.overlaps(loc))


@query
def mechanism_overlaps(s, d):
    return integrate.overlaps(fx.calls(s, d))


@query
def chrom_class(s, d):
    return longs(integrate.by_chromosome(fx.calls(s, d)))


@query
def chrom_status(s, d):
    return longs(integrate.chromosome_summary(fx.calls(s, d), genome_table(s)))


def _laid_out(s, d):
    """(summary, calls, overlaps) of the calls that are laid out from all variants; every seventh sample has none."""
    loc = fx.calls(s, d).where(fx.WITH_CALLS)
    return fx.call_counts(s, d), loc, integrate.overlaps(loc)


@query
def sample_class(s, d):
    return longs(integrate.sample_class(*_laid_out(s, d)))


@query
def complexity(s, d):
    return rounded(longs(integrate.complexity(*_laid_out(s, d))).select("sample_id", "n_mechanisms", "n_chromosomes", "n_mixed_chromosomes", "n_events", "n_overlaps", "score", "level"), "score")


@query
def dominance(s, d):
    return rounded(integrate.dominance(fx.call_counts(s, d)), "proportion")


@query
def dominance_labels(s, d):
    return rounded(layouts.dominance_labels(integrate.dominance(fx.call_counts(s, d))).select("sample_id", "mechanism", "label_at"), "label_at")


@query
def mechanism_matrix(s, d):
    return layouts.mechanism_matrix(fx.calls(s, d), genome_table(s))


@query
def global_fdr(s, d):
    return integrate.global_fdr(_criteria(s, d), _chains(s, d))


@query
def bh_adjust(s, d):
    x = fx.sv(s, d).select("sample_id", "sv_id", (((F.col("sv_no") * 7919) % 10007 + 1).cast("double") / F.lit(10008.0)).alias("p"))
    return rounded(stats.with_bh(x, "p", "fdr", ["sample_id"]), "p", "fdr", digits=9)


@query
def bh_adjust_all(s, d):
    """All variants of the cohort as tests of one family, with ties, nulls and a p of 1 that many share."""
    p = F.when(F.col("sv_no") % 17 == 0, None).when(F.col("sv_no") % 4 == 0, F.lit(1.0)).otherwise(((F.col("sv_no") * 7919) % 2003 + 1).cast("double") / F.lit(2004.0))
    x = fx.sv(s, d).select("sample_id", "sv_id", "svtype", p.alias("p"))
    return rounded(ranked.with_bh(ranked.with_bh(x, "p", "fdr"), "p", "fdr_by_type", ["svtype"]), "p", "fdr", "fdr_by_type", digits=9)


def _summary(s, d, modules=None, detail=None):
    a, b, c = modules or _modules(s, d)
    e, _, g = detail or _detail(s, d, b)
    return integrate.summary(fx.sv(s, d), a, b, e, c, g)


@query
def integrated_summary(s, d):
    return _summary(s, d)


# -- genes and repair -------------------------------------------------------------------------------------------------------
@query
def fusions(s, d):
    return genes.fusions(fx.sv(s, d), fx.gene(s, d))


@query
def gene_impact(s, d):
    a, b, c = _modules(s, d)
    points = b.where(F.col("classification") == cp.LIKELY).select("sample_id", F.explode("sv_nos").alias("sv_no")).distinct()
    points = variants.breakpoints(fx.sv(s, d)).join(points, ["sample_id", "sv_no"]).select("sample_id", "chrom", "pos")
    return genes.impact(a.where("classification = 'High confidence'").select("sample_id", "chrom", "start", "end"), points, c.where("classification = 'Likely chromoanasynthesis'").select("sample_id", "chrom", "start", "end"), fx.gene(s, d))


def _repair(s, d):
    return repair.classify(fx.flank(s, d), fx.sv(s, d))


_FASTA_CHUNK, _FLANK, _SHRINK = 1000, 50, 100


def _near(s, d):
    """Variants at a hundredth of their positions, where a generated genome of some 250,000 bases a chromosome reaches."""
    at = lambda c: F.expr(f"{c} div {_SHRINK}")
    return fx.sv(s, d).withColumns({"pos1": at("pos1"), "pos2": at("pos2")})


@query
def junction_flanks(s, d):
    """Sequences beside each junction, from a FASTA file that is written from digests and read again in splits and chunks."""
    path = f"{scratch(s)}/genome-{uuid.uuid4().hex}.fa"
    fx.fasta_lines(_near(s, d)).coalesce(1).sortWithinPartitions("chrom", "line_no").select("line").write.text(path)
    return repair.junctions(_near(s, d), fasta.read_fasta(s, path, _FASTA_CHUNK), _FLANK, _FASTA_CHUNK)


@query
def microhomology(s, d):
    f = fx.flank(s, d)
    return f.select("sample_id", "sv_id", repair.microhomology_length(F.col("s1_disc"), F.col("s2_disc")).alias("run_length"), repair.microhomology_length(F.col("s1_disc"), F.col("s2_disc"), mode="longest").alias("longest"), repair.reverse_complement(F.col("s1_kept")).alias("rc"))


@query
def repair_class(s, d):
    return _repair(s, d)


@query
def repair_summary(s, d):
    return rounded(repair.summary(_repair(s, d)), "proportion", "mean_length", "median_length")


@query
def repair_text(s, d):
    return repair.region_text(_repair(s, d), ["sample_id"])


@query
def repair_by_type(s, d):
    return rounded(layouts.repair_by_type(_repair(s, d)), "fraction")


@query
def microhomology_histogram(s, d):
    return layouts.microhomology_histogram(_repair(s, d))


# -- cohort -----------------------------------------------------------------------------------------------------------------
def _points(s, d):
    """Breakpoints of translocations as those of events: one event a sample and first chromosome."""
    b = variants.breakpoints(variants.inter(fx.sv(s, d)))
    return cohort.with_event_id(b.withColumn("collapsed_event_id", F.concat(F.lit("CE"), "chrom")).select("sample_id", "collapsed_event_id", "chrom", "pos"))


@query
def recurrent_regions(s, d):
    return cohort.recurrent_regions(_points(s, d), min_samples=2)


@query
def recurrent_chromosomes(s, d):
    return cohort.recurrent_chromosomes(_points(s, d))


@query
def recurrent_genes(s, d):
    p = genes.at_breakpoints(_points(s, d), fx.gene(s, d)).withColumn("event_qc_score", F.col("pos") % 100 / 100.0)
    n = fx.sv(s, d).agg(F.countDistinct("sample_id")).first()[0]
    return rounded(cohort.recurrent_genes(p, n), "mean_event_qc_score", "max_event_qc_score", "recurrence_fraction", "recurrence_score")


@query
def event_artifacts(s, d):
    e, b, _ = _detail(s, d)
    return cohort.flag_artifacts(e, cohort.with_event_id(b))


@query
def event_cohort_priority(s, d):
    e, b, g = _detail(s, d)
    e = cohort.with_event_id(genes.event_genes(e, g))
    return cohort.cohort_priority(e, cohort.recurrent_regions(cohort.with_event_id(b)))


@query
def sample_burden(s, d):
    modules = _modules(s, d)
    e, _, g = detail = _detail(s, d, modules[1])
    return cohort.sample_burden(_summary(s, d, modules, detail), e, g)


@query
def mechanism_crosstab(s, d):
    x = fx.calls(s, d).join(fx.clinical(s, d), "sample_id")
    return cohort.crosstab(x, "grp", "mechanism")


@query
def cooccurrence(s, d):
    return cohort.cooccurrence(fx.calls(s, d))


@query
def prevalence(s, d):
    """From calls alone: each module's are counted as they come, and events, which tell nothing of it, aren't made."""
    a, b, c = _calls(s, d)
    return cohort.prevalence(integrate.summary(fx.sv(s, d), a, b, None, c))


def _hits(s, d):
    p = variants.breakpoints(fx.sv(s, d)).select("sample_id", "sv_id", "chrom", "pos")
    return genes.at_breakpoints(p, fx.gene(s, d)).select("sample_id", "symbol").distinct()


def _positive(s, d):
    return fx.sv(s, d).select("sample_id").distinct().where("int(substring(sample_id, 2)) % 3 = 0")


@query
def gene_enrichment(s, d):
    return rounded(cohort.gene_enrichment(_hits(s, d), _positive(s, d), fx.sv(s, d)), "mech_pos_freq", "mech_neg_freq", "odds_ratio", "pvalue", "fdr")


@query
def group_tests(s, d):
    return cohort.compare_groups(fx.calls(s, d).select("sample_id", "mechanism"), fx.clinical(s, d))[1]


@query
def group_pair_tests(s, d):
    """Two groups of samples: those with an event and those without."""
    pairs = fx.clinical(s, d).withColumn("grp", F.col("os_event").cast("string"))
    return rounded(cohort.compare_groups(fx.calls(s, d).where(fx.WITH_CALLS).select("sample_id", "mechanism"), pairs)[1], "pvalue", digits=9)


@query
def group_counts(s, d):
    return rounded(cohort.compare_groups(fx.calls(s, d).select("sample_id", "mechanism"), fx.clinical(s, d))[0], "fraction")


def _gene_sets(s, d):
    g = fx.gene(s, d)
    a = g.select(F.lit("chromosome").alias("source"), F.concat(F.lit("chr"), "chrom").alias("set_name"), "symbol")
    return a.unionByName(g.select(F.lit("role").alias("source"), F.col("gene_type").alias("set_name"), "symbol"))


@query
def over_representation(s, d):
    picked = fx.gene(s, d).where("is_driver OR chrom = '2'")
    return rounded(longs(cohort.over_representation(picked.select("symbol"), _gene_sets(s, d), 20_000)), "pvalue", "fdr", digits=9)


# -- survival ---------------------------------------------------------------------------------------------------------------
def _features(s, d):
    q = variants.qc_metrics(fx.sv(s, d), fx.cnv(s, d))
    return q.select("sample_id", F.col("n_svs"), F.col("n_inter"), (F.col("n_inter") >= 13).cast("int").alias("many_inter"))


@query
def survival_long(s, d):
    return longs(survival.groups(survival.long_form(_features(s, d), fx.clinical(s, d))))


@query
def km_curve(s, d):
    return rounded(survival.km_curve(survival.groups(survival.long_form(_features(s, d), fx.clinical(s, d)))), "survival")


@query
def logrank(s, d):
    return rounded(survival.logrank(survival.groups(survival.long_form(_features(s, d), fx.clinical(s, d)))), "chisq")


@query
def km_tests(s, d):
    return rounded(survival.km_tests(survival.groups(survival.long_form(_features(s, d), fx.clinical(s, d)))), "chisq", "pvalue", "fdr")


@query
def cox_tests(s, d):
    f = _features(s, d)
    return survival.cox_tests(survival.long_form(f, fx.clinical(s, d)), f.select("sample_id", (F.col("n_svs") % 5).cast("double").alias("covariate")))


@query
def survival_features(s, d):
    modules = _modules(s, d)
    e, _, g = detail = _detail(s, d, modules[1])
    return survival.features(_summary(s, d, modules, detail), e, genes.fusions(fx.sv(s, d), fx.gene(s, d)), g)


@query
def pathway_hits(s, d):
    return survival.pathway_hits(_hits(s, d), _gene_sets(s, d))


# -- plots and text sources -------------------------------------------------------------------------------------------------
@query
def sv_density(s, d):
    return layouts.density(fx.sv(s, d))


@query
def genome_copy_numbers(s, d):
    return layouts.genome_copy_numbers(fx.cnv(s, d), genome_table(s)).select("sample_id", "chrom", "x1", "x2", "shown_cn", "state")


@query
def scaled_segments(s, d):
    return rounded(longs(layouts.scaled_segments(fx.cnv(s, d), ["sample_id", "chrom"])), "scaled_cn")


@query
def cohort_landscape(s, d):
    return layouts.landscape(_summary(s, d), fx.clinical(s, d))


@query
def event_gene_labels(s, d):
    return layouts.event_gene_labels(_detail(s, d)[2])


@query
def vcf_bnd_parse(s, d):
    return vcf.parse_breakends(vcf.records(fx.vcf_line(s, d)))


@query
def vcf_delly_parse(s, d):
    return vcf.sv_from_lines(fx.vcf_line(s, d), caller="delly").select("sample_id", "sv_id", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "svtype")


_COLUMNS = ["sample_id", "sv_id", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "svtype"]


@query
def vcf_gridss_parse(s, d):
    return vcf.sv_from_lines(fx.vcf_lines_of(s, d, "gridss"), caller="gridss").select(*_COLUMNS)


@query
def vcf_manta_parse(s, d):
    return vcf.sv_from_lines(fx.vcf_lines_of(s, d, "manta"), caller="manta").select(*_COLUMNS)


@query
def vcf_lumpy_parse(s, d):
    return vcf.sv_from_lines(fx.vcf_lines_of(s, d, "lumpy"), caller="lumpy").select(*_COLUMNS)


@query
def vcf_generic_parse(s, d):
    return vcf.sv_from_lines(fx.vcf_lines_of(s, d, "generic"), caller="generic").select(*_COLUMNS)


@query
def vcf_auto_parse(s, d):
    """Callers told by INFO keys: samples with even numbers as lumpy writes them, others as gridss does."""
    lines = lambda c, k, ids: fx.vcf_lines_of(s, d, c).where(f"int(substring(sample_id, 2)) % 2 = {k}").unionByName(
        fx.sv(s, d).select("sample_id").distinct().where(f"int(substring(sample_id, 2)) % 2 = {k}").select("sample_id", F.explode(F.array(*[F.lit(f"##INFO=<ID={i},Number=1,Type=String>") for i in ids])).alias("line"))
    )
    return vcf.sv_from_lines(lines("lumpy", 0, ["STRANDS", "SVTYPE"]).unionByName(lines("gridss", 1, ["MATEID", "SVTYPE"]))).select(*_COLUMNS)


@query
def vcf_copy_numbers(s, d):
    return longs(vcf.cnv_from_lines(fx.cnv_line(s, d), merge=False))


@query
def standard_types(s, d):
    names = ["DEL", "<DUP:TANDEM>", "dup", "INV", "INS", "BND", "DEL:ME", "DUP:INT", "INV:X", "INS:ME", "BND2", "TRANSLOCATION", "CNV", ""]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("sv_no") % len(names) + 1).cast("int"))
    pair = [F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("+"), F.lit("."), F.lit("-")), (F.col("sv_no") % n % 5 + 1).cast("int")) for n in (7, 11)]
    x = fx.sv(s, d).select("sample_id", "sv_id", raw.alias("raw"), "chrom1", "chrom2", pair[0].alias("strand1"), pair[1].alias("strand2"))
    return x.withColumn("svtype", variants.standard_type(F.col("raw"), F.col("chrom1"), F.col("chrom2"), F.col("strand1"), F.col("strand2")))


@query
def event_flags(s, d):
    """Every customer's event as a word, a number or nonsense, in turn."""
    words = [*survival.EVENT_WORDS, *survival.NO_EVENT_WORDS, " Dead ", "1.0", "0.0", "1e0", "2", "maybe", ""]
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("c_custkey") % len(words) + 1).cast("int")).alias("word"))
    return c.select("c_custkey", "word", survival.event_flag(F.col("word")).cast("long").alias("event"), survival.event_flag(F.col("c_custkey") % 3 == 0).cast("long").alias("by_truth"), survival.event_flag((F.col("c_custkey") % 3).cast("double")).cast("long").alias("by_number"))


@query
def cohort_results(s, d):
    return cohort.results(_summary(s, d), genes.fusions(fx.sv(s, d), fx.gene(s, d)))


@query
def cp_germline_chains(s, d):
    return cp.detect_germline(fx.sv(s, d), fx.cnv(s, d), window=200_000)


@query
def circular_arcs(s, d):
    return rounded(layouts.circular_arcs(fx.sv(s, d), genome_table(s)), "turn1", "turn2", "between", digits=9)


@query
def region_links(s, d):
    return layouts.region_links(fx.sv(s, d), fx.calls(s, d))


@query
def fusion_repair(s, d):
    return layouts.fusion_repair(genes.fusions(fx.sv(s, d), fx.gene(s, d)), _repair(s, d))


@query
def hazard_forest(s, d):
    return rounded(survival.top_hazards(survival.cox_tests(survival.long_form(_features(s, d), fx.clinical(s, d)))), "hazard_ratio", "conf_low", "conf_high", "pvalue", "fdr")


@query
def chromosome_bounds(s, d):
    """Places of chromosomes and centromeres along the genome, with each one's variants."""
    n = variants.breakpoints(fx.sv(s, d)).groupBy("chrom").agg(F.count("*").alias("n_breakpoints"))
    return longs(layouts.chromosome_bounds(genome_table(s)).join(n, "chrom"))


@query
def position_texts(s, d):
    """Positions as text, from bases to megabases."""
    pos = F.expr("pos1 div CASE sv_no % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100000 END * 10 + 3")  # no ties
    return fx.sv(s, d).select("sample_id", "sv_id", pos.alias("pos")).withColumn("text", layouts.format_position(F.col("pos")))


@query
def recurrence_order(s, d):
    """Recurrent regions in their order, by place."""
    r = cohort.ordered(cohort.recurrent_regions(_points(s, d), min_samples=2), "region")
    return r.select("chrom", "window_start", "n_samples", "n_collapsed_events")


for _q in rules.QUERIES:
    query(_q)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.queries() | oracle_tests.queries() | {name: oracle.with_tables(*spec) for name, spec in rules.SQL.items()}
