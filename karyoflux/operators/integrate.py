"""The three mechanisms together: per sample, per chromosome, overlaps, dominance and complexity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyoflux.functions.stats import with_bh
from karyoflux.model import CHROMOSOMES
from karyoflux.operators import chromoplexy as cp
from karyoflux.operators.intervals import BIN, join_overlapping

ORDER = {"chromothripsis": 1, "chromoplexy": 2, "chromoanasynthesis": 3}


def _rank(mechanism):
    return F.create_map(*[x for k, v in ORDER.items() for x in (F.lit(k), F.lit(v))])[mechanism]


def locations(ct: DataFrame | None, chain: DataFrame | None, cs: DataFrame | None, min_confidence: float = 0.3) -> DataFrame:
    """(sample_id, mechanism, chrom, start, end, confidence, classification, event_id) of calls with at least min_confidence.

    Clusters lie at their bounds; chains at the span of their nodes on each chromosome, widened by 10 kb where that is one place;
    regions at their bounds. A module that wasn't run is None.
    """
    parts = []
    if ct is not None:
        c = ct.where(F.col("classification").isin("High confidence", "Low confidence") & (F.col("confidence_score") >= min_confidence))
        parts.append(c.select("sample_id", F.lit("chromothripsis").alias("mechanism"), "chrom", "start", "end", F.col("confidence_score").alias("confidence"), "classification", F.concat(F.lit("CT_"), "chrom").alias("event_id")))
    if chain is not None:
        c = chain.where(F.col("classification").isin(cp.LIKELY, cp.POSSIBLE) & (F.col("complexity_score") >= min_confidence))
        at = F.transform("nodes", lambda n: F.struct(F.split(n, ":")[0].alias("chrom"), F.split(n, ":")[1].cast("long").alias("pos")))
        c = c.select("sample_id", "chain_id", "classification", F.array_sort(at).alias("at"))  # a chain's places on a chromosome, in its own row
        chroms = F.array_distinct(F.transform("at", lambda p: p["chrom"]))
        n = c.select("sample_id", "chain_id", "classification", "at", F.explode(chroms).alias("chrom"))
        n = n.withColumn("at", F.transform(F.filter("at", lambda p: p["chrom"] == F.col("chrom")), lambda p: p["pos"]))
        n = n.withColumns({"lo": F.element_at("at", 1), "hi": F.element_at("at", -1)})
        wide = F.when(F.col("lo") == F.col("hi"), 10_000).otherwise(0)
        parts.append(n.select("sample_id", F.lit("chromoplexy").alias("mechanism"), "chrom", (F.col("lo") - wide).alias("start"), (F.col("hi") + wide).alias("end"), F.lit(0.7).alias("confidence"), "classification", F.concat(F.lit("CP_"), F.col("chain_id").cast("string")).alias("event_id")))
    if cs is not None:
        c = cs.where(F.col("classification").isin("Likely chromoanasynthesis", "Possible chromoanasynthesis") & (F.col("complexity_score") >= min_confidence))
        parts.append(c.select("sample_id", F.lit("chromoanasynthesis").alias("mechanism"), "chrom", "start", "end", F.col("complexity_score").alias("confidence"), "classification", F.concat(F.lit("CS_"), F.col("region_id").cast("string")).alias("event_id")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(loc: DataFrame, threshold: int = 1_000_000) -> DataFrame:
    """Pairs of calls of different mechanisms that share at least threshold bases of a chromosome; the earlier mechanism first.

    mechanism_pair has both names in alphabetical order.
    """
    side = lambda n: loc.select("sample_id", "chrom", *[F.col(c).alias(f"{c}{n}") for c in ("mechanism", "start", "end", "confidence", "event_id")])
    # mechanisms are a key, so the many chains of a sample never meet each other; calls are wide and the keys small, so bins are wide
    later = F.filter(F.array(*[F.lit(r) for r in ORDER.values()]), lambda r: r > _rank(F.col("mechanism1")))
    one, two = side(1).withColumn("_with", F.explode(later)), side(2).withColumn("_with", _rank(F.col("mechanism2"))).where(F.col("_with") > 1)
    j = join_overlapping(one, two, ["sample_id", "chrom", "_with"], (F.col("start1"), F.col("end1")), (F.col("start2"), F.col("end2")), 50 * BIN)
    size = F.least("end1", "end2") - F.greatest("start1", "start2") + 1
    j = j.withColumn("overlap_size", size).where(F.col("overlap_size") >= threshold)
    pair = F.array_join(F.array_sort(F.array("mechanism1", "mechanism2")), "+")
    return j.select("sample_id", "chrom", "mechanism1", "mechanism2", "event_id1", "event_id2", "overlap_size", "confidence1", "confidence2", pair.alias("mechanism_pair"))


def by_chromosome(loc: DataFrame) -> DataFrame:
    """Mechanisms and calls (n_events) on each chromosome; dominant is the one with the greatest confidence, the first by name on ties."""
    m = loc.groupBy("sample_id", "chrom", "mechanism").agg(F.max("confidence").alias("best"), F.count("*").alias("k"))
    first = F.min(F.struct((-F.col("best")).alias("b"), "mechanism"))["mechanism"]
    g = m.groupBy("sample_id", "chrom").agg(F.array_join(F.sort_array(F.collect_list("mechanism")), "+").alias("mechanisms"), first.alias("dominant_mechanism"), F.count("*").alias("n_mechanisms"), F.max("best").alias("max_confidence"), F.sum("k").alias("n_events"))
    return g.withColumn("is_mixed", F.col("n_mechanisms") > 1)


def chromosome_summary(loc: DataFrame, genome: DataFrame) -> DataFrame:
    """(sample_id, chrom, dominant_mechanism, n_events, mechanisms_list) of each chromosome with calls: mixed, or its one mechanism.

    Clusters and regions count each, chains once, however many run through the chromosome.
    """
    m = loc.groupBy("sample_id", "chrom", "mechanism").agg(F.count("*").alias("n"))
    n = F.when(F.col("mechanism") == "chromoplexy", F.lit(1).cast("long")).otherwise(F.col("n"))
    g = m.join(F.broadcast(genome.select("chrom")), "chrom").groupBy("sample_id", "chrom").agg(F.sum(n).alias("n_events"), F.sort_array(F.collect_list(F.struct(_rank(F.col("mechanism")).alias("r"), "mechanism"))).alias("m"))
    names = F.transform("m", lambda x: x["mechanism"])
    return g.select("sample_id", "chrom", F.when(F.size("m") > 1, "mixed").otherwise(names[0]).alias("dominant_mechanism"), "n_events", F.array_join(names, ", ").alias("mechanisms_list"))


# -- a sample's class, from the counts of its summary ------------------------------------------------------------------------
#: Columns of the summary with the sure and the less sure calls of each mechanism.
COUNTS = {
    "chromothripsis": ("chromothripsis_high_confidence", "chromothripsis_low_confidence"), "chromoplexy": ("chromoplexy_likely", "chromoplexy_possible"),
    "chromoanasynthesis": ("chromoanasynthesis_likely", "chromoanasynthesis_possible"),
}


def _count(name: str) -> Column:
    """A module that wasn't run counts nothing."""
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def present(mechanism: str) -> Column:
    """Whether a sample has the mechanism: clusters of either confidence, likely chains, likely regions."""
    sure, less = COUNTS[mechanism]
    return (_count(sure) > 0) | (_count(less) > 0) if mechanism == "chromothripsis" else _count(sure) > 0


def mechanisms_present() -> Column:
    return F.array_compact(F.array(*[F.when(present(m), m) for m in COUNTS]))


def _events(mechanism: str) -> Column:
    return _count(COUNTS[mechanism][0]) + _count(COUNTS[mechanism][1])


def _with_places(summary: DataFrame, loc: DataFrame, pairs: DataFrame) -> DataFrame:
    """summary with n_overlaps, n_chromosomes and n_mixed_chromosomes, zero for samples without calls."""
    c = by_chromosome(loc).groupBy("sample_id").agg(F.count("*").alias("n_chromosomes"), F.count_if("is_mixed").alias("n_mixed_chromosomes"))
    o = pairs.groupBy("sample_id").agg(F.count("*").alias("n_overlaps"))
    return summary.join(c, "sample_id", "left").join(o, "sample_id", "left").na.fill(0, ["n_chromosomes", "n_mixed_chromosomes", "n_overlaps"])


def sample_class(summary: DataFrame, loc: DataFrame, pairs: DataFrame) -> DataFrame:
    """The class of every sample of the summary: no mechanism, one, or several with or without overlaps (pairs) of their places (loc)."""
    j = _with_places(summary, loc, pairs).withColumn("_m", mechanisms_present())
    n, spatial, names = F.size("_m"), F.col("n_overlaps") > 0, F.array_join("_m", "+")
    text = F.when(n == 0, "No chromoanagenesis").when(n == 1, F.concat(F.lit("Pure "), names)).when(spatial, F.concat(F.lit("Mixed mechanisms with spatial overlap ("), names, F.lit(")"))).otherwise(F.concat(F.lit("Multiple independent mechanisms ("), names, F.lit(")")))
    kind = F.when(n == 0, "normal").when(n == 1, "single_mechanism").when(spatial, "mixed_overlapping").otherwise("mixed_independent")
    return j.select("sample_id", text.alias("classification"), kind.alias("category"), n.alias("n_mechanisms"), "n_mixed_chromosomes", spatial.alias("has_spatial_overlap"), "n_overlaps")


def complexity(summary: DataFrame, loc: DataFrame, pairs: DataFrame) -> DataFrame:
    """Score and level of every sample of the summary, from its mechanisms, overlaps, chromosomes and events."""
    one = F.lit(1.0)
    c = _with_places(summary, loc, pairs)
    c = c.select("sample_id", F.size(mechanisms_present()).alias("n_mechanisms"), "n_chromosomes", "n_mixed_chromosomes", "n_overlaps", sum((_events(m) for m in list(COUNTS)[1:]), _events("chromothripsis")).alias("n_events"))
    c = c.withColumns({"mechanism_component": F.col("n_mechanisms") / 3, "overlap_component": F.least(F.col("n_overlaps") / 5, one), "chromosome_component": F.least(F.col("n_chromosomes") / 10, one), "event_component": F.least(F.col("n_events") / 10, one)})
    c = c.withColumn("score", F.col("mechanism_component") * 0.30 + F.col("overlap_component") * 0.25 + F.col("chromosome_component") * 0.25 + F.col("event_component") * 0.20)
    return c.withColumn("level", F.when(F.col("score") < 0.3, "Low").when(F.col("score") < 0.6, "Moderate").when(F.col("score") < 0.8, "High").otherwise("Very High"))


def dominance(summary: DataFrame) -> DataFrame:
    """Three rows a sample: events of each mechanism, their share, and the sample's dominant one: over half of the events, else
    balanced; none without events."""
    n = {m: _events(m) for m in COUNTS}
    total, most = sum(list(n.values())[1:], n["chromothripsis"]), F.greatest(*n.values())
    top = F.coalesce(*[F.when(c == most, m) for m, c in n.items()])
    kind = F.when(total == 0, "none").when(most / total <= 0.5, "balanced").otherwise(top)
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("mechanism"), c.alias("n_events"), F.when(total > 0, c / total).otherwise(0.0).alias("proportion")) for m, c in n.items()]))
    return summary.select("sample_id", kind.alias("dominant"), rows)


def global_fdr(ct: DataFrame | None, chain: DataFrame | None) -> DataFrame:
    """(sample_id, mechanism, event_id, original_pvalue, adjusted_pvalue, is_significant_fdr) over all tests of a sample.

    Every chromosome of the classification is a test, with its least p of four (null as 1); so is every chain with a p.
    """
    parts = []
    if ct is not None:
        p = [F.coalesce(F.col(c), F.lit(1.0)) for c in ("pval_fragment_joins", "pval_exp_chr", "pval_exp_cluster", "chr_breakpoint_enrichment") if c in ct.columns]
        parts.append(ct.select("sample_id", F.lit("chromothripsis").alias("mechanism"), F.concat(F.lit("CT_"), "chrom").alias("event_id"), (F.least(*p) if len(p) > 1 else p[0]).alias("original_pvalue")))
    if chain is not None:
        parts.append(chain.select("sample_id", F.lit("chromoplexy").alias("mechanism"), F.concat(F.lit("CP_"), F.col("chain_id").cast("string")).alias("event_id"), F.col("pvalue").alias("original_pvalue")))
    tests = with_bh(reduce(DataFrame.unionByName, parts), "original_pvalue", "adjusted_pvalue", ["sample_id"])
    return tests.withColumn("is_significant_fdr", F.col("adjusted_pvalue") < 0.05)


# -- one row a sample -------------------------------------------------------------------------------------------------------
#: Names of the analysis with and without copy numbers.
WITH_CNV, SV_ONLY = "SV+CNV integrated", "SV-only chromoplexy"


def _in_order(name: Column, *order: Column, of: Column | None = None) -> Column:
    """Distinct names, in the order of their first rows, joined."""
    rows = F.sort_array(F.collect_list(F.when(F.lit(True) if of is None else of, F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], name.alias("name")))))
    return F.array_distinct(F.transform(rows, lambda x: x["name"]))


def summary(sv: DataFrame, ct: DataFrame | None, chain: DataFrame | None, event: DataFrame | None, cs: DataFrame | None, detail: DataFrame | None = None) -> DataFrame:
    """One row a sample with the counts of every module, the chromosomes of its calls and its class.

    A module that wasn't run has null counts and "Not analyzed". Chromosomes with clusters are listed by score; those of likely chains by
    the chains' scores; those of likely regions in order. detail: genes at the events' breakpoints, with is_driver.
    """
    out = sv.select("sample_id").distinct().withColumn("analysis_mode", F.lit(SV_ONLY if ct is None and cs is None else WITH_CNV))
    null, skipped = F.lit(None).cast("long"), F.lit("Not analyzed")
    listed = lambda names: F.when(F.size(names) > 0, F.array_join(names, ", ")).otherwise("None")
    if ct is not None:
        kind = F.col("classification")
        place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i, c in enumerate(CHROMOSOMES) for x in (c, i)]), "chrom"), F.lit(len(CHROMOSOMES)))
        by_score = lambda of: _in_order(F.col("chrom"), -F.coalesce("confidence_score", F.lit(0.0)), place, of=of)
        c = ct.groupBy("sample_id").agg(
            F.count_if(kind == "High confidence").alias("chromothripsis_high_confidence"), F.count_if(kind == "Low confidence").alias("chromothripsis_low_confidence"),
            by_score(kind == "High confidence").alias("_high"), by_score(kind == "Low confidence").alias("_low"),
        )
        high, low = (F.array_join(F.coalesce(n, F.array().cast("array<string>")), ", ") for n in ("_high", "_low"))
        text = F.when((high != "") & (low != ""), F.concat(high, F.lit(" (high); "), low, F.lit(" (low)"))).when(high != "", high).when(low != "", F.concat(low, F.lit(" (low confidence)"))).otherwise("None")
        out = out.join(c, "sample_id", "left").na.fill(0, list(COUNTS["chromothripsis"])).withColumn("chromothripsis_chromosomes", text).drop("_high", "_low")
    else:
        out = out.withColumns({**dict.fromkeys(COUNTS["chromothripsis"], null), "chromothripsis_chromosomes": skipped})
    if chain is not None:
        kind = F.col("classification")
        c = chain.groupBy("sample_id").agg(F.count_if(kind == cp.LIKELY).alias("chromoplexy_likely"), F.count_if(kind == cp.POSSIBLE).alias("chromoplexy_possible"), F.count("*").alias("chromoplexy_chains"))
        # a chromosome's place is its first one, so a sample moves a row a chromosome and not its chains
        names = chain.where(kind == cp.LIKELY).select("sample_id", (-F.col("combined_score")).alias("s"), "chain_id", F.posexplode("chromosomes").alias("i", "chrom"))
        names = names.groupBy("sample_id", "chrom").agg(F.min(F.struct("s", "chain_id", "i")).alias("first"))
        names = names.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("first", "chrom"))), lambda x: x["chrom"]).alias("_names"))
        c = c.join(names, "sample_id", "left")
        out = out.join(c, "sample_id", "left").na.fill(0, ["chromoplexy_likely", "chromoplexy_possible", "chromoplexy_chains"]).withColumn("chromoplexy_chromosomes", listed(F.coalesce("_names", F.array().cast("array<string>")))).drop("_names")
    else:
        out = out.withColumns({"chromoplexy_likely": null, "chromoplexy_possible": null, "chromoplexy_chains": null, "chromoplexy_chromosomes": skipped})
    if event is not None:
        out = out.join(event.groupBy("sample_id").agg(F.count("*").alias("chromoplexy_collapsed_events")), "sample_id", "left").na.fill(0, ["chromoplexy_collapsed_events"])
        if detail is not None:
            d = detail.where("is_driver").groupBy("sample_id").agg(F.array_join(F.sort_array(F.collect_set("symbol")), ", ").alias("_drivers"))
            drivers = F.when(F.col("chromoplexy_collapsed_events") == 0, "Not annotated").otherwise(F.coalesce("_drivers", F.lit("None")))
            out = out.join(d, "sample_id", "left").withColumn("chromoplexy_driver_genes", drivers).drop("_drivers")
        else:
            out = out.withColumn("chromoplexy_driver_genes", F.lit("Not annotated"))
    else:
        out = out.withColumns({"chromoplexy_collapsed_events": null, "chromoplexy_driver_genes": skipped})
    if cs is not None:
        kind = F.col("classification")
        c = cs.groupBy("sample_id").agg(
            F.count_if(kind == "Likely chromoanasynthesis").alias("chromoanasynthesis_likely"), F.count_if(kind == "Possible chromoanasynthesis").alias("chromoanasynthesis_possible"), F.count("*").alias("chromoanasynthesis_regions"),
            _in_order(F.col("chrom"), F.col("region_id"), of=kind == "Likely chromoanasynthesis").alias("_names"),
        )
        out = out.join(c, "sample_id", "left").na.fill(0, ["chromoanasynthesis_likely", "chromoanasynthesis_possible", "chromoanasynthesis_regions"]).withColumn("chromoanasynthesis_chromosomes", listed(F.coalesce("_names", F.array().cast("array<string>")))).drop("_names")
    else:
        out = out.withColumns({"chromoanasynthesis_likely": null, "chromoanasynthesis_possible": null, "chromoanasynthesis_regions": null, "chromoanasynthesis_chromosomes": skipped})
    return out.withColumn("overall_classification", overall_class())


def overall_class() -> Column:
    """The summary's words for the mechanisms that a sample has."""
    found = mechanisms_present()
    return F.when(F.size(found) == 0, "No chromoanagenesis detected").when(F.size(found) == 1, F.concat(F.initcap(found[0]), F.lit(" only"))).otherwise(F.concat(F.lit("Multiple mechanisms: "), F.array_join(found, ", ")))
