"""The tables behind plots: arcs, ideograms, densities, landscapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.operators.intervals import join_overlapping
from karyoflux.operators.segments import with_linear
from karyoflux.operators.variants import inter


def arcs(sv: DataFrame, genome: DataFrame) -> DataFrame:
    """Variants with both ends along the genome, span and a class of curvature by it."""
    s = with_linear(with_linear(sv, genome, "chrom1", "pos1", "x1"), genome, "chrom2", "pos2", "x2")
    span = F.abs(F.col("pos2") - F.col("pos1"))
    height = F.when(F.col("chrom1") != F.col("chrom2"), "translocation").when(span < 1_000_000, "short").when(span < 10_000_000, "medium").otherwise("long")
    return s.withColumn("span", F.when(F.col("chrom1") == F.col("chrom2"), span)).withColumn("curvature", height)


def chromosome_bounds(genome: DataFrame) -> DataFrame:
    """Start, end and middle of each chromosome along the genome."""
    w = Window.orderBy("chrom_no").rowsBetween(Window.unboundedPreceding, -1)
    g = genome.withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)))
    return g.select("chrom", "chrom_no", "start", (F.col("start") + F.col("size")).alias("end"), (F.col("start") + F.col("size") / 2).alias("middle"), (F.col("start") + F.col("centromere")).alias("centromere"))


def density(sv: DataFrame) -> DataFrame:
    """Breakpoints by sample, chromosome and type, zero cells included."""
    from karyoflux.operators.variants import breakpoints

    b = breakpoints(sv).join(sv.select("sample_id", "sv_id", "svtype"), ["sample_id", "sv_id"])
    n = b.groupBy("sample_id", "chrom", "svtype").agg(F.count("*").alias("n"))
    frame = n.select("sample_id", "chrom").distinct().crossJoin(F.broadcast(n.select("svtype").distinct()))
    return frame.join(n, ["sample_id", "chrom", "svtype"], "left").na.fill(0, ["n"])


def genome_copy_numbers(cnv: DataFrame, genome: DataFrame, cap: float = 6.0) -> DataFrame:
    """Segments along the genome with the copy number cut at cap and its class."""
    c = with_linear(with_linear(cnv, genome, "chrom", "start", "x1"), genome, "chrom", "end", "x2")
    cn = F.col("total_cn")
    return c.withColumn("shown_cn", F.least(cn, F.lit(cap))).withColumn("state", F.when(cn < 2, "loss").when(cn > 2, "gain").otherwise("neutral"))


def scaled_segments(cnv: DataFrame, keys: list[str]) -> DataFrame:
    """Copy numbers scaled to 0 to 1 within keys; 0.5 where all are the same."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("total_cn").over(w), F.max("total_cn").over(w)
    return cnv.withColumn("scaled_cn", F.when(hi > lo, (F.col("total_cn") - lo) / (hi - lo)).otherwise(0.5))


def event_gene_labels(detail: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` gene names at each breakpoint of an event, in order."""
    return detail.groupBy("sample_id", "collapsed_event_id", "breakpoint_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("symbol")), 1, most), ",").alias("label"))


def mechanism_matrix(loc: DataFrame, genome: DataFrame) -> DataFrame:
    """Presence of each mechanism on each chromosome of each sample with calls."""
    mech = loc.select("mechanism").distinct()
    frame = loc.select("sample_id").distinct().crossJoin(F.broadcast(genome.select("chrom"))).crossJoin(F.broadcast(mech))
    n = loc.groupBy("sample_id", "chrom", "mechanism").agg(F.count("*").alias("n_events"))
    return frame.join(n, ["sample_id", "chrom", "mechanism"], "left").na.fill(0, ["n_events"])


def dominance_labels(dominance: DataFrame) -> DataFrame:
    """Shares with the middle of each label along the stack."""
    w = Window.partitionBy("sample_id").orderBy("mechanism").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dominance.withColumn("label_at", F.sum("proportion").over(w) - F.col("proportion") / 2)


def landscape(summary: DataFrame, clinical: DataFrame) -> DataFrame:
    """Samples in order: group, then mechanisms, then shattered chromosomes."""
    has = lambda c: (F.coalesce(F.col(c), F.lit(0)) > 0).cast("int")
    s = summary.join(clinical.select("sample_id", "grp"), "sample_id", "left")
    s = s.withColumn("order_score", 1000 * (has("chromothripsis_high_confidence") + has("chromoplexy_likely") + has("chromoanasynthesis_likely")) + F.coalesce("chromothripsis_high_confidence", F.lit(0)))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("order_score"), "sample_id"))).select("grp", "place", "sample_id", "order_score", "overall_classification")


def repair_by_type(repair: DataFrame) -> DataFrame:
    return repair.groupBy("svtype", "repair_mechanism").agg(F.count("*").alias("n")).withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("svtype")))


def microhomology_histogram(repair: DataFrame) -> DataFrame:
    return repair.where("mh_length > 0").groupBy("mh_length").agg(F.count("*").alias("n"))


def format_position(pos):
    """Text in Mb, Kb or bases; ties are rounded up."""
    return F.when(pos >= 1_000_000, F.format_string("%.2f Mb", pos / 1e6)).when(pos >= 1000, F.format_string("%.1f Kb", pos / 1e3)).otherwise(F.concat(pos.cast("string"), F.lit(" bp")))


def circular_arcs(sv: DataFrame, genome: DataFrame) -> DataFrame:
    """Interchromosomal variants as arcs of a circle: the angle of each end in turns, and the share of the circle between them."""
    size = genome.agg(F.sum("size").alias("whole"))
    a = arcs(inter(sv), genome).crossJoin(F.broadcast(size)).select("sample_id", "sv_id", (F.col("x1") / F.col("whole")).alias("turn1"), (F.col("x2") / F.col("whole")).alias("turn2"))
    gap = F.abs(F.col("turn2") - F.col("turn1"))
    return a.withColumn("between", F.least(gap, 1 - gap))


def region_links(sv: DataFrame, loc: DataFrame) -> DataFrame:
    """Interchromosomal variants with an end in a called region: (sample_id, sv_id, mechanism, ends), ends the number of ends inside."""
    s = inter(sv)
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("end_no"), F.col(f"chrom{n}").alias("chrom"), F.col(f"pos{n}").alias("pos")) for n in (1, 2)]))
    s = s.select("sample_id", "sv_id", ends.alias("e")).select("sample_id", "sv_id", "e.*")
    r = loc.select("sample_id", "chrom", "mechanism", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    j = join_overlapping(s, r, ["sample_id", "chrom"], (F.col("pos"), F.col("pos")), (F.col("r_start"), F.col("r_end")))
    return j.groupBy("sample_id", "sv_id", "mechanism").agg(F.countDistinct("end_no").alias("ends"))


def fusion_repair(fusion: DataFrame, repair: DataFrame) -> DataFrame:
    """Fusions with how their junction was repaired."""
    r = repair.select("sample_id", "sv_id", "repair_mechanism", "mh_length")
    return fusion.select("sample_id", "sv_id", "fusion_name", "type", "status").join(r, ["sample_id", "sv_id"], "left")
