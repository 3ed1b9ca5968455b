"""Genes at breakpoints and in regions, fusions and disruptions, impact of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.model import DEFAULT_DRIVERS
from karyoflux.operators.intervals import join_overlapping
from karyoflux.operators.variants import plain_chrom


def gene_side(gene: DataFrame) -> DataFrame:
    """The gene table as a side of binned joins, which broadcast it if it has few rows and shuffle it if not."""
    return gene.withColumn("chrom", plain_chrom(F.col("chrom")))


def with_drivers(gene: DataFrame, drivers: list[str] | None = None) -> DataFrame:
    """gene with is_driver and gene_type, from its own columns, else from the driver list."""
    if "is_driver" not in gene.columns:
        gene = gene.withColumn("is_driver", F.col("symbol").isin(*(drivers or DEFAULT_DRIVERS)))
    return gene if "gene_type" in gene.columns else gene.withColumn("gene_type", F.lit("Unknown"))


def at_breakpoints(points: DataFrame, gene: DataFrame, padding: int = 1000) -> DataFrame:
    """points (chrom, pos, ...) with each gene within padding and its distance (0 inside)."""
    g = gene_side(with_drivers(gene)).select("symbol", "gene_id", "gene_type", "is_driver", "chrom", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"))
    j = join_overlapping(points, g, ["chrom"], (F.col("pos") - padding, F.col("pos") + padding), (F.col("gene_start"), F.col("gene_end")))
    return j.withColumn("distance_to_breakpoint", F.greatest(F.lit(0), F.col("gene_start") - F.col("pos"), F.col("pos") - F.col("gene_end")))


def event_genes(event: DataFrame, detail: DataFrame) -> DataFrame:
    """Events with their genes, drivers, driver impact and priority (0.8 of quality, 0.2 of drivers)."""
    keys = ["sample_id", "collapsed_event_id"]
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    g = detail.groupBy(*keys).agg(
        F.countDistinct("symbol").alias("n_genes"), names(F.col("symbol")).alias("genes"), F.countDistinct(F.when(F.col("is_driver"), F.col("symbol"))).alias("n_driver_genes"), names(F.when(F.col("is_driver"), F.col("symbol"))).alias("driver_genes")
    )
    e = event.join(g, keys, "left").na.fill({"n_genes": 0, "n_driver_genes": 0, "genes": "", "driver_genes": ""})
    e = e.withColumn("driver_impact_score", F.least(F.col("n_driver_genes") / 3, F.lit(1.0)))
    return e.withColumn("event_priority_score", 0.8 * F.col("event_qc_score") + 0.2 * F.col("driver_impact_score"))


def gene_events(detail: DataFrame) -> DataFrame:
    """A row a gene: the events that hit it."""
    return detail.groupBy("sample_id", "symbol").agg(
        F.min("gene_id").alias("gene_id"), F.bool_or("is_driver").alias("is_driver"), F.countDistinct("collapsed_event_id").alias("n_events"), F.array_join(F.sort_array(F.collect_set("collapsed_event_id")), ",").alias("events"), F.min("distance_to_breakpoint").alias("min_distance")
    )


def in_regions(region: DataFrame, gene: DataFrame) -> DataFrame:
    """region (chrom, start, end, ...) with each gene that overlaps it."""
    g = gene_side(with_drivers(gene)).select("symbol", "gene_type", "is_driver", "chrom", F.col("start").alias("gene_start"), F.col("end").alias("gene_end"))
    return join_overlapping(region, g, ["chrom"], (F.col("start"), F.col("end")), (F.col("gene_start"), F.col("gene_end")))


def consistency(gene_type, impact):
    """Whether a gene's role fits what happened to it."""
    onco, tsg = gene_type.contains("ONCOGENE"), gene_type.contains("TSG")
    broken = impact.isin("Breakpoint_Disruption", "Region_Overlap")
    return (
        F.when(gene_type == "Unknown", "Unknown").when((impact == "Amplification_Target") & onco, "Consistent (Oncogene Amp)").when((impact == "Amplification_Target") & tsg, "Inconsistent (TSG Amp)")
        .when(broken & tsg, "Consistent (TSG Loss)").when(broken & onco, "Potential Fusion/Disruption").otherwise("Indeterminate")
    )


def impact(ct_high: DataFrame, cp_points: DataFrame, cs_likely: DataFrame, gene: DataFrame, padding: int = 500) -> DataFrame:
    """Genes in high-confidence shattered clusters, at breakpoints of likely chains and in likely gained regions, one row each."""
    text = F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    columns = ["sample_id", "symbol", "gene_type", "is_driver", "mechanism", "impact_type", "region"]
    a = in_regions(ct_high, gene).withColumns({"mechanism": F.lit("Chromothripsis"), "impact_type": F.lit("Region_Overlap"), "region": text}).select(*columns)
    b = at_breakpoints(cp_points, gene, padding).withColumns({"mechanism": F.lit("Chromoplexy"), "impact_type": F.lit("Breakpoint_Disruption"), "region": F.concat_ws(":", "chrom", F.col("pos").cast("string"))}).select(*columns)
    c = in_regions(cs_likely, gene).withColumns({"mechanism": F.lit("Chromoanasynthesis"), "impact_type": F.lit("Amplification_Target"), "region": text}).select(*columns)
    out = a.unionByName(b).unionByName(c).distinct()
    return out.withColumn("mechanism_consistency", consistency(F.col("gene_type"), F.col("impact_type")))


def _side_hits(sv: DataFrame, gene: DataFrame, n: int, max_distance: int) -> DataFrame:
    g = gene_side(gene).select(F.col("symbol").alias(f"gene{n}"), F.col("strand").alias(f"gene{n}_strand"), F.col("start").alias(f"gene{n}_start"), F.col("end").alias(f"gene{n}_end"), F.col("type").alias(f"gene{n}_type"), F.col("chrom").alias("s_chrom"))
    s = sv.select("sample_id", "sv_id", F.col(f"chrom{n}").alias("s_chrom"), F.col(f"pos{n}").alias("s_pos"), F.col(f"strand{n}").alias("s_strand"))
    reach = max_distance + 1
    same = (F.col(f"gene{n}_strand") == F.col("s_strand")) | (F.col(f"gene{n}_strand") == "*") | (F.col("s_strand") == "*")
    at = F.when(F.col(f"gene{n}_strand") == "-", F.col(f"gene{n}_end") - F.col("s_pos")).otherwise(F.col("s_pos") - F.col(f"gene{n}_start")) / (F.col(f"gene{n}_end") - F.col(f"gene{n}_start"))
    j = join_overlapping(s, g, ["s_chrom"], (F.col("s_pos") - reach, F.col("s_pos") + reach), (F.col(f"gene{n}_start"), F.col(f"gene{n}_end"))).where(same)
    j = j.withColumn(f"gene{n}_pos_pct", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at)) * 100, 1))
    j = j.withColumn(f"exon{n}", F.max((F.col(f"gene{n}_type") == "exon").cast("int")).over(Window.partitionBy("sample_id", "sv_id")) == 1)
    return j.where(F.coalesce(F.col(f"gene{n}_type"), F.lit("gene")).isin("gene", "mRNA")).select("sample_id", "sv_id", f"gene{n}", f"gene{n}_strand", f"gene{n}_pos_pct", f"exon{n}")


def fusions(sv: DataFrame, gene: DataFrame, max_distance: int = 1000, drivers: list[str] | None = None) -> DataFrame:
    """Variants with a gene at both ends (fusions) or at one (disruptions), genes on the breakpoint's strand, one row a gene pair."""
    h1, h2 = _side_hits(sv, gene, 1, max_distance), _side_hits(sv, gene, 2, max_distance)
    key = ["sample_id", "sv_id"]
    both = h1.join(h2, key).where("gene1 <> gene2").withColumn("kind", F.lit("Fusion"))
    only1 = h1.join(h2.select(*key), key, "left_anti").withColumn("kind", F.lit("Disruption"))
    only2 = h2.join(h1.select(*key), key, "left_anti").withColumn("kind", F.lit("Disruption"))
    x = both.unionByName(only1, allowMissingColumns=True).unionByName(only2, allowMissingColumns=True).join(sv.select(*key, "svtype", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2"), key)
    fits = lambda a, b: (F.col(f"gene{a}_strand") == F.col(f"strand{a}")) & (F.col(f"gene{b}_strand") != F.col(f"strand{b}"))
    fusion = F.col("kind") == "Fusion"
    forward, backward = fusion & fits(1, 2), fusion & ~fits(1, 2) & fits(2, 1)
    p5 = F.when(backward, F.col("gene2")).otherwise(F.coalesce("gene1", F.lit("intergenic")))
    p3 = F.when(backward, F.col("gene1")).otherwise(F.coalesce("gene2", F.lit("intergenic")))
    exon = F.coalesce("exon1", F.lit(False)) | F.coalesce("exon2", F.lit(False))
    status = F.when(fusion, F.concat(F.when(forward | backward, "Canonical").otherwise("Non-canonical"), F.when(exon, " (Exon disruption)").otherwise(" (Intronic)"))).otherwise(F.when(exon, "Exon disruption").otherwise("Intron disruption"))
    named = lambda c: F.when(c == "intergenic", F.lit("(intergenic)")).otherwise(c)
    if "is_driver" in gene.columns and drivers is None:
        d = gene.where("is_driver").select("symbol").distinct()
        x = x.join(F.broadcast(d.select(F.col("symbol").alias("gene1"), F.lit(True).alias("d1"))), "gene1", "left").join(F.broadcast(d.select(F.col("symbol").alias("gene2"), F.lit(True).alias("d2"))), "gene2", "left")
        driver = F.coalesce("d1", F.lit(False)) | F.coalesce("d2", F.lit(False))
    else:
        names = list(drivers or DEFAULT_DRIVERS)
        driver = F.coalesce(F.col("gene1").isin(*names), F.lit(False)) | F.coalesce(F.col("gene2").isin(*names), F.lit(False))
    return x.select(
        "sample_id", "sv_id", F.concat(named(p5), F.lit("::"), named(p3)).alias("fusion_name"), p5.alias("gene_5p"), p3.alias("gene_3p"), F.col("kind").alias("type"), status.alias("status"),
        F.when(fusion, forward | backward).alias("orientation_compatible"), F.col("svtype").alias("sv_type"), "chrom1", "pos1", "chrom2", "pos2", "gene1_pos_pct", "gene2_pos_pct", driver.alias("is_driver_involved"),
    )
