"""Structural variants: canonical form, filters, breakpoints, quality checks and local clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.model import CHROMOSOMES


def is_intra() -> Column:
    return F.col("chrom1") == F.col("chrom2")


def type_from_strands(chrom1, chrom2, strand1, strand2) -> Column:
    """TRA between chromosomes, else the type that the strand pair has; UNKNOWN for other strands."""
    pair = F.concat(strand1, strand2)
    return (
        F.when(chrom1 != chrom2, "TRA").when(pair == "+-", "DEL").when(pair == "-+", "DUP").when(pair == "++", "h2hINV").when(pair == "--", "t2tINV").otherwise("UNKNOWN")
    )


# Raw names whose variants within a chromosome get the type of their strands.
STRAND_TYPES = ("DEL", "DELETION", "DUP", "DUPLICATION", "DUP:TANDEM", "TANDEM_DUP", "INV", "INVERSION", "INS", "INSERTION", "BND", "TRA", "TRANSLOCATION")


def standard_type(raw: Column, chrom1: Column, chrom2: Column, strand1: Column, strand2: Column) -> Column:
    """The standard type of a raw name: TRA between chromosomes; within one the strands decide, but for names with a suffix
    (DEL:ME), which keep the type of their prefix, an inversion's by its strands if those agree."""
    up = F.upper(F.regexp_replace(raw, "[<>]", ""))
    by_strand = type_from_strands(chrom1, chrom2, strand1, strand2)
    inv = F.when(by_strand.isin("h2hINV", "t2tINV"), by_strand).otherwise("INV")
    starts = lambda p: up.startswith(p)
    prefix = F.when(starts("DEL"), "DEL").when(starts("DUP"), "DUP").when(starts("INV"), inv).when(starts("INS"), "DUP").when(starts("BND") | starts("TRA"), "TRA")
    return F.when(chrom1 != chrom2, "TRA").when(up.isin(*STRAND_TYPES), by_strand).otherwise(F.coalesce(prefix, by_strand))


def plain_chrom(chrom: Column) -> Column:
    """Without a chr prefix of any case; MT as M."""
    bare = F.upper(F.regexp_replace(chrom, "(?i)^chr", ""))
    return F.when(bare == "MT", "M").otherwise(bare)


def match_prefix(df: DataFrame, column: str, style: DataFrame, style_column: str) -> DataFrame:
    """df with column prefixed like most of another table: with chr if any of its values has that prefix."""
    flag = style.agg(F.coalesce(F.bool_or(F.col(style_column).startswith("chr")), F.lit(False)).alias("_chr"))
    bare = F.regexp_replace(F.col(column), "(?i)^chr", "")
    return df.crossJoin(F.broadcast(flag)).withColumn(column, F.when(F.col("_chr"), F.concat(F.lit("chr"), bare)).otherwise(bare)).drop("_chr")


def canonical(sv: DataFrame) -> DataFrame:
    """Supported chromosomes only, plain names, and lower breakpoint first within a chromosome, strands moving along."""
    sv = sv.withColumn("chrom1", plain_chrom(F.col("chrom1"))).withColumn("chrom2", plain_chrom(F.coalesce("chrom2", "chrom1")))
    sv = sv.where(F.col("chrom1").isin(*CHROMOSOMES) & F.col("chrom2").isin(*CHROMOSOMES))
    swap = is_intra() & (F.col("pos1") > F.col("pos2"))
    new = {a: F.when(swap, F.col(b)).otherwise(F.col(a)) for a, b in (("pos1", "pos2"), ("pos2", "pos1"), ("strand1", "strand2"), ("strand2", "strand1"))}
    return sv.withColumns(new).withColumn("svtype", F.coalesce("svtype", F.lit("")))


def rename_aliases(df: DataFrame, required: list[str]) -> DataFrame:
    """Older column names under today's; an error names the required columns that are missing."""
    for old, new in (("start1", "pos1"), ("start2", "pos2"), ("svclass", "svtype"), ("SVtype", "svtype"), ("chromosome", "chrom")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def check_strands(sv: DataFrame) -> DataFrame:
    """sv unchanged; the job fails on the first strand other than + or -. The check is a filter, so no pruning of columns drops it."""
    good = F.coalesce(F.col("strand1").isin("+", "-") & F.col("strand2").isin("+", "-"), F.lit(False))
    return sv.where(F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("strands must be + or -: "), F.coalesce("sv_id", F.lit("?")))).cast("boolean")))


def correct_types(sv: DataFrame) -> DataFrame:
    """Labels of variants within a chromosome that contradict their strands are replaced; empty ones and TRA stay."""
    right = type_from_strands(F.col("chrom1"), F.col("chrom2"), F.col("strand1"), F.col("strand2"))
    return sv.withColumn("svtype", F.when(F.col("svtype").isin("", "TRA") | ~is_intra(), F.col("svtype")).otherwise(right))


def size_filter(sv: DataFrame, min_size: int = 50, include_tra: bool = True) -> DataFrame:
    inter = ~is_intra() if include_tra else F.lit(False)
    return sv.where(inter | (is_intra() & (F.abs(F.col("pos2") - F.col("pos1")) >= min_size)))


def intra(sv: DataFrame) -> DataFrame:
    return sv.where(is_intra())


def inter(sv: DataFrame) -> DataFrame:
    return sv.where(~is_intra())


def breakpoints(sv: DataFrame) -> DataFrame:
    """Two rows a variant: sample_id, sv_id, sv_no, bp_no, chrom, pos, strand."""
    sides = F.array(*[F.struct(F.lit(n).alias("bp_no"), F.col(f"chrom{n}").alias("chrom"), F.col(f"pos{n}").alias("pos"), F.col(f"strand{n}").alias("strand")) for n in (1, 2)])
    return sv.select("sample_id", "sv_id", "sv_no", F.explode(sides).alias("b")).select("sample_id", "sv_id", "sv_no", "b.*")


def nodes(sv: DataFrame) -> DataFrame:
    """Breakpoints of interchromosomal variants, one row a place: the first variant there."""
    w = Window.partitionBy("sample_id", "chrom", "pos").orderBy("sv_no", "bp_no")
    return breakpoints(inter(sv)).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "strand")


def parse_node(node: Column) -> Column:
    """(chrom, pos) of chrom:pos."""
    parts = F.split(node, ":")
    return F.struct(parts[0].alias("chrom"), parts[1].cast("long").alias("pos"))


def local_clusters(sv: DataFrame, window: int = 1000, min_svs: int = 2) -> DataFrame:
    """Runs of interchromosomal breakpoints at most `window` apart with at least min_svs variants: a session per chromosome."""
    b = breakpoints(inter(sv))
    w = Window.partitionBy("sample_id", "chrom").orderBy("pos", "sv_no", "bp_no")
    b = b.withColumn("new", F.coalesce((F.col("pos") - F.lag("pos").over(w) > window).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w))
    c = b.groupBy("sample_id", "chrom", "session").agg(
        F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("n_breakpoints"), F.countDistinct("sv_id").alias("n_svs"), F.sort_array(F.collect_set("sv_id")).alias("sv_ids")
    )
    return c.where(F.col("n_svs") >= min_svs).drop("session")


def without_local_clusters(sv: DataFrame, window: int = 1000, min_svs: int = 2) -> DataFrame:
    """Germline filter: sv without the variants of local clusters."""
    flagged = local_clusters(sv, window, min_svs).select("sample_id", F.explode("sv_ids").alias("sv_id")).distinct()
    return sv.join(flagged, ["sample_id", "sv_id"], "left_anti")


def overlap_rate(sv: DataFrame, max_gap: int = 1000) -> DataFrame:
    """Share of each sample's variants whose first breakpoint has one of another variant within max_gap, over all of them."""
    w = Window.partitionBy("sample_id", "chrom1").orderBy("pos1", "sv_no")
    near = (F.col("pos1") - F.lag("pos1").over(w) <= max_gap) | (F.lead("pos1").over(w) - F.col("pos1") <= max_gap)
    return sv.withColumn("near", F.coalesce(near, F.lit(False))).groupBy("sample_id").agg(F.count("*").alias("n_svs"), F.avg(F.col("near").cast("double")).alias("overlap_rate"))


def qc_metrics(sv: DataFrame, cnv: DataFrame, small: int = 10_000) -> DataFrame:
    """A row a sample: counts by type, share between chromosomes, segments, their mean size and the share of small ones."""
    s = sv.groupBy("sample_id").agg(
        F.count("*").alias("n_svs"), F.count_if(is_intra()).alias("n_intra"), F.count_if(~is_intra()).alias("n_inter"), F.countDistinct("svtype").alias("n_types"),
        F.avg((~is_intra()).cast("double")).alias("inter_rate"),
    )
    width = F.col("end") - F.col("start") + 1
    c = cnv.groupBy("sample_id").agg(F.count("*").alias("n_segments"), F.avg(width.cast("double")).alias("mean_segment"), F.avg((width < small).cast("double")).alias("small_rate"))
    return s.join(c, "sample_id", "left").withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))


def adjacent_duplicates(cnv: DataFrame) -> DataFrame:
    """Per sample, the segments that touch or overlap the next one and have its copy number."""
    w = Window.partitionBy("sample_id", "chrom").orderBy("start", "seg_no")
    same = (F.col("end") >= F.lead("start").over(w)) & (F.col("total_cn") == F.lead("total_cn").over(w))
    touching = F.col("end") + 1 >= F.lead("start").over(w)
    c = cnv.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("touching", F.coalesce(touching & (F.col("total_cn") == F.lead("total_cn").over(w)), F.lit(False)))
    return c.groupBy("sample_id").agg(F.count_if("same").alias("n_overlapping_same"), F.count_if("touching").alias("n_touching_same"))


def quality_warnings(sv: DataFrame, cnv: DataFrame) -> DataFrame:
    """A row for each sample and warning: few variants, one type, no or few segments, repeated segments."""
    q = qc_metrics(sv, cnv).join(adjacent_duplicates(cnv), "sample_id", "left")
    issues = F.array_compact(F.array(
        F.when(F.col("n_intra") < 5, "few_intra_svs"), F.when(F.col("n_types") == 1, "single_sv_type"), F.when(F.col("n_segments") == 0, "no_segments").when(F.col("n_segments") < 10, "few_segments"),
        F.when(F.col("n_overlapping_same") > 0, "unmerged_segments"),
    ))
    return q.select("sample_id", F.explode(issues).alias("issue"))


def in_region(sv: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Variants with a breakpoint in the region."""
    return sv.where(((F.col("chrom1") == chrom) & F.col("pos1").between(start, end)) | ((F.col("chrom2") == chrom) & F.col("pos2").between(start, end)))


def clip_segments(cnv: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Segments that meet the region, cut to it."""
    c = cnv.where((F.col("chrom") == chrom) & (F.col("end") >= start) & (F.col("start") <= end))
    return c.withColumn("start", F.greatest("start", F.lit(start))).withColumn("end", F.least("end", F.lit(end)))
