"""Structural variants and copy numbers from VCF text.

Files are read as lines, many at once; each line keeps the file's name, which becomes the sample. Callers are told by file from
the header. Parsing is a projection over the line's fields and its INFO text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karyoflux.model import CHROMOSOMES
from karyoflux.operators.segments import merge_adjacent
from karyoflux.operators.variants import canonical, plain_chrom, size_filter, standard_type
from karyoflux.runtime import materialize

SV_CALLERS = ("dragen", "manta", "gridss", "delly", "lumpy", "sniffles")
CNV_CALLERS = ("dragen", "cnvkit", "gatk", "freec", "canvas")
CN_INFO = ("CN", "CNV", "TOTAL_CN", "TCN", "CN_TOTAL")
CN_FORMAT = ("CN", "CNV", "TCN", "NG")
#: Local strand, then remote strand, of each connection type.
CONNECTION = {"3to5": "+-", "5to3": "-+", "3to3": "++", "5to5": "--"}
_ALT = r"([\[\]])([^:\[\]]+):([0-9]+)([\[\]])"


def read_lines(spark: SparkSession, path: str | list[str], sample_name: str | None = None) -> DataFrame:
    """(sample_id, line) of VCF files, plain or gzipped; the sample is the file's name without its endings unless given."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(?i)(\.vcf)?(\.b?gz)?$", "")
    return spark.read.text(path).select((F.lit(sample_name) if sample_name else name).alias("sample_id"), F.col("value").alias("line"))


def callers(lines: DataFrame, names: tuple[str, ...] = SV_CALLERS) -> DataFrame:
    """(sample_id, caller): from ##source, else for variants from the INFO keys that the header declares, else generic."""
    h = lines.where(F.col("line").startswith("##"))
    low = F.lower("line")
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    key = lambda k: has(F.col("line").startswith(f"##INFO=<ID={k},"))
    flags = {f"src_{n}": has(low.startswith("##source") & low.contains(n)) for n in names}
    flags |= {f"key_{k}": key(k) for k in ("MATEID", "SVTYPE", "CT", "STRANDS", "RNAMES")}
    g = h.groupBy("sample_id").agg(*[v.alias(k) for k, v in flags.items()])
    by_source = F.coalesce(*[F.when(F.col(f"src_{n}"), n) for n in names])
    by_key = F.when(F.col("key_MATEID") & F.col("key_SVTYPE"), "gridss").when(F.col("key_CT"), "delly").when(F.col("key_STRANDS"), "lumpy").when(F.col("key_RNAMES"), "sniffles")
    found = F.coalesce(by_source, by_key, F.lit("generic")) if names is SV_CALLERS else F.coalesce(by_source, F.lit("generic"))
    all_samples = lines.select("sample_id").distinct()
    return all_samples.join(g.select("sample_id", found.alias("caller")), "sample_id", "left").withColumn("caller", F.coalesce("caller", F.lit("generic")))


def records(lines: DataFrame) -> DataFrame:
    """sample_id, chrom, pos, id, ref, alt, info (its KEY=VALUE parts), format, sample (first sample's field)."""
    f = F.split("line", "\t")
    r = lines.where(~F.col("line").startswith("#") & (F.size(f) >= 8))
    return r.select(
        "sample_id", F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(2)).alias("id"), F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.split(F.try_element_at(f, F.lit(8)), ";").alias("info"),
        F.try_element_at(f, F.lit(9)).alias("format"), F.try_element_at(f, F.lit(10)).alias("sample"),
    ).where("pos IS NOT NULL")


def _key(*names: str) -> Column:
    """The value of the first of names that INFO has; of a repeated key the last."""
    last = lambda n: F.try_element_at(F.filter("info", lambda p: p.startswith(f"{n}=")), F.lit(-1))
    return F.coalesce(*[F.nullif(F.substring(last(n), len(n) + 2, 1 << 30), F.lit("")) for n in names])


def _flag(name: str) -> Column:
    return F.exists("info", lambda p: (p == name) | p.startswith(f"{name}="))


def breakend(alt: Column) -> dict[str, Column]:
    """chrom, pos and strands of a breakend: local - if ALT starts with a bracket, else +; remote + if it opens with [, else -."""
    there = alt.rlike(_ALT)
    return {
        "chrom2": F.when(there, F.regexp_extract(alt, _ALT, 2)), "pos2": F.when(there, F.regexp_extract(alt, _ALT, 3).try_cast("long")),
        "strand1": F.when(there, F.when(alt.rlike(r"^[\[\]]"), "-").otherwise("+")), "strand2": F.when(there, F.when(F.regexp_extract(alt, _ALT, 1) == "[", "+").otherwise("-")),
    }


def parse_breakends(rec: DataFrame) -> DataFrame:
    """Single-record breakends (SVTYPE=BND) between supported chromosomes, as translocations."""
    b = breakend(F.col("alt"))
    r = rec.where((_key("SVTYPE") == "BND") & F.col("alt").rlike(_ALT))
    r = r.select("sample_id", F.col("id").alias("sv_id"), plain_chrom(F.col("chrom")).alias("chrom1"), F.col("pos").alias("pos1"), b["strand1"].alias("strand1"), plain_chrom(b["chrom2"]).alias("chrom2"), b["pos2"].alias("pos2"), b["strand2"].alias("strand2"), F.lit("TRA").alias("svtype"))
    return r.where(F.col("chrom1").isin(*CHROMOSOMES) & F.col("chrom2").isin(*CHROMOSOMES))


def parse(rec: DataFrame, caller: Column) -> DataFrame:
    """Every record as a variant, by its file's caller; ends from CHR2 and END, END2 or POS2, else the ALT breakend, else its own place.

    delly: strands from CT. manta, dragen: INV3 and INV5 flags. lumpy: STRANDS. Others: INV as head to head, INS as DUP, BND as TRA.
    """
    b = breakend(F.col("alt"))
    r = rec.select(
        "sample_id", F.col("id").alias("sv_id"), "chrom", "pos", caller.alias("who"), F.coalesce(_key("SVTYPE"), F.regexp_extract("alt", "<([^>:]+)", 1)).alias("raw"), _key("CHR2", "CHROM2", "chr2").alias("there"),
        _key("POS2", "END2").alias("pos_key"), _key("END").alias("end_key"), _key("END", "END2", "POS2").alias("any_end"), _key("CT").alias("ct"), F.nullif(F.substring(_key("STRANDS"), 1, 2), F.lit("")).alias("strands"),
        F.when(_flag("INV3"), "++").when(_flag("INV5"), "--").alias("inv"), _key("MATEID").alias("mate"), b["chrom2"].alias("b_chrom"), b["pos2"].alias("b_pos"), F.concat(b["strand1"], b["strand2"]).alias("b_pair"),
        F.monotonically_increasing_id().alias("record"),  # keeps later filters from being pushed into, and copied all over, these expressions
    )
    raw, who = F.col("raw"), F.col("who")
    by_type = F.create_map(*[x for k, v in CONNECTION.items() for x in (F.lit(k), F.lit(v))])[F.col("ct")]
    told = F.when(who == "delly", by_type).when(who == "lumpy", F.col("strands")).when(who.isin("manta", "dragen"), F.col("inv"))
    usual = F.when(raw.startswith("DEL"), "+-").when(raw.startswith("DUP") | raw.startswith("INS"), "-+").when(raw.startswith("INV"), "++")
    # delly writes POS2 beside an END of another meaning; others say the far end in END or ALT, and ALT counts where INFO says none
    delly_pos = F.coalesce(F.when(F.col("pos_key").isNull(), F.col("b_pos")), F.coalesce("pos_key", "end_key").try_cast("long"), F.col("pos"))
    said_chrom, said_pos = F.coalesce("there", "chrom"), F.coalesce(F.col("any_end").try_cast("long"), F.col("pos"))
    by_alt = F.col("b_pos").isNotNull() & (F.coalesce("there", "any_end").isNull() | ((plain_chrom(said_chrom) == plain_chrom(F.col("chrom"))) & (said_pos == F.col("pos"))))
    pos2 = F.when(who == "delly", delly_pos).when(by_alt, F.col("b_pos")).otherwise(said_pos)
    far = F.when(who == "delly", F.coalesce("there", "b_chrom", "chrom")).when(by_alt, F.col("b_chrom")).otherwise(said_chrom)
    r = r.withColumn("pair", F.coalesce(told, F.col("b_pair"), usual, F.lit("+-"))).withColumn("pos2", pos2).withColumn("far", far)
    r = r.select("sample_id", "sv_id", plain_chrom(F.col("chrom")).alias("chrom1"), F.col("pos").alias("pos1"), F.substring("pair", 1, 1).alias("strand1"), plain_chrom(F.col("far")).alias("chrom2"), "pos2", F.substring("pair", 2, 1).alias("strand2"), "raw", "mate", "record")
    kind = standard_type(F.col("raw"), F.col("chrom1"), F.col("chrom2"), F.col("strand1"), F.col("strand2"))
    return r.withColumn("svtype", F.when(F.col("raw").isin("BND", "TRA"), "TRA").otherwise(kind))


def pair_breakends(parsed: DataFrame) -> DataFrame:
    """Mutual mates as one variant, the one that comes first, with the place and own strand of each and the type of both; records
    whose mate is missing stay as they are. Of mates with one identifier the first record counts."""
    once = Window.partitionBy("sample_id", "sv_id").orderBy("record")
    m = parsed.where(F.col("mate").isNotNull()).withColumn("_k", F.row_number().over(once)).where("_k = 1")
    m = m.select(F.col("sample_id").alias("m_sample"), F.col("sv_id").alias("m_id"), F.col("mate").alias("m_mate"), F.col("chrom1").alias("m_chrom"), F.col("pos1").alias("m_pos"), F.col("strand1").alias("m_strand"), F.col("record").alias("m_record"))
    j = parsed.join(m, (F.col("sample_id") == F.col("m_sample")) & (F.col("mate") == F.col("m_id")) & (F.col("m_mate") == F.col("sv_id")), "left")
    paired = F.col("m_id").isNotNull()
    j = j.where(~paired | (F.struct("chrom1", "pos1", "sv_id", "record") <= F.struct("m_chrom", "m_pos", "m_id", "m_record")))
    j = j.withColumns({"chrom2": F.coalesce("m_chrom", "chrom2"), "pos2": F.coalesce("m_pos", "pos2"), "strand2": F.coalesce("m_strand", "strand2")})
    kind = standard_type(F.col("raw"), F.col("chrom1"), F.col("chrom2"), F.col("strand1"), F.col("strand2"))
    return j.withColumn("svtype", F.when(paired, kind).otherwise(F.col("svtype"))).drop("m_sample", "m_id", "m_mate", "m_chrom", "m_pos", "m_strand", "m_record", "mate", "raw")


def sv_from_lines(lines: DataFrame, caller: str = "auto", min_sv_size: int = 50, include_tra: bool = True) -> DataFrame:
    """The variant table (model.SV_COLUMNS and sv_no) of lines."""
    rec = records(lines)
    rec = rec.join(callers(lines), "sample_id") if caller == "auto" else rec.withColumn("caller", F.lit(caller))
    # written once: text is not parsed again for every use, and the filters below don't drag the parser's expressions along
    read = materialize(parse(rec, F.col("caller")), "variants")
    single = read.where(F.col("mate").isNull()).drop("mate", "raw")  # most records have no mate, and needn't meet others
    parsed = single.unionByName(pair_breakends(read.where(F.col("mate").isNotNull())))
    sv = size_filter(canonical(parsed.drop("record")), min_sv_size, include_tra)
    return sv.withColumn("sv_no", F.row_number().over(Window.partitionBy("sample_id").orderBy("chrom1", "pos1", "sv_id")).cast("long"))


def read_sv_vcf(spark: SparkSession, path: str | list[str], caller: str = "auto", min_sv_size: int = 50, include_tra: bool = True, sample_name: str | None = None) -> DataFrame:
    return sv_from_lines(read_lines(spark, path, sample_name), caller, min_sv_size, include_tra)


def cnv_from_lines(lines: DataFrame, cn_field: str | None = None, merge: bool = True) -> DataFrame:
    """The segment table of lines: END (else the start), copy number from INFO or the first sample's FORMAT field.

    cn_field names the field, as INFO:NAME or FORMAT:NAME; else FORMAT CN counts first for dragen, then the usual INFO names, then
    the usual FORMAT names. Records without a copy number or on other chromosomes are dropped.
    """
    rec = records(lines).join(callers(lines, CNV_CALLERS), "sample_id")
    fmt = lambda n: F.try_element_at(F.split("sample", ":"), F.nullif(F.array_position(F.split("format", ":"), n), F.lit(0)).cast("int"))
    if cn_field:
        where, _, name = cn_field.rpartition(":")
        value = fmt(name) if where == "FORMAT" else _key(name) if where == "INFO" else F.coalesce(_key(name), fmt(name))
    else:
        value = F.coalesce(F.when(F.col("caller") == "dragen", fmt("CN")), *[_key(n) for n in CN_INFO], *[fmt(n) for n in CN_FORMAT])
    c = rec.select("sample_id", plain_chrom(F.col("chrom")).alias("chrom"), F.col("pos").alias("start"), F.coalesce(_key("END").try_cast("long"), F.col("pos")).alias("end"), value.try_cast("double").alias("total_cn"))
    c = c.where(F.col("total_cn").isNotNull() & F.col("chrom").isin(*CHROMOSOMES))
    c = c.withColumn("seg_no", F.row_number().over(Window.partitionBy("sample_id", "chrom").orderBy("start", "end")))
    return merge_adjacent(c).drop("n_merged") if merge else c


def read_cnv_vcf(spark: SparkSession, path: str | list[str], cn_field: str | None = None, merge: bool = True, sample_name: str | None = None) -> DataFrame:
    return cnv_from_lines(read_lines(spark, path, sample_name), cn_field, merge)
