"""Domain tables from the driver's parquet tables: integer arithmetic only, so that other engines get the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural variants: one an event, the user as sample. sv_no is the order of input."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    buy = F.col("event_type") == "purchase"
    e = e.withColumn("chrom1", F.expr("string((event_id * 7 + user_id) % 6 + 1)")).withColumn("pos1", F.expr("1000000 + ((event_id * 104729) % 20000) * 1000"))
    return e.select(
        F.expr("concat('S', user_id)").alias("sample_id"), F.expr("concat('sv', event_id)").alias("sv_id"), "chrom1", "pos1",
        F.expr("CASE event_type WHEN 'click' THEN '+' WHEN 'view' THEN '-' WHEN 'signup' THEN '+' WHEN 'error' THEN '-' ELSE CASE WHEN event_id % 4 < 2 THEN '+' ELSE '-' END END").alias("strand1"),
        F.when(buy, F.expr("string((event_id * 7 + user_id + 1 + event_id % 5) % 6 + 1)")).otherwise(F.col("chrom1")).alias("chrom2"),
        F.when(buy, F.expr("1000000 + ((event_id * 15485863) % 20000) * 1000")).otherwise(F.expr("pos1 + bigint(floor(value * 40000)) + 2000")).alias("pos2"),
        F.expr("CASE event_type WHEN 'click' THEN '-' WHEN 'view' THEN '+' WHEN 'signup' THEN '+' WHEN 'error' THEN '-' ELSE CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END END").alias("strand2"),
        F.expr("CASE event_type WHEN 'click' THEN 'DEL' WHEN 'view' THEN 'DUP' WHEN 'signup' THEN 'h2hINV' WHEN 'error' THEN 't2tINV' ELSE 'TRA' END").alias("svtype"),
        F.col("event_id").alias("sv_no"),
    )


def cnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copy-number segments between consecutive breakpoints of a sample's chromosome; seg_no is their order."""
    e = _read(spark, sf_dir, "events").select("event_id", "user_id")
    e = e.withColumn("chrom", F.expr("string((event_id * 7 + user_id) % 6 + 1)")).withColumn("start", F.expr("1000000 + ((event_id * 104729) % 20000) * 1000"))
    w = Window.partitionBy("user_id", "chrom").orderBy("start", "event_id")
    e = e.withColumn("rn", F.row_number().over(w)).withColumn("nx", F.lead("start").over(w)).where("nx > start")
    cn = F.expr("double(CASE user_id % 3 WHEN 0 THEN 1 + rn % 2 WHEN 1 THEN least(rn, 8) ELSE 1 + (event_id * 31) % 3 END)")
    seg = F.row_number().over(Window.partitionBy("user_id", "chrom").orderBy("start"))
    return e.select(F.expr("concat('S', user_id)").alias("sample_id"), "chrom", "start", F.expr("nx - 1").alias("end"), cn.alias("total_cn"), seg.alias("seg_no"))


def gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").where("p_partkey < 300").select("p_partkey", "p_size")
    start = F.expr("1000000 + ((p_partkey * 9973) % 20000) * 1000")
    return p.select(
        F.expr("concat('G', p_partkey)").alias("symbol"), F.expr("concat('G', p_partkey)").alias("gene_id"), F.expr("string(p_partkey % 6 + 1)").alias("chrom"), start.alias("start"),
        (start + F.expr("p_size * 2000")).alias("end"), F.expr("if(p_partkey % 2 = 0, '+', '-')").alias("strand"), F.lit("gene").alias("type"),
        F.expr("CASE p_partkey % 3 WHEN 0 THEN 'ONCOGENE' WHEN 1 THEN 'TSG' ELSE 'Unknown' END").alias("gene_type"), F.expr("p_partkey % 5 = 0").alias("is_driver"),
    )


def clinical(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    c = _read(spark, sf_dir, "customer").join(users, "c_custkey", "left_semi")
    return c.select(F.expr("concat('S', c_custkey)").alias("sample_id"), F.expr("round(c_acctbal + 1000, 2)").alias("os_time"), F.expr("int(c_nationkey % 2)").alias("os_event"), F.col("c_mktsegment").alias("grp"))


def flank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences beside both breakpoints: discarded and kept sides, 32 bases and up to 23 of a shared run."""
    bases = lambda p: f"translate(md5(concat('{p}', event_id)), '0123456789abcdef', 'ACGTACGTACGTACGT')"
    k = "int(if(event_id % 4 = 0, (event_id div 4) % 24, 0))"
    return _read(spark, sf_dir, "events").select(
        F.expr("concat('S', user_id)").alias("sample_id"), F.expr("concat('sv', event_id)").alias("sv_id"), F.expr(f"concat(repeat('A', {k}), {bases('a')})").alias("s1_disc"),
        F.expr(f"concat({bases('b')}, repeat('A', {k}))").alias("s2_disc"), F.expr(bases("c")).alias("s1_kept"), F.expr(bases("d")).alias("s2_kept"),
    )


def vcf_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, line): the variants as lines of VCF text."""
    s = sv(spark, sf_dir)
    alt = F.expr("""CASE WHEN svtype = 'TRA' THEN CASE WHEN strand1 = '+' THEN concat('N[chr', chrom2, ':', pos2, '[') ELSE concat(']chr', chrom2, ':', pos2, ']N') END
                         WHEN svtype IN ('h2hINV', 't2tINV') THEN '<INV>' ELSE concat('<', svtype, '>') END""")
    ct = "CASE concat(strand1, strand2) WHEN '+-' THEN '3to5' WHEN '-+' THEN '5to3' WHEN '++' THEN '3to3' ELSE '5to5' END"
    info = F.expr(f"CASE WHEN svtype = 'TRA' THEN 'SVTYPE=BND' ELSE concat('SVTYPE=', if(svtype LIKE '%INV', 'INV', svtype), ';END=', pos2, ';CT=', {ct}) END")
    return s.select("sample_id", F.concat_ws("\t", F.concat(F.lit("chr"), "chrom1"), F.col("pos1").cast("string"), "sv_id", F.lit("N"), alt, F.lit("60"), F.lit("PASS"), info).alias("line"))


def _mate(own: str, far: str, chrom: str, pos: str) -> str:
    """SQL of the ALT text of a breakend with strand own, joined to one with strand far at chrom:pos."""
    there = f"concat('chr', {chrom}, ':', {pos})"
    return f"""CASE WHEN {own} = '+' AND {far} = '-' THEN concat('N[', {there}, '[') WHEN {own} = '+' THEN concat('N]', {there}, ']')
                    WHEN {far} = '+' THEN concat(']', {there}, ']N') ELSE concat('[', {there}, '[N') END"""


def vcf_lines_of(spark: SparkSession, sf_dir: str, caller: str) -> DataFrame:
    """(sample_id, line): the variants as this caller writes them, without header.

    gridss: two mates for every variant. manta: mates between chromosomes, INV3 and INV5 flags. lumpy: STRANDS. generic: CHR2 and END.
    """
    s = sv(spark, sf_dir).withColumn("pair", F.concat("strand1", "strand2"))
    plain = "if(svtype LIKE '%INV', 'INV', svtype)"
    o, h = _mate("strand1", "strand2", "chrom2", "pos2"), _mate("strand2", "strand1", "chrom1", "pos1")
    mates = lambda some: some.select(
        "sample_id", F.explode(F.array(
            F.struct(F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), F.concat("sv_id", F.lit("o")).alias("id"), F.expr(o).alias("alt"), F.expr("concat('SVTYPE=BND;MATEID=', sv_id, 'h')").alias("info")),
            F.struct(F.col("chrom2").alias("chrom"), F.col("pos2").alias("pos"), F.concat("sv_id", F.lit("h")).alias("id"), F.expr(h).alias("alt"), F.expr("concat('SVTYPE=BND;MATEID=', sv_id, 'o')").alias("info")),
        )).alias("r")).select("sample_id", "r.*")
    own = lambda some, info: some.select("sample_id", F.col("chrom1").alias("chrom"), F.col("pos1").alias("pos"), F.col("sv_id").alias("id"), F.expr(f"concat('<', {plain}, '>')").alias("alt"), F.expr(info).alias("info"))
    near, far = s.where("chrom1 = chrom2"), s.where("chrom1 <> chrom2")
    if caller == "gridss":
        r = mates(s)
    elif caller == "manta":
        r = own(near, f"concat('SVTYPE=', {plain}, ';END=', pos2, CASE pair WHEN '++' THEN ';INV3' WHEN '--' THEN ';INV5' ELSE '' END)").unionByName(mates(far))
    elif caller == "lumpy":
        r = own(s, f"concat('SVTYPE=', if(svtype = 'TRA', 'BND', {plain}), ';CHR2=chr', chrom2, ';END=', pos2, ';STRANDS=', pair, ':7')")
    else:
        r = own(s, f"concat('SVTYPE=', {plain}, ';CHR2=chr', chrom2, ';END=', pos2)")
    return r.select("sample_id", F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("pos").cast("string"), "id", F.lit("N"), "alt", F.lit("60"), F.lit("PASS"), "info").alias("line"))


def cnv_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, line): the segments as VCF text, with the copy number in INFO or FORMAT in turn."""
    c = cnv(spark, sf_dir)
    info = F.expr("if(seg_no % 2 = 0, concat('END=', end, ';CN=', int(total_cn)), concat('END=', end))")
    return c.select("sample_id", F.concat_ws("\t", F.concat(F.lit("chr"), "chrom"), F.col("start").cast("string"), F.concat(F.lit("seg"), F.col("seg_no").cast("string")), F.lit("N"), F.lit("<CNV>"), F.lit("."), F.lit("PASS"), info, F.lit("GT:CN"), F.expr("concat('0/1:', int(total_cn))")).alias("line"))


#: Samples that the laid-out calls are taken from where samples without calls are wanted too.
WITH_CALLS = "int(substring(sample_id, 2)) % 7 > 0"


def call_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample with the distinct events of the laid-out calls, by mechanism and certainty, named as in the integrated summary."""
    names = {"chromothripsis": ("high_confidence", "low_confidence"), "chromoplexy": ("likely", "possible"), "chromoanasynthesis": ("likely", "possible")}
    possible = F.col("classification").startswith("Possible")
    events = [F.countDistinct(F.when((F.col("mechanism") == m) & (possible if less else ~possible), F.col("event_id"))).alias(f"{m}_{n}") for m, pair in names.items() for less, n in enumerate(pair)]
    n = calls(spark, sf_dir).where(WITH_CALLS).groupBy("sample_id").agg(*events)
    return sv(spark, sf_dir).select("sample_id").distinct().join(n, "sample_id", "left").na.fill(0)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of all mechanisms laid out from all variants, with overlaps of every kind: none, one-sided, nested, exactly at and just
    under a million bases; event ids and confidences tie."""
    mech = F.expr("CASE sv_no div 6 % 3 WHEN 0 THEN 'chromothripsis' WHEN 1 THEN 'chromoplexy' ELSE 'chromoanasynthesis' END")
    return sv(spark, sf_dir).select(
        "sample_id", mech.alias("mechanism"), F.col("chrom1").alias("chrom"), F.col("pos1").alias("start"), F.expr("pos1 + 500000 + (sv_no * 7919 % 4000) * 1000 - 1").alias("end"),
        F.expr("round(0.3 + (sv_no % 7) / 10.0, 2)").cast("double").alias("confidence"), F.expr("if(sv_no % 4 = 0, 'Possible call', 'Likely call')").alias("classification"), F.expr("concat('E', sv_no div 36, '.', sv_no div 6 % 3)").alias("event_id"),
    )


def fasta_lines(sv: DataFrame) -> DataFrame:
    """(chrom, line_no, line): FASTA text of chromosomes 1 to 5, of 32 bases a line made of digests, up to the last position of sv.

    Chromosome 6 is missing, so some variants have no sequence.
    """
    last = sv.agg(F.expr("max(greatest(pos1, pos2)) div 32 + 1").alias("n"))
    lines = last.select("n", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("c")).select(F.col("c").cast("string").alias("chrom"), F.explode(F.expr("sequence(-1L, n)")).alias("line_no"))
    bases = F.translate(F.md5(F.concat_ws(":", F.lit("fa"), "chrom", F.col("line_no").cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return lines.select("chrom", "line_no", F.when(F.col("line_no") < 0, F.concat(F.lit(">chr"), "chrom", F.lit(" made of digests"))).otherwise(bases).alias("line"))
