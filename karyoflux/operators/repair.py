"""Repair signatures from the sequences beside breakpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_complement(s: Column) -> Column:
    """Case stays; what is no base becomes N."""
    return F.reverse(F.translate(F.regexp_replace(s, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def microhomology_length(disc1: Column, disc2: Column, longest: int = 25, mode: str = "run") -> Column:
    """Bases that the start of one discarded sequence shares with the end of the other.

    run: lengths 1, 2, ... as long as every one matches, so two or more need a repeated base. longest: the greatest that matches.
    """
    a, b = F.upper(disc1), F.upper(disc2)
    top = F.least(F.length(a), F.length(b), F.lit(longest))
    match = F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.length(b) - k + 1, k))
    if mode == "longest":
        found = F.aggregate(F.transform(match, lambda m, i: F.when(m, i + 1).otherwise(0)), F.lit(0), lambda x, y: F.greatest(x, y))
    else:
        at = F.array_position(match, False)
        found = F.when(at == 0, F.size(match)).otherwise(at - 1)
    return F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(0)).otherwise(found).cast("long")


def inserted(ref: Column, alt: Column, insseq: Column) -> Column:
    """Inserted bases: INSSEQ if given, else what a plain ALT has beyond REF."""
    longer = F.when(alt.rlike("^[ACGTNacgtn]+$") & (F.length(alt) > F.length(ref)), F.substring(alt, F.length(ref) + 1, F.length(alt)))
    return F.coalesce(F.nullif(insseq, F.lit("")), longer)


def classify(flank: DataFrame, sv: DataFrame, least: int = 2, longest: int = 25, mode: str = "run") -> DataFrame:
    """Each variant's repair class: by microhomology if at least `least` bases, else end joining; with confidence and evidence.

    Without sequences (has_sequence false, or null ones) the length of microhomology is null and counts as 0.
    """
    s = sv.select("sample_id", "sv_id", "svtype", *[F.col(c) if c in sv.columns else F.lit(None).cast("string").alias(c) for c in ("ref", "alt", "insseq")])
    known = F.col("s1_disc").isNotNull() & F.col("s2_disc").isNotNull() & (F.coalesce("has_sequence", F.lit(False)) if "has_sequence" in flank.columns else F.lit(True))
    x = flank.join(s, ["sample_id", "sv_id"]).withColumn("mh_length", F.when(known, microhomology_length(F.col("s1_disc"), F.col("s2_disc"), longest, mode))).withColumn("insertion", inserted(F.col("ref"), F.col("alt"), F.col("insseq")))
    n, added = F.coalesce("mh_length", F.lit(0)), F.length(F.coalesce("insertion", F.lit("")))
    found = n >= least
    kind = F.when(found & (F.col("svtype") == "DUP") & n.between(2, 5), "MMBIR/FoSTeS").when(found & (n > 20), "SSA").when(found, "MMEJ").otherwise("NHEJ")
    sure = F.when(kind == "MMBIR/FoSTeS", "Moderate").when(found | (added > 0), "High").otherwise("Moderate")
    return x.select(
        "sample_id", "sv_id", "svtype", "mh_length", (F.col("mh_length") >= least).alias("has_microhomology"), kind.alias("repair_mechanism"), sure.alias("confidence"), F.format_string("MH: %d bp, Ins: %d bp", n, added).alias("evidence")
    )


def summary(repair: DataFrame) -> DataFrame:
    """A row a sample: variants, those with microhomology and their share, mean, median and range of all known lengths, zeros
    included, and the most frequent class (least name on ties)."""
    mh = F.col("mh_length")
    share = F.coalesce(F.avg(F.col("has_microhomology").cast("int")), F.lit(0.0))
    return repair.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if("has_microhomology").alias("n_microhomology"), share.alias("proportion"), F.avg(mh).alias("mean_length"), F.median(mh).alias("median_length"), F.min(mh).alias("min_length"), F.max(mh).alias("max_length"),
        F.coalesce(F.mode("repair_mechanism", True), F.lit("Unknown")).alias("dominant_mechanism"),
    )


def region_text(repair: DataFrame, keys: list[str], top: int = 2) -> DataFrame:
    """keys with the most frequent classes as text: "X (60%), Y (40%)"."""
    c = repair.groupBy(*keys, "repair_mechanism").agg(F.count("*").alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "repair_mechanism"))).where(F.col("place") <= top)
    piece = F.struct("place", F.format_string("%s (%d%%)", F.col("repair_mechanism"), F.bround(100 * F.col("n") / F.col("total"), 0).cast("int")).alias("t"))
    return c.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["t"]), ", ").alias("repair_summary"))


def junctions(sv: DataFrame, genome_seq: DataFrame, flank: int = 50, chunk: int = 100_000) -> DataFrame:
    """(sample_id, sv_id, has_sequence, s1_kept, s1_disc, s2_kept, s2_disc): the sequences beside each junction, from the chunks (chrom,
    bin, seq) of the genome.

    A + side keeps what lies before and at the breakpoint and discards what follows; a - side keeps what lies at and behind it. The
    junction is read from side 1 to side 2, so sequences of a - first side and of a + second side are reverse complemented. A sequence
    that would leave its chromosome is null. Variants on chromosomes that the genome lacks have has_sequence false and empty text.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(f"chrom{n}").alias("chrom"), F.col(f"pos{n}").alias("pos"), F.col(f"strand{n}").alias("strand")) for n in (1, 2)])
    s = sv.select("sample_id", "sv_id", F.explode(sides).alias("s")).select("sample_id", "sv_id", "s.*")
    ends = genome_seq.groupBy("chrom").agg(F.max(F.col("bin") * chunk + F.length("seq")).alias("last"))
    s = s.join(ends, "chrom", "left")
    lo, hi = F.greatest(F.col("pos") - flank, F.lit(1)), F.least(F.col("pos") + flank, F.col("last"))
    wanted = s.where(lo <= hi).withColumn("bin", F.explode(F.sequence(((lo - 1) / chunk).cast("long"), ((hi - 1) / chunk).cast("long"))))
    first = F.greatest(lo - F.col("bin") * chunk, F.lit(1))  # of the chunk's part, from 1
    part = F.substring("seq", first.cast("int"), (F.least(hi - F.col("bin") * chunk, F.lit(chunk)) - first + 1).cast("int"))
    found = wanted.join(genome_seq, ["chrom", "bin"]).select("sample_id", "sv_id", "side", "bin", part.alias("part"))
    found = found.groupBy("sample_id", "sv_id", "side").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bin", "part"))), lambda x: x["part"]), "").alias("around"))
    j = s.join(found, ["sample_id", "sv_id", "side"], "left").withColumn("lo", lo)

    def bases(start: Column, end: Column) -> Column:
        inside = (start >= 1) & (end <= F.col("last"))
        return F.when(inside, F.substring("around", (start - F.col("lo") + 1).cast("int"), (end - start + 1).cast("int")))

    pos, plus = F.col("pos"), F.col("strand") == "+"
    kept = F.when(plus, bases(pos - flank + 1, pos)).otherwise(bases(pos, pos + flank - 1))
    disc = F.when(plus, bases(pos + 1, pos + flank)).otherwise(bases(pos - flank, pos - 1))
    turned = plus == (F.col("side") == 2)
    read = lambda seq: F.when(turned, reverse_complement(seq)).otherwise(seq)
    j = j.withColumns({"kept": read(kept), "disc": read(disc)})
    pick = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    out = j.groupBy("sample_id", "sv_id").agg(F.bool_and(F.col("last").isNotNull()).alias("has_sequence"), *[pick(n, c).alias(f"s{n}_{c}") for n in (1, 2) for c in ("kept", "disc")])
    return out.withColumns({c: F.when(F.col("has_sequence"), F.col(c)).otherwise("") for c in ("s1_kept", "s1_disc", "s2_kept", "s2_disc")})
