"""Schemas, parameter defaults and constants of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SV_COLUMNS = ["sample_id", "sv_id", "chrom1", "pos1", "strand1", "chrom2", "pos2", "strand2", "svtype"]
CNV_COLUMNS = ["sample_id", "chrom", "start", "end", "total_cn", "seg_no"]
GENE_COLUMNS = ["symbol", "gene_id", "chrom", "start", "end", "strand", "type", "gene_type", "is_driver"]
SV_TYPES = ("DEL", "DUP", "h2hINV", "t2tINV", "TRA")
MECHANISMS = ("chromothripsis", "chromoplexy", "chromoanasynthesis")

#: Autosomes and X, in natural order.
CHROMOSOMES = tuple(str(n) for n in range(1, 23)) + ("X",)

# Public assembly lengths in bases, in the order of CHROMOSOMES.
CHROM_SIZES = {
    "hg19": (
        249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895,
        115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560,
    ),
    "hg38": (
        248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309,
        114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895,
    ),
}
# Approximate centromere positions in bases, in the order of CHROMOSOMES.
CENTROMERES = {
    "hg19": (
        125000000, 93300000, 91000000, 50400000, 48400000, 61000000, 59900000, 45600000, 49000000, 40200000, 53700000, 35800000,
        17900000, 17600000, 19000000, 36600000, 24000000, 17200000, 26500000, 27500000, 13200000, 14700000, 60600000,
    ),
    "hg38": (
        123400000, 93900000, 90900000, 50000000, 48800000, 59800000, 60100000, 45200000, 43000000, 39800000, 53400000, 35500000,
        17700000, 17200000, 17000000, 36800000, 25100000, 18500000, 26200000, 28100000, 12000000, 15000000, 61000000,
    ),
}
# Genome sizes in bases used by the rate estimates.
GENOME_SIZE = {"hg19": 3137161264, "hg38": 3088269832}
# Cancer genes that count as drivers when no gene list is given.
DEFAULT_DRIVERS = (
    "TP53 MYC PTEN BRCA1 BRCA2 EGFR KRAS NRAS HRAS BRAF PIK3CA APC VHL RB1 CDKN2A CCND1 MDM2 ERBB2 ATM ATR MLH1 MSH2 MSH6 PMS2 ARID1A SMARCA4 "
    "PBRM1 KMT2A KMT2D CREBBP EP300 NOTCH1 FBXW7 SF3B1 TERT ALK ROS1 RET MET NTRK1 NTRK2 NTRK3 FGFR1 FGFR2 FGFR3 KIT PDGFRA FLT3 IDH1 IDH2 WT1 "
    "NPM1 RUNX1 DNMT3A TET2 JAK2 BCL2 BCL6 MYCN CDK4 CDK6 CTNNB1 NF1 NF2 SMAD4 GATA3 FOXA1 MED12 SETD2 BAP1 CDH1"
).split()


def genome_table(spark: SparkSession, genome: str = "hg19") -> DataFrame:
    """(chrom, chrom_no, size, centromere): one row a chromosome."""
    rows = [(c, i + 1, CHROM_SIZES[genome][i], CENTROMERES[genome][i]) for i, c in enumerate(CHROMOSOMES)]
    return spark.createDataFrame(rows, "chrom string, chrom_no int, size long, centromere long")
