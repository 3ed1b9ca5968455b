"""Command line: one sample's VCF files to its tables, e.g. python -m karyoflux --sample-id S1 --sv-vcf s1.vcf.gz --out-dir out."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from karyoflux.plans.analysis import analyze
from karyoflux.sources import tables, vcf


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="karyoflux", description="Complex rearrangements of one sample")
    p.add_argument("--sample-id", required=True)
    p.add_argument("--sv-vcf", required=True)
    p.add_argument("--cnv-vcf")
    p.add_argument("--genome", choices=["hg19", "hg38"], default="hg38")
    p.add_argument("--out-dir")
    p.add_argument("--genes", help="gene models as Parquet or CSV")
    p.add_argument("--min-sv-size", type=int, default=0)
    p.add_argument("--max-path-search", type=int, default=50)
    p.add_argument("--max-neighbors", type=int, default=3)
    p.add_argument("--prefix", help="of the tables' names; the sample's id if not given")
    p.add_argument("--enrichment", action="store_true", help="write the genes of events for an enrichment test")
    p.add_argument("--no-tables", action="store_true", help="print the summary only")
    p.add_argument("--quiet", action="store_true")
    return p.parse_args(args)


def main(args: list[str]) -> int:
    a = arguments(args)
    spark = SparkSession.builder.appName("karyoflux").getOrCreate()
    sv = vcf.read_sv_vcf(spark, a.sv_vcf, min_sv_size=a.min_sv_size, sample_name=a.sample_id)
    cnv = vcf.read_cnv_vcf(spark, a.cnv_vcf, sample_name=a.sample_id) if a.cnv_vcf else None
    gene = tables.read_genes(spark, a.genes) if a.genes else None
    found = analyze(sv, cnv, gene, a.genome, a.max_neighbors, max_paths=a.max_path_search)
    if a.enrichment and gene is not None:
        from karyoflux.operators import cohort

        found["enrichment_genes"] = cohort.gene_symbols(found["gene_hits"])
    if a.out_dir and not a.no_tables:
        for name, table in found.items():
            tables.write_table(table, f"{a.out_dir.rstrip('/')}/{a.prefix or a.sample_id}_{name}")
    if not a.quiet:
        found["summary"].show(truncate=False, vertical=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
