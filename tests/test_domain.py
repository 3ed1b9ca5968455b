"""Fixtures with values derived by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from karyoflux.functions import stats
from karyoflux.model import SV_COLUMNS, genome_table
from karyoflux.operators import chromoanasynthesis, chromoplexy, chromothripsis, cohort, genes, repair, segments, variants
from karyoflux.sources import vcf

SV = "sample_id string, sv_id string, chrom1 string, pos1 long, strand1 string, chrom2 string, pos2 long, strand2 string, svtype string, sv_no long"
CNV = "sample_id string, chrom string, start long, end long, total_cn double, seg_no int"


def triangle(a, b, sample="S1"):
    return [(sample, "sv1", "1", a, "+", "2", a, "-", "TRA", 1), (sample, "sv2", "2", b, "+", "3", a, "-", "TRA", 2), (sample, "sv3", "3", b, "+", "1", b, "-", "TRA", 3)]


def test_triangle_without_statistics(spark):
    sv = spark.createDataFrame(triangle(1_000_000, 1_100_000), SV)
    edges = chromoplexy.graph(sv).collect()
    assert sorted(e.edge_type for e in edges) == ["ADJACENCY"] * 3 + ["TRANSLOCATION"] * 3
    assert all(abs(e.evidence_strength - math.exp(-0.05)) < 1e-9 for e in edges if e.edge_type == "ADJACENCY")
    c = chromoplexy.detect(sv, statistical=False)
    (row,) = c.collect()
    assert (row.n_chromosomes, row.n_translocations, row.n_adjacency_edges, row.is_cycle) == (3, 3, 2, True)
    assert row.complexity_score == pytest.approx(0.56) and row.combined_score == pytest.approx(0.336) and row.classification == "Likely chromoplexy"
    (event,) = chromoplexy.events(c, sv).collect()
    assert event.event_qc_score == pytest.approx(0.448983333) and event.event_confidence == "Low" and event.collapsed_event_id == "CE001"


def test_triangle_with_statistics(spark):
    sv = spark.createDataFrame(triangle(1_000_000, 1_200_000), SV)
    (row,) = chromoplexy.detect(sv).collect()
    assert row.pvalue == pytest.approx(6.497917824e-6, rel=1e-6) and row.fdr == pytest.approx(4.780935506e-4, rel=1e-6)
    assert row.combined_score == pytest.approx(0.524348304) and row.evidence_mode == "SV-only" and row.classification == "Likely chromoplexy"
    cnv = spark.createDataFrame([("S1", c, 1 + k * 1_000_000, (k + 1) * 1_000_000, 2.0, k + 1) for c in "123" for k in range(4)], CNV)
    (row,) = chromoplexy.detect(sv, cnv).collect()
    assert row.cn_stability_score == pytest.approx(1) and row.combined_score == pytest.approx(0.667043813) and row.classification == "Likely chromoplexy"
    assert row.evidence_mode == "SV+CNV"


def test_interleaving(spark):
    rows = [("S", n, "1", a, "+", "1", b, "-", "DEL", i) for i, (n, a, b) in enumerate([("A", 10, 50), ("B", 30, 80), ("C", 35, 40), ("D", 80, 90)])]
    sv = spark.createDataFrame(rows, SV)
    assert {(r.a, r.b) for r in chromothripsis.interleaving_pairs(sv).collect()} == {("A", "B"), ("B", "D")}
    got = {r.sv_id: (r.component, r.n) for r in chromothripsis.components(sv).collect()}
    assert got == {"A": ("A", 3), "B": ("A", 3), "D": ("A", 3), "C": ("C", 1)}


@pytest.mark.parametrize(("cn", "two", "three"), [([1, 2, 1, 2, 1, 2, 1, 2, 1], 9, 9), ([1, 3, 5, 7, 9], 2, 2), ([1, 2, 3], None, None)])
def test_oscillation(spark, cn, two, three):
    cnv = spark.createDataFrame([("S", "1", 100 * i + 1, 100 * i + 100, float(x), i + 1) for i, x in enumerate(cn)], CNV)
    (r,) = segments.longest_runs(cnv).collect()
    assert (r.osc2, r.osc3) == (two, three)


def test_merge(spark):
    cnv = spark.createDataFrame([("S", "1", a, b, float(c), i) for i, (a, b, c) in enumerate([(1, 100, 2), (101, 200, 2), (201, 300, 3), (500, 600, 3)])], CNV)
    assert [(r.start, r.end) for r in segments.merge_adjacent(cnv).orderBy("start").collect()] == [(1, 200), (201, 300), (500, 600)]


def test_local_cluster(spark):
    rows = [("S", f"v{p}", "1", p, "+", "2", 10**7 * (i + 1), "-", "TRA", i) for i, p in enumerate([100, 900, 1800, 5000])]
    (r,) = variants.local_clusters(spark.createDataFrame(rows, SV)).collect()
    assert (r.start, r.end, r.n_svs) == (100, 1800, 3)


def test_microhomology(spark):
    df = spark.createDataFrame([("AAAC", "CGAAA"), ("ACGT", "TTAC"), ("", "A")], "a string, b string")
    run = [r[0] for r in df.select(repair.microhomology_length(F.col("a"), F.col("b"))).collect()]
    top = [r[0] for r in df.select(repair.microhomology_length(F.col("a"), F.col("b"), mode="longest")).collect()]
    assert run == [3, 0, 0] and top == [3, 2, 0]


def test_statistics(spark):
    df = spark.createDataFrame([(1, p) for p in (0.01, 0.02, 0.03, 0.5)], "g int, p double")
    assert sorted(r.q for r in stats.with_bh(df, "p", "q", ["g"]).collect()) == pytest.approx([0.04, 0.04, 0.04, 0.5])
    (r,) = spark.range(1).select(stats.fisher_combine(F.lit(2 * math.log(0.05)), F.lit(2)).alias("p")).collect()
    assert r.p == pytest.approx(0.01747866, rel=1e-6)
    (r,) = spark.range(1).select(chromoplexy.bridge_confidence(F.lit(0), F.lit(1000), F.lit(0.0)).alias("a"), chromoplexy.bridge_confidence(F.lit(200000), F.lit(20000), F.lit(1.0)).alias("b")).collect()
    assert r.a == pytest.approx(1.0) and r.b == pytest.approx(math.exp(-1))


def test_thin_keeps_the_better():
    assert chromoanasynthesis.thin([(0, 100, 0.5), (5, 100, 0.9), (200, 300, 0.1)]) == [1, 2]


def test_breakends(spark):
    lines = ["##source=Sniffles2", "#CHROM\tPOS"] + [f"chr{a}\t1000000\tb{a}\tN\tN[CHR{b}:1000000[\t60\tPASS\tSVTYPE=BND" for a, b in ((1, 2), (2, 3), (3, 1))]
    df = spark.createDataFrame([("T5", x) for x in lines], "sample_id string, line string")
    got = vcf.sv_from_lines(df).orderBy("sv_id").collect()
    assert [(r.chrom1, r.chrom2, r.svtype, r.strand1, r.strand2) for r in got] == [("1", "2", "TRA", "+", "+"), ("2", "3", "TRA", "+", "+"), ("3", "1", "TRA", "+", "+")]
    assert set(SV_COLUMNS) <= set(vcf.sv_from_lines(df).columns)
    assert vcf.callers(df).first().caller == "sniffles"


def test_copy_numbers_from_text(spark):
    lines = ["##source=other", "chr1\t1\ta\tN\t<DEL>\t.\tPASS\tEND=100;CN=1\tGT:CN\t0/1:7", "chr1\t101\tb\tN\t<DEL>\t.\tPASS\tEND=200;CN=1\tGT\t0/1", "1\t201\tc\tN\t<DUP>\t.\tPASS\tEND=300\tGT:CN\t0/1:3", "GL1\t1\td\tN\t.\t.\tPASS\tEND=9;CN=2"]
    df = spark.createDataFrame([("S", x) for x in lines], "sample_id string, line string")
    assert [(r.start, r.end, r.total_cn) for r in vcf.cnv_from_lines(df).orderBy("start").collect()] == [(1, 200, 1.0), (201, 300, 3.0)]


def test_gene_hits_and_bins(spark):
    gene = spark.createDataFrame([("TP53", "TP53", "1", 999_500, 1_000_500, "+", "gene"), ("KRAS", "KRAS", "2", 1, 10, "-", "gene")], "symbol string, gene_id string, chrom string, start long, end long, strand string, type string")
    points = spark.createDataFrame([("S", "CE001", "1", 1_000_000), ("S", "CE001", "1", 1_001_000)], "sample_id string, collapsed_event_id string, chrom string, pos long")
    assert sorted((r.pos, r.symbol, r.distance_to_breakpoint, r.is_driver) for r in genes.at_breakpoints(points, gene).collect()) == [(1_000_000, "TP53", 0, True), (1_001_000, "TP53", 500, True)]
    bins = {r.window_start for r in cohort.recurrent_regions(cohort.with_event_id(points)).collect()}
    assert bins == {1, 1_000_001}


def test_empty_tables(spark):
    sv, cnv = spark.createDataFrame([], SV), spark.createDataFrame([], CNV)
    assert chromothripsis.cluster_summary(sv, cnv).count() == 0
    assert chromoplexy.detect(sv, cnv).count() == 0
    assert segments.merge_adjacent(cnv).count() == 0
    assert genome_table(spark).count() == 23
