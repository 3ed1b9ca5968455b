"""Interval joins, sweeps, statistics, survival, sources, streaming and the whole analysis, on small tables against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from karyoflux.functions import stats
from karyoflux.operators import chromothripsis, cohort, intervals, survival, variants
from karyoflux.plans import analysis
from karyoflux.sources import tables, vcf
from karyoflux.streaming import ingest
from test_domain import CNV, SV, triangle


def test_intervals_by_brute_force(spark):
    r = random.Random(1)
    draw = lambda n: [(r.choice("ab"), i, s, s + r.choice([-1, 0, 5, 99, 100, 1000, 5000])) for i, s in ((i, r.randrange(-300, 3000)) for i in range(n))]
    left, right = draw(80), draw(80)
    a, b = spark.createDataFrame(left, "k string, i long, s long, e long"), spark.createDataFrame(right, "k string, j long, t long, f long")
    got = intervals.join_overlapping(a, b, ["k"], (F.col("s"), F.col("e")), (F.col("t"), F.col("f")), 100).select("k", "i", "j").collect()
    want = sorted((x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted(map(tuple, got)) == want and len(want) > 100


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 8)), max_size=9))
def test_sweep_is_the_components_of_all_pairs(spans):
    p1, p2 = [a for a, _ in spans], [a + n for a, n in spans]
    label = list(range(len(spans)))
    for a, b in itertools.permutations(range(len(spans)), 2):
        if p1[a] < p1[b] and p1[b] - 1 <= p2[a] + 1 and p2[a] < p2[b]:
            label = [label[a] if x == label[b] else x for x in label]
    got = chromothripsis.sweep(p1, p2)
    assert all((got[a] == got[b]) == (label[a] == label[b]) for a in range(len(spans)) for b in range(a))


def test_components_over_partitions(spark):
    r = random.Random(2)
    rows = [(f"S{i % 7}", f"v{i}", "1", p, "+", "1", p + r.randrange(10, 4000), "-", "DEL", i) for i, p in ((i, r.randrange(20_000)) for i in range(200))]
    sv = spark.createDataFrame(rows, SV).repartition(5)
    got = {(x.sample_id, x.sv_id): (x.component, x.n) for x in chromothripsis.components(sv).collect()}
    for s in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == s]
        found = chromothripsis.sweep([x[3] for x in own], [x[6] for x in own])
        for x, g in zip(own, found, strict=True):
            same = [y[1] for y, h in zip(own, found, strict=True) if h == g]
            assert got[s, x[1]] == (min(same), len(same))


def test_cox_closed_form():
    """One two-valued covariate without ties: the slope that makes the score of the partial likelihood zero, by bisection."""
    time, event, x = np.arange(1.0, 13), np.ones(12, int), np.array([1, 1, 0, 1, 0, 1, 0, 0, 1, 0, 0, 1.0])

    def score(beta):
        return sum(x[i] - (x[i:] * np.exp(beta * x[i:])).sum() / np.exp(beta * x[i:]).sum() for i in range(12))

    lo, hi = -5.0, 5.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if score(mid) > 0 else (lo, mid)
    beta, se = stats.cox(time, event, x[:, None])
    info = sum((w := np.exp(lo * x[i:])) @ (x[i:] ** 2) / w.sum() - (w @ x[i:] / w.sum()) ** 2 for i in range(12))
    assert beta[0] == pytest.approx(lo, abs=1e-6) and se[0] == pytest.approx(1 / math.sqrt(info), rel=1e-5)


def test_survival_events_and_text_features(spark):
    c = spark.createDataFrame([("a", 10.0, 1.0), ("b", 5.0, 0.0), ("c", 7.0, 2.0), ("d", 3.0, None)], "sample_id string, os_time double, os_event double")
    f = spark.createDataFrame([("a", "male", "x", 1), ("b", "female", "y", 2), ("c", "", "z", 3), ("d", None, "x", 4)], "sample_id string, sex string, site string, n long")
    got = {(r.sample_id, r.feature): (r.event, r.value) for r in survival.long_form(f, c).collect()}
    assert got == {("a", "sex"): (1, 1.0), ("b", "sex"): (0, 0.0), ("a", "n"): (1, 1.0), ("b", "n"): (0, 2.0)}
    words = spark.createDataFrame([(w,) for w in ("T", " Relapsed ", "no event", "1.0", "0", "relapse", "living", None)], "w string")
    assert [r[0] for r in words.select(survival.event_flag(F.col("w"))).collect()] == [1, 1, 0, 1, 0, None, None, None]
    assert [r[0] for r in spark.createDataFrame([(True,), (False,)], "w boolean").select(survival.event_flag(F.col("w"))).collect()] == [1, 0]


def test_types_of_mates(spark):
    """Mates within a chromosome get the type of their own strands; one without its mate stays a translocation."""
    lines = ["chr1\t1000\ta1\tN\tN[chr1:900000[\t.\tPASS\tSVTYPE=BND;MATEID=a2", "chr1\t900000\ta2\tN\t]chr1:1000]N\t.\tPASS\tSVTYPE=BND;MATEID=a1", "chr2\t500\tb1\tN\tN]chr2:90000]\t.\tPASS\tSVTYPE=BND;MATEID=b2",
             "chr2\t90000\tb2\tN\tN]chr2:500]\t.\tPASS\tSVTYPE=BND;MATEID=b1", "chr3\t5\tc1\tN\tN[chr4:9[\t.\tPASS\tSVTYPE=BND;MATEID=gone"]
    got = {r.sv_id: (r.svtype, r.strand1 + r.strand2, r.pos1, r.pos2) for r in vcf.sv_from_lines(spark.createDataFrame([("S", x) for x in lines], "sample_id string, line string"), "gridss").collect()}
    assert got == {"a1": ("DEL", "+-", 1000, 900_000), "b1": ("h2hINV", "++", 500, 90_000), "c1": ("TRA", "++", 5, 9)}


def test_strands_are_checked_whatever_is_read(spark):
    bad = spark.createDataFrame([("S", "v", "1", 1, "?", "1", 9, "-", "DEL", 1)], SV)
    with pytest.raises(Exception, match="strands must be"):
        variants.check_strands(bad).select("pos1").collect()
    assert variants.check_strands(spark.createDataFrame(triangle(1, 2), SV)).count() == 3


def test_cache_and_tables(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, n long")
    tables.write_cache(df, f"{tmp_path}/cache", batch=1)
    tables.write_cache(spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], df.schema), f"{tmp_path}/cache", batch=2)
    assert sorted(map(tuple, tables.read_cache(spark, f"{tmp_path}/cache").select("sample_id", "n").collect())) == [("a", 1), ("b", 3), ("b", 4), ("c", 5)]
    (tmp_path / "sheet.csv").write_text("sv_file,cnv_file\n/x/s1.vcf.gz,\n/x/s2.vcf,/x/c2.vcf\n")
    sheet = tables.read_sample_sheet(spark, str(tmp_path / "sheet.csv"))
    assert [r.sample_id for r in sheet.orderBy("sample_id").collect()] == ["s1", "s2"]
    tables.write_table(df.withColumn("l", F.array(F.lit(1), F.lit(2))), f"{tmp_path}/t")
    assert sorted(r.l for r in spark.read.csv(f"{tmp_path}/t", header=True, sep="\t").collect()) == ["1,2", "1,2"]


def test_cohort_tables(spark):
    s = spark.createDataFrame([("a", "Chromoplexy", 0, 2, None), ("b", None, 1, 0, 3)], "sample_id string, overall_classification string, chromothripsis_high_confidence long, chromoplexy_likely long, chromoanasynthesis_likely long")
    f = spark.createDataFrame([("a",), ("a",)], "sample_id string")
    assert sorted(map(tuple, cohort.results(s, f).collect())) == [("a", "Chromoplexy", 0.0, 2.0, 0.0, 2), ("b", "Unknown", 1.0, 0.0, 3.0, 0)]
    lists = spark.createDataFrame([("TP53, KRAS", "TP53"), ("KRAS;", None), (None, "")], "genes string, driver_genes string")
    assert sorted(r[0] for r in cohort.gene_symbols(lists).collect()) == ["KRAS", "TP53"] and [r[0] for r in cohort.gene_symbols(lists, driver_only=True).collect()] == ["TP53"]
    g = spark.createDataFrame([("b", 2, 3, False), ("a", 2, 3, False), ("c", 2, 3, True), ("d", 9, 1, False)], "symbol string, n_samples long, n_collapsed_events long, is_driver boolean")
    assert [r.symbol for r in cohort.ordered(g, "gene").collect()] == ["d", "c", "a", "b"]


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, pos in (("s1", 100), ("s2", 200)):
        (tmp_path / "in" / f"{name}.vcf").write_text(f"##source=x\nchr1\t{pos}\tv\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END={pos + 999}\n")
    lines = ingest.arriving_lines(spark, str(tmp_path / "in"))
    ingest.score_arrivals(lines, lambda sv: sv.groupBy("sample_id").agg(F.min("pos1").alias("first")), f"{tmp_path}/cache", f"{tmp_path}/ck").awaitTermination()
    assert sorted((r.sample_id, r.first) for r in tables.read_cache(spark, f"{tmp_path}/cache").collect()) == [("s1", 100), ("s2", 200)]


def test_analysis_of_a_triangle(spark):
    sv = spark.createDataFrame(triangle(1_000_000, 1_200_000), SV)
    cnv = spark.createDataFrame([("S1", c, 1 + 1_000_000 * k, 1_000_000 * (k + 1), 2.0, k + 1) for c in "123" for k in range(4)], CNV)
    gene = spark.createDataFrame([("TP53", "TP53", "1", 999_500, 1_000_500, "+", "gene")], "symbol string, gene_id string, chrom string, start long, end long, strand string, type string")
    found = analysis.analyze(sv, cnv, gene)
    (r,) = found["results"].collect()
    assert (r.classification, r.cp_likely) == ("Chromoplexy only", 1.0)
    (m,) = found["summary"].collect()
    assert (m.analysis_mode, m.chromothripsis_chromosomes, m.chromoplexy_chromosomes, m.chromoplexy_driver_genes, m.chromoanasynthesis_chromosomes) == ("SV+CNV integrated", "None", "1, 2, 3", "TP53", "None")
    (k,), (w,) = found["sample_class"].collect(), found["complexity"].collect()
    assert (k.classification, k.category, k.n_overlaps, w.level) == ("Pure chromoplexy", "single_mechanism", 0, "Low")
    assert {(d.mechanism, d.n_events, d.dominant) for d in found["dominance"].collect()} == {("chromothripsis", 0, "chromoplexy"), ("chromoplexy", 1, "chromoplexy"), ("chromoanasynthesis", 0, "chromoplexy")}
    (f,) = found["fdr"].where("mechanism = 'chromoplexy'").collect()
    assert found["fdr"].count() == 24 and f.adjusted_pvalue == pytest.approx(24 * f.original_pvalue)  # 23 chromosomes are tests too
    (f,) = found["features"].collect()
    assert (f.has_chromoplexy, f.n_chromoplexy_genes, f.has_cycle_chromoplexy_event, len(f)) == (1, 1, 1, 34)
    assert found["overlaps"].count() == 0 and analysis.analyze(sv)["results"].count() == 1


def test_sheets_aligned_by_blanks(spark, tmp_path):
    (tmp_path / "sheet.txt").write_text("sample_id   sv_file\t cnv_file # files\n\ns1          a/one.vcf.gz    NA\ns2\tb/two.vcf  c.vcf\n  s3   d.vcf\n")
    got = sorted((r.sample_id, r.sv_file, r.cnv_file) for r in tables.read_sample_sheet(spark, str(tmp_path / "sheet.txt")).collect())
    assert got == [("s1", "a/one.vcf.gz", None), ("s2", "b/two.vcf", "c.vcf"), ("s3", "d.vcf", None)]
    (tmp_path / "names.tsv").write_text("sv_file\nx/one.vcf.gz\ny/two.VCF\n")
    assert sorted(r.sample_id for r in tables.read_sample_sheet(spark, str(tmp_path / "names.tsv")).collect()) == ["one", "two"]
    (tmp_path / "again.txt").write_text("sample_id sv_file\ns a\ns b\n")
    with pytest.raises(ValueError, match="repeated samples: s"):
        tables.read_sample_sheet(spark, str(tmp_path / "again.txt"))
    (tmp_path / "none.txt").write_text("\n")
    with pytest.raises(ValueError, match="no header"):
        tables.read_sample_sheet(spark, str(tmp_path / "none.txt"))


def test_callers_of_copy_numbers_are_told_by_their_header(spark):
    line = "chr1\t1\ta\tN\t<DEL>\t.\tPASS\tEND=100;CN=1\tGT:CN\t0/1:7"
    names = {"DRAGEN 3.9": "dragen", "CNVkit v0.9": "cnvkit", "GATK-CNV": "gatk", "FREEC": "freec", "Canvas 1.4": "canvas", "other": "generic"}
    rows = [(n, x) for n in names for x in (f"##source={n}", "##INFO=<ID=CN,Number=1>", "#CHROM\tPOS", line)] + [("bare", line)]
    lines = spark.createDataFrame(rows, "sample_id string, line string")
    assert {r.sample_id: r.caller for r in vcf.callers(lines, vcf.CNV_CALLERS).collect()} == {**names, "bare": "generic"}
    got = {r.sample_id: r.total_cn for r in vcf.cnv_from_lines(lines).collect()}
    assert got == {n: 7.0 if n.startswith("DRAGEN") else 1.0 for n in [*names, "bare"]}  # dragen's FORMAT field counts first
    assert {r.total_cn for r in vcf.cnv_from_lines(lines, "FORMAT:CN").collect()} == {7.0} and {r.total_cn for r in vcf.cnv_from_lines(lines, "INFO:CN").collect()} == {1.0}
