"""The integration layer, chain comparison, chain context and junction sequences against plain versions of their rules."""

import math
import random
import statistics

import pytest

from karyoflux.model import genome_table
from karyoflux.operators import chromoplexy, integrate, rate_chains, repair
from karyoflux.plans import analysis
from karyoflux.sources import fasta
from test_domain import CNV, SV, triangle


# -- one sample's class -----------------------------------------------------------------------------------------------------
COUNTS = [c for pair in integrate.COUNTS.values() for c in pair]
LOC = "sample_id string, mechanism string, chrom string, start long, end long, confidence double, classification string, event_id string"


def test_class_of_samples_with_and_without_calls(spark):
    rows = [("none", 0, 0, 0, 0, 0, 0), ("low", 0, 1, 0, 0, 0, 0), ("possible", 0, 0, 0, 3, 0, 2), ("two", 2, 0, 1, 0, 0, 1), ("apart", 1, 0, 0, 0, 2, 0), ("skipped", None, None, 1, 0, None, None)]
    summary = spark.createDataFrame(rows, "sample_id string, " + ", ".join(f"{c} long" for c in COUNTS))
    loc = spark.createDataFrame([
        ("two", "chromothripsis", "1", 1, 5_000_000, 0.9, "High confidence", "CT_1"), ("two", "chromoplexy", "1", 2_000_000, 9_000_000, 0.7, "Likely chromoplexy", "CP_1"), ("two", "chromoplexy", "2", 5, 6, 0.7, "Likely chromoplexy", "CP_1"),
        ("apart", "chromothripsis", "3", 1, 100, 0.5, "High confidence", "CT_3"), ("apart", "chromoanasynthesis", "4", 1, 100, 0.5, "Likely chromoanasynthesis", "CS_1"), ("possible", "chromoplexy", "X", 1, 2, 0.7, "Possible chromoplexy", "CP_2"),
    ], LOC)
    pairs = integrate.overlaps(loc)
    (p,) = pairs.collect()
    assert (p.mechanism1, p.mechanism2, p.mechanism_pair, p.overlap_size) == ("chromothripsis", "chromoplexy", "chromoplexy+chromothripsis", 3_000_001)
    got = {r.sample_id: tuple(r)[1:] for r in integrate.sample_class(summary, loc, pairs).collect()}
    assert got == {
        "none": ("No chromoanagenesis", "normal", 0, 0, False, 0), "low": ("Pure chromothripsis", "single_mechanism", 1, 0, False, 0), "possible": ("No chromoanagenesis", "normal", 0, 0, False, 0),
        "two": ("Mixed mechanisms with spatial overlap (chromothripsis+chromoplexy)", "mixed_overlapping", 2, 1, True, 1), "skipped": ("Pure chromoplexy", "single_mechanism", 1, 0, False, 0),
        "apart": ("Multiple independent mechanisms (chromothripsis+chromoanasynthesis)", "mixed_independent", 2, 0, False, 0),
    }
    score = {r.sample_id: (r.score, r.level, r.n_events) for r in integrate.complexity(summary, loc, pairs).collect()}
    assert score["none"] == (0.0, "Low", 0) and score["two"][0] == pytest.approx(2 / 3 * 0.3 + 0.2 * 0.25 + 0.2 * 0.25 + 0.4 * 0.2) and score["two"][1:] == ("Moderate", 4)
    top = {(r.sample_id, r.mechanism): (r.n_events, r.proportion, r.dominant) for r in integrate.dominance(summary).collect()}
    assert len(top) == 18 and top["none", "chromoplexy"] == (0, 0.0, "none") and top["two", "chromothripsis"] == (2, 0.5, "balanced") and top["possible", "chromoplexy"] == (3, 0.6, "chromoplexy")
    words = {r.sample_id: r.w for r in summary.select("sample_id", integrate.overall_class().alias("w")).collect()}
    assert words == {"none": "No chromoanagenesis detected", "low": "Chromothripsis only", "possible": "No chromoanagenesis detected", "two": "Multiple mechanisms: chromothripsis, chromoplexy", "apart": "Multiple mechanisms: chromothripsis, chromoanasynthesis", "skipped": "Chromoplexy only"}


def test_chromosomes_of_a_sample(spark):
    loc = spark.createDataFrame([("s", m, c, 1, 2, f, "x", e) for m, c, f, e in (
        ("chromoplexy", "1", 0.7, "CP_1"), ("chromoplexy", "1", 0.7, "CP_2"), ("chromothripsis", "1", 0.7, "CT_1"), ("chromoanasynthesis", "2", 0.4, "CS_1"), ("chromoanasynthesis", "2", 0.6, "CS_2"), ("chromoplexy", "MT", 0.7, "CP_1"))], LOC)
    by = {r.chrom: (r.mechanisms, r.dominant_mechanism, r.n_mechanisms, r.max_confidence) for r in integrate.by_chromosome(loc).collect()}
    assert by == {"1": ("chromoplexy+chromothripsis", "chromoplexy", 2, 0.7), "2": ("chromoanasynthesis", "chromoanasynthesis", 1, 0.6), "MT": ("chromoplexy", "chromoplexy", 1, 0.7)}
    got = {r.chrom: (r.dominant_mechanism, r.n_events, r.mechanisms_list) for r in integrate.chromosome_summary(loc, genome_table(spark)).collect()}
    assert got == {"1": ("mixed", 2, "chromothripsis, chromoplexy"), "2": ("chromoanasynthesis", 2, "chromoanasynthesis")}  # chains count once


def test_global_fdr_takes_every_chromosome(spark):
    ct = spark.createDataFrame([("s", "1", 0.04, None, 0.5, None, 0.001), ("s", "2", None, None, None, None, None)], "sample_id string, chrom string, pval_fragment_joins double, pval_exp_chr double, pval_exp_cluster double, chr_breakpoint_enrichment double, inter_pval_fragment_joins double")
    chain = spark.createDataFrame([("s", 1, 0.02), ("s", 2, None)], "sample_id string, chain_id long, pvalue double")
    got = {r.event_id: (r.original_pvalue, r.adjusted_pvalue, r.is_significant_fdr) for r in integrate.global_fdr(ct, chain).collect()}
    assert got["CT_1"] == (0.04, pytest.approx(0.06), False) and got["CT_2"] == (1.0, 1.0, False) and got["CP_1"] == (0.02, pytest.approx(0.06), False) and got["CP_2"] == (None, None, None)


def test_modes_with_and_without_segments(spark):
    sv = spark.createDataFrame(triangle(1_000_000, 1_200_000), SV)
    (only,) = analysis.analyze(sv)["summary"].collect()
    assert only.analysis_mode == "SV-only chromoplexy" and only.chromothripsis_high_confidence is None and only.chromothripsis_chromosomes == only.chromoanasynthesis_chromosomes == "Not analyzed" and only.chromoplexy_chains >= 1
    assert {r.evidence_mode for r in chromoplexy.detect(sv).collect()} == {"SV-only"}
    cnv = spark.createDataFrame([("S1", c, 1 + k * 1_000_000, (k + 1) * 1_000_000, 2.0, k + 1) for c in "123" for k in range(4)], CNV)
    (full,) = analysis.analyze(sv, cnv)["summary"].collect()
    assert full.analysis_mode == "SV+CNV integrated" and full.chromothripsis_high_confidence == 0 and full.chromoanasynthesis_likely == 0 and full.chromoplexy_driver_genes == "Not annotated"
    assert {r.evidence_mode for r in chromoplexy.detect(sv, cnv).collect()} == {"SV+CNV"}


# -- chains -----------------------------------------------------------------------------------------------------------------
def brute_match(a, b):
    taken, found = set(), []
    for i, x in a:
        for j, y in b:
            if j not in taken and len(x & y) / len(x | y) > 0.5:
                taken.add(j)
                found.append((i, j))
                break
    return found


def test_methods_are_compared_by_variants(spark):
    r = random.Random(6)
    sets = lambda: [frozenset(r.sample(range(7), r.randrange(2, 5))) for _ in range(12)]
    rate, fixed = {s: sets() for s in "xyz"}, {s: sets() for s in "xy"}
    kind = ["Likely chromoplexy", "Possible chromoplexy", "Unlikely chromoplexy"]
    a = spark.createDataFrame([(s, i, sorted(v), kind[i % 3]) for s, c in rate.items() for i, v in enumerate(c)], "sample_id string, chain_id long, sv_nos array<long>, classification string")
    b = spark.createDataFrame([(s, i, sorted(v), kind[i % 3], float(i * 5 % 7)) for s, c in fixed.items() for i, v in enumerate(c)], "sample_id string, chain_id long, sv_nos array<long>, classification string, combined_score double")
    by_score = {s: sorted(enumerate(c), key=lambda x: (-float(x[0] * 5 % 7), x[0])) for s, c in fixed.items()}
    want = {s: brute_match(list(enumerate(rate[s])), by_score[s]) for s in "xy"}
    got = {(m.sample_id, m.chain_a, m.chain_b) for m in rate_chains.match_chains(a, b).collect()}
    assert got == {(s, i, j) for s, m in want.items() for i, j in m} and len(got) > 4
    samples = spark.createDataFrame([(s,) for s in "wxyz"], "sample_id string")
    rows = {r.sample_id: r for r in rate_chains.compare_methods(samples, a, b).collect()}
    n = len(want["x"])
    assert (rows["x"].n_shared, rows["x"].n_rate_only, rows["x"].n_fixed_only, rows["x"].rate_likely) == (n, 12 - n, 12 - n, 4) and rows["x"].jaccard == pytest.approx(n / (24 - n))
    assert (rows["z"].n_shared, rows["z"].n_rate_only, rows["z"].jaccard) == (0, 12, 0.0) and (rows["w"].rate_total_chains, rows["w"].jaccard) == (0, 0.0)


def test_rate_search_starts_where_variants_name_their_ends():
    edges = [("9:5", "1:5", "TRANSLOCATION", 1), ("1:5", "2:5", "TRANSLOCATION", 2), ("2:5", "3:5", "TRANSLOCATION", 3), ("3:5", "9:5", "STAT_ADJACENCY", None)]
    first = rate_chains.search(edges, 3, 3, 100, 10)[0]
    assert first["nodes"][0] == "9:5" and first["sv_nos"] == [1, 2, 3] and len(rate_chains.search(edges, 3, 3, 1, 10)) <= 4


def test_context_of_chains(spark):
    r = random.Random(3)
    segments = [("s", c, a, a + r.randrange(1, 9) * 1_000_000, float(r.randrange(5)), i) for c in "12" for i, a in enumerate(range(1, 60_000_000, 4_000_000))] + [("s", "3", 1, 100_000_000, 2.0, 1)]
    nodes = {1: ["1:9000000", "2:30000000"], 2: ["1:55000000", "3:50000000"], 3: ["3:50000000"]}
    chains = spark.createDataFrame([("s", i, n, [1, 2, 3] if i < 3 else [], 4) for i, n in nodes.items()], "sample_id string, chain_id long, nodes array<string>, sv_nos array<long>, n_translocations long")
    cnv = spark.createDataFrame(segments, CNV)
    got = {x.chain_id: x.local_cn_change for x in chromoplexy.local_variation(chains, cnv).collect()}
    for i, places in nodes.items():
        sds = []
        for place in places:
            c, pos = place.split(":")
            near = [s[4] for s in segments if s[1] == c and (abs(s[2] - int(pos)) <= 5_000_000 or abs(s[3] - int(pos)) <= 5_000_000)]
            sds += [statistics.stdev(near)] if len(near) > 1 else []
        assert got[i] == pytest.approx(min(statistics.mean(sds) / 2, 1) if sds else 0)  # the segment that spans the window tells nothing
    assert {x.local_cn_change for x in chromoplexy.local_variation(chains, cnv.limit(0)).collect()} == {0.0}
    bridges = spark.createDataFrame([("s", 1, 0.5), ("s", 1, 0.9), ("s", 3, 0.1), ("s", 9, 1.0)], "sample_id string, sv_no long, confidence double")
    rows = {x.chain_id: x for x in chromoplexy.bridge_enrichment(chains, bridges).collect()}
    assert (rows[1].n_bridges, rows[1].bridge_proportion) == (3, 0.75) and rows[1].bridge_enrichment == pytest.approx(0.75 * 0.6 + 0.5 * 0.4) and rows[3].bridge_enrichment == 0.0


# -- sequences --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("split", ["64", "1000000"])
def test_fasta_in_splits(spark, tmp_path, split):
    r = random.Random(1)
    genome = {name: "".join(r.choice("ACGTN") for _ in range(n)) for name, n in (("chr1", 1000), ("2", 37), ("chrX", 400), ("contig", 1))}
    text = "skipped\n"
    for name, seq in genome.items():
        text += f">{name} of {len(seq)}\n" + "".join(seq[i : i + 13] + "\n" + "\n" * (i % 3 == 0) for i in range(0, len(seq), 13))
    (tmp_path / "g.fa").write_text(text + ">empty\n")
    (tmp_path / "h.fa").write_text(">chr7\nacgt")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        got = {(x.chrom, x.bin): x.seq for x in fasta.read_fasta(spark, str(tmp_path), 100).collect()}
    finally:
        spark.conf.set(key, before)
    want = {(name.removeprefix("chr").upper(), i // 100): seq[i : i + 100] for name, seq in {**genome, "7": "acgt"}.items() for i in range(0, len(seq), 100)}
    assert got == want


def brute_junction(genome, flank, c1, p1, s1, c2, p2, s2):
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA")) if s is not None else None
    cut = lambda c, a, b: genome[c][a - 1 : b] if a >= 1 and b <= len(genome[c]) else None
    if c1 not in genome or c2 not in genome:
        return (False, "", "", "", "")
    out = []
    for side, c, p, s in ((1, c1, p1, s1), (2, c2, p2, s2)):
        kept, disc = (cut(c, p - flank + 1, p), cut(c, p + 1, p + flank)) if s == "+" else (cut(c, p, p + flank - 1), cut(c, p - flank, p - 1))
        out += [turn(kept), turn(disc)] if (s == "+") == (side == 2) else [kept, disc]
    return (True, *out)


def test_junctions_at_chunk_borders_and_ends(spark):
    r = random.Random(2)
    genome = {c: "".join(r.choice("ACGT") for _ in range(n)) for c, n in (("1", 95), ("2", 40))}
    chunks = spark.createDataFrame([(c, i // 10, s[i : i + 10]) for c, s in genome.items() for i in range(0, len(s), 10)], "chrom string, bin long, seq string")
    rows = [("s", f"v{i}", r.choice("12"), r.randrange(1, 40), r.choice("+-"), r.choice("123"), r.randrange(1, 60), r.choice("+-"), "TRA", i) for i in range(150)]
    got = {x.sv_id: tuple(x)[2:] for x in repair.junctions(spark.createDataFrame(rows, SV), chunks, flank=7, chunk=10).collect()}
    assert got == {x[1]: brute_junction(genome, 7, *x[2:8]) for x in rows}
    flank = spark.createDataFrame([("s", "v0", False, "", "", "", ""), ("s", "v1", True, "AAC", "AAC", "GAA", "GAA"), ("s", "v2", True, None, None, "A", "A")], "sample_id string, sv_id string, has_sequence boolean, s1_kept string, s1_disc string, s2_kept string, s2_disc string")
    kinds = {x.sv_id: (x.mh_length, x.has_microhomology, x.repair_mechanism, x.evidence) for x in repair.classify(flank, spark.createDataFrame(rows, SV)).collect()}
    assert kinds == {"v0": (None, None, "NHEJ", "MH: 0 bp, Ins: 0 bp"), "v1": (2, True, "MMEJ", "MH: 2 bp, Ins: 0 bp"), "v2": (None, None, "NHEJ", "MH: 0 bp, Ins: 0 bp")}
    (s,) = repair.summary(repair.classify(flank, spark.createDataFrame(rows, SV))).collect()
    assert (s.n, s.n_microhomology, s.proportion, s.mean_length, s.dominant_mechanism) == (3, 1, 1.0, 2.0, "NHEJ") and not math.isnan(s.median_length)
