"""Findings of round 5: what each one claims, held by a small case."""

from pyspark.sql import functions as F

from karyoflux.operators import chromoanasynthesis, integrate, intervals
from karyoflux.operators.genes import in_regions
from karyoflux.operators.intervals import join_overlapping
from karyoflux.runtime import materialize


def _ran(df):
    """Rows of df and the plan that gave them."""
    rows = sorted(tuple(r) for r in df.collect())
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_bins_of_samples_are_never_broadcast(spark):
    """Files of regions are small, and Spark doesn't count the bins of their rows."""
    left = materialize(spark.createDataFrame([("s", "1", 5, 5), ("t", "1", 5_500_000, 5_500_000)], "sample_id string, chrom string, a long, b long"), "points")
    right = materialize(spark.createDataFrame([("s", "1", 1, 9_000_000), ("t", "1", 1, 9_000_000), ("t", "2", 1, 9)], "sample_id string, chrom string, lo long, hi long"), "spans")
    rows, plan = _ran(join_overlapping(left, right, ["sample_id", "chrom"], (F.col("a"), F.col("b")), (F.col("lo"), F.col("hi"))))
    assert [(r[0], r[-1]) for r in rows] == [("s", 9_000_000), ("t", 9_000_000)]
    assert "BroadcastExchange" not in plan


def test_a_gene_list_may_still_be_broadcast(spark):
    points = spark.createDataFrame([("1", 5)], "chrom string, pos long")
    genes = spark.createDataFrame([("1", 1, 9)], "chrom string, lo long, hi long")
    rows, plan = _ran(join_overlapping(points, genes, ["chrom"], (F.col("pos"), F.col("pos")), (F.col("lo"), F.col("hi"))))
    assert rows == [("1", 5, 1, 9)] and "BroadcastExchange" in plan


def test_regions_are_never_broadcast_to_a_gene_list(spark, monkeypatch):
    """The gene list takes the smaller part, whatever Spark takes the files of the regions for."""
    regions = materialize(spark.createDataFrame([("s", "1", 1, 9)], "sample_id string, chrom string, start long, end long"), "regions")
    rows = [(f"G{i}", f"G{i}", "1", 1 + i * 1000, 9 + i * 1000, "+", "gene", "TSG" * 50, True) for i in range(200)]
    genes = materialize(spark.createDataFrame(rows, "symbol string, gene_id string, chrom string, start long, end long, strand string, type string, gene_type string, is_driver boolean"), "genes")
    found, plan = _ran(in_regions(regions, genes))
    assert [r[4] for r in found] == ["G0"]
    assert "BuildRight" in plan and "BuildLeft" not in plan
    monkeypatch.setattr(intervals, "FEW_PLACES", 10)
    again, plan = _ran(in_regions(regions, genes))
    assert again == found and "BroadcastExchange" not in plan


def test_topology_of_written_regions_sends_no_bins_to_the_driver(spark):
    r = materialize(spark.createDataFrame([("s", 1, "1", 1, 9_000_000)], "sample_id string, region_id int, chrom string, start long, end long"), "regions")
    sv = spark.createDataFrame([("s", "1", 5_000, "1", 9_000, "DUP", 1), ("s", "1", 6_000, "2", 9_000, "TRA", 2)], "sample_id string, chrom1 string, pos1 long, chrom2 string, pos2 long, svtype string, sv_no long")
    t = chromoanasynthesis.topology(r, sv)
    got = t.select("n_tandem_dups", "n_total_svs", "n_inter_chr_svs").collect()
    assert [tuple(x) for x in got] == [(1, 1, 1)]
    joins = chromoanasynthesis.region_variants(r, sv)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in joins


def test_calls_of_a_cohort_meet_without_broadcast(spark):
    loc = spark.createDataFrame([("s", m, "1", 1, 9_000_000, 0.5, m) for m in integrate.ORDER], "sample_id string, mechanism string, chrom string, start long, end long, confidence double, event_id string")
    rows, plan = _ran(integrate.overlaps(loc))
    assert len(rows) == 3 and "BroadcastExchange" not in plan
