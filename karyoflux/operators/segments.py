"""Copy-number segments: merging, oscillation runs, linear coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["sample_id", "chrom"]


def merge_adjacent(cnv: DataFrame) -> DataFrame:
    """Runs of touching segments (start at most one after the run's end) with one copy number become one segment."""
    w = Window.partitionBy(*KEYS).orderBy("start", "seg_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = cnv.withColumn("new", F.coalesce(((F.col("start") > F.max("end").over(before) + 1) | (F.col("total_cn") != F.lag("total_cn").over(w))).cast("int"), F.lit(1)))
    c = c.withColumn("run", F.sum("new").over(w))
    out = c.groupBy(*KEYS, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("total_cn").alias("total_cn"), F.count("*").alias("n_merged"))
    return out.withColumn("seg_no", F.row_number().over(Window.partitionBy(*KEYS).orderBy("start"))).drop("run")


def longest_runs(cnv: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, n_segments, osc2, osc3: oscillating segments between two and up to three states; null with fewer than 4 segments.

    A step oscillates if the rounded copy number (half to even) two segments on is the same (two states), or at most one off
    (three states). The longest run of such steps, 0 if none, plus 2.
    """
    w = Window.partitionBy(*keys).orderBy("start", "seg_no")
    cn = F.bround("total_cn", 0)
    s = cnv.withColumn("step", F.abs(cn - F.lead(cn, 2).over(w))).withColumn("at", F.row_number().over(w))
    two, three = F.coalesce((F.col("step") == 0).cast("int"), F.lit(-1)), F.coalesce((F.col("step") <= 1).cast("int"), F.lit(-1))
    s = s.withColumns({"v2": two, "v3": three})
    for v, g in (("v2", "g2"), ("v3", "g3")):
        s = s.withColumn(g, F.col("at") - F.row_number().over(Window.partitionBy(*keys, v).orderBy("start", "seg_no")))
    s = s.withColumn("r2", F.when(F.col("v2") == 1, F.count("*").over(Window.partitionBy(*keys, "v2", "g2")))).withColumn("r3", F.when(F.col("v3") == 1, F.count("*").over(Window.partitionBy(*keys, "v3", "g3"))))
    out = s.groupBy(*keys).agg(F.count("*").alias("n_segments"), (F.coalesce(F.max("r2"), F.lit(0)) + 2).alias("osc2"), (F.coalesce(F.max("r3"), F.lit(0)) + 2).alias("osc3"))
    enough = F.col("n_segments") >= 4
    return out.withColumn("osc2", F.when(enough, F.col("osc2"))).withColumn("osc3", F.when(enough, F.col("osc3")))


def oscillation_test(cnv: DataFrame, cutoff: int = 2, times: int = 5000, seed: int = 1, keys: list[str] = KEYS) -> DataFrame:
    """keys, n_segments, observed and pvalue: the share of shuffles of the rounded copy numbers whose longest oscillating run (steps of
    two segments that differ by at most cutoff - 2) is at least the observed one.

    Shuffles are orders of digests of (seed, shuffle, segment), so that any engine draws the same ones. They depend on the number of
    segments alone, so a task draws them once for each number and applies them to all chromosomes of a batch that have it.
    """
    cn = cnv.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "seg_no", F.bround("total_cn", 0).cast("double").alias("v")))), lambda x: x["v"]).alias("cn"))  # a chromosome's segments

    @F.pandas_udf("struct<observed: int, hits: long>")
    def test(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept: dict[int, list[np.ndarray]] = {}
        for s in batches:
            observed, hits = np.zeros(len(s), np.int32), np.zeros(len(s), np.int64)
            sizes = s.map(len).to_numpy(np.int64)
            for n in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == n)
                own = np.array([[np.nan if v is None else v for v in s.iloc[k]] for k in rows], np.float64).reshape(len(rows), n)
                observed[rows] = _run_lengths(own, cutoff)
                if n <= _KEPT and n not in kept:
                    kept[n] = list(_orders(n, times, seed))
                for orders in kept.get(n) or _orders(n, times, seed):
                    step = max(1, _AT_ONCE // max(1, orders.size))
                    for k in range(0, len(rows), step):
                        drawn = own[k : k + step][:, orders].reshape(-1, n)
                        hits[rows[k : k + step]] += (_run_lengths(drawn, cutoff).reshape(-1, len(orders)) >= observed[rows[k : k + step], None]).sum(1)
            yield pd.DataFrame({"observed": observed, "hits": hits})

    x = cn.select(*keys, F.size("cn").alias("n_segments"), test("cn").alias("t"))
    return x.select(*keys, "n_segments", "t.observed", (F.col("t.hits") / F.lit(float(times))).alias("pvalue"))


#: Segments up to which a task keeps its shuffles, and numbers that it holds at once.
_KEPT, _AT_ONCE = 256, 1 << 20


def _orders(n: int, times: int, seed: int) -> Iterator[np.ndarray]:
    """The shuffles of n segments as rows of places, _AT_ONCE places at once."""
    step = max(1, _AT_ONCE // max(1, n))
    for first in range(1, times + 1, step):
        some = range(first, min(first + step, times + 1))
        yield np.array([sorted(range(n), key=[hashlib.md5(f"{seed}:{t}:{i}".encode()).digest() for i in range(n)].__getitem__) for t in some], np.int64).reshape(len(some), n)


def _run_lengths(cn: np.ndarray, cutoff: int) -> np.ndarray:
    """For each row the longest run of steps of two segments that differ by at most cutoff - 2; missing ones end a run."""
    now = best = np.zeros(len(cn), np.int32)
    for i in range(cn.shape[1] - 2):
        now = np.where(np.abs(cn[:, i] - cn[:, i + 2]) <= cutoff - 2, now + 1, 0).astype(np.int32)
        best = np.maximum(best, now)
    return best


def segments_of(clusters: DataFrame, cnv: DataFrame) -> DataFrame:
    """The segments of each cluster (sample_id, chrom, start, end): from the last that starts at or before its start (else the
    first after it) to the first that ends at or after its end (else the last before it); none if that is no range."""
    bounds = clusters.select(*KEYS, F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    c = cnv.join(bounds, KEYS)
    a = F.coalesce(F.max(F.when(F.col("start") <= F.col("c_start"), F.col("seg_no"))), F.min(F.when(F.col("start") >= F.col("c_start"), F.col("seg_no"))))
    b = F.coalesce(F.min(F.when(F.col("end") >= F.col("c_end"), F.col("seg_no"))), F.max(F.when(F.col("end") <= F.col("c_end"), F.col("seg_no"))))
    ranges = c.groupBy(*KEYS).agg(a.alias("first_seg"), b.alias("last_seg"))
    return cnv.join(ranges, KEYS).where(F.col("seg_no").between(F.col("first_seg"), F.col("last_seg"))).drop("first_seg", "last_seg")


def with_linear(df: DataFrame, genome: DataFrame, chrom: str = "chrom", pos: str = "pos", out: str = "linear_pos") -> DataFrame:
    """df with the position along the whole genome, chromosomes in natural order. genome has one row a chromosome."""
    w = Window.orderBy("chrom_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = genome.select(F.col("chrom").alias("_c"), F.coalesce(F.sum("size").over(w), F.lit(0)).alias("_offset"))
    return df.join(F.broadcast(offsets), F.col(chrom) == F.col("_c")).withColumn(out, F.col(pos) + F.col("_offset")).drop("_c", "_offset")
