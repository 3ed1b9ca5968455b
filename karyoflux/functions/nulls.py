"""Null distributions as tables: made once for the sizes that a table has, and met by it in an equi-join.

Equal shares among four cells: sums of squares of all splits of n, by convolution of two pairs of cells, with exact probabilities.
Exponential gaps: the distances of samples of n drawn under the null, which don't depend on scale; draws come from digests of
(seed, n, sample, place), so any engine and any run makes the same table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.functions.tails import chi2_3_upper, leading, log_factorial
from karyoflux.runtime import materialize

#: Samples of the gaps' null, and its seed.
SAMPLES, SEED = 1000, 1
#: Greatest n whose splits are enumerated (n^3 / 24 rows each); beyond, chi-square with three degrees of freedom is close.
ENUMERATED = 500
#: A null table of at most so many sizes (8 KB each) is broadcast.
FEW_SIZES = 4096


def equal_shares(sizes: DataFrame) -> DataFrame:
    """(n, squares, pvalue) from distinct n > 0: for every sum of squares of four counts that add up to n, the probability of at least it."""
    pair = lambda total, a: a * a + (total - a) * (total - a)
    ways = lambda total, a: F.when(2 * a == total, 0.0).otherwise(math.log(2)) - log_factorial(a) - log_factorial(total - a)  # noqa: E731  both orders of a pair
    n, s, a, b = (F.col(c) for c in "nsab")
    # one pair of cells holds s, the other n - s; each pair once by its smaller count
    rows = sizes.select(n.cast("long").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("s"))
    rows = rows.select("n", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(s / 2))).alias("a"))
    rows = rows.groupBy("n", "s", pair(s, a).alias("first")).agg(F.sum(F.exp(ways(s, a) + log_factorial(s))).alias("w"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - s) / 2))).alias("b"))
    log_p = F.log("w") - log_factorial(s) + ways(n - s, b) + log_factorial(n) - n * math.log(4)
    rows = rows.groupBy("n", (F.col("first") + pair(n - s, b)).alias("squares")).agg(F.sum(F.exp(log_p)).alias("p"))
    down = Window.partitionBy("n").orderBy(F.desc("squares"))  # under n^2 / 2 sums of one n
    return rows.select("n", "squares", F.least(F.sum("p").over(down), F.lit(1.0)).alias("pvalue"))


def with_equal_shares_p(df: DataFrame, counts: list[str], out: str) -> DataFrame:
    """df with out: the probability of a chi-square against equal shares as great as that of its four counts; null without any."""
    n = sum((F.col(c).cast("long") for c in counts[1:]), F.col(counts[0]).cast("long"))
    squares = sum((F.col(c).cast("long") * F.col(c) for c in counts[1:]), F.col(counts[0]).cast("long") * F.col(counts[0]))
    df = df.withColumns({"_n": n, "_squares": squares})
    null = equal_shares(df.where((F.col("_n") > 0) & (F.col("_n") <= ENUMERATED)).select(F.col("_n").alias("n")).distinct())
    null = null.select(F.col("n").alias("_n"), F.col("squares").alias("_squares"), F.col("pvalue").alias("_p"))
    beyond = F.when(F.col("_n") > ENUMERATED, chi2_3_upper(4 * F.col("_squares") / F.col("_n") - F.col("_n")))
    return df.join(null, ["_n", "_squares"], "left").withColumn(out, F.coalesce("_p", beyond)).drop("_n", "_squares", "_p")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a digest of parts."""
    text = F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def exponential_gaps(sizes: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(n, distances) from distinct n: the greatest first, of samples of n from their own exponential law."""
    draws = lambda: F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: -F.log(_uniform(F.col("n"), F.col("sample"), i)))
    rows = sizes.select(F.col("n").cast("long").alias("n")).select("n", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    rows = rows.repartition("n", "sample").select("n", F.array_sort(draws()).alias("x"))
    rows = rows.select("n", "x", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.col("n")).alias("mean"))
    far = F.transform("x", lambda v, i: F.greatest((i + 1) / F.col("n") - (1 - F.exp(-v / F.col("mean"))), 1 - F.exp(-v / F.col("mean")) - i / F.col("n")))
    return rows.select("n", F.array_max(far).alias("d")).groupBy("n").agg(F.sort_array(F.collect_list("d"), asc=False).alias("distances"))


def with_gaps_p(df: DataFrame, distance: str, size: str, out: str, samples: int = SAMPLES) -> DataFrame:
    """df with out: the share of null samples of the same size at least as far off, the observed one counted in; null where either is."""
    sizes = df.where(F.col(size).isNotNull()).select(F.col(size).cast("long").alias("n")).distinct()
    null = materialize(exponential_gaps(sizes, samples).withColumnsRenamed({"n": "_n", "distances": "_null"}), "gaps-null")
    if null.count() <= FEW_SIZES:
        null = F.broadcast(null)
    above = leading(F.col("_null"), samples, lambda d: d >= F.col(distance))
    return df.join(null, df[size].cast("long") == null["_n"], "left").withColumn(out, F.when(F.col(distance).isNotNull() & F.col("_null").isNotNull(), (above + 1) / F.lit(float(samples + 1)))).drop("_n", "_null")
