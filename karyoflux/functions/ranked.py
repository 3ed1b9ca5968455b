"""Ranks, running sums and adjusted p-values of tables that no task could order alone.

A value column is cut into ranges by approximate quantiles, so ranges are of like size. Running sums go in two levels: sums of
every range, carried over the few rows that these are, and a running sum inside each range, which a task orders. Equal values are
counted together first, so a value that many rows share is one row and lies in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.functions.tails import leading
from karyoflux.runtime import cleaned, materialize

#: Ranges that a column is cut into, and the error of the quantiles, which changes the ranges' sizes but no result.
RANGES, QUANTILE_ERROR = 64, 0.002
#: A table of at most so many distinct values is ordered in one task.
ORDERED_IN_TASK = 100_000
#: A value with over 1 / HOT_SHARE of all rows is broadcast to them; there are fewer than HOT_SHARE of these.
HOT_SHARE = 1000


def with_range(df: DataFrame, value: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df with out: the number of the value's range, growing with it; 0 for null."""
    cuts = sorted(set(df.approxQuantile(value, [k / ranges for k in range(1, ranges)], QUANTILE_ERROR))) if ranges > 1 else []
    if not cuts:
        return df.withColumn(out, F.lit(0))
    return df.withColumn(out, F.coalesce(leading(F.array(*map(F.lit, cuts)), len(cuts), lambda cut: cut < F.col(value)), F.lit(0)))


def running(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], down: bool = False, ranges: int = RANGES) -> DataFrame:
    """df with each of sums added up, within keys, over the rows with this value and those before it (down: behind it).

    Rows must differ in (keys, value). A column _range that df has already from with_range is used, and dropped.
    """
    df = (df if "_range" in df.columns else with_range(df, value, "_range", ranges)).withColumns({f"_{n}": c for n, c in sums.items()})
    per = df.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_b_{n}") for n in sums])
    order = F.desc("_range") if down else F.asc("_range")
    past = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    per = per.select(*keys, "_range", *[F.coalesce(F.sum(f"_b_{n}").over(past), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(value) if down else F.asc(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = _meet(df, per, [*keys, "_range"])
    return df.withColumns({n: F.col(f"_b_{n}") + F.sum(f"_{n}").over(inside) for n in sums}).drop("_range", *[f"_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def _meet(df: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets null."""
    renamed = few.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [df[k].eqNullSafe(renamed[f"_k{i}"]) for i, k in enumerate(keys)]
    return df.join(renamed, same).drop(*[f"_k{i}" for i in range(len(keys))])


def adjusted(df: DataFrame, p: str, keys: Sequence[str], out: str, ranges: int = RANGES, ordered_in_task: int = ORDERED_IN_TASK) -> DataFrame:
    """(keys, p, out, n): Benjamini-Hochberg adjusted p of each distinct p within keys, and its number of rows. Null p don't count."""
    keys = list(keys)
    n = materialize(df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("n")), "distinct-p")
    if n.count() <= ordered_in_task:
        ranges = 1
    n = running(n, keys, p, {"_rank": F.col("n")}, ranges=ranges)
    total = n.groupBy(*keys).agg(F.max("_rank").alias("_m")) if keys else n.agg(F.max("_rank").alias("_m"))
    n = _meet(n, total, keys) if keys else n.crossJoin(F.broadcast(total))  # without keys one number
    n = with_range(n.withColumn("_q", F.col(p) * F.col("_m") / F.col("_rank")), p, "_range", ranges)
    # the least q of this and of all greater p: of the ranges behind, then inside the own one
    per = n.groupBy(*keys, "_range").agg(F.min("_q").alias("_least"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_range", F.min("_least").over(later).alias("_least"))
    inside = Window.partitionBy(*keys, "_range").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = _meet(n, per, [*keys, "_range"])
    least = F.least(F.lit(1.0), F.min("_q").over(inside), F.col("_least"))  # least() skips nulls
    return n.select(*keys, p, least.alias(out), "n")


def with_bh(df: DataFrame, p: str, out: str, keys: Sequence[str] = (), ranges: int = RANGES, ordered_in_task: int = ORDERED_IN_TASK) -> DataFrame:
    """df with out: p adjusted over all rows of the same keys by Benjamini and Hochberg; null p stay null and don't count.

    Ranks come from counts of the distinct values in ranges, so no task orders all tests. They meet the rows in a shuffled join;
    a p that many rows share, such as 1, is broadcast to them.
    """
    keys = list(keys)
    with cleaned():
        found = materialize(adjusted(df, p, keys, out, ranges, ordered_in_task), "adjusted", keep=True)
    n = found.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT_SHARE > n
    side = lambda few, value: few.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(p).alias("_p"), F.col(out).alias(value), F.pmod(F.hash(p), F.lit(1)).alias("_s"))
    hot, cold = side(found.where(is_hot), "_hot"), side(found.where(~is_hot), "_cold")
    same = lambda few: [df[k].eqNullSafe(few[f"_k_{k}"]) for k in keys]
    met = df.join(F.broadcast(hot), [*same(hot), df[p] == hot["_p"]], "left").drop(*[f"_k_{k}" for k in keys], "_p", "_s")
    # rows that are done or have no p look for nothing, each under one of many keys
    done = F.col("_hot").isNotNull() | F.col(p).isNull()
    met = met.withColumns({"_want": F.when(~done, F.col(p)), "_salt": F.when(done, F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)})
    met = met.join(cold, [*[met[k].eqNullSafe(cold[f"_k_{k}"]) for k in keys], met["_want"] == cold["_p"], met["_salt"] == cold["_s"]], "left")
    return met.withColumn(out, F.coalesce("_hot", "_cold")).select(*df.columns, out)
