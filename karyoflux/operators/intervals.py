"""Interval joins through position bins.

Both sides are cut into bins of a fixed width and meet in an equi-join on their keys and the bin, so a chromosome is many small
keys instead of one large one. A pair that shares several bins is kept in the one where its later start lies, so no pair comes
twice and none needs to be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of one bin: a chromosome has at most some 250, and most variants and genes touch one or two.
BIN = 1_000_000
#: A list of places, such as genes, is broadcast with at most so many rows in bins.
FEW_PLACES = 200_000


def join_overlapping(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: int = BIN) -> DataFrame:
    """left with each row of right that has its keys and shares a position with it; spans are inclusive (first, last).

    Other columns of left and right must have different names. Rows with a null key or span, or that end before they start, meet
    nothing. Sides by sample grow with the cohort and are never broadcast: Spark takes a side for as large as its compressed files
    and doesn't count the rows of its bins, so the driver would get many times what it was told. Without samples as keys right is a
    list of places, which is counted: few are broadcast to the cohort, many meet it in a shuffle.
    """
    a = _binned(left, left_span, "_l", width)
    b = _binned(right, right_span, "_r", width)
    few = "sample_id" not in keys and b.limit(FEW_PLACES + 1).count() <= FEW_PLACES
    b = b.hint("broadcast" if few else "merge")
    j = a.join(b, [*keys, "_bin"]).where((F.col("_l_lo") <= F.col("_r_hi")) & (F.col("_r_lo") <= F.col("_l_hi")))
    return j.where(F.col("_bin") == _bin(F.greatest("_l_lo", "_r_lo"), width)).drop("_bin", "_l_lo", "_l_hi", "_r_lo", "_r_hi")


def _bin(position: Column, width: int) -> Column:
    return F.floor(position / F.lit(width)).cast("long")


def _binned(df: DataFrame, span: tuple[Column, Column], name: str, width: int) -> DataFrame:
    df = df.withColumn(f"{name}_lo", span[0].cast("long")).withColumn(f"{name}_hi", span[1].cast("long")).where(F.col(f"{name}_lo") <= F.col(f"{name}_hi"))
    return df.withColumn("_bin", F.explode(F.sequence(_bin(F.col(f"{name}_lo"), width), _bin(F.col(f"{name}_hi"), width))))
