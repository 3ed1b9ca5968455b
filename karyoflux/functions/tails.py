"""Exact tails and special functions as column expressions, so that tests run in the JVM beside the counts they judge.

Sums over a distribution are folds over a sequence of cells: the log of a probability follows from the one before by the ratio of
neighbouring cells, which keeps tails of any size from underflow and costs one logarithm a cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Ties of a probability with the observed one, as the exact tests of statistics packages count them.
TIE = math.log1p(1e-7)
#: Arguments of the gamma function are raised to at least this before Stirling's series, whose five terms are then exact to a double.
_RAISED = 16


def log_gamma(x: Column) -> Column:
    """Of positive x."""
    x = x.cast("double")
    small = x < _RAISED
    high = F.when(small, x + _RAISED).otherwise(x)
    y = 1 / (high * high)
    series = (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y * (1 / 1680 - y / 1188)))) / high
    stirling = (high - 0.5) * F.log(high) - high + F.lit(0.5 * math.log(2 * math.pi)) + series
    product = x
    for k in range(1, _RAISED):
        product = product * (x + k)
    return stirling - F.when(small, F.log(product)).otherwise(0.0)


def log_factorial(n: Column) -> Column:
    return log_gamma(n + 1)


def log_choose(n: Column, k: Column) -> Column:
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _fold(first: Column, log_first: Column, last: Column, log_ratio: Callable[[Column], Column], counts: Callable[[Column], Column]) -> Column:
    """Sum of probabilities of the cells first to last whose log passes counts; log_ratio(i) is that of cell i + 1 over cell i."""

    def add(acc: Column, i: Column) -> Column:
        log_p = acc["log_p"]
        p = F.when(counts(log_p), F.exp(log_p)).otherwise(F.lit(0.0))
        # behind the last cell nothing is read any more, and its ratio would be log 0
        return F.struct(F.when(i < last, log_p + log_ratio(i)).otherwise(log_p).alias("log_p"), (acc["total"] + p).alias("total"))

    start = F.struct(log_first.cast("double").alias("log_p"), F.lit(0.0).alias("total"))
    return F.when(first > last, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.aggregate(F.sequence(first, F.greatest(first, last)), start, add, lambda acc: acc["total"])))


def _hypergeometric(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column, Callable[[Column], Column], Callable[[Column], Column]]:
    """(x, least and greatest cell, log probability and log ratio of cells) of the first cell of a 2 x 2 table with its margins."""
    a, b, c, d = (v.cast("long") for v in (a, b, c, d))
    m, n, k = a + b, c + d, a + c
    lo, hi = F.greatest(F.lit(0).cast("long"), k - n), F.least(m, k)
    log_p = lambda i: log_choose(m, i) + log_choose(n, k - i) - log_choose(m + n, k)
    ratio = lambda i: F.log(((m - i) * (k - i)).cast("double") / ((i + 1) * (n - k + i + 1)))
    return a, lo, hi, log_p, ratio


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Upper tail of the first cell of a 2 x 2 table, its own value included."""
    x, _, hi, log_p, ratio = _hypergeometric(a, b, c, d)
    return _fold(x, log_p(x), hi, ratio, lambda v: F.lit(True))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """All tables with these margins that are at most as likely."""
    x, lo, hi, log_p, ratio = _hypergeometric(a, b, c, d)
    return bound(log_p(x) + TIE, lambda seen: _fold(lo, log_p(lo), hi, ratio, lambda v: v <= seen))


def binomial_two_sided(x: Column, n: Column, p: Column) -> Column:
    """All outcomes of n draws that are at most as likely as x; null without draws. p of 0 or 1 allow one outcome."""
    x, n, p = x.cast("long"), n.cast("long"), p.cast("double")
    odds = F.log(p) - F.log1p(-p)
    log_p = lambda i: log_choose(n, i) + i * F.log(p) + (n - i) * F.log1p(-p)
    ratio = lambda i: F.log((n - i).cast("double") / (i + 1)) + odds
    zero = F.lit(0).cast("long")
    sure = F.when((p <= 0) & (x == 0) | (p >= 1) & (x == n), 1.0).when((p <= 0) | (p >= 1), 0.0)
    return F.when(n > 0, F.coalesce(sure, bound(log_p(x) + TIE, lambda seen: _fold(zero, log_p(zero), n, ratio, lambda v: v <= seen))))


def with_odds_ratio(df: DataFrame, out: str, a: Column, b: Column, c: Column, d: Column, rounds: int = 60) -> DataFrame:
    """df with out: the odds ratio under which the mean of the noncentral hypergeometric distribution is the first cell.

    0 or infinite where the cell is the least or greatest that its margins allow. Newton's steps are held inside the interval that
    has the root, and bisect it where a step leaves it; rounds are enough for bisection alone to reach a double.
    """
    x, lo, hi, log_p, _ = _hypergeometric(a, b, c, d)
    df = df.withColumns({"_logs": F.transform(F.sequence(lo, hi), log_p), "_cell": (x - lo).cast("double"), "_last": (hi - lo).cast("double")})

    def moments(theta: Column) -> Column:
        """Mean and variance of the cell, counted from the least one, under log odds ratio theta."""
        first = F.struct(*[F.lit(0.0).alias(k) for k in ("i", "w", "s", "t")])
        add = lambda m, w: F.struct((m["i"] + 1).alias("i"), (m["w"] + w).alias("w"), (m["s"] + m["i"] * w).alias("s"), (m["t"] + m["i"] * m["i"] * w).alias("t"))
        weights = bound(F.transform("_logs", lambda v, i: v + i * theta), lambda t: bound(F.array_max(t), lambda top: F.transform(t, lambda v: F.exp(v - top))))
        return F.aggregate(weights, first, add, lambda m: F.struct((m["s"] / m["w"]).alias("mean"), (m["t"] / m["w"] - m["s"] * m["s"] / m["w"] / m["w"]).alias("var")))

    def looked(s: Column) -> Column:
        return F.struct(s["theta"].alias("theta"), s["low"].alias("low"), s["high"].alias("high"), moments(s["theta"]).alias("m"))

    def narrowed(s: Column) -> Column:
        below = s["m"]["mean"] < F.col("_cell")
        low, high = F.when(below, s["theta"]).otherwise(s["low"]), F.when(below, s["high"]).otherwise(s["theta"])
        newton = s["theta"] + (F.col("_cell") - s["m"]["mean"]) / s["m"]["var"]
        inside = (s["m"]["var"] > 1e-12) & (newton > low) & (newton < high)
        theta = F.when(inside, newton).otherwise((low + high) / 2)
        return F.struct(theta.alias("theta"), low.alias("low"), high.alias("high"), (F.abs(theta - s["theta"]) < 1e-14).alias("done"))

    start = F.array(F.struct(F.lit(0.0).alias("theta"), F.lit(-50.0).alias("low"), F.lit(50.0).alias("high"), F.lit(False).alias("done")))
    # a state is the one element of an array, so that the moments of a round are computed once and read by transform
    turn = lambda s, _: F.when(F.get(s, F.lit(0))["done"], s).otherwise(F.transform(F.transform(s, looked), narrowed))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: F.exp(F.get(s, F.lit(0))["theta"]))
    edge = F.when(F.col("_cell") == 0, F.lit(0.0)).when(F.col("_cell") == F.col("_last"), F.lit(math.inf))
    return df.withColumn(out, F.coalesce(edge, found)).drop("_logs", "_cell", "_last")


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: the series of erf below 2, the continued fraction from there on."""
    x = x.cast("double")
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda s, k: F.struct((s["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (s["total"] + s["term"] * 2 * x * x / (2 * k + 1)).alias("total")), lambda s: s["total"],
    )
    front = F.exp(-x * x) * F.lit(1 / math.sqrt(math.pi))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), x, lambda s, k: x + k / 2 / s)
    return F.when(x < 2, 1 - front * 2 * x * terms).otherwise(front / fraction)


def chi2_1_upper(x: Column) -> Column:
    """Upper tail of chi-square with one degree of freedom; null for null."""
    return F.when(x > 0, erfc(F.sqrt(F.abs(x) / 2))).when(x <= 0, 1.0)


def chi2_3_upper(x: Column) -> Column:
    """Upper tail of chi-square with three degrees of freedom; null for null."""
    tail = erfc(F.sqrt(F.abs(x) / 2)) + F.sqrt(2 * F.abs(x) / math.pi) * F.exp(-x / 2)
    return F.when(x > 0, F.least(F.lit(1.0), tail)).when(x <= 0, 1.0)


def beta_inc(a: Column, b: Column, x: Column, rounds: int = 80) -> Column:
    """Regularised incomplete beta function, by a continued fraction of fixed depth; good to a double for a and b up to some thousands."""
    a, b, x = (v.cast("double") for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    parts = F.struct(F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), F.when(swap, 1 - x).otherwise(x).alias("y"))

    def value(v: Column) -> Column:
        p, q, y = v["p"], v["q"], v["y"]

        # two coefficients a round: the even ones have k = 2m, the odd ones k = 2m + 1
        def coefficient(k: Column) -> Column:
            m = F.shiftright(k, 1)
            return F.when(k % 2 == 0, m * (q - m) * y / ((p + k - 1) * (p + k))).otherwise(-(p + m) * (p + q + m) * y / ((p + k - 1) * (p + k)))

        def turn(s: Column, num: Column) -> Column:
            return bound(F.struct((1 + num / s["c"]).alias("c"), (1 / (1 + num * s["d"])).alias("d")), lambda t: F.struct(t["c"].alias("c"), t["d"].alias("d"), (s["h"] * t["d"] * t["c"]).alias("h")))

        d0 = 1 / (1 - (p + q) * y / (p + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        fraction = F.aggregate(F.sequence(F.lit(2), F.lit(2 * rounds + 1)), start, lambda s, k: bound(coefficient(k), lambda num: turn(s, num)), lambda s: s["h"])
        return F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log1p(-y)) * fraction / p

    found = bound(bound(parts, value), lambda v: F.when(swap, 1 - v).otherwise(v))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)


def correlation_pvalue(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation by the t distribution with n - 2 degrees of freedom; 1 under 3 pairs."""
    df = (n - 2).cast("double")
    return F.when(n < 3, 1.0).when(F.abs(rho) >= 1, 0.0).otherwise(beta_inc(df / 2, F.lit(0.5), 1 - rho * rho))


def leading(values: Column, most: int, fits: Callable[[Column], Column]) -> Column:
    """How many elements at the front of an array of at most `most` fit, where none fits behind one that doesn't: by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    more = lambda at, s: F.when((at + s <= F.size(values)) & F.coalesce(fits(F.try_element_at(values, at + s)), F.lit(False)), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), more)
