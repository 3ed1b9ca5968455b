"""Special statistics: column expressions where they have a closed form, numpy kernels where they don't. tails and nulls hold the exact
tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- column expressions -----------------------------------------------------------------------------------------------------
def fisher_combine(sum_log: Column, k: Column) -> Column:
    """P-value of k combined p-values with sum of logs sum_log: upper tail of chi-square with 2k degrees of freedom."""
    half = -sum_log
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("total")),
        lambda acc, i: F.struct((acc["term"] * half / i).alias("term"), (acc["total"] + acc["term"]).alias("total")),
        lambda acc: acc["total"],
    )
    return F.least(F.exp(-half) * terms, F.lit(1.0))


def with_bh(df: DataFrame, p: str, out: str, partition: list[str]) -> DataFrame:
    """df with `out`: Benjamini-Hochberg adjusted p over the partition; null p stay null and don't count.

    A partition is ordered in one task: for the tests of one sample. ranked.with_bh takes tables of any size.
    """
    keys = [*partition, F.col(p).isNull()]
    group = Window.partitionBy(*keys)
    df = df.withColumn("_r", F.count("*").over(group.orderBy(p).rangeBetween(Window.unboundedPreceding, 0)) / F.lit(1.0)).withColumn("_m", F.count("*").over(group))
    down = group.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down)))).drop("_r", "_m")


def adjacency_pvalue(distance: Column, mu: Column) -> Column:
    return F.least(F.greatest(-F.expm1(-mu * distance / 1e6), F.lit(1e-10)), F.lit(1.0))


# -- numpy kernels ----------------------------------------------------------------------------------------------------------
def cox_step(beta: np.ndarray, u: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, bool]:
    """(next coefficients, whether they have settled) of Newton's method; NaN where the information can't be inverted."""
    try:
        step = np.linalg.solve(info, u)
    except np.linalg.LinAlgError:
        return np.full(len(beta), np.nan), True
    return beta + np.clip(step, -5, 5), bool(np.abs(step).max() < 1e-9)


def cox_result(beta: np.ndarray, info: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, standard errors) on the scale of the values from those of standardised ones; NaN where they ran away."""
    none = np.full(len(beta), np.nan), np.full(len(beta), np.nan)
    if not np.isfinite(beta).all() or np.abs(beta).max() > 30:
        return none
    try:
        variance = np.diag(np.linalg.inv(info))
    except np.linalg.LinAlgError:
        return none
    return (beta / sd, np.sqrt(variance) / sd) if (variance > 0).all() else none


def cox(time: np.ndarray, event: np.ndarray, x: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, standard errors) of proportional hazards by Newton steps, ties by Efron's method; NaN if it doesn't settle."""
    order = np.argsort(-time, kind="stable")
    time, dead, x = time[order], event[order].astype(bool), x[order]
    sd = x.std(axis=0)
    if (sd == 0).any():
        return np.full(x.shape[1], np.nan), np.full(x.shape[1], np.nan)
    z, beta, info = (x - x.mean(axis=0)) / sd, np.zeros(x.shape[1]), np.eye(x.shape[1])
    first = np.flatnonzero(np.r_[True, time[1:] != time[:-1]])  # of each time, latest times first
    last, d = np.r_[first[1:], len(time)] - 1, np.add.reduceat(dead.astype(np.int64), first)
    some = d > 0
    ties = np.repeat(np.arange(some.sum()), d[some])  # a row for each death
    share = (np.arange(len(ties)) - np.r_[0, np.cumsum(d[some])[:-1]][ties]) / d[some][ties]
    u0 = z[dead].sum(axis=0)
    for _ in range(rounds):
        r = np.exp(np.clip(z @ beta, -50, 50))
        rows = np.c_[r, r[:, None] * z, (r[:, None, None] * z[:, :, None] * z[:, None, :]).reshape(len(z), -1)]
        at_risk, of_dead = np.cumsum(rows, axis=0)[last][some], np.add.reduceat(rows * dead[:, None], first)[some]
        m = at_risk[ties] - share[:, None] * of_dead[ties]
        mean = m[:, 1 : 1 + z.shape[1]] / m[:, :1]
        info = (m[:, 1 + z.shape[1] :] / m[:, :1]).sum(axis=0).reshape(info.shape) - mean.T @ mean
        beta, settled = cox_step(beta, u0 - mean.sum(axis=0), info)
        if settled:
            break
    return cox_result(beta, info, sd)
