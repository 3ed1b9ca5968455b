"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become integers, floor(256 c), so that counts and sums are exact. The fit list holds each distinct integer vector once.
Every partition of it keeps a summary: number of vectors, exact sums, and all singular values and right vectors of its centred
rows; none are cut off. Two summaries merge by stacking their scaled vectors with one more row, sqrt(n m / (n + m)) times the
difference of the means, and decomposing that again: the Gram matrix of the stack is the scatter of the union about its own
mean, so nothing is lost. Partitions merge batches as they read them; summaries then merge FAN at a time in rounds of tasks until one is
left. A summary has at most d values and d vectors of d entries, whatever the number of rows, and no covariance is ever formed,
which would square the condition. The model (d x d) is the one thing that reaches the driver.

Dropped are rows whose vector is null, empty, or holds null, not finite or huge entries (|c| of 2^44 or more, whose integers are not exact), and
vectors of another length than the commonest of the fit list (of equally common ones the longest). Repeated rows and ids are each
returned. A component whose variance is zero but for rounding has whitened null and explained 0; with one distinct vector or
equal ones all are such, and explained is null. An empty table gives no rows. deviation is null where it exceeds a long. The sign
of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from karyoflux.runtime import cleaned, materialize

#: Entries times this, rounded down, are the integers.
SCALE = 256
#: |c| from here on isn't exact as an integer.
HUGE = float(1 << 44)
#: Rows decomposed at once, and summaries merged by one task.
ROWS, FAN = 2048, 8
_SUMMARY = "part long, n long, sums array<decimal(38,0)>, scaled array<double>"


def quantise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """df with x, the integers of column, without rows that have none."""
    plain = lambda c: F.coalesce(F.abs(c.cast("double")) < HUGE, F.lit(False))  # noqa: E731  false for null and infinite; NaN is greatest in Spark
    whole = df.where(F.col(column).isNotNull()).where((F.size(column) > 0) & F.forall(column, plain))
    return whole.withColumn("x", F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles: whole parts are subtracted as integers, so large means cost no digits."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(np.float64) - np.array([(s % n) / n for s in sums])


@dataclass
class Summary:
    """Of n rows: exact sums, and scaled, whose Gram matrix is the scatter of the rows about their mean (values times vectors)."""

    n: int
    sums: list[int]
    scaled: np.ndarray


def _decomposed(stack: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(stack, full_matrices=False)
    return s[:, None] * vt


def summary_of(x: np.ndarray) -> Summary:
    sums = [int(v) for v in np.add.reduce(x, axis=0, dtype=object)] if np.abs(x).max(initial=0) > (1 << 62) // max(len(x), 1) else [int(v) for v in x.sum(axis=0)]
    return Summary(len(x), sums, _decomposed(centred(x, len(x), sums)))


def merged(a: Summary, b: Summary) -> Summary:
    """The summary of the rows of both."""
    n = a.n + b.n
    apart = np.array([(q * a.n - p * b.n) / (a.n * b.n) for p, q in zip(a.sums, b.sums, strict=True)])  # integers until the division
    row = np.sqrt(a.n / n * b.n) * apart
    return Summary(n, [p + q for p, q in zip(a.sums, b.sums, strict=True)], _decomposed(np.vstack([a.scaled, b.scaled, row])))


def _packed(part: int, s: Summary) -> dict:
    return {"part": part, "n": s.n, "sums": [Decimal(v) for v in s.sums], "scaled": s.scaled.ravel().tolist()}


def _unpacked(n: int, sums: list, scaled: list) -> Summary:
    return Summary(int(n), [int(v) for v in sums], np.asarray(scaled, dtype=np.float64).reshape(-1, len(sums)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summaries(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Summary | None = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), ROWS):
                part = summary_of(x[at : at + ROWS])
                total = merged(total, part) if total else part
        if total:
            schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0))), ("scaled", pa.list_(pa.float64()))])
            yield pa.RecordBatch.from_pylist([_packed(TaskContext.get().partitionId(), total)], schema)

    return run


def _merge_group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total: Summary | None = None
    for r in rows.sort_values("part").itertuples():
        one = _unpacked(r.n, r.sums, r.scaled)
        total = merged(total, one) if total else one
    return pd.DataFrame([_packed(key[0], total)])


@dataclass
class Whitening:
    """A fitted model: n vectors of the fit list, their sums, variances and unit components by falling variance (rows)."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        """Components whose variance isn't rounding error of the largest."""
        least = self.variances.max(initial=0.0) * (len(self.sums) * np.finfo(float).eps) ** 2
        return self.variances > max(least, 0.0)

    def whiten(self, x: np.ndarray, k: int) -> np.ndarray:
        """Rows of x on the first k components, each over its deviation; NaN where there is none."""
        z = centred(x, self.n, self.sums) @ self.components[:k].T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.usable()[:k], z / np.sqrt(self.variances[:k]), np.nan)

    def explained(self) -> list[float | None]:
        total = float(self.variances.sum())
        return [float(v) / total if total > 0 else None for v in np.where(self.usable(), self.variances, 0.0)]


def fit_list(df: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(x) with each distinct vector of the commonest length once, written to the scratch folder, and that length (0: no vectors)."""
    distinct = materialize(quantise(df.select(column), column).select("x").distinct(), "fit-list")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0
    return distinct.where(F.size("x") == d), d


def fit(vectors: DataFrame, d: int, k: int) -> Whitening | None:
    """The model of fit_list's vectors; k: components whose identity_error is measured. None without vectors."""
    if not d:
        return None
    left = materialize(vectors.mapInArrow(_summaries(d), _SUMMARY), "summaries")
    while left.count() > 1:
        left = materialize(left.withColumn("part", F.expr(f"part div {FAN}")).groupBy("part").applyInPandas(_merge_group, _SUMMARY), "summaries")
    total = _unpacked(*left.select("n", "sums", "scaled").first())
    _, s, vt = np.linalg.svd(total.scaled, full_matrices=True)
    variances = np.zeros(d)
    variances[: len(s)] = s**2 / total.n
    largest = np.take_along_axis(vt, np.abs(vt).argmax(axis=1)[:, None], axis=1)
    model = Whitening(total.n, total.sums, variances, vt * np.where(largest < 0, -1.0, 1.0))
    model.identity_error = _identity_error(vectors, model, min(k, d))
    return model


def _identity_error(vectors: DataFrame, model: Whitening, k: int) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, over usable components: partitions are centred apart."""
    use, d = np.flatnonzero(model.usable()[:k]), len(model.sums)
    if not len(use):
        return None
    m = len(use)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = model.whiten(_matrix(batch.column(0), d), k)[:, use]
            if len(z):
                mean = z.mean(axis=0)
                scatter = (z - mean).T @ (z - mean) + len(z) * np.outer(mean, mean)
                yield pa.RecordBatch.from_pydict({"n": [len(z)], "v": [np.concatenate([len(z) * mean, scatter.ravel()]).tolist()]})

    sums = vectors.mapInArrow(moments, "n long, v array<double>").agg(F.sum("n"), *[F.sum(F.col("v")[i]) for i in range(m + m * m)]).first()
    n, mean = sums[0], np.array(sums[1 : 1 + m]) / sums[0]
    return float(np.abs(np.array(sums[1 + m :]).reshape(m, m) / n - np.outer(mean, mean) - np.eye(m)).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2 for every row, exactly; None beyond a long."""
    most = max(int(np.abs(x).max(initial=0)) * n, 0) + max(map(abs, sums), default=0)
    wide = most * most * max(len(sums), 1) >= 1 << 63
    apart = x.astype(object if wide else np.int64) * n - np.array(sums, dtype=object if wide else np.int64)
    found = [int(v) for v in (apart * apart).sum(axis=1)]
    return [v if v < 1 << 63 else None for v in found]


def whiten(df: DataFrame, model: Whitening | None, column: str = "embedding", k: int = 4, keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """The columns keep, deviation and whitened (an array of the first k components) of each row that the model fits."""
    shape = df.select(*keep).schema
    rows = quantise(df.select(*keep, F.col(column).alias("_v")), "_v").select(*keep, "x")
    d = len(model.sums) if model else 0
    rows = rows.where(F.size("x") == d)
    k = min(k, d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(len(keep)), d)
            z = model.whiten(x, k) if len(x) else np.zeros((0, k))
            white = pa.array([[None if np.isnan(v) else v for v in r] for r in z.tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(deviations(x, model.n, model.sums), pa.int64()), white], names=[*keep, "deviation", "whitened"])

    for name, kind in (("deviation", LongType()), ("whitened", ArrayType(DoubleType()))):
        shape = shape.add(name, kind)
    return rows.mapInArrow(run, shape) if model else _none(df.sparkSession, shape)


def _none(spark: SparkSession, shape) -> DataFrame:
    return spark.createDataFrame([], shape)


def components(df: DataFrame, column: str = "embedding", k: int = 4) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row a vector and component up to k."""
    with cleaned():  # the model is all that is needed of the fit list
        vectors, d = fit_list(df, column)
        model = fit(vectors, d, k)
    rows = whiten(df, model, column, k).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "white"))
    explained = F.array(*[F.lit(v).cast("double") for v in (model.explained()[:k] if model else [None])])
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", F.col("white").alias("whitened"),
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
