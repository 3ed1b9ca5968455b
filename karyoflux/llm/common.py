"""What the operators share: table access, row ids, white space, held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from karyoflux.runtime import materialize

#: The white space of the contracts: space and U+0009 to U+000D.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WHITE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one Arrow batch, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows; texts have no bound, and a worker holds one batch at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or wanted with underscores until no column of df has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows in a row of one task whose verdicts are one bitmap; Spark's bitmaps have this many bits.
BLOCK = 1 << 15


def with_row_ids(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written once with a row id that later reads all agree on, and that column's name.

    monotonically_increasing_id depends on how a scan was split, so the numbered rows are written before anything uses them. The
    table is bucketed by the id's block of BLOCK rows (column rid + "_block"), which lets keep_rows filter it where it lies.
    """
    rid = "_row_id"
    while free_name(df, rid) != rid or free_name(df, f"{rid}_block") != f"{rid}_block":
        rid += "_"
    numbered = df.withColumn(rid, F.monotonically_increasing_id())
    return materialize(numbered.withColumn(f"{rid}_block", F.shiftright(rid, 15)), label, by=f"{rid}_block"), rid


def repeat_rows(df: DataFrame, rid: str, times: DataFrame, most: int) -> DataFrame:
    """The rows of df (of with_row_ids) as often as times (rid, times) says, 0 to most, without the id's columns.

    Only ids are shuffled: they become bitmaps of a block, one for each number of times, and meet df in a join on the block, by
    which df is bucketed already. A text never leaves the task that reads it, and no side is broadcast.
    """
    block, bit, bits, often = f"{rid}_block", free_name(df, "_bit"), free_name(df, "_bits"), free_name(df, "_times")
    ids = times.select(F.shiftright(rid, 15).alias(block), F.col(rid).bitwiseAND(F.lit(BLOCK - 1)).alias(bit), F.col("times").alias(often))
    maps = ids.repartition(block).groupBy(block).agg(*[F.expr(f"bitmap_construct_agg(`{bit}`) FILTER (WHERE `{often}` >= {k})").alias(f"{bits}{k}") for k in range(1, most + 1)])
    kept = [c for c in df.columns if c not in (rid, block)]
    at = F.col(rid).bitwiseAND(F.lit(BLOCK - 1))
    met = df.join(maps.hint("shuffle_hash"), block).select(*kept, F.array(*[_bit(F.col(f"{bits}{k}"), at) for k in range(1, most + 1)]).alias(often))
    n = F.aggregate(often, F.lit(0), lambda a, x: a + x)
    if most == 1:
        return met.where(n > 0).select(*kept)
    return met.where(n > 0).withColumn(often, F.explode(F.sequence(F.lit(1), n))).select(*kept)


def _bit(bits: Column, at: Column) -> Column:
    """Bit number at of a bitmap, as 0 or 1."""
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at.bitwiseAND(F.lit(7)) + 1).cast("int"))) > 0, 1).otherwise(0)


def keep_rows(df: DataFrame, rid: str, kept: DataFrame) -> DataFrame:
    """The rows of df (of with_row_ids) whose id is in kept (one column named like rid), without the id's columns."""
    return repeat_rows(df, rid, kept.withColumn("times", F.lit(1)), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def without_white(text: Column) -> Column:
    """text without any of WHITE; null counts as empty. One byte search per character beats a regular expression."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than WHITE; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    parts = F.size(F.split(t, f"{WHITE_CLASS}+"))
    edges = t.rlike(f"^{WHITE_CLASS}").cast("long") + t.rlike(f"{WHITE_CLASS}\\z").cast("long")
    return F.when(t == "", F.lit(0)).otherwise(parts - edges).cast("long")
