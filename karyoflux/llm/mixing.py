"""Weighted fair queueing of sources to target token shares, in DataFrame functions only.

Each source is a flow. Its documents, shuffled by a seeded digest and repeated up to max_repeats times, queue one after
another; a document's virtual finish time is its source's tokens up to and with it, divided by the source's target. Served in
order of finish time, all sources progress in proportion to their targets; the queue stops where the total budget is spent.

Prefix sums run in two levels so that no source, however large, meets in one task: sums per (source, range of the shuffle
key), a running sum over those few rows, then a running sum inside each range. The global cut does the same over ranges of the
finish time: whole ranges below the cut are taken, and only documents of the range in which the budget ends are put in order.

Null sources are one source, last in order. A null or empty text has size 0 and is never taken. Repeated rows are separate
documents; those with one id and size tie and are interchangeable. Without any words every target and taken is 0. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.llm.common import repeat_rows, with_row_ids, word_count
from karyoflux.runtime import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Seed of the shuffle.
SEED = "mix-1"
#: Ranges of finish times counted at once, and rows of a range that are put in order to find the cut.
CUT_RANGES, CUT_ROWS = 1024, 20_000


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_rank, source_size, target) from (source, source_size): one row a source.

    Targets share the total by weight; those above max_repeats times their size stop there and the excess is shared among the
    others by weight until none is above. In closed form: with sources in order of cap / weight, the first k are capped, k the
    least for which the next one's share of what is left, by weight, is under its cap.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_rank") - 1) % n + 1).cast("int"))
    s = sizes.withColumn("source_rank", F.row_number().over(in_order)).withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), "source_rank")
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", level)
    return s.select("source", "source_rank", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def finish_times(slim: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(rid, doc_id, size, source_rank, source_size, target, served) from (rid, doc_id, source, size).

    served: the source's words up to and with this row in its shuffled order.
    """
    rows = slim.count()
    ranges = max(1, math.ceil(math.sqrt(rows)))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    slim = slim.withColumn("key", key).withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("int"))
    slim = slim.withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    per_range = materialize(slim.groupBy("no_source", "source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    sizes = per_range.groupBy("no_source", "source").agg(F.sum("range_size").alias("source_size"))
    sizes = sizes.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size")
    targets = source_targets(sizes, weights, max_repeats).withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    earlier = Window.partitionBy("no_source", "source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("start", F.coalesce(F.sum("range_size").over(earlier), F.lit(0))).drop("range_size").join(targets, ["no_source", "source"])
    inside = Window.partitionBy("no_source", "source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    served = slim.join(starts, ["no_source", "source", "range"]).withColumn("served", F.col("start") + F.sum("size").over(inside))
    return served.select("rid", "doc_id", "size", "source_rank", "source_size", "target", "served")


def _finish(epoch) -> F.Column:
    return (epoch * F.col("source_size") + F.col("served")).cast("double") / F.col("target")


def budget_cut(queue: DataFrame, max_repeats: int = MAX_REPEATS) -> tuple[float, int]:
    """(finish, source_rank) of the first turn that no longer fits in the budget, which is the sum of all sizes.

    Ranges of finish times are summed, the range in which the budget ends is divided again, and so on until it is small.
    """
    turns = queue.where("size > 0 and target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("finish", _finish(F.col("epoch"))).select("finish", "source_rank", "size")
    top = turns.agg(F.max("finish"), F.count("*")).first()
    budget = queue.agg(F.sum("size")).first()[0] or 0
    low, width, rows = 0.0, top[0] or 0.0, top[1]
    while rows > CUT_ROWS and width / CUT_RANGES > 0:
        width /= CUT_RANGES
        turns = turns.withColumn("slot", F.least(F.greatest(F.floor((F.col("finish") - low) / width), F.lit(0)), F.lit(CUT_RANGES - 1)))
        for slot, total, n, least, most in sorted(tuple(r) for r in turns.groupBy("slot").agg(F.sum("size"), F.count("*"), F.min("finish"), F.max("finish")).collect()):
            if total > budget:
                break
            budget -= total
        else:
            return math.inf, 0
        if least == most:  # turns that finish together go by source, of which each has one
            for rank, total in sorted(tuple(r) for r in turns.where(F.col("slot") == slot).groupBy("source_rank").agg(F.sum("size")).collect()):
                if total > budget:
                    return least, rank
                budget -= total
        low, rows, turns = low + slot * width, n, turns.where(F.col("slot") == slot).drop("slot")
    running = F.sum("size").over(Window.orderBy("finish", "source_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = turns.withColumn("running", running).where(F.col("running") > budget).orderBy("finish", "source_rank").select("finish", "source_rank").first()
    return (first[0], first[1]) if first else (math.inf, 0)


def mix(slim: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(rid, doc_id, size, source_size, target, times, taken) for each row of slim (rid, doc_id, source, size)."""
    queue = materialize(finish_times(slim, weights, max_repeats, seed), "queue")
    finish, rank = budget_cut(queue, max_repeats)
    first = lambda e: (_finish(F.lit(e)) < finish) | ((_finish(F.lit(e)) == finish) & (F.col("source_rank") < rank))
    times = sum((F.when((F.col("size") > 0) & (F.col("target") > 0) & first(e), 1).otherwise(0) for e in range(1, max_repeats)), F.when((F.col("size") > 0) & (F.col("target") > 0) & first(0), 1).otherwise(0))
    return queue.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times")).select("rid", "doc_id", "size", "source_size", "target", "times", "taken")


def slim_rows(df: DataFrame, rid: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(rid, doc_id, source, size), written so that the texts are read once."""
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    return materialize(df.select(number.alias("rid"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")), "sizes")


def mix_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of df as often as it is taken, with df's columns."""
    numbered, rid = with_row_ids(df, "mix")
    slim = slim_rows(numbered, rid, doc_id, text, source)
    return repeat_rows(numbered, rid, mix(slim).where("times > 0").select(F.col("rid").alias(rid), "times"), MAX_REPEATS)
