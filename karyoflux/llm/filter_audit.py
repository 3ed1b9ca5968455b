"""Audit of filters that are applied one after another: what each removes, in every order, by a subset-zeta transform.

Every document becomes a mask with one bit a filter it fails. Documents are counted once by part and mask (2^k counts for k
filters). The zeta transform sums these counts over the subsets of every mask in k rounds; the survivors of a filter set are the
documents whose mask is a subset of the other filters, so each step of each order is the difference of two neighbouring sets.
Documents with a good or a toxic label go through the same transform. No document is looked at again, whatever the order.

The fifth filter, an identical text under a smaller id, needs all documents. Only digests move: rows that are alike are counted
where they are read, then by digest, part, mask and label, and the smallest id of a digest meets at most one row a part, mask
and label. A text that a third of all rows share is thus a few rows by the time it is shuffled.

Null text is empty. Null lang is part "". A null id is neither smaller nor larger than others: such rows never fail for identity
and have no labels. Repeated rows are separate documents, and rows of equal id and text aren't copies of each other. A document
is good (toxic) if any of its label rows says 1. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karyoflux.llm.common import WHITE_CLASS

#: Thresholds: fewest words, least per cent of distinct words, most per cent of capitals, characters of code and markup.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 100, 80, 10, r"[#$%&*|]"
#: Bits of the filters on a text alone, in order, and of identity.
TEXT_FILTERS, IDENTITY = "ABCD", "E"
#: Orders of more filters than this are too many rows to list.
MOST_FILTERS = 8


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every document: mask has bit i set if the text fails filter i of TEXT_FILTERS."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("t"), F.split(text, f"{WHITE_CLASS}+").alias("w"))
    first, last = F.element_at("w", 1) == "", (F.element_at("w", -1) == "") & (F.size("w") > 1)  # white space at an edge, or no text
    words = F.size("w") - first.cast("int") - last.cast("int")
    distinct = F.size(F.array_distinct("w")) - (first | last).cast("int")
    rows = rows.select("doc_id", "part", "t", words.cast("long").alias("words"), distinct.cast("long").alias("distinct"))
    fails = [
        F.col("words") < MIN_WORDS,
        100 * F.col("distinct") < MIN_DISTINCT * F.col("words"),
        100 * F.regexp_count("t", F.lit("[A-Z]")).cast("long") > MAX_CAPITALS * F.length("t").cast("long"),
        F.col("t").rlike(MARKS),
    ]
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, identity_bit: int = 1 << len(TEXT_FILTERS)) -> DataFrame:
    """(part, mask, n, good, toxic) from text_masks: documents, and those with a good and a toxic label, by part and full mask."""
    alike = masks.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    said = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    said = said.where("good + toxic > 0").select(F.col("doc_id").cast("string").alias("key"), "good", "toxic")
    # null ids, which have no labels, would be one key of the join
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.hex("digest")))
    rows = alike.withColumn("key", key).join(said, "key", "left").fillna(0, ["good", "toxic"])
    # doc_ids are distinct within a group by now, so the rows of the smallest one are those of min_by
    by_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first")
    )
    least = F.min("first").over(Window.partitionBy("digest"))  # of a row a part and label, so texts are read once
    unlike = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = by_text.withColumn("least", least).withColumn("unlike", unlike).withColumn("copies", F.col("n") - F.col("unlike"))
    weights = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = split.groupBy("part", "mask").agg(*[F.sum(F.col(side) * w).alias(f"{side}_{m}") for side in ("unlike", "copies") for m, w in weights.items()])
    side = lambda s, bit: F.struct((F.col("mask") + bit).alias("mask"), *[F.col(f"{s}_{m}").alias(m) for m in weights])
    return sums.select("part", F.inline(F.array(side("unlike", 0), side("copies", identity_bit))))


def zeta(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """df with each column, an array of 2^k counts by mask, summed over the subsets of every mask."""

    def with_bit(c: str, bit: int) -> Column:
        """Counts of masks with the bit, plus those of the same masks without it."""
        return F.transform(c, lambda x, i: F.when(i.bitwiseAND(F.lit(bit)) != 0, x + F.element_at(c, i - bit + 1)).otherwise(x))

    for b in range(k):
        df = df.withColumns({c: with_bit(c, 1 << b) for c in columns})
    return df


def order_steps(counts: DataFrame, filters: str) -> DataFrame:
    """Every step of every order of the filters, by part, from (part, mask, n, good, toxic) with bit i for filters[i].

    kept after the step, removed in it, redundant (fail its filter, removed before), unique_fails (fail no other), good_lost and
    toxic_lost (removed in it), and shapley: the filter's removed summed over all orders.
    """
    k, full = len(filters), (1 << len(filters)) - 1
    if not 0 < k <= MOST_FILTERS or len(set(filters)) != k:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters, not {filters!r}")
    measures = ("n", "good", "toxic")
    cells = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures).alias("v")))).alias("cells"))  # 2^k at most
    filled = lambda m: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda i: F.coalesce(F.try_element_at("cells", i)[m], F.lit(0)).cast("long"))
    arrays = cells.select("part", *[filled(m).alias(m) for m in measures], filled("n").alias("exact"))
    sums = zeta(arrays, measures, k)

    def left(m: str, gone: Column) -> Column:
        """Survivors of the filters of mask gone."""
        return F.element_at(m, F.lit(full) - gone + 1)

    def shapley(bit: int) -> Column:
        orders = F.array(*[F.lit(math.factorial(j) * math.factorial(k - 1 - j)) for j in range(k)])  # in which j given ones come before

        def add(total: Column, s: Column) -> Column:
            rest = s.bitwiseAND(F.lit(bit)) == 0
            return total + F.when(rest, F.element_at(orders, F.bit_count(s) + 1) * (left("n", s) - left("n", s + bit))).otherwise(F.lit(0))

        return F.aggregate(F.sequence(F.lit(0), F.lit(full - bit)), F.lit(0).cast("long"), add)

    bits = [1 << i for i in range(k)]
    sums = sums.withColumn("shapleys", F.array(*[shapley(b) for b in bits]))
    listed = F.array(*[F.lit("".join(p)) for p in itertools.permutations(filters)])
    steps = sums.withColumn("filter_order", F.explode(listed)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    before = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    place = F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1)))
    steps = steps.withColumn("before", sum((F.when(F.contains(before, F.lit(f)), b).otherwise(0) for f, b in zip(filters, bits, strict=True)), F.lit(0)))
    steps = steps.withColumn("place", place).withColumn("bit", F.element_at(F.array(*map(F.lit, bits)), F.col("place")))
    lost = lambda m: left(m, F.col("before")) - left(m, F.col("before") + F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", left("n", F.col("before") + F.col("bit")).alias("kept"), lost("n").alias("removed"),
        (left("n", F.lit(0)) - left("n", F.col("bit")) - lost("n")).alias("redundant"), F.element_at("exact", F.col("bit") + 1).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.element_at("shapleys", F.col("place")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over documents (doc_id, text, lang) and labels (doc_id, quality, toxic): one row a part, order and step."""
    return order_steps(mask_counts(text_masks(docs), labels), TEXT_FILTERS + IDENTITY)
