"""Near-duplicates by SimHash with pigeonhole blocks.

A fingerprint has 64 bits from the XXH64 hashes of a text's word shingles. Fingerprints within `distance` bits are linked, and
components of links are near-duplicate groups. Fingerprints that agree are one node, so copies never multiply.

Candidates: the 64 bits are cut into `blocks` blocks. Two fingerprints within `distance` bits agree on at least
blocks - distance whole blocks, so rows are keyed by every choice of that many blocks, joined on the key and verified by
Hamming distance. A key that more than HOT_KEY fingerprints share isn't paired up: those fingerprints are cut again, down to
single bits. Two of them within 2 bits have a common point at most one bit from each, so each fingerprint meets the others at
its 65 nearest points, and all that meet at a point lie within 2 bits of each other by the triangle inequality. Linking each
one to the least there keeps exactly the components that all pairs would give, in rows linear in the number of fingerprints.

Null and empty texts, and texts of white space only, have fingerprint zero, which is linked like any other. Repeated rows share
their group. A null doc_id never names a group unless all its ids are null. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import keep_rows, small_batches, with_row_ids
from karyoflux.operators.components import connected_components
from karyoflux.runtime import materialize

DISTANCE, BLOCKS, SHINGLE, SEED = 2, 4, 3, 42
#: Fingerprints of one key that are still compared in pairs.
HOT_KEY = 64
#: Shingles hashed at once, which bounds memory for texts of any length.
STRIDE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), seed))
    n, ones = len(words) - shingle + 1, np.zeros(64, np.int64)
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), itertools.repeat(seed))
    for at in range(0, n, STRIDE):
        part = np.fromiter(itertools.islice(hashes, STRIDE), np.uint64, min(STRIDE, n - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprints(df: DataFrame, text: str = "text", out: str = "fp", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, shingle, seed) for t in s], dtype="int64")

    small_batches(df.sparkSession)
    return df.withColumn(out, of(F.col(text)))


def block_keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """An array of (choice, key): the bits of every choice of blocks - distance blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in range(edges[i], edges[i + 1])) for i in range(blocks)]
    choices = [sum(masks[i] for i in c) for c in itertools.combinations(range(blocks), blocks - distance)]
    return F.array(*[F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for n, m in enumerate(choices)])


def links(fps: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, hot_key: int = HOT_KEY) -> DataFrame:
    """(a, b): links between the distinct fingerprints fps (fp) that have the same components as all links within distance.

    Distances other than 2 have no hot path: there all keys are paired.
    """
    keyed = materialize(fps.select("fp", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "k.choice", "k.key"), "keys")
    counts = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(counts.select("choice", "key", "n"), "shared")
    few = keyed.join(shared.where(F.col("n") <= hot_key) if distance == 2 else shared, ["choice", "key"], "left_semi")
    pairs = few.select("choice", "key", F.col("fp").alias("a")).join(few.select("choice", "key", F.col("fp").alias("b")), ["choice", "key"])
    pairs = pairs.where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    if distance != 2:
        return pairs
    hot = keyed.join(shared.where(F.col("n") > hot_key), ["choice", "key"], "left_semi").select("fp").distinct()
    points = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(64)])
    met = hot.select(F.explode(points).alias("point"), "fp")
    least = met.groupBy("point").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top > b").select("point", "b")
    near = met.join(least, "point").select(F.col("fp").alias("a"), "b").where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return pairs.unionByName(near)


def groups(rows: DataFrame, found: DataFrame | None = None, **how) -> DataFrame:
    """rows (rid, doc_id, fp) with component_id and keep_rid: the least doc_id of its group, and the row that has it.

    found: components (node, component) of fingerprints, in place of those of links().
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    nodes = materialize(rows.groupBy("fp").agg(first.alias("first")), "nodes")
    found = connected_components(links(nodes.select("fp"), **how)) if found is None else found
    rooted = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = rooted.groupBy("component").agg(F.min("first").alias("least"))
    names = rooted.select("fp", "component").join(named, "component").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep_rid"))
    return rows.join(names, "fp")


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rid: str | None = None, shingle: int = SHINGLE, **how) -> DataFrame:
    """(rid, doc_id, fp, component_id, keep_rid) for each row of df. how: blocks, distance, hot_key of links()."""
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    slim = df.select(number.alias("rid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return groups(materialize(with_fingerprints(slim, shingle=shingle).drop("text"), "fingerprints"), **how)


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df with one row of each near-duplicate group, all columns as they were."""
    numbered, rid = with_row_ids(df, "near")
    kept = near_dedup(numbered, doc_id, text, rid, **how).where("rid = keep_rid").select(F.col("rid").alias(rid))
    return keep_rows(numbered, rid, kept)
