"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

1. Each text loses its white space and is cut where its own content says so, never at fixed offsets: after three characters in a
   row of a fixed class, at least MIN_CHUNK and at most MAX_CHUNK characters after the last cut. Equal texts are cut alike.
2. A chunk's identifier is its XXH64. Its recipe is the text's ordered list of identifiers, made where the row is read.
3. The chunk store groups identifiers with the chunk's SHA-256 and proves that each identifier has one content. Where two
   contents share an identifier, the recipes that hold it also carry the whole text's SHA-256, so they still compare exactly.
4. Rows with equal recipes are one group. Only ids, lengths, digests and recipes move; a text never leaves the task that read it.

Nulls count as empty texts and are equal to texts of white space only. Equal rows under one doc_id are separate rows of one
group, of which one stays. A null doc_id sorts after all others. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import keep_rows, with_row_ids, without_white
from karyoflux.runtime import materialize

MIN_CHUNK, MAX_CHUNK = 256, 4096

#: Cut characters: every eighth code point of Latin-1, and about one block in eight of other common scripts.
_CUT = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x100) if c % 8 == 1) + r"\x{430}-\x{433}\x{627}-\x{62A}\x{915}-\x{91A}\x{5000}-\x{57FF}\x{B000}-\x{B7FF}]"
CHUNK_PATTERN = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 3}}}?{_CUT}{{3}}|(?s).{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    """The chunks of a text without white space, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def recipes(df: DataFrame, rid: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, doc_id, n_points, digest, chunk): chunk is the ordered array of (id, sha) of a row's chunks."""
    flat = df.select(
        F.col(rid).alias("rid"), F.col(doc_id).alias("doc_id"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_points"), without_white(F.col(text)).alias("flat")
    )
    return flat.select(
        "rid", "doc_id", "n_points",
        F.unhex(F.sha2("flat", 256)).alias("digest"),
        F.transform(chunks(F.col("flat")), lambda c: F.struct(F.xxhash64(c).alias("id"), F.unhex(F.sha2(c, 256)).alias("sha"))).alias("chunk"),
    )


def chunk_store(rows: DataFrame) -> DataFrame:
    """(id, sha, n): the distinct chunks of all recipes with their uses."""
    return rows.select(F.explode("chunk").alias("c")).groupBy(F.col("c.id").alias("id"), F.col("c.sha").alias("sha")).agg(F.count("*").alias("n"))


def verified(rows: DataFrame) -> DataFrame:
    """rows with recipe (ordered verified identifiers) and split (null, or the digest where an identifier isn't unique)."""
    clashing = materialize(chunk_store(rows).groupBy("id").agg(F.count("*").alias("contents")).where("contents > 1").select("id"), "clashes")
    listed = rows.select("rid", "doc_id", "n_points", "digest", F.col("chunk.id").alias("recipe"))
    if clashing.isEmpty():
        return listed.withColumn("split", F.lit(None).cast("binary"))
    doubtful = rows.select("rid", F.explode("chunk.id").alias("id")).join(clashing, "id", "left_semi").select("rid").distinct()
    return listed.join(doubtful.withColumn("doubt", F.lit(True)), "rid", "left").withColumn("split", F.when(F.col("doubt"), F.col("digest"))).drop("doubt")


def decide(df: DataFrame, rid: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: rid, doc_id, keep_id, keep_rid, group_size, kept, text_sha256.

    Of equal texts the row with the most code points stays, then the least doc_id, then the least rid.
    """
    rows = materialize(recipes(df, rid, doc_id, text), "recipes")
    rows = verified(rows)
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    groups = rows.groupBy("recipe", "split").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select(F.col("recipe").alias("g_recipe"), F.col("split").alias("g_split"), F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    return rows.join(groups, (F.col("recipe") == F.col("g_recipe")) & F.col("split").eqNullSafe(F.col("g_split"))).select(
        "rid", "doc_id", "keep_id", "keep_rid", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """decide() over a table without row ids. Ids are given to the narrow rows, which are written before use."""
    rid = "_rid"
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn(rid, F.monotonically_increasing_id())
    return decide(slim, rid).drop("rid", "keep_rid")


def drop_exact_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each group of equal texts, all columns as they were."""
    numbered, rid = with_row_ids(df, "exact")
    kept = decide(numbered, rid, doc_id, text).where("kept").select(F.col("rid").alias(rid))
    return keep_rows(numbered, rid, kept)
