"""Genome sequence from FASTA text, as chunks of fixed length that joins can find by position.

A file is read in splits, by many tasks. A line doesn't know which sequence it belongs to, nor where in it, since its header may lie
in an earlier split. So lines are numbered inside their split, the stretches between headers are summed to one row each, and
those few rows carry names and offsets from split to split; the lines then meet their stretch and are cut at chunk borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from karyoflux.operators.variants import plain_chrom
from karyoflux.runtime import materialize

#: Bases of a chunk.
CHUNK = 100_000


def read_fasta(spark: SparkSession, path: str | list[str], chunk: int = CHUNK) -> DataFrame:
    """(chrom, bin, seq): bases bin * chunk + 1 to (bin + 1) * chunk of each sequence; the last chunk of a sequence is shorter.

    A sequence is named by the first word of its header, without "chr". Empty lines and text before the first header are skipped.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line")).where("line <> ''")
    split = Window.partitionBy("file", "block").orderBy("line_no")
    header = F.col("line").startswith(">")
    lines = text.withColumn("stretch", F.sum(header.cast("int")).over(split)).withColumn("size", F.when(header, 0).otherwise(F.length("line")).cast("long"))
    before = Window.partitionBy("file", "block", "stretch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = materialize(lines.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))), "fasta-lines")
    name = plain_chrom(F.regexp_extract("line", r"^>\s*(\S*)", 1))
    parts = lines.groupBy("file", "block", "stretch").agg(F.sum("size").alias("total"), F.max(F.when(header, name)).alias("name"))
    # a row a split and header: the name comes from the last header, the offset from what the sequence has before
    in_file = Window.partitionBy("file").orderBy("block", "stretch")
    parts = parts.withColumn("chrom", F.last("name", ignorenulls=True).over(in_file)).withColumn("seq_no", F.count("name").over(in_file))
    earlier = Window.partitionBy("file", "seq_no").orderBy("block", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0))).where("chrom IS NOT NULL").select("file", "block", "stretch", "chrom", "offset")
    placed = lines.where(~header).join(parts, ["file", "block", "stretch"]).select("chrom", (F.col("offset") + F.col("at")).alias("first"), "size", "line")
    bins = F.sequence(F.expr(f"first div {chunk}"), F.expr(f"(first + size - 1) div {chunk}"))
    pieces = placed.withColumn("bin", F.explode(bins)).withColumn("skip", F.greatest(F.col("bin") * chunk - F.col("first"), F.lit(0)))
    pieces = pieces.select("chrom", "bin", (F.col("first") + F.col("skip")).alias("at"), F.substring("line", F.col("skip") + 1, (F.col("bin") + 1) * chunk - F.col("first") - F.col("skip")).alias("piece"))
    whole = pieces.groupBy("chrom", "bin").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))  # chunk bases
    return whole.select("chrom", "bin", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))
