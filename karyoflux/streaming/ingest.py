"""Incremental ingest: new VCF files of a folder become variants and per-sample results as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from karyoflux.sources import tables, vcf


def arriving_lines(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of (sample_id, line, arrived) from a folder that files are put into; arrived is when the file was written."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"(?i)(\.vcf)?(\.b?gz)?$", "")
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder).select(name.alias("sample_id"), F.col("value").alias("line"), F.col("_metadata.file_modification_time").alias("arrived"))


def score_arrivals(lines: DataFrame, score: Callable[[DataFrame], DataFrame], cache: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs score on the variants of each batch's samples and replaces those samples' results in the cache.

    A file is a whole sample, so a batch holds all lines of its samples; a batch that is run again replaces its samples once more.
    """

    def batch(df: DataFrame, _: int) -> None:
        tables.write_cache(score(vcf.sv_from_lines(df.drop("arrived"))), cache)

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def breakpoint_rates(lines: DataFrame, window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Records by the window in which their file was written and type: (window, kind, count); files up to `delay` late count."""
    t = lines.withWatermark("arrived", delay)
    kind = F.when(F.col("line").contains("SVTYPE=BND"), "BND").otherwise(F.regexp_extract("line", "SVTYPE=([A-Z]+)", 1))
    return t.where(~F.col("line").startswith("#")).groupBy(F.window("arrived", window), kind.alias("kind")).count()
