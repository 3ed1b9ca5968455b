"""Sample sheets, gene lists, the result cache and text tables."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karyoflux.model import DEFAULT_DRIVERS


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """A text table whose columns are set apart by any run of blanks or tabs, under a header; NA is null, as is a missing last value,
    and text behind # is a comment. All columns are text."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " ")).alias("line")).where("line <> ''")
    head = lines.first()
    if head is None:
        raise ValueError(f"no header in {path}")
    cells = F.split("line", " ")
    names = head["line"].split(" ")
    value = lambda i: F.nullif(F.get(cells, F.lit(i)), F.lit("NA"))
    return lines.where(F.col("line") != head["line"]).select(*[value(i).alias(n.strip("\"'")) for i, n in enumerate(names)])


def read_sample_sheet(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """sample_id, sv_file, cnv_file; the sample is named after its file if not given, and a repeated one is an error.

    Without sep a .csv file has commas and any other is aligned by blanks.
    """
    if sep is None and not path.lower().endswith(".csv"):
        s = read_aligned(spark, path)
    else:
        s = spark.read.csv(path, header=True, sep=sep or ",", nullValue="NA")
    if "sv_file" not in s.columns:
        raise ValueError("a sample sheet needs the column sv_file")
    name = F.regexp_replace(F.element_at(F.split("sv_file", "/"), -1), r"(?i)(\.vcf)?(\.b?gz)?$", "")
    s = s.select((F.col("sample_id") if "sample_id" in s.columns else name).alias("sample_id"), "sv_file", (F.col("cnv_file") if "cnv_file" in s.columns else F.lit(None).cast("string")).alias("cnv_file"))
    again = s.groupBy("sample_id").count().where("count > 1").select("sample_id").take(5)
    if again:
        raise ValueError(f"repeated samples: {', '.join(str(r[0]) for r in again)}")
    return s


def read_clinical(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, header=True, sep=sep, inferSchema=True)


def cancer_genes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(symbol, gene_type): a tab-separated gene list, or the default drivers with type Unknown."""
    if path:
        g = spark.read.csv(path, header=True, sep="\t")
        return g.select(F.col("Hugo_Symbol").alias("symbol"), (F.col("Gene_Type") if "Gene_Type" in g.columns else F.lit("Unknown")).alias("gene_type"))
    return spark.createDataFrame([(s, "Unknown") for s in DEFAULT_DRIVERS], "symbol string, gene_type string")


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """Gene models from Parquet or CSV; the symbol comes from symbol, gene_name or gene_id, whichever is first."""
    g = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    name = next(c for c in ("symbol", "gene_name", "gene_id") if c in g.columns)
    g = g.withColumn("symbol", F.col(name))
    return g if "type" in g.columns else g.withColumn("type", F.lit("gene"))


def clean_sample_id(c):
    """A sample's name from a result file's."""
    return F.regexp_replace(F.regexp_replace(c, r"\.(rds|parquet)$", ""), r"(_chromoanagenesis|_result)+$", "")


def write_cache(df: DataFrame, path: str, batch: int | None = None) -> None:
    """Appends results by sample; what is written later replaces a sample's earlier rows when read.

    A batch is a folder of as many files as df has tasks, so their number doesn't grow with the samples.
    """
    df.withColumn("_batch", F.lit(time.time_ns() if batch is None else batch)).write.mode("append").partitionBy("_batch").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Each sample's rows of its last batch."""
    df = spark.read.parquet(path)
    last = df.groupBy("sample_id").agg(F.max("_batch").alias("_batch"))
    return df.join(last, ["sample_id", "_batch"], "left_semi").drop("_batch")


def not_cached(sheet: DataFrame, cache: DataFrame) -> DataFrame:
    """Samples of the sheet without a cached result."""
    return sheet.join(cache.select(F.col("sample_id").cast("string").alias("sample_id")).distinct(), "sample_id", "left_anti")


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A text table with a header; arrays are joined by commas."""
    flat = df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)
