"""Session settings and the shared scratch folder that cuts long lineages."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []
_scopes: list[list[DataFrame]] = []
#: Codec of scratch tables. Its buffers are of a fixed size on the heap; snappy's are as large as a page, outside the heap, and a
#: page of long texts is large.
_CODEC = "zstd"


def session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("karyoflux")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where that setting is absent and the master is local (tests on one machine) a temporary folder is made; it goes at exit.
    On a cluster a machine's own folder would hide each executor's files from the others, so there the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="karyoflux-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


@contextlib.contextmanager
def collected(tables: list[DataFrame]) -> Iterator[None]:
    """Adds to tables what materialize writes inside it, but for tables written with keep."""
    _scopes.append(tables)
    try:
        yield
    finally:
        _scopes.pop()


@contextlib.contextmanager
def cleaned() -> Iterator[None]:
    """Deletes at its end what materialize wrote inside it, but for tables written with keep."""
    tables: list[DataFrame] = []
    try:
        with collected(tables):
            yield
    finally:
        for df in tables:
            discard(df)


def materialize(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The written files cut the lineage, survive lost executors and fix what is nondeterministic (row ids). With by, the table is
    bucketed by that column: each task writes its rows where they are, and a later join on the column leaves the table unmoved.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    if by is None:
        df.write.parquet(path, compression=_CODEC)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        out = _bucketed(df, path, by)
    out._scratch_path = path
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(out)
    return out


def _bucketed(df: DataFrame, path: str, by: str) -> DataFrame:
    """Buckets exist for catalog tables only, so one is named while it is written and resolved, and its files outlive the name."""
    spark, writers = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    name = f"karyoflux_{uuid.uuid4().hex}"
    before = spark.conf.get(writers)
    spark.conf.set(writers, str(max(int(before), 64)))  # several open files in place of a sort of the rows by bucket
    try:
        df.write.options(path=path, compression=_CODEC).bucketBy(_buckets(df), by).saveAsTable(name, format="parquet")
    finally:
        spark.conf.set(writers, before)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _buckets(df: DataFrame) -> int:
    """As many as shuffle partitions, or as scans of df's inputs of known size would have tasks where that is more."""
    conf = df.sparkSession.conf
    split = df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get("spark.sql.files.maxPartitionBytes"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    known = sum(n for n in sizes if n < 1 << 55)  # Spark takes tables of unknown size for exabytes
    return min(100_000, max(int(conf.get("spark.sql.shuffle.partitions")), known // split))


def discard(df: DataFrame, spark: SparkSession | None = None) -> None:
    """Delete what materialize wrote for df, once nothing will read it again; spark: where df's own session may have ended."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = spark or df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
