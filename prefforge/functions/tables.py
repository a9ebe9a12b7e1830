"""Shared tables: written to a folder that every executor sees, so that lost executors cost no recomputation."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Paths and tables that this process has written and not yet deleted.
_WRITTEN: list[str] = []
_TABLES: list[str] = []
#: Bytes of one Arrow batch sent to Python, so that very long texts do not pile up in one batch.
ARROW_BYTES = 4 << 20
try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries do not have it
except (OSError, AttributeError):
    _LIBC = None


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and all runs in one JVM (tests, a laptop) a temporary one
    is set; on a cluster the executors could not read it, so that raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_dir.isDefined():
            return set_dir.get()
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = "file://" + tempfile.mkdtemp(prefix="prefforge-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return folder


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: the lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like shared_table, but dealt by a key: later joins and groupings by it find the rows in place. Only the catalog's entry is
    the warehouse's, the files lie in the shared folder; a row's files are those of one task, so there are as many as buckets."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"prefforge_{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/tables/{table_name}"
    _TABLES.append(table_name)
    _WRITTEN.append(path)
    df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table_name)
    return spark.table(table_name)


def clean_shared(spark: SparkSession) -> int:
    """Delete the shared tables of this process, and tell how many there were. Results that read them must have been written
    before; they are kept until then, since a lost executor's part is read again."""
    n = len(_WRITTEN)
    while _TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop()}")
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def bounded_batches(spark: SparkSession, n_bytes: int = ARROW_BYTES) -> None:
    """Limit Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(n_bytes))


def release_memory() -> None:
    """Give what this Python worker has freed back to the system: workers serve many tasks, and what Arrow and the C library
    keep for later adds up to hundreds of megabytes in each."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def releasing(run: Callable) -> Callable:
    """A function of Arrow batches that gives freed memory back before its task and behind it."""

    def wrapped(batches):
        release_memory()
        yield from run(batches)
        release_memory()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def number_rows(df: DataFrame, order: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """(df with its place `at` from 0 by the order of a unique column, number of rows): sorted by ranges, numbered within
    each, and shifted by the sizes of the ranges before. The driver sees one count of each range."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    ranged = shared_table(ranged.withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id").bitwiseAND((1 << 33) - 1)), "numbered")
    total, base = 0, []
    for p, n in sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect()):
        base.append((p, total))
        total += n
    bases = spark.createDataFrame(base or [(0, 0)], "_p long, _b long")
    return ranged.join(F.broadcast(bases), "_p").withColumn("at", F.col("_b") + F.col("_i")).drop("_id", "_p", "_i", "_b"), total


def running(df: DataFrame, order: str, value: str, name: str, how: str = "sum") -> DataFrame:
    """df with the sum (of no rows: 0) or the largest (of no rows: null) of `value` over all rows before it by a unique
    column: formed within ranges of the order and joined with what the ranges before give. The driver sees one value of
    each range, and no task more than a range."""
    spark = df.sparkSession
    add = {"sum": F.sum, "max": F.max}[how]
    ranged = shared_table(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()), "ranged")
    made = sorted((r["_p"], r["n"]) for r in ranged.groupBy("_p").agg(add(value).alias("n")).collect())
    kind = ranged.groupBy().agg(add(value).alias("n")).schema["n"].dataType.simpleString()
    zero = 0.0 if kind == "double" else 0
    total, base = (zero if how == "sum" else None), []
    for p, n in made:
        base.append((p, total))
        if n is not None:
            total = n if total is None else total + n if how == "sum" else max(total, n)
    bases = spark.createDataFrame(base, f"_p int, _b {kind}")
    inside = add(value).over(Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    both = F.coalesce("_s", F.lit(zero)) + F.coalesce("_b", F.lit(zero)) if how == "sum" else F.greatest("_s", "_b")
    return ranged.withColumn("_s", inside).join(F.broadcast(bases), "_p").withColumn(name, both).drop("_p", "_b", "_s")


def prefix_sums(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """df with the sum of `value` over all rows before it by a unique column."""
    return running(df, order, value, name)
