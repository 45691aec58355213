"""What the operators of this subpackage share: tables in the cluster's shared
folder and the reading of the standard input tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes of an Arrow batch at most: whole texts of any length pass through, a few at a time.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20
#: Bytes of input, as they lie on disk, of one range of a table that is dealt out by ranges.
RANGE_BYTES = 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches at ``BATCH_ROWS`` rows and about ``BATCH_BYTES``, on both sides of a
    worker's pipe. Plans are run after this returns, so the session keeps the setting."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(str(spark.conf.get(name)).removesuffix("B").removesuffix("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own; a
    cluster session is refused, since a machine-local folder would lose data.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    if not hasattr(spark, "_quarry_shared"):  # the setting itself can't be changed at run time
        spark._quarry_shared = f"file://{tempfile.mkdtemp(prefix='quarry-')}"
    return spark._quarry_shared


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives
    the loss of any executor."""
    bounded_batches(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more; other tables are left alone."""
    for table in (t for t in tables if hasattr(t, "_quarry_path")):
        path = spark._jvm.org.apache.hadoop.fs.Path(table._quarry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def reshuffled(rows: DataFrame, key: str) -> DataFrame:
    """An aggregate over ``key`` (a long), to be joined on it, with a shuffle of its own.

    Spark joins an aggregate where its groups already lie, and then it can't split the hot
    keys of the other side. Dealt out by another hash first, both sides of the join are plain
    shuffles, whose skewed partitions adaptive execution splits."""
    held = f"__{key}"
    moved = rows.withColumnRenamed(key, held).withColumn(key, F.bitwise_not(F.bitwise_not(F.col(held))))
    return moved.drop(held)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranges(spark: SparkSession, rows: DataFrame) -> int:
    """Into how many ranges a table is dealt: as many as shuffles have partitions, or more where the plan's
    statistics say that it is large."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # Spark's mark of a size that it doesn't know is larger
    return max(shuffle_partitions(spark), -(-known // RANGE_BYTES))


#: What a worker keeps from task to task, by the name of its user.
kept: dict = {}


def slices(batches, rows: int = 256, size: int = 2 << 20, keep: str | None = None):
    """Arrow batches in parts of at most so many rows and, by their mean size, bytes, to keep few Python objects
    at a time. Workers live on after their tasks: what other users have kept goes at the start of a task (of one
    that keeps ``"*"`` nothing goes), and freed memory goes back to the system at its end."""
    for name in [n for n in kept if keep not in (n, "*")]:
        del kept[name]
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch  # not held while the next one is read
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
