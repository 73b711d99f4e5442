"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The six white space characters of the word rule ``[^\x20\x09-\x0D]+``; they are also those of ``bytes.split()``.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every ASCII character but letters and digits into a space.
ALNUM_TABLE = bytes(
    ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256)
)
_SPACE_RE = re.compile(rb"[ \t-\r]")
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one of
    this driver where the setting is absent and the master is local."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="searchloom-")
        atexit.register(shutil.rmtree, _local_root, True)
    return _local_root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/searchloom/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts the
    lineage, and survives the loss of executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`stage` made and nothing reads any more."""
    context = df.sparkSession.sparkContext
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        target = context._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, by position, so that other columns
    whose names differ only in case (or are repeated) do no harm."""
    at = [df.columns.index(name) for name in names]
    flat = numbered(df)
    return flat.select(*[F.col(f"_{i}").alias(name) for i, name in zip(at, names, strict=True)])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named ``_0``, ``_1`` ... by position: no name can clash."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of ``[^\x20\x09-\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def word_blocks(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text in lists of about ``size`` bytes, so that a very long
    text never stands in memory as one list."""
    if len(data) <= size:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = _SPACE_RE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


def running_totals(rows: DataFrame, order: list, value: str, name: str, by: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row in an order, or
    within each ``by`` of it (which then comes first in the order, without
    nulls). A range sort deals the rows, so no task holds more than its share;
    the sorted rows are a written table, and what goes between its parts is one
    sum a part (and ``by``)."""
    placed = rows.orderBy(*order).withColumn("_part", F.spark_partition_id())
    placed = stage(placed.withColumn("_place", F.monotonically_increasing_id()), "ordered")
    keys = ["_part", by] if by else ["_part"]
    sums = placed.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    across = (W.partitionBy(by) if by else W).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys).orderBy("_place").rowsBetween(W.unboundedPreceding, 0)
    totals = placed.withColumn("_inside", F.sum(value).over(inside)).join(sums, keys)
    return totals.withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_place", "_before", "_inside")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
