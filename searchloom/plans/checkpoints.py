"""Written tables that cut a plan's lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_root: str | None = None


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared checkpoint folder, deleted when the driver's JVM
    ends. A folder of this machine only for a local master without that setting."""
    global _root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _root is None:
            _root = tempfile.mkdtemp(prefix="searchloom-tables-")
            atexit.register(shutil.rmtree, _root, True)
        root = _root
    path = f"{root.rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named_files(spark: SparkSession, folder: str, name) -> None:
    """Renames the data files of a folder: ``name(value, number)``, where value is
    that of the partition folder a file is in, or empty. Files move to the folder itself."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listing = [], files.listFiles(top, True)
    while listing.hasNext():
        path = listing.next().getPath()
        if path.getName().startswith("part-"):
            parent = path.getParent().getName()
            found.append((parent.split("=", 1)[1] if "=" in parent else "", path))
    for number, (value, path) in enumerate(sorted(found, key=lambda x: (x[0], x[1].getName()))):
        files.rename(path, jvm.org.apache.hadoop.fs.Path(top, name(value, number)))
