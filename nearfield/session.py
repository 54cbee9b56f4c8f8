"""Session helpers: where cut lineage and intermediate tables are written, and how many partitions a job gets."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def work_root(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A temporary one only in local mode, where that is unset; on a cluster it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
        elif re.fullmatch(r"local(\[[\d*,]+\])?", spark.sparkContext.master):
            root = tempfile.mkdtemp(prefix="nearfield-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: it cuts lineage, and survives the loss of executors.

    The files go when release is called, or when the program ends.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/nearfield/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialised DataFrame that nothing reads any more."""
    path = getattr(df, "_written_to", None)
    if path in _written:
        _delete(_written.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for path, spark in list(_written.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: nothing more can be done from here
            return


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
