"""Session helpers: tables, shared folders for intermediate results, lineage cuts."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder is given, a local master gets a folder of the machine's own; on a
    cluster, where executors would each write to their own disk, this raises ``ValueError``.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="caseweave-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def _tables_folder(spark: SparkSession) -> str:
    """Where this application's tables go; deleted when the application ends."""
    folder = f"{shared_folder(spark)}/caseweave-{spark.sparkContext.applicationId}"
    if folder not in _registered:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _registered.add(folder)
    return folder


_registered: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    The files outlive an executor, the lineage ends, and the plan gets true sizes: a checkpoint would keep the size
    estimate of the plan it cuts, which in a loop of joins multiplies itself without bound. ``release`` deletes the files
    as soon as nothing reads them; what a result still reads goes with the application or by ``release_all``.
    """
    spark = df.sparkSession
    path = f"{_tables_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._caseweave_path = path  # type: ignore[attr-defined]
    return out


def there(df: DataFrame) -> bool:
    """Whether the files of a frame made by ``cut`` still exist."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._caseweave_path)  # type: ignore[attr-defined]
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def release_all(spark: SparkSession) -> None:
    """Delete all tables of this application; frames made from them can no longer be read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_folder(spark))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(path, True)
    files.mkdirs(path)


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by ``cut`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._caseweave_path)  # type: ignore[attr-defined]
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Let go of the shuffle files that no frame can read any more, which otherwise stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()
