"""Shared working folder for tables that cut lineage, and other session helpers.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) a
temporary folder is made and set, and on a cluster without that setting there is an error.  Every executor must be able to reach it, so an executor that is lost takes no
written table with it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """URI or path of the folder shared by all executors."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    told = told or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        told = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path for a table of this session below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no plan reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clean() -> None:
    """Removes the written tables of this driver; DataFrames that read them can't be used any more."""
    while _made:
        spark, path = _made.pop()
        try:
            remove(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(clean)


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table behind a DataFrame of ``materialise`` that no plan needs any more."""
    path = _paths.pop(df, None)
    if path:
        remove(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Lets the driver drop what no DataFrame refers to any more, so that shuffle files of finished steps are removed.

    Spark removes them when the driver's JVM happens to collect its garbage; an iterative job on a large heap would keep
    the files of all of its rounds.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
