"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import time
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Where the tables lie that cut() wrote.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def folder(spark: SparkSession) -> str:
    """The folder that all executors share. It is the cluster's; only where it names none (tests) a local one is made."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster has to name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="sigloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to a table in the shared folder, so that a lost executor costs no recomputation of what led to
    them and iterations do not grow the plan. Written as Parquet, which takes a fraction of the room of a checkpoint. The
    tables go when they are discarded, at the latest when the driver ends."""
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


#: How many times the bytes of its file a table of ids and repeated words may take as rows, less what the threshold of broadcasts leaves room for.
DENSE = 20


def cut_dense(df: DataFrame) -> DataFrame:
    """cut() for rows that Parquet makes very small: ids, places, words that come again and again. Spark takes the bytes of a file
    for those of its rows, and would gather tables of millions of rows in the driver to broadcast them. The session is told that
    rows take DENSE times their file, unless it was told something itself; tables that are small as rows are broadcast as before."""
    if float(df.sparkSession.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        df.sparkSession.conf.set("spark.sql.sources.fileCompressionFactor", str(DENSE))
    return cut(df)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has no more than `most` rows, which is looked at first."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def discard(df: DataFrame) -> None:
    """Removes the table that cut() wrote for df; plans that read it can run no more. Other DataFrames are left alone."""
    if path := _PATHS.pop(df, None):
        _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended, and its folder with it
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of plans that nothing refers to any more. It does so when the driver's garbage is
    collected; the first collection only finds them."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
