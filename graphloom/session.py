"""Session helpers shared by every operator."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Where the session names none: a private folder in local mode, a folder of the user on the default file system of a
    cluster; a cluster whose default file system is that of each machine has to name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc._jsc.sc().getCheckpointDir().isEmpty():
        return str(sc._jsc.sc().getCheckpointDir().get())
    if named is None:
        if re.match(r"local(\[|$)", sc.master):
            named = tempfile.mkdtemp(prefix="spark-")
        else:
            fs = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
            if fs.getUri().getScheme() == "file":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = f"{fs.getHomeDirectory()}/.checkpoints/{sc.applicationId}"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that later stages neither recompute it nor lose it with an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a CPU-heavy Python stage work for every core.

    For plans without an exchange, that is scans with filters and projections: their splits are known before anything
    runs.  Large inputs already have more splits than cores and pass unchanged; only an input of few splits is dealt
    out again, so the extra exchange never grows beyond a few splits per core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores * per_core:
        return df
    return df.repartition(cores * per_core)
