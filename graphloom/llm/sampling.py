"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def bounded(rows: DataFrame, usable: str, key: Column, columns: list[Column], size: int) -> list[Row]:
    """At most ``size`` usable rows, those with the smallest hash of key.

    The rows are first thinned by the hash to a quarter more than the wanted number, so that what reaches the driver stays
    the same however many rows and partitions there are.  The number of rows is counted before the condition on their
    texts, so that only one scan reads these; where many rows are not usable, the sample is smaller.
    """
    total = rows.count()
    if not total:
        return []
    scale = 1 << 30
    keep = min(scale, int(scale * 1.25 * size / total) + 1)
    h = F.pmod(F.xxhash64(key), F.lit(scale))
    return rows.where(usable).withColumn("__h", h).where(F.col("__h") < keep).select(*columns, "__h").orderBy("__h").limit(size).collect()
