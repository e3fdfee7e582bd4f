"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\r\n\f\v"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def clean_path(c: Column | str) -> Column:
    """Canonical spelling of an id or path: `/` as separator and no blanks around it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(F.translate(c, "\\", "/"), F.lit(BLANKS))
