"""Source files as a DataFrame: discovery, routing by extension, changes between commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import language

# Folders that hold no sources, and the patterns read by default.
EXCLUDED = "node_modules .git .svn dist build out bin obj .next .nuxt .angular coverage __pycache__ .venv venv .tox target .cache".split()
PATTERNS = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx", "**/*.cs", "**/*.md")


def extensions(patterns: tuple[str, ...]) -> list[str]:
    """Extensions of glob patterns; the folder part of a pattern does not count."""
    return sorted({p.rpartition(".")[2].lower() for p in patterns if "." in p.rpartition("/")[2]})


def listed(spark: SparkSession, root: str, patterns: tuple[str, ...] = PATTERNS, explicit: list[str] | None = None, exclude: str | None = None) -> DataFrame:
    """(file_path, language, content) of the files below root, read and filtered by Spark.

    ``explicit`` limits the files to a list of relative paths, ``exclude`` is a regular expression on the relative path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/") + "/"
    relative = F.substring_index(F.regexp_replace("path", r"^\w+:/*", "/"), base, -1)
    rows = files.select(relative.alias("file_path"), "content")
    rows = rows.where(F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1)).isin(*extensions(patterns)))
    rows = rows.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, EXCLUDED))))
    if explicit is not None:
        rows = rows.where(F.col("file_path").isin(*explicit))
    if exclude:
        rows = rows.where(~F.col("file_path").rlike(exclude))
    return rows.select("file_path", language("file_path").alias("language"), F.decode("content", "UTF-8").alias("content"))


def one(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(file_path, language, content) of one file below root."""
    found = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}")
    return found.select(F.lit(path).alias("file_path"), language(F.lit(path)).alias("language"), F.decode("content", "UTF-8").alias("content"))


def raw_files(files: DataFrame, repo: str, run_id: str) -> DataFrame:
    """Files as RawNode rows of one run."""
    return files.select(
        F.lit(run_id).alias("run_id"), F.lit("file").alias("type"), F.substring_index("file_path", "/", -1).alias("name"), "language", "file_path", F.lit(repo).alias("repo"),
        F.struct(F.lit(1).alias("start"), F.size(F.split("content", "\n")).alias("end")).alias("line_range"), F.lit(None).cast("string").alias("signature"), F.col("content").alias("code_snippet"),
        F.create_map().cast("map<string,string>").alias("extra"), F.current_timestamp().cast("timestamp_ntz").alias("extracted_at"),
    )


def changes(lines: DataFrame) -> DataFrame:
    """(status, path, old_path) of the lines of a name-status diff: A, M, D, R (from old_path), C counts as A; others are ignored."""
    f = F.split("value", "\t")
    letter = F.substring(F.get(f, F.lit(0)), 1, 1)
    two = letter.isin("R", "C")
    return lines.where(letter.isin("A", "M", "D", "R", "C")).select(
        F.when(letter == "C", "A").otherwise(letter).alias("status"), F.when(two, F.get(f, F.lit(2))).otherwise(F.get(f, F.lit(1))).alias("path"), F.when(letter == "R", F.get(f, F.lit(1))).alias("old_path")
    )
