"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import packing, pii, provenance, secrets, tokenizer
from graphloom.llm.syntax import operator as syntax
from graphloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "raw_nodes"))


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.all_errors(table(spark, d, "raw_nodes"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "raw_nodes"))


def p2_against_reports(spark: SparkSession, d: str) -> DataFrame:
    return syntax.against_reports(table(spark, d, "raw_nodes"), table(spark, d, "pipeline_runs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.found(table(spark, d, "nodes"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redacted(table(spark, d, "nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.found(table(spark, d, "nodes"), table(spark, d, "third_party"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return provenance.rates(table(spark, d, "nodes"), table(spark, d, "third_party"))


def p4_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """What remains: source files labelled as written by hand, with the probability of that."""
    return provenance.labelled(table(spark, d, "nodes"), table(spark, d, "third_party")).where(F.col("label") == provenance.LABELS[0]).select("id", "repo", "path", "probability").distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(table(spark, d, "documents"))


def p6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Texts, characters and tokens by source."""
    docs = table(spark, d, "documents")
    return (
        tokenizer.encoded(docs.select("doc_id", "text"), counts_only=True)
        .join(docs.select("doc_id", "source", F.length("text").alias("chars")), "doc_id")
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars"), F.sum("n_tokens").alias("tokens"))
    )


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), table(spark, d, "given_names"))


# ---- properties that hold for every row, so that SQL can check the work on whole tables
def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that were parsed, by language."""
    return syntax.rates(table(spark, d, "raw_nodes")).groupBy("language").agg(F.sum("files").alias("files"), F.max((F.col("invalid") <= F.col("files")).cast("int")).alias("sound"))


def p3_shape(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a snippet, by type, and whether blanking kept the length and the lines of each."""
    nodes = table(spark, d, "nodes").where("code_snippet IS NOT NULL AND coalesce(type, '') NOT IN ('section', 'document')")
    out = secrets.judged(nodes.withColumn("id", F.concat_ws("|", F.coalesce("type", F.lit("")), F.length("code_snippet"), F.length(F.regexp_replace("code_snippet", "[^\n]", "")))), secrets.train(nodes), True)
    part = F.split("id", r"\|")
    kept = (F.length("redacted") == F.get(part, F.lit(1)).cast("int")) & (F.length(F.regexp_replace("redacted", "[^\n]", "")) == F.get(part, F.lit(2)).cast("int"))
    return out.groupBy(F.get(part, F.lit(0)).alias("type")).agg(F.count(F.lit(1)).alias("snippets"), F.min(kept.cast("int")).alias("kept"))


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Source files that have a label, by repo."""
    return provenance.labelled(table(spark, d, "nodes"), table(spark, d, "third_party")).groupBy("repo").agg(F.count_distinct("id").alias("files"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Does every text come back from its ids?"""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tokenizer.decoded(tokenizer.encoded(docs)).join(docs, "doc_id").select("doc_id", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """By container type: texts, whether all fit, whether only texts above the capacity are split, and whether no token is lost."""
    docs, kinds = table(spark, d, "documents"), table(spark, d, "containers").select("container_type", "capacity_tokens").distinct()
    placed = packing.pack(docs, table(spark, d, "containers")).join(kinds, "container_type")
    fits = placed.groupBy("container_type", "container_no").agg((F.sum("n_tokens") <= F.max("capacity_tokens")).alias("fits")).groupBy("container_type").agg(F.min(F.col("fits").cast("int")).alias("fits"))
    texts = placed.groupBy("container_type", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max("capacity_tokens").alias("c"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("parts") == F.greatest(F.ceil(F.col("n") / F.col("c")), F.lit(1))) & (F.col("end") == F.col("n"))
    return texts.groupBy("container_type").agg(F.count(F.lit(1)).alias("texts"), F.min(whole.cast("int")).alias("whole")).join(fits, "container_type")


def p8_shape(spark: SparkSession, d: str) -> DataFrame:
    """Texts by source, and whether each comes back when its placeholders are filled with what was found."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    out = pii.judged(docs.select("doc_id", "text"), pii.train(docs, table(spark, d, "given_names")), True)
    taken = F.aggregate("entities", F.lit(0), lambda n, e: n + F.length(e.found_text))
    holders = F.aggregate("entities", F.lit(0), lambda n, e: n + F.length(e.kind) + 2)
    inside = F.forall("entities", lambda e: F.substring(F.col("text"), e.start + 1, F.length(e.found_text)) == e.found_text)
    sound = F.when(F.col("text").isNull(), F.col("redacted").isNull()).otherwise((F.length("redacted") == F.length("text") - taken + holders) & inside)
    return out.join(docs, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.min(sound.cast("int")).alias("sound"))


QUERIES = {
    "p2_found": p2_found,
    "p2_errors": p2_errors,
    "p2_rates": p2_rates,
    "p2_against_reports": p2_against_reports,
    "p2_files": p2_files,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_shape": p3_shape,
    "p4_found": p4_found,
    "p4_rates": p4_rates,
    "p4_handwritten": p4_handwritten,
    "p4_files": p4_files,
    "p6_ids": p6_ids,
    "p6_token_counts": p6_token_counts,
    "p6_round_trip": p6_round_trip,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_whole": p7_whole,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
    "p8_shape": p8_shape,
}

CLEAN = "trim(replace({0}, '\\', '/'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
EXT = "lower(regexp_extract(" + CLEAN.format("file_path") + ", '\\.(\\w+)$', 1))"

ORACLE: dict[str, str] = {
    "p2_files": f"""SELECT language, count(*) AS files, 1 AS sound FROM (SELECT DISTINCT run_id, repo, {CLEAN.format('file_path')} AS p,
  CASE {EXT} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'cs' THEN 'csharp' WHEN 'go' THEN 'go' WHEN 'json' THEN 'json' END AS language
  FROM raw_nodes WHERE type = 'file' AND code_snippet IS NOT NULL) WHERE language IS NOT NULL GROUP BY language""",
    "p3_shape": "SELECT coalesce(type, '') AS type, count(*) AS snippets, 1 AS kept FROM nodes WHERE code_snippet IS NOT NULL AND coalesce(type, '') NOT IN ('section', 'document') GROUP BY 1",
    "p4_files": f"SELECT coalesce(repo, '') AS repo, count(DISTINCT {CLEAN.format('id')}) AS files FROM nodes WHERE type = 'file' AND {EXT} NOT IN ('json', 'yaml', 'yml', 'properties', 'env', 'toml', 'ini') GROUP BY 1",
    "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    "p7_whole": "SELECT container_type, (SELECT count(*) FROM documents) AS texts, 1 AS whole, 1 AS fits FROM (SELECT DISTINCT container_type FROM containers WHERE container_type IS NOT NULL AND capacity_tokens > 0)",
    "p8_shape": "SELECT source, count(*) AS texts, 1 AS sound FROM documents GROUP BY source",
}
