"""References to records that do not exist (problem 5).

Parents (nodes) and children (the two ends of every edge) are united in one long form and grouped by key.  A group is
kept when it lacks a parent, or when no single life of the parent spans all its references; its edges are then judged
one by one against the lives of the key, and the cases are summed by period.  Counting is partial before the shuffle,
so a key that holds a third of all references costs one row per task; the kept keys are unique on their side of the
second join, which adaptive execution may therefore split or broadcast by its measured size.

Defined results: null references are no cases; ``unresolved = true`` excuses ``to_id`` only; an edge without created_at
is a case only when its key has no row at all; repeated rows count once; empty nodes make every reference missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.tables import clean_path


def references(edges: DataFrame) -> DataFrame:
    """The long form of the child side: (edge_id, edge_type, side, key, ts)."""
    ends = F.array(
        F.struct(F.lit("from").alias("side"), clean_path("from_id").alias("key")),
        F.struct(F.lit("to").alias("side"), F.when(~F.coalesce(F.col("unresolved"), F.lit(False)), clean_path("to_id")).alias("key")),
    )
    return (
        edges.select(clean_path("id").alias("edge_id"), F.col("type").alias("edge_type"), F.col("created_at").alias("ts"), F.explode(ends).alias("e"))
        .select("edge_id", "edge_type", "ts", "e.side", "e.key")
        .where("key IS NOT NULL")
    )


def suspects(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """(key, lives): keys whose references are not all inside one life of the parent; lives is empty without a parent."""
    life = F.struct(F.col("created_at").alias("born"), F.col("deleted_at").alias("died"))
    parents = nodes.where("id IS NOT NULL").select(clean_path("id").alias("key"), life.alias("life"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("child"))
    children = refs.select("key", F.lit(None).cast("struct<born:timestamp_ntz,died:timestamp_ntz>").alias("life"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(1).alias("child"))
    groups = parents.unionByName(children).groupBy("key").agg(
        F.collect_set("life").alias("lives"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("child").alias("refs"), F.count("ts").alias("dated")
    )
    spans = F.exists("lives", lambda x: (x["born"] <= F.col("first")) & (x["died"].isNull() | (x["died"] > F.col("last"))))
    fine = F.coalesce(spans, F.lit(False)) & (F.col("refs") == F.col("dated"))
    return groups.where((F.col("refs") > 0) & ~fine).select("key", "lives")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(edge_id, edge_type, side, ts, reason), one row per orphan reference."""
    refs = references(edges)
    judged = refs.join(suspects(nodes, refs), "key")
    alive = F.exists("lives", lambda x: (x["born"] <= F.col("ts")) & (x["died"].isNull() | (x["died"] > F.col("ts"))))
    later = F.exists("lives", lambda x: x["born"] > F.col("ts"))
    reason = (
        F.when(F.size("lives") == 0, "missing")
        .when(F.col("ts").isNull() | alive, None)
        .when(later, "late")
        .otherwise("deleted")
    )
    return judged.select("edge_id", "edge_type", "side", "ts", reason.alias("reason")).where("reason IS NOT NULL").distinct()


def orphan_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cases per edge type, month of created_at, side and reason."""
    return (
        orphans(edges, nodes)
        .groupBy("edge_type", F.date_format("ts", "yyyy-MM").alias("month"), "side", "reason")
        .agg(F.count(F.lit(1)).alias("cases"))
    )
