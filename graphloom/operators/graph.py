"""The property graph as two DataFrames, and its one-hop reads and aggregations.

nodes: one row per id, the latest life.  edges: one row per (src, type, dst), the first one written (its weight wins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.tables import clean_path

NODE_COLUMNS = (
    "type name repo language file_path line_range signature signature_hash file_hash code_snippet summary tags complexity layer first_seen_commit last_seen_commit created_at updated_at deleted_at".split()
)
DOC_TYPES = ("document", "section")


def nodes_view(nodes: DataFrame, *columns: str) -> DataFrame:
    """Latest life of every id with the wanted columns; empty layers and summaries are null."""
    keep = list(columns) or NODE_COLUMNS
    value = {c: F.col(c) for c in keep}
    for c in ("layer", "summary"):
        if c in value:
            value[c] = F.nullif(F.trim(c), F.lit(""))
    if "file_path" in value:
        value["file_path"] = clean_path("file_path")
    rows = nodes.where("id IS NOT NULL").select(clean_path("id").alias("id"), F.struct(*[v.alias(c) for c, v in value.items()]).alias("v"), F.col("created_at").alias("born"))
    return rows.groupBy("id").agg(F.max_by("v", F.struct("born", F.xxhash64("v"))).alias("v")).select("id", "v.*")


def edges_view(edges: DataFrame) -> DataFrame:
    """(src, dst, type, weight, unresolved, created_at): first-written edge of every key with both ends named."""
    first = F.struct("created_at", clean_path("id").alias("id"), "weight", F.coalesce("unresolved", F.lit(False)).alias("unresolved"))
    return (
        edges.where("from_id IS NOT NULL AND to_id IS NOT NULL")
        .select(clean_path("from_id").alias("src"), clean_path("to_id").alias("dst"), "type", first.alias("f"))
        .groupBy("src", "dst", "type")
        .agg(F.min("f").alias("f"))
        .select("src", "dst", "type", "f.weight", "f.unresolved", "f.created_at")
    )


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where("deleted_at IS NULL")


def optional(column: str, values: Sequence[str] | None) -> Column:
    """A predicate that holds for everything when no values are given; nulls never match values."""
    return F.lit(True) if values is None else F.col(column).isin(*values)


def select_nodes(nodes: DataFrame, repos=None, types=None, layers=None) -> DataFrame:
    return nodes.where(optional("repo", repos) & optional("type", types) & optional("layer", layers))


def test_path(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return low.contains("test") | low.contains("spec") | low.contains("__tests__")


def test_path_words(path: Column) -> Column:
    """The same question as a pattern, without regard to case."""
    return F.coalesce(path, F.lit("")).rlike("(?i)test|spec|__tests__")


# ---- one hop
def neighbours(edges: DataFrame, nodes: DataFrame, of: DataFrame, edge_types=None, min_weight: float | None = None, most: int | None = None) -> DataFrame:
    """(id, neighbour, edge_type, weight, type, name) in both directions of the ids in ``of``; a self-loop comes once.

    Missing and zero weights count as 1.0.  With ``most``, the first neighbours of an id by edge type, name and id.
    """
    weight = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    e = edges.where(optional("type", edge_types))
    if min_weight:
        e = e.where(F.col("weight") >= min_weight)
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"), F.col("type").alias("edge_type"), weight.alias("weight")).unionByName(
        e.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("neighbour"), F.col("type").alias("edge_type"), weight.alias("weight"))
    )
    out = both.join(of.select("id").distinct(), "id", "left_semi").join(nodes.select(F.col("id").alias("neighbour"), "type", "name"), "neighbour")
    out = out.select("id", "neighbour", "edge_type", "weight", "type", "name")
    if most is None:
        return out
    w = Window.partitionBy("id").orderBy("edge_type", "name", "neighbour", F.desc("weight"))
    return out.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def sources_of(edges: DataFrame, nodes: DataFrame, types: Sequence[str], min_weight: float | None = None, only_live: bool = False) -> DataFrame:
    """(target, id, type, name, layer, edge_type, score): nodes with an edge of the types into a target."""
    e = edges.where(F.col("type").isin(*types))
    if min_weight is not None:
        e = e.where(F.col("weight") >= min_weight)
    n = live(nodes) if only_live else nodes
    return e.select(F.col("src").alias("id"), F.col("dst").alias("target"), F.col("type").alias("edge_type"), F.col("weight").alias("score")).join(
        n.select("id", "type", "name", "layer"), "id"
    ).select("target", "id", "type", "name", "layer", "edge_type", "score")


def targets_of(edges: DataFrame, nodes: DataFrame, types: Sequence[str], min_weight: float | None = None) -> DataFrame:
    """(section, id, type, name, layer, edge_type, score): live nodes that a section has an edge of the types to."""
    e = edges.where(F.col("type").isin(*types))
    if min_weight is not None:
        e = e.where(F.col("weight") >= min_weight)
    return e.select(F.col("dst").alias("id"), F.col("src").alias("section"), F.col("type").alias("edge_type"), F.col("weight").alias("score")).join(
        live(nodes).select("id", "type", "name", "layer"), "id"
    ).select("section", "id", "type", "name", "layer", "edge_type", "score")


def intra_repo_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, repo, from_layer, to_layer): CALLS between live nodes of one repo."""
    n = live(nodes)
    a = n.select(F.col("id").alias("src"), F.col("repo"), F.col("layer").alias("from_layer"))
    b = n.select(F.col("id").alias("dst"), F.col("repo").alias("repo2"), F.col("layer").alias("to_layer"))
    return edges.where("type = 'CALLS'").select("src", "dst").join(a, "src").join(b, "dst").where("repo = repo2").drop("repo2")


# ---- aggregations
def degrees(edges: DataFrame, edge_type: str = "CALLS") -> DataFrame:
    """(id, in_degree, out_degree, degree) in one shuffle: each edge gives both its ends a count."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return (
        edges.where(F.col("type") == edge_type)
        .select(F.explode(ends).alias("e"))
        .groupBy("e.id")
        .agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
        .withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    )


def hotspots(edges: DataFrame, nodes: DataFrame, most: int = 15) -> DataFrame:
    """The nodes of most calls of every repo."""
    w = Window.partitionBy("repo").orderBy(F.desc("degree"), "id")
    return (
        live(nodes)
        .where("repo IS NOT NULL")
        .select("id", "type", "name", "repo", "layer", "file_path")
        .join(degrees(edges), "id")
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= most)
    )


def entry_points(edges: DataFrame, nodes: DataFrame, layer: str = "controller", most: int = 10) -> DataFrame:
    """Members of the entry layer by incoming calls, per repo."""
    w = Window.partitionBy("repo").orderBy(F.desc("in_degree"), "id")
    into = edges.where("type = 'CALLS'").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (
        live(nodes)
        .where(F.col("layer") == layer)
        .select("id", "name", "repo")
        .join(into, "id", "left")
        .withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= most)
    )


def layer_flows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return (
        intra_repo_calls(edges, nodes)
        .where("from_layer IS NOT NULL AND to_layer IS NOT NULL AND from_layer <> to_layer")
        .groupBy("repo", "from_layer", "to_layer")
        .agg(F.count(F.lit(1)).alias("edge_count"))
    )


def layers(nodes: DataFrame) -> DataFrame:
    """(id, repo, name, member_count) of the layers of every repo."""
    return (
        live(nodes)
        .where("layer IS NOT NULL")
        .groupBy("repo", F.col("layer").alias("name"))
        .agg(F.count(F.lit(1)).alias("member_count"))
        .select(F.concat_ws(":", F.lit("layer"), "repo", "name").alias("id"), "repo", "name", "member_count")
    )


def projects(repos: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repos with their live nodes and the edges that leave them; the slug falls back to the lower-case name."""
    n = live(nodes).select("id", "repo")
    node_count = n.groupBy("repo").agg(F.count(F.lit(1)).alias("node_count"))
    edge_count = edges.select(F.col("src").alias("id")).join(n, "id").groupBy("repo").agg(F.count(F.lit(1)).alias("edge_count"))
    slug = F.coalesce("slug", F.lower("name"))
    return (
        repos.select("id", slug.alias("slug"), "name", "last_commit_sha", "last_ingest_at")
        .distinct()
        .join(node_count.withColumnRenamed("repo", "slug"), "slug", "left")
        .join(edge_count.withColumnRenamed("repo", "slug"), "slug", "left")
        .select("id", "slug", "name", "last_commit_sha", "last_ingest_at", F.coalesce("node_count", F.lit(0)).alias("node_count"), F.coalesce("edge_count", F.lit(0)).alias("edge_count"))
    )


# ---- shaping
def shaped(nodes: DataFrame, cap: int = 280) -> DataFrame:
    """List shape: long summaries are cut and get an ellipsis; missing tags are an empty list."""
    s = F.coalesce("summary", F.lit(""))
    return nodes.select(
        "id", F.coalesce("type", F.lit("Unknown")).alias("type"), "name", "file_path", F.when(F.length(s) > cap, F.concat(F.substring(s, 1, cap), F.lit("…"))).otherwise(s).alias("summary"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "layer",
    )


# ---- the documented ad-hoc questions
def layer_violations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return intra_repo_calls(edges, nodes).where("from_layer = 'model' AND to_layer IN ('service', 'controller')")


def without_incoming(nodes: DataFrame, edges: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    return nodes.join(edges.where(F.col("type").isin(*edge_types)).select(F.col("dst").alias("id")), "id", "left_anti")


def untested_functions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    picked = live(nodes).where("type = 'function' AND layer IN ('service', 'repository')")
    return without_incoming(picked, edges, ["TESTS"]).select("id", "name", "repo", "layer")


def undocumented_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    picked = live(nodes).where("type = 'class' AND layer IN ('service', 'controller')")
    return without_incoming(picked, edges, ["MENTIONS", "DOCUMENTS"]).select("id", "name", "repo", "layer")


def cross_repo_callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), F.col("repo").alias("caller_repo"), F.col("name").alias("caller"))
    b = nodes.select(F.col("id").alias("dst"), F.col("repo").alias("callee_repo"), F.col("name").alias("callee"))
    return edges.where("type = 'CALLS'").select("src", "dst").join(a, "src").join(b, "dst").where("caller_repo <> callee_repo")


def refactor_risk(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Risk of changing a function or class, from its direct callers, their layers and their tests.

    High: more than five callers, callers in two or more layers, or a caller in the controller layer; Medium: two to
    five callers; Low otherwise; one level lower when every direct caller has a test.
    """
    tested = edges.where("type = 'TESTS'").select(F.col("dst").alias("src"), F.lit(1).alias("tested")).distinct()
    callers = (
        edges.where("type = 'CALLS'")
        .select("src", "dst")
        .join(live(nodes).select(F.col("id").alias("src"), "layer"), "src")
        .join(tested, "src", "left")
        .groupBy(F.col("dst").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("callers"), F.count_distinct("layer").alias("layers"), F.max((F.col("layer") == "controller").cast("int")).alias("c"),
            F.sum(F.coalesce("tested", F.lit(0))).alias("tested"),
        )
    )
    level = F.when((F.col("callers") > 5) | (F.col("layers") >= 2) | (F.coalesce("c", F.lit(0)) == 1), 2).when(F.col("callers") >= 2, 1).otherwise(0)
    lowered = F.greatest(level - F.when((F.col("callers") > 0) & (F.col("tested") == F.col("callers")), 1).otherwise(0), F.lit(0))
    return (
        live(nodes).where("type IN ('function', 'class')").select("id", "repo").join(callers, "id", "left")
        .na.fill(0, ["callers", "layers", "c", "tested"])
        .select("id", "repo", "callers", "layers", F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), lowered.cast("int") + 1).alias("risk"))
    )


def test_gap_priority(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Untested functions: Critical (service function called from a controller), High (repository write), Medium (other repository), Low."""
    from_controller = (
        edges.where("type = 'CALLS'").join(live(nodes).where("layer = 'controller'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(1).alias("c")).distinct()
    )
    gaps = without_incoming(live(nodes).where("type = 'function'").select("id", "name", "repo", "layer"), edges, ["TESTS"]).join(from_controller, "id", "left")
    write = F.col("name").rlike("(?i)^(add|create|insert|update|save|store|delete|remove|upsert|write|publish)")
    priority = (
        F.when((F.col("layer") == "service") & F.col("c").isNotNull(), "Critical")
        .when((F.col("layer") == "repository") & write, "High")
        .when(F.col("layer") == "repository", "Medium")
        .otherwise("Low")
    )
    return gaps.select("id", "repo", "layer", priority.alias("priority"))


def architecture_overview(nodes: DataFrame, most: int = 3) -> DataFrame:
    """The largest layers of every repo with their numbers of classes and functions."""
    w = Window.partitionBy("repo").orderBy(F.desc("members"), "layer")
    return (
        live(nodes).where("layer IS NOT NULL").groupBy("repo", "layer")
        .agg(F.count(F.lit(1)).alias("members"), F.count_if(F.col("type") == "class").alias("classes"), F.count_if(F.col("type") == "function").alias("functions"))
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    )
