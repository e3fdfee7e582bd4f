"""Keeping the graph current: normalisation, keyed upserts, soft deletes, purges, diffs.

Plain Parquet has no MERGE: an upsert is one full outer join of the old rows with the new ones by key, and the result is
written as a new generation (sources.generations).  All functions are lazy and take the time as an argument, so that
running them again gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import assign_layer, name_tokens, node_id, signature_hash
from graphloom.sources.tables import clean_path

NODE_KINDS = ("file", "class", "interface", "enum", "function", "document", "section")


def normalised(raw: DataFrame, with_text: bool = False) -> DataFrame:
    """RawNode rows as nodes: stable id, layer, hashes of contents; the row extracted last wins; kinds without ids are dropped."""
    rows = raw.where(F.col("type").isin(*NODE_KINDS) & F.col("repo").isNotNull() & F.col("file_path").isNotNull()).select(
        node_id("type", "repo", "file_path", "name", "signature").alias("id"), "type", "name", "repo", "language", clean_path("file_path").alias("file_path"), "line_range",
        "signature", signature_hash("signature").alias("signature_hash"), F.when(F.col("type").isin("file", "document", "section"), F.md5("code_snippet")).alias("file_hash"),
        assign_layer("type", "name", "file_path").alias("layer"), name_tokens("name").alias("name_tokens"), "run_id", "extracted_at", *["code_snippet"] * with_text,
    )
    cells = [c for c in rows.columns if c != "id"]
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct(*cells), F.struct("extracted_at", "run_id", F.xxhash64(*[F.col(c) for c in cells]))).alias("v")).select("id", "v.*")


def upsert_nodes(old: DataFrame, new: DataFrame, commit: Column, now: Column) -> DataFrame:
    """Old nodes with the new ones merged in by id.

    New ids get every value and first_seen_commit; known ids change only file_hash, line_range, layer and updated_at,
    and live again; last_seen_commit moves for all that the batch holds.
    """
    cells = ("type", "name", "repo", "language", "file_path", "line_range", "signature", "signature_hash", "file_hash", "layer")
    text = [c for c in ("code_snippet",) if c in old.columns and c in new.columns]
    others = [c for c in old.columns if c not in (*cells, *text, "id", "first_seen_commit", "last_seen_commit", "created_at", "updated_at", "deleted_at", "action")]  # summaries and the like stay
    n = new.select("id", F.struct(*cells, *text, commit.alias("commit"), now.alias("now")).alias("n"))
    o = old.select("id", F.struct(*[c for c in old.columns if c != "id"]).alias("o"))
    both = o.join(n, "id", "full")
    is_new, hit = F.col("o").isNull(), F.col("n").isNotNull()

    def keep(c: str) -> Column:
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    def change(c: str) -> Column:
        return F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return both.select(
        "id", *[keep(c) for c in ("type", "name", "repo", "language", "file_path", "signature", "signature_hash")], *[change(c) for c in ("file_hash", "line_range", "layer", *text)],
        F.coalesce("o.first_seen_commit", F.when(is_new, F.col("n.commit"))).alias("first_seen_commit"), F.when(hit, F.col("n.commit")).otherwise(F.col("o.last_seen_commit")).alias("last_seen_commit"),
        F.coalesce("o.created_at", "n.now").alias("created_at"), F.when(hit, F.col("n.now")).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(~hit, F.col("o.deleted_at")).alias("deleted_at"), F.when(is_new, "created").when(hit, "matched").otherwise("kept").alias("action"), *[F.col(f"o.{c}").alias(c) for c in others],
    )


def upsert_edges(old: DataFrame, new: DataFrame, now: Column, overwrite_weight: bool = False) -> DataFrame:
    """Edges by (src, type, dst): the first weight stays unless ``overwrite_weight``; missing types are REFERENCES."""
    kind = F.coalesce("type", F.lit("REFERENCES"))
    n = new.select("src", "dst", kind.alias("type"), "weight", "unresolved").groupBy("src", "dst", "type").agg(F.min(F.struct("unresolved", "weight")).alias("n"))
    o = old.select("src", "dst", "type", F.struct("weight", "unresolved", "created_at").alias("o"))
    weight = F.coalesce("n.weight", "o.weight") if overwrite_weight else F.when(F.col("o").isNotNull(), F.col("o.weight")).otherwise(F.col("n.weight"))
    return o.join(n, ["src", "dst", "type"], "full").select(
        "src", "dst", "type", weight.alias("weight"), F.when(F.col("o").isNotNull(), F.col("o.unresolved")).otherwise(F.col("n.unresolved")).alias("unresolved"),
        F.coalesce("o.created_at", now).alias("created_at"), F.when(F.col("n").isNotNull(), now).otherwise(F.col("o.created_at")).alias("updated_at"),
    )


def written(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(action, rows): how many rows of an upsert are new, how many were there before."""
    old = before.select(*key).distinct().withColumn("old", F.lit(True))
    return after.select(*key).join(old, key, "left").groupBy(F.when(F.col("old"), "kept").otherwise("created").alias("action")).agg(F.count(F.lit(1)).alias("rows"))


def repaired(nodes: DataFrame) -> DataFrame:
    """Stored nodes as the schema wants them: '' is no layer, name_tokens are filled in; a column that is missing is an error."""
    missing = {"id", "name", "layer"} - set(nodes.columns)
    if missing:
        raise ValueError(f"nodes lack {sorted(missing)}")
    tokens = name_tokens("name")
    return nodes.withColumns({"layer": F.nullif(F.trim("layer"), F.lit("")), "name_tokens": F.coalesce("name_tokens", tokens) if "name_tokens" in nodes.columns else tokens})


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def membership_edges(nodes: DataFrame) -> DataFrame:
    """IN_REPO and BELONGS_TO_LAYER edges of live nodes."""
    alive = nodes.where("deleted_at IS NULL AND repo IS NOT NULL")
    repo = F.struct(F.lit("IN_REPO").alias("type"), F.concat(F.lit("repo:"), F.col("repo")).alias("dst"))
    layer = F.struct(F.lit("BELONGS_TO_LAYER").alias("type"), F.when(F.col("layer").isNotNull(), F.concat_ws(":", F.lit("layer"), "repo", "layer")).alias("dst"))
    return alive.select(F.col("id").alias("src"), F.explode(F.array(repo, layer)).alias("e")).select("src", "e.dst", "e.type").where("dst IS NOT NULL")


def soft_delete_files(nodes: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """Live nodes of the given files (repo, file_path) get deleted_at."""
    gone = files.select("repo", "file_path").distinct().withColumn("gone", F.lit(True))
    return nodes.join(gone, ["repo", "file_path"], "left").withColumn("deleted_at", F.when(F.col("gone") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).drop("gone")


def soft_delete_unseen(nodes: DataFrame, heads: DataFrame, now: Column) -> DataFrame:
    """After a full run: live nodes of a repo last seen at another commit than its head (repo, head) get deleted_at."""
    late = F.col("last_seen_commit").isNotNull() & (F.col("last_seen_commit") != F.col("head")) & F.col("deleted_at").isNull()
    return nodes.join(heads.select("repo", "head"), "repo", "left").withColumn("deleted_at", F.when(late, now).otherwise(F.col("deleted_at"))).drop("head")


def purge(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the deleted ones, and edges without those that touch them."""
    dead = nodes.where("deleted_at IS NOT NULL").select("id")
    kept = edges.join(dead.withColumnRenamed("id", "src"), "src", "left_anti").join(dead.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where("deleted_at IS NULL"), kept


def delete_repos(nodes: DataFrame, edges: DataFrame, slugs: list[str], confirm: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the repos; refused unless confirmed."""
    if not confirm:
        raise ValueError("deleting a repo needs confirm=True")
    gone = nodes.where(F.col("repo").isin(*slugs)).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.where(~F.coalesce(F.col("repo").isin(*slugs), F.lit(False))), kept


def upsert_repos(repos: DataFrame, runs: DataFrame) -> DataFrame:
    """Repo rows with the commit and time of their last completed run; repos of runs that lack a row get one."""
    last = (
        runs.where("status = 'completed' AND repo IS NOT NULL")
        .groupBy("repo").agg(F.max(F.struct("started_at", "commit_sha")).alias("r"))
        .select(F.concat(F.lit("repo:"), F.col("repo")).alias("id"), "repo", F.col("r.commit_sha").alias("sha"), F.col("r.started_at").alias("at"))
    )
    return repos.select("id", "slug", "name", "last_commit_sha", "last_ingest_at").distinct().join(last, "id", "full").select(
        "id", F.coalesce("slug", F.lower("name"), "repo").alias("slug"), F.coalesce("name", "repo").alias("name"), F.coalesce("sha", "last_commit_sha").alias("last_commit_sha"), F.coalesce("at", "last_ingest_at").alias("last_ingest_at")
    )


def diff(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, id, kind) between the commits of (repo, base, head): added, removed, modified."""
    n = nodes.select("repo", "id", "first_seen_commit", "last_seen_commit", "file_hash").join(pairs, "repo")
    first, last, base, head = (F.col(c) for c in ("first_seen_commit", "last_seen_commit", "base", "head"))
    kind = (
        F.when(first == head, "added")
        .when((last == base) & (base != head), "removed")
        .when((F.coalesce(first, F.lit("")) != head) & (last == head) & F.col("file_hash").isNotNull(), "modified")
    )
    return n.select("repo", "id", kind.alias("kind")).where("kind IS NOT NULL")


def write_enrichment(nodes: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Nodes with the summaries, tags and complexities found for them; a failed one stays null, so that it is asked again."""
    f = found.select("id", F.col("summary").alias("s"), F.col("tags").alias("t"), F.col("complexity").alias("c"))
    hit = F.col("s").isNotNull()
    return nodes.join(f, "id", "left").select(
        "id", F.coalesce("s", "summary").alias("summary"), F.when(hit, F.coalesce("t", F.array().cast("array<string>"))).otherwise(F.col("tags")).alias("tags"),
        F.when(hit, F.col("c")).otherwise(F.col("complexity")).alias("complexity"), F.when(hit, now).alias("enriched_at"),
    )
