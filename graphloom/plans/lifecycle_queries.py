"""Queries of the lifecycle, of enrichment and of the incremental stream, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import enrich
from graphloom.operators import graph as G
from graphloom.operators import lifecycle as L
from graphloom.operators import resolve as R
from graphloom.plans.graph_queries import E, N, sql
from graphloom.plans.problem_queries import clean
from graphloom.plans.text_queries import SIG4, TEST_MAP, calls, layer_sql, resolve_sql
from graphloom.session import ensure_checkpoint_dir
from graphloom.sources.tables import table
from graphloom.streaming.ingest import GraphStream



def now():
    """The time of the written changes, fixed so that results can be compared."""
    return F.expr("timestamp_ntz'2026-01-01 00:00:00'")


STATE = ("type", "name", "repo", "language", "file_path", "signature", "signature_hash", "file_hash", "line_range", "layer", "first_seen_commit", "last_seen_commit", "created_at", "updated_at", "deleted_at")


def old_nodes(s, d) -> DataFrame:
    return N(s, d, *STATE)


def latest_raw(s, d) -> DataFrame:
    """Raw rows of the last run of every repo, by start."""
    runs = table(s, d, "pipeline_runs").where("run_id IS NOT NULL").select("run_id", "repo", "started_at").distinct()
    last = runs.groupBy("repo").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id")).select("run_id")
    return table(s, d, "raw_nodes").join(last, "run_id", "left_semi")


def shown(df: DataFrame) -> DataFrame:
    return df.select("id", "type", "file_hash", "layer", "first_seen_commit", "last_seen_commit", "created_at", "updated_at", "deleted_at", *[c for c in df.columns if c == "action"])


def heads(s, d) -> DataFrame:
    return table(s, d, "repos").where("last_commit_sha IS NOT NULL").groupBy(F.coalesce("slug", F.lower("name")).alias("repo")).agg(F.max("last_commit_sha").alias("head"))


def commit_pairs(s, d) -> DataFrame:
    """Each repo's last commit and the one before it."""
    c = table(s, d, "commits").select("repo", "commit_sha", "parent_sha", "committed_at").distinct()
    return c.groupBy("repo").agg(F.max(F.struct("committed_at", "commit_sha", "parent_sha")).alias("c")).select("repo", F.col("c.parent_sha").alias("base"), F.col("c.commit_sha").alias("head")).where("base IS NOT NULL")


def new_edges(s, d) -> DataFrame:
    return R.test_links(E(s, d).where("type = 'CALLS'"), N(s, d, "type", "repo", "file_path", "deleted_at")).select("src", "dst", F.lit("TESTS").alias("type"), "weight", F.lit(False).alias("unresolved"))


def enriched(s, d) -> DataFrame:
    n = N(s, d, "type", "name", "summary", "tags", "complexity", "code_snippet", "deleted_at")
    found = enrich.summaries(enrich.wanted(n).withColumnRenamed("code_snippet", "text"))
    return L.write_enrichment(n, found, now()).select("id", "summary", "tags", "complexity")


def node_embeddings(s, d) -> DataFrame:
    n = G.live(N(s, d, "name", "summary", "deleted_at"))
    e = enrich.embeddings(n.select("id", F.concat_ws(" ", "name", "summary").alias("t")), "id", "t")
    return e.select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).isin(0.0, 1.0).alias("unit_or_empty"))


def streamed(s, d) -> DataFrame:
    """raw_nodes taken as a stream of files into a fresh store; the result is the batch upsert into an empty graph."""
    root = f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    g = GraphStream(s, f"{root}/graph", 8)
    g.start(f"{d}/raw_nodes*.parquet", table(s, d, "raw_nodes").schema, f"{root}/progress").awaitTermination()
    return g.nodes().select("id", "type", "file_hash", "layer", "first_seen_commit")


def norm_sql(source: str) -> str:
    path = clean("file_path")
    node = f"CASE type WHEN 'file' THEN 'file:' || repo || ':' || {path} WHEN 'class' THEN 'class:' || repo || ':' || {path} || ':' || name WHEN 'function' THEN 'function:' || repo || ':' || {path} || ':' || name || ':' || {SIG4} END"
    return f"""rn AS (SELECT {node} AS id, type, name, repo, language, {path} AS file_path, line_range, signature, CASE WHEN coalesce(signature, '') <> '' THEN substr(sha1(signature), 1, 8) END AS signature_hash,
  CASE WHEN type = 'file' THEN md5(code_snippet) END AS file_hash, {layer_sql()} AS layer, run_id, extracted_at FROM {source}),
nn AS (SELECT * FROM rn WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY extracted_at DESC, run_id DESC) = 1)"""


LATEST = "lr AS (SELECT * FROM raw_nodes WHERE run_id IN (SELECT arg_max(run_id, (started_at, run_id)) FROM pipeline_runs WHERE run_id IS NOT NULL GROUP BY repo))"
HEADS = "hd AS (SELECT coalesce(slug, lower(name)) AS repo, max(last_commit_sha) AS head FROM repos WHERE last_commit_sha IS NOT NULL GROUP BY 1)"
PAIRS_SQL = "cp AS (SELECT repo, parent_sha AS base, commit_sha AS head FROM (SELECT DISTINCT repo, commit_sha, parent_sha, committed_at FROM commits) QUALIFY row_number() OVER (PARTITION BY repo ORDER BY committed_at DESC, commit_sha DESC) = 1)"
DIFF = f", {PAIRS_SQL}, df AS (SELECT n.repo, n.id, CASE WHEN first_seen_commit = head THEN 'added' WHEN last_seen_commit = base AND base <> head THEN 'removed' WHEN coalesce(first_seen_commit, '') <> head AND last_seen_commit = head AND file_hash IS NOT NULL THEN 'modified' END AS kind FROM gn n JOIN cp ON cp.repo = n.repo WHERE base IS NOT NULL)"
TS = "TIMESTAMP '2026-01-01'"


def diffed(kind: str | None):
    def run(s, d):
        x = L.diff(N(s, d, "repo", "first_seen_commit", "last_seen_commit", "file_hash"), commit_pairs(s, d))
        return x.groupBy("repo", "kind").count() if kind is None else x.where(F.col("kind") == kind).select("repo", "id")

    return run


PAIRS: dict[str, tuple] = {
    "normalized_nodes": (
        lambda s, d: L.normalised(table(s, d, "raw_nodes")).select("id", "type", "name", "language", "signature_hash", "layer"),
        f"WITH {norm_sql('raw_nodes')} SELECT id, type, name, language, signature_hash, layer FROM nn",
    ),
    "upsert_nodes": (
        lambda s, d: shown(L.upsert_nodes(old_nodes(s, d), L.normalised(latest_raw(s, d)), F.col("run_id"), now())),
        sql(f""", {LATEST}, {norm_sql('lr')}
SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN n.type ELSE o.type END AS type, CASE WHEN n.id IS NOT NULL THEN n.file_hash ELSE o.file_hash END AS file_hash, CASE WHEN n.id IS NOT NULL THEN n.layer ELSE o.layer END AS layer,
coalesce(o.first_seen_commit, CASE WHEN o.id IS NULL THEN n.run_id END) AS first_seen_commit, CASE WHEN n.id IS NOT NULL THEN n.run_id ELSE o.last_seen_commit END AS last_seen_commit, coalesce(o.created_at, {TS}) AS created_at,
CASE WHEN n.id IS NOT NULL THEN {TS} ELSE o.updated_at END AS updated_at, CASE WHEN n.id IS NULL THEN o.deleted_at END AS deleted_at, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NOT NULL THEN 'matched' ELSE 'kept' END AS action
FROM gn o FULL JOIN nn n ON n.id = o.id"""),
    ),
    "upsert_edges": (
        lambda s, d: L.upsert_edges(E(s, d), new_edges(s, d), now()),
        sql(f"{TEST_MAP} SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, coalesce(o.type, 'TESTS') AS type, CASE WHEN o.src IS NOT NULL THEN o.weight ELSE n.weight END AS weight, CASE WHEN o.src IS NOT NULL THEN o.unresolved ELSE false END AS unresolved, coalesce(o.created_at, {TS}) AS created_at, CASE WHEN n.src IS NOT NULL THEN {TS} ELSE o.created_at END AS updated_at FROM ge o FULL JOIN tm n ON n.src = o.src AND n.dst = o.dst AND o.type = 'TESTS'"),
    ),
    "upsert_edges_overwrite": (
        lambda s, d: L.upsert_edges(E(s, d).where("type = 'CALLS'"), calls(s, d).withColumn("type", F.lit("CALLS")), now(), True),
        sql(", o AS (SELECT * FROM ge WHERE type = 'CALLS'), n AS (" + "WITH " + resolve_sql("'function'", "'CALLS'") + f") SELECT coalesce(o.src, n.src) AS src, coalesce(o.dst, n.dst) AS dst, 'CALLS' AS type, coalesce(n.weight, o.weight) AS weight, CASE WHEN o.src IS NOT NULL THEN o.unresolved ELSE n.unresolved END AS unresolved, coalesce(o.created_at, {TS}) AS created_at, CASE WHEN n.src IS NOT NULL THEN {TS} ELSE o.created_at END AS updated_at FROM o FULL JOIN n ON n.src = o.src AND n.dst = o.dst"),
    ),
    "edges_with_both_ends": (
        lambda s, d: L.with_both_ends(E(s, d), N(s, d, "type")).select("src", "dst", "type"),
        sql("SELECT src, dst, type FROM ge WHERE src IN (SELECT id FROM gn) AND dst IN (SELECT id FROM gn)"),
    ),
    "membership_edges": (
        lambda s, d: L.membership_edges(N(s, d, "repo", "layer", "deleted_at")),
        sql("SELECT id AS src, 'repo:' || repo AS dst, 'IN_REPO' AS type FROM ln WHERE repo IS NOT NULL UNION ALL SELECT id, 'layer:' || repo || ':' || layer, 'BELONGS_TO_LAYER' FROM ln WHERE repo IS NOT NULL AND layer IS NOT NULL"),
    ),
    "soft_delete_files": (
        lambda s, d: (lambda n: L.soft_delete_files(n, G.live(n).where("type = 'file' AND complexity = 'complex'"), now()).select("id", "deleted_at"))(N(s, d, "type", "repo", "file_path", "complexity", "deleted_at")),
        sql(f"SELECT id, CASE WHEN deleted_at IS NULL AND (repo, file_path) IN (SELECT (repo, file_path) FROM ln WHERE type = 'file' AND complexity = 'complex') THEN {TS} ELSE deleted_at END AS deleted_at FROM gn"),
    ),
    "soft_delete_unseen": (
        lambda s, d: L.soft_delete_unseen(N(s, d, "repo", "last_seen_commit", "deleted_at"), heads(s, d), now()).select("id", "deleted_at"),
        sql(f", {HEADS} SELECT id, CASE WHEN deleted_at IS NULL AND last_seen_commit <> head THEN {TS} ELSE deleted_at END AS deleted_at FROM gn LEFT JOIN hd USING (repo)"),
    ),
    "purge_nodes": (lambda s, d: L.purge(N(s, d, "type", "deleted_at"), E(s, d))[0].select("id", "type"), sql("SELECT id, type FROM ln")),
    "purge_edges": (
        lambda s, d: L.purge(N(s, d, "type", "deleted_at"), E(s, d))[1].select("src", "dst", "type"),
        sql("SELECT src, dst, type FROM ge WHERE src NOT IN (SELECT id FROM gn WHERE deleted_at IS NOT NULL) AND dst NOT IN (SELECT id FROM gn WHERE deleted_at IS NOT NULL)"),
    ),
    "delete_repo_edges": (
        lambda s, d: L.delete_repos(N(s, d, "repo"), E(s, d), ["harborline-core"], True)[1].select("src", "dst", "type"),
        sql("SELECT src, dst, type FROM ge WHERE src NOT IN (SELECT id FROM gn WHERE repo = 'harborline-core') AND dst NOT IN (SELECT id FROM gn WHERE repo = 'harborline-core')"),
    ),
    "repo_meta": (
        lambda s, d: L.upsert_repos(table(s, d, "repos"), table(s, d, "pipeline_runs")),
        "WITH r AS (SELECT DISTINCT id, slug, name, last_commit_sha, last_ingest_at FROM repos), l AS (SELECT 'repo:' || repo AS id, repo, commit_sha AS sha, started_at AS at_ FROM pipeline_runs WHERE status = 'completed' AND repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY started_at DESC, commit_sha DESC) = 1) SELECT coalesce(r.id, l.id) AS id, coalesce(slug, lower(name), repo) AS slug, coalesce(name, repo) AS name, coalesce(sha, last_commit_sha) AS last_commit_sha, coalesce(at_, last_ingest_at) AS last_ingest_at FROM r FULL JOIN l ON l.id = r.id",
    ),
    "diff_added": (diffed("added"), sql(f"{DIFF} SELECT repo, id FROM df WHERE kind = 'added'")),
    "diff_removed": (diffed("removed"), sql(f"{DIFF} SELECT repo, id FROM df WHERE kind = 'removed'")),
    "diff_modified": (diffed("modified"), sql(f"{DIFF} SELECT repo, id FROM df WHERE kind = 'modified'")),
    "diff_counts": (diffed(None), sql(f"{DIFF} SELECT repo, kind, count(*) AS count FROM df WHERE kind IS NOT NULL GROUP BY ALL")),
    "enrichment": (
        enriched,
        sql(""", w AS (SELECT id, type, name, coalesce(code_snippet, '') AS t FROM ln WHERE summary IS NULL AND type IN ('class', 'interface', 'function', 'method', 'file', 'enum')),
f AS (SELECT id, coalesce(nullif(trim(regexp_extract(t, '(?:\"\"\"|///?|#|/\\*\\*?|\\*)\\s*([A-Za-z][^\\n\"*]{8,200})', 1), ' ' || chr(9) || chr(13)), ''), upper(type[1]) || lower(type[2:]) || ' ' || chr(39) || name || chr(39) || '.') AS s,
  list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(name, ''), '[A-Z]?[a-z]{2,}'), lambda x: lower(x))))[1:5] AS g, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END AS n FROM w)
SELECT gn.id, coalesce(f.s, summary) AS summary, CASE WHEN f.id IS NOT NULL THEN g ELSE tags END AS tags, CASE WHEN f.id IS NULL THEN complexity WHEN n < 20 THEN 'simple' WHEN n < 60 THEN 'moderate' ELSE 'complex' END AS complexity FROM gn LEFT JOIN f ON f.id = gn.id"""),
    ),
    "node_embeddings": (node_embeddings, sql("SELECT id, 64 AS dimension, true AS unit_or_empty FROM ln")),
    "run_totals": (
        lambda s, d: table(s, d, "pipeline_runs").distinct().groupBy("repo").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum("nodes_added").alias("nodes_added"), F.round(F.avg("duration_seconds"), 6).alias("mean_seconds"), F.sum(F.size(F.coalesce("errors", F.array().cast("array<string>")))).alias("errors")),
        "SELECT repo, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, sum(nodes_added)::BIGINT AS nodes_added, round(avg(duration_seconds), 6) AS mean_seconds, sum(len(coalesce(errors, [])))::BIGINT AS errors FROM (SELECT DISTINCT * FROM pipeline_runs) GROUP BY repo",
    ),
    "stream_ingest": (streamed, f"WITH {norm_sql('raw_nodes')} SELECT id, type, file_hash, layer, run_id AS first_seen_commit FROM nn"),
}

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items() if q}
