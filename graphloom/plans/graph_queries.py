"""Queries over the graph and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.plans.problem_queries import clean
from graphloom.sources.tables import table


def N(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return G.nodes_view(table(s, d, "nodes"), *columns)


def E(s: SparkSession, d: str) -> DataFrame:
    return G.edges_view(table(s, d, "edges"))


BASIC = ("type", "name", "repo", "layer", "file_path", "deleted_at")

GRAPH = f"""
gn AS (
  SELECT * REPLACE (nullif(trim(layer), '') AS layer, nullif(trim(summary), '') AS summary, {clean('file_path')} AS file_path) FROM (SELECT * REPLACE ({clean('id')} AS id) FROM nodes WHERE id IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1),
ge AS (
  SELECT {clean('from_id')} AS src, {clean('to_id')} AS dst, type, weight, coalesce(unresolved, false) AS unresolved, created_at
  FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {clean('from_id')}, {clean('to_id')}, type ORDER BY created_at, {clean('id')}) = 1),
ln AS (SELECT * FROM gn WHERE deleted_at IS NULL),
deg AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree, (sum(i) + sum(o))::BIGINT AS degree FROM (
  SELECT src AS id, 0 AS i, 1 AS o FROM ge WHERE type = 'CALLS' UNION ALL SELECT dst, 1, 0 FROM ge WHERE type = 'CALLS') GROUP BY id),
intra AS (SELECT e.src, e.dst, a.repo, a.layer AS from_layer, b.layer AS to_layer FROM ge e JOIN ln a ON a.id = e.src JOIN ln b ON b.id = e.dst WHERE e.type = 'CALLS' AND a.repo = b.repo),
sides AS (
  SELECT src AS id, dst AS neighbour, type AS edge_type, weight AS w0, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END AS weight FROM ge
  UNION ALL SELECT dst, src, type, weight, CASE WHEN coalesce(weight, 0) = 0 THEN 1.0 ELSE weight END FROM ge WHERE src <> dst)"""


def sql(body: str) -> str:
    return f"WITH {GRAPH}\n{body}"


TEST_PATH = "(lower(coalesce({0}, '')) LIKE '%test%' OR lower(coalesce({0}, '')) LIKE '%spec%')"

PAIRS: dict[str, tuple] = {
    "hotspots": (
        lambda s, d: G.hotspots(E(s, d), N(s, d, *BASIC)),
        sql("SELECT id, type, name, repo, layer, file_path, in_degree, out_degree, degree, row_number() OVER (PARTITION BY repo ORDER BY degree DESC, id) AS rank FROM ln JOIN deg USING (id) WHERE repo IS NOT NULL QUALIFY rank <= 15"),
    ),
    "degrees": (lambda s, d: G.degrees(E(s, d)), sql("SELECT * FROM deg")),
    "entry_points": (
        lambda s, d: G.entry_points(E(s, d), N(s, d, *BASIC)),
        sql("SELECT id, name, repo, coalesce(in_degree, 0) AS in_degree, row_number() OVER (PARTITION BY repo ORDER BY coalesce(in_degree, 0) DESC, id) AS rank FROM ln LEFT JOIN deg USING (id) WHERE layer = 'controller' QUALIFY rank <= 10"),
    ),
    "layer_flows": (
        lambda s, d: G.layer_flows(E(s, d), N(s, d, *BASIC)),
        sql("SELECT repo, from_layer, to_layer, count(*) AS edge_count FROM intra WHERE from_layer <> to_layer GROUP BY ALL"),
    ),
    "intra_repo_calls": (lambda s, d: G.intra_repo_calls(E(s, d), N(s, d, *BASIC)), sql("SELECT * FROM intra")),
    "list_layers": (
        lambda s, d: G.layers(N(s, d, *BASIC)),
        sql("SELECT 'layer:' || repo || ':' || layer AS id, repo, layer AS name, count(*) AS member_count FROM ln WHERE layer IS NOT NULL GROUP BY repo, layer"),
    ),
    "layer_members": (
        lambda s, d: G.live(N(s, d, *BASIC)).where("layer IS NOT NULL").select(F.concat_ws(":", F.lit("layer"), "repo", "layer").alias("layer_id"), "id", "type", "name"),
        sql("SELECT 'layer:' || repo || ':' || layer AS layer_id, id, type, name FROM ln WHERE layer IS NOT NULL"),
    ),
    "list_projects": (
        lambda s, d: G.projects(table(s, d, "repos"), N(s, d, *BASIC), E(s, d)),
        sql("""SELECT r.id, r.slug, r.name, r.last_commit_sha, r.last_ingest_at, coalesce(n.c, 0) AS node_count, coalesce(e.c, 0) AS edge_count
FROM (SELECT DISTINCT id, coalesce(slug, lower(name)) AS slug, name, last_commit_sha, last_ingest_at FROM repos) r
LEFT JOIN (SELECT repo, count(*) AS c FROM ln GROUP BY repo) n ON n.repo = r.slug
LEFT JOIN (SELECT repo, count(*) AS c FROM ge JOIN ln ON ln.id = ge.src GROUP BY repo) e ON e.repo = r.slug"""),
    ),
    "repo_state": (
        lambda s, d: table(s, d, "repos").select("id", F.coalesce("slug", F.lower("name")).alias("slug"), "last_commit_sha").distinct().join(
            N(s, d, "repo").groupBy(F.col("repo").alias("slug")).agg(F.count(F.lit(1)).alias("nodes")), "slug", "left"
        ).select("id", "slug", "last_commit_sha", F.coalesce("nodes", F.lit(0)).alias("node_count"), F.lit(True).alias("exists")),
        sql("SELECT r.id, r.slug, r.last_commit_sha, coalesce(n.c, 0) AS node_count, true AS \"exists\" FROM (SELECT DISTINCT id, coalesce(slug, lower(name)) AS slug, last_commit_sha FROM repos) r LEFT JOIN (SELECT repo, count(*) AS c FROM gn GROUP BY repo) n ON n.repo = r.slug"),
    ),
    "get_node": (
        lambda s, d: N(s, d, "type", "name", "repo", "file_path", "signature", "layer", "summary", "tags").select("id", "type", "name", "repo", "file_path", "signature", "layer", F.substring(F.coalesce("summary", F.lit("")), 1, 2000).alias("summary"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")),
        sql("SELECT id, type, name, repo, file_path, signature, layer, substr(coalesce(summary, ''), 1, 2000) AS summary, coalesce(tags, []) AS tags FROM gn"),
    ),
    "neighbors_undirected": (
        lambda s, d: (lambda n: G.neighbours(E(s, d), n, n.where("type = 'class'"), most=20))(N(s, d, "type", "name")),
        sql("SELECT s.id, neighbour, edge_type, s.weight, n.type, n.name FROM sides s JOIN gn n ON n.id = s.neighbour WHERE s.id IN (SELECT id FROM gn WHERE type = 'class') QUALIFY row_number() OVER (PARTITION BY s.id ORDER BY edge_type, n.name, neighbour, s.weight DESC) <= 20"),
    ),
    "neighbors_filtered": (
        lambda s, d: (lambda n: G.neighbours(E(s, d), n, n, edge_types=["TESTS", "DOCUMENTS", "MENTIONS"], min_weight=0.6))(N(s, d, "type", "name")),
        sql("SELECT s.id, neighbour, edge_type, s.weight, n.type, n.name FROM sides s JOIN gn n ON n.id = s.neighbour JOIN gn m ON m.id = s.id WHERE edge_type IN ('TESTS', 'DOCUMENTS', 'MENTIONS') AND w0 >= 0.6"),
    ),
    "find_tests_for": (
        lambda s, d: G.sources_of(E(s, d), N(s, d, *BASIC), ["TESTS"], 0.5),
        sql("SELECT dst AS target, id, n.type, name, layer, e.type AS edge_type, weight AS score FROM ge e JOIN gn n ON n.id = e.src WHERE e.type = 'TESTS' AND weight >= 0.5"),
    ),
    "find_docs_for": (
        lambda s, d: G.sources_of(E(s, d), N(s, d, *BASIC), ["MENTIONS", "DOCUMENTS"]),
        sql("SELECT dst AS target, id, n.type, name, layer, e.type AS edge_type, weight AS score FROM ge e JOIN gn n ON n.id = e.src WHERE e.type IN ('MENTIONS', 'DOCUMENTS')"),
    ),
    "find_code_for": (
        lambda s, d: G.targets_of(E(s, d), N(s, d, *BASIC), ["MENTIONS", "DOCUMENTS"]),
        sql("SELECT src AS section, id, n.type, name, layer, e.type AS edge_type, weight AS score FROM ge e JOIN ln n ON n.id = e.dst WHERE e.type IN ('MENTIONS', 'DOCUMENTS')"),
    ),
    "calls_from_tests": (
        lambda s, d: (lambda n, e: e.where("type = 'CALLS'").select("src", "dst").join(n.where(G.test_path(F.col("file_path"))).select(F.col("id").alias("src")), "src").join(n.where(~G.test_path(F.col("file_path"))).select(F.col("id").alias("dst")), "dst").select("src", "dst"))(G.live(N(s, d, *BASIC)), E(s, d)),
        sql(f"SELECT src, dst FROM ge JOIN ln a ON a.id = src JOIN ln b ON b.id = dst WHERE ge.type = 'CALLS' AND {TEST_PATH.format('a.file_path')} AND NOT {TEST_PATH.format('b.file_path')}"),
    ),
    "summaries_shape": (
        lambda s, d: G.shaped(N(s, d, "type", "name", "file_path", "summary", "tags", "layer"), 20),
        sql("SELECT id, type, name, file_path, CASE WHEN length(summary) > 20 THEN substr(summary, 1, 20) || '…' ELSE coalesce(summary, '') END AS summary, coalesce(tags, []) AS tags, layer FROM gn"),
    ),
    "layer_violations": (lambda s, d: G.layer_violations(E(s, d), N(s, d, *BASIC)), sql("SELECT * FROM intra WHERE from_layer = 'model' AND to_layer IN ('service', 'controller')")),
    "untested_functions": (
        lambda s, d: G.untested_functions(N(s, d, *BASIC), E(s, d)),
        sql("SELECT id, name, repo, layer FROM ln WHERE type = 'function' AND layer IN ('service', 'repository') AND id NOT IN (SELECT dst FROM ge WHERE type = 'TESTS')"),
    ),
    "undocumented_classes": (
        lambda s, d: G.undocumented_classes(N(s, d, *BASIC), E(s, d)),
        sql("SELECT id, name, repo, layer FROM ln WHERE type = 'class' AND layer IN ('service', 'controller') AND id NOT IN (SELECT dst FROM ge WHERE type IN ('MENTIONS', 'DOCUMENTS'))"),
    ),
    "cross_repo_callers": (
        lambda s, d: G.cross_repo_callers(E(s, d), N(s, d, "name", "repo")),
        sql("SELECT src, dst, a.repo AS caller_repo, a.name AS caller, b.repo AS callee_repo, b.name AS callee FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst WHERE ge.type = 'CALLS' AND a.repo <> b.repo"),
    ),
    "direct_callers": (
        lambda s, d: (lambda n: E(s, d).where("type = 'CALLS'").select("src", "dst").join(n.select(F.col("id").alias("src"), F.col("name").alias("caller")), "src").join(n.select(F.col("id").alias("dst"), F.col("name").alias("callee")), "dst").groupBy("callee").agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("caller").alias("callers")))(N(s, d, "name")),
        sql("SELECT b.name AS callee, count(*) AS calls, count(DISTINCT a.name) AS callers FROM ge JOIN gn a ON a.id = src JOIN gn b ON b.id = dst WHERE ge.type = 'CALLS' GROUP BY b.name"),
    ),
    "label_histogram": (lambda s, d: N(s, d, "type").groupBy("type", F.when(F.col("type").isin(*G.DOC_TYPES), "DocNode").when(F.col("type") == "module", None).otherwise("CodeNode").alias("cross_label")).count(), sql("SELECT type, CASE WHEN type IN ('document', 'section') THEN 'DocNode' WHEN type = 'module' THEN NULL ELSE 'CodeNode' END AS cross_label, count(*) AS count FROM gn GROUP BY ALL")),
    "edge_type_histogram": (lambda s, d: E(s, d).groupBy("type").count(), sql("SELECT type, count(*) AS count FROM ge GROUP BY type")),
    "layer_distribution": (lambda s, d: N(s, d, "layer").groupBy("layer").count(), sql("SELECT layer, count(*) AS count FROM gn GROUP BY layer")),
    "unclassified_nodes": (
        lambda s, d: G.live(N(s, d, *BASIC)).where("layer IS NULL AND type <> 'file'").orderBy("file_path", "id").limit(50).select("id", "type", "file_path"),
        sql("SELECT id, type, file_path FROM ln WHERE layer IS NULL AND type <> 'file' ORDER BY file_path NULLS FIRST, id LIMIT 50"),
    ),
    "classes_of_layer": (lambda s, d: G.select_nodes(G.live(N(s, d, *BASIC)), types=["class"], layers=["service", "repository"]).select("id", "repo", "layer"), sql("SELECT id, repo, layer FROM ln WHERE type = 'class' AND layer IN ('service', 'repository')")),
    "refactor_risk": (
        lambda s, d: G.refactor_risk(E(s, d), N(s, d, *BASIC)),
        sql("""SELECT n.id, n.repo, coalesce(callers, 0) AS callers, coalesce(layers, 0) AS layers,
list_extract(['Low', 'Medium', 'High'], 1 + greatest(CASE WHEN callers > 5 OR layers >= 2 OR c THEN 2 WHEN callers >= 2 THEN 1 ELSE 0 END - CASE WHEN callers > 0 AND tested = callers THEN 1 ELSE 0 END, 0)) AS risk
FROM ln n LEFT JOIN (SELECT e.dst AS id, count(*) AS callers, count(DISTINCT a.layer) AS layers, coalesce(bool_or(a.layer = 'controller'), false) AS c, count(t.dst) AS tested
  FROM ge e JOIN ln a ON a.id = e.src LEFT JOIN (SELECT DISTINCT dst FROM ge WHERE type = 'TESTS') t ON t.dst = e.src WHERE e.type = 'CALLS' GROUP BY e.dst) k USING (id)
WHERE n.type IN ('function', 'class')"""),
    ),
    "test_gap_priority": (
        lambda s, d: G.test_gap_priority(E(s, d), N(s, d, *BASIC)),
        sql("""SELECT id, repo, layer, CASE WHEN layer = 'service' AND id IN (SELECT e.dst FROM ge e JOIN ln a ON a.id = e.src WHERE e.type = 'CALLS' AND a.layer = 'controller') THEN 'Critical'
WHEN layer = 'repository' AND regexp_matches(name, '(?i)^(add|create|insert|update|save|store|delete|remove|upsert|write|publish)') THEN 'High' WHEN layer = 'repository' THEN 'Medium' ELSE 'Low' END AS priority
FROM ln WHERE type = 'function' AND id NOT IN (SELECT dst FROM ge WHERE type = 'TESTS')"""),
    ),
    "architecture_overview": (
        lambda s, d: G.architecture_overview(N(s, d, *BASIC)),
        sql("SELECT repo, layer, count(*) AS members, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'function') AS functions, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, layer) AS rank FROM ln WHERE layer IS NOT NULL GROUP BY repo, layer QUALIFY rank <= 3"),
    ),
}

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items()}
