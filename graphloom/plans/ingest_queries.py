"""Queries of extraction and ingestion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import enrich, ingest, resolve
from graphloom.operators import graph as G
from graphloom.operators import lifecycle as L
from graphloom.operators import search as S
from graphloom.plans.graph_queries import E, N, sql
from graphloom.plans.lifecycle_queries import PAIRS as LIFECYCLE
from graphloom.plans.lifecycle_queries import new_edges, now, old_nodes
from graphloom.plans.lifecycle_queries import latest_raw as latest
from graphloom.plans.problem_queries import clean
from graphloom.sources import extract, sites
from graphloom.sources.tables import clean_path, table

RAW_MEMBER = ("run_id", "kind", "file_path", "name", "line")


def members_of_raw(s, d):
    """The classes and functions of raw_nodes that stand at their line in the text of their file, as the walker finds them."""
    raw = table(s, d, "raw_nodes")
    found = sites.members(sites.scanned(raw)).select("run_id", "file_path", "kind", "name", F.col("first").alias("line"))
    held = raw.where("type IN ('class', 'function')").select("run_id", clean_path("file_path").alias("file_path"), F.col("type").alias("kind"), "name", F.col("line_range.start").alias("line")).distinct()
    return held.join(found.distinct(), ["run_id", "file_path", "kind", "name", "line"], "left_semi").select(*RAW_MEMBER)


def found_sites(s, d, *types):
    return sites.sites(sites.scanned(table(s, d, "raw_nodes")), *types)


def registry(s, d, *types):
    n = table(s, d, "nodes").where(F.col("type").isin(*types) & F.col("deleted_at").isNull())
    return n.select("repo", clean_path("file_path").alias("file"), "name", clean_path("id").alias("id"))


def resolved(types, kinds):
    def run(s, d):
        named = found_sites(s, d, *types).select("repo", "from_file", "from_name", "target", "weight").distinct()
        return resolve.resolve_names(named, registry(s, d, *kinds))

    return run


def files_now(s, d):
    return N(s, d, "type", "repo", "file_path", "file_hash", "deleted_at")


def node_texts(s, d):
    """List and detail shapes with their defaults and caps."""
    n = N(s, d, "type", "name", "summary", "code_snippet", "signature")
    text = F.coalesce("summary", "code_snippet", "name")
    return n.select(
        "id", F.coalesce("type", F.lit("Unknown")).alias("type"), F.coalesce("summary", F.lit("")).alias("summary"), F.md5(text).alias("text"),
        F.coalesce(F.length(F.substring("code_snippet", F.lit(1), F.when(F.col("type").isin(*G.DOC_TYPES), ingest.TEXT_CAP).otherwise(ingest.CODE_CAP))), F.lit(0)).alias("kept"), F.substring_index("signature", "\n", 1).alias("signature"),
    )


def resolved_links(s, d):
    docs = table(s, d, "documents")
    at = docs.where("file_path IS NOT NULL").select("doc_id", clean_path("file_path").alias("base"))
    return extract.links(docs).join(at, "doc_id").select("doc_id", "target", X.resolve_link("target", "base").alias("path"))


def upsert_counts(s, d):
    nodes = L.upsert_nodes(old_nodes(s, d), L.normalised(latest(s, d)), F.col("run_id"), now())
    old = E(s, d)
    edges = L.written(old, L.upsert_edges(old, new_edges(s, d), now()), ["src", "dst", "type"])
    return nodes.groupBy("action").agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("nodes")).unionByName(edges.withColumn("table", F.lit("edges")))


def hybrid_nodes(s, d):
    """Both ways over the same nodes: words and vectors of name and summary; the layers ask."""
    n = G.live(N(s, d, "name", "summary", "layer", "deleted_at"))
    text = F.concat_ws(" ", F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "summary")
    q = n.where("layer IS NOT NULL").select(F.col("layer").alias("query"), F.col("layer").alias("q")).distinct()
    words = S.bm25(n, "id", text, q, 30)
    vectors = enrich.embeddings(n.select("id", text.alias("t")), "id", "t")
    asked = enrich.embeddings(q, "query", "q").select("query", F.col("embedding").alias("vector"))
    return S.fuse([words, S.knn(vectors, "id", "embedding", asked, 30)], "id")


TEXTS = f"tx AS (SELECT DISTINCT run_id, {clean('file_path')} AS p, string_split(replace(code_snippet, chr(13), ''), chr(10)) AS ls FROM raw_nodes WHERE type = 'file' AND code_snippet IS NOT NULL AND regexp_matches(lower({clean('file_path')}), '\\.(py|js|jsx|ts|tsx|java|cs|go)$'))"
COLLAPSED = "array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(base, '[^/]*$', '') || regexp_replace(target, '#.*$', ''), '/'), lambda x: [x])), lambda acc, x: CASE WHEN x[1] IN ('.', '') THEN acc WHEN x[1] = '..' THEN acc[:-2] ELSE acc || x END), '/')"

PAIRS: dict[str, tuple] = {
    "members_of_raw": (
        members_of_raw,
        # every member whose line in the text of its file names it is there, whatever its language
        f"WITH {TEXTS} SELECT DISTINCT m.run_id, m.type AS kind, {clean('m.file_path')} AS file_path, m.name, m.line_range.\"start\" AS line FROM raw_nodes m JOIN tx ON tx.run_id = m.run_id AND tx.p = {clean('m.file_path')} WHERE m.type IN ('class', 'function') AND m.line_range.\"start\" IS NOT NULL AND regexp_matches(tx.ls[m.line_range.\"start\"], '\\b' || m.name || '\\b')",
    ),
    "extracted_sites": (lambda s, d: found_sites(s, d), None),
    "extracted_calls": (resolved(("CALLS",), ("function",)), None),
    "extracted_bases": (resolved(("INHERITS", "IMPLEMENTS"), ("class", "interface")), None),
    "rename_edges": (
        lambda s, d: ingest.rename_edges(files_now(s, d), ingest.renamed(files_now(s, d))).select("src", "dst", "type"),
        sql(", fi AS (SELECT * FROM gn WHERE type = 'file'), nw AS (SELECT repo, file_hash, min(file_path) AS path FROM fi WHERE deleted_at IS NULL AND file_hash IS NOT NULL GROUP BY ALL), mv AS (SELECT DISTINCT o.repo, o.file_path AS old_path, nw.path FROM fi o JOIN nw ON nw.repo = o.repo AND nw.file_hash = o.file_hash WHERE o.deleted_at IS NOT NULL AND o.file_path <> nw.path) SELECT DISTINCT a.id AS src, b.id AS dst, 'RENAMED_FROM' AS type FROM mv JOIN fi a ON a.repo = mv.repo AND a.file_path = mv.old_path JOIN fi b ON b.repo = mv.repo AND b.file_path = mv.path WHERE a.id <> b.id"),
    ),
    "test_paths": (
        lambda s, d: N(s, d, "file_path").where("file_path IS NOT NULL").select("id", G.test_path(F.col("file_path")).alias("contains"), G.test_path_words(F.col("file_path")).alias("pattern")),
        sql("SELECT id, contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') AS contains, regexp_matches(file_path, '(test|spec|tests|__tests__)', 'i') AS pattern FROM gn WHERE file_path IS NOT NULL"),
    ),
    "node_texts": (
        node_texts,
        sql("SELECT id, coalesce(type, 'Unknown') AS type, coalesce(summary, '') AS summary, md5(coalesce(summary, code_snippet, name)) AS text, coalesce(CASE WHEN code_snippet IS NOT NULL THEN least(length(code_snippet), CASE WHEN type IN ('document', 'section') THEN 4000 ELSE 2000 END) END, 0)::INT AS kept, string_split(signature, chr(10))[1] AS signature FROM gn"),
    ),
    "section_hashes": (
        lambda s, d: N(s, d, "type", "code_snippet").where("type IN ('document', 'section') AND code_snippet IS NOT NULL").select("id", F.md5("code_snippet").alias("hash")),
        sql("SELECT id, md5(code_snippet) AS hash FROM gn WHERE type IN ('document', 'section') AND code_snippet IS NOT NULL"),
    ),
    "repaired_nodes": (
        lambda s, d: L.repaired(table(s, d, "nodes").select("id", "name", "layer").distinct()).select("id", "layer", "name_tokens"),
        "SELECT id, nullif(trim(layer), '') AS layer, array_to_string(list_filter(list_append(w, lower(name)), lambda x, i: list_position(list_append(w, lower(name)), x) = i), ' ') AS name_tokens FROM (SELECT *, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT id, name, layer FROM nodes))",
    ),
    "upsert_counts": (
        upsert_counts,
        f"WITH un AS ({LIFECYCLE['upsert_nodes'][1]}), ue AS ({LIFECYCLE['upsert_edges'][1]}) SELECT action, count(*) AS rows, 'nodes' AS \"table\" FROM un GROUP BY action UNION ALL SELECT CASE WHEN created_at = TIMESTAMP '2026-01-01' AND updated_at = created_at THEN 'created' ELSE 'kept' END, count(*), 'edges' FROM ue GROUP BY 1",
    ),
    "hybrid_nodes": (hybrid_nodes, None),
}
PAIRS["resolved_links"] = (
    resolved_links,
    "WITH l AS (SELECT doc_id, file_path, unnest(regexp_extract_all(regexp_replace(text, '(?s)(?:^|\\n)```.*?(?:\\n```[ \\t\\r]*(?:\\n|$)|$)', chr(10), 'g'), '\\[[^\\]\\n]*\\]\\([^)\\s]+\\)')) AS l FROM documents WHERE text IS NOT NULL AND file_path IS NOT NULL), "
    + f"t AS (SELECT DISTINCT doc_id, {clean('file_path')} AS base, regexp_extract(l, '\\(([^)]+)\\)$', 1) AS target, regexp_extract(l, '^\\[([^\\]]*)\\]', 1) AS label FROM l), "
    + f"k AS (SELECT *, NOT regexp_matches(lower(target), '^(?:https?|ftp|mailto):') AND (regexp_matches(lower(regexp_replace(target, '#.*$', '')), '\\.(?:md|markdown)$') OR NOT contains(string_split(regexp_replace(target, '#.*$', ''), '/')[-1], '.')) AS internal FROM t) SELECT doc_id, target, CASE WHEN internal THEN {COLLAPSED} END AS path FROM k",
)

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items() if q}
