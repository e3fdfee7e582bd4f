"""Queries of composed workflows and of invariants, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import enrich
from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators import traversal as T
from graphloom.plans.graph_queries import BASIC, E, N, sql
from graphloom.plans.traversal_queries import CALLS, HOT, chain_sql, hottest, recursive
from graphloom.sources.tables import table


def invariants(s, d):
    """How many nodes break each rule of the graph."""
    n = N(s, d, "type", "name", "repo", "layer", "created_at", "deleted_at")
    rules = {"no name": F.col("name").isNull(), "no repo": F.col("repo").isNull(), "empty layer": F.col("layer") == "", "deleted before created": F.col("deleted_at") < F.col("created_at"), "class without repo": (F.col("type") == "class") & F.col("repo").isNull()}
    counts = n.agg(*[F.count_if(r).alias(k) for k, r in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(f"`{k}`"))])).alias("rule", "nodes"))


def candidates(s, d):
    """Code near to every fiftieth document by embedding, the candidates of semantic document links."""
    code = G.live(N(s, d, "type", "name", "repo", "summary", "deleted_at")).where("type IN ('class', 'function')")
    vectors = enrich.embeddings(code.select("id", F.concat_ws(" ", F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "summary").alias("t")), "id", "t")
    docs = table(s, d, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL")
    return S.knn(vectors, "id", "embedding", enrich.embeddings(docs, "doc_id", "text").select(F.col("doc_id").alias("query"), F.col("embedding").alias("vector")))


NEAR = f"""{HOT.format(n=1)}, {CALLS}, un AS (SELECT src AS a, dst AS b FROM ce UNION SELECT dst, src FROM ce),
h1 AS (SELECT start, id FROM (SELECT DISTINCT hot.id AS start, b AS id FROM hot JOIN un ON a = hot.id WHERE b <> hot.id) QUALIFY row_number() OVER (PARTITION BY start ORDER BY id) <= 50),
h2 AS (SELECT start, id FROM (SELECT DISTINCT start, b AS id FROM h1 JOIN un ON a = h1.id WHERE b <> start AND (start, b) NOT IN (SELECT (start, id) FROM h1)) QUALIFY row_number() OVER (PARTITION BY start ORDER BY id) <= 50)"""
FOLDER = "list_filter(string_split(regexp_replace(coalesce(file_path, ''), '/?[^/]*$', ''), '/'), lambda x: x NOT IN ('src', ''))"

PAIRS: dict[str, tuple] = {
    "neighborhood_layers": (lambda s, d: T.neighbourhood(E(s, d), hottest(s, d)), sql(f", {NEAR} SELECT start, id, 1 AS depth FROM h1 UNION ALL SELECT start, id, 2 FROM h2")),
    "dependency_map": (
        lambda s, d: T.dependency_map(E(s, d), N(s, d, *BASIC), hottest(s, d)),
        recursive(chain_sql().replace("depth < 6", "depth < 3").replace("SELECT start, ch.at AS id", ", cf AS (SELECT start, ch.at AS id", 1) + f""" ),
st AS (SELECT DISTINCT start, id, 'confirmed' AS status FROM cf WHERE id <> start),
ne AS (SELECT src AS start, dst AS id FROM ge UNION SELECT dst, src FROM ge),
al AS (SELECT * FROM st UNION ALL SELECT start, ne.id, 'likely' FROM ne JOIN hot ON hot.id = start WHERE start <> ne.id AND (start, ne.id) NOT IN (SELECT (start, id) FROM st)),
fo AS (SELECT id, {FOLDER} AS f FROM gn)
SELECT start, al.id, status, status = 'confirmed' OR len(list_intersect(a.f, b.f)) > 0 AS related FROM al JOIN fo a ON a.id = al.id JOIN fo b ON b.id = al.start"""),
    ),
    "entry_chains": (
        lambda s, d: (lambda n: T.entry_chains(G.intra_repo_calls(E(s, d), n), n))(N(s, d, *BASIC)),
        sql("SELECT DISTINCT a.src AS entry, a.dst AS service, b.dst AS repository FROM intra a LEFT JOIN intra b ON b.src = a.dst AND b.from_layer = 'service' AND b.to_layer = 'repository' WHERE a.from_layer = 'controller' AND a.to_layer = 'service'"),
    ),
    "graph_invariants": (
        invariants,
        sql("SELECT unnest(['no name', 'no repo', 'empty layer', 'deleted before created', 'class without repo']) AS rule, unnest([count(*) FILTER (name IS NULL), count(*) FILTER (repo IS NULL), count(*) FILTER (layer = ''), count(*) FILTER (deleted_at < created_at), count(*) FILTER (type = 'class' AND repo IS NULL)]) AS nodes FROM gn"),
    ),
    "summary_prompts": (
        lambda s, d: enrich.wanted(N(s, d, "type", "name", "language", "summary", "code_snippet", "deleted_at")).select("id", F.md5(X.summary_prompt("type", "name", "language", "code_snippet")).alias("prompt")),
        sql("SELECT id, md5('Summarise the ' || coalesce(type, 'node') || ' ''' || coalesce(name, '') || ''' in one sentence and give tags and a complexity as JSON.' || chr(10) || 'Language: ' || coalesce(language, 'unknown') || chr(10) || chr(10) || substr(coalesce(code_snippet, ''), 1, 4000)) AS prompt FROM ln WHERE summary IS NULL AND type IN ('class', 'interface', 'function', 'method', 'file', 'enum')"),
    ),
    "semantic_doc_candidates": (candidates, None),
}

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items() if q}
