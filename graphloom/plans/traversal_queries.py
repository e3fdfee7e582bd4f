"""Queries of traversal and search, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import graph as G
from graphloom.operators import search as S
from graphloom.operators import traversal as T
from graphloom.plans.graph_queries import BASIC, E, N, sql
from graphloom.sources.tables import table


def hottest(s, d, n=1):
    """The busiest function of every repo."""
    return G.hotspots(E(s, d), N(s, d, *BASIC), n).select("id")


def impacted(up):
    return lambda s, d: T.impact(E(s, d), N(s, d, *BASIC), hottest(s, d, 3), 3, up)


def dead(part):
    def run(s, d):
        n = N(s, d, *BASIC)
        return T.dead_code(G.intra_repo_calls(E(s, d), n), n)[part]

    return run


HOT = "hot AS (SELECT id FROM ln JOIN deg USING (id) WHERE repo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo ORDER BY degree DESC, id) <= {n})"
CALLS = "ce AS (SELECT DISTINCT src, dst FROM ge WHERE type = 'CALLS' AND src <> dst)"


def recursive(body: str) -> str:
    return "WITH RECURSIVE" + sql(body)[4:]


def trail_sql(up: bool, n: int) -> str:
    at, nxt = ("dst", "src") if up else ("src", "dst")
    path = "list_reverse(path)" if up else "path"
    return f""", {HOT.format(n=n)}, {CALLS},
tr AS (SELECT id AS start, id AS at, 0 AS depth, [id] AS path, []::VARCHAR[] AS used FROM hot
  UNION ALL SELECT start, c.{nxt}, depth + 1, list_append(path, c.{nxt}), list_append(used, c.{at} || '>' || c.{nxt}) FROM tr JOIN ce c ON c.{at} = tr.at WHERE depth < 3 AND NOT list_contains(used, c.{at} || '>' || c.{nxt})),
imp AS (SELECT start, n.id, name, layer, depth, array_to_string({path}, '>') AS path FROM tr JOIN ln n ON n.id = tr.at WHERE depth > 0)"""


def chain_sql() -> str:
    return f""", {HOT.format(n=1)}, {CALLS},
ch AS (SELECT id AS start, id AS at, 0 AS depth, id AS path FROM hot
  UNION ALL SELECT start, c.dst, depth + 1, path || '>' || c.dst FROM ch JOIN ce c ON c.src = ch.at WHERE depth < 6 AND NOT contains('>' || path || '>', '>' || c.dst || '>'))
SELECT start, ch.at AS id, depth, min(path) AS path FROM ch WHERE depth > 0 GROUP BY start, ch.at, depth QUALIFY depth = min(depth) OVER (PARTITION BY start, ch.at)"""


REACH = ", re AS (SELECT id FROM ln WHERE layer = 'controller' UNION SELECT i.dst FROM re JOIN intra i ON i.src = re.id)"


def text_queries(s, d):
    """Every fiftieth document asks for itself with its whole text."""
    return table(s, d, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL").select(F.col("doc_id").alias("query"), F.col("text").alias("q"))


def docs_ranked(s, d, most=10):
    return S.bm25_texts(table(s, d, "documents").where("text IS NOT NULL"), "doc_id", F.col("text"), text_queries(s, d), most)


def vectors_ranked(s, d, most=10):
    v = table(s, d, "embeddings")
    return S.knn(v, "vec_id", "embedding", v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), most)


def vector_filtered(s, d):
    """Nearest thirty, then only those of the query's label."""
    v = table(s, d, "embeddings")
    label = v.select("vec_id", "label")
    near = vectors_ranked(s, d, 30).join(label, "vec_id").join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("asked")), "query")
    return near.where("label = asked").select("query", "vec_id", "score", "rank")


def hybrid(s, d):
    """Documents and vectors share ids where both have them; the two rankings are fused."""
    a = docs_ranked(s, d, 30)
    b = vectors_ranked(s, d, 30).withColumnRenamed("vec_id", "doc_id")
    return S.fuse([a, b], "doc_id")


def node_search(s, d):
    """Nodes by name, name parts, summary and signature; the queries are the names of the layers."""
    n = G.live(N(s, d, "name", "summary", "signature", "layer", "deleted_at"))
    q = n.where("layer IS NOT NULL").select(F.col("layer").alias("query"), F.col("layer").alias("q")).distinct()
    split = F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2")
    return S.bm25(n, "id", F.concat_ws(" ", "name", split, "summary", "signature"), q)


def section_search(s, d):
    """Documents and sections by name and text; the queries are the names of the sections."""
    n = G.live(N(s, d, "type", "name", "code_snippet", "deleted_at")).where(F.col("type").isin(*G.DOC_TYPES))
    q = n.where("type = 'section' AND name IS NOT NULL").select(F.col("name").alias("query"), F.col("name").alias("q")).distinct()
    return S.bm25(n, "id", F.concat_ws(" ", "name", "code_snippet"), q)


WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25_sql(name: str, docs: str, key: str, asked: str, most: int) -> str:
    return f"""{name}_d AS (SELECT {key}, {WORDS.format('t')} AS w FROM ({docs})),
{name}_p AS (SELECT {key}, len(w) AS size, unnest(w) AS term FROM {name}_d),
{name}_t AS (SELECT {key}, term, count(*) AS tf, any_value(size) AS size FROM {name}_p GROUP BY {key}, term),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY term),
{name}_q AS (SELECT query, unnest(list_distinct({WORDS.format('q')})) AS term FROM ({asked})),
{name}_s AS (SELECT query, {key}, round(sum(ln(1 + ((SELECT count(*) FROM {name}_d) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (SELECT avg(len(w)) FROM {name}_d)))), 6) AS score
  FROM {name}_t JOIN {name}_f USING (term) JOIN {name}_q USING (term) GROUP BY query, {key}),
{name} AS (SELECT query, {key}, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, {key}) AS rank FROM {name}_s QUALIFY rank <= {most})"""


def doc_sql(most: int) -> str:
    return bm25_sql("docs", "SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL", "doc_id", "SELECT doc_id AS query, text AS q FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL", most)


def vec_sql(most: int) -> str:
    return f"vecs AS (SELECT a.vec_id AS query, b.vec_id, round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round((1 + list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / 2, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= {most})"


NODE_TEXT = "concat_ws(' ', name, regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), summary, signature)"

PAIRS: dict[str, tuple] = {
    "impact_upstream": (impacted(True), recursive(f"{trail_sql(True, 3)} SELECT * FROM imp QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, name, id, path) <= 100")),
    "impact_downstream": (impacted(False), recursive(f"{trail_sql(False, 3)} SELECT * FROM imp QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, name, id, path) <= 100")),
    "impact_layer_breakdown": (
        lambda s, d: T.layer_breakdown(E(s, d), N(s, d, *BASIC), hottest(s, d, 3)),
        recursive(f"{trail_sql(True, 3)}, " + trail_sql(False, 3).split(CALLS + ",")[1].replace("tr AS", "td AS").replace("FROM tr JOIN", "FROM td JOIN").replace("tr.at", "td.at").replace("imp AS", "imq AS").strip() + " SELECT start, 'upstream' AS direction, layer, count(*) AS paths FROM imp WHERE layer IS NOT NULL GROUP BY start, layer UNION ALL SELECT start, 'downstream', layer, count(*) FROM imq WHERE layer IS NOT NULL GROUP BY start, layer"),
    ),
    "trace_call_chain": (lambda s, d: T.call_chains(E(s, d), hottest(s, d)).where("id <> start"), recursive(chain_sql())),
    "reachable_set": (
        lambda s, d: (lambda n: T.reachable(G.intra_repo_calls(E(s, d), n), n.where("deleted_at IS NULL AND layer = 'controller'")))(N(s, d, *BASIC)),
        recursive(f"{REACH} SELECT id FROM re"),
    ),
    "dead_code_nodes": (dead(0), recursive(f"{REACH} SELECT id, name, repo, layer, file_path FROM ln WHERE type = 'function' AND id NOT IN (SELECT id FROM re)")),
    "dead_code_stats": (
        dead(1),
        recursive(f"{REACH} SELECT f.repo, coalesce(any_value(c.n), 0) AS entry_points, count(*) AS total, count(re.id) AS reachable, count(*) - count(re.id) AS unreachable FROM ln f LEFT JOIN re ON re.id = f.id LEFT JOIN (SELECT repo, count(*) AS n FROM ln WHERE layer = 'controller' GROUP BY repo) c ON c.repo = f.repo WHERE f.type = 'function' GROUP BY f.repo"),
    ),
    "fulltext_docs": (docs_ranked, f"WITH {doc_sql(10)} SELECT * FROM docs"),
    "fulltext_code": (node_search, sql(", " + bm25_sql("docs", f"SELECT id, {NODE_TEXT} AS t FROM ln", "id", "SELECT DISTINCT layer AS query, layer AS q FROM ln WHERE layer IS NOT NULL", 10) + " SELECT * FROM docs")),
    "fulltext_sections": (section_search, sql(", " + bm25_sql("docs", "SELECT id, concat_ws(' ', name, code_snippet) AS t FROM ln WHERE type IN ('document', 'section')", "id", "SELECT DISTINCT name AS query, name AS q FROM ln WHERE type = 'section' AND name IS NOT NULL", 10) + " SELECT * FROM docs")),
    "vector_topk": (vectors_ranked, f"WITH {vec_sql(10)} SELECT * FROM vecs"),
    "vector_topk_postfilter": (vector_filtered, f"WITH {vec_sql(30)} SELECT query, vecs.vec_id, score, rank FROM vecs JOIN embeddings a ON a.vec_id = vecs.vec_id JOIN embeddings b ON b.vec_id = query WHERE a.label = b.label"),
    "hybrid_rrf": (
        hybrid,
        f"WITH {doc_sql(30)}, {vec_sql(30)}, f AS (SELECT query, doc_id, round(sum(1 / (60.0 + rank)), 6) AS score FROM (SELECT query, doc_id, rank FROM docs UNION ALL SELECT query, vec_id, rank FROM vecs) GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10",
    ),
}

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items()}
