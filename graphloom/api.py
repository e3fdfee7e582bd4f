"""The tools over one graph: thin compositions of the operators.

Tools that answer with one object return a dict or None, the others a DataFrame; nothing but the few rows of an answer
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import enrich, ingest, lifecycle, resolve, search, traversal
from graphloom.operators import graph as G
from graphloom.sources import files, sites
from graphloom.session import cut
from graphloom.sources.tables import clean_path, table


class CodeGraph:
    def __init__(self, nodes: DataFrame, edges: DataFrame, repos: DataFrame | None = None, vectors: DataFrame | None = None, provider=enrich.HashedWords):
        """Views of nodes and edges (operators.graph), repo rows, and (id, embedding) of nodes where there are any."""
        self.spark = nodes.sparkSession
        self.nodes, self.edges, self.repos, self.vectors, self.provider = nodes, edges, repos, vectors, provider

    @classmethod
    def load(cls, spark: SparkSession, directory: str) -> CodeGraph:
        return cls(G.nodes_view(table(spark, directory, "nodes")), G.edges_view(table(spark, directory, "edges")), table(spark, directory, "repos"))

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    # -- reads
    def find_nodes(self, query: str, types=None, repos=None, layers=None, limit: int = 10, use_semantic: bool = True) -> DataFrame:
        """Keyword and vector hits, each three times over-fetched, fused by rank; documents only where all types are."""
        docs = bool(types) and set(types) <= set(G.DOC_TYPES)
        pool = G.select_nodes(G.live(self.nodes), repos, types, None if docs else layers)
        text = F.concat_ws(" ", "name", F.regexp_replace("name", "([a-z0-9])([A-Z])", "$1 $2"), "summary", *(["code_snippet"] if docs else ["signature"]))
        q = self.spark.createDataFrame([(query, query)], "query string, q string")
        lists = [search.bm25(pool, "id", text, q, 3 * limit)]
        if use_semantic and self.vectors is not None:
            vector = self.provider().embed([query])[0].tolist()
            near = search.knn(self.vectors, "id", "embedding", self.spark.createDataFrame([(query, vector)], "query string, vector array<double>"), 3 * limit)
            lists.append(near.join(pool.select("id"), "id", "left_semi"))
        ranked = search.fuse(lists, "id", limit) if len(lists) > 1 else lists[0].where(F.col("rank") <= limit)
        return G.shaped(self.nodes).join(ranked.select("id", "score", "rank"), "id").orderBy("rank")

    def get_node(self, id: str, include_neighbors: bool = True, neighbor_edge_types=None, max_neighbors: int = 20) -> dict | None:
        row = G.shaped(self.nodes.where(F.col("id") == id), 2000).first()
        if row is None:
            return None
        out = row.asDict()
        if include_neighbors:
            found = G.neighbours(self.edges, self.nodes, self._ids(id), neighbor_edge_types, most=max_neighbors)
            out["neighbors"] = [r.asDict() for r in found.orderBy("edge_type", "name", "neighbour").collect()]
        return out

    def impact_analysis(self, id: str, max_depth: int = 3, include_tests: bool = True, include_docs: bool = True, most: int = 100) -> dict | None:
        """Callers and called within the depth, tests and documents: the first ``most`` of each, as the answer is one object."""
        if self.nodes.where(F.col("id") == id).isEmpty():
            return None
        start = self._ids(id)
        both = {k: traversal.impact(self.edges, self.nodes, start, max_depth, k == "upstream") for k in ("upstream", "downstream")}
        out = {"target": id} | {k: [r.asDict() for r in v.collect()] for k, v in both.items()}
        out["layer_breakdown"] = {}
        for r in out["upstream"] + out["downstream"]:
            if r["layer"]:
                out["layer_breakdown"][r["layer"]] = out["layer_breakdown"].get(r["layer"], 0) + 1
        if include_tests:
            out["tests"] = [r.asDict() for r in self.find_tests_for(id, 0.0).limit(most).collect()]
        if include_docs:
            out["docs"] = [r.asDict() for r in self.find_docs_for(id).limit(most).collect()]
        return out

    def trace_call_chain(self, from_id: str, to_id: str, max_depth: int = 6, edge_types=("CALLS", "INSTANTIATES")) -> dict | None:
        if from_id == to_id:
            return None
        row = traversal.call_chains(self.edges, self._ids(from_id), max_depth, edge_types, self._ids(to_id)).first()
        if row is None:
            return None
        names = {r["id"]: r for r in self.nodes.where(F.col("id").isin(*row["path"].split(">"))).select("id", "name", "type").collect()}
        return {"chain": [names[i].asDict() for i in row["path"].split(">") if i in names], "depth": row["depth"]}

    def find_tests_for(self, id: str, min_weight: float = 0.5) -> DataFrame:
        return G.sources_of(self.edges.where(F.col("dst") == id), self.nodes, ["TESTS"], min_weight).orderBy(F.desc("score"), "id")

    def find_docs_for(self, id: str, min_weight: float = 0) -> DataFrame:
        return G.sources_of(self.edges.where(F.col("dst") == id), self.nodes, ["MENTIONS", "DOCUMENTS"], min_weight or None).orderBy(F.desc("score"), "id")

    def find_code_for(self, id: str, min_weight: float = 0) -> DataFrame:
        return G.targets_of(self.edges.where(F.col("src") == id), self.nodes, ["MENTIONS", "DOCUMENTS"], min_weight or None).orderBy(F.desc("score"), "id")

    def semantic_search(self, query: str, scope: str = "all", top_k: int = 10, repos=None) -> DataFrame:
        known = {"code": ~F.col("type").isin(*G.DOC_TYPES), "docs": F.col("type").isin(*G.DOC_TYPES), "all": F.lit(True)}
        pool = G.select_nodes(self.nodes, repos).where(known.get(scope, F.lit(False)))
        if self.vectors is None:
            return G.shaped(pool.limit(0)).withColumn("score", F.lit(0.0))
        vector = self.provider().embed([query])[0].tolist()
        near = search.knn(self.vectors.join(pool.select("id"), "id", "left_semi"), "id", "embedding", self.spark.createDataFrame([(query, vector)], "query string, vector array<double>"), top_k)
        return G.shaped(self.nodes).join(near.select("id", "score", "rank"), "id").orderBy("rank").drop("rank")

    def list_layers(self, repo: str) -> DataFrame:
        return G.layers(self.nodes.where(F.col("repo") == repo)).orderBy("name")

    def get_diff(self, repo: str, base_commit: str, head_commit: str) -> DataFrame:
        pair = self.spark.createDataFrame([(repo, base_commit, head_commit)], "repo string, base string, head string")
        return lifecycle.diff(self.nodes, pair)

    def list_projects(self) -> DataFrame:
        return G.projects(self.repos, self.nodes, self.edges).orderBy(F.desc("last_ingest_at"), "slug")

    def repo_state(self, slug: str) -> dict:
        row = self.repos.where(F.lower(F.coalesce("slug", "name")) == slug.lower()).orderBy("id").first()
        count = self.nodes.where(F.lower("repo") == slug.lower()).count()
        return {"slug": slug, "exists": row is not None, "last_commit_sha": row["last_commit_sha"] if row else None, "node_count": count}

    def get_architecture(self, repo: str) -> dict[str, DataFrame]:
        n = self.nodes.where(F.col("repo") == repo)
        names = [r[0] for r in G.layers(n).select("name").orderBy("name").collect()]
        entry = "controller" if "controller" in names else (names or ["controller"])[0]
        return {"layers": G.layers(n), "entry_points": G.entry_points(self.edges, n, entry), "hotspots": G.hotspots(self.edges, n), "layer_flows": G.layer_flows(self.edges, n)}

    def find_dead_code(self, repo: str, entry_layer: str = "controller", limit: int = 50) -> dict:
        n = self.nodes.where(F.col("repo") == repo)
        dead, counters = traversal.dead_code(G.intra_repo_calls(self.edges, n), n, entry_layer)
        row = counters.first()
        return (row.asDict() if row else {}) | {"rows": [r.asDict() for r in dead.orderBy("file_path", "name", "id").limit(limit).collect()]}

    # -- writes: each returns the new tables, to be stored as a generation
    def ingest_repo(self, root: str, repo: str, commit: str, patterns=files.PATTERNS, changed: DataFrame | None = None, now=None) -> CodeGraph:
        """Read a checkout, extract, resolve and merge files, members, documents, sections and their edges.

        With ``changed`` (status, path, old_path) only those files are read: deleted and renamed ones are soft-deleted with
        their members, members that a changed file no longer has too, renames get an edge; changes that concern no file of
        the patterns leave the graph as it is.  A full run soft-deletes what the checkout no longer has.
        """
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        if changed is not None:
            ends = F.lower(F.regexp_extract(F.coalesce("path", "old_path"), r"\.(\w+)$", 1)).isin(*files.extensions(patterns))
            changed = changed.select("status", clean_path("path").alias("path"), clean_path("old_path").alias("old_path")).where(ends).distinct()
            if changed.isEmpty():
                return self
        found = files.listed(self.spark, root, patterns)
        if changed is not None:
            found = found.join(changed.where("status <> 'D'").select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
        return self._merged(found, repo, commit, now, changed)

    def _merged(self, found: DataFrame, repo: str, commit: str, now, changed: DataFrame | None) -> CodeGraph:
        raw = cut(files.raw_files(found, repo, commit))
        scanned = cut(sites.scanned(raw))
        new = cut(ingest.nodes_of(raw, scanned))
        nodes = lifecycle.upsert_nodes(self.nodes, new, F.lit(commit), now).drop("action")
        edges = self.edges
        if changed is not None:
            gone = changed.select(F.lit(repo).alias("repo"), F.when(F.col("status") == "D", F.col("path")).otherwise(F.col("old_path")).alias("file_path")).where("file_path IS NOT NULL")
            nodes = ingest.dropped_members(lifecycle.soft_delete_files(nodes, gone, now), new, now)
            edges = lifecycle.upsert_edges(edges, ingest.rename_edges(nodes, changed.withColumn("repo", F.lit(repo))), now)
        else:
            nodes = lifecycle.soft_delete_unseen(nodes, self.spark.createDataFrame([(repo, commit)], "repo string, head string"), now)
        edges = lifecycle.upsert_edges(edges, ingest.edges_of(raw, scanned, nodes), now)
        return CodeGraph(nodes, edges, self.repos, self.vectors, self.provider)

    def reindex_file(self, root: str, repo: str, path: str, commit: str, now=None) -> CodeGraph:
        """Read one file again; nothing else of the checkout is listed or opened."""
        now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
        one = self.spark.createDataFrame([("M", path, None)], "status string, path string, old_path string")
        return self._merged(files.one(self.spark, root, path), repo, commit, now, one)

    def feature_template(self, description: str, repo: str, top_k: int = 8) -> dict[str, DataFrame]:
        """For a new feature: the layers of the repo, the code nearest to its description, what that touches, and the contracts (interfaces) it rests on."""
        n = self.nodes.where(F.col("repo") == repo)
        here = CodeGraph(n, self.edges, self.repos, self.vectors, self.provider)
        near = here.semantic_search(description, "code", top_k) if self.vectors is not None else here.find_nodes(description, limit=top_k, use_semantic=False)
        near = cut(near)
        around = G.neighbours(self.edges, n, near.select("id"), most=20)
        kind = n.select(F.col("id").alias("neighbour"), F.col("type").alias("kind"))
        contracts = around.join(kind.where("kind = 'interface'"), "neighbour", "left_semi").unionByName(around.where("edge_type IN ('IMPLEMENTS', 'INHERITS')")).distinct()
        return {"layers": G.layers(n), "nearest": near, "around": around, "contracts": contracts}

    def refresh_summaries(self, repo: str | None = None, node_ids: list[str] | None = None, only_if_missing: bool = True, limit: int = 500, provider=enrich.RuleSummaries) -> DataFrame:
        n = self.nodes if repo is None else self.nodes.where(F.col("repo") == repo)
        picked = enrich.wanted(n, node_ids, only_if_missing).orderBy("id").limit(limit)
        return enrich.summaries(picked.withColumnRenamed("code_snippet", "text"), provider)

    def delete_repo(self, slug: str, confirm: bool = False) -> CodeGraph:
        nodes, edges = lifecycle.delete_repos(self.nodes, self.edges, [slug], confirm)
        return CodeGraph(nodes, edges, self.repos, self.vectors, self.provider)

    def run_test_map(self, repo: str, min_weight: float = 0.5) -> DataFrame:
        n = self.nodes.where(F.col("repo") == repo)
        return resolve.test_links(self.edges.where("type = 'CALLS'"), n, min_weight)

    def refresh_doc_links(self, repo: str, min_confidence: float = 0.3, judge=None) -> DataFrame:
        """Links of sections to code: by name and, where there are vectors, by likeness; ``judge`` makes the confidence."""
        n = self.nodes.where(F.col("repo") == repo)
        sections = n.where("type = 'section' AND code_snippet IS NOT NULL").select(F.col("id").alias("section"), "repo", F.col("code_snippet").alias("text"))
        return resolve.document_links(sections, n, min_confidence, self.vectors, judge)
