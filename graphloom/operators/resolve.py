"""Resolution of calls, bases and imports, and of places to the scopes that hold them.

All are equi-joins on (repo, file, name) or (repo, name); registries are ordinary DataFrames, so Catalyst broadcasts
them only when their measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import collapse
from graphloom.sources.tables import clean_path


def resolve_names(sites: DataFrame, registry: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """(src, dst, unresolved, weight) of sites (repo, from_file, from_name, target, weight) against (repo, file, name, id).

    The source must be known by file and name.  The target is the node of that name in the same file, else every node of
    that name in the repo, marked unresolved.  Edges to itself are dropped; of several sites of a pair the first by weight
    and resolution stays.  ``changed`` (repo, from_file) limits the sites, never the registry.
    """
    if changed is not None:
        sites = sites.join(changed.select("repo", "from_file").distinct(), ["repo", "from_file"], "left_semi")
    r = registry.select("repo", "file", "name", "id").distinct()
    src = r.groupBy("repo", F.col("file").alias("from_file"), F.col("name").alias("from_name")).agg(F.min("id").alias("src"))
    near = r.groupBy("repo", F.col("file").alias("from_file"), F.col("name").alias("target")).agg(F.min("id").alias("near"))
    far = r.select("repo", F.col("name").alias("target"), F.col("id").alias("far"))
    s = sites.distinct().join(src, ["repo", "from_file", "from_name"]).join(near, ["repo", "from_file", "target"], "left")
    same = s.where("near IS NOT NULL").select("src", F.col("near").alias("dst"), F.lit(False).alias("unresolved"), "weight")
    other = s.where("near IS NULL").join(far, ["repo", "target"]).select("src", F.col("far").alias("dst"), F.lit(True).alias("unresolved"), "weight")
    return same.unionByName(other).where("src <> dst").groupBy("src", "dst").agg(F.min("unresolved").alias("unresolved"), F.max("weight").alias("weight"))


# What a relative import may leave out, in the order in which it is tried.
PROBES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js"]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst, unresolved, weight) of imports (repo, path, import_path) against files (repo, path, id).

    Relative paths are collapsed and tried with each probe; the first file found wins.  Everything else becomes a module.
    """
    relative = F.col("import_path").rlike(r"^\.\.?/")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    base = collapse(F.concat(folder, F.col("import_path")))
    tries = F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.col("base"), F.lit(p)).alias("target")) for k, p in enumerate(PROBES)])
    rows = imports.distinct().withColumn("base", F.when(relative, base))
    hit = (
        rows.where("base IS NOT NULL").select("repo", "path", "import_path", F.explode(tries).alias("t")).select("repo", "path", "import_path", "t.k", "t.target")
        .join(files.select("repo", F.col("path").alias("target"), F.col("id").alias("dst")), ["repo", "target"])
        .groupBy("repo", "path", "import_path").agg(F.min_by("dst", F.struct("k", "dst")).alias("dst"))
    )
    src = F.concat_ws(":", F.lit("file"), "repo", "path")
    module = F.concat_ws(":", F.lit("module"), "repo", "import_path")
    return (
        rows.join(hit, ["repo", "path", "import_path"], "left")
        .select(src.alias("src"), F.coalesce("dst", module).alias("dst"), F.col("dst").isNull().alias("unresolved"), F.when(F.col("dst").isNull(), 0.7).otherwise(1.0).alias("weight"))
        .distinct()
    )


def innermost_scope(sites: DataFrame, scopes: DataFrame) -> DataFrame:
    """(site, scope) of sites (site, repo, path, line) in scopes (scope, repo, path, start, end): the smallest span that holds the line."""
    held = sites.join(scopes, ["repo", "path"]).where((F.col("start") <= F.col("line")) & (F.col("line") <= F.col("end")))
    return held.groupBy("site").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "start", "scope")).alias("best")).select("site", "best.scope")


# ---- tests and documents
def test_links(calls: DataFrame, nodes: DataFrame, least: float = 0.5) -> DataFrame:
    """(src, dst, weight) from test nodes to production nodes of a repo.

    By calls (0.9), by file name without its test suffix (0.7), by mirrored path (0.6); a pair keeps its largest weight.
    """
    from graphloom.functions.text import mirror_path, stem, strip_test_suffix
    from graphloom.operators.graph import test_path

    n = nodes.where("deleted_at IS NULL AND type IN ('class', 'function', 'file')").select("id", "type", "repo", "file_path").where("file_path IS NOT NULL")
    tests, prod = n.where(test_path(F.col("file_path"))), n.where(~test_path(F.col("file_path")))
    by_call = (
        calls.select("src", "dst").join(tests.select(F.col("id").alias("src"), "repo"), "src").join(prod.select(F.col("id").alias("dst"), F.col("repo").alias("r")), "dst").where("repo = r")
        .select("src", "dst", F.lit(0.9).alias("weight"))
    )
    tf, pf = tests.where("type = 'file'"), prod.where("type = 'file'")
    by_name = (
        tf.select(F.col("id").alias("src"), "repo", F.lower(strip_test_suffix(stem("file_path"))).alias("base"))
        .join(pf.select(F.col("id").alias("dst"), "repo", F.lower(stem("file_path")).alias("base")), ["repo", "base"])
        .select("src", "dst", F.lit(0.7).alias("weight"))
    )
    by_path = (
        tf.select(F.col("id").alias("src"), "repo", mirror_path("file_path").alias("target")).where("target IS NOT NULL")
        .join(pf.select(F.col("id").alias("dst"), "repo", F.col("file_path").alias("target")), ["repo", "target"])
        .select("src", "dst", F.lit(0.6).alias("weight"))
    )
    return by_call.unionByName(by_name).unionByName(by_path).groupBy("src", "dst").agg(F.max("weight").alias("weight")).where(F.col("weight") >= least)


# Fixed value: the confidence of a link between a section and a symbol that it names.
UNJUDGED = 0.5


# What a judge sees of a section, and how many of the nearest members are candidates.
JUDGED, NEAREST = 1500, 10


def document_links(sections: DataFrame, nodes: DataFrame, least: float = 0.3, vectors: DataFrame | None = None, judge=None) -> DataFrame:
    """(src, dst, confidence): sections (section, repo, text) and the classes or functions of their repo that they describe.

    Candidates are the members that a section names, and with ``vectors`` (id, embedding, of sections and members) the
    NEAREST members of its repo.  ``judge``, made once per worker, has ``confidence(list of dicts) -> list of float``; where
    there is none or it fails, every candidate has UNJUDGED.
    """
    from graphloom.operators.search import knn, name_matches

    names = nodes.where("deleted_at IS NULL AND type IN ('class', 'function')").select("id", "name", "repo")
    found = name_matches(sections, "section", F.col("text"), names, "repo").select("section", "id")
    if vectors is not None:
        asked = vectors.join(sections.select(F.col("section").alias("id"), "repo").distinct(), "id").select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
        near = knn(vectors.join(names.select("id"), "id", "left_semi"), "id", "embedding", asked, NEAREST).select(F.col("query").alias("section"), "id")
        same = near.join(sections.select("section", "repo").distinct(), "section").join(names.select("id", "repo"), ["id", "repo"], "left_semi").select("section", "id")
        found = found.unionByName(same)
    pairs = found.distinct()
    if judge is None:
        return pairs.select(F.col("section").alias("src"), F.col("id").alias("dst"), F.lit(UNJUDGED).alias("confidence")).where(F.col("confidence") >= least)

    def run(batches):
        import pandas as pd

        made = judge()
        for frame in batches:
            try:
                sure = [float(x) for x in made.confidence(frame.to_dict("records"))]
                if len(sure) != len(frame):
                    raise ValueError("one confidence for each pair")
            except Exception:  # a judge may be any service
                sure = [UNJUDGED] * len(frame)
            yield pd.DataFrame({"src": frame["src"], "dst": frame["dst"], "confidence": sure})

    rows = pairs.join(sections.select("section", F.substring("text", 1, JUDGED).alias("text")), "section").join(names.select("id", "name"), "id").select(F.col("section").alias("src"), F.col("id").alias("dst"), "text", "name")
    return rows.mapInPandas(run, "src string, dst string, confidence double").where(F.col("confidence") >= least)


def call_sites(edges: DataFrame, edge_types=("CALLS",)) -> DataFrame:
    """Sites (repo, from_file, from_name, target, weight) as the ids of edges tell them."""
    a, b = F.split(clean_path("from_id"), ":"), F.split(clean_path("to_id"), ":")
    return (
        edges.where(F.col("type").isin(*edge_types) & F.col("to_id").isNotNull())
        .where((F.size(a) >= 4) & (F.size(b) >= 4))
        .select(F.get(a, F.lit(1)).alias("repo"), F.get(a, F.lit(2)).alias("from_file"), F.get(a, F.lit(3)).alias("from_name"), F.get(b, F.lit(3)).alias("target"), "weight")
    )
