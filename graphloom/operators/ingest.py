"""From file texts to graph rows: nodes of files, members, documents and sections, and the edges between them.

``nodes_of`` and ``edges_of`` take RawNode rows of type ``file``; they are what a full run, an incremental run and the
stream apply.  Names are resolved against the nodes of the graph, so that a run over a few files still finds the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import heading_slug, internal_link, language, resolve_link
from graphloom.operators import lifecycle, resolve
from graphloom.operators.search import name_matches
from graphloom.sources import extract, sites
from graphloom.sources.tables import clean_path

# Characters that are kept of the text of a member, and of a document or section.
CODE_CAP, TEXT_CAP = sites.SNIPPET, 4000
EDGE = ("src", "dst", "type", "weight", "unresolved")


def texts(raw: DataFrame) -> DataFrame:
    return raw.where("type = 'file' AND code_snippet IS NOT NULL").select("run_id", "repo", clean_path("file_path").alias("file_path"), "extracted_at", F.regexp_replace("code_snippet", "\r", "").alias("text")).distinct()


def raw_row(kind: Column, name: Column, lang: Column, line_range: Column, signature: Column, snippet: Column) -> list[Column]:
    return [
        "run_id", kind.alias("type"), name.alias("name"), lang.alias("language"), "file_path", "repo", line_range.alias("line_range"), signature.cast("string").alias("signature"),
        snippet.cast("string").alias("code_snippet"), F.create_map().cast("map<string,string>").alias("extra"), "extracted_at",
    ]


def spans(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("start"), last.cast("int").alias("end"))


def raw_members(raw: DataFrame, scanned: DataFrame) -> DataFrame:
    """RawNode rows of the members: signature is the first line, the snippet at most CODE_CAP characters of their lines."""
    lines = texts(raw).select("run_id", "repo", "file_path", "extracted_at", F.split("text", "\n").alias("lines"))
    m = sites.members(scanned).join(lines, ["run_id", "repo", "file_path"])
    text = F.substring(F.array_join(F.slice("lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n"), 1, CODE_CAP)
    return m.select(*raw_row(F.col("kind"), F.col("name"), F.col("language"), spans(F.col("first"), F.col("last")), F.col("signature"), text))


def markdown(raw: DataFrame) -> DataFrame:
    """(run_id, repo, file_path, extracted_at, doc_id, text) of the Markdown files."""
    return texts(raw).where(language("file_path") == "markdown").withColumn("doc_id", F.concat_ws(":", F.lit("doc"), "repo", "file_path"))


def section_texts(docs: DataFrame) -> DataFrame:
    """(…, title, slug, content) of the sections: the text from a heading to the next, the first of a slug in a document."""
    parts = F.split(extract.without_fences(F.concat(F.lit("\n"), F.col("text"))), r"\n(?=#{1,4} )")
    found = docs.select("run_id", "repo", "file_path", "extracted_at", "doc_id", F.posexplode(parts).alias("no", "part")).where(F.col("part").rlike("^#{1,4} "))
    title = F.trim(F.regexp_replace(F.substring_index("part", "\n", 1), "^#+", ""))
    rows = found.select("run_id", "repo", "file_path", "extracted_at", "doc_id", "no", title.alias("title"), heading_slug(title).alias("slug"), F.trim(F.regexp_replace("part", r"^[^\n]*\n?", "")).alias("content"))
    cells = ("no", "title", "content", "extracted_at")
    return rows.groupBy("run_id", "repo", "file_path", "doc_id", "slug").agg(F.min(F.struct(*cells)).alias("r")).select("run_id", "repo", "file_path", "doc_id", "slug", "r.title", "r.content", "r.extracted_at")


def nodes_of(raw: DataFrame, scanned: DataFrame) -> DataFrame:
    """Normalised nodes of the files of raw: files, members, documents and their sections."""
    docs, none = markdown(raw), F.lit(None)
    name = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    documents = docs.select(*raw_row(F.lit("document"), name, F.lit("markdown"), spans(F.lit(1), F.size(F.split("text", "\n"))), none, F.substring("text", 1, TEXT_CAP)))
    sections = section_texts(docs).select(*raw_row(F.lit("section"), F.col("title"), F.lit("markdown"), spans(none, none), none, F.substring("content", 1, TEXT_CAP)))
    columns = documents.columns
    return lifecycle.normalised(raw.select(columns).unionByName(raw_members(raw, scanned)).unionByName(documents).unionByName(sections), True)


def registry(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.where(F.col("type").isin(*types) & F.col("deleted_at").isNull()).select("repo", F.col("file_path").alias("file"), "name", "id")


def edges_of(raw: DataFrame, scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type, weight, unresolved) of the files of raw, resolved against the nodes of the graph."""
    facts = extract.facts(raw).where("kind = 'import'").select("repo", F.col("file_path").alias("path"), F.col("name").alias("import_path"))
    files = nodes.where("type = 'file' AND deleted_at IS NULL").select("repo", F.col("file_path").alias("path"), "id")
    out = [resolve.resolve_imports(facts, files).withColumn("type", F.lit("IMPORTS"))]
    for kind, types in (("CALLS", ("function",)), ("INHERITS", ("class", "interface")), ("IMPLEMENTS", ("class", "interface"))):
        named = sites.sites(scanned, kind).select("repo", "from_file", "from_name", "target", "weight").distinct()
        out.append(resolve.resolve_names(named, registry(nodes, *types)).withColumn("type", F.lit(kind)))
    docs = markdown(raw)
    parts = section_texts(docs).withColumn("section", F.concat_ws("#", "doc_id", "slug"))
    out.append(parts.select(F.col("doc_id").alias("src"), F.col("section").alias("dst"), F.lit("HAS_SECTION").alias("type"), F.lit(1.0).alias("weight"), F.lit(False).alias("unresolved")))
    code = nodes.where("deleted_at IS NULL AND type IN ('class', 'function')").select("id", "name", "repo")
    out.append(name_matches(parts, "section", F.col("content"), code, "repo").select(F.col("section").alias("src"), F.col("id").alias("dst"), F.lit("MENTIONS").alias("type"), F.lit(0.8).alias("weight"), F.lit(False).alias("unresolved")))
    found = extract.links(docs).join(docs.select("doc_id", "repo", "file_path").distinct(), "doc_id").where(internal_link("target"))
    out.append(found.select(F.col("doc_id").alias("src"), F.concat_ws(":", F.lit("doc"), "repo", resolve_link("target", "file_path")).alias("dst"), F.lit("LINKS_TO").alias("type"), F.lit(1.0).alias("weight"), F.lit(False).alias("unresolved")))
    rows = out[0].select(*EDGE)
    for x in out[1:]:
        rows = rows.unionByName(x.select(*EDGE))
    return rows.where("src <> dst").distinct()


def rename_edges(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """RENAMED_FROM edges of changes (repo, old_path, path): from the old file node to the new one, where both exist."""
    file = nodes.where("type = 'file'").select("repo", F.col("file_path").alias("p"), "id")
    moved = changes.where("old_path IS NOT NULL").select("repo", "old_path", "path").distinct()
    return (
        moved.join(file.select("repo", F.col("p").alias("old_path"), F.col("id").alias("src")), ["repo", "old_path"])
        .join(file.select("repo", F.col("p").alias("path"), F.col("id").alias("dst")), ["repo", "path"])
        .select("src", "dst", F.lit("RENAMED_FROM").alias("type"), F.lit(1.0).alias("weight"), F.lit(False).alias("unresolved")).where("src <> dst").distinct()
    )


def renamed(nodes: DataFrame) -> DataFrame:
    """(repo, old_path, path) of files that went while a file of the same content and repo lives elsewhere: the first by path."""
    f = nodes.where("type = 'file' AND file_hash IS NOT NULL").select("repo", "file_hash", "file_path", "deleted_at")
    new = f.where("deleted_at IS NULL").groupBy("repo", "file_hash").agg(F.min("file_path").alias("path"))
    return f.where("deleted_at IS NOT NULL").select("repo", "file_hash", F.col("file_path").alias("old_path")).join(new, ["repo", "file_hash"]).select("repo", "old_path", "path").where("old_path <> path").distinct()


def dropped_members(nodes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Live members of the files of ``new`` that ``new`` no longer holds get deleted_at."""
    files = new.where("type = 'file'").select("repo", "file_path").distinct().withColumn("again", F.lit(True))
    held = new.select("id").distinct().withColumn("held", F.lit(True))
    gone = F.coalesce(F.col("again"), F.lit(False)) & F.col("held").isNull() & F.col("deleted_at").isNull()
    return nodes.join(files, ["repo", "file_path"], "left").join(held, "id", "left").withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at"))).drop("again", "held")
