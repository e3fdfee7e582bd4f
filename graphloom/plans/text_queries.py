"""Queries of scalar functions, extraction and resolution, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph as G
from graphloom.operators import resolve as R
from graphloom.plans.graph_queries import E, N, TEST_PATH, sql
from graphloom.plans.problem_queries import clean
from graphloom.sources import extract
from graphloom.sources.tables import clean_path, table

RAW_BASE = ("repo", "type", "name", "language", "file_path", "signature")


def raw(s, d):
    return table(s, d, "raw_nodes").select(*RAW_BASE).distinct()


def named(f, *keep):
    return lambda s, d: f(N(s, d, "name", "type", "repo", "file_path", "signature", "layer", "summary"))


def registry(s, d, *types):
    n = table(s, d, "nodes").where(F.col("type").isin(*types) & F.col("deleted_at").isNull())
    return n.select("repo", clean_path("file_path").alias("file"), "name", clean_path("id").alias("id"))


def calls(s, d, changed=None):
    return R.resolve_names(R.call_sites(table(s, d, "edges")), registry(s, d, "function"), changed)


def changed_files(s, d):
    """Files whose node was updated after the last ingest of their repo began."""
    r = table(s, d, "repos").select(F.coalesce("slug", F.lower("name")).alias("repo"), "last_commit_sha").where("last_commit_sha IS NOT NULL")
    f = table(s, d, "nodes").where("type = 'file'").select("repo", clean_path("file_path").alias("from_file"), "last_seen_commit")
    return f.join(r, "repo").where("last_seen_commit = last_commit_sha").select("repo", "from_file").distinct()


def imports(s, d):
    f = extract.facts(table(s, d, "raw_nodes")).where("kind = 'import'").select("repo", F.col("file_path").alias("path"), F.col("name").alias("import_path"))
    files = table(s, d, "raw_nodes").where("type = 'file'").select("repo", clean_path("file_path").alias("path")).distinct()
    return R.resolve_imports(f, files.withColumn("id", F.concat_ws(":", F.lit("file"), "repo", "path")))


def scopes(s, d):
    """Functions in the classes of their file, by line."""
    r = table(s, d, "raw_nodes").where("line_range.start IS NOT NULL AND line_range.end IS NOT NULL").select("run_id", "type", "repo", "name", clean_path("file_path").alias("path"), F.col("line_range.start").alias("start"), F.col("line_range.end").alias("end")).distinct()
    place = F.concat_ws("|", "run_id", "path", "name", "start")
    sites = r.where("type = 'function'").select(place.alias("site"), F.concat_ws("|", "repo", "run_id").alias("repo"), "path", F.col("start").alias("line")).distinct()
    held = r.where("type = 'class'").select(F.concat_ws("|", "name", "start").alias("scope"), F.concat_ws("|", "repo", "run_id").alias("repo"), "path", "start", "end")
    return R.innermost_scope(sites, held)


def section_texts(s, d):
    own = table(s, d, "nodes").where("type = 'section' AND code_snippet IS NOT NULL").select(clean_path("id").alias("section"), "repo", F.col("code_snippet").alias("text")).distinct()
    return own.unionByName(document_texts(s, d).withColumn("section", F.col("section").cast("string")))


def document_texts(s, d):
    return table(s, d, "documents").where("text IS NOT NULL AND repo IS NOT NULL").select(F.col("doc_id").alias("section"), "repo", "text")


def slug_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '-')"


# The rules written out, apart from those of the functions that they check; p is the path in lower case.
LAYERS = r"""
  WHEN regexp_matches(p, '/[^/]*(?:test|spec)[^/]*/|/__tests__/|/e2e/|\.(?:spec|test)\.[a-z]+$') THEN 'test'
  WHEN regexp_matches(p, '/[^/]*(?:component|page|view|guard|directive|pipe|widget|screen)[^/]*/|\.(?:component|guard|directive|pipe|module)\.[a-z]+$') THEN 'component'
  WHEN regexp_matches(p, '/[^/]*(?:store|state|reducer|effect|action|selector)[^/]*/|\.(?:store|reducer|effects?|actions?|selectors?)\.[a-z]+$') THEN 'store'
  WHEN regexp_matches(p, '/[^/]*(?:migration|seed|flyway|liquibase)[^/]*/|/[^/]*(?:initializ|seed)[^/]*\.[a-z]+$') THEN 'migration'
  WHEN regexp_matches(p, '/[^/]*(?:controller|route|handler|hub)[^/]*/') THEN 'controller'
  WHEN regexp_matches(p, '/[^/]*(?:service|logic|resolver)[^/]*/|\.service\.[a-z]+$') THEN 'service'
  WHEN regexp_matches(p, '/[^/]*(?:repositor|repo|persistence|dbcontext)[^/]*/') THEN 'repository'
  WHEN regexp_matches(p, '/[^/]*(?:model|entit|schema|dto|domain|example)[^/]*/') THEN 'model'
  WHEN regexp_matches(p, '/[^/]*(?:validator|validation)[^/]*/') THEN 'validator'
  WHEN regexp_matches(p, '/[^/]*(?:util|helper|common|extension|factor|mapper|constant)[^/]*/|/[^/]*(?:util|helper|common)[^/]*\.[a-z]+$') THEN 'utility'
  WHEN regexp_matches(p, '/[^/]*(?:middleware|interceptor|filter|pipeline|authorization|modelbinder|custommodelbinder)[^/]*/') THEN 'middleware'
  WHEN regexp_matches(p, '/[^/]*(?:config|configuration|setting|properties|injection)[^/]*/|/[^/]*(?:startup)[^/]*\.[a-z]+$') THEN 'config'
  WHEN regexp_matches(p, '/[^/]*(?:exception|error|fault)[^/]*/') THEN 'exception'
  WHEN regexp_matches(name, '(?:Test|Tests|Spec|Fixture|TestBase|TestData|TestHelper|Mock|Stub|Fake)$') THEN 'test'
  WHEN regexp_matches(name, '(?:Component|Guard|Pipe|Directive|Module|Page|Widget|Screen)$') THEN 'component'
  WHEN regexp_matches(name, '(?:Store|Effect|Effects|Reducer|Action|Actions|Selector|Selectors|State|Facade)$') THEN 'store'
  WHEN regexp_matches(name, '(?:Validator|Validation|ValidatorBase|Rule)$') THEN 'validator'
  WHEN regexp_matches(name, '(?:Controller|Handler|Router|Hub)$') THEN 'controller'
  WHEN regexp_matches(name, '(?:Service|Manager|Provider|Processor|Resolver)$') THEN 'service'
  WHEN regexp_matches(name, '(?:Repository|Dao|DbContext|Context|UnitOfWork)$') THEN 'repository'
  WHEN regexp_matches(name, '(?:Model|Entity|Dto|DTO|Response|Request|View|ViewModel|Payload|Event|Command|Query|Example|Result|Output|Input|Summary|Info)$') THEN 'model'
  WHEN regexp_matches(name, '(?:Exception|Error|Fault)$') THEN 'exception'
  WHEN regexp_matches(name, '(?:Util|Utils|Helper|Tool|Common|Extension|Extensions|Factory|Builder|Mapper|Profile|Attribute|Decorator|Converter)$') THEN 'utility'
  WHEN regexp_matches(name, '(?:Middleware|Interceptor|Filter|Pipeline|Behavior)$') THEN 'middleware'
  WHEN regexp_matches(name, '(?:Config|Configuration|Settings|Options|Constant|Constants|Startup)$') THEN 'config'
  WHEN regexp_matches(name, '(?:Migration|Snapshot|Seed|Initialiser|Initializer)$') THEN 'migration'
"""


def layer_sql() -> str:
    return f"CASE WHEN type NOT IN ('class', 'interface', 'function', 'enum') THEN NULL {LAYERS.replace('(p, ', '(lower(' + clean('file_path') + '), ')} END"


RAW = "raw AS (SELECT DISTINCT repo, type, name, language, file_path, signature FROM raw_nodes)"
STEM = "regexp_replace(string_split({0}, '/')[-1], '\\.[^.]*$', '')"
SUFFIX = "(Tests|Test|Spec|\\.spec|\\.test|_test|_tests|_spec)$"
SIG4 = "substr(sha1(trim(regexp_replace(coalesce(signature, ''), '\\s+', ' ', 'g'))), 1, 4)"
EXT = "regexp_extract({0}, '\\.(\\w+)$', 1)"


LANGUAGE = """CASE lower({0}) WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'cs' THEN 'csharp' WHEN 'java' THEN 'java'
  WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' END"""

IMPORT_NAME = r"""CASE language
  WHEN 'python' THEN coalesce(nullif(regexp_extract(text, '^from\s+([\w.]+)\s+import', 1), ''), nullif(regexp_extract(text, '^import\s+([\w.]+)', 1), ''))
  WHEN 'javascript' THEN nullif(regexp_extract(text, '^import\s+.*from\s+[''"]([^''"]+)[''"]', 1), '')
  WHEN 'typescript' THEN nullif(regexp_extract(text, '^import\s+.*from\s+[''"]([^''"]+)[''"]', 1), '')
  WHEN 'java' THEN nullif(regexp_extract(text, '^import\s+(?:static\s+)?([\w.]+)', 1), '')
  WHEN 'csharp' THEN nullif(regexp_extract(text, '^using\s+([\w.]+)\s*;', 1), '')
  WHEN 'go' THEN nullif(regexp_extract(text, '^(?:import\s+|\s+)(?:[\w.]+\s+)?"([\w./-]+)"\s*(?://.*)?$', 1), '') END"""


def imports_sql() -> str:
    return f"""fl AS (SELECT DISTINCT run_id, repo, {clean('file_path')} AS file_path, {LANGUAGE.format(EXT.format(clean('file_path')))} AS language, replace(code_snippet, chr(13), '') AS t FROM raw_nodes WHERE type = 'file' AND code_snippet IS NOT NULL),
ls AS (SELECT repo, file_path, language, unnest(string_split(t, chr(10))) AS text FROM fl WHERE language <> 'markdown'),
facts AS (SELECT DISTINCT repo, file_path, {IMPORT_NAME} AS name FROM ls)"""


def resolve_sql(kinds: str, edge_types: str, changed: bool = False) -> str:
    scope = "" if not changed else """AND (repo, from_file) IN (SELECT (n.repo, """ + clean("n.file_path") + """) FROM nodes n JOIN (SELECT DISTINCT coalesce(slug, lower(name)) AS repo, last_commit_sha FROM repos) r ON r.repo = n.repo WHERE n.type = 'file' AND n.last_seen_commit = r.last_commit_sha)"""
    return f"""r AS (SELECT DISTINCT repo, {clean('file_path')} AS file, name, {clean('id')} AS id FROM nodes WHERE type IN ({kinds}) AND deleted_at IS NULL),
st AS (SELECT DISTINCT a[2] AS repo, a[3] AS from_file, a[4] AS from_name, b[4] AS target, weight FROM (SELECT string_split({clean('from_id')}, ':') AS a, string_split({clean('to_id')}, ':') AS b, weight FROM edges WHERE type IN ({edge_types}) AND to_id IS NOT NULL) WHERE len(a) >= 4 AND len(b) >= 4),
sc AS (SELECT * FROM st WHERE true {scope}),
sr AS (SELECT s.*, (SELECT min(id) FROM r WHERE r.repo = s.repo AND r.file = s.from_file AND r.name = s.from_name) AS src, (SELECT min(id) FROM r WHERE r.repo = s.repo AND r.file = s.from_file AND r.name = s.target) AS near FROM sc s),
ed AS (SELECT src, near AS dst, false AS unresolved, weight FROM sr WHERE src IS NOT NULL AND near IS NOT NULL UNION ALL SELECT src, r.id, true, weight FROM sr JOIN r ON r.repo = sr.repo AND r.name = sr.target WHERE src IS NOT NULL AND near IS NULL)
SELECT src, dst, min(unresolved) AS unresolved, max(weight) AS weight FROM ed WHERE src <> dst GROUP BY src, dst"""


FENCED = "regexp_replace(text, '(?s)(?:^|\\n)```.*?(?:\\n```[ \\t\\r]*(?:\\n|$)|$)', chr(10), 'g')"
NAMES = "nm AS (SELECT DISTINCT id, name, repo FROM ln WHERE type IN ('class', 'function') AND length(name) >= 3)"


def mention_sql(texts: str) -> str:
    return sql(f", {NAMES}, tx AS ({texts}), tk AS (SELECT DISTINCT section, repo, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{2,}}')) AS name FROM tx), mt AS (SELECT DISTINCT section, id, name FROM tk JOIN nm USING (repo, name))")


SECTION_TEXTS = f"SELECT DISTINCT {clean('id')} AS section, repo, code_snippet AS text FROM nodes WHERE type = 'section' AND code_snippet IS NOT NULL UNION ALL SELECT doc_id::VARCHAR, repo, text FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL"

MIRROR = f"""CASE WHEN pos > 0 AND pos < len(parts) THEN array_to_string(list_transform(parts[:-2], lambda x, i: CASE WHEN i = pos THEN 'src' ELSE x END), '/') || '/' || regexp_replace({STEM.format('p')}, '{SUFFIX}', '') || regexp_extract(p, '(\\.[^./]*)$', 1) END"""
MIRRORED = f"pp AS (SELECT *, list_position(list_transform(parts, lambda x: lower(x) IN ('test', 'tests', 'spec', 'specs', '__tests__')), true) AS pos FROM (SELECT id, file_path AS p, string_split(file_path, '/') AS parts FROM ln WHERE file_path IS NOT NULL))"

X_PROBES = "['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.js']"

TEST_MAP = f""", t AS (SELECT id, type, repo, file_path FROM ln WHERE type IN ('class', 'function', 'file') AND file_path IS NOT NULL AND {TEST_PATH.format('file_path')}),
p AS (SELECT id, type, repo, file_path FROM ln WHERE type IN ('class', 'function', 'file') AND file_path IS NOT NULL AND NOT {TEST_PATH.format('file_path')}), {MIRRORED},
u AS (SELECT src, dst, 0.9 AS weight FROM ge JOIN t ON t.id = src JOIN p ON p.id = dst WHERE ge.type = 'CALLS' AND t.repo = p.repo
UNION ALL SELECT t.id, p.id, 0.7 FROM t JOIN p ON t.repo = p.repo AND lower(regexp_replace({STEM.format('t.file_path')}, '{SUFFIX}', '')) = lower({STEM.format('p.file_path')}) WHERE t.type = 'file' AND p.type = 'file'
UNION ALL SELECT t.id, p.id, 0.6 FROM t JOIN (SELECT id, {MIRROR} AS target FROM pp) m ON m.id = t.id JOIN p ON p.repo = t.repo AND p.file_path = m.target WHERE t.type = 'file' AND p.type = 'file'),
tm AS (SELECT src, dst, max(weight)::DOUBLE AS weight FROM u GROUP BY src, dst)"""

PAIRS: dict[str, tuple] = {
    "name_tokens": (
        named(lambda n: n.select("id", X.name_tokens("name").alias("tokens"))),
        sql("SELECT id, array_to_string(list_filter(list_append(w, lower(name)), lambda x, i: list_position(list_append(w, lower(name)), x) = i), ' ') AS tokens FROM (SELECT id, name, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM gn)"),
    ),
    "slugs": (
        named(lambda n: n.select("id", X.slugify("name").alias("slug"), X.heading_slug("name").alias("heading"))),
        sql(f"SELECT id, {slug_sql('name')} AS slug, coalesce(nullif({slug_sql('trim(name)')}, ''), 'section') AS heading FROM gn"),
    ),
    "signature_hashes": (
        named(lambda n: n.select("id", X.sig_hash("signature").alias("h4"), X.signature_hash("signature").alias("h8"))),
        sql(f"SELECT id, {SIG4} AS h4, CASE WHEN coalesce(signature, '') <> '' THEN substr(sha1(signature), 1, 8) END AS h8 FROM gn"),
    ),
    "stable_ids": (
        lambda s, d: raw(s, d).select("repo", "type", "name", clean_path("file_path").alias("file_path"), X.node_id("type", "repo", "file_path", "name", "signature").alias("id")).distinct(),
        f"WITH {RAW} SELECT DISTINCT repo, type, name, {clean('file_path')} AS file_path, CASE type WHEN 'file' THEN 'file:' || repo || ':' || {clean('file_path')} WHEN 'class' THEN 'class:' || repo || ':' || {clean('file_path')} || ':' || name WHEN 'function' THEN 'function:' || repo || ':' || {clean('file_path')} || ':' || name || ':' || {SIG4} END AS id FROM raw",
    ),
    "id_parts": (
        named(lambda n: n.select("id", X.id_parts("id").alias("p")).select("id", "p.kind", "p.repo", "p.rest", "p.anchor")),
        sql("SELECT id, p[1] AS kind, p[2] AS repo, string_split(r, '#')[1] AS rest, CASE WHEN contains(r, '#') THEN string_split(r, '#')[-1] END AS anchor FROM (SELECT id, string_split(id, ':') AS p, array_to_string(string_split(id, ':')[3:], ':') AS r FROM gn)"),
    ),
    "test_suffix": (
        named(lambda n: n.where("file_path IS NOT NULL").select("id", X.strip_test_suffix("name").alias("base"), X.strip_test_suffix(X.stem("file_path")).alias("file_base"))),
        sql(f"SELECT id, regexp_replace(name, '{SUFFIX}', '') AS base, regexp_replace({STEM.format('file_path')}, '{SUFFIX}', '') AS file_base FROM gn WHERE file_path IS NOT NULL"),
    ),
    "mirror_path": (
        lambda s, d: G.live(N(s, d, "file_path", "deleted_at")).where("file_path IS NOT NULL").select("id", X.mirror_path("file_path").alias("target")),
        sql(f", {MIRRORED} SELECT id, {MIRROR} AS target FROM pp"),
    ),
    "layer_assign": (
        lambda s, d: raw(s, d).select("repo", "type", "name", clean_path("file_path").alias("file_path"), X.assign_layer("type", "name", "file_path").alias("layer")).distinct(),
        f"WITH {RAW} SELECT DISTINCT repo, type, name, {clean('file_path')} AS file_path, {layer_sql()} AS layer FROM raw",
    ),
    "detect_language": (
        lambda s, d: raw(s, d).groupBy(X.language("file_path").alias("by_path"), F.col("language").alias("stated")).agg(F.count(F.lit(1)).alias("rows")),
        f"WITH {RAW} SELECT {LANGUAGE.format(EXT.format(clean('file_path')))} AS by_path, language AS stated, count(*) AS rows FROM raw GROUP BY ALL",
    ),
    "fallback_summaries": (
        lambda s, d: N(s, d, "type", "name", "summary").where("summary IS NULL AND type IN ('class', 'function', 'file')").select("id", X.fallback_summary("type", "name").alias("summary")),
        sql("SELECT id, '[fallback] ' || upper(type[1]) || type[2:] || ' ''' || coalesce(name, '') || '''.' AS summary FROM gn WHERE summary IS NULL AND type IN ('class', 'function', 'file')"),
    ),
    "source_slices": (
        lambda s, d: (lambda n: n.where("type = 'function'").select("id", "repo", "file_path", "line_range").join(n.where("type = 'file' AND code_snippet IS NOT NULL").select("repo", "file_path", F.col("code_snippet").alias("t")), ["repo", "file_path"]).select("id", F.md5(X.source_slice(F.col("t"), F.col("line_range.start"), F.col("line_range.end"))).alias("slice")).distinct())(G.live(N(s, d, "type", "repo", "file_path", "line_range", "code_snippet", "deleted_at"))),
        sql("SELECT DISTINCT a.id, md5(array_to_string(CASE WHEN a.line_range.\"start\" >= 1 AND a.line_range.\"end\" >= a.line_range.\"start\" THEN string_split(f.code_snippet, chr(10))[a.line_range.\"start\":a.line_range.\"end\"] ELSE string_split(f.code_snippet, chr(10))[1:60] END, chr(10))) AS slice FROM ln a JOIN ln f ON f.repo = a.repo AND f.file_path = a.file_path AND f.type = 'file' AND f.code_snippet IS NOT NULL WHERE a.type = 'function'"),
    ),
    "extract_facts": (lambda s, d: extract.facts(table(s, d, "raw_nodes")), None),  # methods and arrows are no matter of SQL; members_of_raw and the tests check them
    "extracted_imports": (
        lambda s, d: extract.facts(table(s, d, "raw_nodes")).where("kind = 'import'").select("repo", "file_path", "name").distinct(),
        f"WITH {imports_sql()} SELECT * FROM facts WHERE name IS NOT NULL",
    ),
    "sections": (
        lambda s, d: extract.sections(table(s, d, "documents")),
        f"WITH h AS (SELECT doc_id, regexp_extract_all({FENCED}, '(?m)^#{{1,4}} [^\\r\\n]*') AS hs FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, unnest(hs) AS head, (generate_subscripts(hs, 1) - 1)::INT AS no FROM h), t AS (SELECT doc_id, no, length(regexp_extract(head, '^#+'))::INT AS level, trim(regexp_replace(head, '^#+', '')) AS title FROM x) SELECT *, coalesce(nullif({slug_sql('trim(title)')}, ''), 'section') AS slug FROM t",
    ),
    "links": (
        lambda s, d: extract.links(table(s, d, "documents")).withColumn("internal", X.internal_link("target")),
        f"WITH l AS (SELECT doc_id, unnest(regexp_extract_all({FENCED}, '\\[[^\\]\\n]*\\]\\([^)\\s]+\\)')) AS l FROM documents WHERE text IS NOT NULL), t AS (SELECT DISTINCT doc_id, regexp_extract(l, '^\\[([^\\]]*)\\]', 1) AS label, regexp_extract(l, '\\(([^)]+)\\)$', 1) AS target FROM l) SELECT *, NOT regexp_matches(lower(target), '^(?:https?|ftp|mailto):') AND (regexp_matches(lower(regexp_replace(target, '#.*$', '')), '\\.(?:md|markdown)$') OR NOT contains(string_split(regexp_replace(target, '#.*$', ''), '/')[-1], '.')) AS internal FROM t",
    ),
    "has_section": (
        lambda s, d: N(s, d, "type", "deleted_at").where("type = 'section' AND deleted_at IS NULL").select(F.substring_index("id", "#", 1).alias("src"), F.col("id").alias("dst")).join(N(s, d, "type").where("type = 'document'").select(F.col("id").alias("src")), "src", "left_semi"),
        sql("SELECT string_split(id, '#')[1] AS src, id AS dst FROM ln WHERE type = 'section' AND string_split(id, '#')[1] IN (SELECT id FROM gn WHERE type = 'document')"),
    ),
    "mentions": (
        lambda s, d: (lambda n: __import__("graphloom.operators.search", fromlist=["name_matches"]).name_matches(document_texts(s, d), "section", F.col("text"), n.where("type IN ('class', 'function')"), "repo").withColumn("weight", F.lit(0.8)))(G.live(N(s, d, "type", "name", "repo", "deleted_at"))),
        mention_sql("SELECT doc_id AS section, repo, text FROM documents WHERE text IS NOT NULL AND repo IS NOT NULL") + " SELECT section, id, name, 0.8::DOUBLE AS weight FROM mt",
    ),
    "document_links": (
        lambda s, d: R.document_links(section_texts(s, d), N(s, d, "type", "name", "repo", "deleted_at")),
        mention_sql(SECTION_TEXTS) + " SELECT DISTINCT section AS src, id AS dst, 0.5::DOUBLE AS confidence FROM mt",
    ),
    "calls_resolution": (calls, f"WITH {resolve_sql(chr(39) + 'function' + chr(39), chr(39) + 'CALLS' + chr(39))}"),
    "calls_scoped": (lambda s, d: calls(s, d, changed_files(s, d)), f"WITH {resolve_sql(chr(39) + 'function' + chr(39), chr(39) + 'CALLS' + chr(39), True)}"),
    "inherits_resolution": (
        lambda s, d: R.resolve_names(R.call_sites(table(s, d, "edges"), ("INHERITS", "IMPLEMENTS")), registry(s, d, "class", "interface", "function")),
        f"WITH {resolve_sql(chr(39) + 'class' + chr(39) + ', ' + chr(39) + 'interface' + chr(39) + ', ' + chr(39) + 'function' + chr(39), chr(39) + 'INHERITS' + chr(39) + ', ' + chr(39) + 'IMPLEMENTS' + chr(39))}",
    ),
    "imports_resolution": (
        imports,
        f"""WITH {imports_sql()}, fi AS (SELECT DISTINCT repo, {clean('file_path')} AS path, 'file:' || repo || ':' || {clean('file_path')} AS id FROM raw_nodes WHERE type = 'file'),
im AS (SELECT DISTINCT repo, file_path AS path, name AS import_path FROM facts WHERE name IS NOT NULL),
ba AS (SELECT *, CASE WHEN regexp_matches(import_path, '^\\.\\.?/') THEN array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(path, '[^/]*$', '') || import_path, '/'), lambda x: [x])), lambda acc, x: CASE WHEN x[1] IN ('.', '') THEN acc WHEN x[1] = '..' THEN acc[:-2] ELSE acc || x END), '/') END AS base FROM im),
tr AS (SELECT repo, path, import_path, unnest(list_transform({X_PROBES}, lambda p: base || p)) AS target, unnest(range(1, 8)) AS k FROM ba WHERE base IS NOT NULL),
hi AS (SELECT tr.repo, tr.path, import_path, fi.id AS dst FROM tr JOIN fi ON fi.repo = tr.repo AND fi.path = tr.target QUALIFY row_number() OVER (PARTITION BY tr.repo, tr.path, import_path ORDER BY k, fi.id) = 1)
SELECT DISTINCT 'file:' || ba.repo || ':' || ba.path AS src, coalesce(dst, 'module:' || ba.repo || ':' || ba.import_path) AS dst, dst IS NULL AS unresolved, (CASE WHEN dst IS NULL THEN 0.7 ELSE 1.0 END)::DOUBLE AS weight FROM ba LEFT JOIN hi USING (repo, path, import_path)""",
    ),
    "containing_scope": (
        scopes,
        f"WITH r AS (SELECT DISTINCT run_id, type, repo, name, {clean('file_path')} AS path, line_range.\"start\" AS s, line_range.\"end\" AS e FROM raw_nodes WHERE line_range.\"start\" IS NOT NULL AND line_range.\"end\" IS NOT NULL), h AS (SELECT concat_ws('|', f.run_id, f.path, f.name, f.s) AS site, concat_ws('|', c.name, c.s) AS scope, c.e - c.s AS span, c.s FROM r f JOIN r c ON c.type = 'class' AND c.repo = f.repo AND c.run_id = f.run_id AND c.path = f.path AND c.s <= f.s AND f.s <= c.e WHERE f.type = 'function') SELECT site, scope FROM h QUALIFY row_number() OVER (PARTITION BY site ORDER BY span, s, scope) = 1",
    ),
    "test_map": (
        lambda s, d: R.test_links(E(s, d).where("type = 'CALLS'"), N(s, d, "type", "repo", "file_path", "deleted_at")),
        sql(f"{TEST_MAP} SELECT * FROM tm"),
    ),
}

QUERIES = {k: f for k, (f, _) in PAIRS.items()}
ORACLE = {k: q for k, (_, q) in PAIRS.items() if q}
