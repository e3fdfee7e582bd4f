"""Scalar functions over columns: identifiers, slugs, hashes, name parts, test and layer rules, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.sources.tables import clean_path


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(c: Column | str) -> Column:
    """Lower case; letters, digits and hyphens stay, blanks and underscores become one hyphen, none at the ends."""
    x = F.regexp_replace(F.lower(col(c)), r"[^\p{L}\p{N}_\s-]", "")
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"[\s_]+", "-"), "-+", "-"), F.lit("-"))


def heading_slug(c: Column | str) -> Column:
    return F.coalesce(F.nullif(slugify(F.trim(col(c))), F.lit("")), F.lit("section"))


def sig_hash(c: Column | str, size: int = 4) -> Column:
    """First digits of the SHA-1 of a signature with its blanks collapsed."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))), 1, size)


def signature_hash(c: Column | str) -> Column:
    return F.when(F.coalesce(col(c), F.lit("")) != "", F.substring(F.sha1(col(c)), 1, 8))


def node_id(kind: Column | str, repo: Column | str, path: Column | str, name: Column | str, signature: Column | str) -> Column:
    """Stable ids by kind; null for kinds without ids of this form."""
    kind, repo, path, name = col(kind), col(repo), clean_path(path), col(name)
    return (
        F.when(kind == "file", F.concat_ws(":", F.lit("file"), repo, path))
        .when(kind.isin("class", "interface", "enum"), F.concat_ws(":", F.when(kind == "interface", "interface").otherwise("class"), repo, path, name))
        .when(kind == "function", F.concat_ws(":", F.lit("function"), repo, path, name, sig_hash(signature)))
        .when(kind == "module", F.concat_ws(":", F.lit("module"), repo, name))
        .when(kind == "document", F.concat_ws(":", F.lit("doc"), repo, path))
        .when(kind == "section", F.concat(F.concat_ws(":", F.lit("doc"), repo, path), F.lit("#"), heading_slug(name)))
        .when(kind == "layer", F.concat_ws(":", F.lit("layer"), repo, slugify(name)))
        .when(kind == "repo", F.concat_ws(":", F.lit("repo"), repo))
    )


def id_parts(c: Column | str) -> Column:
    """struct(kind, repo, rest, anchor) of an id."""
    p = F.split(col(c), ":", 3)
    rest = F.get(p, F.lit(2))
    return F.struct(
        F.get(p, F.lit(0)).alias("kind"), F.get(p, F.lit(1)).alias("repo"), F.substring_index(rest, "#", 1).alias("rest"),
        F.when(rest.contains("#"), F.substring_index(rest, "#", -1)).alias("anchor"),
    )


def name_tokens(c: Column | str) -> Column:
    """Words of an identifier in lower case, each once, and the whole identifier after them."""
    x = F.regexp_replace(col(c), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    words = F.filter(F.split(F.lower(F.regexp_replace(x, r"[^A-Za-z0-9]+", " ")), " "), lambda w: w != "")
    return F.array_join(F.array_distinct(F.concat(words, F.array(F.lower(col(c))))), " ")


def stem(path: Column | str) -> Column:
    return F.regexp_replace(F.substring_index(clean_path(path), "/", -1), r"\.[^.]*$", "")


# Suffixes of test names, in the order in which they are tried.
TEST_SUFFIX = r"(Tests|Test|Spec|\.spec|\.test|_test|_tests|_spec)$"


def strip_test_suffix(c: Column | str) -> Column:
    return F.regexp_replace(col(c), TEST_SUFFIX, "")


def mirror_path(path: Column | str) -> Column:
    """The production path of a test path: the first test folder becomes src, the suffix goes; null without such a folder."""
    p = clean_path(path)
    parts = F.split(p, "/")
    spot = F.array_position(F.transform(parts, lambda x: F.lower(x).isin("test", "tests", "spec", "specs", "__tests__").cast("int")), F.lit(1))
    folder = F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.when(i + 1 == spot, F.lit("src")).otherwise(x)), "/")
    extension = F.regexp_extract(p, r"(\.[^./]*)$", 1)
    return F.when((spot > 0) & (spot < F.size(parts)), F.concat(folder, F.lit("/"), strip_test_suffix(stem(path)), extension))


# Layer rules, the first that fits wins; path rules (on the lower-case path) come before name rules.
# Path rules: words within a folder's name, words within a file's name, further patterns.
PATH_WORDS = [
    ("test", ["test", "spec"], [], [r"/__tests__/", r"/e2e/", r"\.(?:spec|test)\.[a-z]+$"]),
    ("component", ["component", "page", "view", "guard", "directive", "pipe", "widget", "screen"], [], [r"\.(?:component|guard|directive|pipe|module)\.[a-z]+$"]),
    ("store", ["store", "state", "reducer", "effect", "action", "selector"], [], [r"\.(?:store|reducer|effects?|actions?|selectors?)\.[a-z]+$"]),
    ("migration", ["migration", "seed", "flyway", "liquibase"], ["initializ", "seed"], []),
    ("controller", ["controller", "route", "handler", "hub"], [], []),
    ("service", ["service", "logic", "resolver"], [], [r"\.service\.[a-z]+$"]),
    ("repository", ["repositor", "repo", "persistence", "dbcontext"], [], []),
    ("model", ["model", "entit", "schema", "dto", "domain", "example"], [], []),
    ("validator", ["validator", "validation"], [], []),
    ("utility", ["util", "helper", "common", "extension", "factor", "mapper", "constant"], ["util", "helper", "common"], []),
    ("middleware", ["middleware", "interceptor", "filter", "pipeline", "authorization", "modelbinder", "custommodelbinder"], [], []),
    ("config", ["config", "configuration", "setting", "properties", "injection"], ["startup"], []),
    ("exception", ["exception", "error", "fault"], [], []),
]
# Name rules: case-sensitive suffixes.
NAME_SUFFIXES = [
    ("test", ["Test", "Tests", "Spec", "Fixture", "TestBase", "TestData", "TestHelper", "Mock", "Stub", "Fake"]),
    ("component", ["Component", "Guard", "Pipe", "Directive", "Module", "Page", "Widget", "Screen"]),
    ("store", ["Store", "Effect", "Effects", "Reducer", "Action", "Actions", "Selector", "Selectors", "State", "Facade"]),
    ("validator", ["Validator", "Validation", "ValidatorBase", "Rule"]),
    ("controller", ["Controller", "Handler", "Router", "Hub"]),
    ("service", ["Service", "Manager", "Provider", "Processor", "Resolver"]),
    ("repository", ["Repository", "Dao", "DbContext", "Context", "UnitOfWork"]),
    ("model", ["Model", "Entity", "Dto", "DTO", "Response", "Request", "View", "ViewModel", "Payload", "Event", "Command", "Query", "Example", "Result", "Output", "Input", "Summary", "Info"]),
    ("exception", ["Exception", "Error", "Fault"]),
    ("utility", ["Util", "Utils", "Helper", "Tool", "Common", "Extension", "Extensions", "Factory", "Builder", "Mapper", "Profile", "Attribute", "Decorator", "Converter"]),
    ("middleware", ["Middleware", "Interceptor", "Filter", "Pipeline", "Behavior"]),
    ("config", ["Config", "Configuration", "Settings", "Options", "Constant", "Constants", "Startup"]),
    ("migration", ["Migration", "Snapshot", "Seed", "Initialiser", "Initializer"]),
]


def path_pattern(folders: list[str], files: list[str], more: list[str]) -> str:
    parts = [rf"/[^/]*(?:{'|'.join(folders)})[^/]*/"]
    if files:
        parts.append(rf"/[^/]*(?:{'|'.join(files)})[^/]*\.[a-z]+$")
    return "|".join([*parts, *more])


PATH_RULES = [(layer, path_pattern(*words)) for layer, *words in PATH_WORDS]
NAME_RULES = [(layer, f"(?:{'|'.join(words)})$") for layer, words in NAME_SUFFIXES]


def assign_layer(kind: Column | str, name: Column | str, path: Column | str) -> Column:
    """Layer of a class, interface, function or enum by its path, then by its name; null without a hit."""
    p, n = F.lower(clean_path(path)), col(name)
    rules = [F.when(p.rlike(r), F.lit(x)) for x, r in PATH_RULES] + [F.when(n.rlike(r), F.lit(x)) for x, r in NAME_RULES]
    return F.when(col(kind).isin("class", "interface", "function", "enum"), F.coalesce(*rules))


# Languages of file extensions.
LANGUAGE = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "cs": "csharp", "java": "java", "py": "python", "go": "go", "md": "markdown", "markdown": "markdown"}


def language(path: Column | str) -> Column:
    return F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])[F.lower(F.regexp_extract(clean_path(path), r"\.(\w+)$", 1))]


def internal_link(c: Column | str) -> Column:
    """A link to another document: no scheme, and a Markdown file or a name without a dot."""
    bare = F.regexp_replace(col(c), r"#.*$", "")
    return ~F.lower(col(c)).rlike(r"^(?:https?|ftp|mailto):") & (F.lower(bare).rlike(r"\.(?:md|markdown)$") | ~F.substring_index(bare, "/", -1).contains("."))


def collapse(path: Column) -> Column:
    """A path without . and .. parts."""
    def step(acc: Column, x: Column) -> Column:
        return F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_link(c: Column | str, base: Column | str) -> Column:
    """Target of a link relative to the file that holds it; null for links elsewhere."""
    folder = F.regexp_replace(clean_path(base), r"[^/]*$", "")
    return F.when(internal_link(c), collapse(F.concat(folder, F.regexp_replace(col(c), r"#.*$", ""))))


def fallback_summary(kind: Column | str, name: Column | str) -> Column:
    return F.format_string("[fallback] %s '%s'.", F.initcap(col(kind)), F.coalesce(col(name), F.lit("")))


def source_slice(text: Column, start: Column, end: Column, first: int = 60) -> Column:
    """Lines start..end (from 1, inclusive) of a text, else its first lines."""
    lines = F.split(text, "\n")
    known = start.isNotNull() & end.isNotNull() & (start >= 1) & (end >= start)
    return F.array_join(F.when(known, F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(1)))).otherwise(F.slice(lines, 1, first)), "\n")


def summary_prompt(kind: Column | str, name: Column | str, lang: Column | str, code: Column | str, cap: int = 4000) -> Column:
    """The question put to a summary provider."""
    return F.format_string(
        "Summarise the %s '%s' in one sentence and give tags and a complexity as JSON.\nLanguage: %s\n\n%s", F.coalesce(col(kind), F.lit("node")), F.coalesce(col(name), F.lit("")), F.coalesce(col(lang), F.lit("unknown")), F.substring(F.coalesce(col(code), F.lit("")), 1, cap)
    )


def parse_response(c: Column | str) -> Column:
    """struct(summary, tags, complexity) from the answer of a provider: the first JSON object, fenced or not; nulls where there is none."""
    body = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    return F.from_json(F.nullif(body, F.lit("")), "summary string, tags array<string>, complexity string")
