"""Facts of source and Markdown files: declarations, imports, headings, links, read line by line in the JVM.

A line that opens a declaration names it at its head in all these languages, so one anchored pattern per language finds
declarations and imports with their line numbers without a parser; the patterns are plain and run alike in SQL engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import heading_slug, language
from graphloom.sources.tables import clean_path

# Heads of declarations by language and kind; the name is the first group.
HEADS = {
    "python": {"class": r"^\s*class\s+(\w+)", "function": r"^\s*(?:async\s+)?def\s+(\w+)", "import": r"^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"},
    "javascript": {"class": r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)", "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "import": r"^import\s+.*from\s+['\"]([^'\"]+)['\"]"},
    "typescript": {
        "class": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "interface": r"^\s*(?:export\s+)?interface\s+(\w+)",
        "function": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)", "import": r"^import\s+.*from\s+['\"]([^'\"]+)['\"]",
    },
    "java": {
        "class": r"^\s*(?:public\s+|private\s+|protected\s+)?(?:abstract\s+|static\s+|final\s+)*class\s+(\w+)", "interface": r"^\s*(?:public\s+)?interface\s+(\w+)",
        "function": r"^\s+(?:public|private|protected)\s+(?:static\s+|final\s+|abstract\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$", "import": r"^import\s+(?:static\s+)?([\w.]+)",
    },
    "csharp": {
        "class": r"^\s*(?:public\s+|private\s+|internal\s+|protected\s+)?(?:abstract\s+|static\s+|sealed\s+|partial\s+)*(?:class|struct)\s+(\w+)", "interface": r"^\s*(?:public\s+|internal\s+)?interface\s+(\w+)",
        "function": r"^\s+(?:public|private|protected|internal)\s+(?:static\s+|async\s+|override\s+|virtual\s+)*[\w<>\[\], ?]+\s+(\w+)\s*\([^;]*$", "import": r"^using\s+([\w.]+)\s*;",
    },
    "go": {"class": r"^type\s+(\w+)\s+struct", "interface": r"^type\s+(\w+)\s+interface", "function": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "import": r"^(?:import\s+|\s+)(?:[\w.]+\s+)?\"([\w./-]+)\"\s*(?://.*)?$"},
}

# Methods and functions held by a name, of JavaScript and TypeScript.  The parameters may go over several lines; what is
# left open at the end of a line is read on to PARAMETERS lines.
PARAMETERS = 64
_MODIFIERS = r"(?:(?:export|default|public|private|protected|static|abstract|override|readonly|declare|async|get|set)\s+)*"
_INSIDE = r"[^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+"  # possessive, as lines of generated code are very long
_PARAMETERS = rf"(?:<[^()]*?>\s*)?\({_INSIDE}\)"
_NO_NAME = r"(?!(?:if|for|while|switch|catch|with|function|return|await|constructor|super|typeof|new|throw|yield|delete|void|do|else|in|of)\b)"
_METHOD_NAME = rf"^\s+(?:@[\w.]+(?:\([^()]*\))?\s+)*{_MODIFIERS}\*?{_NO_NAME}([\w$]+)\s*"
_HELD_NAME = rf"^\s*{_MODIFIERS}(?:(?:const|let|var)\s+)?{_NO_NAME}([\w$]+)[?!]?\s*(?::[^;]*?)?=(?![=>])\s*(?:async\s+|async(?=\())?"
METHOD = rf"{_METHOD_NAME}{_PARAMETERS}\s*(?::(?:[^;{{}}]++|\{{[^{{}}]*+\}})*?)?(?<![<|&,(\[:=])(?<![<|&,(\[:=]\s)\{{"  # no type that opens with a brace
HELD = rf"{_HELD_NAME}(?:function\b|(?:{_PARAMETERS}\s*(?::[^;]*?)?|[\w$]+\s*)=>)"
OPEN = rf"(?:{_METHOD_NAME}|{_HELD_NAME})(?:<[^()]*?>\s*)?\((?!.*\)\s*(?:=>\s*)?\{{)[^()]*+(?:\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)[^()]*+)*+$"
SCRIPTS = ("javascript", "typescript")


def with_heads(lines):
    return F.transform(F.col(lines), lambda x: F.struct(x.alias("text"), x.alias("head")))


def heads_read_on(lines):
    """Every line with the head that begins there: a line that leaves a parenthesis open goes on in the next lines."""
    more = lambda x, i: F.when(x.rlike(OPEN), F.array_join(F.slice(F.col(lines), i + 1, PARAMETERS), " ")).otherwise(x)
    return F.transform(F.col(lines), lambda x, i: F.struct(x.alias("text"), more(x, i).alias("head")))


def facts(raw_nodes: DataFrame) -> DataFrame:
    """(run_id, repo, file_path, language, kind, name, line) of the declarations and imports of every file text."""
    lines = (
        raw_nodes.where("type = 'file' AND code_snippet IS NOT NULL")
        .select("run_id", "repo", clean_path("file_path").alias("file_path"), language("file_path").alias("language"), "code_snippet")
        .distinct()
        .where(F.col("language").isin(*HEADS))
        .select("run_id", "repo", "file_path", "language", F.split(F.regexp_replace("code_snippet", "\r", ""), "\n").alias("lines"))
        .select("run_id", "repo", "file_path", "language", F.posexplode(F.when(F.col("language").isin(*SCRIPTS), heads_read_on("lines")).otherwise(with_heads("lines"))).alias("line", "l"))
        .select("run_id", "repo", "file_path", "language", "line", "l.text", "l.head")
    )
    cases = []
    for lang, heads in HEADS.items():
        for kind, pattern in heads.items():
            groups = [F.nullif(F.regexp_extract("text", pattern, g), F.lit("")) for g in range(1, 3 if "|import" in pattern else 2)]
            cases.append(F.when(F.col("language") == lang, F.when(F.coalesce(*groups).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.coalesce(*groups).alias("name")))))
    held = F.when(F.col("language").isin(*SCRIPTS), F.coalesce(*[F.nullif(F.regexp_extract("head", p, 1), F.lit("")) for p in (METHOD, HELD)]))
    cases.append(F.when(held.isNotNull(), F.struct(F.lit("function").alias("kind"), held.alias("name"))))
    return lines.withColumn("f", F.coalesce(*cases)).where("f IS NOT NULL").select("run_id", "repo", "file_path", "language", "f.kind", "f.name", (F.col("line") + 1).alias("line")).distinct()


FENCE = r"(?s)(?:^|\n)```.*?(?:\n```[ \t\r]*(?:\n|$)|$)"


def without_fences(c):
    return F.regexp_replace(c, FENCE, "\n")


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, no, level, title, slug) of the headings of levels 1 to 4 outside code fences."""
    heads = F.regexp_extract_all(without_fences(F.col("text")), F.lit(r"(?m)^#{1,4} [^\r\n]*"), F.lit(0))
    return (
        documents.where("text IS NOT NULL")
        .select("doc_id", F.posexplode(heads).alias("no", "head"))
        .select("doc_id", "no", F.length(F.regexp_extract("head", "^#+", 0)).alias("level"), F.trim(F.regexp_replace("head", "^#+", "")).alias("title"))
        .withColumn("slug", heading_slug("title"))
    )


def links(documents: DataFrame) -> DataFrame:
    """(doc_id, label, target) of the Markdown links outside code fences."""
    found = F.regexp_extract_all(without_fences(F.col("text")), F.lit(r"\[[^\]\n]*\]\([^)\s]+\)"), F.lit(0))
    return (
        documents.where("text IS NOT NULL").select("doc_id", F.explode(found).alias("l"))
        .select("doc_id", F.regexp_extract("l", r"^\[([^\]]*)\]", 1).alias("label"), F.regexp_extract("l", r"\(([^)]+)\)$", 1).alias("target")).distinct()
    )
