"""Members of source files with their spans, and what they name: calls, bases, interfaces.

A file is scanned once by a small walker that knows comments, strings, brackets and the heads of declarations; Spark deals
the files to the workers.  A call belongs to the innermost named function around it, a base to the class that names it.

Defined results: null texts and other languages have no rows; repeated rows count once; a member that is not closed ends
with its file; calls outside of functions have no row; very long files are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import language
from graphloom.session import spread
from graphloom.sources.tables import clean_path

# Names of built-ins that calls do not resolve to, by language.
SKIPPED = {
    "typescript": frozenset(
        """toString valueOf hasOwnProperty isPrototypeOf push pop shift unshift splice slice concat map filter reduce forEach find findIndex includes some every flat flatMap sort reverse
        join split trim replace match test log warn error info debug resolve reject then catch finally subscribe unsubscribe next complete setTimeout setInterval clearTimeout clearInterval
        parseInt parseFloat isNaN isFinite JSON Object Array String Number Boolean Promise Symbol Error console""".split()
    ),
    "csharp": frozenset(
        """ToString GetType Equals GetHashCode Dispose Add Remove Clear Count Any Where Select ToList ToArray FirstOrDefault First Single SingleOrDefault OrderBy OrderByDescending GroupBy
        Contains TryGetValue TryAdd GetValueOrDefault nameof typeof sizeof""".split()
    ),
    "python": frozenset(
        """print len range enumerate zip map filter sorted list dict set tuple str int float bool bytes type isinstance issubclass hasattr getattr setattr super property classmethod
        staticmethod open read write close append extend insert remove pop clear update get keys values items format join split strip replace startswith endswith upper lower encode decode
        logging logger debug info warning error critical raise assert""".split()
    ),
    "go": frozenset("make new append copy delete len cap close panic recover print println Println Printf Fprintf Sprintf Errorf Error Fatal Fatalf Log Logf".split()),
}
SKIPPED["javascript"] = SKIPPED["typescript"]
LANGUAGES = (*SKIPPED, "java")  # Java gives no calls
WEIGHT = {"CALLS": 0.8, "INHERITS": 1.0, "IMPLEMENTS": 1.0}
SNIPPET = 2000  # characters of a member's text that are kept
KEYWORDS = frozenset("if for foreach while switch catch return throw new function func def class with lock using await typeof sizeof do else in of and or not lambda elif yield super this constructor case go defer select fixed checked unchecked assert except print".split()) - {"print"}

HIDDEN = {
    "slash": re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`[^`]*`?", re.S),
    "hash": re.compile(r"#[^\n]*|(\"\"\"|''').*?(?:\1|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?", re.S),
}
REGEX = re.compile(r"([=(,:;!&|?\[]\s*)/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
TOKEN = re.compile(r"[A-Za-z_$][\w$]*|[{}()\[\];=,:<>]|\n")
CALL = re.compile(r"([A-Za-z_]\w*)\s*\(")
PY_HEAD = re.compile(r"(?:async\s+)?(class|def)\s+(\w+)")
GO_FUNC = re.compile(r"func\s+(?:\([^()]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?\(")
GO_TYPE = re.compile(r"type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\b")
CLASS = re.compile(r"(class|struct|record|interface)\s+([A-Za-z_$][\w$]*)([^{};]*)")
HELD = re.compile(r"([A-Za-z_$][\w$]*)\s*(?::[^=;{}]*)?=\s*(?:async\s*)?(?:function\b[^({]*)?\(")
AFTER = re.compile(r"\s*(?::\s*[^{};=]*(?:\{[^{}\n]*\}[^{};=\n]*)?|throws\s+[\w., ]+|where\s+[^{};]*)?\s*(\{|=>)")

Row = tuple[str, str, str | None, int, int, str | None]  # kind, name, target, first and last line, first line of the text


def hidden(text: str, family: str) -> str:
    """The text with blanks for comments and strings; places stay."""
    code = HIDDEN[family].sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    return REGEX.sub(lambda m: m.group(1) + " " * (len(m.group()) - len(m.group(1))), code) if family == "slash" else code


def bases(tail: str, kind: str, lang: str) -> Iterator[tuple[str, str]]:
    """(edge type, name) of what the head of a class or interface names."""
    tail = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", tail)).split(" where ")[0]
    named = re.compile(r"[A-Za-z_$][\w$.]*")
    if lang == "csharp":
        m = re.search(r":(.*)", re.sub(r"\([^()]*\)", "", tail), re.S)
        for k, x in enumerate(m.group(1).split(",") if m else ()):
            if n := named.search(x):
                yield ("INHERITS" if k == 0 else "IMPLEMENTS"), n.group().rpartition(".")[2]
        return
    for word, edge in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
        m = re.search(rf"\b{word}\b(.*?)(?=\b(?:extends|implements|permits)\b|$)", tail, re.S)
        for x in m.group(1).split(",") if m else ():
            if n := named.search(x):
                yield edge, n.group().rpartition(".")[2]


def scan_python(text: str) -> list[Row]:
    code, out, open_, depth = hidden(text, "hash").split("\n"), [], [], 0
    lines, last, skip = text.split("\n"), 0, SKIPPED["python"]

    def leave(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, kind, name, at = open_.pop()
            out.append((kind, name, None, at + 1, last + 1, lines[at].strip()))

    for k, x in enumerate(code):
        if not x.strip():
            continue
        if not depth:
            indent = len(x.expandtabs(8)) - len(x.expandtabs(8).lstrip())
            leave(indent)
            if m := PY_HEAD.match(x.strip()):
                open_.append((indent, "class" if m.group(1) == "class" else "function", m.group(2), k))
        last = k
        scope = next((name for _, kind, name, _ in reversed(open_) if kind == "function"), None)
        if scope:
            for m in CALL.finditer(x):
                if m.group(1) not in KEYWORDS and m.group(1) not in skip and not re.search(r"\b(?:def|class)\s+$", x[: m.start()]):
                    out.append(("CALLS", scope, m.group(1), k + 1, k + 1, None))
        depth = max(0, depth + sum(map(x.count, "([{")) - sum(map(x.count, ")]}")))
    leave(0)
    return out


def scan_braces(text: str, lang: str) -> list[Row]:
    code, out = hidden(text, "slash"), []
    tokens = [(m.group(), m.start()) for m in TOKEN.finditer(code)]
    partner: dict[int, int] = {}
    waiting: list[int] = []
    for t, at in tokens:
        if t == "(":
            waiting.append(at)
        elif t == ")" and waiting:
            partner[waiting.pop()] = at
    scopes: list[tuple[str, str, int] | None] = []
    pending: tuple[str, str, int] | None = None
    heads: dict[int, tuple[str, str, int]] = {}  # place of the brace that opens the body -> scope
    line, skip, before = 0, SKIPPED.get(lang, frozenset()), ("", "")
    lines = text.split("\n")
    inline: list[tuple[int, tuple[str, str, int]]] = []  # bodies without braces: their end

    def body_of(call: int) -> int:
        """Place of the brace or arrow after the parameters that open at ``call``, or -1."""
        end = partner.get(call, -1)
        m = AFTER.match(code, end + 1) if end >= 0 else None
        return m.start(1) if m else -1

    def put(kind: str, name: str, at: int) -> None:
        if code.startswith("=>", at):
            brace = re.compile(r"=>\s*\{").match(code, at)
            if not brace:
                stop = re.compile(r"[;\n]").search(code, at)
                inline.append((stop.start() if stop else len(code), (kind, name, line)))
                return
            at = brace.end() - 1
        heads[at] = (kind, name, line)

    for k, (t, at) in enumerate(tokens):
        while inline and inline[0][0] < at:
            _, (kind, name, first) = inline.pop(0)
            out.append((kind, name, None, first + 1, line + 1, lines[first].strip()))
        if t == "\n":
            line += 1
            continue
        if t == "{":
            scopes.append(heads.pop(at, None) or pending)
            pending = None
        elif t == "}":
            if scopes and (s := scopes.pop()):
                out.append((s[0], s[1], None, s[2] + 1, line + 1, lines[s[2]].strip()))
        elif t == ";":
            pending = None
        elif t[0].isalpha() or t[0] in "_$":
            top = next((s for s in reversed(scopes) if s is not None), None)
            after = tokens[k + 1] if k + 1 < len(tokens) else ("", -1)
            if lang == "go":
                if t == "func" and (m := GO_FUNC.match(code, at)):
                    if (b := go_body(code, partner, m.end() - 1)) >= 0:
                        heads[b] = ("function", m.group(1), line)
                elif t == "type" and (m := GO_TYPE.match(code, at)):
                    pending = ("class" if m.group(2) == "struct" else "interface", m.group(1), line)
            elif t in ("class", "interface", "struct", "record") and before[0] != "." and (m := CLASS.match(code, at)) and (t in ("class", "interface") or lang in ("csharp", "java")):
                kind = "interface" if t == "interface" else "class"
                pending = (kind, m.group(2), line)
                out += [(edge, m.group(2), n, line + 1, line + 1, None) for edge, n in bases(m.group(3), kind, lang)]
            elif lang in ("javascript", "typescript") and t not in KEYWORDS and (after[0] in ("=", ":")) and (m := HELD.match(code, at)) and before[0] != ".":
                if (b := body_of(m.end() - 1)) >= 0:
                    put("function", t, b)
            if after[0] == "(" and t not in KEYWORDS:
                inside = scopes[-1] if scopes else None
                declared = inside is not None and inside[0] in ("class", "interface") or before[0] == "function"
                b = body_of(after[1]) if declared and lang != "go" else -1
                if b >= 0 and before[0] not in ("new", "."):
                    put("function", t, b)
                elif before[0] not in ("new", "function", "func") and t not in skip and lang != "java" and not (lang == "go" and code[:at].rstrip().endswith(")") and before[0] == "func"):
                    own = next((s for _, s in reversed(inline)), None) or next((s for s in reversed(scopes) if s is not None and s[0] == "function"), None)
                    if own and not (top and top[2] == line and top[1] == t):
                        out.append(("CALLS", own[1], t, line + 1, line + 1, None))
        before = (code[at - 1] if at and code[at - 1] == "." else t, "")
        if t[0].isalpha():
            before = (t, "")
        nxt = tokens[k + 1] if k + 1 < len(tokens) else None
        if nxt and "." in code[at + len(t) : nxt[1]]:
            before = (".", "")
    for s in scopes:
        if s:
            out.append((s[0], s[1], None, s[2] + 1, len(lines), lines[s[2]].strip()))
    return out


def go_body(code: str, partner: dict[int, int], params: int) -> int:
    """Place of the brace that opens the body of a Go function; results in brackets are passed over."""
    end = partner.get(params, -1)
    m = re.compile(r"\s*(?:\([^{}]*?\)|[\w.*\[\]]+(?:\{\})?)?\s*\{").match(code, end + 1) if end >= 0 else None
    return m.end() - 1 if m else -1


def scan(text: str, lang: str) -> list[Row]:
    text = text.replace("\r", "")
    return scan_python(text) if lang == "python" else scan_braces(text, lang)


FACT = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("target", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("signature", pa.string())]))


def scanned(raw_nodes: DataFrame) -> DataFrame:
    """(run_id, repo, file_path, language, kind, name, target, first, last, signature): members (target null) and sites."""
    files = (
        raw_nodes.where("type = 'file' AND code_snippet IS NOT NULL")
        .select("run_id", "repo", clean_path("file_path").alias("file_path"), language("file_path").alias("language"), F.col("code_snippet").alias("text")).where(F.col("language").isin(*LANGUAGES))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                [dict(zip(("kind", "name", "target", "first", "last", "signature"), r, strict=True)) for r in scan(t, lang)]
                for t, lang in zip(batch.column("text").to_pylist(), batch.column("language").to_pylist(), strict=True)
            ]
            keep = [batch.column(c) for c in ("run_id", "repo", "file_path", "language")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(rows, FACT)], names=["run_id", "repo", "file_path", "language", "rows"])

    schema = "run_id string, repo string, file_path string, language string, rows array<struct<kind string, name string, target string, first int, last int, signature string>>"
    return spread(files).mapInArrow(run, schema).select("run_id", "repo", "file_path", "language", F.inline("rows")).distinct()


def members(rows: DataFrame) -> DataFrame:
    """Classes, interfaces and functions among the scanned rows."""
    return rows.where("target IS NULL")


def sites(rows: DataFrame, *types: str) -> DataFrame:
    """(run_id, repo, from_file, from_name, target, type, weight) of the calls or bases among the scanned rows, as resolve_names reads them."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])[F.col("kind")]
    return rows.where(F.col("kind").isin(*(types or WEIGHT))).select("run_id", "repo", F.col("file_path").alias("from_file"), F.col("name").alias("from_name"), "target", F.col("kind").alias("type"), weight.alias("weight")).distinct()
