"""Generated, minified or vendored source files (problem 4).

Every file gets evidence for five labels (handwritten, generated, minified, vendored, blob) from its text, its name, its
header and its likeness to the reference copies.  Belief propagation (sum-product, in logarithms) then runs over the
directory trees: files hang on groups of siblings of one extension, groups on directories, directories on their parents.
The compatibility of parent and child says how likely a child of one label is under a parent of another, so that an
uncertain file follows its siblings and the folder it lies in, while strong evidence stands against them.

Messages are aggregations and joins over (directory, five numbers); a directory of a third of all files is one partial
sum per task.  The trees are contracted: a round rakes all leaves and takes every second directory out of runs without
branches, whose messages compose to one matrix, so that the number of rounds follows the logarithm of the tree and not
its depth; the rounds are replayed backwards for the messages that go down.

What a header says is learned from where files lie: the words of the comments at the top of files are counted over all
files, apart for library folders (and copies of the references) and all others, and the log odds of its words are the
evidence of a header.  Likeness is the share of the five-word shingles of a reference copy or of the file, whichever is
smaller, that both have; references of up to ``REFERENCE_BYTES`` of text are shared with the workers, beyond that the
same likeness comes from a join on shingles.

Defined results: null texts carry no evidence of their own and follow their directory; settings files are never cases;
rows of one id with several lives are one case if any of them is; repeated rows count once; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from graphloom.session import cut, spread
from graphloom.sources.tables import clean_path

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
SETTINGS = ("json", "yaml", "yml", "properties", "env", "toml", "ini")
REFERENCE_BYTES = 64_000_000
MOST_WORDS = 500_000  # entries of the list of header words that all workers share
RARE = 20_000  # a header word counts if one header in so many has it

# Compatibility of parent (row) and child (column), in the order of LABELS.
COMPATIBLE = np.array([
    [0.90, 0.03, 0.02, 0.03, 0.02],
    [0.05, 0.91, 0.01, 0.01, 0.02],
    [0.10, 0.03, 0.80, 0.04, 0.03],
    [0.015, 0.02, 0.06, 0.885, 0.02],
    [0.25, 0.05, 0.05, 0.05, 0.60],
])
ROOT = np.log([0.92, 0.02, 0.02, 0.02, 0.02])
BASE = np.array([0.0, -2.5, -3.0, -1.5, -3.0])

# What tools write at the top of their output; words of headers that copies of libraries carry, as a start.
MADE = re.compile(
    r"(?i)auto-?\s?generated|automatically (?:generated|created|produced|written)|\bgenerated (?:by|from|file|code|with|using|source)|@generated|do not (?:edit|modify|change)|changes (?:to this file )?will be (?:lost|overwritten)|edits will be|machine-(?:made|written|generated|produced)|regenerate (?:with|by|using)|(?:written|produced|created|built|emitted) by \S+ (?:compiler|generator)|produit par|ne pas (?:modifier|éditer|editer)|généré (?:par|automatiquement)|genere (?:par|automatiquement)|erzeugt (?:von|durch|mit)|nicht (?:bearbeiten|ändern|aendern|editieren)|automatisch (?:erzeugt|erstellt|generiert)|generado (?:por|automáticamente)|no (?:editar|modificar)|gerado (?:por|automaticamente)|não (?:editar|edite|modificar)|自動生成|this (?:file|code) (?:is|was) (?:generated|created|produced|written) by"
)
CARRIED = ("spdx", "license", "licence", "licensed", "redistribution", "redistributed", "version", "9.9")
LIBRARY_FOLDERS = ("vendor", "third_party", "third-party", "thirdparty", "node_modules", "bower_components", "external", "externals", "extern", "deps", "pods", "site-packages")
HEADER_WORD = re.compile(r"[^\W\d_]{2,}|\d+(?:\.\d+)+")
BLOCK_START, BLOCK_END = re.compile(r"^\s*(?:/\*|<!--|\"\"\")"), re.compile(r"\*/|-->|\"\"\"\s*$")
COMMENT_LINE = re.compile(r"^\s*(?://|#(?!include)|/\*|\*|--|;|<!--|\"\"\")")
DATA_LINE = re.compile(r"^\s*(?:[\[{(]?\s*(?:-?\d[\d.eExXa-fA-F_]*[fFlLuU]?|0[xX][0-9a-fA-F]+|\"[\w+/=\\. -]*\"|'[\w+/=\\. -]*')\s*[\])}]?\s*[,;+]?\s*)+[\])}]?[,;+]?\s*\\?$|^\s*\"?[A-Za-z0-9+/=]{40,}\"?\s*[+,;]?\s*$")
WORD = re.compile(r"\w+")
SHAPE = re.compile(r"\"[^\"]*\"|'[^']*'|\d+|[A-Z]\w*|\w*_\w+|[a-z]+[A-Z0-9]\w*")
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1)
def reference_shingles(texts: tuple[str, ...]) -> References:
    """Made once per worker."""
    return References(list(texts))


def name_evidence(name: str) -> np.ndarray:
    """From the name of a file."""
    low, e = name.lower(), np.zeros(5)
    if re.search(r"[.\-_](?:min|bundle|pack(?:ed)?|chunk|prod)\.(?:m?js|css)$", low):
        e[2] += 2.5
    if re.search(r"(?:_pb2?|\.pb|\.g|\.designer|\.generated|_generated|\.gen|_gen|_stubs?|\.stubs?|_grpc)\.\w+$", low):
        e[1] += 2.0
    if re.search(r"(?:font|glyphs?|blob|table|data|payload|fixture|lookup)s?\.\w+$", low):
        e[4] += 0.7
    return e


def directory_evidence(name: Column, depth: Column) -> list[Column]:
    """From the name of a directory; depth 1 lies at the root of the repo."""
    low = F.lower(name)
    library = low.isin(*LIBRARY_FOLDERS)
    tool = low.isin("gen", "generated", "__generated__", "generated-sources", "generated_sources", "autogen", "obj", "stubs")
    dist = low.isin("dist", "bundle", "bundles", "minified")
    zero = F.lit(0.0)
    return [
        zero,
        F.when(tool, 3.0).otherwise(0.0),
        F.when(dist, 1.0).otherwise(0.0),
        F.when(library & (depth == 1), 6.5).when(low == "node_modules", 5.0).when(library, 0.3).otherwise(0.0),
        zero,
    ]


def shingles(text: str) -> set[int]:
    w = WORD.findall(text)
    return {hash(x) for x in zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)}


class References:
    """Shingles of the reference copies: shingle -> copies."""

    def __init__(self, texts: list[str]):
        self.sizes, self.where = [], defaultdict(list)
        for k, t in enumerate(texts):
            s = shingles(t)
            self.sizes.append(len(s))
            for x in s:
                self.where[x].append(k)

    def likeness(self, text: str) -> float:
        own = shingles(text)
        if len(own) < 5:
            return 0.0
        shared: dict[int, int] = defaultdict(int)
        get = self.where.get
        for x in own:
            for k in get(x, ()):
                shared[k] += 1
        return max((n / min(len(own), self.sizes[k]) for k, n in shared.items()), default=0.0)


def periodicity(lines: list[str]) -> float | None:
    """The largest share of lines that have the shape of the line one to five before; None for short files.

    A shape is a line without blanks in which names, numbers and strings are all alike but keywords are not.
    """
    s = [SPACE.sub("", SHAPE.sub("a", x)) for x in lines if len(x.strip()) > 3 and not COMMENT_LINE.match(x)]
    n = len(s)
    if n < 8:
        return None
    return max(sum(s[i] == s[i - k] for i in range(k, n)) / (n - k) for k in range(1, 6))


def header(lines: list[str]) -> list[str]:
    """The comment lines at the top of a file: the whole leading block, and comments among its first lines of code."""
    top, inside = [], False
    for k, x in enumerate(lines):
        if inside:
            top.append(x)
            inside = not BLOCK_END.search(x)
        elif COMMENT_LINE.match(x):
            top.append(x)
            m = BLOCK_START.match(x)
            inside = m is not None and not BLOCK_END.search(x, m.end())
        elif k >= 8:
            break
    return top


def header_words(top: list[str]) -> list[str]:
    """Different words of a header in lower case; all version numbers are one word."""
    return sorted({"9.9" if x[0].isdigit() else x.lower() for line in top for x in HEADER_WORD.findall(line)})


def text_evidence(text: str, name: str, refs: References | None) -> tuple[np.ndarray, list[str]]:
    """From the text and the name of a file: log evidence, and the words of its header."""
    e = BASE + name_evidence(name)
    if not text.strip():
        return e, []
    lines = [x for x in text.split("\n") if x.strip()]
    top = header(lines)
    spaces = sum(map(text.count, " \t\n"))
    longest = max(map(len, lines))
    dense = spaces / len(text)
    mean = len(text) / len(lines)
    data = sum(1 for x in lines if DATA_LINE.match(x))
    share = data / len(lines)
    if share > 0.6 and data >= 8 or longest > 1500 and len(re.findall(r"[\d,xXa-fA-F\s\"+/=.-]", text)) > 0.93 * len(text):
        e[4] += 8.0
    elif longest > 350 and dense < 0.09 and mean > 90:
        e[2] += 7.5
    elif mean > 70 and dense < 0.07:
        e[2] += 3.0
    if refs is not None:
        e[3] += alike(refs.likeness(text))
    regular = periodicity(lines) if e[4] < 2 and e[2] < 2 else 0.0
    if any(MADE.search(x) for x in top):
        e[1] += 5.0 if regular is None or regular > 0.45 else 1.0
    if regular is not None and regular > 0.45:
        e[1] += 6.5 if regular > 0.65 else 2.5
    return e, header_words(top) if e[1] < 2 and e[2] < 2 and e[4] < 2 else []


def alike(near: float) -> float:
    return 9.0 if near > 0.75 else 5.5 if near > 0.5 else 0.0


def joined_likeness(files: DataFrame, references: DataFrame) -> DataFrame:
    """(id, repo, path, alike): the evidence of likeness by a join on shingles, for references too large to share."""

    def gram(c: str) -> Column:
        words = F.regexp_extract_all(c, F.lit(r"\w+"), F.lit(0))
        grams = F.transform(F.sequence(F.lit(1), F.size(words) - 4), lambda i: F.xxhash64(F.slice(words, i, 5)))
        return F.array_distinct(F.when(F.size(words) > 4, grams).otherwise(F.array().cast("array<bigint>")))

    refs = references.where("code_snippet IS NOT NULL").select("code_snippet").distinct().select(F.xxhash64("code_snippet").alias("ref"), gram("code_snippet").alias("g"))
    refs = refs.select("ref", F.size("g").alias("ref_size"), F.explode("g").alias("x"))
    own = files.select("id", "repo", "path", gram("text").alias("g")).select("id", "repo", "path", F.size("g").alias("size"), F.explode("g").alias("x")).where("size >= 5")
    shared = own.join(refs, "x").groupBy("id", "repo", "path", "size", "ref", "ref_size").agg(F.count(F.lit(1)).alias("n"))
    near = shared.groupBy("id", "repo", "path").agg(F.max(F.col("n") / F.least("size", "ref_size")).alias("near"))
    return near.select("id", "repo", "path", F.when(F.col("near") > 0.75, 9.0).when(F.col("near") > 0.5, 5.5).otherwise(0.0).alias("alike"))


def evidence(nodes: DataFrame, references: DataFrame, reference_bytes: int = REFERENCE_BYTES) -> DataFrame:
    """(id, repo, path, extension, e0..e4): log evidence of every file, settings files included as bystanders."""
    spark = nodes.sparkSession
    texts = references.where("code_snippet IS NOT NULL").select("code_snippet").distinct()
    small = (texts.agg(F.sum(F.octet_length("code_snippet"))).collect()[0][0] or 0) <= reference_bytes
    shared = spark.sparkContext.broadcast(tuple(r[0] for r in texts.collect()) if small else ())  # at most reference_bytes of text
    path = clean_path("file_path")
    files = nodes.where("type = 'file'").select(
        clean_path("id").alias("id"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce(path, F.lit("")).alias("path"), F.regexp_replace(F.regexp_replace("code_snippet", "^\ufeff", ""), "\r", "").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = reference_shingles(shared.value) if shared.value else None
        for batch in batches:
            texts, paths = batch.column("text").to_pylist(), batch.column("path").to_pylist()
            both = [text_evidence(t or "", p.rpartition("/")[2], known) for t, p in zip(texts, paths, strict=True)]
            e = np.array([x for x, _ in both]).reshape(-1, 5)
            keep = [batch.column(c) for c in ("id", "repo", "path")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(e[:, k]) for k in range(5)), pa.array([w for _, w in both], pa.list_(pa.string()))], names=["id", "repo", "path", *E, "head"])

    rows = spread(files).mapInArrow(run, "id string, repo string, path string, " + ", ".join(f"{c} double" for c in E) + ", head array<string>").distinct()
    if not small:
        rows = rows.join(joined_likeness(files.distinct(), references), ["id", "repo", "path"], "left").withColumn("e3", F.col("e3") + F.coalesce("alike", F.lit(0.0))).drop("alike")
    return with_headers(cut(rows)).withColumn("extension", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))


def with_headers(rows: DataFrame) -> DataFrame:
    """The evidence with that of the headers: log odds of their words between library folders and all others."""
    library = F.exists(F.split(F.lower("path"), "/"), lambda x: x.isin(*LIBRARY_FOLDERS)) | (F.col("e3") > 3)
    heads = rows.where(F.size("head") > 0).select(F.explode("head").alias("word"), library.cast("int").alias("lib"), F.lit(0).alias("one"))
    totals = rows.where(F.size("head") > 0).agg(F.count(F.lit(1)), F.sum(library.cast("int"))).collect()[0]
    n, inside = totals[0], totals[1] or 0
    words = heads.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("lib").alias("lib")).where(F.col("n") >= max(3, n // RARE))
    listed = words.limit(MOST_WORDS + 1).collect()
    if len(listed) > MOST_WORDS:
        return joined_headers(rows, words, n, inside)
    counts = {w: (2.0, 0.0) for w in CARRIED}
    for w, k, lib in listed:
        start = counts.get(w, (0.0, 0.0))
        counts[w] = (start[0] + lib, start[1] + k - lib)
    odds = {w: float(np.log((lib + 0.5) / (inside + 4)) - np.log((other + 0.5) / (n - inside + 4))) for w, (lib, other) in counts.items()}
    shared = rows.sparkSession.sparkContext.broadcast(odds)  # at most MOST_WORDS entries

    @F.pandas_udf("double")
    def said(head: pd.Series) -> pd.Series:
        get = shared.value.get
        return pd.Series([min(3.5, max(-3.5, sum(get(w, 0.0) for w in h))) if len(h) else 0.0 for h in head], dtype="float64")

    return rows.withColumn("e3", F.col("e3") + F.greatest(F.lit(0.0), said("head"))).drop("head")


def joined_headers(rows: DataFrame, words: DataFrame, n: int, inside: int) -> DataFrame:
    """The same evidence where the words are too many to share: headers meet the odds of their words in a join."""
    carried = F.when(F.col("word").isin(*CARRIED), 2.0).otherwise(0.0)
    odds = F.log((F.col("lib") + carried + 0.5) / (inside + 4)) - F.log((F.col("n") - F.col("lib") + 0.5) / (n - inside + 4))
    missing = rows.sparkSession.createDataFrame([(w,) for w in CARRIED], "word string").join(words.select("word"), "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("lib"))
    table = words.select("word", "n", F.col("lib").cast("bigint").alias("lib")).unionByName(missing).select("word", odds.alias("odds"))
    key = ["id", "repo", "path"]
    said = rows.select(*key, "head", F.explode("head").alias("word")).join(table, "word").groupBy(*key, "head").agg(F.least(F.lit(3.5), F.sum("odds")).alias("said"))
    return rows.join(said, [*key, "head"], "left").withColumn("e3", F.col("e3") + F.greatest(F.lit(0.0), F.coalesce("said", F.lit(0.0)))).drop("said", "head")


E = [f"e{k}" for k in range(5)]
M = [f"m{k}" for k in range(5)]
B = [f"b{k}" for k in range(5)]


def through(df: DataFrame, values: list[str], matrix: np.ndarray, out: list[str]) -> DataFrame:
    """df with a log message through a compatibility: for each row r, log sum over c of matrix[r, c] * exp(values[c]).

    ``values`` are SQL expressions.  In steps, so that no expression is written out many times in the generated code.
    """
    kept = [f"`{c}`" for c in df.columns if c not in out]
    df = df.selectExpr(*kept, *[f"{v} AS __v{k}" for k, v in enumerate(values)])
    df = df.selectExpr("*", "greatest(__v0, __v1, __v2, __v3, __v4) AS __top").selectExpr(*kept, "__top", *[f"exp(__v{k} - __top) AS __x{k}" for k in range(5)])
    sums = [" + ".join(f"__x{c} * {float(matrix[r, c])!r}D" for c in range(5)) for r in range(5)]
    return df.selectExpr(*kept, *[f"ln({t}) + __top AS {o}" for t, o in zip(sums, out, strict=True)])


# The same in arrays, where every row has a matrix of its own (25 numbers, row by row).
def plus(v: Column, w: Column) -> Column:
    return F.zip_with(v, w, lambda x, y: x + y)


NUMBERS = ArrayType(DoubleType())


def stacked(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float).reshape(len(s), -1)


def sent_on(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """log(A exp(v)) row by row."""
    top = v.max(1, keepdims=True, initial=-np.inf)
    return np.log(np.einsum("nrc,nc->nr", a, np.exp(v - top))) + top


@F.pandas_udf(NUMBERS)
def message(a: pd.Series, v: pd.Series) -> pd.Series:
    return pd.Series(list(sent_on(stacked(a).reshape(-1, 5, 5), stacked(v))))


@F.pandas_udf(NUMBERS)
def composed(a: pd.Series, v: pd.Series, b: pd.Series) -> pd.Series:
    """A diag(exp(v)) B up to a factor, what passes through a directory of one child; B where there is no such directory."""
    out = b.copy()
    has = a.notna().to_numpy()
    if has.any():
        v = stacked(v[has])
        m = np.einsum("nrj,nj,njc->nrc", stacked(a[has]).reshape(-1, 5, 5), np.exp(v - v.max(1, keepdims=True)), stacked(b[has]).reshape(-1, 5, 5)).reshape(-1, 25)
        out[has] = pd.Series(list(m / m.max(1, keepdims=True)), index=out.index[has])
    return out


@F.pandas_udf(StructType().add("u", NUMBERS).add("b", NUMBERS))
def back(a: pd.Series, v: pd.Series, pb: pd.Series, ca: pd.Series, cu: pd.Series) -> pd.DataFrame:
    """All that came up to a directory, and its belief, from the belief of its parent and what came up to its child."""
    u, m = stacked(v), stacked(a).reshape(-1, 5, 5)
    has = ca.notna().to_numpy()
    if has.any():
        u[has] += sent_on(stacked(ca[has]).reshape(-1, 5, 5), stacked(cu[has]))
    b = u + sent_on(m.transpose(0, 2, 1), stacked(pb) - sent_on(m, u)) if len(u) else u
    return pd.DataFrame({"u": list(u), "b": list(b)})


def parent(key: Column) -> Column:
    return F.regexp_replace(key, r"/[^/]*$", "")


KEY = ["repo", "key"]


def directories(groups: DataFrame) -> DataFrame:
    """(repo, key, pkey, depth, kids, v, a) of every directory above the groups: its evidence and the matrix to its parent."""
    here = groups.groupBy("repo", F.col("pkey").alias("key")).agg(*[F.sum(b).alias(b) for b in B])
    parts = F.split("key", "/")
    every = here.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("key")).distinct()
    every = every.withColumns({"depth": F.size(F.split("key", "/")) - 1, "pkey": F.when(F.col("key") != "", parent(F.col("key")))})
    kids = every.where("pkey IS NOT NULL").groupBy("repo", F.col("pkey").alias("key")).agg(F.count(F.lit(1)).alias("kids"))
    own = directory_evidence(F.regexp_extract("key", r"([^/]*)$", 1), F.col("depth"))
    v = F.array(*[F.coalesce(F.col(b), F.lit(0.0)) + e for b, e in zip(B, own, strict=True)])
    flat = F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in COMPATIBLE.ravel()) + ")")
    return every.join(here, KEY, "left").join(kids, KEY, "left").select(*KEY, "pkey", "depth", F.coalesce("kids", F.lit(0)).alias("kids"), v.alias("v"), flat.alias("a"))


def contracted(dirs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The roots with all that came up, and what every round took out: (repo, key, pkey, v, a[, ckey, ca])."""
    live, gone = cut(dirs), []
    while not live.where("pkey IS NOT NULL").isEmpty():
        odd = lambda c, bit=len(gone) % 6: F.shiftright(F.col(c), bit).bitwiseAND(F.lit(1)) == 1
        leaf = F.col("kids") == 0
        sent = live.where("pkey IS NOT NULL").withColumn("m", F.when(leaf, message("a", "v")))
        news = sent.groupBy("repo", F.col("pkey").alias("key")).agg(
            F.array(*[F.coalesce(F.sum(F.get("m", F.lit(k))), F.lit(0.0)) for k in range(5)]).alias("came"), F.count_if(~leaf).alias("left"), F.max(F.when(~leaf, F.struct("key", "depth", "a"))).alias("child")
        )
        v = F.when(F.col("came").isNull(), F.col("v")).otherwise(plus(F.col("v"), F.col("came")))
        step = live.join(news, KEY, "left").select(*KEY, "pkey", "depth", leaf.alias("raked"), F.coalesce(F.col("kids") > F.col("left"), F.lit(False)).alias("fed"), F.coalesce("left", F.lit(0)).alias("kids"), v.alias("v"), "a", "child")
        between = F.col("pkey").isNotNull() & (F.col("kids") == 1) & ~F.col("fed") & odd("depth") & ~odd("child.depth")  # no two that touch, none that a leaf fed
        step = step.withColumn("out", F.col("pkey").isNotNull() & (F.col("raked") | between))
        moved = step.where("out AND NOT raked").select("repo", F.col("child.key").alias("key"), F.col("pkey").alias("above"), F.col("a").alias("xa"), F.col("v").alias("xv"))
        state = cut(
            step.join(moved, KEY, "left").select(
                *KEY, F.coalesce("above", "pkey").alias("pkey"), "depth", "kids", "v", composed("xa", "xv", "a").alias("a"), "out",
                F.when(F.col("out") & ~F.col("raked"), F.col("child.key")).alias("ckey"), F.when(F.col("out") & ~F.col("raked"), F.col("child.a")).alias("ca"),
            )
        )
        gone.append(state.where("out").select(*KEY, "pkey", "v", "a", "ckey", "ca"))
        live = state.where("NOT out").drop("out", "ckey", "ca")
    return live, gone


def propagate(files: DataFrame) -> DataFrame:
    """Beliefs of the files: (id, repo, path, extension, b0..b4), up to a constant."""
    group = F.concat(F.lit("/"), F.when(F.instr("path", "/") > 0, F.regexp_replace("path", r"/[^/]*$", "/")).otherwise(""), F.lit("*."), F.col("extension"))
    sent = through(files.withColumn("key", group), E, COMPATIBLE, M)
    groups = through(sent.groupBy(*KEY).agg(*[F.sum(m).alias(m) for m in M]), M, COMPATIBLE, B).withColumn("pkey", parent(F.col("key")))
    groups = cut(groups)  # b: what a group sends to its directory
    roots, gone = contracted(directories(groups))
    known = roots.select(*KEY, F.col("v").alias("u"), plus(F.col("v"), F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in ROOT) + ")")).alias("b"))
    for part in reversed(gone):
        above = known.select("repo", F.col("key").alias("pkey"), F.col("b").alias("pb"))
        below = known.select("repo", F.col("key").alias("ckey"), F.col("u").alias("cu"))
        here = part.join(above, ["repo", "pkey"]).join(below, ["repo", "ckey"], "left").select(*KEY, back("a", "v", "pb", "ca", "cu").alias("r"))
        known = known.unionByName(cut(here.select(*KEY, "r.u", "r.b")))
    above = groups.join(known.select("repo", F.col("key").alias("pkey"), F.col("b").alias("pb")), ["repo", "pkey"])
    down = through(above, [f"pb[{k}] - {b}" for k, b in enumerate(B)], COMPATIBLE.T, ["d" + b for b in B])
    beliefs = down.select(*KEY, *[(F.col(m) + F.col("d" + b)).alias("p" + b) for m, b in zip(M, B, strict=True)])
    final = through(sent.join(beliefs, KEY), [f"p{b} - {m}" for b, m in zip(B, M, strict=True)], COMPATIBLE.T, B)
    return final.select("id", "repo", "path", "extension", *[(F.col(e) + F.col(b)).alias(b) for e, b in zip(E, B, strict=True)])


def labelled(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(id, repo, path, label, probability) of every file that is not a settings file."""
    beliefs = cut(propagate(cut(evidence(nodes, references))))  # written, else a filter on the label would repeat all of it
    top = F.greatest(*[F.col(b) for b in B])
    label = F.coalesce(*[F.when(F.col(b) == top, F.lit(name)) for b, name in zip(B, LABELS, strict=True)])
    total = sum((F.exp(F.col(b) - top) for b in B[1:]), F.exp(F.col(B[0]) - top))
    return beliefs.where(~F.col("extension").isin(*SETTINGS)).select("id", "repo", "path", label.alias("label"), F.round(1 / total, 4).alias("probability"))


def found(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """(id)."""
    return labelled(nodes, references).where(F.col("label") != LABELS[0]).select("id").distinct()


def rates(nodes: DataFrame, references: DataFrame) -> DataFrame:
    """Files by repo and label."""
    return labelled(nodes, references).groupBy("repo", "label").agg(F.count_distinct("id").alias("files"))
