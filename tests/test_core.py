"""Small fixtures of the core operators."""

import os
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from graphloom import evaluation
from graphloom.api import CodeGraph
from graphloom.functions import text as X
from graphloom.operators import enrich, lifecycle, references, resolve, search, snapshots, traversal
from graphloom.operators import graph as G
from graphloom.sources import extract, files
from graphloom.sources.tables import clean_path
from graphloom.streaming.ingest import GraphStream

SNAP = "repo string, snapshot_no int, id string, type string, name string, language string, file_path string, line_range struct<start:int,end:int>, signature string, file_hash string, layer string, complexity string, tags array<string>, first_seen_commit string, last_seen_commit string, loaded_at timestamp_ntz"
T = [datetime(2024, 1, d) for d in range(1, 29)]


def snap(no, id, t=T[0], repo="r", **k):
    base = dict(type="class", name="n", language="go", file_path="a/b.go", line_range=(1, 2), signature="x y", file_hash="h", layer=None, complexity="", tags=["a", "b"])
    base.update(k)
    return (repo, no, id, base["type"], base["name"], base["language"], base["file_path"], base["line_range"], base["signature"], base["file_hash"], base["layer"], base["complexity"], base["tags"], None, None, t)


def values(df):
    return sorted(tuple(r) for r in df.collect())


def numbers(spark, *nos, repo="r"):
    return spark.createDataFrame([(repo, n) for n in nos], "repo string, snapshot_no int")


BOTH = pytest.mark.parametrize("way", [snapshots.replay, snapshots.consecutive])


@BOTH
def test_snapshot_changes(spark, way):
    rows = [
        snap(3, "a"), snap(3, "b"), snap(3, None), snap(3, "s\\x "),
        snap(7, "a", signature=" x   y ", tags=["b", "a", "a"], layer="", complexity=None), snap(7, "c"), snap(7, "s/x", file_path="a\\b.go"),
        snap(8, "a", name="m", t=T[1]), snap(8, "a", t=T[0]), snap(8, "c", line_range=None), snap(8, "c", line_range=None),
    ]
    found = values(way(spark.createDataFrame(rows, SNAP), numbers(spark, 3, 7, 8)))
    assert found == [("r", 7, "b", "removed"), ("r", 7, "c", "added"), ("r", 8, "a", "changed"), ("r", 8, "c", "changed"), ("r", 8, "s/x", "removed")]


def test_repeated_rows_shrink_before_the_shuffle(spark):
    rows = spark.createDataFrame([snap(1, "a") for _ in range(8)], SNAP)
    plan = snapshots.replay(rows, numbers(spark, 1, 2))._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" not in plan and "REPARTITION" not in plan and "partial_max" in plan
    plan = snapshots.placed(rows, numbers(spark, 1, 2))._jdf.queryExecution().sparkPlan().toString()
    assert "REPARTITION" not in plan and "partial_max" in plan


def test_probes_do_not_shuffle(spark):
    """Bucketed indexes meet bucket by bucket: the only exchange left is that of the list of snapshots."""
    rows = spark.createDataFrame([snap(n, f"k{k}", name=f"{k % n}") for n in (1, 2, 3) for k in range(50)], SNAP)
    df = snapshots.consecutive(rows, numbers(spark, 1, 2, 3), 4)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.find("Initial Plan")]
    assert "SelectedBucketsCount: 4 out of 4" in plan or "Bucketed: true" in plan
    assert "hashpartitioning(repo" not in plan or "id#" not in plan[plan.find("hashpartitioning(repo") : plan.find("hashpartitioning(repo") + 60]


@BOTH
def test_snapshot_empty_and_extra(spark, way):
    none = spark.createDataFrame([], SNAP)
    assert values(way(none, numbers(spark, 1, 2))) == []
    rows = spark.createDataFrame([snap(1, "a"), snap(3, "a")], SNAP).withColumn("ord", F.lit("clash")).withColumn("h1", F.lit(1))
    assert values(way(rows, numbers(spark, 1, 2, 3).withColumn("next_no", F.lit(9)))) == [("r", 2, "a", "removed"), ("r", 3, "a", "added")]
    changed = snapshots.changed_fields(spark.createDataFrame([snap(1, "a"), snap(2, "a", name=None, tags=["z"])], SNAP), numbers(spark, 1, 2))
    assert values(changed) == [("r", 2, "a", "name", "n", ""), ("r", 2, "a", "tags", "a,b", "z")]


def test_snapshot_index_equals_replay(spark, tmp_path):
    rows = [snap(1, "a"), snap(1, "b"), snap(2, "a", name="m"), snap(2, "c"), snap(3, "c"), snap(3, "a", name="m")]
    all_rows, index, found = spark.createDataFrame(rows, SNAP), snapshots.SnapshotIndex(spark, str(tmp_path / "i")), []
    for n in (1, 2, 3):
        changes = index.advance(all_rows.where(F.col("snapshot_no") == n))
        found += [] if changes is None else [(r, n, i, k) for r, i, k in values(changes.select("repo", "id", "change_kind"))]
        if n == 2:
            assert [(r["id"], r["old_value"]["name"], r["new_value"]["name"]) for r in changes.where("old_value IS NOT NULL").collect()] == [("a", "n", "m")]
            index = snapshots.SnapshotIndex(spark, str(tmp_path / "i"))  # as a new session opens it
    assert sorted(found) == values(snapshots.replay(all_rows, numbers(spark, 1, 2, 3)))


def test_changed_fields_beyond_the_shared_keys(spark, monkeypatch):
    rows, nos = spark.createDataFrame([snap(n, f"k{k}", name=f"{k % n}", t=T[n]) for n in (1, 2, 3) for k in range(40)], SNAP), numbers(spark, 1, 2, 3)
    want = values(snapshots.changed_fields(rows, nos))
    monkeypatch.setattr(snapshots, "MOST_KEYS", 3)
    assert values(snapshots.changed_fields(rows, nos)) == want and want


def test_generations(spark, tmp_path):
    """A generation comes into force whole; one that was not published is not seen; buckets are rewritten one by one."""
    from graphloom.sources.generations import Generations

    g = Generations(spark, str(tmp_path))
    assert g.read("t") is None and g.state() == {}
    g.write(t=spark.range(3))
    assert Generations(spark, str(tmp_path)).read("t") is None
    g.publish()
    g.write(t=spark.range(9))  # and now the writer dies
    other = Generations(spark, str(tmp_path))
    assert other.read("t").count() == 3
    other.write_buckets("u", spark.range(10).withColumn("b", F.col("id") % 3), "b", [0, 1, 2])
    other.publish()
    before = other.state()["u"]
    other.write_buckets("u", other.read("u", [1]).select(F.col("id") + 100).toDF("id").withColumn("b", F.lit(1)), "b", [1])
    other.publish()
    assert sorted(r[0] for r in other.read("u").select("id").collect()) == [0, 2, 3, 5, 6, 8, 9, 101, 104, 107]
    assert {b for b, at in other.state()["u"].items() if before[b] == at} == {"0", "2"}
    other.write_buckets("u", spark.range(0).withColumn("b", F.lit(0)), "b", [0])
    other.publish()
    assert set(other.state()["u"]) == {"1", "2"}


NODE = "id string, created_at timestamp_ntz, deleted_at timestamp_ntz"
EDGE = "id string, type string, from_id string, to_id string, unresolved boolean, created_at timestamp_ntz"


def test_orphans(spark):
    nodes = spark.createDataFrame([("n", T[5], T[10]), ("n", T[12], None), ("m", T[5], None), ("m", T[5], None), (None, T[1], None)], NODE)
    edges = spark.createDataFrame(
        [
            ("e1", "CALLS", "n", "m ", None, T[6]), ("e1", "CALLS", "n", "m ", None, T[6]), ("e2", "CALLS", "n", "x", True, T[10]), ("e3", "CALLS", "m", "x", False, T[11]),
            ("e4", "CALLS", "m", "n", False, T[11]), ("e5", "CALLS", "m", None, False, T[2]), ("e6", "CALLS", "n", "m", False, None), ("e7", "CALLS", "y\\z", "n", False, T[20]), ("e8", "CALLS", "y/z", "m", False, None),
        ],
        EDGE,
    )
    found = values(references.orphans(edges, nodes).select("edge_id", "side", "reason"))
    assert found == [("e2", "from", "late"), ("e3", "to", "missing"), ("e4", "to", "late"), ("e5", "from", "late"), ("e7", "from", "missing"), ("e8", "from", "missing")]
    counts = references.orphan_counts(edges, nodes)
    assert counts.agg(F.sum("cases")).first()[0] == 6
    assert references.orphans(edges.limit(0), nodes).count() == 0
    assert references.orphans(edges, nodes.limit(0)).where("reason <> 'missing'").count() == 0


def test_orphan_of_deleted_node(spark):
    nodes = spark.createDataFrame([("n", T[1], T[2])], NODE)
    edges = spark.createDataFrame([("e", "CALLS", "n", "n", False, T[3])], EDGE)
    assert values(references.orphans(edges, nodes).select("side", "reason")) == [("from", "deleted"), ("to", "deleted")]


def one(spark, column, **cells):
    return spark.createDataFrame([Row(**cells)]).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, X.slugify("a"), a="Hello  World_x, (Test)!") == "hello-world-x-test"
    assert one(spark, X.heading_slug("a"), a=" ?? ") == "section"
    assert one(spark, X.sig_hash("a"), a="f( a,  b )") == one(spark, X.sig_hash("a"), a=" f( a, b ) ")
    assert len(one(spark, X.sig_hash("a"), a="x")) == 4
    assert one(spark, X.name_tokens("a"), a="HTTPServerName_v2") == "http server name v2 httpservername_v2"
    assert one(spark, X.strip_test_suffix("a"), a="CandidateServiceTests") == "CandidateService"
    assert one(spark, X.strip_test_suffix("a"), a="candidate.service.spec") == "candidate.service"
    assert one(spark, X.mirror_path("a"), a="tests/Services/CandidateServiceTest.cs") == "src/Services/CandidateService.cs"
    assert one(spark, X.mirror_path("a"), a="src/Services/CandidateService.cs") is None
    assert one(spark, X.resolve_link("a", F.lit("docs/x/y.md")), a="../z.md#part") == "docs/z.md"
    assert one(spark, X.resolve_link("a", F.lit("docs/y.md")), a="https://h.example/z.md") is None
    assert one(spark, X.source_slice(F.col("a"), F.lit(2), F.lit(3)), a="1\n2\n3\n4") == "2\n3"
    assert one(spark, X.fallback_summary(F.lit("class"), "a"), a="Foo") == "[fallback] Class 'Foo'."


@pytest.mark.parametrize(
    "kind, name, path, layer",
    [
        ("class", "FooController", "src/x/y.cs", "controller"), ("class", "Foo", "src/services/y.cs", "service"), ("class", "FooController", "src/models/y.cs", "model"),
        ("class", "Foo", "src/x/y.cs", None), ("file", "FooService", "src/services/y.cs", None), ("function", "makeHelper", "src/x/y.cs", "utility"), ("class", "OrderDto", "lib/y.cs", "model"),
    ],
)
def test_layers(spark, kind, name, path, layer):
    assert one(spark, X.assign_layer("k", "n", "p"), k=kind, n=name, p=path) == layer


def test_stable_ids(spark):
    assert one(spark, X.node_id(F.lit("file"), F.lit("r"), "p", F.lit("x"), F.lit("")), p=" a\\b.ts") == "file:r:a/b.ts"
    assert one(spark, X.node_id(F.lit("section"), F.lit("r"), "p", F.lit("Known gaps"), F.lit("")), p="d.md") == "doc:r:d.md#known-gaps"


def sites(spark, *rows):
    return spark.createDataFrame(rows, "repo string, from_file string, from_name string, target string, weight double")


def test_call_resolution(spark):
    registry = spark.createDataFrame([("r", "a.cs", "GetFoo", "1"), ("r", "a.cs", "GetBar", "2"), ("r", "b.cs", "DoThing", "3")], "repo string, file string, name string, id string")
    s = sites(spark, ("r", "a.cs", "GetFoo", "GetBar", 0.8), ("r", "b.cs", "DoThing", "GetFoo", 0.8), ("r", "b.cs", "Nobody", "GetFoo", 0.8), ("r", "a.cs", "GetFoo", "GetFoo", 0.8))
    assert values(resolve.resolve_names(s, registry)) == [("1", "2", False, 0.8), ("3", "1", True, 0.8)]
    only = spark.createDataFrame([("r", "a.cs")], "repo string, from_file string")
    assert values(resolve.resolve_names(s, registry, only)) == [("1", "2", False, 0.8)]


def test_import_resolution(spark):
    i = spark.createDataFrame([("m", "src/app/foo.ts", "./bar"), ("m", "src/app/foo.ts", "../x"), ("m", "src/app/foo.ts", "@angular/core")], "repo string, path string, import_path string")
    f = spark.createDataFrame([("m", "src/app/bar.ts", "file:m:src/app/bar.ts"), ("m", "src/x/index.ts", "file:m:src/x/index.ts")], "repo string, path string, id string")
    assert values(resolve.resolve_imports(i, f)) == [
        ("file:m:src/app/foo.ts", "file:m:src/app/bar.ts", False, 1.0), ("file:m:src/app/foo.ts", "file:m:src/x/index.ts", False, 1.0), ("file:m:src/app/foo.ts", "module:m:@angular/core", True, 0.7),
    ]


def test_document_links_of_many_names(spark):
    """A section keeps every link however many names and homonyms it has."""
    nodes = spark.createDataFrame([(f"function:r:f{k}.py:helper{k % 20}", "function", f"helper{k % 20}", "r", None) for k in range(40)], "id string, type string, name string, repo string, deleted_at timestamp")
    texts = spark.createDataFrame([("long", "r", " ".join(f"helper{k}" for k in range(20))), ("short", "r", "see helper1.")], "section string, repo string, text string")
    got = resolve.document_links(texts, nodes).groupBy("src").agg(F.count("dst").alias("n"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    assert {tuple(r) for r in got.collect()} == {("long", 40, 0.5, 0.5), ("short", 2, 0.5, 0.5)}


def test_innermost_scope(spark):
    s = spark.createDataFrame([("x", "r", "p", 5)], "site string, repo string, path string, line int")
    held = spark.createDataFrame([("big", "r", "p", 1, 9), ("small", "r", "p", 4, 6), ("off", "r", "p", 6, 7)], "scope string, repo string, path string, start int, end int")
    assert values(resolve.innermost_scope(s, held)) == [("x", "small")]


def graph(spark):
    n = [("c", "class", "Ctl", "controller"), ("s", "function", "svc", "service"), ("d", "function", "dao", "repository"), ("z", "function", "lone", None)]
    nodes = spark.createDataFrame([(i, t, m, "r", "go", f"src/{i}.go", None, l, ["t"], None, None) for i, t, m, l in n], "id string, type string, name string, repo string, language string, file_path string, summary string, layer string, tags array<string>, signature string, deleted_at timestamp_ntz")
    edges = spark.createDataFrame([("c", "s", "CALLS", 0.8), ("s", "d", "CALLS", 0.8), ("d", "s", "CALLS", 0.8), ("s", "s", "CALLS", 0.0)], "src string, dst string, type string, weight double").withColumn("unresolved", F.lit(False)).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    return nodes, edges


def test_traversal(spark):
    nodes, edges = graph(spark)
    start = nodes.where("id = 'd'").select("id")
    up = values(traversal.trails(edges, start, 3, True).select("id", "depth", F.array_join("path_ids", ">")))
    assert up == [("c", 2, "c>s>d"), ("d", 2, "d>s>d"), ("s", 1, "s>d")]  # the edge s>d is not walked twice
    chains = values(traversal.call_chains(edges, nodes.where("id = 'c'").select("id")))
    assert chains == [("c", "d", 2, "c>s>d"), ("c", "s", 1, "c>s")]
    dead, counters = traversal.dead_code(G.intra_repo_calls(edges, nodes), nodes)
    assert [r["id"] for r in dead.collect()] == ["z"]
    assert values(counters) == [("r", 1, 3, 2, 1)]


def test_neighbours(spark):
    nodes, edges = graph(spark)
    found = values(G.neighbours(edges, nodes, nodes.where("id = 's'")))
    assert [x[1] for x in found].count("s") == 1
    assert ("s", "s", "CALLS", 1.0, "function", "svc") in found


def test_tools_and_evaluation(spark):
    nodes, edges = graph(spark)
    tools = CodeGraph(nodes, edges)
    assert tools.get_node("nothing") is None
    assert tools.trace_call_chain("c", "d")["depth"] == 2
    assert tools.trace_call_chain("c", "z") is None
    assert [r["id"] for r in tools.find_nodes("svc").collect()] == ["s"]
    assert tools.impact_analysis("d")["layer_breakdown"] == {"controller": 1, "service": 2, "repository": 2}
    questions = [
        {"id": "Q1", "tool": "trace_call_chain", "input": {"from_id": "c", "to_id": "d"}, "assertions": [{"type": "chain_length", "value": 3}, {"type": "chain_contains_name", "name": "svc"}]},
        {"id": "Q2", "tool": "get_node", "input": {"id": "missing"}, "assertions": [{"type": "is_null"}]},
        {"id": "Q3", "tool": "get_node", "input": {"id": "s"}, "assertions": [{"type": "min_neighbors", "value": 2}, {"type": "field_equals", "field": "layer", "value": "service"}]},
        {"id": "Q4", "tool": "get_node", "input": {"id": "s"}, "assertions": [{"type": "min_neighbors", "value": 99}]},
    ]
    result = evaluation.run(questions, tools)
    assert [x["passed"] for x in result["questions"]] == [True, True, True, False]
    assert "3 of 4 passed" in evaluation.report(result)


def test_fusion(spark):
    lists = [spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(x)], "query string, id int, rank int") for x in ([1, 2, 3], [2, 4, 1])]
    assert [r["id"] for r in search.fuse(lists, "id", 4).orderBy("rank").collect()] == [2, 1, 4, 3]


def test_bm25_orders_by_term_frequency(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, "gamma"), (4, None)], "id int, t string")
    q = spark.createDataFrame([("q", "Alpha?")], "query string, q string")
    assert [r["id"] for r in search.bm25(docs, "id", F.col("t"), q).orderBy("rank").collect()] == [2, 1]


def test_whole_texts_as_queries(spark, monkeypatch):
    """The same ranks as brute force over whole texts, in one block of queries or several."""
    import math
    import re
    from collections import Counter, defaultdict

    from graphloom.plans import traversal_queries

    texts = {k: " ".join(f"Wort{(k * j * j + j) % 41}é, {j % 7}" for j in range(3 + k % 23)) for k in range(120)} | {120: "", 121: "é", 122: "Short, 12 Café"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(traversal_queries, "table", lambda s, d, t: docs)
    assert {r["q"] for r in traversal_queries.text_queries(spark, "").collect()} == {texts[0], texts[50], texts[100]}
    words = {k: [w for w in re.split(r"[\W_]+", t.lower()) if w] for k, t in texts.items()}
    df, mean = Counter(w for ws in words.values() for w in set(ws)), sum(map(len, words.values())) / len(words)
    want = []
    for q in range(0, 123, 2):
        score = defaultdict(float)
        for k, ws in words.items():
            for w in set(words[q]) & set(ws):
                tf = ws.count(w)
                score[k] += math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        want += [(q, k, rank) for rank, (k, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10], 1)]
    asked = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("query"), F.col("text").alias("q"))
    for block, rare in ((2048, 0.02), (16, 0.5)):
        monkeypatch.setattr(search, "BLOCK", block)
        monkeypatch.setattr(search.QueryBlock, "FREQUENT", rare)
        got = search.bm25_texts(docs, "doc_id", F.col("text"), asked)
        assert sorted((r["query"], r["doc_id"], r["rank"]) for r in got.collect()) == sorted(want)


def test_upserts(spark):
    raw = spark.createDataFrame(
        [("run", "class", "A", "go", "src/models/a.go", "r", (1, 2), None, None, {}, T[1]), ("run", "class", "A", "go", "src\\models\\a.go", "r", (3, 4), None, None, {}, T[2]), ("run", "endpoint", "e", "go", "x", "r", None, None, None, {}, T[2])],
        "run_id string, type string, name string, language string, file_path string, repo string, line_range struct<start:int,end:int>, signature string, code_snippet string, extra map<string,string>, extracted_at timestamp_ntz",
    )
    new = lifecycle.normalised(raw)
    row = new.first()
    assert (new.count(), row["id"], row["layer"], row["line_range"]["start"]) == (1, "class:r:src/models/a.go:A", "model", 3)
    old = spark.createDataFrame([], "id string, type string, name string, repo string, language string, file_path string, signature string, signature_hash string, file_hash string, line_range struct<start:int,end:int>, layer string, first_seen_commit string, last_seen_commit string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")
    first = lifecycle.upsert_nodes(old, new, F.lit("c1"), F.lit(T[3]).cast("timestamp_ntz"))
    gone = lifecycle.soft_delete_files(first.drop("action"), new.select("repo", "file_path"), F.lit(T[4]).cast("timestamp_ntz"))
    assert gone.first()["deleted_at"] is not None
    again = lifecycle.upsert_nodes(gone.select(*old.columns), new, F.lit("c2"), F.lit(T[5]).cast("timestamp_ntz")).first()
    assert (again["action"], again["first_seen_commit"], again["last_seen_commit"], again["deleted_at"]) == ("matched", "c1", "c2", None)


def test_edge_upsert_keeps_first_weight(spark):
    old = spark.createDataFrame([("a", "b", "TESTS", 0.9, False, T[1])], "src string, dst string, type string, weight double, unresolved boolean, created_at timestamp_ntz")
    new = spark.createDataFrame([("a", "b", "TESTS", 0.6, False), ("a", "c", None, 0.5, True)], "src string, dst string, type string, weight double, unresolved boolean")
    now = F.lit(T[2]).cast("timestamp_ntz")
    assert values(lifecycle.upsert_edges(old, new, now).select("dst", "type", "weight")) == [("b", "TESTS", 0.9), ("c", "REFERENCES", 0.5)]
    assert values(lifecycle.upsert_edges(old, new, now, True).where("dst = 'b'").select("weight")) == [(0.6,)]


def test_delete_needs_confirmation(spark):
    nodes, edges = graph(spark)
    with pytest.raises(ValueError):
        lifecycle.delete_repos(nodes, edges, ["r"])
    assert lifecycle.delete_repos(nodes, edges, ["r"], True)[1].count() == 0


def test_markdown(spark):
    docs = spark.createDataFrame([(1, "# One\ntext\n```\n# not\n[no](x.md)\n```\n## Two two\n[a](docs/api.md) [b](https://h.example/x)\n##### five"), (2, None), (3, "")], "doc_id int, text string")
    assert values(extract.sections(docs)) == [(1, 0, 1, "One", "one"), (1, 1, 2, "Two two", "two-two")]
    assert values(extract.links(docs)) == [(1, "a", "docs/api.md"), (1, "b", "https://h.example/x")]


SCRIPT = """import { a } from './a'
export class Relay extends Base {
  private items = new Map();
  constructor(limit) {
    super(limit);
  }
  mergeRelay(source, limit) {
    if (source) {
      call(source, () => {
        other(limit);
      });
    }
    for (const x of source) { use(x); }
    call(
      source, (x) => {
        return x;
      });
  }
  static async fetchAll(
    url: string,
    most = size(url),
  ): Promise<{ a: number }> {
    return await get(url);
  }
  get size(): number { return 1; }
  *walk() {
  }
  onClick = async (e) => {
  };
}
interface Shape {
  area(): number;
  parts(n: number): { a: number };
  wide(n: number): Promise<{ a: number }>;
}
export const twice = (x) => x * 2;
const typed: (x: number) => void = (x) => {
};
let old = function (x) { return x; };
const total = list.map((x) => x);
const one = x => x;
/**
 * example(a) {
 */
async function plain() {
}
"""


def test_methods_and_arrows_of_scripts(spark):
    rows = [("1", "r", "file", "src/relay.ts", SCRIPT), ("1", "r", "file", "src/relay.js", "const o = {\r\n  open(a) {\r\n  },\r\n};\r\n")]
    f = extract.facts(spark.createDataFrame(rows, "run_id string, repo string, type string, file_path string, code_snippet string")).where("kind = 'function'")
    got = {(r["name"], r["line"]) for r in f.where("language = 'typescript'").collect()}
    assert got == {("mergeRelay", 7), ("fetchAll", 19), ("size", 25), ("walk", 26), ("onClick", 28), ("twice", 36), ("typed", 37), ("old", 39), ("one", 41), ("plain", 45)}
    assert [(r["name"], r["line"]) for r in f.where("language = 'javascript'").collect()] == [("open", 2)]


def test_facts_hold_the_functions_of_raw_nodes(spark):
    """Every function row of a script that stands in the text of its file is extracted at its line."""
    raw = spark.read.parquet("/root/testdata/sf0.001/raw_nodes.parquet")
    f = extract.facts(raw).where("kind = 'function'").select("run_id", "repo", "file_path", "name", "line")
    at = lambda df: df.withColumn("file_path", clean_path("file_path"))
    texts = at(raw.where("type = 'file' AND code_snippet IS NOT NULL").select("run_id", "repo", "file_path", F.split("code_snippet", "\n").alias("lines")))
    want = at(raw.where("type = 'function' AND language IN ('javascript', 'typescript')").select("run_id", "repo", "file_path", "name", F.col("line_range.start").alias("line")))
    want = want.join(texts, ["run_id", "repo", "file_path"]).where("contains(get(lines, line - 1), name)").drop("lines").distinct()
    assert want.count() > 10 and want.join(f, ["run_id", "repo", "file_path", "name", "line"], "left_anti").count() == 0


def test_files_and_changes(spark, tmp_path):
    for p in ("src/a.ts", "src/b.py", "node_modules/c.ts", "readme.md"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("export function hello() {}\n")
    assert [r["file_path"] for r in files.listed(spark, str(tmp_path)).orderBy("file_path").collect()] == ["readme.md", "src/a.ts"]
    lines = spark.createDataFrame([("A\tx.ts",), ("R095\told.ts\tnew.ts",), ("T\ty",), ("D\tz",)], "value string")
    assert values(files.changes(lines).select("status", "path")) == [("A", "x.ts"), ("D", "z"), ("R", "new.ts")]
    nodes, edges = graph(spark)
    empty = spark.createDataFrame([], "id string, type string, name string, repo string, language string, file_path string, signature string, signature_hash string, file_hash string, line_range struct<start:int,end:int>, layer string, first_seen_commit string, last_seen_commit string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz")
    g = CodeGraph(empty, edges).ingest_repo(str(tmp_path), "r", "c1")
    ids = {r["id"] for r in g.nodes.collect()}
    assert ids == {"file:r:readme.md", "file:r:src/a.ts", "doc:r:readme.md"} | {i for i in ids if i.startswith("function:r:src/a.ts:hello:")} and len(ids) == 4
    assert g.edges.count() == edges.count()


def test_enrichment(spark):
    n = spark.createDataFrame([("a", "class", "FooBar", "// Counts the parcels.\nclass FooBar {}"), ("b", "file", None, None)], "id string, type string, name string, text string")
    found = {r["id"]: r for r in enrich.summaries(n).collect()}
    assert found["a"]["summary"] == "Counts the parcels." and found["a"]["tags"] == ["bar", "foo"]

    class Broken:
        def summarise(self, rows):
            raise OSError

    assert [r["summary"] for r in enrich.summaries(n, Broken).collect()] == [None, None]
    assert {len(r["embedding"]) for r in enrich.embeddings(n, "id", "text").collect()} == {64}


def test_stream_is_idempotent(spark, tmp_path):
    schema = "run_id string, type string, name string, language string, file_path string, repo string, line_range struct<start:int,end:int>, signature string, code_snippet string, extra map<string,string>, extracted_at timestamp_ntz"
    rows = [("r1", "class", "A", "go", "a.go", "r", (1, 2), None, None, {}, T[1]), ("r2", "class", "A", "go", "a.go", "r", (5, 6), None, None, {}, T[2]), ("r2", "class", "B", "go", "a.go", "r", (7, 8), None, None, {}, T[2])]
    for k, r in enumerate((rows[:1], rows[1:])):
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    g = GraphStream(spark, str(tmp_path / "graph"))
    read = spark.read.schema(schema).parquet(str(tmp_path / "in/*")).schema
    g.start(str(tmp_path / "in/*"), read, str(tmp_path / "progress"), 1).awaitTermination()
    assert g.nodes().count() == 2
    before = g.applied()
    g.merge(spark.createDataFrame(rows[:1], schema), before)  # a batch delivered again
    assert g.applied() == before and g.nodes().count() == 2


# ---- members and what they name
CODE = {
    "typescript": """import { a } from './a';
interface Shape extends Base { area(): number; }
export class Relay extends Tram<Map<string, X>> implements Shape, Other {
  constructor(private x: Map<string, number>) { super(); this.start(); }
  async load(id: string): Promise<string[]> {
    const pick = (n: number) => rank(n);
    // not(called) and "neither(this)" nor /{}(x)/
    return this.fetch(id).map(parse).trim();
  }
}
const held = async (x) => { helper(x); new Relay(); };
function outer() { function inner() { deep(); } inner(); }
""",
    "python": """import os
class A(B, metaclass=M):
    def f(self, x):
        # hidden(1)
        s = "also(2)"
        return g(
            h(x),
        )

    async def k(self):
        self.m.n(); print(len(x))

def top():
    def nested():
        low()
    nested()
call_outside()
""",
    "csharp": """namespace X {
 public sealed class Svc<T> : BaseSvc<T>, ISvc, IOther where T : class {
  public async Task<int> Load(int id) { var x = Helper.Find(id); list.Add(x); return await Next(x); }
  public int Size() => Count2(3);
 }
 public interface ISvc { void Run(); }
}
""",
    "java": """package a;
public final class Svc<T extends X> extends BaseSvc<T> implements ISvc, Other {
  @Override
  public <R> List<R> load(int id) throws IOException {
    return find(id);
  }
  void local() { }
}
interface ISvc extends Closeable { void run(); }
""",
    "go": """package a
type Store struct { n int }
type Reader interface { Read() int }
func (s *Store) Load(id int) (string, error) {
	x := s.find(id)
	go run(func() { inner(x) })
	return fmt.Sprintf("a(b)", x), nil
}
func helper() int { return len(x) }
""",
}


def test_members_and_sites(spark):
    from graphloom.sources import sites

    def seen(lang):
        rows = sites.scan(CODE[lang], lang)
        return {(k, n, a, b) for k, n, t, a, b, _ in rows if t is None}, {(n, t) for k, n, t, *_ in rows if k == "CALLS"}, {(k, n, t) for k, n, t, *_ in rows if t and k != "CALLS"}

    members, calls, bases = seen("typescript")
    assert {("interface", "Shape", 2, 2), ("class", "Relay", 3, 10), ("function", "load", 5, 9), ("function", "held", 11, 11), ("function", "outer", 12, 12), ("function", "inner", 12, 12)} <= members
    assert {("load", "fetch"), ("held", "helper"), ("inner", "deep"), ("outer", "inner")} <= calls and not {"not", "neither", "map", "trim", "Relay", "called"} & {t for _, t in calls}
    assert bases == {("INHERITS", "Shape", "Base"), ("INHERITS", "Relay", "Tram"), ("IMPLEMENTS", "Relay", "Shape"), ("IMPLEMENTS", "Relay", "Other")}
    members, calls, bases = seen("python")
    assert members == {("class", "A", 2, 11), ("function", "f", 3, 8), ("function", "k", 10, 11), ("function", "top", 13, 16), ("function", "nested", 14, 15)}
    assert calls == {("f", "g"), ("f", "h"), ("k", "n"), ("nested", "low"), ("top", "nested")} and not bases
    members, calls, bases = seen("csharp")
    assert members == {("class", "Svc", 2, 5), ("function", "Load", 3, 3), ("function", "Size", 4, 4), ("interface", "ISvc", 6, 6)} | {m for m in members if m[1] == "Run"}
    assert calls == {("Load", "Find"), ("Load", "Next"), ("Size", "Count2")} and bases == {("INHERITS", "Svc", "BaseSvc"), ("IMPLEMENTS", "Svc", "ISvc"), ("IMPLEMENTS", "Svc", "IOther")}
    members, calls, bases = seen("java")
    assert {("class", "Svc", 2, 8), ("function", "load", 4, 6), ("function", "local", 7, 7), ("interface", "ISvc", 9, 9)} <= members
    assert not calls and bases == {("INHERITS", "Svc", "BaseSvc"), ("IMPLEMENTS", "Svc", "ISvc"), ("IMPLEMENTS", "Svc", "Other"), ("INHERITS", "ISvc", "Closeable")}
    members, calls, bases = seen("go")
    assert members == {("class", "Store", 2, 2), ("interface", "Reader", 3, 3), ("function", "Load", 4, 8), ("function", "helper", 9, 9)}
    assert {("Load", "find"), ("Load", "run"), ("Load", "inner")} <= calls and "Sprintf" not in {t for _, t in calls}


def test_scanned_files(spark):
    from graphloom.sources import sites

    raw = spark.createDataFrame([("r", "file", "a.py", "x", CODE["python"])] * 2 + [("r", "file", "b.py", "x", None), ("r", "file", "c.txt", "x", "def f(): g()"), ("r", "class", "d.py", "x", "def f(): g()"), ("r", "file", "e.go", None, "")], "run_id string, type string, file_path string, repo string, code_snippet string").withColumn("kind", F.lit("clash"))
    rows = sites.scanned(raw)
    assert sites.sites(rows, "CALLS").count() == 5 and sites.members(rows).count() == 5
    assert {r["signature"] for r in sites.members(rows).where("name = 'f'").collect()} == {"def f(self, x):"}
    assert sites.scanned(raw.limit(0)).count() == 0


EMPTY_NODES = "id string, type string, name string, repo string, language string, file_path string, signature string, signature_hash string, file_hash string, line_range struct<start:int,end:int>, code_snippet string, summary string, tags array<string>, layer string, first_seen_commit string, last_seen_commit string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"
EMPTY_EDGES = "src string, dst string, type string, weight double, unresolved boolean, created_at timestamp_ntz, updated_at timestamp_ntz"


def test_ingestion_of_a_checkout(spark, tmp_path):
    """A full run, then one over what changed: edges of all kinds, dropped members, deleted and renamed files."""
    from graphloom.session import cut

    def write(p, text):
        os.makedirs((tmp_path / p).parent, exist_ok=True)
        (tmp_path / p).write_text(text)

    write("src/a.ts", "import { b } from './b';\nexport class A extends Root {\n  run(x: number): void {\n    helper(x);\n  }\n  old(): void {\n    this.run(1);\n  }\n}\n")
    write("src/b.ts", "export class Root {\n}\nexport function helper(x) {\n  return x;\n}\n")
    write("docs/guide.md", "# Guide\nSee [api](../docs/api.md).\n## Relay helper\nCall `helper` first.\n")
    write("docs/api.md", "# Api\n")
    g = CodeGraph(spark.createDataFrame([], EMPTY_NODES), spark.createDataFrame([], EMPTY_EDGES)).ingest_repo(str(tmp_path), "r", "c1")
    g = CodeGraph(cut(g.nodes), cut(g.edges))
    ids = {r["id"] for r in g.nodes.collect()}
    assert {"class:r:src/a.ts:A", "class:r:src/b.ts:Root", "doc:r:docs/guide.md", "doc:r:docs/guide.md#relay-helper", "file:r:docs/api.md"} <= ids
    named = {(r["type"], r["src"].split(":")[-1] if r["type"] == "LINKS_TO" else r["src"].split(":")[3] if r["type"] in ("CALLS", "INHERITS") else r["src"].split(":")[2], r["dst"].split(":")[3] if r["type"] in ("CALLS", "INHERITS", "MENTIONS") else r["dst"].split(":")[2], r["unresolved"]) for r in g.edges.collect()}
    assert {("CALLS", "run", "helper", True), ("CALLS", "old", "run", False), ("INHERITS", "A", "Root", True), ("IMPORTS", "src/a.ts", "src/b.ts", False), ("HAS_SECTION", "docs/guide.md", "docs/guide.md#guide", False), ("LINKS_TO", "docs/guide.md", "docs/api.md", False), ("MENTIONS", "docs/guide.md#relay-helper", "helper", False)} <= named
    member = g.nodes.where("name = 'run'").first()
    assert member["signature"] == "run(x: number): void {" and member["code_snippet"].startswith("  run(x") and member["line_range"]["end"] == 5

    write("src/a.ts", "export class A {\n  run(x: number): void {\n  }\n}\n")
    os.rename(tmp_path / "src/b.ts", tmp_path / "src/c.ts")
    os.remove(tmp_path / "docs/api.md")
    changed = spark.createDataFrame([("M", "src/a.ts", None), ("R", "src/c.ts", "src/b.ts"), ("D", "docs/api.md", None), ("M", "x.bin", None)], "status string, path string, old_path string")
    h = g.ingest_repo(str(tmp_path), "r", "c2", changed=changed)
    h = CodeGraph(cut(h.nodes), cut(h.edges))
    dead = {r["id"] for r in h.nodes.where("deleted_at IS NOT NULL").collect()}
    assert {i for i in ids if ":old:" in i or "src/b.ts" in i or "docs/api.md" in i} == dead
    assert h.edges.where("type = 'RENAMED_FROM'").select("src", "dst").collect() == [("file:r:src/b.ts", "file:r:src/c.ts")]
    none = spark.createDataFrame([("M", "x.bin", None)], changed.schema)
    assert h.ingest_repo(str(tmp_path), "r", "c3", changed=none) is h
    write("src/a.ts", "export class Again {\n}\n")
    k = h.reindex_file(str(tmp_path), "r", "src/a.ts", "c3")
    assert {r["id"] for r in k.nodes.where("file_path = 'src/a.ts' AND deleted_at IS NULL").collect()} == {"file:r:src/a.ts", "class:r:src/a.ts:Again"}
    counts = {r["action"]: r["rows"] for r in lifecycle.written(h.edges, k.edges, ["src", "dst", "type"]).collect()}
    assert counts == {"kept": h.edges.count()}
    t = k.feature_template("guide for the relay", "r")
    assert t["layers"].count() == 0 and "contracts" in t and t["around"].count() >= 0


def test_renames_by_content(spark):
    from graphloom.operators import ingest

    n = spark.createDataFrame([("file:r:a", "file", "r", "a", "h", T[1]), ("file:r:b", "file", "r", "b", "h", None), ("file:r:c", "file", "r", "c", "h", None), ("file:s:d", "file", "s", "d", "h", T[1]), ("file:r:e", "file", "r", "e", None, T[1])], "id string, type string, repo string, file_path string, file_hash string, deleted_at timestamp_ntz")
    moves = ingest.renamed(n)
    assert values(moves) == [("r", "a", "b")]
    assert values(ingest.rename_edges(n, moves).select("src", "dst", "type")) == [("file:r:a", "file:r:b", "RENAMED_FROM")]
    gone = spark.createDataFrame([("r", "zz", "b"), ("r", None, "b")], "repo string, old_path string, path string")
    assert ingest.rename_edges(n, gone).count() == 0


def test_stream_brings_edges_and_touches_few_buckets(spark, tmp_path):
    schema = "run_id string, type string, name string, language string, file_path string, repo string, line_range struct<start:int,end:int>, signature string, code_snippet string, extra map<string,string>, extracted_at timestamp_ntz"

    def rows(run, t):
        file = lambda p, text: (run, "file", p, None, p, "r", None, None, text, {}, t)
        fn = lambda p, n: (run, "function", n, None, p, "r", None, n, None, {}, t)
        return [file("a.py", "import b\ndef f():\n    g()\n"), fn("a.py", "f"), file("b.py", "def g():\n    pass\n"), fn("b.py", "g")]

    g = GraphStream(spark, str(tmp_path / "g"), 16)
    g.merge(spark.createDataFrame(rows("r1", T[1]), schema), 0)
    calls = g.edges().where("type = 'CALLS'").collect()
    assert [(r["src"].split(":")[3], r["dst"].split(":")[3], r["unresolved"]) for r in calls] == [("f", "g", True)]
    before = g.store.state()
    g.merge(spark.createDataFrame(rows("r2", T[2])[2:], schema), 1)
    after = g.store.state()
    assert g.nodes().count() == 4 and g.edges().where("type = 'CALLS'").count() == 1 and g.applied() == 1
    assert any(after["nodes"][b] == at for b, at in before["nodes"].items()) and after["edges"] == before["edges"]


def test_impact_of_a_hub(spark):
    """Longer trails are not enumerated for a start whose nearer ones fill the answer; the answer is the same."""
    pairs = [(f"c{k}", "hub") for k in range(30)] + [(f"d{k}", f"c{k % 30}") for k in range(90)] + [("c1", "lone"), ("d9", "c1")]
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs], "src string, dst string, type string").distinct()
    nodes = spark.createDataFrame([(x, x, "service", None) for x in sorted({x for p in pairs for x in p})], "id string, name string, layer string, deleted_at timestamp_ntz")
    starts = spark.createDataFrame([("hub",), ("lone",)], "id string")
    every = sorted((r["start"], r["depth"], r["name"], r["id"], r["path"]) for r in traversal.impact(edges, nodes, starts, 3, True, None).collect())
    for most in (5, 40):
        want = [x for s in ("hub", "lone") for x in [y for y in every if y[0] == s][:most]]
        assert sorted((r["start"], r["depth"], r["name"], r["id"], r["path"]) for r in traversal.impact(edges, nodes, starts, 3, True, most).collect()) == sorted(want)


def test_reachable_in_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(traversal, "FRONTS", 3)
    edges = spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}") for k in range(9)] + [("n05", "n02"), ("x", "y")], "src string, dst string")
    assert values(traversal.reachable(edges, spark.createDataFrame([("n00",)], "id string"))) == [(f"n{k:02}",) for k in range(10)]


def test_judged_document_links(spark):
    class Sure:
        def confidence(self, rows):
            return [0.9 if r["name"] in r["text"] else 0.1 for r in rows]

    class Broken:
        def confidence(self, rows):
            raise OSError

    sections = spark.createDataFrame([("s", "r", "The Relay moves parcels")], "section string, repo string, text string")
    nodes = spark.createDataFrame([("a", "class", "Relay", "r", None), ("b", "class", "Depot", "r", None), ("c", "class", "Depot", "q", None)], "id string, type string, name string, repo string, deleted_at timestamp_ntz")
    vectors = spark.createDataFrame([("s", [1.0, 0.0]), ("a", [1.0, 0.1]), ("b", [0.9, 0.2]), ("c", [1.0, 0.0])], "id string, embedding array<double>")
    assert values(resolve.document_links(sections, nodes, 0.3, vectors)) == [("s", "a", 0.5), ("s", "b", 0.5)]
    assert values(resolve.document_links(sections, nodes, 0.3, vectors, Sure)) == [("s", "a", 0.9)]
    assert values(resolve.document_links(sections, nodes, 0.3, None, Broken)) == [("s", "a", 0.5)]
    assert search.knn(vectors, "id", "embedding", spark.createDataFrame([], "query string, vector array<double>")).count() == 0


def test_shapes_and_repairs(spark):
    n = spark.createDataFrame([("a", None, "fooBar", " ", None), ("b", "class", "x", "service", "given")], "id string, type string, name string, layer string, name_tokens string")
    rows = {r["id"]: r for r in lifecycle.repaired(n).collect()}
    assert rows["a"]["layer"] is None and rows["a"]["name_tokens"] == "foo bar foobar" and rows["b"]["name_tokens"] == "given"
    with pytest.raises(ValueError):
        lifecycle.repaired(n.drop("layer"))
    shaped = G.shaped(n.withColumns({"summary": F.lit(None).cast("string"), "tags": F.lit(None).cast("array<string>"), "file_path": F.lit("a")})).where("id = 'a'").first()
    assert (shaped["type"], shaped["summary"], shaped["tags"]) == ("Unknown", "", [])
    assert [r[0] for r in spark.createDataFrame([("src/latest/a.ts",), ("SPEC/x",), ("src/a.ts",), (None,)], "p string").select(G.test_path_words(F.col("p"))).collect()] == [True, True, False, False]


def test_nearest_keep_few_rows(spark, monkeypatch):
    """A partition gives at most the wanted number for each query, ties by key, also over many steps."""
    import numpy as np

    monkeypatch.setattr(search, "STEP", 7)
    rng = np.random.default_rng(2)
    v = np.vstack([rng.normal(size=(200, 4)), np.ones((60, 4))])
    rows = spark.createDataFrame([(k, [float(y) for y in x]) for k, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    q = spark.createDataFrame([("a", [1.0, 1.0, 1.0, 1.0]), ("b", [1.0, -1.0, 0.5, 0.0]), ("c", None)], "query string, vector array<double>")
    got = sorted((r["query"], r["rank"], r["id"]) for r in search.knn(rows, "id", "v", q, 5).collect())
    want = []
    for name, x in (("a", np.ones(4)), ("b", np.array([1, -1, 0.5, 0]))):
        s = np.round((1 + v @ x / np.linalg.norm(v, axis=1) / np.linalg.norm(x)) / 2, 6)
        want += [(name, n + 1, k) for n, k in enumerate(sorted(range(len(v)), key=lambda k: (-s[k], k))[:5])]
    assert got == want
