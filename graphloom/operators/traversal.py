"""Multi-hop traversal as frontier joins.

Every hop joins the frontier with the edges on the frontier's end; nothing is gathered on the driver.  Trails repeat no
edge (nodes may recur), as in a variable-length pattern match.  Loops that run until nothing new is found cut their
lineage in the shared checkpoint folder each round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut


FRONTS = 24  # parts of a growing set before they are put together


def hops(edges: DataFrame, up: bool, edge_types=("CALLS",)) -> DataFrame:
    e = edges.where(F.col("type").isin(*edge_types) & (F.col("src") != F.col("dst")))
    return e.select(F.col("dst" if up else "src").alias("at"), F.col("src" if up else "dst").alias("next"))


def trails(edges: DataFrame, starts: DataFrame, depth: int, up: bool, enough=None) -> DataFrame:
    """(start, id, depth, path_ids): all trails of 1..depth CALLS edges that end (up) or begin (down) at the starts.

    ``enough`` (depth, trails so far, rows of this depth) gives the starts that need no longer trails.
    """
    step = hops(edges, up)
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at"), F.array("id").alias("path"))
    out: DataFrame | None = None
    parts: list[DataFrame] = []
    for d in range(1, depth + 1):
        pair = F.array(F.col("at"), F.col("next"))
        used = F.exists(F.sequence(F.lit(0), F.size("path") - 2), lambda i: F.slice("path", i + 1, 2) == pair) if d > 1 else F.lit(False)
        front = front.join(step, "at").where(~used).select("start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))
        now = front.select("start", F.col("at").alias("id"), F.lit(d).alias("depth"), (F.reverse("path") if up else F.col("path")).alias("path_ids"))
        out = now if out is None else out.unionByName(now)
        if enough is not None and d < depth:
            front = cut(front)
            now = front.select("start", F.col("at").alias("id"), F.lit(d).alias("depth"), (F.reverse("path") if up else F.col("path")).alias("path_ids"))
            parts.append(now)
            out = reduce(DataFrame.unionByName, parts)
            front = front.join(enough(out), "start", "left_anti")
    return out


def impact(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3, up: bool = True, most: int | None = 100) -> DataFrame:
    """Trails whose far end lives, the nearest first by name; at most ``most`` for each start."""
    far = nodes.where("deleted_at IS NULL").select("id", "name", "layer")

    def enough(rows: DataFrame) -> DataFrame:
        """Starts whose nearer trails already fill the answer."""
        return rows.join(far.select("id"), "id", "left_semi").groupBy("start").count().where(F.col("count") >= most).select("start")

    rows = trails(edges, starts, depth, up, None if most is None else enough).join(far, "id")
    if most is not None:
        w = Window.partitionBy("start").orderBy("depth", "name", "id", F.array_join("path_ids", ">"))
        rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
    return rows.select("start", "id", "name", "layer", "depth", F.array_join("path_ids", ">").alias("path"))


def layer_breakdown(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """Paths per start, direction and layer of their far end; nodes without a layer are left out."""
    both = impact(edges, nodes, starts, depth, True, None).withColumn("direction", F.lit("upstream")).unionByName(
        impact(edges, nodes, starts, depth, False, None).withColumn("direction", F.lit("downstream"))
    )
    return both.where("layer IS NOT NULL").groupBy("start", "direction", "layer").agg(F.count(F.lit(1)).alias("paths"))


def call_chains(edges: DataFrame, starts: DataFrame, depth: int = 6, edge_types=("CALLS", "INSTANTIATES"), ends: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, path): the shortest chain from each start to each reachable node, the first by its ids.

    A round extends the frontier by one edge, keeps the least path of every (start, node) and drops what was seen.
    """
    step = cut(hops(edges, False, edge_types))
    front = cut(starts.select("id")).select(F.col("id").alias("start"), F.col("id").alias("at"), F.col("id").alias("path"))
    seen, out = front.select("start", "at"), None
    for d in range(1, depth + 1):
        new = (
            front.join(step, "at").select("start", F.col("next").alias("at"), F.concat_ws(">", "path", "next").alias("path"))
            .join(seen, ["start", "at"], "left_anti").groupBy("start", "at").agg(F.min("path").alias("path"))
        )
        front = cut(new)
        now = front.select("start", F.col("at").alias("id"), F.lit(d).alias("depth"), "path")
        out = now if out is None else out.unionByName(now)
        seen = seen.unionByName(front.select("start", "at"))
        if front.isEmpty():
            break
    return out if ends is None else out.join(ends.select("id").distinct(), "id", "left_semi")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id): the roots and all that can be reached from them over (src, dst), however many rounds it takes."""
    step = cut(edges.select(F.col("src").alias("id"), F.col("dst").alias("next")).where("id <> next"))
    front = cut(roots.select("id").distinct())
    parts = [front]  # each front is written once; many small ones are put together
    while True:
        seen = reduce(DataFrame.unionByName, parts)
        front = cut(front.join(step, "id").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti"))
        if front.isEmpty():
            return seen
        parts = [*parts, front] if len(parts) < FRONTS else [cut(seen), front]


def dead_code(calls: DataFrame, nodes: DataFrame, entry_layer: str = "controller") -> tuple[DataFrame, DataFrame]:
    """Functions that no member of the entry layer reaches over live calls of their repo, and counters per repo."""
    alive = nodes.where("deleted_at IS NULL")
    roots = alive.where(F.col("layer") == entry_layer)
    hit = reachable(calls, roots).withColumn("reached", F.lit(True))
    functions = alive.where("type = 'function'").join(hit, "id", "left")
    dead = functions.where("reached IS NULL").select("id", "name", "repo", "layer", "file_path")
    entries = roots.groupBy("repo").agg(F.count(F.lit(1)).alias("entry_points"))
    counters = (
        functions.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count("reached").alias("reachable"))
        .join(entries, "repo", "left")
        .select("repo", F.coalesce("entry_points", F.lit(0)).alias("entry_points"), "total", "reachable", (F.col("total") - F.col("reachable")).alias("unreachable"))
    )
    return dead, counters


def neighbourhood(edges: DataFrame, starts: DataFrame, depth: int = 2, direction: str = "both", edge_types: tuple[str, ...] = ("CALLS",), per_hop: int = 50) -> DataFrame:
    """(start, id, depth): layers of nodes at exactly 1..depth hops; at most ``per_hop`` new nodes (by id) for a start and hop."""
    out, inn = hops(edges, False, edge_types), hops(edges, True, edge_types)
    step = cut({"out": out, "in": inn, "both": out.unionByName(inn)}[direction].distinct())
    front = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("at")))
    seen, layers = front, None
    w = Window.partitionBy("start").orderBy("at")
    for d in range(1, depth + 1):
        new = front.join(step, "at").select("start", F.col("next").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        front = cut(new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_hop).drop("n"))
        now = front.select("start", F.col("at").alias("id"), F.lit(d).alias("depth"))
        layers = now if layers is None else layers.unionByName(now)
        seen = seen.unionByName(front)
    return layers


def dependency_map(edges: DataFrame, nodes: DataFrame, starts: DataFrame, depth: int = 3) -> DataFrame:
    """(start, id, status, related): confirmed where a call path leads from the start, likely where only an edge touches it.

    related: the node shares a word of its file's folder with the start, or is confirmed.
    """
    confirmed = call_chains(edges, starts, depth).select("start", "id").withColumn("status", F.lit("confirmed"))
    e = edges.select(F.col("src").alias("start"), F.col("dst").alias("id")).unionByName(edges.select(F.col("dst").alias("start"), F.col("src").alias("id"))).where("start <> id").distinct()
    likely = e.join(starts.select(F.col("id").alias("start")), "start", "left_semi").join(confirmed.select("start", "id"), ["start", "id"], "left_anti").withColumn("status", F.lit("likely"))
    folder = F.array_except(F.split(F.regexp_replace(F.coalesce("file_path", F.lit("")), r"/?[^/]*$", ""), "/"), F.array(F.lit("src"), F.lit("")))
    n = nodes.select("id", folder.alias("f"))
    return (
        confirmed.unionByName(likely).join(n, "id").join(n.select(F.col("id").alias("start"), F.col("f").alias("g")), "start")
        .select("start", "id", "status", ((F.col("status") == "confirmed") | F.arrays_overlap("f", "g")).alias("related"))
    )


def entry_chains(calls: DataFrame, nodes: DataFrame, upper: str = "controller", middle: str = "service", lower: str = "repository") -> DataFrame:
    """(entry, service, repository): calls from the upper over the middle to the lower layer; repository is null where a chain ends early."""
    def members(layer: str, name: str) -> DataFrame:
        return nodes.where((F.col("layer") == layer) & F.col("deleted_at").isNull()).select(F.col("id").alias(name))

    c = calls.select("src", "dst")
    first = c.join(members(upper, "src"), "src", "left_semi").join(members(middle, "dst"), "dst", "left_semi").select(F.col("src").alias("entry"), F.col("dst").alias("service"))
    last = c.join(members(middle, "src"), "src", "left_semi").join(members(lower, "dst"), "dst", "left_semi").select(F.col("src").alias("service"), F.col("dst").alias("repository"))
    return first.join(last, "service", "left").select("entry", "service", "repository").distinct()
