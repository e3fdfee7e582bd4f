"""Filling fixed-capacity containers with items (problem 7).

Sizes are integers of at most the capacity, so the global histogram says everything that a packing needs and its size
is bounded by the capacity, not by the data.  Dynamic programming over it chooses the ends of length buckets with the
least padding.  Token-budget batches form inside each bucket, from the largest bucket to the smallest: batches that items
of the bucket alone fill to the last token come first; a batch that they cannot fill takes what fits from the buckets
below.  The result is a short plan of container patterns with multiplicities.  Spark ranks the items of each size and
looks up where the plan puts the n-th item of that size, so no group of items is ever gathered: a size that many items
have is ranked in as many parts as its count in the histogram asks for.

An item is split only if it exceeds the capacity: into whole containers and one remainder, which is packed like any item.

Defined results: null and empty texts have no tokens and lie in container 0; ties are broken by doc_id and part;
repeated container rows count once, null or non-positive capacities are ignored; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import tokenizer
from graphloom.session import cut

RANKED = 100_000  # items of one size that one window group ranks, about


def boundaries(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[int]:
    """Upper ends of the buckets with the least total padding (sizes ascending, each at most the capacity), among all sizes.

    best[j] is the least best[i] + ceil((before[j] - before[i]) / per) of i < j.  As the ceiling is monotone, that is the ceiling
    of (before[j] + min(per * best[i] - before[i])) / per; sizes of one ``per`` lie together and cannot lower the minimum
    among themselves, so each such run is one step, on at most capacity / per sizes: about capacity * log(capacity) in all.
    """
    tops = np.asarray(sizes, np.int64)
    before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    n, per = len(tops), capacity // tops
    best, back = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    runs = np.append(np.flatnonzero(np.diff(per, prepend=-1)) + 1, n + 1)
    for a, b in zip(runs[:-1], runs[1:], strict=True):
        p = per[a - 1]
        least = np.minimum.accumulate(p * best[:a] - before[:a])
        best[a:b] = -(-(before[a:b] + least[-1]) // p)
        back[a:b] = np.searchsorted(-least, before[a:b] - p * best[a:b])  # the first i that gives as few
    ends, j = [], n
    while j:
        ends.append(int(tops[j - 1]))
        j = int(back[j])
    return ends[::-1]


@dataclass
class Plan:
    """Slots sorted by (size, first): items first.. of a size go to containers base, base + 1, ..., per of them in each."""

    ends: list[int]
    size: np.ndarray
    first: np.ndarray
    base: np.ndarray
    per: np.ndarray
    containers: int

    def container(self, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size), np.int64)
        for s in np.unique(size):
            low, high = np.searchsorted(self.size, [s, s + 1])
            mine = size == s
            at = low + np.searchsorted(self.first[low:high], rank[mine], "right") - 1
            out[mine] = self.base[at] + (rank[mine] - self.first[at]) // self.per[at]
        return out


class Stock:
    """How many items of each size are left; sizes are looked up by their place in the ascending list."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.sizes, self.left, self.used = sizes, counts.astype(np.int64).copy(), np.zeros(len(sizes), np.int64)
        self.below = np.arange(len(sizes) + 1)  # place + 1 of the largest size of at most this place that has items, found lazily

    def largest(self, most: int) -> int:
        """Place of the largest size of at most ``most`` with items left, or -1."""
        k = int(np.searchsorted(self.sizes, most, "right"))
        path = []
        while k and not self.left[k - 1]:
            path.append(k)
            k = int(self.below[k]) if self.below[k] < k else k - 1
        for p in path:
            self.below[p] = k
        return k - 1

    def batch(self, top: int, low: int, capacity: int) -> tuple[list[tuple[int, int]], int]:
        """Places and numbers of the items of a batch, largest first, of sizes above ``low``; and the room that stays."""
        room, pattern, k = capacity, [], top
        while k >= 0 and self.sizes[k] > low:
            size = int(self.sizes[k])
            per = min(int(self.left[k]), room // size)
            pattern.append((k, per))
            room -= per * size
            k = self.largest(min(room, size - 1))
        return pattern, room


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, ends: list[int] | None = None) -> Plan:
    """Patterns of containers by buckets, the largest first, on a histogram of sizes from 1 to the capacity."""
    order = np.argsort(sizes)
    sizes, counts = np.asarray(sizes)[order], np.asarray(counts)[order]
    ends = boundaries(sizes, counts, capacity) if ends is None else ends
    stock = Stock(sizes, counts)
    slots: list[tuple[int, int, int, int]] = []
    base = 0

    def put(pattern: list[tuple[int, int]]) -> None:
        nonlocal base
        times = min(int(stock.left[k]) // per for k, per in pattern)
        for k, per in pattern:
            slots.append((int(sizes[k]), int(stock.used[k]), base, per))
            stock.used[k] += times * per
            stock.left[k] -= times * per
        base += times

    for low, high in reversed(list(zip([0, *ends], ends, strict=False))):
        most = high
        while (top := stock.largest(most)) >= 0 and sizes[top] > low:  # inside the bucket, full
            pattern, room = stock.batch(top, low, capacity)
            if room:
                most = int(sizes[top]) - 1
            else:
                put(pattern)
        while (top := stock.largest(high)) >= 0 and sizes[top] > low:  # the rest, with room given to the buckets below
            put(stock.batch(top, 0, capacity)[0])
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return Plan(ends, *(np.ascontiguousarray(table[:, k]) for k in range(4)), base)


def types(containers: DataFrame) -> list[tuple[str, int]]:
    """The container types; the result holds every text once for each of them, so they are few by their nature."""
    rows = containers.where("container_type IS NOT NULL AND capacity_tokens > 0").select("container_type", "capacity_tokens").distinct().collect()
    return sorted((r[0], r[1]) for r in rows)


def items(sizes: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """(t, doc_id, part_no, start_token, n_tokens): what has to be placed, for every container type."""
    table = pd.DataFrame({"t": range(len(kinds)), "c": [c for _, c in kinds]}, dtype="int32").to_dict("records")
    each = F.from_json(F.lit(str(table).replace("'", '"')), "array<struct<t int, c int>>")
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("c")), F.lit(1)).cast("int") - 1)
    return (
        sizes.select("doc_id", "n_tokens", F.explode(each).alias("k"))
        .select("doc_id", "n_tokens", "k.t", "k.c")
        .select("t", "c", "doc_id", "n_tokens", F.explode(parts).alias("part_no"))
        .withColumn("start_token", F.col("part_no") * F.col("c"))
        .select("t", "doc_id", "part_no", "start_token", F.least(F.col("c"), F.col("n_tokens") - F.col("start_token")).alias("n_tokens"))
    )


def histogram(placed: DataFrame) -> pd.DataFrame:
    """Items per type and size; at most the sum of the capacities of rows, whatever the number of texts."""
    return placed.where("n_tokens > 0").groupBy("t", "n_tokens").count().toPandas().sort_values(["t", "n_tokens"], ignore_index=True)


def ranked(placed: DataFrame, h: pd.DataFrame) -> DataFrame:
    """With the number of every item among those of its type and size, from 0, in the order of (doc_id, part_no).

    Sizes of many items are dealt out by ranges of (doc_id, part_no) in parts of about RANKED items; parts are ranked apart
    and then moved by the items of the parts before, which gives the numbers that one part would give.
    """
    spark = placed.sparkSession
    hot = h[h["count"] > RANKED]
    group = ["t", "n_tokens", "salt"]
    w = Window.partitionBy(*group).orderBy("doc_id", "part_no")
    if hot.empty:
        return placed.withColumn("salt", F.lit(0)).withColumn("nth", (F.row_number().over(w) - 1).cast("bigint"))
    many = spark.createDataFrame([(int(t), int(s)) for t, s in hot[["t", "n_tokens"]].itertuples(index=False)], "t int, n_tokens int")
    parts = int((-(-hot["count"] // RANKED)).sum())
    ranges = placed.join(F.broadcast(many), ["t", "n_tokens"], "left_semi").repartitionByRange(parts, "t", "n_tokens", "doc_id", "part_no")
    cutup = cut(ranges.withColumn("salt", F.spark_partition_id()))  # kept, as the ranges are drawn anew wherever they are asked for
    before = Window.partitionBy("t", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    moved = cutup.groupBy(*group).count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = cutup.withColumn("nth", F.row_number().over(w) - 1).join(moved, group).withColumn("nth", F.col("nth") + F.col("offset")).drop("offset")
    few = placed.join(F.broadcast(many), ["t", "n_tokens"], "left_anti").withColumn("salt", F.lit(0)).withColumn("nth", (F.row_number().over(w) - 1).cast("bigint"))
    return numbered.unionByName(few)


def pack(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_type, container_no, doc_id, part_no, start_token, n_tokens)."""
    spark = documents.sparkSession
    sizes, kinds = cut(tokenizer.encoded(documents, counts_only=True)), types(containers)
    placed = items(sizes, kinds)
    h = histogram(placed)
    plans = [plan(own["n_tokens"].to_numpy(np.int64), own["count"].to_numpy(np.int64), capacity) for t, (_, capacity) in enumerate(kinds) for own in [h[h.t == t]]]
    shared = spark.sparkContext.broadcast(plans)  # a slot for each size and pattern: bounded by the capacities

    @F.pandas_udf("bigint")
    def container_no(t: pd.Series, size: pd.Series, nth: pd.Series) -> pd.Series:
        out = np.zeros(len(t), np.int64)
        t_, s_, n_ = (x.to_numpy(np.int64) for x in (t, size, nth))
        for k in np.unique(t_):
            mine = (t_ == k) & (s_ > 0)
            out[mine] = shared.value[k].container(s_[mine], n_[mine])
        return pd.Series(out)

    names = F.array(*[F.lit(n) for n, _ in kinds]) if kinds else F.array().cast("array<string>")
    filled = ranked(placed.where("n_tokens > 0"), h).select("t", container_no("t", "n_tokens", "nth").alias("container_no"), "doc_id", "part_no", "start_token", "n_tokens")
    empty = placed.where("n_tokens = 0").select("t", F.lit(0).cast("bigint").alias("container_no"), "doc_id", "part_no", "start_token", "n_tokens")
    return filled.unionByName(empty).select(F.get(names, F.col("t")).alias("container_type"), "container_no", "doc_id", "part_no", "start_token", "n_tokens")


def fill(documents: DataFrame, containers: DataFrame) -> DataFrame:
    """Containers, tokens and unused share of every container type."""
    return (
        pack(documents, containers)
        .groupBy("container_type", "container_no")
        .agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
        .join(containers.select("container_type", "capacity_tokens").distinct(), "container_type")
        .groupBy("container_type", "capacity_tokens")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
