"""What changed between full snapshots (problem 1).

The unit of work is a *bucketed key-to-hash index*: one row (repo, id, hash) per record of a snapshot, bucketed by its key.
A new snapshot probes the index of the one before, bucket by bucket and without a shuffle; old values are fetched only for
keys whose hash differs; then the index of the new snapshot takes the place of the old one.  Two forms share the hash and
the rules:

* ``consecutive`` takes a table that already holds all snapshots.  Its rows are hashed and placed once, each snapshot of
  a repo in the generation of its number in order; generation k probes generation k - 1, for all repos at a time, and
  every probe is a join of bucketed files.
* ``SnapshotIndex`` keeps the index of the last snapshot in force behind a pointer, for snapshots that arrive one at a time.

``replay`` gives the same rows as ``consecutive`` by windows in one pass and without an index; tests hold them together.

Defined results: rows with a null id or an unlisted snapshot are ignored; of repeated rows the latest loaded_at counts
(nulls first; equal times fall back to the larger hash); a listed snapshot without rows removes everything; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.session import cut, ensure_checkpoint_dir
from graphloom.sources.generations import Generations, bucketed, reopened
from graphloom.sources.tables import clean_path

KEY = ["repo", "id"]
BUCKET_BYTES = 1 << 30  # of input, about, for each bucket of an index
MOST_KEYS = 1_000_000  # changed keys that are shared with all workers; more are joined


def text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def compared_values() -> dict[str, Column]:
    """The compared fields in canonical spelling: null equals empty, blanks of a signature collapse, tags are a set."""
    bounds = F.concat_ws(":", F.col("line_range.start").cast("string"), F.col("line_range.end").cast("string"))
    return {
        "type": text("type"),
        "name": text("name"),
        "language": text("language"),
        "file_path": F.coalesce(clean_path("file_path"), F.lit("")),
        "line_range": F.coalesce(bounds, F.lit("")),
        "signature": F.trim(F.regexp_replace(text("signature"), r"\s+", " ")),
        "file_hash": text("file_hash"),
        "layer": text("layer"),
        "complexity": text("complexity"),
        "tags": F.coalesce(F.array_join(F.array_sort(F.array_distinct("tags")), "\u0001"), F.lit("")),
    }


def hashed(rows: DataFrame) -> DataFrame:
    """(repo, id, snapshot_no, loaded_at, h1, h2): a 128-bit hash stands for the compared values."""
    values = list(compared_values().values())
    return rows.where(F.col("id").isNotNull()).select(
        "repo", clean_path("id").alias("id"), "snapshot_no", "loaded_at",
        F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit("second"), *values).alias("h2"),
    )


def latest(rows: DataFrame, *extra: str) -> DataFrame:
    """One row per key and snapshot, the one loaded last."""
    return (
        rows.groupBy(*KEY, *extra)
        .agg(F.max(F.struct("loaded_at", "h1", "h2")).alias("last"))
        .select(*KEY, *extra, F.col("last.h1").alias("h1"), F.col("last.h2").alias("h2"))
    )


def ordinals(snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot_no, ord, next_no): the list of snapshots numbered without gaps."""
    w = Window.partitionBy("repo").orderBy("snapshot_no")
    return (
        snapshots.where(F.col("snapshot_no").isNotNull())
        .select("repo", "snapshot_no")
        .distinct()
        .withColumns({"ord": F.row_number().over(w), "next_no": F.lead("snapshot_no").over(w)})
    )


def replay(node_snapshots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo, snapshot_no, id, change_kind) of every pair of consecutive snapshots of every repo."""
    buckets = latest(hashed(node_snapshots), "snapshot_no")  # repeated rows shrink before they are shuffled
    w = Window.partitionBy(*KEY).orderBy("snapshot_no")
    probed = buckets.join(ordinals(snapshots), ["repo", "snapshot_no"]).withColumns({
        "held": F.lag(F.struct("ord", "h1", "h2")).over(w), "coming": F.lead("ord").over(w),
    })
    in_index = F.coalesce(F.col("held.ord") == F.col("ord") - 1, F.lit(False))
    differs = (F.col("held.h1") != F.col("h1")) | (F.col("held.h2") != F.col("h2"))
    gone = F.col("next_no").isNotNull() & ~F.coalesce(F.col("coming") == F.col("ord") + 1, F.lit(False))

    def case(cond: Column, no: str, kind: str) -> Column:
        return F.when(cond, F.struct(F.col(no).alias("snapshot_no"), F.lit(kind).alias("change_kind")))

    cases = F.array_compact(F.array(
        case((F.col("ord") > 1) & ~in_index, "snapshot_no", "added"),
        case(in_index & differs, "snapshot_no", "changed"),
        case(gone, "next_no", "removed"),
    ))
    return probed.select("repo", "id", F.explode(cases).alias("c")).select("repo", "c.snapshot_no", "id", "c.change_kind")


def buckets_for(rows: DataFrame) -> int:
    """Buckets of an index: one per gigabyte of input, one per core at least; the session's number where the size is not known."""
    spark = rows.sparkSession
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(50_000, max(spark.sparkContext.defaultParallelism, size // BUCKET_BYTES))


def placed(node_snapshots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(repo, id, ord, h1, h2): what goes into the indexes; repeated rows shrink before they are shuffled."""
    return latest(hashed(node_snapshots), "snapshot_no").join(ordinals(snapshots), ["repo", "snapshot_no"]).select(*KEY, "ord", "h1", "h2")


def probed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, id, change_kind) of an index and the next one."""
    o, n = old.select(*KEY, F.col("h1").alias("o1"), F.col("h2").alias("o2")), new.select(*KEY, "h1", "h2")
    kind = F.when(F.col("o1").isNull(), "added").when(F.col("h1").isNull(), "removed").when((F.col("o1") != F.col("h1")) | (F.col("o2") != F.col("h2")), "changed")
    return o.join(n, KEY, "full").select(*KEY, kind.alias("change_kind")).where("change_kind IS NOT NULL")


def consecutive(node_snapshots: DataFrame, snapshots: DataFrame, buckets: int | None = None) -> DataFrame:
    """(repo, snapshot_no, id, change_kind) of every pair of consecutive snapshots of every repo."""
    spark = node_snapshots.sparkSession
    numbers = ordinals(snapshots)
    last = numbers.agg(F.max("ord")).first()[0] or 0
    path = f"{ensure_checkpoint_dir(spark)}/snapshot-index-{uuid.uuid4().hex}"
    index = bucketed(placed(node_snapshots, snapshots), path, buckets or buckets_for(node_snapshots), KEY, "ord")
    rounds = [probed(index.where(F.col("ord") == k - 1), index.where(F.col("ord") == k)).withColumn("ord", F.lit(k)) for k in range(2, last + 1)]
    if not rounds:
        return numbers.limit(0).select("repo", "snapshot_no", F.lit("").alias("id"), F.lit("").alias("change_kind"))
    # A repo without a snapshot of this number has none here: its last index stays in force.
    return reduce(DataFrame.unionByName, rounds).join(numbers.select("repo", "ord", "snapshot_no"), ["repo", "ord"]).select("repo", "snapshot_no", "id", "change_kind")


def changed_fields(node_snapshots: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Old and new value of every field of every changed record.

    The wide table is read only for the changed keys, before anything of it is shuffled: up to MOST_KEYS of them are
    shared with the scan, more are joined.
    """
    nos = ordinals(snapshots).select("repo", F.col("snapshot_no").alias("old_no"), F.col("next_no").alias("new_no")).where("new_no IS NOT NULL")
    changes = consecutive(node_snapshots, snapshots).where("change_kind = 'changed'").select("repo", F.col("snapshot_no").alias("new_no"), "id")
    wanted = changes.join(nos, ["repo", "new_no"]).select(
        "repo", "id", "new_no", F.explode(F.array(F.struct(F.col("old_no").alias("snapshot_no"), F.lit("old").alias("side")), F.struct(F.col("new_no").alias("snapshot_no"), F.lit("new").alias("side")))).alias("x")
    ).select("repo", "id", "new_no", "x.snapshot_no", "x.side")
    wanted = cut(wanted)
    if wanted.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        wanted = F.broadcast(wanted)
    values = compared_values()
    wide = node_snapshots.where(F.col("id").isNotNull()).select(
        "repo", clean_path("id").alias("id"), "snapshot_no", "loaded_at", F.xxhash64(*values.values()).alias("h1"), F.xxhash64(F.lit("second"), *values.values()).alias("h2"),
        F.struct(*[v.alias(k) for k, v in values.items()]).alias("v"),
    )
    row = F.struct("loaded_at", "h1", "h2", "v")
    last = wide.join(wanted, ["repo", "id", "snapshot_no"]).groupBy("repo", "id", "new_no").agg(
        F.max(F.when(F.col("side") == "old", row)).alias("o"), F.max(F.when(F.col("side") == "new", row)).alias("n")
    )
    pair = last.select("repo", "id", "new_no", F.col("o.v").alias("o"), F.col("n.v").alias("n"))
    fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"o.{k}").alias("old_value"), F.col(f"n.{k}").alias("new_value")) for k in values])
    return (
        pair.select("repo", F.col("new_no").alias("snapshot_no"), "id", F.explode(fields).alias("f"))
        .select("repo", "snapshot_no", "id", "f.field", F.translate("f.old_value", "\u0001", ",").alias("old_value"), F.translate("f.new_value", "\u0001", ",").alias("new_value"))
        .where("old_value <> new_value")
    )


class SnapshotIndex:
    """The index of the last snapshot in force, for snapshots that arrive one at a time.

    A generation holds (repo, id, h1, h2, v), bucketed by key; v are the compared values, which are read only for keys
    that changed.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.store, self.buckets = spark, Generations(spark, root), buckets

    def index(self) -> DataFrame | None:
        """The index in force."""
        at = self.store.state().get("index")
        return at and reopened(self.spark, f"{self.store.root}/{at}", self.buckets, KEY)

    def advance(self, rows: DataFrame) -> DataFrame | None:
        """Probe with one new snapshot of whole repos, swap the index, and return the changes (None for the first):
        (repo, id, change_kind, old_value, new_value), the values of changed keys only.

        ``rows`` may hold several repos; repos that it lacks keep their index entries and show no changes.
        """
        self.buckets = self.buckets or self.store.state().get("buckets") or buckets_for(rows)
        values = compared_values()
        old = self.index()
        new = (
            rows.where(F.col("id").isNotNull())
            .select("repo", clean_path("id").alias("id"), "loaded_at", F.xxhash64(*values.values()).alias("h1"), F.xxhash64(F.lit("second"), *values.values()).alias("h2"), F.struct(*[v.alias(k) for k, v in values.items()]).alias("v"))
            .groupBy(*KEY).agg(F.max(F.struct("loaded_at", "h1", "h2", "v")).alias("r")).select(*KEY, "r.h1", "r.h2", "r.v")
        )
        arrived = rows.where(F.col("id").isNotNull()).select("repo").distinct()
        kept = new if old is None else new.unionByName(old.join(arrived, "repo", "left_anti"))
        path = f"index-{uuid.uuid4().hex}"
        fresh = bucketed(kept, f"{self.store.root}/{path}", self.buckets, KEY)
        changes = None
        if old is not None:
            known = old.select("repo").distinct()
            kinds = probed(old, fresh).join(known, "repo", "left_semi")
            pick = kinds.where("change_kind = 'changed'").select(*KEY)
            pairs = pick.join(old.select(*KEY, F.col("v").alias("old_value")), KEY).join(fresh.select(*KEY, F.col("v").alias("new_value")), KEY)
            changes = kinds.join(pairs, KEY, "left")
        self.store.keep(index=path, buckets=self.buckets)
        self.store.publish()
        return changes
