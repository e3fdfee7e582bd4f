"""Incremental ingestion as a stream: every micro-batch of RawNode rows is merged into the stored graph.

The store keeps nodes and edges in buckets (nodes by id, edges by source) behind a pointer (sources.generations); a batch
reads and rewrites only the buckets that its rows fall into.  The number of the last batch stands in the pointer, so that
a batch that is delivered again after a failure is applied once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.operators import ingest
from graphloom.operators import lifecycle as L
from graphloom.session import cut
from graphloom.sources import sites
from graphloom.sources.generations import Generations

EMPTY = "id string, type string, name string, repo string, language string, file_path string, signature string, signature_hash string, file_hash string, line_range struct<start:int,end:int>, layer string, first_seen_commit string, last_seen_commit string, created_at timestamp_ntz, updated_at timestamp_ntz, deleted_at timestamp_ntz"


EDGES = "src string, dst string, type string, weight double, unresolved boolean, created_at timestamp_ntz, updated_at timestamp_ntz"
BUCKETS = 64


class GraphStream:
    """Feeds batches of raw rows into the graph stored at root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.store, self.buckets = spark, Generations(spark, root), buckets

    def _read(self, table: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        known = self.store.read(table, buckets)
        return self.spark.createDataFrame([], schema) if known is None else known.select(*[c.split(" ")[0] for c in schema.replace("struct<start:int,end:int>", "struct").split(", ")])

    def nodes(self) -> DataFrame:
        return self._read("nodes", EMPTY)

    def edges(self) -> DataFrame:
        return self._read("edges", EDGES)

    def applied(self) -> int:
        return self.store.state().get("batch", -1)

    def _merge(self, table: str, schema: str, new: DataFrame, key: str, merged) -> None:
        """Merge new rows into the buckets that they fall into."""
        bucket = F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            self.store.write_buckets(table, merged(self._read(table, schema, touched), new).withColumn("bucket", bucket), "bucket", touched)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge one batch; the last run of each repo in it is the commit that its rows are seen at."""
        if number <= self.applied():
            return
        batch = cut(batch)
        scanned = cut(sites.scanned(batch))
        new = cut(L.normalised(batch))
        at = F.col("extracted_at")
        self._merge("nodes", EMPTY, new, "id", lambda old, n: L.upsert_nodes(old, n, F.col("run_id"), at).drop("action"))
        # Edges are resolved against what is stored and what this batch brings, of the repos that it touches.
        repos = new.select("repo").distinct()
        known = self.nodes().join(repos, "repo", "left_semi").where("deleted_at IS NULL").select("id", "type", "name", "repo", "file_path", "deleted_at")
        known = known.unionByName(new.select("id", "type", "name", "repo", "file_path", F.lit(None).cast("timestamp_ntz").alias("deleted_at"))).dropDuplicates(["id"])
        found = cut(ingest.edges_of(batch, scanned, known))
        self._merge("edges", EDGES, found, "src", lambda old, n: L.upsert_edges(old, n, F.current_timestamp().cast("timestamp_ntz")))
        self.store.keep(batch=number)
        self.store.publish()

    def start(self, path: str, schema: StructType, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
        """Read Parquet files as they arrive under path and merge them, all that are there now and then stop."""
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return reader.parquet(path).writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
