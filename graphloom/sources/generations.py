"""Tables kept as generations of Parquet folders behind numbered pointer files.

A generation is written whole before its pointer appears, pointers are never overwritten, and the one with the highest
number is in force: a job that dies leaves the old one, and what is read is never overwritten.  A table may be kept in
buckets; a generation then holds only the buckets that it changed, and the pointer says where each bucket lies.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def bucketed(df: DataFrame, path: str, buckets: int, keys: list[str], by: str | None = None) -> DataFrame:
    """df written to path, bucketed and sorted by keys (inside folders of ``by``), and read back: joins on the keys do not shuffle it."""
    spark, name = df.sparkSession, f"generation_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path)
    (writer.partitionBy(by) if by else writer).saveAsTable(name)
    return spark.table(name)


def reopened(spark: SparkSession, path: str, buckets: int, keys: list[str]) -> DataFrame:
    """What ``bucketed`` wrote to path (without folders), in a session that does not know it yet."""
    name, schema = f"generation_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(keys)}) SORTED BY ({', '.join(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class Generations:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.next: dict | None = None

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[int]:
        found, fs = self._path("CURRENT-*")
        return sorted(int(s.getPath().getName().rpartition("-")[2]) for s in fs.globStatus(found) or [])

    def state(self) -> dict:
        """What is in force: table -> folder, or table -> bucket -> folder; empty before the first generation."""
        pointers = self._pointers()
        return json.loads(self.spark.read.text(f"{self.root}/CURRENT-{pointers[-1]:012d}", wholetext=True).first()[0]) if pointers else {}

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The table in force, of a bucketed one only the given buckets if there are any; None where nothing is there."""
        at = self.state().get(table)
        if isinstance(at, dict):
            folders = [f"{self.root}/{g}" for b, g in sorted(at.items()) if buckets is None or int(b) in buckets]
            return self.spark.read.parquet(*folders) if folders else None
        return None if at is None else self.spark.read.parquet(f"{self.root}/{at}")

    def _begin(self) -> tuple[dict, str]:
        self.next = self.state() if self.next is None else self.next
        return self.next, f"gen-{uuid.uuid4().hex}"

    def write(self, **tables: DataFrame) -> dict[str, DataFrame]:
        """Write whole tables; they come into force with ``publish``, tables that are not named stay."""
        state, gen = self._begin()
        for table, df in tables.items():
            df.write.parquet(f"{self.root}/{gen}/{table}")
            state[table] = f"{gen}/{table}"
        return {t: self.spark.read.parquet(f"{self.root}/{gen}/{t}") for t in tables}

    def write_buckets(self, table: str, df: DataFrame, bucket: str, touched: list[int]) -> None:
        """Write the touched buckets of a table anew, the others stay where they are."""
        state, gen = self._begin()
        df.repartition(bucket).write.partitionBy(bucket).parquet(f"{self.root}/{gen}/{table}")
        here, fs = self._path(f"{gen}/{table}")
        written = {s.getPath().getName() for s in fs.listStatus(here)}
        at = dict(state.get(table) or {})
        for b in touched:
            at.pop(str(b), None)
            if f"{bucket}={b}" in written:
                at[str(b)] = f"{gen}/{table}/{bucket}={b}"
        state[table] = at

    def keep(self, **values) -> None:
        """Small values that belong to the generation, in the pointer itself."""
        state, _ = self._begin()
        state.update(values)

    def publish(self) -> None:
        """Put in force what was written: the next pointer appears by a rename that fails if another writer was first."""
        number = (self._pointers() or [0])[-1] + 1
        new, fs = self._path(f"next-{uuid.uuid4().hex}")
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(self.next).encode()))
        out.close()
        pointer, _ = self._path(f"CURRENT-{number:012d}")
        if fs.exists(pointer) or not fs.rename(new, pointer):
            fs.delete(new, False)
            raise RuntimeError(f"{self.root} was changed by another writer")
        self.next = None
