"""Keyword, vector and fused search.

BM25 is spelled out over posting lists (k1 1.2, b 0.75; lower case, split at what is no letter or digit).  Vector search
is exact cosine: the query set is taken in blocks of bounded size, each block meets every partition of the vectors as
one matrix product step by step, partitions keep their own best and a window merges them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, spread

K1, B, RRF = 1.2, 0.75, 60
BLOCK = 2048
STEP = 1024  # vectors that meet a block at once


def terms(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf, size)."""
    words = docs.select(key, terms(text).alias("words"))
    return words.select(key, F.size("words").alias("size"), F.explode("words").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("size").alias("size"))


def bm25(docs: DataFrame, key: str, text: Column, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query, key, score, rank) of the best documents for each query (query, q) by BM25.

    Document counts and lengths cover all documents; only the postings of the queries' terms are scored.
    """
    asked = queries.select("query", F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
    p = postings(docs, key, text)
    stats = docs.select(F.size(terms(text)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    total = stats.collect()[0]
    n, mean = total["docs"], total["mean"] or 1.0
    hit = p.join(asked.select("term").distinct(), "term", "left_semi")
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))
    scored = hit.join(df, "term").select(key, "term", part.alias("s")).join(asked, "term").groupBy("query", key).agg(F.round(F.sum("s"), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def bm25_texts(docs: DataFrame, key: str, text: Column, queries: DataFrame, most: int = 10) -> DataFrame:
    """The same as ``bm25`` for queries that are whole texts, which share words with nearly every document.

    No row for each pair is made: the queries go block by block, as in ``knn``, and each batch of documents meets a block
    as one matrix of scores, in frequent terms by a product of matrices and in the others posting by posting.
    """
    d = docs.select(F.col(key).alias("k"), terms(text).alias("words"))
    q = queries.select("query", F.array_distinct(terms(F.col("q"))).alias("words")).where(F.size("words") > 0)
    total = d.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("words")).alias("mean")).collect()[0]
    n, mean = total["docs"], total["mean"] or 1.0
    asked = q.count()
    blocks = max(1, -(-asked // BLOCK))
    df = d.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if blocks > 1:
        q, df = cut(q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))), cut(df)
    kinds, kind = dict(docs.dtypes)[key], dict(queries.dtypes)["query"]
    out: DataFrame | None = None
    for b in range(blocks):
        part = q if blocks == 1 else q.where(F.col("block") == b)
        known = {r["term"]: r["df"] for r in df.join(part.select(F.explode("words").alias("term")).distinct(), "term", "left_semi").collect()}
        rows = part.select("query", "words").collect()
        block = QueryBlock([r["query"] for r in rows], [r["words"] for r in rows], known, n, mean, most)
        shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by the words of BLOCK queries

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from shared.value.ranked(batches)

        scored = spread(d).mapInArrow(best, f"query {kind}, k {kinds}, score double")
        out = scored if out is None else out.unionByName(scored)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "k")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumnRenamed("k", key)


class QueryBlock:
    """The terms of some queries, and the scores of documents against all of them."""

    ROWS = 512  # documents taken at once
    FREQUENT = 0.02  # share of the documents from which a term counts as frequent

    def __init__(self, names: list, words: list[list[str]], df: dict[str, int], n: int, mean: float, most: int):
        self.names, self.mean, self.most = names, mean, most
        self.terms = sorted((t for t in df), key=lambda t: (-df[t], t))
        self.dense = sum(df[t] >= max(2, self.FREQUENT * n) for t in self.terms)
        at = {t: k for k, t in enumerate(self.terms)}
        counts = np.array([df[t] for t in self.terms], np.float64)
        self.idf = np.log(1 + (n - counts + 0.5) / (counts + 0.5))
        pairs = sorted((at[t], j) for j, ws in enumerate(words) for t in ws if t in at)
        term, self.query = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def ranked(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What may be among the best of a query, batch by batch: nothing below the best that were seen before it."""
        if not self.terms:
            return
        m, known = len(self.names), pa.array(self.terms)
        names = pa.array(self.names)
        matrix = np.zeros((self.dense, m))
        inside = slice(0, self.start[self.dense])
        matrix[np.repeat(np.arange(self.dense), np.diff(self.start[: self.dense + 1])), self.query[inside]] = 1.0
        top = np.zeros((m, self.most))
        for batch in batches:
            for low in range(0, batch.num_rows, self.ROWS):
                rows = batch.slice(low, self.ROWS)
                score = np.round(self.scores(rows.column(1), known, matrix), 6)
                merged = np.concatenate([top, score.T], axis=1)
                top = np.partition(merged, -self.most, axis=1)[:, -self.most :]
                i, j = np.nonzero((score >= top.min(axis=1)) & (score > 0))  # ties at the edge all go on; the window settles them
                yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), rows.column(0).take(pa.array(i)), pa.array(score[i, j])], names=["query", "k", "score"])

    def scores(self, words: pa.ListArray, known: pa.Array, matrix: np.ndarray) -> np.ndarray:
        """Documents by queries."""
        n, m, v = len(words), len(self.names), len(self.terms)
        size = np.nan_to_num(pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.float64))
        doc = np.repeat(np.arange(n), size.astype(np.int64))
        term = pc.fill_null(pc.index_in(words.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        cell, tf = np.unique((doc * v + term)[term >= 0], return_counts=True)
        doc, term = cell // v, cell % v
        weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / self.mean))
        often = term < self.dense
        left = np.zeros((n, self.dense))
        left[doc[often], term[often]] = weight[often]
        out = left @ matrix
        doc, term, weight = doc[~often], term[~often], weight[~often]
        times = self.start[term + 1] - self.start[term]
        if times.sum():
            first = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(times)[:-1]]), times)
            asked = self.query[first + np.arange(len(first))]
            out += np.bincount(np.repeat(doc, times) * m + asked, np.repeat(weight, times), n * m).reshape(n, m)
        return out


def knn(vectors: DataFrame, key: str, vector: str, queries: DataFrame, most: int = 10) -> DataFrame:
    """(query, key, score, rank): the nearest rows to each query (query, vector) by cosine, score (1 + cos) / 2.

    Queries go block by block, so that what is shared with the workers is bounded by BLOCK vectors.
    """
    kinds = dict(vectors.dtypes)
    q = queries.where("vector IS NOT NULL").select("query", "vector")
    blocks = -(-q.count() // BLOCK)
    if blocks > 1:  # blocks by hash are of about equal size
        q = cut(q.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks))))
    out: DataFrame | None = None
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.col("block") == b)).select("query", "vector").collect()
        if not rows:
            continue
        names = np.array([r["query"] for r in rows])
        matrix = np.array([r["vector"] for r in rows], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

        def best(batches: Iterator[pd.DataFrame], names=names, matrix=matrix) -> Iterator[pd.DataFrame]:
            kept, floor = pd.DataFrame({"i": [], "k": [], "score": []}), np.full(len(names), -np.inf)
            found: list[pd.DataFrame] = []
            waiting = 0

            def compact() -> pd.DataFrame:
                """The best of every query so far, ties by key; and the score that a row must reach from now on."""
                rows = pd.concat([x for x in (kept, *found) if len(x)] or [kept]).sort_values(["i", "score", "k"], ascending=[True, False, True])
                rows = rows[rows.groupby("i").cumcount() < most]
                full = rows.groupby("i")["score"].agg(["size", "min"])
                full = full[full["size"] == most]
                floor[full.index.to_numpy(int)] = full["min"].to_numpy()
                found.clear()
                return rows

            for frame in batches:
                for at in range(0, len(frame), STEP):
                    part = frame.iloc[at : at + STEP]
                    v = np.stack(part["v"].to_numpy()).astype(np.float64)
                    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                    score = np.round((1 + matrix @ v.T) / 2, 6)
                    k = min(most, score.shape[1])
                    edge = np.maximum(np.partition(score, -k, axis=1)[:, -k], floor)
                    i, j = np.nonzero(score >= edge[:, None])  # ties at the edge all stay until they are settled by key
                    found.append(pd.DataFrame({"i": i, "k": part["k"].to_numpy()[j], "score": score[i, j]}))
                    waiting += len(i)
                    if waiting > 4 * most * len(names):
                        kept, waiting = compact(), 0
            kept = compact()
            if len(kept):
                yield pd.DataFrame({"query": names[kept["i"].to_numpy(int)], "k": kept["k"].to_numpy(), "score": kept["score"].to_numpy()})

        kind = dict(queries.dtypes)["query"]
        part = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v IS NOT NULL").mapInPandas(best, f"query {kind}, k {kinds[key]}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(queries.dtypes)["query"]
        return vectors.select(F.lit(None).cast(kind).alias("query"), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "k")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).withColumnRenamed("k", key)


def fuse(lists: list[DataFrame], key: str, most: int = 10) -> DataFrame:
    """Reciprocal rank fusion of (query, key, rank) lists: the sum of 1 / (60 + rank)."""
    rows = lists[0].select("query", key, "rank")
    for x in lists[1:]:
        rows = rows.unionByName(x.select("query", key, "rank"))
    scored = rows.groupBy("query", key).agg(F.round(F.sum(1 / (F.lit(float(RRF)) + F.col("rank"))), 6).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def name_matches(texts: DataFrame, key: str, text: Column, names: DataFrame, group: str) -> DataFrame:
    """(key, id, name): whole-word, case-sensitive mentions of names of three letters or more, by tokens and an equi-join."""
    found = texts.select(key, group, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))).alias("name"))
    return found.join(names.select("id", "name", group).where(F.length("name") >= 3).distinct(), ["name", group]).select(key, "id", "name").distinct()
