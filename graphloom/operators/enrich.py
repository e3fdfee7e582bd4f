"""Summaries and embeddings from pluggable providers.

A provider is an object with ``summarise(list of dicts) -> list of dicts`` or ``embed(list of str) -> 2-d array``; it is
made once per Python worker by a factory and called with whole batches.  The defaults need no network: a rule-based
summary and a hashed bag of words of fixed dimension.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



class RuleSummaries:
    """First sentence of the first comment or docstring, else a sentence made of kind and name."""

    COMMENT = re.compile(r'(?:"""|///?|#|/\*\*?|\*)\s*([A-Za-z][^\n"*]{8,200})')

    def summarise(self, rows: list[dict]) -> list[dict]:
        out = []
        for r in rows:
            text = r["text"] or ""
            m = self.COMMENT.search(text)
            lines = text.count("\n") + 1 if text else 0
            words = re.findall(r"[A-Z]?[a-z]{2,}", r["name"] or "")
            out.append({
                "summary": m.group(1).strip() if m else f"{(r['type'] or 'node').capitalize()} '{r['name']}'.",
                "tags": sorted({w.lower() for w in words})[:5],
                "complexity": "simple" if lines < 20 else "moderate" if lines < 60 else "complex",
            })
        return out


class HashedWords:
    """Unit vectors of signed word counts, hashed to a fixed dimension."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def summaries(nodes: DataFrame, factory: Callable = RuleSummaries, attempts: int = 3) -> DataFrame:
    """(id, summary, tags, complexity) of nodes (id, type, name, text); a batch that keeps failing gives nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in batches:
            found = None
            for _ in range(attempts):
                try:
                    found = provider.summarise(frame.to_dict("records"))
                    break
                except Exception:  # a provider may be any service
                    continue
            found = found or [{"summary": None, "tags": None, "complexity": None}] * len(frame)
            yield pd.DataFrame({"id": frame["id"], "summary": [x["summary"] for x in found], "tags": [x["tags"] for x in found], "complexity": [x["complexity"] for x in found]})

    return nodes.select("id", "type", "name", "text").mapInPandas(run, "id string, summary string, tags array<string>, complexity string")


def embeddings(rows: DataFrame, key: str, text: str, factory: Callable = HashedWords) -> DataFrame:
    """(key, embedding) of every row."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for frame in batches:
            yield pd.DataFrame({"k": frame["k"], "embedding": list(provider.embed(frame["t"].fillna("").tolist()))})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, embedding array<float>").withColumnRenamed("k", key)


def wanted(nodes: DataFrame, ids: list[str] | None = None, only_missing: bool = True) -> DataFrame:
    """Live nodes to summarise: those named, or those of the summarised kinds; with ``only_missing`` without a summary."""
    n = nodes.where("deleted_at IS NULL").where(F.col("id").isin(*ids) if ids else F.col("type").isin("class", "interface", "function", "method", "file", "enum"))
    return n.where("summary IS NULL") if only_missing else n
