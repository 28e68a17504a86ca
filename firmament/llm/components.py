"""Connected components of an edge table, as Spark joins and aggregates.

Alternates two contractions until nothing changes: every node's larger
neighbours are linked to its smallest neighbour, then every node's smaller
neighbours are.  Each keeps connectivity, and what remains is a star around
the smallest node of every component.  Before the first round each batch of
edges is reduced to a spanning star of its own components, so a dense group
arrives as about one edge per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.store import saved

EDGES = "a bigint, b bigint"


def min_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node index of each node's component, for edges between 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[label])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every other node of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = min_labels(at[: len(a)], at[len(a) :], len(nodes))
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        if len(x):
            a, b = star_edges(x["a"].to_numpy(np.int64), x["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": a, "b": b})


def _link(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction; ``a`` > ``b`` in every edge it gets and returns."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        out = both.filter("b > a").join(saved(low, "low"), "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        low = saved(edges.groupBy("a").agg(F.min("b").alias("low")), "low")
        out = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        out = out.unionByName(low.select("a", F.col("low").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b: bigint);
    component is the smallest node that links reach.  No edges: no rows."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    edges = saved(edges.mapInPandas(_reduce, EDGES).distinct(), "edges")
    before = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
        edges = saved(_link(saved(_link(edges, True), "edges"), False), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
