"""Embedding near-duplicates: navigable small-world graphs per shard.

1. Valid vectors are scaled to unit length in double precision; equal ones are
   one class with a count, so copies are neither indexed nor compared again.
2. Classes are dealt over shards by hash.  Every shard is one hierarchical
   small-world graph, built by one task; ``shard_rows`` and ``SHARD_BYTES`` of
   vectors bound its size.
3. Classes are queries in blocks, every block against every shard.  A task
   audits its beam on a sample of its queries against brute force and doubles
   it until recall reaches ``recall``; a query whose beam is full of links is
   repeated with a wider one; past a quarter of the shard the search is a scan.
4. Links are verified by cosine in double precision.  A task returns counts
   per query and a spanning star of the links it found, never the pairs;
   components unite the stars.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component link with nothing (0 links, own component, kept); so do
vectors of different lengths with each other; rows that repeat a vector are
links of each other; a null id is carried and names no component unless all
its ids are null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmament.llm.components import components, min_labels
from firmament.llm.store import saved

M = 12  # links of a node on the upper levels; twice that on the lowest
BEAM_BUILD = 48
BEAM_QUERY = 48
AUDIT = 100  # queries of a block that are checked by brute force
AT_ONCE = 256  # queries that walk a graph together
EXPAND = 4  # nodes a query opens in one step
SHARD_BYTES = 32 << 20  # of a shard's vectors, in double precision
COSINES = 1 << 20  # made at once by brute force


def unit(vector: list[float] | None) -> bytes | None:
    """The vector scaled to length 1, as doubles; None if it can have no links."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return (v / np.sqrt(v @ v)).tobytes()


@dataclass
class Graph:
    """Hierarchical navigable small-world graph over unit vectors."""

    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # (row of each node or -1, links)
    top: int = -1

    def walk(self, queries: np.ndarray, start: np.ndarray, beam: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The beams of many queries at one level: (nodes, cosines), best first, -1 for none."""
        row, links = self.levels[level]
        n = len(queries)
        width = max(beam, start.shape[1])
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf, np.float32)
        ids[:, : start.shape[1]] = start
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("bkd,bd->bk", self.vectors[start], queries), -np.inf)
        seen = np.zeros((n, len(self.vectors) + 1), bool)  # the last column stands for -1
        np.put_along_axis(seen, ids, True, 1)
        opened = ids < 0
        active = np.arange(n)
        while len(active):
            waiting = np.where(opened[active], -np.inf, sims[active])
            pick = np.argpartition(-waiting, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
            real = np.isfinite(np.take_along_axis(waiting, pick, 1))
            go = real.any(1)
            active, pick, real = active[go], pick[go], real[go]
            if not len(active):
                break
            opened[active[:, None], pick] = True
            from_ids = np.where(real, ids[active[:, None], pick], -1)
            near = np.where(from_ids[..., None] >= 0, links[row[from_ids]], -1).reshape(len(active), -1)
            near.sort(1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[seen[active[:, None], near]] = -1
            seen[active[:, None], near] = True
            used = (near >= 0).any(0)
            near = near[:, used] if used.any() else near[:, :1]
            cos = np.where(near >= 0, np.einsum("bkd,bd->bk", self.vectors[near], queries[active]), -np.inf)
            all_ids = np.hstack([ids[active], near])
            all_sims = np.hstack([sims[active], cos])
            all_open = np.hstack([opened[active], near < 0])
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.arange(width)[None, :]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            opened[active] = np.take_along_axis(all_open, best, 1) | (ids[active] < 0)
        order = np.argsort(-sims, 1)[:, :beam]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def descend(self, queries: np.ndarray, to: int) -> np.ndarray:
        """Entry points at level ``to``: greedy walks from the top."""
        at = np.full((len(queries), 1), self.top)
        for level in range(len(self.levels) - 1, to, -1):
            at = self.walk(queries, at, 1, level)[0]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        out = [self.walk(q, self.descend(q, 0), beam, 0) for q in (queries[i : i + AT_ONCE] for i in range(0, len(queries), AT_ONCE))]
        return np.vstack([o[0] for o in out]), np.vstack([o[1] for o in out])


def spread_out(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first), links that point different ways:
    one is taken if it is nearer to the node than to every link before it;
    places left go to the nearest others."""
    n, k = ids.shape
    each = vectors[ids]
    between = np.einsum("nid,njd->nij", each, each)
    taken = np.zeros((n, k), bool)
    for c in range(k):
        crowded = (np.where(taken, between[:, c], -np.inf) >= sims[:, c, None]).any(1)
        taken[:, c] = ~crowded & (ids[:, c] >= 0) & (taken.sum(1) < most)
    rank = np.where(taken, 0, 1) * k + np.arange(k) + np.where(ids < 0, 2 * k, 0)
    order = np.argsort(rank, 1)[:, :most]
    out = np.take_along_axis(ids, order, 1)
    return np.hstack([out, np.full((n, most - out.shape[1]), -1)]) if out.shape[1] < most else out


def build(vectors: np.ndarray, seed: int = 11) -> Graph:
    """The graph of all rows of ``vectors``; nodes join in batches that search
    what is there and see each other."""
    n = len(vectors)
    vectors = vectors.astype(np.float32)
    height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(M)).astype(int)
    height[0] = max(height.max(initial=0), height[0])  # the first node is the entry everywhere
    graph = Graph(vectors, top=0)
    for level in range(height.max(initial=0) + 1):
        members = np.flatnonzero(height >= level)
        row = np.full(n + 1, -1)
        row[members] = np.arange(len(members))
        graph.levels.append((row, np.full((len(members) + 1, 2 * M if level == 0 else M), -1)))
    done = 1
    while done < n:
        batch = np.arange(done, min(n, done + max(16, min(done, 512))))
        for level in range(len(graph.levels)):
            new = batch[height[batch] >= level]
            if len(new):
                _join(graph, new, level)
        done = batch[-1] + 1
    return graph


def _join(graph: Graph, new: np.ndarray, level: int) -> None:
    row, links = graph.levels[level]
    vectors, most = graph.vectors, links.shape[1]
    ids, sims = [], []
    for i in range(0, len(new), AT_ONCE):
        q = vectors[new[i : i + AT_ONCE]]
        a, b = graph.walk(q, graph.descend(q, level), BEAM_BUILD, level)
        ids.append(a)
        sims.append(b)
    own = vectors[new] @ vectors[new].T
    np.fill_diagonal(own, -np.inf)
    mates = min(len(new) - 1, 2 * M)
    ids_all, sims_all = np.vstack(ids), np.vstack(sims)
    if mates > 0:
        near = np.argpartition(-own, mates - 1, axis=1)[:, :mates]
        ids_all = np.hstack([ids_all, new[near]])
        sims_all = np.hstack([sims_all, np.take_along_axis(own, near, 1)])
    order = np.argsort(-sims_all, 1)[:, :BEAM_BUILD]
    ids_all, sims_all = np.take_along_axis(ids_all, order, 1), np.take_along_axis(sims_all, order, 1)
    links[row[new]] = spread_out(vectors, ids_all, sims_all, most)

    # the other direction: a node's list takes the newcomers, and is thinned when it overflows
    to, back = links[row[new]].ravel(), np.repeat(new, most)
    to, back = to[to >= 0], back[to >= 0]
    cos = np.einsum("kd,kd->k", vectors[to], vectors[back])
    order = np.lexsort((-cos, to))
    to, back = to[order], back[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    place = np.arange(len(to)) - np.repeat(first, count)
    width = min(int(count.max(initial=0)), most)  # the nearest newcomers only; a graph heuristic, the audit checks it
    incoming = np.full((len(nodes), width), -1)
    ok = place < width
    incoming[np.repeat(np.arange(len(nodes)), count)[ok], place[ok]] = back[ok]
    joint = np.hstack([links[row[nodes]], incoming])
    joint.sort(1)
    joint[:, 1:][joint[:, 1:] == joint[:, :-1]] = -1
    sims_j = np.where(joint >= 0, np.einsum("nkd,nd->nk", vectors[joint], vectors[nodes]), -np.inf)
    order = np.argsort(-sims_j, 1)
    links[row[nodes]] = spread_out(vectors, np.take_along_axis(joint, order, 1), np.take_along_axis(sims_j, order, 1), most)


def linked(queries: np.ndarray, exact: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) of all links by brute force, ``COSINES`` pairs at a time."""
    step = max(1, COSINES // max(1, len(queries)))
    for i in range(0, len(exact), step):
        q, node = np.nonzero(queries @ exact[i : i + step].T >= cosine)
        yield q, node + i


def search_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, cosine: float, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) index arrays of all links found, a piece at a time."""
    n, low = len(exact), cosine - 1e-5  # single precision leads, double precision decides
    sample = np.linspace(0, len(queries) - 1, min(AUDIT, len(queries))).astype(int)
    truth = np.zeros((len(sample), n), bool)
    for q, node in linked(queries[sample], exact, cosine):
        truth[q, node] = True
    beam = BEAM_QUERY
    while 4 * beam < n:
        ids, sims = graph.search(queries[sample].astype(np.float32), beam)
        full = (sims[:, -1] >= low) & (ids[:, -1] >= 0)  # repeated wider below
        found = sum(np.isin(np.flatnonzero(t), i).sum() for t, i, f in zip(truth, ids, full) if not f)
        if found >= recall * truth[~full].sum():
            break
        beam *= 2
    todo = np.arange(len(queries))
    while len(todo):
        rest = []
        for i in range(0, len(todo), AT_ONCE):
            at = todo[i : i + AT_ONCE]
            if 4 * beam >= n:
                yield from ((at[q], node) for q, node in linked(queries[at], exact, cosine))
                continue
            ids, sims = graph.search(queries[at].astype(np.float32), beam)
            full = (sims[:, -1] >= low) & (ids[:, -1] >= 0)
            rest.append(at[full])
            q, k = np.nonzero((sims >= low) & (ids >= 0) & ~full[:, None])
            node = ids[q, k]
            right = np.einsum("kd,kd->k", queries[at][q], exact[node]) >= cosine
            yield at[q[right]], node[right]
        todo = np.concatenate(rest) if rest else todo[:0]
        beam *= 4


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, shards: int = 4, shard_rows: int = 200_000, blocks: int = 8, recall: float = 0.99) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    There are ``shards`` graphs, more when one would pass ``shard_rows``
    classes or ``SHARD_BYTES``, and per shard ``blocks`` blocks of queries or as
    many as keep a block under both."""
    units = F.udf(unit, "binary")(F.col(vector_col))
    rows = saved(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), units.alias("unit")).withColumn("key", F.md5("unit")), "units")
    classes = rows.filter("unit is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("unit").alias("unit"), F.min("vec_id").alias("first"))
    classes = saved(classes.select(F.xxhash64("key").alias("cid"), "key", "n", "unit", "first"), "classes")
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("unit").cast("bigint")), F.lit(0))).first()
    least = max(math.ceil(n / shard_rows), math.ceil(size / SHARD_BYTES))
    shards, blocks = max(shards, least), max(blocks, least)
    dims = F.octet_length("unit")

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid")
        exact = np.stack([np.frombuffer(u) for u in part["unit"]])
        graph = build(exact)
        graph.vectors = None  # made again from ``exact``
        graph.levels = [(row.astype(np.int32), links.astype(np.int32)) for row, links in graph.levels]
        kept = (graph, exact, part["cid"].to_numpy(np.int64), part["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [part["shard"].iat[0]], "dims": [part["dims"].iat[0]], "graph": [pickle.dumps(kept, 5)]})

    dealt = classes.select("cid", "n", "unit", dims.alias("dims"), F.pmod(F.col("cid"), F.lit(shards)).cast("int").alias("shard"))
    graphs = saved(dealt.groupBy("dims", "shard").applyInPandas(make, "shard int, dims int, graph binary"), "graphs", maxRecordsPerFile="1")
    places = graphs.select("shard", "dims", "graph", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    queries = classes.select("cid", "unit", dims.alias("dims"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def look(block: pd.DataFrame, place: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(place):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        graph, exact, cids, sizes = pickle.loads(place["graph"].iat[0])
        graph.vectors = exact.astype(np.float32)
        own = block["cid"].to_numpy(np.int64)
        asked = np.stack([np.frombuffer(u) for u in block["unit"]])
        nodes, at = np.unique(np.concatenate([own, cids]), return_inverse=True)
        own_at, cid_at = at[: len(own)], at[len(own) :]
        label, links = np.arange(len(nodes)), np.zeros(len(own), np.int64)
        for q, node in search_links(graph, exact, asked, cosine, recall):
            other = cids[node] != own[q]
            q, node = q[other], node[other]
            np.add.at(links, q, sizes[node])
            if len(q):  # joined to what is known, a piece at a time
                edge = np.unique(np.stack([label[own_at[q]], label[cid_at[node]]]), axis=1)
                label = min_labels(edge[0], edge[1], len(nodes))[label]
        off = np.flatnonzero(label != np.arange(len(nodes)))
        star = pd.DataFrame({"a": nodes[off], "b": nodes[label[off]], "links": 0})
        counts = pd.DataFrame({"a": own, "b": own, "links": links})
        return pd.concat([star, counts[counts["links"] > 0]]).astype("int64")

    found = queries.groupBy("dims", "shard", "block").cogroup(places.groupBy("dims", "shard", "block")).applyInPandas(look, "a bigint, b bigint, links bigint")
    found = saved(found, "found")
    links = found.filter("a = b").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnRenamed("node", "cid")
    named = classes.select("cid", "key", "n", "first").join(links, "cid", "left").join(roots, "cid", "left")
    named = saved(named.withColumn("component", F.coalesce("component", "cid")), "linked")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    per_key = saved(named.join(smallest, "component").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "named")
    out = rows.select("vec_id", "key").join(per_key, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
