"""Distributed union-find: connected components by alternating stars.

Each round re-hangs every node's neighbours on its smallest neighbour (large
star: those above it; small star: those below).  Edges only ever move towards
the roots, so the edge set ends as one star per component after O(log n)
rounds on real link graphs.  Nothing is collected; a hub's edges are reduced by
`min` before the shuffle and spread again by a join that Spark can split.

Before that, each task replaces the edges that it has read by the stars of their
components.  What is left travels packed; up to HELD edges are one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bitstrata.llm import kernels as K
from bitstrata.llm import scratch

#: Edges that one task holds at once.
HELD = 1 << 20


def stars(edges: np.ndarray) -> np.ndarray:
    """(node, root) for every node of (n, 2) edges but the roots: the least nodes of the components."""
    nodes, ends = np.unique(edges, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    at = np.flatnonzero(parent != np.arange(len(nodes)))
    return np.stack([nodes[at], nodes[parent[at]]], 1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) -> (m, edges): their stars, in rows of at most HELD edges."""
    held: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        edges = stars(np.concatenate(held))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([len(edges)]), pa.array([edges.tobytes()], pa.binary())], names=["m", "edges"])

    for batch in batches:
        for k in range(0, batch.num_rows, HELD):
            held.append(np.stack([batch.column(c).slice(k, HELD).to_numpy() for c in (0, 1)], 1))
            if sum(map(len, held)) >= HELD:
                yield out()
    if held:
        yield out()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(0):
            yield np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in _edges(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy())], names=["u", "v"])


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed edges -> (node, component), all of them at once."""
    found = stars(np.concatenate([np.zeros((0, 2), np.int64), *_edges(batches)]))
    roots = np.unique(found[:, 1])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([found[:, 0], roots])), pa.array(np.concatenate([found[:, 1], roots]))], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select("u", F.col("m").alias("v"))
        out = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter("u <> v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a table, with their number and a sum that tells whether any has moved."""
    seen = Observation()
    out = scratch.keep(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")), "edges")
    return out, (int(seen.get["n"]), int(seen.get["h"] or 0))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; component is the
    smallest node reachable.  Links may repeat, point both ways or to itself;
    links with a null end are left out.  No links: no rows."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    ends = links.select(x.alias("u"), y.alias("v")).filter(x.isNotNull() & y.isNotNull() & (x != y))
    packed = scratch.keep(ends.mapInArrow(K.trimming(_packed), "m long, edges binary"), "edges", compression="none")
    if int(packed.agg(F.sum("m")).first()[0] or 0) <= HELD:
        out = scratch.keep(packed.select("edges").coalesce(1).mapInArrow(K.trimming(_solved), "node long, component long"), "components")
        scratch.drop(packed)
        return out
    edges, state = _kept(packed.select("edges").mapInArrow(K.trimming(_unpacked), "u long, v long").distinct())
    scratch.drop(packed)
    while state[0]:
        after, now = _kept(_star(_star(edges, True), False))
        scratch.drop(edges)
        edges, same = after, now == state
        state = now
        if same:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
