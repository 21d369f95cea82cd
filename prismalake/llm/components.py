"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a minimum by vertex and a join back, so no vertex's neighbours are ever gathered in one place; a vertex
with very many links is split by adaptive skew joins. Every round is written to the shared folder, which cuts the
lineage. The rounds grow with the logarithm of the number of vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links and the smallest vertex that each reaches, by repeated minima over the links."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _shrunk(links: DataFrame) -> DataFrame:
    """Links of each task replaced by stars around the smallest vertex that they reach there."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                u, v = local_roots(batch.column("u").to_numpy(), batch.column("v").to_numpy())
                keep = u != v
                yield pa.record_batch([pa.array(u[keep]), pa.array(v[keep])], ["u", "v"])

    return links.mapInArrow(stars, "u long, v long")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component): for every vertex of a link the smallest vertex reachable. Loops and nulls are ignored."""
    links = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v")
    edges, before = written(_shrunk(links).distinct(), "links"), None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        edges = written(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            break
        before = state
    found = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return found.unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
