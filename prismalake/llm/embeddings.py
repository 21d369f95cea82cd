"""Embedding near-duplicates by epsilon grid order join.

Vectors are normalised, projected on their leading principal dimensions and cut into grid cells as wide as the
distance that the similarity allows. Spark sorts the vectors by cell (range partitions, then within each), consecutive
ones form blocks, and blocks that hold equal or neighbouring cells meet in a join; those whose bounding boxes on all
leading dimensions are provably farther apart are skipped before any vector moves. Each pair of blocks is joined
recursively: the longer interval is halved, halves whose bounding boxes are provably farther apart are skipped, and
leaves are compared in double precision.

Equal vectors of a label are one vertex with a count, so a very common vector costs one row. A pair of blocks returns
counts and a spanning forest of its links, not the links, so a dense group of m vectors gives O(m) rows for each pair
of its blocks. The principal directions come from sums of ``dim * dim`` numbers; nothing larger reaches the driver.

Defined results: a vector that is null, zero or has null or non-finite components, and any with a null label, links
with nothing; vectors of one label but different length are not compared; rows with the same id count once; a null id
gives a null component and is kept; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import components, local_roots

LEADING, CELL_DIMS, BLOCK, LEAF = 6, 3, 1024, 48


def fingerprints(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, f1, f2, vec): ``vec`` (little-endian doubles) and fingerprint are null where nothing can link."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, f1, f2 = [], [], []
            for label, x in zip(batch.column("label"), batch.column("embedding")):
                ok = label.is_valid and x.is_valid and len(x.values) and x.values.null_count == 0
                v = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0 if ok else np.zeros(0)
                ok = ok and np.isfinite(v).all() and v.any()
                vecs.append(v.tobytes() if ok else None)
                h = np.frombuffer(hashlib.blake2b(vecs[-1], digest_size=16).digest(), "<i8") if ok else (None, None)
                f1.append(None if h[0] is None else int(h[0]))
                f2.append(None if h[1] is None else int(h[1]))
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "label", "f1", "f2", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(mark, "vec_id long, label string, f1 long, f2 long, vec binary")


def _unit(column: pa.Array) -> np.ndarray:
    m = np.frombuffer(b"".join(x.as_py() for x in column), "<f8").reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)  # very large and very small components neither overflow nor vanish
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def principal(reps: DataFrame, leading: int) -> dict[int, np.ndarray]:
    """Leading principal directions for each vector length, from summed products."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = pc.binary_length(batch.column("vec")).to_numpy().astype(np.int64) // 8
            for d in np.unique(dims).tolist():
                m = _unit(batch.column("vec").filter(pa.array(dims == d)))
                m = np.hstack([m, np.ones((len(m), 1))])
                total[d] = total.get(d, 0) + m.T @ m
        for d, m in total.items():
            yield pa.record_batch([pa.array(np.full(m.size, d)), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["dim", "at", "x"])

    table = reps.select("vec").mapInArrow(sums, "dim long, at long, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).toArrow()
    out = {}
    for d in pc.unique(table.column("dim")).to_pylist():
        own = table.filter(pc.equal(table.column("dim"), d)).sort_by("at")
        m = own.column("x").to_numpy().reshape(d + 1, d + 1)
        mean = m[:d, d] / m[d, d]
        out[d] = np.linalg.eigh(m[:d, :d] / m[d, d] - np.outer(mean, mean))[1][:, ::-1][:, :leading].copy()
    return out


def ordered_blocks(reps: DataFrame, eps: float, axes: Broadcast, size: int = BLOCK) -> DataFrame:
    """(block, label, dim, ids, copies, vecs, cells, low, high): consecutive vectors in grid order, ``cells`` the first
    cells they hold, ``low`` and ``high`` their bounds on all leading dimensions. ``axes``: see ``principal``."""
    spark = reps.sparkSession

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.binary_length(batch.column("vec")).to_numpy().astype(np.int64) // 8
            cells = np.zeros((batch.num_rows, CELL_DIMS), np.int32)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                p = _unit(batch.column("vec").take(pa.array(at))) @ axes.value[d]
                cells[at, : min(CELL_DIMS, p.shape[1])] = np.floor(p[:, :CELL_DIMS] / eps)
            yield pa.record_batch([*batch.columns, pa.array(dims), *(pa.array(cells[:, i]) for i in range(CELL_DIMS))], [*batch.schema.names, "dim", *(f"c{i}" for i in range(CELL_DIMS))])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal count
            cells = np.unique(np.stack([table.column(f"c{i}").to_numpy() for i in range(CELL_DIMS)], 1), axis=0)
            cells = pa.array(cells.tolist(), pa.list_(pa.int32()))
            count += 1
            p = _unit(table.column("vec").combine_chunks()) @ axes.value[table.column("dim")[0].as_py()]
            low, high = (pa.array([x.tolist()], pa.list_(pa.float64())) for x in (p.min(0), p.max(0)))
            return pa.record_batch([pa.array([(part << 33) + count]), table.column("label").slice(0, 1).combine_chunks(), table.column("dim").slice(0, 1).combine_chunks(), pa.array([table.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([table.column("copies").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([b"".join(table.column("vec").to_pylist())], pa.binary()), pa.array([cells.to_pylist()], pa.list_(pa.list_(pa.int32()))), low, high], ["block", "label", "dim", "ids", "copies", "vecs", "cells", "low", "high"])

        def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            key = pc.binary_join_element_wise(table.column("label"), table.column("dim").cast(pa.string()), "\x00")
            number = key.combine_chunks().dictionary_encode().indices.to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b, size):
                    n = min(size, b - i)
                    if last or b < table.num_rows or n == size:
                        yield out(table.slice(i, n))
                    else:
                        held.append(table.slice(i, n))

        for batch in batches:
            if batch.num_rows:
                table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                held = []
                yield from cut(table, False)
        if held:
            table, held = pa.concat_tables(held), []
            yield from cut(table, True)

    order = ["label", "dim", *(f"c{i}" for i in range(CELL_DIMS)), "id"]
    placed = reps.select("id", "label", "vec", "copies").mapInArrow(place, "id long, label string, vec binary, copies long, dim long, " + ", ".join(f"c{i} int" for i in range(CELL_DIMS)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return rows.mapInArrow(block, "block long, label string, dim long, ids binary, copies binary, vecs binary, cells array<array<int>>, low array<double>, high array<double>")


def joined(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float, eps: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine at least ``least``: intervals are halved until provably distant or small."""
    found, stack = [], [(0, len(x), 0, len(y))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c >= b:
            continue
        gap = np.maximum(0, np.maximum(px[a:b].min(0) - py[c:d].max(0), py[c:d].min(0) - px[a:b].max(0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= least)
            found.append((i + a, j + c))
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    i, j = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    if same:
        i, j = i[j < i], j[j < i]
    return i, j


def near_links(reps: DataFrame, least: float) -> DataFrame:
    """(id, n, near): for ``reps(id, label, vec, copies)`` the copies linked with each and a spanning forest of links."""
    spark = reps.sparkSession
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    axes = spark.sparkContext.broadcast(principal(reps, LEADING))
    blocks = written(ordered_blocks(reps, eps, axes), "blocks")
    cell = blocks.select("label", "dim", "block", F.explode("cells").alias("c"))
    cell = cell.select("label", "dim", "block", *[F.col("c")[i].alias(f"c{i}") for i in range(CELL_DIMS)])
    around = cell
    for i in range(CELL_DIMS):
        around = around.withColumn(f"c{i}", F.explode(F.array(*[F.col(f"c{i}") + k for k in (-1, 0, 1)])))
    around = around.distinct()
    pairs = cell.join(around.withColumnRenamed("block", "other"), ["label", "dim", *(f"c{i}" for i in range(CELL_DIMS))]).where("other <= block").select("block", "other").distinct()
    # Blocks whose boxes are provably farther apart are skipped before any vector moves.
    box = blocks.select("block", "low", "high")
    pairs = pairs.join(box, "block").join(box.select(F.col("block").alias("other"), F.col("low").alias("low2"), F.col("high").alias("high2")), "other")
    gap = "aggregate(zip_with(zip_with(low, high2, (a, b) -> a - b), zip_with(low2, high, (a, b) -> a - b), (a, b) -> greatest(0D, a, b)), 0D, (s, g) -> s + g * g)"
    pairs = written(pairs.where(F.expr(gap) <= eps * eps).select("block", "other"), "block-pairs")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(c)[k].as_py()
                d, same = get("dim"), get("block") == get("other")
                ia, ib = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("ids2"), "<i8")
                x, y = (_unit(pa.array([v[i : i + 8 * d] for i in range(0, len(v), 8 * d)], pa.binary())) for v in (get("vecs"), get("vecs2")))
                i, j = joined(x, y, x @ axes.value[d], y @ axes.value[d], least, eps, same)
                if not len(i):
                    continue
                na, nb = np.frombuffer(get("copies"), "<i8"), np.frombuffer(get("copies2"), "<i8")
                ids, at = np.unique(np.concatenate([ia[i], ib[j]]), return_inverse=True)
                n = np.bincount(at, np.concatenate([nb[j], na[i]]), len(ids)).astype(np.int64)
                nodes, root = local_roots(ia[i], ib[j])
                yield pa.record_batch([pa.array(ids), pa.array(n), pa.array(root[np.searchsorted(nodes, ids)])], ["id", "n", "near"])

    one = blocks.select("block", "dim", "ids", "copies", "vecs")
    two = blocks.select(F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("copies").alias("copies2"), F.col("vecs").alias("vecs2"))
    return pairs.join(one, "block").join(two, "other").mapInArrow(link, "id long, n long, near long")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``."""
    rows = written(fingerprints(vectors), "vectors")
    same = ["label", "f1", "f2"]
    reps = rows.where("f1 is not null and vec_id is not null").groupBy(*same).agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.first("vec").alias("vec"))
    reps = written(reps, "vertices")
    near = written(near_links(reps, least), "near")
    counts = near.groupBy("id").agg(F.sum("n").alias("n"))
    found = components(near, "id", "near")
    of = reps.select(*same, "id", "copies").join(counts, "id", "left").join(found, "id", "left")
    of = of.select(*same, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    out = rows.select("vec_id", *same).join(of, same, "left")
    out = out.withColumn("component_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
