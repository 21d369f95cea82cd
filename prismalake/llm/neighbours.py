"""Approximate nearest neighbours by adaptive dimension scans of inverted lists.

Centroids are fitted by k-means on a bounded sample (``SAMPLE`` rows, ``SAMPLE_MB`` at most); every vector is put into
the list of its nearest centroid. Vectors are turned by one random orthogonal matrix, so that the distance over the
first d of D dimensions, times D / d, estimates the whole distance; a list is stored in blocks of at most ``BLOCK``
vectors, each block as columns of ``STEP`` dimensions. A query scans the columns of a probed block one after another and
after each tests the hypothesis that a candidate is nearer than the query's threshold: candidates whose estimate lies
more than ``EPSILON / sqrt(d)`` (relative) above it are given up. The distance of those that last is computed from the
original vectors in double precision.

A first round scans each query's nearest list; its tenth distance is the query's threshold. The second round probes the
nearest ``PROBE`` of all lists, without those whose ball lies wholly beyond the threshold. Lists are cut into blocks by range
partitions over list and id and queries are packed the same way, so that a list that holds a third of all rows, or a
list that many queries probe, is many rows of bounded size. A pair of blocks returns at most ``top`` rows a query.

Defined results: vectors that are null, zero or empty, or hold null or non-finite components, take no part, nor do rows
with a null id; rows that share an id count once (the one whose bytes sort first); only vectors of equal length are
compared; fewer candidates than ``top`` give fewer rows; an empty input gives an empty result; other columns are ignored.
Components are to lie within 1e150 in size; distances beyond the range of doubles are infinite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, SAMPLE_MB, LISTS, ROUNDS = 32_768, 64, 1024, 8
BLOCK, QUERIES, STEP, EPSILON, PROBE = 1024, 256, 16, 2.1, 0.65
PAIRS = 1 << 18  # pairs whose partial distances a task holds at once


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, vec): the vectors that take part, one for each id, as little-endian doubles."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, vecs = [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not x.is_valid or not len(x.values) or x.values.null_count:
                    continue
                v = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(v).all() and v.any():
                    ids.append(i)
                    dims.append(len(v))
                    vecs.append(v.tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(dims, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "dim", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(mark, "vec_id long, dim long, vec binary")
    return rows.groupBy("vec_id").agg(F.min(F.struct("vec", "dim")).alias("x")).select("vec_id", "x.dim", "x.vec")


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def turned(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every run."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by products (exact enough to order lists and test hypotheses)."""
    with np.errstate(all="ignore"):
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """k-means, started from rows spread over the sample; empty lists keep their place."""
    found = np.unique(sample, axis=0)
    at = found[np.random.default_rng(k).permutation(len(found))[:k]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([squares(sample[i : i + 4096], at).argmin(1) for i in range(0, len(sample), 4096)])
        n = np.bincount(near, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, near, sample)
        at[n > 0] = sums[n > 0] / n[n > 0, None]
    return at


def fitted(rows: DataFrame) -> dict[int, np.ndarray]:
    """Centroids for each vector length, from a sample of bounded size: rows whose hash is below a share."""
    out = {}
    for dim, n in rows.groupBy("dim").count().collect():  # a row for each length of vectors
        most = max(256, min(SAMPLE, (SAMPLE_MB << 20) // (8 * dim)))
        share = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
        some = rows.where(F.col("dim") == dim).where(share).limit(2 * most).select("vec").toArrow()
        if not some.num_rows:
            some = rows.where(F.col("dim") == dim).limit(most).select("vec").toArrow()
        sample = matrix(some.column("vec").combine_chunks(), dim)
        out[dim] = centroids(sample, max(1, min(LISTS, int(np.sqrt(n)))))
    return out


def packed(rows: DataFrame, size: int, extra: list[str]) -> DataFrame:
    """(dim, list, ids, vecs, and ``extra`` as doubles): consecutive rows of a list, at most ``size`` in each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            blob = lambda c, kind: pa.array([table.column(c).to_numpy().astype(kind).tobytes()], pa.binary())
            key = [table.column(c).slice(0, 1).combine_chunks() for c in ("dim", "list")]
            return pa.record_batch([*key, blob("vec_id", "<i8"), pa.array([b"".join(table.column("vec").to_pylist())], pa.binary()), *(blob(c, "<f8") for c in extra)], ["dim", "list", "ids", "vecs", *extra])

        def cut(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            dim, at = table.column("dim").to_numpy(), table.column("list").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(dim) != 0) | (np.diff(at) != 0)) + 1).tolist(), table.num_rows]
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

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["dim", "list", "vec_id"]
    kinds = "".join(f", {c} binary" for c in extra)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(pack, f"dim long, list long, ids binary, vecs binary{kinds}")


def scan(q: np.ndarray, own: np.ndarray, limit: np.ndarray, x: np.ndarray, ids: np.ndarray, turn: np.ndarray, top: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, distance): for each row of ``q`` the ``top`` nearest rows of ``x`` within ``limit`` that last."""
    dim = q.shape[1]
    tq, tx = q @ turn, x @ turn
    columns = [(tq[:, d : d + step], np.ascontiguousarray(tx[:, d : d + step])) for d in range(0, dim, step)]
    sizes = (q * q).sum(1)[:, None] + (x * x).sum(1)[None]  # bounds the rounding of the products
    out = []
    for a in range(0, len(q), rows := max(1, PAIRS // max(1, len(x)))):
        b = min(len(q), a + rows)
        with np.errstate(all="ignore"):
            part, done, most = squares(columns[0][0][a:b], columns[0][1]), min(step, dim), limit[a:b] ** 2

            def lasts(part: np.ndarray, most: np.ndarray, slack: np.ndarray) -> np.ndarray:
                factor = (1 + EPSILON / np.sqrt(done)) ** 2 if done < dim else 1
                return ~(part * (dim / done) > most * factor + slack)

            i, j = np.nonzero(lasts(part, most[:, None], 1e-9 * sizes[a:b]) & (own[a:b, None] != ids[None]))
            part = part[i, j]
            for cq, cx in columns[1:]:
                done = min(dim, done + step)
                part = part + ((cq[i + a] - cx[j]) ** 2).sum(1)
                keep = lasts(part, most[i], 1e-9 * sizes[i + a, j])
                i, j, part = i[keep], j[keep], part[keep]
            exact = np.concatenate([np.sqrt(((q[i[k : k + PAIRS] + a] - x[j[k : k + PAIRS]]) ** 2).sum(1)) for k in range(0, len(i), PAIRS)] or [np.zeros(0)])
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < top
        out.append((i[keep] + a, j[keep], exact[keep]))
    return tuple(np.concatenate(z) for z in zip(*out))


def met(queries: DataFrame, lists: DataFrame, top: int) -> DataFrame:
    """(query_id, vec_id, score) of each block of queries with each block of the list that they probe."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[k].as_buffer(), kind)
                dim = batch.column("dim")[k].as_py()
                if dim not in turns:
                    turns[dim] = turned(dim)
                own, ids = get("ids", "<i8"), get("ids2", "<i8")
                i, j, score = scan(get("vecs", "<f8").reshape(-1, dim), own, get("within", "<f8"), get("vecs2", "<f8").reshape(-1, dim), ids, turns[dim], top)
                yield pa.record_batch([pa.array(own[i]), pa.array(ids[j]), pa.array(score)], ["query_id", "vec_id", "score"])

    other = lists.select("dim", "list", F.col("ids").alias("ids2"), F.col("vecs").alias("vecs2"))
    return packed(queries, QUERIES, ["within"]).join(other, ["dim", "list"]).mapInArrow(link, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame | None = None, top: int = 10, probe: float = PROBE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``top`` nearest found among ``vectors``.

    Both have (vec_id, embedding); without ``queries`` these are the vectors whose id is divisible by 100. A query is
    never its own candidate."""
    spark = vectors.sparkSession
    rows = written(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % 100 == 0) if queries is None else written(usable(queries), "queries")
    model = spark.sparkContext.broadcast(fitted(rows))  # LISTS centroids at most for each length of vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            at, far = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                i = np.flatnonzero(dims == d)
                for c in range(0, len(i), 1024):
                    some = i[c : c + 1024]
                    x = matrix(batch.column("vec").take(pa.array(some)), d)
                    at[some] = squares(x, model.value[d]).argmin(1)
                    far[some] = np.sqrt(((x - model.value[d][at[some]]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(at), pa.array(far)], [*batch.schema.names, "list", "far"])

    placed = rows.mapInArrow(assign, "vec_id long, dim long, vec binary, list long, far double")
    lists = written(packed(placed, BLOCK, ["far"]), "lists")

    def balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = [np.frombuffer(x.as_buffer(), "<f8").max() for x in batch.column("far")]
            yield pa.record_batch([batch.column("dim"), batch.column("list"), pa.array(far, pa.float64())], ["dim", "list", "radius"])

    radius = {d: np.full(len(c), -1.0) for d, c in model.value.items()}
    found = lists.select("dim", "list", "far").mapInArrow(balls, "dim long, list long, radius double").groupBy("dim", "list").agg(F.max("radius").alias("radius"))
    for d, at, r in found.collect():  # a row for each list that holds vectors
        radius[d][at] = r
    reach = spark.sparkContext.broadcast(radius)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Without a threshold: the nearest list that holds vectors. With one: the others to probe."""
        for batch in batches:
            first, dims = "limit" not in batch.schema.names, batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                if d not in model.value:
                    continue
                own = batch.filter(pa.array(dims == d))
                limit = np.full(own.num_rows, np.inf) if first else pc.fill_null(own.column("limit"), np.inf).to_numpy()
                size = reach.value[d]
                for c in range(0, own.num_rows, 256):
                    x = matrix(own.column("vec").slice(c, 256), d)
                    far = np.where(size >= 0, squares(x, model.value[d]), np.inf)
                    order = np.argsort(far, 1, kind="stable")
                    n = min(int((size >= 0).sum()), max(1, int(np.ceil(probe * (size >= 0).sum()))))
                    chosen = order[:, :1] if first else order[:, 1:n]
                    away = np.sqrt(np.maximum(0, np.take_along_axis(far, chosen, 1))) - size[chosen]
                    i, j = np.nonzero(~(away * (1 - 1e-9) > limit[c : c + 256, None]))
                    some = own.slice(c, 256).take(pa.array(i))
                    yield pa.record_batch([some.column("vec_id"), some.column("dim"), some.column("vec"), pa.array(chosen[i, j].astype(np.int64)), pa.array(limit[c + i])], ["vec_id", "dim", "vec", "list", "within"])

    kinds = "vec_id long, dim long, vec binary, list long, within double"
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")  # at most ``top`` rows of each probed block
    seed = written(met(asked.mapInArrow(aim, kinds), lists, top), "seeds")
    limit = seed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.col("score").alias("limit"))
    rest = met(asked.join(limit, "vec_id", "left").mapInArrow(aim, kinds), lists, top)
    ranked = seed.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
