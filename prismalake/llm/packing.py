"""Best-fit packing by exact-complement hashing.

Pieces are packed by length alone, so the plan is made on the counts of the at most ``capacity`` different lengths:
for the longest remaining length the gap is looked up among single lengths, sums of two and sums of three that are
still available, each found combination is used as often as the counts allow, and what fills no gap exactly is packed
best-fit decreasing. The plan (ranges of ranks within a length -> sequence and offset) is bounded by the number of
lengths and not by the corpus, so it is made on the driver and broadcast. Spark numbers the pieces of each length:
every task numbers its own, and the counts by task and length are summed over the tasks.

Defined results: null text is the empty text (its only id is the end id); longer documents are cut into pieces of
``capacity`` of which the first may be shorter; repeated documents are packed as often as they occur; an empty input
gives an empty result; other columns of the input are ignored by ``pack_documents``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import pieces, written


def fillings(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: times}, sequences) that use up ``counts`` (index: length)."""
    left, out = counts.astype(np.int64).copy(), []

    def use(parts: tuple[int, ...], most: int) -> int:
        need: dict[int, int] = {}
        for x in parts:
            need[x] = need.get(x, 0) + 1
        n = min(most, *(int(left[x]) // k for x, k in need.items()))
        if n > 0:
            for x, k in need.items():
                left[x] -= n * k
            out.append((need, n))
        return max(n, 0)

    for first in range(capacity, 0, -1):
        if left[first] and first == capacity:
            use((first,), int(left[first]))
            continue
        gap = capacity - first
        if left[first] and gap <= capacity and left[gap]:
            use((first, gap), int(left[first]))
        if left[first]:
            for second in _pairs(left, gap):
                use((first, second, gap - second), int(left[first]))
                if not left[first]:
                    break
        if left[first]:
            for second in np.flatnonzero(left[: gap - 1])[::-1].tolist() if gap > 2 else []:
                if not left[first]:
                    break
                if 3 * second < gap:
                    break
                for third in _pairs(left, gap - second, second):
                    use((first, second, third, gap - second - third), int(left[first]))
                    if not left[first] or not left[second]:
                        break
    # Best fit decreasing over what fills no gap exactly: bins of the same filling are handled together.
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            fits = [r for r in open_bins if r >= x]
            room = min(fits, default=capacity)
            if fits:
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
            else:
                pattern, bins = {}, n
            each = min(room // x, n)
            used = min(bins, n // each)
            if fits and used < bins:
                open_bins.setdefault(room, []).append((pattern, bins - used))
            open_bins.setdefault(room - each * x, []).append((pattern | {x: each}, used))
            n -= used * each
    return out + [p for bins in open_bins.values() for p in bins]


def _pairs(left: np.ndarray, total: int, most: int | None = None) -> list[int]:
    """Available a (at most ``most``) with an available total - a, the larger of the two, largest first."""
    if total < 2:
        return []
    a = np.arange(min(total - 1, most or total), (total - 1) // 2, -1)
    return a[(left[a] > 0) & (left[total - a] > 0)].tolist()


def placements(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, times in a sequence, first sequence, offset), ordered by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for x, times in sorted(pattern.items(), reverse=True):
            rows.append((x, rank.get(x, 0), times, sequence, offset))
            rank[x] = rank.get(x, 0) + n * times
            offset += x * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(plan: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the piece with this rank among the pieces of its length."""
    step = np.int64(1) << np.int64(48)
    at = np.searchsorted(plan[:, 0] * step + plan[:, 1], length * step + rank, "right") - 1
    inner, (times, sequence, offset) = rank - plan[at, 1], plan[at, 2:].T
    return sequence + inner // times, offset + inner % times * length


def token_pieces(docs: DataFrame, path: str, end: int, capacity: int, style: str = "leading", with_ids: bool = False, held: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids if asked for, part, rank): rank counts within part and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokens.coder(path, style, held), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in pieces(batches, "text", 8 << 20):
            ids, n = tokens.with_end(*coder.encode(batch.column("text")), end)
            k = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
            head = n - (k - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            data = np.ascontiguousarray(ids, "<u4")
            begin = np.repeat(np.cumsum(n) - n, k) + start
            crc = np.fromiter((zlib.crc32(data[a : a + x]) for a, x in zip(begin.tolist(), length.tolist())), np.int64, len(row))
            order = np.argsort(length, kind="stable")
            by = length[order]
            groups = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
            rank = np.empty(len(by), np.int64)
            sizes = np.diff(np.append(groups, len(by)))
            rank[order] = np.arange(len(by)) - np.repeat(groups, sizes) + seen[by]
            seen[by[groups]] += sizes
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array([data[a : a + x].tobytes() for a, x in zip(begin.tolist(), length.tolist())], pa.binary()))
                names.append("ids")
            yield pa.record_batch([*cols, pa.array(np.full(len(row), part)), pa.array(rank)], [*names, "part", "rank"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, f"doc_id long, piece int, start long, length long, ids_crc32 long, {'ids binary, ' if with_ids else ''}part long, rank long")


def pack(rows: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to written rows with ``length``, ``part`` and ``rank``."""
    spark = rows.sparkSession
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).toArrow()  # at most ``capacity`` rows
    held = np.zeros(capacity + 1, np.int64)
    held[counts.column("length").to_numpy()] = counts.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(placements(fillings(held, capacity)))
    before = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    before = before.select("part", "length", earlier.alias("before"))
    names = [c for c in rows.columns if c not in ("part", "rank")]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = place(plan, batch.column("length").to_numpy(), rank)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = rows.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return rows.join(before, ["part", "length"]).select(*names, "rank", "before").mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = 2048, with_ids: bool = False, held: int | None = None) -> DataFrame:
    """One row for each piece of ``docs(doc_id, text)`` with its place. ``held``: words whose ids a worker keeps."""
    return pack(written(token_pieces(docs, tokenizer, end, capacity, with_ids=with_ids, held=held), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the ids of each sequence one after another; needs ``with_ids``."""
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.tokenizer_path("byte_bpe_50k.json"), end=0)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: the pieces of all kept documents with their sequences. Workers that serve other stages too keep
    fewer words."""
    return pack_documents(docs, tokens.tokenizer_path("byte_bpe_50k.json"), end=0, held=200_000)
