"""Token ids as compressed binary files: static range asymmetric numeral system.

One frequency table of the whole corpus is shared by all blocks. A block holds the ids of some consecutive documents,
spread over interleaved lanes that are coded side by side with numpy. Blocks are independent, carry a checksum, and
keep checkpoints (all lane states every ``every`` rows) from which decoding can start inside a block.

Layout of a folder: ``table`` (frequencies) and data files of blocks. A block: the fixed header ``HEADER``, then
document ids (signed 64 bit) and their null flags (8 bit), ids of each document (64 bit), first states (64 bit, one
a lane), checkpoints (row 64 bit, words before it 64 bit, states), words (32 bit). All little-endian. The list of
blocks in order (file, position, size, tokens before it) is a Parquet table next to them, ``blocks``: it is written
last and names only the files of tasks that ended well, so that lost or repeated tasks leave no trace in it.

Sizes: the table holds at most ``2**SCALE`` slots, whatever the corpus; a task holds one block (about
``block_tokens`` ids, more only if one document is longer).

Defined results: null text is the empty text (one id, the end id); an empty input gives a folder with no blocks and an
empty result; repeated ids and null ids (first in order) are documents of their own; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder, pieces, written

SCALE = 20
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<8sIIIIQQII")
MAGIC = b"PRISMRA1"
U32, U64 = np.uint32, np.uint64


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; every symbol that occurs keeps at least 1."""
    total, room = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), U32)
    if (counts > 0).sum() > room:
        raise ValueError(f"more than {room} distinct symbols")
    out = np.maximum(counts.astype(np.float64) * room / total, counts > 0).astype(np.int64)
    extra = int(out.sum()) - room
    order = np.argsort(-out, kind="stable")
    while extra > 0:  # taken from the most frequent
        for i in order:
            give = min(extra, int(out[i]) - 1, max(1, int(out[i]) // 8))
            if give <= 0:
                break
            out[i] -= give
            extra -= give
            if not extra:
                break
    out[order[0]] -= extra
    return out.astype(U32)


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(U64)
        self.slots = np.repeat(np.arange(len(freq), dtype=U32), freq)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Final states, checkpoints (row, words before it, states) and words; ids fill rows of ``lanes``."""
        rows = -(-len(ids) // lanes)
        state, chunks, marks, count = np.full(lanes, LOW, U64), [], [], 0
        for r in range(rows - 1, -1, -1):
            row = ids[r * lanes : (r + 1) * lanes]
            x, f = state[: len(row)], self.freq[row]
            full = x >= (f << U64(63 - SCALE))
            if full.any():
                chunks.append(x[full].astype(U32))
                count += len(chunks[-1])
                x = np.where(full, x >> U64(32), x)
            q = x // f
            state[: len(row)] = (q << U64(SCALE)) + (x - q * f) + self.start[row]
            if r and r % every == 0:
                marks.append((r, count, state.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, U32)
        return state, [(r, count - c, s) for r, c, s in reversed(marks)], words

    def decode(self, state: np.ndarray, words: np.ndarray, n: int, at: int = 0) -> np.ndarray:
        """The n ids whose coding left these states and words; ``at``: the first word to read."""
        lanes, out, mask = len(state), np.empty(n, U32), U64((1 << SCALE) - 1)
        state = state.copy()
        wide = words.astype(U64)
        for i in range(0, n, lanes):
            x = state[: min(lanes, n - i)]
            slot = x & mask
            got = self.slots[slot]
            out[i : i + len(x)] = got
            x = self.freq[got] * (x >> U64(SCALE)) + slot - self.start[got]
            low = np.flatnonzero(x < LOW)
            if len(low):
                x[low] = (x[low] << U64(32)) | wide[at : at + len(low)]
                at += len(low)
            state[: len(x)] = x
        return out


def pack_block(table: Table, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray, lanes: int = 2048, every: int = 128) -> bytes:
    lanes = int(max(1, min(lanes, len(ids) // 64)))
    state, marks, words = table.encode(ids, lanes, every)
    body = b"".join([
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], np.uint8).tobytes(),
        lengths.astype("<i8").tobytes(),
        state.astype("<u8").tobytes(),
        *(struct.pack("<QQ", r, c) + s.astype("<u8").tobytes() for r, c, s in marks),
        words.astype("<u4").tobytes(),
    ])
    return HEADER.pack(MAGIC, len(doc_ids), lanes, every, len(marks), len(ids), len(words), zlib.crc32(body), 0) + body


class Block:
    """A read block; ``ids(first, last)`` decodes from the nearest checkpoint."""

    def __init__(self, data: bytes, table: Table):
        magic, docs, self.lanes, self.every, marks, self.n, n_words, check, _ = HEADER.unpack_from(data)
        body = memoryview(data)[HEADER.size :]
        if magic != MAGIC or zlib.crc32(body) != check:
            raise ValueError("damaged block")
        self.table, at = table, 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        self.doc_ids, self.no_id, self.lengths = take("<i8", docs), take("u1", docs), take("<i8", docs)
        self.marks = {0: (0, take("<u8", self.lanes))}
        for _ in range(marks):
            row, before = take("<u8", 2)
            self.marks[int(row)] = (int(before), take("<u8", self.lanes))
        self.words = take("<u4", n_words)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n if last is None else last
        row = first // self.lanes // self.every * self.every
        before, state = self.marks[row]
        return self.table.decode(state.astype(U64), self.words, last - row * self.lanes, before)[first - row * self.lanes :]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(path: str, data: bytes) -> None:
    store, name = _at(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name) as f:
        f.write(data)


def _get(path: str, at: int | None = None, size: int | None = None) -> bytes:
    store, name = _at(path)
    with store.open_input_file(name) as f:
        return f.read() if at is None else f.read_at(size, at)


def tokenised(docs: DataFrame, path: str, end: int, style: str) -> DataFrame:
    """(oid, doc_id, ids, counts) in ascending doc_id order: ``oid`` grows with it and is gapless in each part.

    ``ids``: little-endian unsigned, 16 bits each where the vocabulary allows, else 32. A part's last row has no ``oid``:
    its ``counts`` are the ids that occur in the part and how often, 64 bits each."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(path, style)
        kind = np.dtype(id_type(coder.coder.get_vocab_size()))
        sums = np.zeros(coder.coder.get_vocab_size(), np.int64)
        for batch in pieces(batches, "text", 8 << 20):
            ids, n = tokens.with_end(*coder.encode(batch.column("text")), end)
            sums += np.bincount(ids, minlength=len(sums))
            offsets = np.append(0, np.cumsum(n * kind.itemsize)).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, kind))])
            yield pa.record_batch([batch.column("oid"), batch.column("doc_id"), data, pa.nulls(len(n), pa.binary())], ["oid", "doc_id", "ids", "counts"])
        at = np.flatnonzero(sums)
        none = pa.array([None], pa.int64())
        yield pa.record_batch([none, none, pa.array([None], pa.binary()), pa.array([np.stack([at, sums[at]]).astype("<i8").tobytes()])], ["oid", "doc_id", "ids", "counts"])

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id").select(F.monotonically_increasing_id().alias("oid"), "doc_id", "text")
    return rows.mapInArrow(encode, "oid long, doc_id long, ids binary, counts binary")


def id_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int, style: str = "words", block_tokens: int = 1 << 20) -> None:
    """Encode ``docs(doc_id, text)`` to ``folder`` in ascending doc_id order."""
    spark = docs.sparkSession
    rows = written(tokenised(docs, tokenizer, end, style), "tokens")
    kind = id_type(tokens.coder(tokenizer, style).coder.get_vocab_size())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("counts"):
                at, n = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                sums = np.pad(sums, (0, max(0, int(at.max(initial=-1)) + 1 - len(sums))))
                sums[at] += n
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(sums[at])], ["id", "n"])

    counts = rows.where("counts is not null").select("counts").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # a row for each token id
    held = np.zeros(int(np.max(counts.column("id").to_numpy(), initial=-1)) + 1, np.int64)
    held[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    freq = frequencies(held)
    _put(f"{folder}/table", freq.astype("<u4").tobytes())
    shared = spark.sparkContext.broadcast(freq)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, name = Table(shared.value), f"{folder}/data-{uuid.uuid4().hex}"
        out, at, listed = None, 0, []
        gathered: list[tuple] = []

        def flush() -> None:
            nonlocal out, at, gathered
            if not gathered:
                return
            if out is None:
                store, local = _at(name)
                store.create_dir(local.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(local)
            ids = np.concatenate([g[2] for g in gathered])
            data = pack_block(table, ids, [g[1] for g in gathered], np.array([len(g[2]) for g in gathered]))
            out.write(data)
            listed.append((name, at, len(data), gathered[0][0], len(ids), len(gathered)))
            at += len(data)
            gathered = []

        size = 0
        for batch in batches:
            for oid, doc, ids in zip(batch.column("oid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
                if gathered and (oid != gathered[-1][0] + 1 or size >= block_tokens):
                    flush()
                    size = 0
                gathered.append((oid, doc, np.frombuffer(ids.as_buffer(), kind)))
                size += len(gathered[-1][2])
        flush()
        if out is not None:
            out.close()
        names = ["file", "at", "size", "oid", "n_tokens", "n_docs"]
        kinds = [pa.string(), *[pa.int64()] * 5]
        yield pa.record_batch([pa.array([x[i] for x in listed], kinds[i]) for i in range(6)], names)

    blocks = rows.where("oid is not null").select("oid", "doc_id", "ids").mapInArrow(encode, "file string, at long, size long, oid long, n_tokens long, n_docs long")
    blocks.write.parquet(f"{folder}/blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``start``, the ids before each: sums by part first, then within each part."""
    part = F.shiftright("oid", 33)
    by_part = blocks.groupBy(part.alias("part")).agg(F.sum("n_tokens").alias("all"))  # a row for each part of the sort
    by_part = by_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = Window.partitionBy("part").orderBy("oid")
    rows = blocks.withColumn("part", part).withColumn("inner", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return rows.join(by_part, "part").select(*blocks.columns, (F.col("before") + F.col("inner")).alias("start"))


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: little-endian 32-bit) of every document; blocks are decoded in parallel."""
    freq = np.frombuffer(_get(f"{folder}/table"), "<u4")
    shared = spark.sparkContext.broadcast(freq)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(_get(row["file"], row["at"], row["size"]), table)
                n = block.lengths
                before = np.cumsum(n) - n
                offsets = np.append(0, np.cumsum(n * 4)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(block.ids(), "<u4"))])
                yield pa.record_batch([pa.array(block.doc_ids, mask=block.no_id.astype(bool)), pa.array(row["start"] + before), pa.array(n), data], ["doc_id", "start", "n_tokens", "ids"])

    schema = "file string, at long, size long, oid long, n_tokens long, n_docs long"
    blocks = block_starts(spark.read.schema(schema).parquet(f"{folder}/blocks"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(parts, "file", "at").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "rans")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokens.tokenizer_path("word_bpe_49k.json"), end=1)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
