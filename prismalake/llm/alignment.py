"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often they do so corpus-wide.

Both tokenizers are run over units, i.e. stretches of a text that start at a blank after a character that is no white
space: no token of either joins characters across such a place, so a unit is encoded once and kept by the worker. Byte
offsets where tokens of both end cut them into groups; the tokens that end there are linked.

Links are counted as packed 64-bit keys (first id, second id): each task counts its own with ``np.unique``, Spark sorts
the counts by range partitions, and each partition sums runs of equal keys and writes a sorted shard (keys, then counts)
to the shared folder. The second pass maps the shards into memory and finds each batch's distinct keys by binary search,
so a worker reads only pages that it needs and nothing of the size of the table is broadcast. Where the shared folder
is no local path, Spark's own file distribution brings the shards to the executors. Broadcast are the shards' first keys
and the highest count of each second id (as many as the second vocabulary has).

Defined results: null and empty texts, and those that one of the vocabularies changes (as a text that holds U+2581),
have no tokens: zeros and an empty string; repeated rows and rows that share an id are judged each by its own text; an
empty input gives an empty result; other columns are ignored. As every token has at least one byte, just one token of
each vocabulary ends at a common offset, and there are as many links as groups.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, new_folder, pieces, utf8, written
from .rans import _put
from .tokens import gathered, tokenizer_path

KEPT = 300_000  # units whose ids a worker keeps
JOINED = 400  # new units encoded in one call
PARTIAL = 1 << 20  # distinct keys whose counts a task adds up before it sends them
_aligners: dict[tuple[str, str], Aligner] = {}


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Aligner:
    """Encodes batches with a byte-level vocabulary (file of ``tokenizers``) and a piece vocabulary (``sentencepiece``)."""

    def __init__(self, bytes_path: str, pieces_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(bytes_path), sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        letters = byte_letters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(letters.get(c, 63) for c in name) for name in names]
        pieces_ = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces_)]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces_)
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        self.kind = np.dtype("<u2" if max(len(names), len(pieces_)) <= 1 << 16 else "<u4")
        self.seen: dict[bytes, tuple[bytes, bytes] | None] = {}
        most = max(len(names), len(pieces_))
        number, width = np.arange(most), len(str(most))
        self.digits = np.zeros((most, width + 1), np.uint8)  # right-justified, a place for the separator at the end
        for k in range(width):
            self.digits[:, width - 1 - k] = 48 + number // 10**k % 10
        self.places = np.ones(most, np.int64)
        for k in range(1, width):
            self.places += number >= 10**k

    def both(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of ``text``, which begins with a blank, in both vocabularies; the second puts that blank there itself."""
        second = self.b.encode(text[1:]) if len(text) > 1 else [self.blank]
        return self.a.encode(text, add_special_tokens=False).ids, second

    def checked(self, unit: bytes) -> tuple[bytes, bytes] | None:
        a, b = self.both(unit.decode())
        same = b"".join([self.a_bytes[i] for i in a]) == unit and b"".join([self.b_bytes[i] for i in b]) == unit
        return (np.array(a, self.kind).tobytes(), np.array(b, self.kind).tobytes()) if same else None

    def learn(self, units: list[bytes]) -> None:
        """Ids of new units: those that end in a plain character many in one call, as parts of one text."""
        joined, alone = [], []
        for u in units:
            (joined if self.cuts and (33 <= u[-1] <= 126 or len(u) > 2 and 0xC3 <= u[-2] <= 0xDF) and b"\xe2\x96\x81" not in u else alone).append(u)
        for k in range(0, len(joined), JOINED):
            some = joined[k : k + JOINED]
            text = b"".join(some)
            ids = [np.array(x, self.kind) for x in self.both(text.decode())]
            bounds, parts = np.cumsum([len(u) for u in some]), []
            for x, size, names in zip(ids, (self.a_size, self.b_size), (self.a_bytes, self.b_bytes)):
                ends = np.cumsum(size[x])
                at = np.searchsorted(ends, bounds)
                if not len(ends) or ends[-1] != bounds[-1] or (ends[at] != bounds).any() or b"".join([names[i] for i in x.tolist()]) != text:
                    break
                raw, edge = x.tobytes(), [0, *((at + 1) * self.kind.itemsize).tolist()]
                parts.append([raw[s:e] for s, e in zip(edge, edge[1:])])
            if len(parts) == 2:
                self.seen.update(zip(some, zip(*parts)))
            else:
                alone += some
        for u in alone:
            self.seen[u] = self.checked(u)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in the first vocabulary, their number by row, and the same of the second. Rows that differ have none."""
        texts = utf8(texts)
        full = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise(pa.scalar(b" ", texts.type), texts, pa.scalar(b"", texts.type)), texts)
        data, offsets = flat(full)
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(rows, np.int64), np.zeros(0, self.kind), np.zeros(rows, np.int64)
        start = np.zeros(len(data) + 1, bool)
        if self.cuts:
            plain = (data >= 33) & (data <= 126)
            plain[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
            start[1:-1] = (data[1:] == 32) & plain[:-1]
        start[offsets] = True
        at = np.flatnonzero(start)
        owner = np.searchsorted(offsets, at[:-1], "right") - 1
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        names, of = units.dictionary.to_pylist(), units.indices.to_numpy().astype(np.int64)
        new = [u for u in names if u not in self.seen]
        if len(self.seen) + len(new) > KEPT:
            self.seen, new = {}, names
        self.learn(new)
        found = [self.seen[u] for u in names]
        good = np.fromiter((f is not None for f in found), bool, len(found))
        row_good = np.ones(rows, bool)
        row_good[owner[~good[of]]] = False
        of, owner = of[row_good[owner]], owner[row_good[owner]]
        out = []
        for side in (0, 1):
            each = [f[side] if f else b"" for f in found]
            sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.kind.itemsize
            begins = np.cumsum(sizes) - sizes
            out += [gathered(np.frombuffer(b"".join(each), self.kind), begins[of], sizes[of]), np.bincount(owner, sizes[of], rows).astype(np.int64)]
        return tuple(out)

    def groups(self, a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Linked ids (pairs, row after row), their number by row, and the checksum of each row's groups."""
        rows = len(na)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if not len(a):
            return np.zeros((0, 2), self.kind), np.zeros(rows, np.int64), [""] * rows
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        links = np.stack([a[last_a], b[last_b]], 1)
        n = np.bincount(np.repeat(np.arange(rows), na)[last_a], minlength=rows)
        close_a, close_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1  # tokens up to the end of each group
        in_a, in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a = np.arange(len(a)) + np.append(0, close_b)[in_a]
        at_b = np.arange(len(b)) + close_a[in_b]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
        text = self.digits[ids]
        text[:, -1] = mark
        width = self.places[ids] + 1
        raw = text[np.arange(text.shape[1])[None] >= text.shape[1] - width[:, None]].tobytes()
        edge = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(na + nb))].tolist()
        return links, n, [hashlib.sha256(memoryview(raw)[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(edge, edge[1:])]


def aligner(bytes_path: str, pieces_path: str) -> Aligner:
    """The worker's aligner of two vocabularies."""
    if (bytes_path, pieces_path) not in _aligners:
        _aligners[bytes_path, pieces_path] = Aligner(bytes_path, pieces_path)
    return _aligners[bytes_path, pieces_path]


def keys_of(blob: np.ndarray) -> np.ndarray:
    """Packed keys of linked ids (pairs one after another)."""
    pair = blob.reshape(-1, 2).astype(np.int64)
    return (pair[:, 0] << 32) | pair[:, 1]


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, links, groups_sha256) by row, and rows that hold a task's counts: (keys, counts)."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256", "keys", "counts"]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(bytes_path, pieces_path)
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def sums() -> pa.RecordBatch:
            none = [pa.nulls(1, k) for k in (*[pa.int64()] * 4, pa.binary(), pa.string())]
            return pa.record_batch([*none, pa.array([keys.astype("<i8").tobytes()]), pa.array([counts.astype("<i8").tobytes()])], names)

        for batch in pieces(batches, "text"):
            a, na, b, nb = both.encode(batch.column("text"))
            links, n, marks = both.groups(a, na, b, nb)
            own, times = np.unique(keys_of(links), return_counts=True)
            keys, counts = added(np.append(keys, own), np.append(counts, times))
            offsets = np.append(0, np.cumsum(n * 2 * links.itemsize)).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(links))])
            yield pa.record_batch([batch.column("doc_id"), pa.array(na), pa.array(nb), pa.array(n), blob, pa.array(marks, pa.string()), *[pa.nulls(len(n), pa.binary())] * 2], names)
            if len(keys) > PARTIAL:
                yield sums()
                keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield sums()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, links binary, groups_sha256 string, keys binary, counts binary")


def count_shards(partial: DataFrame, folder: str) -> DataFrame:
    """(first, path) of the shards written from ``partial(keys, counts)``, and (b, most): each shard's highest counts."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.record_batch([pa.array(np.frombuffer(batch.column(c)[k].as_buffer(), "<i8")) for c in ("keys", "counts")], ["key", "n"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [added(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        keys, counts = added(*(np.concatenate(x) for x in zip(*held)))
        path = f"{folder}/counts-{uuid.uuid4().hex}"  # a task that runs again writes another file; only what it returns is read
        _put(path, keys.astype("<i8").tobytes() + counts.astype("<i8").tobytes())
        second = keys & 0xFFFFFFFF
        order = np.argsort(second, kind="stable")
        b, first = np.unique(second[order], return_index=True)
        most = np.maximum.reduceat(counts[order], first)
        head = pa.nulls(len(b), pa.int64())
        yield pa.record_batch([pa.array([int(keys[0])], pa.int64()), pa.array([path]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], ["first", "path", "b", "most"])
        yield pa.record_batch([head, pa.nulls(len(b), pa.string()), pa.array(b), pa.array(most)], ["first", "path", "b", "most"])

    parts = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = partial.mapInArrow(single, "key long, n long").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(write, "first long, path string, b long, most long")


class Shards:
    """Sorted shards mapped into memory; files that Spark brought to the executor are known by their bare names."""

    def __init__(self, first: np.ndarray, paths: list[str]):
        self.first, self.paths, self.open = first, paths, {}

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted keys, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        part = np.searchsorted(self.first, keys, "right") - 1
        for p in np.unique(part).tolist():
            if p not in self.open:
                path = self.paths[p]
                self.open[p] = np.memmap(path if os.path.isabs(path) else SparkFiles.get(path), "<i8", "r").reshape(2, -1)
            a, b = np.searchsorted(part, [p, p + 1])
            table = self.open[p]
            out[a:b] = table[1][np.searchsorted(table[0], keys[a:b])]
        return out


def reachable(spark: SparkSession, path: str, ship: bool) -> str:
    """Where an executor finds the file: the path itself in a shared local folder, else the name of a copy that Spark brings."""
    local = path.removeprefix("file:")
    if not ship and "://" not in local.lstrip("/") and local.startswith("/"):
        return "/" + local.lstrip("/")
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def cross_alignment(docs: DataFrame, bytes_path: str, pieces_path: str, ship: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    rows = written(aligned(docs, bytes_path, pieces_path), "aligned")
    shards = written(count_shards(rows.where("keys is not null").select("keys", "counts"), new_folder(spark, "pair-counts")), "shards")
    listed = sorted((r.first_, r.path) for r in shards.where("path is not null").select(F.col("first").alias("first_"), "path").collect())  # a row for each partition
    most = shards.where("b is not null").groupBy("b").agg(F.max("most").alias("most")).toArrow()  # a row for each piece that is used
    best = np.zeros(int(np.max(most.column("b").to_numpy(), initial=0)) + 1, np.int64)
    best[most.column("b").to_numpy()] = most.column("most").to_numpy()
    shared = spark.sparkContext.broadcast((np.array([f for f, _ in listed], np.int64), [reachable(spark, p, ship) for _, p in listed], best))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, paths, best = shared.value
        table, kind = Shards(first, paths), aligner(bytes_path, pieces_path).kind
        for batch in pieces(batches, "links", 4 << 20):
            data, offsets = flat(batch.column("links"))
            keys = keys_of(np.frombuffer(data.tobytes(), kind))
            own, of = np.unique(keys, return_inverse=True)
            count = table.count(own)
            top = (count == best[own & 0xFFFFFFFF])[of]
            sums = lambda x: np.diff(np.append(0, np.cumsum(x))[offsets // (2 * kind.itemsize)])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), batch.column("n_groups"), pa.array(sums(top)), pa.array(sums(count[of])), batch.column("groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    documents = rows.where("links is not null").select("doc_id", "n_a", "n_b", "n_groups", "links", "groups_sha256")
    return documents.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cross_alignment(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
