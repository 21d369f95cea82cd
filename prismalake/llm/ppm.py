"""Language-model scoring by prediction by partial matching, pretrained on the training texts.

The text is read as running bytes: words, lower-cased, each followed by a blank, then an end symbol. A byte is predicted
in the context of the ``ORDERS`` bytes before it, which run across word boundaries; blanks stand before a text's start. A
trie holds the counts of symbols by context, from every training position and in contexts of all orders. A symbol new to
a context costs an escape (method C) and is sought in the next shorter one, with the symbols of the longer context
excluded, down to equal chances for symbols never seen. The probabilities of all symbols that may follow a context sum to
one. The score is the code length of the document, summed.

Tasks add up equal strings of ``ORDERS + 1`` symbols before the shuffle, and Spark adds up the corpus; what is shuffled
grows with it. The trie's counts are broadcast: a trie of more than ``max_trie`` counts is dealt into shares by the last
two bytes of the context, and a symbol is coded by the share that has its contexts, one share at a time: orders and
scores are the same at every size. Documents are coded in pieces of about ``PIECE`` bytes, equal strings of a piece once.
For the base score, tokens are counted over the corpus and joined back to the blocks of documents that hold them.

Defined results: null text is the empty text (its only token is the end); without training documents the counts are 0,
the base score takes its formula with N = 0 and the model knows no context; repeated rows are scored each; a null id
counts as the empty text in the share; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_share, flat, lower_ascii, pieces, utf8, word_bounds, written

ORDERS, BLOCK, PIECE, END, SYMBOLS = 5, 16 << 20, 3 << 20, 256, 257
FIRST = [0, *np.cumsum([1 << (8 * k) for k in range(ORDERS)]).tolist()]  # where the contexts of each order begin


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows, lower-cased, then an empty one for each row's end, and the row of each."""
    data, offsets = flat(utf8(texts))
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offsets)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    n = len(offsets) - 1
    edges = np.append(0, np.cumsum(np.concatenate([ends - starts, np.zeros(n, np.int64)]))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts) + n, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(low[solid]))])
    return words, np.concatenate([np.repeat(np.arange(n), np.diff(first)), np.arange(n)])


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol of the rows its context of ORDERS bytes (the nearest first) and itself, as one number, and its row."""
    data, offsets = flat(utf8(texts))
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offsets)
    n = len(offsets) - 1
    words = np.diff(first)
    sizes = ends - starts + 1  # each with a blank
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    running = np.insert(low[solid], np.cumsum(sizes - 1), np.uint8(32)).astype(np.int64)
    total = np.append(0, np.cumsum(sizes))
    length = total[first[1:]] - total[first[:-1]]
    symbols = np.insert(running, np.cumsum(length), END)
    length = length + 1
    row = np.repeat(np.arange(n, dtype=np.int32), length)
    place = np.arange(len(symbols)) - np.repeat(np.cumsum(length) - length, length)
    code = np.zeros(len(symbols), np.int64)
    for k in range(1, ORDERS + 1):
        back = np.roll(symbols, k)
        back[place < k] = 32
        code = code * 256 + back
    return code * 512 + symbols, row


def contexts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and contexts by order of what ``grams`` gives."""
    code = keys >> 9
    return keys & 511, np.stack([FIRST[k] + (code >> (8 * (ORDERS - k))) for k in range(ORDERS + 1)])


def rows_at_most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", PIECE):
        for i in range(0, batch.num_rows, 8192):
            yield batch.slice(i, 8192)


def blocks(docs: DataFrame, tries: list) -> DataFrame:
    """Of ``docs(doc_id, held_out, text)``: rows (block, word, at, n) of tokens, ``n`` in training texts, and, with a null
    word, (block, table), which has the model's scores. ``tries``: broadcasts of the shares of the trie."""

    def cost(texts: pa.Array) -> np.ndarray:
        keys, row = grams(texts)
        keys, at = np.unique(keys, return_inverse=True)
        symbols, ctx = contexts(keys)
        each = np.zeros(len(keys))
        for shared in tries:
            each += shared.value.coded(symbols, ctx)
            if len(tries) > 1:
                shared.__dict__.pop("_value", None)  # one share at a time is held
        return np.bincount(row, each[at], len(texts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        names = ["block", "word", "at", "n", "table"]
        for batch in pieces(batches, "text", BLOCK):
            block = (part << 33) + count
            count += 1
            score = np.concatenate([cost(b.column("text")) for b in rows_at_most(iter([batch]))])
            words, rows = _words(batch.column("text"))
            coded = words.dictionary_encode()
            at, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            learn = ~batch.column("held_out").to_numpy(zero_copy_only=False)[rows]
            n = np.bincount(at[learn], minlength=size)
            key, times = np.unique((rows << 32) + at, return_counts=True)
            rows, at = key >> 32, key & 0xFFFFFFFF
            edges = pa.array(np.append(0, np.cumsum(np.bincount(rows, minlength=batch.num_rows))).astype(np.int32))
            table = pa.record_batch([
                batch.column("doc_id"), batch.column("held_out"), pa.array(score),
                pa.ListArray.from_arrays(edges, pa.array(np.diff(at, prepend=0).astype(np.int32))),
                pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
            ], ["doc_id", "held_out", "score", "step", "times"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(table)
            yield pa.record_batch([pa.array([block]), pa.array([None], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names)
            for i in range(0, size, 50_000):
                some = coded.dictionary.slice(i, 50_000).cast(pa.binary())
                m = len(some)
                yield pa.record_batch([pa.array(np.full(m, block)), some, pa.array(np.arange(i, i + m, dtype=np.int32)), pa.array(n[i : i + m].astype(np.int64)), pa.nulls(m, pa.binary())], names)

    return docs.mapInArrow(cut, "block long, word binary, at int, n long, table binary")


class Trie:
    """Counts of symbols by context, sorted by ``context * SYMBOLS + symbol``.

    ``share``: of contexts of two bytes and more, only those of this share of ``shares`` are there."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, orders: int, share: int = 0, shares: int = 1):
        self.orders, self.share, self.shares = orders, share, shares
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order].astype(np.int64)
        of = self.keys // SYMBOLS
        self.nodes, first = np.unique(of, return_index=True)
        edges = np.append(first, len(of))
        self.total = np.add.reduceat(self.counts, first) if len(of) else np.zeros(0, np.int64)
        self.distinct = np.diff(edges)
        # How much of the next shorter context the symbols of a context make up.
        order_of = np.searchsorted(FIRST, self.nodes, "right") - 1
        code = self.nodes - np.array(FIRST)[order_of]
        parent = np.where(order_of > 0, np.array([0, *FIRST[:-1]])[order_of] + (code >> 8), 0)
        at = np.repeat(parent, self.distinct) * SYMBOLS + self.keys % SYMBOLS
        inside = self.count(at)
        self.covered = np.add.reduceat(inside, first) if len(of) else np.zeros(0, np.int64)

    def count(self, keys: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.counts[i], 0) if len(self.keys) else np.zeros(len(keys), np.int64)

    def coded(self, symbols: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each symbol in its contexts; of a share: 0 for those of others."""
        cost = np.zeros(len(symbols))
        open_ = np.arange(len(symbols))
        if self.shares > 1:
            open_ = np.flatnonzero(((ctx[2] - FIRST[2]) * 40503 >> 3) % self.shares == self.share)
        excluded = np.full(len(open_), -1)
        for k in range(self.orders, -1, -1):
            node = ctx[k, open_]
            i = np.minimum(np.searchsorted(self.nodes, node), max(len(self.nodes) - 1, 0))
            known = (self.nodes[i] == node) if len(self.nodes) else np.zeros(len(node), bool)
            n, d = np.zeros(len(node)), np.zeros(len(node))
            n[known], d[known] = self.total[i[known]], self.distinct[i[known]]
            out = (excluded >= 0) & known
            n[out] -= self.covered[excluded[out]]
            d[out] -= self.distinct[excluded[out]]
            c = np.zeros(len(node))
            c[known] = self.count(node[known] * SYMBOLS + symbols[open_[known]])
            use = n > 0
            got = use & (c > 0)
            cost[open_[got]] += np.log(c[got] / (n[got] + d[got]))
            escape = use & ~got
            cost[open_[escape]] += np.log(d[escape] / (n[escape] + d[escape]))
            excluded = np.where(known, i, excluded)[~got]
            open_ = open_[~got]
        seen = int(self.distinct[0]) if len(self.nodes) and self.nodes[0] == 0 else 0
        cost[open_] -= np.log(max(SYMBOLS - seen, 1))
        return cost


def train(docs: DataFrame, max_trie: int = 1 << 24) -> Iterator[Trie]:
    """The trie of the texts of ``docs``, in shares of about ``max_trie`` counts."""

    def summed(parts: Iterator[np.ndarray], given: Iterator[np.ndarray | None]) -> pa.RecordBatch:
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for part, n in zip(parts, given):
            part, own = np.unique(part, return_counts=True) if n is None else (part, n)
            keys, at = np.unique(np.concatenate([keys, part]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, own]), len(keys)).astype(np.int64)
        return pa.record_batch([pa.array(keys), pa.array(sums)], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield summed((grams(b.column("text"))[0] for b in rows_at_most(batches)), repeat(None))

    def by_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, ctx = contexts(batch.column("key").to_numpy())
            yield summed(iter([(ctx * SYMBOLS + symbols).ravel()]), iter([np.tile(batch.column("n").to_numpy(), len(ctx))]))

    whole = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    table = written(whole.mapInArrow(by_order, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "trie")
    shares = max(1, -(-table.count() // max_trie))
    context = f"(key div {SYMBOLS})"
    two = "case " + " ".join(f"when {context} >= {FIRST[k]} then shiftright({context} - {FIRST[k]}, {8 * (k - 2)})" for k in range(ORDERS, 1, -1)) + " end"
    for share in range(shares):
        own = table if shares == 1 else table.where(f"{context} < {FIRST[2]} or shiftright(({two}) * 40503, 3) % {shares} = {share}")
        got = own.toArrow()
        yield Trie(got.column("key").to_numpy(), got.column("n").to_numpy(), ORDERS, share, shares)


def score(docs: DataFrame, max_trie: int = 1 << 24) -> DataFrame:
    """Scores of ``docs(doc_id, text, held_out)``; the model learns from the rows that are not held out.

    ``max_trie``: counts of the trie that a task holds; the scores do not depend on it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("held_out").cast("boolean").alias("held_out"), F.col("text").cast("string").alias("text"))
    tries = []
    for trie in train(rows.where("not held_out"), max_trie):
        tries.append(spark.sparkContext.broadcast(trie))
        tries[-1].__dict__.pop("_value", None)  # the driver holds one share at a time, too
    found = written(blocks(rows, tries), "blocks")
    tokens = found.where("word is not null")
    words = written(tokens.groupBy("word").agg(F.sum("n").alias("c")), "words")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    known = tokens.select("block", "word", "at").join(words, "word").select(F.col("block").alias("of"), "at", "c")

    def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("at").to_numpy()
        c = np.zeros(right.num_rows, np.int64)
        c[place] = right.column("c").to_numpy()
        base = np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))
        out = []
        for blob in left.column("table").to_pylist():
            table = pa.ipc.open_stream(blob).read_all().combine_chunks()
            n_docs = table.num_rows
            step, times = table.column("step").combine_chunks(), table.column("times").combine_chunks()
            doc = np.repeat(np.arange(n_docs), np.diff(step.offsets.to_numpy()))
            at, k = np.cumsum(step.flatten().to_numpy().astype(np.int64)), times.flatten().to_numpy().astype(np.int64)
            out.append(pa.table({
                "doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
                "n_tokens": np.bincount(doc, k, n_docs).astype(np.int64), "n_known": np.bincount(doc, k * (c[at] > 0), n_docs).astype(np.int64),
                "train_tokens": np.full(n_docs, total), "base_score": np.bincount(doc, k * base[at], n_docs), "score": pc.divide(table.column("score"), float(np.log(10))),
            }))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    tables = found.where("word is null").select("block", "table")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return tables.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(judge, schema)


def op6_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs.select("doc_id", "text", (crc_share("doc_id", 5) == 1).alias("held_out")))
