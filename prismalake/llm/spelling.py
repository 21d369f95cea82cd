"""Spelling variants: words at one edit, found with forward and backward minimal acyclic automata.

The words of the texts are counted by batches of tasks and then by Spark. The vocabulary is sorted twice, by length and
word and by length and reversed word (range partitions), and cut into shards of at most ``SHARD`` words of one length. Each
shard becomes a minimal acyclic automaton whose transitions carry the number of words before them, so that a path
gives a word's number in the shard (perfect hash). A word is cut in two halves. In shards of forward automata its first
half is followed exactly and the rest is completed with one error; in those of backward automata the same is done with
the reversed word, whose second half is then exact. One of these finds every word at one edit; what both find is taken from the
forward search only. Shards meet where they share the first two code points, lengths differ by one at most
and the halves' intervals overlap, so each row of work is two shards of bounded size, however many words begin alike.

A word's form is its near word of largest count, where that is at least ``ratio`` times its own (ties: the smallest);
counts grow along forms, so the last of a chain is found by pointer doubling.

Defined results: null and empty texts hold no words; repeated rows count each; a null id counts as the empty text before
the colon; an empty vocabulary gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, lower_ascii, pieces, utf8, written
from .tokens import gathered

SHARD, LEAST_LENGTH, LEAST_COUNT, RATIO, SPOILT = 16_384, 5, 3, 2, 97
HELD = 1 << 18  # distinct words whose counts a task adds up before it sends them


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of UTF-8 rows."""
    low = data | 0x20
    inside = (low >= 97) & (low <= 122)
    lead = data == 0xC3  # U+00C0 to U+00FF are C3 80 to C3 BF
    inside |= lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _step(x: np.ndarray) -> np.ndarray:
    """One byte of zeros through the register of the checksum, bit by bit."""
    for _ in range(8):
        x = np.where(x & 1, (x >> np.uint32(1)) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


class Checksums:
    """crc32 of a prefix and a word from the two checksums: shifting one by a number of bytes is linear in its bits."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        self.tables = [np.stack([byte << np.uint32(8 * k) for k in range(4)])]  # by length: what each byte becomes

    def joined(self, heads: list[bytes], row: np.ndarray, words: list[bytes], of: np.ndarray) -> np.ndarray:
        """For each occurrence the checksum of ``heads[row]`` and ``words[of]`` one after another."""
        before, own = (np.array([zlib.crc32(x) for x in side], np.uint32) for side in (heads, words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        while len(self.tables) <= min(int(length.max(initial=0)), 63):
            self.tables.append(_step(self.tables[-1]))
        stack, at, before = np.stack(self.tables), np.minimum(length[of], 63), before[row]
        out = own[of]
        for k in range(4):
            out ^= stack[at, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(length[of] > 63).tolist():  # long runs are rare
            out[i] = zlib.crc32(heads[row[i]] + words[of[i]])
        return out


def spoilt(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, in Latin-1 bytes; words of fewer than ``LEAST_LENGTH`` code points are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = Checksums(), [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]).combine_chunks()

        for batch in pieces(batches, "text", 4 << 20):
            data, offsets = flat(utf8(batch.column("text")))
            starts, ends, row = runs(data, offsets)
            if not len(starts):
                continue
            raw = lower_ascii(gathered(data, starts, ends - starts))
            bounds = np.append(0, np.cumsum(ends - starts))
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
            names, of = words.dictionary.to_pylist(), words.indices.to_numpy().astype(np.int64)
            heads = [b"%s:" % (b"" if i is None else str(i).encode()) for i in batch.column("doc_id").to_pylist()]
            h = sums.joined(heads, row, names, of)
            bad = h % np.uint32(SPOILT) == 0
            n = np.bincount(of[~bad], minlength=len(names))
            latin = [w.decode() for w in names]
            some = np.flatnonzero(bad)
            changed = [spoilt(latin[k], x) for k, x in zip(of[some].tolist(), h[some].tolist())]
            word = [x.encode("latin-1") for x in [*latin, *changed]]
            table = pa.table({"word": pa.array(word, pa.binary()), "n": np.append(n, np.ones(len(changed), np.int64))})
            table = table.filter(pc.and_(pc.greater(table.column("n"), 0), pc.greater_equal(pc.binary_length(table.column("word")), LEAST_LENGTH)))
            held.append(table)
            size += table.num_rows
            if size > HELD:
                held = [added()]
                size = held[0].num_rows
                if size > HELD // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
        if held:
            yield from added().to_batches()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """A minimal acyclic automaton of sorted words of one length (rows of ``words``), with word numbers.

    ``go[s, c]`` is the state after state s and letter number c (-1: none), ``skip[s, c]`` how many of the words that
    pass s come before those that take c. State 0 is the start; the last state, the only final one, ends every word."""

    def __init__(self, words: np.ndarray):
        n, length = words.shape
        self.length, self.letters = length, np.unique(words)
        number = np.full(256, -1, np.int64)
        number[self.letters] = np.arange(len(self.letters))
        self.number = number
        coded = number[words]
        apart = np.append(-1, (words[1:] != words[:-1]).argmax(1))  # letters that a word shares with the one before it
        below, levels = np.zeros(n, np.int64), []
        for at in range(length - 1, -1, -1):  # of the prefixes of ``at`` letters, those with equal transitions are one state
            rows = np.flatnonzero(apart <= at)
            owner = np.cumsum(apart[rows] < at) - 1
            table = np.full((owner[-1] + 1, len(self.letters)), -1, np.int64)
            table[owner, coded[rows, at]] = below
            states, below = np.unique(table, axis=0, return_inverse=True)
            below = below.ravel()
            levels.append(states)
        self._number(levels[::-1])

    def _number(self, levels: list[np.ndarray]) -> None:
        base = np.append(0, np.cumsum([len(states) for states in levels]))
        self.go = np.full((base[-1] + 1, len(self.letters)), -1, np.int32)
        self.skip = np.zeros_like(self.go)
        words = np.zeros(base[-1] + 1, np.int64)
        words[-1] = 1
        for depth in range(len(levels) - 1, -1, -1):
            go = np.where(levels[depth] >= 0, levels[depth] + base[depth + 1], -1)
            count = np.where(go >= 0, words[go], 0)
            at = slice(base[depth], base[depth + 1])
            self.go[at], self.skip[at], words[at] = go, np.cumsum(count, 1) - count, count.sum(1)

    def follow(self, state: np.ndarray, number: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states and word numbers after one letter each; dead states stay dead."""
        c = self.number[letter]
        ok = (state >= 0) & (c >= 0)
        s, c = np.where(ok, state, 0), np.where(ok, c, 0)
        return np.where(ok, self.go[s, c], -1), number + np.where(ok, self.skip[s, c], 0)

    def within_one(self, words: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, number of a word of the automaton) at exactly one edit, ``half`` letters being equal."""
        n, length = words.shape
        change = self.length - length  # -1: a letter of the query is left out, 0: replaced, 1: one is put in
        if abs(change) > 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, state, number = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def complete(row: np.ndarray, state: np.ndarray, number: np.ndarray, at: int) -> None:
            while at < length and len(row):
                state, number = self.follow(state, number, words[row, at])
                live = state >= 0
                row, state, number, at = row[live], state[live], number[live], at + 1
            found.append((row, number))

        for at in range(length + 1):
            if not len(row):
                break
            if at >= half:
                if change == -1 and at < length:  # of equal letters side by side the last one is left out
                    last = np.flatnonzero(words[row, at] != words[row, at + 1]) if at + 1 < length else slice(None)
                    complete(row[last], state[last], number[last], at + 1)
                elif change >= 0 and at < length + change:
                    i, c = np.nonzero(self.go[state] >= 0)
                    if at < length:  # a letter beside an equal one is put in behind it
                        other = self.letters[c] != words[row[i], at]
                        i, c = i[other], c[other]
                    complete(row[i], self.go[state[i], c].astype(np.int64), number[i] + self.skip[state[i], c], at + 1 - change)
            if at < length:
                state, number = self.follow(state, number, words[row, at])
                live = state >= 0
                row, state, number = row[live], state[live], number[live]
        row, number = (np.concatenate(z) for z in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return row, number


def shards(vocabulary: DataFrame, backward: bool) -> DataFrame:
    """(shard, length, words, ns, low, high, heads) of sorted words (reversed ones where ``backward``) of one length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            words = table.column("key").to_pylist()
            half = (len(words[0]) + 1) // 2 if backward else len(words[0]) // 2
            heads = sorted({w[:2] for w in words})
            one = [pa.array([x], k) for x, k in ((len(words[0]), pa.int32()), (b"".join(words), pa.binary()), (table.column("n").to_numpy().astype("<i8").tobytes(), pa.binary()), (words[0], pa.binary()), (words[-1], pa.binary()), (half, pa.int32()), (heads, pa.list_(pa.binary())))]
            return pa.record_batch(one, ["length", "words", "ns", "low", "high", "half", "heads"])

        def parts(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            size = pc.binary_length(table.column("key")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), table.num_rows]
            for a, b in zip(edges, edges[1:]):
                for i in range(a, b, SHARD):
                    n = min(SHARD, b - i)
                    if last or b < table.num_rows or n == SHARD:
                        yield out(table.slice(i, n))
                    else:
                        held.append(table.slice(i, n))

        for batch in batches:
            if batch.num_rows:
                table = pa.concat_tables([*held, pa.Table.from_batches([batch])])
                held = []
                yield from parts(table, False)
        if held:
            table, held = pa.concat_tables(held), []
            yield from parts(table, True)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("word")
            if backward:
                key = pa.array([w[::-1] for w in key.to_pylist()], pa.binary())
            yield pa.record_batch([key, batch.column("n")], ["key", "n"])

    parts_ = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = vocabulary.select("word", "n").mapInArrow(keyed, "key binary, n long").withColumn("size", F.length("key"))
    rows = rows.repartitionByRange(parts_, "size", "key").sortWithinPartitions("size", "key").select("key", "n")
    found = rows.mapInArrow(cut, "length int, words binary, ns binary, low binary, high binary, half int, heads array<binary>")
    return found.withColumn("shard", F.monotonically_increasing_id())


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, n): sums over shards of a word's near words: their number and the one of largest count."""
    both = []
    for backward in (False, True):
        own = written(shards(vocabulary, backward), "shards")
        ends = own.select("shard", "length", "half", "low", "high", F.explode("heads").alias("head"))
        one = ends.select(F.col("shard").alias("query"), F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("length"), "half", "head", F.col("low").alias("low1"), F.col("high").alias("high1"))
        cut = lambda c: F.expr(f"substring({c}, 1, half)")
        pairs = one.join(ends.drop("half"), ["length", "head"]).where((cut("high") >= cut("low1")) & (cut("low") <= cut("high1"))).select("query", "shard").distinct()
        left = own.select(F.col("shard").alias("query"), "half", F.col("length").alias("length1"), F.col("words").alias("words1"))

        def link(batches: Iterator[pa.RecordBatch], backward: bool = backward) -> Iterator[pa.RecordBatch]:
            last: tuple = (None, None)
            for batch in batches:
                for k in range(batch.num_rows):
                    get = lambda c: batch.column(c)[k].as_py()
                    bytes_ = lambda c, size: np.frombuffer(get(c), np.uint8).reshape(-1, size)
                    words, other, ns, half = bytes_("words1", get("length1")), bytes_("words", get("length")), np.frombuffer(get("ns"), "<i8"), get("half")
                    if last[0] != get("shard"):
                        last = (get("shard"), Automaton(other))
                    i, j = last[1].within_one(words, half)
                    if backward:  # the forward search finds those whose first half is equal
                        front = words.shape[1] - half
                        again = (words[i][:, half:] == other[j][:, other.shape[1] - front :]).all(1)
                        i, j = i[~again], j[~again]
                    if not len(i):
                        continue
                    turn = slice(None, None, -1) if backward else slice(None)
                    near = [w.tobytes() for w in other[j][:, turn]]
                    rank = np.unique(np.array(near, f"S{other.shape[1]}"), return_inverse=True)[1]
                    order = np.lexsort((rank, -ns[j], i))
                    i, j = i[order], j[order]
                    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                    count = np.diff(np.append(first, len(i)))
                    names = [words[x, turn].tobytes() for x in i[first]]
                    yield pa.record_batch([pa.array(names, pa.binary()), pa.array(count), pa.array([near[x] for x in order[first]], pa.binary()), pa.array(ns[j[first]])], ["word", "n_near", "near", "near_n"])

        met = pairs.join(left, "query").join(own.select("shard", "length", "words", "ns"), "shard").select("shard", "length", "words", "ns", "length1", "words1", "half")
        both.append(met.mapInArrow(link, "word binary, n_near long, near binary, near_n long"))
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best")
    return both[0].unionByName(both[1]).groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.near", "best.near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: pointers to the next form are doubled until none moves."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        new = written(new, "roots")
        state = new.select("word", "root")
        if new.where("moved").isEmpty():
            return state


def spelling_forms(docs: DataFrame, ratio: int = RATIO, least: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs(doc_id, text)``."""
    vocabulary = written(counted(docs).where(F.col("n") >= least), "vocabulary")
    near = near_pairs(vocabulary)
    found = F.col("near_n") >= ratio * F.col("n")
    words = vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("near")).alias("form"), F.when(found, F.col("near_n")).alias("form_n"))
    words = written(words, "forms")
    root = roots(words.where("form is not null"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1").alias(c)
    return words.join(root, "word", "left").withColumn("root", F.coalesce("root", "word")).select(text("word"), text("form"), text("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet"))
