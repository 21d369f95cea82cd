"""Removal of repeated passages: every byte covered by a string of ``length`` bytes that also starts elsewhere.

Suffixes are sorted only where a repeat can be. A window of ``length`` bytes always holds an *anchor*: its ``GRAM``-byte
string with the smallest hash. Equal windows have equal anchors in equal places, so two occurrences meet under the hash
of their anchor. Around an anchor at ``a`` the bytes ``[a - reach, a + length)``, ``reach = length - GRAM``, hold all
windows with that anchor. Anchors whose surroundings occur as a whole more than once are covered by all of them; they
are only counted. For anchors in different surroundings, the suffixes to the right of the anchor and the reversed
prefixes to its left are sorted (deep-shallow: a multikey quicksort with eight-byte characters to a shallow depth, then
a blind trie for each group that still agrees). A window that begins ``l`` bytes before the anchor is repeated if
another suffix agrees for ``reach - l`` bytes to the right and for ``l`` bytes to the left, which the two orders and
their common prefixes tell for all anchors at once.

The same machinery takes words as its units: every word is one 64-bit hash (blanks between words do not count), windows
are of so many words, and an anchor is a string of ``WORD_GRAM`` words. Spans are then word numbers.

Hot anchors: counts are added up before the shuffle and joins on them may be split by Spark. An anchor in more than
``hot`` different surroundings is not sorted in one task: its windows are counted as rows.

Memory: a task holds one piece of texts (2 MB or one longer text) or the surroundings of ``held`` anchors.

Defined results: null text is empty; texts shorter than ``length`` lose nothing; repeated rows are repeats of one
another; a null id is an id of its own; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Powers, flat, free_name, mix64, pieces, scratch, spread, utf8, word_bounds, written

GRAM, SHALLOW, HOT, HELD = 128, 4, 20_000, 30_000
PASSAGE, WORD_GRAM = 51, 16  # words of the shortest passage that the pipeline's stage takes out, and of an anchor's string
_symbols = spread(11)
_powers = Powers(0xD1342543DE82EF95)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x)
    if n < width:
        return x[:0]
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def word_values(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and where each row's begin (and the end)."""
    data, offsets = flat(utf8(texts))
    starts, ends, first = word_bounds(data, offsets)
    up, down = _powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_symbols[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)), first


def anchors(values: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Positions of the anchors in ``values`` (one for each byte or word; rows at ``offsets``), their rows, and hashes of
    anchor and surroundings."""
    n = len(values)
    if n < length:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    up, down = _powers.to(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1]
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    bits = U64(int(n).bit_length())
    mark = (mix_low(h) >> bits << bits) | np.arange(len(h), dtype=U64)  # ties: the leftmost
    least = sliding_min(mark, length - gram + 1)
    inside = np.zeros(n + 1, np.int32)
    sizes = np.diff(offsets)
    long_rows = np.flatnonzero(sizes >= length)
    np.add.at(inside, offsets[long_rows], 1)
    np.add.at(inside, offsets[long_rows] + sizes[long_rows] - length + 1, -1)
    at = (least[np.cumsum(inside)[: len(least)] > 0] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    row = np.searchsorted(offsets, at, "right") - 1
    # Rows without units share an offset with the next one; the last of them is the row that has the unit.
    a = np.maximum(at - (length - gram), offsets[row])
    b = np.minimum(at + length, offsets[row + 1])
    key = mix64(h[at])
    around = mix64((sums[b] - sums[a]) * down[a] + mix64(((at - a) << 32 | (b - at)).astype(U64)))
    return at, row, key, around


def mix_low(h: np.ndarray) -> np.ndarray:
    return h * U64(0x94D049BB133111EB)


def find_anchors(docs: DataFrame, length: int, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(key, around, doc_id, rid, pos) of ``docs(doc_id, rid, text)``; ``length``, ``gram`` and ``pos`` in words or bytes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            if words:
                values, offsets = word_values(batch.column("text"))
            else:
                data, offsets = flat(utf8(batch.column("text")))
                values = _symbols[data]
            at, row, key, around = anchors(values, offsets, length, gram)
            take = pa.array(row)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), batch.column("doc_id").take(take), batch.column("rid").take(take), pa.array((at - offsets[row]).astype(np.int64))], ["key", "around", "doc_id", "rid", "pos"])

    return docs.mapInArrow(find, "key long, around long, doc_id long, rid long, pos long")


def _multikey(words: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the rows of ``words`` within their groups, all groups side by side, to ``shallow`` words.

    Returns the order and, for each place in it, the number of the group of rows that still agree.
    """
    order = np.argsort(group, kind="stable")
    begin = np.append(True, group[order][1:] != group[order][:-1])
    part = np.cumsum(begin) - 1  # current group of each place
    depth = np.zeros(len(order), np.int64)  # words on which the rows of the group at this place agree
    while True:
        size = np.bincount(part)
        open_ = np.flatnonzero((size[part] > 1) & (depth < shallow))
        if not len(open_):
            return order, part
        of, rows = part[open_], order[open_]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        count = np.diff(np.append(first, len(of)))
        c = words[rows, depth[open_]]
        pivot = np.repeat(c[first + count // 2], count)
        side = np.where(c < pivot, 0, np.where(c == pivot, 1, 2))
        by = np.argsort(of * 3 + side, kind="stable")
        order[open_] = rows[by]
        depth[open_] = (depth[open_] + (side == 1))[by]
        new = np.zeros(len(order), bool)
        new[open_] = np.append(False, (of * 3 + side)[by][1:] != (of * 3 + side)[by][:-1])
        begin |= new
        part = np.cumsum(begin) - 1


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix of two byte strings of one length."""
    if x == y:
        return len(x)
    low, high = 0, len(x)
    while high - low > 1:  # x[:low] == y[:low], x[:high] != y[:high]
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of strings of one length and the common prefix of each with the one before it (0 for the first).

    A blind trie holds only branching depths and characters: a string is led down by these, compared once with the
    leaf it comes to, and inserted where the two part. A leaf holds equal strings.
    """
    root: list = [[0]]  # a leaf is a list of numbers in a list; a node is (depth, {character: child})
    for i in range(1, len(strings)):
        s, node = strings[i], root[0]
        while isinstance(node, tuple):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        other = strings[node[0]]
        common = _common(s, other)
        if common == len(s):
            node.append(i)
            continue
        holder, where, node = root, 0, root[0]
        while isinstance(node, tuple) and node[0] < common:
            holder, where = node[1], s[node[0]]
            node = holder[where]
        if isinstance(node, tuple) and node[0] == common:
            node[1][s[common]] = [i]
        else:
            holder[where] = (common, {other[common]: node, s[common]: [i]})
    order: list[int] = []
    commons: list[int] = []
    stack: list = [(root[0], 0)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, tuple):
            kids = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in kids[:-1]] + [(kids[-1][1], common)]
        else:
            order += node
            commons += [common] + [len(strings[node[0]])] * (len(node) - 1)
    return order, commons


def deep_shallow(rows: np.ndarray, lengths: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte rows (padded with 0) within their groups and common prefixes with the row before (-1: new group)."""
    n, width = rows.shape
    words = np.ascontiguousarray(rows).view(">u8")
    order, part = _multikey(words, group, shallow)
    common = np.full(n, -1, np.int64)
    same = group[order][1:] == group[order][:-1]
    a, b = order[1:][same], order[:-1][same]
    differ = words[a, : shallow + 1] != words[b, : shallow + 1]
    word = np.argmax(differ, 1)
    x = (words[a, word] ^ words[b, word]).astype(U64)
    lead = np.zeros(len(a), np.int64)
    for k in range(7, 0, -1):  # equal leading bytes of the first unequal word
        lead[(x >> U64(8 * (8 - k))) == 0] = np.maximum(lead[(x >> U64(8 * (8 - k))) == 0], k)
    common[1:][same] = np.where(differ.any(1), 8 * word + lead, 0)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    count = np.diff(np.append(first, n))
    for f, c in zip(first[count > 1].tolist(), count[count > 1].tolist()):
        own = order[f : f + c]
        own = own[np.argsort(lengths[own], kind="stable")]
        by, commons = blind_trie([rows[i].tobytes() for i in own.tolist()])
        order[f : f + c] = own[by]
        common[f + 1 : f + c] = commons[1:]
    short = np.minimum(lengths[order][1:], lengths[order][:-1])
    common[1:] = np.minimum(common[1:], short)
    return order, common


def extents(left: np.ndarray, n_left: np.ndarray, right: np.ndarray, n_right: np.ndarray, group: np.ndarray, unit: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the fewest and most units (of ``unit`` bytes) before it at which a repeated window begins (-1: none)."""
    n, reach = left.shape[0], left.shape[1] // unit
    ro, rc = deep_shallow(right, n_right, group)
    lo, lc = deep_shallow(left, n_left, group)
    rc, lc = rc // unit, lc // unit
    fewest, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    of_right, of_left = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(reach + 1):
        of_right[ro] = np.cumsum(rc < reach - before)
        of_left[lo] = np.cumsum(lc < before)
        code = of_right * (n + 1) + of_left
        by = np.argsort(code)
        equal = code[by][1:] == code[by][:-1]
        hit = np.zeros(n, bool)
        hit[by[1:][equal]] = True
        hit[by[:-1][equal]] = True
        fewest[hit & (fewest < 0)] = before
        most[hit] = before
    return fewest, most


def _matrix(strings: list[bytes], reach: int, back: bool) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), -(-reach // 8) * 8), np.uint8)
    data = np.frombuffer(b"".join(strings), np.uint8)
    at = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(strings)), sizes)
    out[row, np.repeat(sizes, sizes) - 1 - at if back else at] = data
    return out, sizes


def _surroundings(docs: DataFrame, wanted: DataFrame, length: int, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(key, doc_id, rid, pos, left, right) for ``wanted(key, doc_id, rid, pos)``: bytes, or hashes of the words, before and
    after the anchors."""
    reach, unit = length - gram, 8 if words else 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "doc_id", "rid", "pos", "left", "right"]
        for batch in pieces(batches, "blob", 2 << 20):
            rows: list[tuple] = []
            for doc, rid, blob, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "blob", "at"))):
                text = unpacked(blob)
                text = word_values(pa.array([text], pa.binary()))[0].tobytes() if words else text
                rows += [(x["key"], doc, rid, x["pos"], text[unit * max(0, x["pos"] - reach) : unit * x["pos"]], text[unit * (x["pos"] + gram) : unit * (x["pos"] + length)]) for x in at]
            for i in range(0, len(rows), 10_000):
                some = list(zip(*rows[i : i + 10_000]))
                yield pa.record_batch([pa.array(x, k) for x, k in zip(some, [pa.int64()] * 4 + [pa.binary()] * 2)], names)

    at = wanted.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("key", "pos")).alias("at"))  # as many as a text has
    met = packed(docs).join(at, (F.col("d").eqNullSafe(F.col("doc_id"))) & (F.col("r") == F.col("rid"))).select("doc_id", "rid", "blob", "at")
    return met.mapInArrow(cut, "key long, doc_id long, rid long, pos long, left binary, right binary")


def packed(docs: DataFrame) -> DataFrame:
    """(d, r, blob): id, row hash and compressed bytes of the texts, so that joins move less."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array([coder.compress(x) for x in utf8(batch.column("text")).to_pylist()], pa.binary())], ["d", "r", "blob"])

    return docs.select("doc_id", "rid", "text").mapInArrow(pack, "d long, r long, blob binary")


def unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob) if blob else b""


def _sorted_spans(around: DataFrame, length: int, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """(doc_id, rid, start, stop) of repeated windows at anchors, by sorting; whole keys in a task."""
    reach = (length - gram) * unit

    def judge(rows: pa.Table) -> pa.RecordBatch:
        group = np.unique(rows.column("key").to_numpy(), return_inverse=True)[1]
        left, n_left = _matrix(rows.column("left").to_pylist(), reach, True)
        right, n_right = _matrix(rows.column("right").to_pylist(), reach, False)
        fewest, most = extents(left[:, :reach] if reach % 8 == 0 else left, n_left, right[:, :reach] if reach % 8 == 0 else right, n_right, group, unit)
        hit = pa.array(np.flatnonzero(most >= 0))
        found, pos = rows.take(hit), rows.column("pos").to_numpy()
        at = hit.to_numpy()
        return pa.record_batch([found.column("doc_id").combine_chunks(), found.column("rid").combine_chunks(), pa.array(pos[at] - most[at]), pa.array(pos[at] + length - fewest[at])], ["doc_id", "rid", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column("key").to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield judge(table.slice(0, last))
                    table = table.slice(last)
                held, size = table.to_batches(), table.num_rows
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    parts = int(around.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = around.repartition(parts, "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "doc_id long, rid long, start long, stop long")


def _counted_spans(around: DataFrame, length: int, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """The same for hot anchors: windows as rows, counted by Spark."""
    reach = length - gram

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, rid, pos, left, right in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "rid", "pos", "left", "right"))):
                # The anchor's own bytes are the same for a key; windows differ in what is around it.
                own = [x for x in range(max(0, reach - len(right) // unit), min(reach, len(left) // unit) + 1)]
                marks = np.array([np.frombuffer(hashlib.blake2b(left[len(left) - unit * x :] + right[: unit * (reach - x)], digest_size=16).digest(), "<i8") for x in own], np.int64).reshape(-1, 2)
                n = len(own)
                yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array([doc] * n, pa.int64()), pa.array([rid] * n, pa.int64()), pa.array([pos] * n, pa.int64()), pa.array(own, pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1])], ["key", "doc_id", "rid", "pos", "before", "w1", "w2"])

    rows = around.mapInArrow(windows, "key long, doc_id long, rid long, pos long, before long, w1 long, w2 long")
    same = ["key", "before", "w1", "w2"]
    repeated = rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    by = rows.join(repeated, same).groupBy("doc_id", "rid", "pos").agg(F.max("before").alias("most"), F.min("before").alias("fewest"))
    return by.select("doc_id", "rid", (F.col("pos") - F.col("most")).alias("start"), (F.col("pos") + length - F.col("fewest")).alias("stop"))


def repeated_spans(docs: DataFrame, length: int, hot: int = HOT, words: bool = False) -> DataFrame:
    """(doc_id, rid, start, stop), overlapping, of ``docs(doc_id, rid, text)``; covers every repeated byte (or word)."""
    gram, unit = (min(WORD_GRAM, length), 8) if words else (GRAM, 1)
    found = written(find_anchors(docs, length, gram, words), "anchors")
    kinds = found.groupBy("key", "around").agg(F.count("*").alias("n"))
    by_key = kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1").select("key", "kinds")
    met = written(found.join(kinds.join(by_key, "key"), ["key", "around"]), "met")
    reach = length - gram
    whole = met.where("n > 1").select("doc_id", "rid", (F.col("pos") - reach).alias("start"), (F.col("pos") + length).alias("stop"))
    mixed = met.where("kinds > 1")
    one = mixed.where("n > 1").groupBy("key", "around").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("x"), F.first("kinds").alias("kinds")).select("key", "x.doc_id", "x.rid", "x.pos", "kinds")
    wanted = mixed.where("n = 1").select("key", "doc_id", "rid", "pos", "kinds").unionByName(one)
    spans = whole.unionByName(_sorted_spans(_surroundings(docs, wanted.where(F.col("kinds") <= hot), length, gram, words), length, gram, unit))
    hot_ones = wanted.where(F.col("kinds") > hot)
    if not hot_ones.isEmpty():
        spans = spans.unionByName(_counted_spans(written(_surroundings(docs, hot_ones, length, gram, words), "hot"), length, gram, unit))
    return spans


def remove_repeats(docs: DataFrame, length: int = 400, hot: int = HOT, whole_characters: bool = False, words: int | None = None) -> DataFrame:
    """(doc_id, rid, n_bytes, n_removed, n_spans, kept): each row of ``docs(doc_id, text)`` without its repeated bytes.

    ``words``: besides, each run of so many words that also starts elsewhere goes, however few bytes it has.
    ``whole_characters``: a character of which some bytes are repeated and some not is kept as a whole.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc_id", "text"))
    if words:  # one search after the other, so that the tables of only one are on disk
        both = []
        for in_words, n in ((False, length), (True, words)):
            with scratch(docs.sparkSession):
                both.append(written(repeated_spans(rows, n, hot, words=in_words).withColumn("words", F.lit(in_words)), "spans", keep=True))
        spans = both[0].unionByName(both[1])
    else:
        spans = repeated_spans(rows, length, hot).withColumn("words", F.lit(False))
    spans = spans.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "stop", "words")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "blob", 2 << 20):
            out: list[tuple] = []
            for blob, own in zip(batch.column("blob").to_pylist(), batch.column("spans").to_pylist()):
                text = unpacked(blob)
                if not own:
                    out.append((len(text), 0, 0, text))
                    continue
                gone = np.zeros(len(text) + 2, np.int32)
                data = np.frombuffer(text, np.uint8)
                begin, end = word_bounds(data, np.array([0, len(data)]))[:2] if any(x["words"] for x in own) else ((), ())
                for x in own:
                    a, b = max(0, x["start"]), x["stop"]
                    if x["words"]:
                        a, b = int(begin[a]), int(end[min(len(end), b) - 1])
                    gone[a + 1] += 1
                    gone[min(len(text), b) + 1] -= 1
                gone = np.cumsum(gone) > 0  # gone[i + 1]: byte i goes
                if whole_characters:
                    first = np.flatnonzero((data & 0xC0) != 0x80)
                    if len(first):
                        good = np.logical_and.reduceat(gone[1:-1], first)
                        gone[1:-1] = np.repeat(good, np.diff(np.append(first, len(data))))
                out.append((len(text), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), data[~gone[1:-1]].tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.record_batch([batch.column("d"), batch.column("r"), *(pa.array(list(x), k) for x, k in zip(zip(*out), kinds))], ["doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept"])

    met = packed(rows).join(spans, (F.col("d").eqNullSafe(F.col("doc_id"))) & (F.col("r") == F.col("rid")), "left").select("d", "r", "blob", "spans")
    return met.mapInArrow(cut, "doc_id long, rid long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: passages that repeat go from the texts; documents of which nothing is left go. Same columns.

    A passage is a string of 400 bytes or more, or a run of ``PASSAGE`` words or more."""
    cut = remove_repeats(docs, whole_characters=True, words=PASSAGE).where("n_removed > 0")
    cut = cut.groupBy("doc_id", "rid").agg(F.first("kept").alias("kept"))  # repeated rows are cut alike
    id_, rid, kept, row = (free_name(x, docs.columns) for x in ("cut_id", "cut_rid", "cut_kept", "cut_row"))
    cut = cut.select(F.col("doc_id").alias(id_), F.col("rid").alias(rid), F.col("kept").cast("string").alias(kept))
    rows = docs.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    met = rows.join(cut, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(row) == F.col(rid)), "left")
    met = met.where(F.col(kept).isNull() | (F.col(kept) != ""))
    new = {"text": F.coalesce(kept, "text"), "n_chars": F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return met.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"`{c}`") for c in docs.columns])
