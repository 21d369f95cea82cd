"""SentencePiece encoding and decoding by suffix-array matching.

The units of a batch's text (a run of word marks with the letters after it; pieces never cross these), repeated ones
once, are concatenated and indexed by a suffix array that is sorted as deep as the longest piece. Every piece of the
vocabulary is binary-searched for its range of occurrences; the ranges give edges ``(start, end, score)``, which are
sorted by position. Relaxation over the edges then finds the segmentation:

* ``bpe``: in every unit the best-scored edge over two neighbouring segments (the leftmost of equal ones) joins them,
  until none is left. This is the order of merges that the model defines. All units of a batch advance together, but
  for units of more than ``LONG`` characters, whose edges wait in a heap.
* ``unigram``: the best sum of scores over paths of edges, position by position.

Characters that no piece covers become byte pieces, or the unknown piece where the model has none. Each row is encoded
by itself, without shuffle; memory is bounded by the batch and by ``held`` remembered units.

Defined results: null and empty text -> no ids, decoded to the empty text; a text with ``NUL`` is handled like any
other; repeated rows are encoded each; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flat, free_name, pieces
from .tokens import gathered, tokenizer_path

MARK, LONG, TEXTS, UNITS = "▁", 64, 4 << 20, 50_000
DENSE = 1 << 23  # places of starts and lengths up to which edges are looked up in a dense table
_loaded: dict[tuple, PieceCoder] = {}


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes' first ``depth`` characters, by doubling."""
    n = len(text)
    letters, rank = np.unique(text, return_inverse=True)
    rank, width, bits = rank.astype(np.int64) + 1, 1, max(1, int(len(letters)).bit_length())
    key = rank
    while 2 * width * bits <= 62 and width < depth:  # the first characters packed into one key
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = key[width:]
        key, width = (key << (bits * width)) | after, 2 * width
    order = np.argsort(key)
    ranked = key[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
    while width < depth:
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))
        width *= 2
    return order


class PieceCoder:
    def __init__(self, path: str, method: str = "bpe", held: int = 300_000):
        import sentencepiece

        if method not in ("bpe", "unigram"):
            raise ValueError(f"unknown method {method!r}")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.method, self.held, self.known = method, held, {}
        self.names = [model.id_to_piece(i) for i in range(len(model))]
        self.unknown = model.unk_id()
        plain = [i for i in range(len(model)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(len(model)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(len(model)) if model.is_control(i)}
        self.id_of = {self.names[i]: i for i in plain}
        side_by_side = {name[i : i + 2] for name in self.id_of for i in range(len(name) - 1)}
        self.ends = "".join(c for c in ",." if not any(x[1] == c and x[0].isalpha() for x in side_by_side))  # never joined to a letter before
        self.lines = not any("\n" in name for name in self.id_of)
        self.score = np.array([model.get_score(i) for i in range(len(model))])
        self.longest = max(map(len, self.id_of), default=1)
        self.least = float(self.score[plain].min()) - 10 if plain else 0.0
        # Pieces as rows of code points, padded with -1, with their lengths.
        self.ids = np.array(sorted(plain, key=lambda i: self.names[i]), np.int64)
        self.sizes = np.array([len(self.names[i]) for i in self.ids], np.int64)
        self.cuts = not any(MARK in self.names[i].lstrip(MARK) for i in plain)

    def units(self, text: str) -> list[str]:
        """The normalised text cut before each run of marks (as a whole where pieces cross marks)."""
        if not text:
            return []
        text = MARK + text.replace(" ", MARK)
        if not self.cuts:
            return [text]
        out, parts = [], text.split(MARK)
        run = MARK
        for p in parts[1:]:
            if p:
                out.append(run + p)
                run = MARK
            else:
                run += MARK
        if len(run) > 1:
            out.append(run[:-1])
        return out

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and piece ids of all occurrences in the concatenated units, by position; the units' starts."""
        text = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        order = suffix_array(text, self.longest)
        padded = np.append(text, np.full(self.longest, -1))
        low, high = np.zeros(len(self.ids), np.int64), np.full(len(self.ids), len(text))
        names = np.frombuffer("".join(self.names[i] for i in self.ids).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        for k in range(self.longest):  # narrow each piece's range by its next character
            at = np.flatnonzero((self.sizes > k) & (low < high))
            if not len(at):
                break
            want, a, b = names[first[at] + k], low[at], high[at]
            for side in (0, 1):
                lo, hi = a.copy(), b.copy()
                while True:
                    open_ = lo < hi
                    if not open_.any():
                        break
                    mid = (lo + hi) // 2
                    got = padded[order[np.minimum(mid, len(order) - 1)] + k]
                    go = (got < want) if side == 0 else (got <= want)
                    lo = np.where(open_ & go, mid + 1, lo)
                    hi = np.where(open_ & ~go, mid, hi)
                if side == 0:
                    low[at] = lo
                else:
                    high[at] = lo
        n = np.maximum(high - low, 0)
        piece = np.repeat(np.arange(len(n)), n)
        begin = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        length = self.sizes[piece]
        unit_end = np.repeat(starts + sizes, sizes)
        inside = begin + length <= unit_end[begin]
        begin, length, piece = begin[inside], length[inside], self.ids[piece[inside]]
        by = np.argsort(begin * (self.longest + 1) + length)
        return begin[by], length[by], piece[by], starts

    def encode_units(self, units: list[str]) -> list[list[int]]:
        begin, length, piece, starts = self.edges(units)
        n = sum(map(len, units))
        wide = self.longest + 1
        if n * wide <= DENSE:
            table = np.full((n, wide), -1, np.int32)  # piece by start and length
            table[begin, length] = piece

            def look(at: np.ndarray, size: np.ndarray) -> np.ndarray:
                return table[at, size]
        else:
            keys, own = begin * wide + length, np.append(piece, -1)

            def look(at: np.ndarray, size: np.ndarray) -> np.ndarray:
                want = at * wide + size
                i = np.searchsorted(keys, want)
                return np.where(np.append(keys, -1)[i] == want, own[i], -1)

        sizes = np.diff(np.append(starts, n))
        owner = np.repeat(np.arange(len(units)), sizes)
        ends = np.zeros(n, bool)
        if self.method == "bpe":
            ends = self._merged(look, owner, np.flatnonzero((sizes <= LONG)[owner]))
            for u in np.flatnonzero(sizes > LONG).tolist():
                lo, hi = np.searchsorted(begin, [starts[u], starts[u] + sizes[u]])
                ends[starts[u] + np.array(self._heap(int(sizes[u]), begin[lo:hi] - starts[u], length[lo:hi], piece[lo:hi]))] = True
        elif len(units):
            ends = self._best_paths(look, starts, n)
        at = np.flatnonzero(ends)
        size = np.diff(np.append(at, n))
        ids = look(at, np.minimum(size, self.longest))
        text = "".join(units)
        out: list[list[int]] = [[] for _ in units]
        for u, a, s, i in zip(owner[at].tolist(), at.tolist(), size.tolist(), ids.tolist()):
            out[u] += [i] if i >= 0 else self.fallback(text[a : a + s])
        return out

    def _merged(self, look: Callable, owner: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Whether each position begins a segment when no neighbouring segments can be joined any more.

        ``seg``: the positions of the units to work on, later the starts of segments that may still change."""
        n = len(owner)
        begins = np.zeros(n, bool)
        begins[seg] = True
        while len(seg):
            nxt = np.append(seg[1:], n)
            after = np.append(nxt[1:], n)
            same = np.append(owner[seg[1:]] == owner[seg[:-1]], False)
            # where the second segment ends: its unit's end if it is the last of its unit
            end_of = np.where(np.append(same[1:], False), after, self._unit_end(owner, np.minimum(nxt, n - 1)))
            size = end_of - seg
            fits = same & (size <= self.longest)
            got = np.where(fits, look(seg, np.where(fits, size, 0)), -1)
            cost = np.where(got >= 0, -self.score[got], np.inf)
            unit = owner[seg]
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            best = np.minimum.reduceat(cost, first)
            number = np.cumsum(np.append(True, unit[1:] != unit[:-1])) - 1
            active = np.isfinite(best)
            hit = np.flatnonzero((cost == best[number]) & active[number])
            if not len(hit):
                break
            hit = hit[np.append(True, number[hit][1:] != number[hit][:-1])]  # leftmost of each unit
            begins[seg[hit + 1]] = False
            keep = active[number]
            keep[hit + 1] = False
            seg = seg[keep]
        return begins

    @staticmethod
    def _unit_end(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(owner, owner[at], "right")

    def _best_paths(self, look: Callable, starts: np.ndarray, n: int) -> np.ndarray:
        """Whether each position begins a segment of the path with the best sum of scores."""
        sizes = np.diff(np.append(starts, n))
        best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
        # Positions of all units advance together: position p of every unit long enough.
        value = np.full((len(starts), int(sizes.max(initial=0)) + 1), -np.inf)
        value[:, 0] = 0
        frm = np.zeros(value.shape, np.int64)
        for p in range(1, value.shape[1]):
            rows = np.flatnonzero(sizes >= p)
            for k in range(1, min(self.longest, p) + 1):
                at = starts[rows] + p - k
                got = look(at, np.full(len(at), k))
                step = np.where(got >= 0, self.score[got], self.least if k == 1 else -np.inf)
                new = value[rows, p - k] + step
                better = new > value[rows, p]
                value[rows[better], p], frm[rows[better], p] = new[better], p - k
        begins = np.zeros(n, bool)
        at = sizes.copy()
        while (at > 0).any():
            rows = np.flatnonzero(at > 0)
            at[rows] = frm[rows, at[rows]]
            begins[starts[rows] + at[rows]] = True
        return begins

    def fallback(self, char: str) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in char.encode("utf-8", "replace")]
        return [self.unknown]

    def _heap(self, n: int, begin: np.ndarray, length: np.ndarray, piece: np.ndarray) -> list[int]:
        """Where segments of one long unit begin: the same joins, with a heap over the edges between living neighbours."""
        edge = dict(zip(zip(begin.tolist(), (begin + length).tolist()), (-self.score[piece]).tolist()))
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a]
            if b < n and (a, end[b]) in edge:
                heapq.heappush(heap, (edge[a, end[b]], a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == e):
                continue
            alive[b] = False
            end[a], after[a] = e, after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [a for a in range(n) if alive[a]]

    def looked_up(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct units one after another and the number of each one's, remembered or newly encoded."""
        if len(self.known) > self.held:
            self.known = {}
        known = self.known
        new = [u for u in units if u not in known]
        for i in range(0, len(new), UNITS):
            some = new[i : i + UNITS]
            known.update((u, np.array(ids, "<u4").tobytes()) for u, ids in zip(some, self.encode_units(some)))
        found = [known[u] for u in units]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another and the number of each row's; null is empty.

        A word is a unit with the mark before it. Where no piece joins them, a line end before a word and a comma or full
        stop after a letter are parts of their own. Rows with other blanks or marks are cut by ``units``."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
        n = len(texts)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n") if self.lines else texts, " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first -= first[0]
        coded = lists.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        rows = np.repeat(np.arange(n), np.diff(first))
        flags = lambda x: x.to_numpy(zero_copy_only=False)
        odd = np.full(n, not self.cuts)  # texts where a unit is not one mark and one word
        odd[rows[(flags(pc.equal(words, "")) | flags(pc.match_substring(words, MARK)))[at]]] = True
        line = flags(pc.starts_with(words, "\n")) if self.lines else np.zeros(len(words), bool)
        last = flags(pc.match_substring_regex(words, f"[A-Za-z\u00df-\u00f6\u00f8-\u00ff][{self.ends}]$")) if self.ends else np.zeros(len(words), bool)
        stop = flags(pc.ends_with(words, ".")).astype(np.int64)
        stems = pc.if_else(pa.array(last), pc.utf8_slice_codeunits(words, 0, -1), words)
        text = lambda x: pa.scalar(x, pa.large_string())
        stems = pc.if_else(pa.array(line), pc.utf8_slice_codeunits(stems, 1), pc.binary_join_element_wise(text(MARK), stems, text("")))
        keep = ~odd[rows]
        used = np.zeros(len(words), bool)
        used[at[keep]] = True
        coded = stems.filter(pa.array(used)).dictionary_encode()
        names = dict.fromkeys(["", "\n", ",", ".", *coded.dictionary.to_pylist()])
        other = {int(r): self.units(texts[int(r)].as_py()) for r in np.flatnonzero(odd)}
        names.update((u, None) for units in other.values() for u in units)
        place = {u: i for i, u in enumerate(names)}
        flat_ids, sizes = self.looked_up(list(names))
        begins = np.cumsum(sizes) - sizes
        of = np.zeros(len(words), np.int64)
        of[used] = np.array([place[u] for u in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if used.any() else 0
        three = np.stack([line.astype(np.int64), of, np.where(last, 2 + stop, 0)], 1)[at[keep]]
        unit, counts = three.ravel(), 3 * np.diff(first)
        if other:
            parts = np.split(unit, np.cumsum(np.where(odd, 0, counts))[:-1])
            parts = [np.array([place[u] for u in other[r]], np.int64) if r in other else parts[r] for r in range(n)]
            unit, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)
        each = sizes[unit]
        ends = np.append(0, np.cumsum(each))
        bounds = np.append(0, np.cumsum(counts))
        return gathered(flat_ids, begins[unit], each), ends[bounds[1:]] - ends[bounds[:-1]]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The text of each row of ids; ``lengths``: ids of each."""
        if not hasattr(self, "surfaces"):
            named = [b"" if i in self.control else " ⁇ ".encode() if i == self.unknown else bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(self.names)]
            sizes = np.fromiter(map(len, named), np.int64, len(named))
            self.surfaces = np.frombuffer(b"".join(named), np.uint8), np.cumsum(sizes) - sizes, sizes
        data, begins, sizes = self.surfaces
        each = sizes[ids]
        raw = gathered(data, begins[ids], each).tobytes()
        ends = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(lengths))].tolist()
        texts = (raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:]))
        return [t[1:] if t.startswith(" ") else t for t in texts]


def coder(path: str, method: str = "bpe") -> PieceCoder:
    if (path, method) not in _loaded:
        _loaded[path, method] = PieceCoder(path, method)
    return _loaded[path, method]


def as_binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    edges = np.append(0, np.cumsum(4 * lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])


def encode(docs: DataFrame, model: str, method: str = "bpe", text: str = "text", keep: tuple[str, ...] = ("doc_id",), back: bool = False) -> DataFrame:
    """``keep`` columns with ``ids`` (little-endian unsigned 32-bit) of each row's text.

    ``back``: and with ``decoded``, the text of the ids; one Python worker does both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model, method)
        for batch in pieces(batches, batch_text, TEXTS):
            ids, n = own.encode(batch.column(batch_text))
            more = [pa.array(own.decode(ids, n), pa.string())] if back else []
            yield pa.record_batch([*batch.columns[:-1], as_binary(ids, n), *more], [*batch.schema.names[:-1], "ids", *["decoded"] * back])

    batch_text = free_name("text", list(keep))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(batch_text))
    schema = rows.drop(batch_text).schema.add("ids", "binary")
    return rows.mapInArrow(run, schema.add("decoded", "string") if back else schema)


def decode(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` columns with the decoded ``text`` of each row's ``ids`` (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model)
        for batch in pieces(batches, name, TEXTS):
            data, offsets = flat(pc.fill_null(batch.column(name), b""))
            texts = own.decode(data.view("<u4"), np.diff(offsets) // 4)
            yield pa.record_batch([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    name = free_name("coded", list(keep))
    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col("ids").alias(name))
    return rows.mapInArrow(run, rows.drop(name).schema.add("text", "string"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, decoded again: n_pieces, crc32 of the ids, and crc32 of the decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = encode(docs, tokenizer_path("piece_bpe_32k.model"), back=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"))


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
