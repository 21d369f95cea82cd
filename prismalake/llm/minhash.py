"""MinHash near-duplicates: bottom-k sketches from one hash function.

A document's set is its distinct word shingles, hashed to 64 bits by one function; the sketch keeps the ``SKETCH``
smallest values. Documents with the same set are one vertex from the start. Inverted lists hold the ``INDEX`` smallest
values, rare ones first: two sets of the wanted similarity share at least ``shared_at_least`` of these, so each is listed
under all of them but its so many (less one) most frequent, and the two still meet. For sets whose union has at most
``INDEX`` values this bound is exact; for larger ones fewer are shared with a chance below ``MISS``. No value is dropped
for being frequent: a text made of frequent passages is listed under them.

Lists of up to ``SHORT`` documents give all their pairs. The documents of longer lists get new lists, in the same way, from
their ``FINE`` smallest values (32 bits each), which leave out what they share with unlike texts. In lists that stay long a
document is paired with the list's first one and
the one before it. A document's best candidate is verified first, and links are joined up to components. Then, in long
lists, documents outside the list's largest component are compared with all others of other components, in blocks of
``BLOCK``, by their ``FINE`` values; pairs that pass the union-sketch estimate are verified by exact intersection and union of the full sets, which
are made again from the texts. The first round sends the best ``BEST`` for a document and block; if that left any out, a
second round sends them all.

Defined results: no words or null text -> empty set, linked with nothing; fewer words than a shingle -> the whole
sequence is the one shingle; repeated rows get the same result each; rows that share an id are judged each by its own
text; rows with a null id take part, and their component is the smallest id in it or null; an empty input gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Powers, flat, free_name, given_back, lower_ascii, mix64, pieces, scratch, spread, utf8, word_bounds, written
from .components import components
from .tokens import gathered

SKETCH, INDEX, FINE, SHORT, BLOCK, BEST = 64, 40, 256, 8, 1024, 4
MISS = 1e-9  # chance that two similar sets share fewer of their INDEX smallest values than the lists count on
TEXTS = 1 << 19  # bytes of text whose shingles a task holds at once; one longer text stays whole
_symbols = spread(5)
_powers = Powers(0x9E3779B97F4A7C15)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles, row after row, and the number of each row's."""
    data, offsets = flat(utf8(texts))
    low = lower_ascii(data)
    starts, ends, first = word_bounds(low, offsets)
    up, down = _powers.to(len(low) + 1)
    sums = np.zeros(len(low) + 1, U64)
    np.cumsum(_symbols[low] * up[: len(low)], out=sums[1:])
    h = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))
    n = np.diff(first)
    out_n = np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))
    full = np.zeros(max(len(h) - words + 1, 0), U64)
    for i in range(words):
        full = (full ^ h[i : i + len(full)]) * U64(0xC2B2AE3D27D4EB4F) + U64(i + 1)
    full = mix64(full)
    at = np.repeat(first[:-1], out_n) + np.arange(out_n.sum()) - np.repeat(np.cumsum(out_n) - out_n, out_n)
    out = np.zeros(len(at), U64)
    owner_n = np.repeat(n, out_n)
    whole = owner_n >= words
    out[whole] = full[at[whole]]
    short = np.flatnonzero(~whole)
    x, left = owner_n[short].astype(U64), owner_n[short]
    for j in range(words - 1):
        on = left > j
        x[on] = mix64(x[on] ^ h[at[short[on]] + j]) * U64(0xC2B2AE3D27D4EB4F)
    out[short] = mix64(x)
    return out, out_n


def _sets(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts)
    return [np.unique(values[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _marks(own: np.ndarray) -> tuple[int, int]:
    return int(mix64(own).sum(dtype=U64).view(np.int64)), int(mix64(own ^ U64(0xA5A5A5A5DEADBEEF)).sum(dtype=U64).view(np.int64))


def row_hash(doc_id: str | Column, text: str | Column) -> Column:
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def sketches(docs: DataFrame, words: int = 3, k: int = SKETCH) -> DataFrame:
    """(doc_id, rid, n, f1, f2, sketch): row hash, set size, 128-bit fingerprint of the set, its k smallest values."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", TEXTS):
            sets = _sets(*shingles(batch.column("text"), words))
            marks = np.array([_marks(s) for s in sets], np.int64).reshape(-1, 2)
            yield pa.record_batch([batch.column("doc_id"), batch.column("rid"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0].copy()), pa.array(marks[:, 1].copy()), pa.array([s[:k].tobytes() for s in sets], pa.binary())], ["doc_id", "rid", "n", "f1", "f2", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash("doc_id", "text").alias("rid"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, rid long, n long, f1 long, f2 long, sketch binary")


def shared_at_least(percent: int, index: int = INDEX) -> np.ndarray:
    """By set size (the last entry: that and all larger): how many of its ``index`` smallest values a similar set shares.

    Of the ``index`` smallest values of the union of ``u``, both sets hold those that they share, of which there are at least
    ``percent * u / 100``: at most ``u - index`` of them are not among these, and their number is at least that of a
    binomial draw but for a chance of MISS."""
    p, tail, likely, sizes = percent / 100, 0.0, 0, 4 * index
    while likely < index and (tail := tail + math.comb(index, likely) * p**likely * (1 - p) ** (index - likely)) <= MISS:
        likely += 1
    out = np.full(sizes + 1, likely, np.int64)
    for n in range(sizes):
        of = [(-(-percent * u // 100), u) for u in range(max(n, 1), max(n * 100 // percent, 1) + 1)]
        out[n] = max(1, min(x if u <= index else max(x - (u - index), likely) for x, u in of))
    return out


def _lists(sets: DataFrame, percent: int, index: int = INDEX) -> DataFrame:
    """(key, id, df, first) of ``sets(id, n, values)``: the inverted lists of at least two documents, their lengths and
    smallest ids. ``values``: 64 bits each, or 32 where ``index`` is FINE."""
    bound, kind = shared_at_least(percent, index), np.uint32 if index == FINE else np.int64

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("values"))
            data, offsets = data.view(kind), offsets // kind().itemsize
            n = np.diff(offsets)
            first = np.arange(len(data)) - np.repeat(offsets[:-1], n) < index
            need = bound[np.minimum(batch.column("n").to_numpy(), len(bound) - 1)].astype(np.int16)
            yield pa.record_batch([pa.array(data[first].astype(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), n)[first]), pa.array(np.repeat(need, n)[first])], ["key", "id", "need"])

    rows = sets.select("id", "n", "values").mapInArrow(values, "key long, id long, need short")
    met = rows.join(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "key")
    own = Window.partitionBy("id")  # at most ``index`` rows
    met = met.withColumn("after", F.count("*").over(own) - F.row_number().over(own.orderBy("df", "key")))
    kept = written(met.where("after >= need - 1").select("key", "id"), "lists")
    lengths = kept.groupBy("key").agg(F.count("*").alias("df"), F.min("id").alias("first")).where("df > 1")
    return written(kept.join(lengths, "key"), "lists")


def _candidates(lists: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, with the number of lists that gave them."""
    salt = F.when(F.col("df") > BLOCK, F.pmod(F.hash("id"), F.ceil(F.col("df") / BLOCK).cast("int"))).otherwise(0)
    order = Window.partitionBy("key", "salt").orderBy("id")
    rows = lists.withColumn("salt", salt).withColumns({f"near{i}": F.lag("id", i).over(order) for i in range(1, SHORT)})
    near = [F.when((F.col("df") <= SHORT) | (F.lit(i < 2)), F.col(f"near{i}")) for i in range(1, SHORT)]
    partners = F.array_distinct(F.array_compact(F.array(*near, F.when(F.col("df") > SHORT, F.col("first")))))
    pairs = rows.select(F.col("id").alias("b"), F.explode(partners).alias("a")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("overlaps"))


def _estimate(x: np.ndarray, y: np.ndarray, k: int = SKETCH) -> float:
    """Similarity from the union's sketch: the k smallest values of either, and how many both have."""
    both = np.sort(np.concatenate([x, y]))
    same = both[1:] == both[:-1]
    union = np.append(both[:-1][~same], both[-1:])
    if len(x) >= k or len(y) >= k:
        union = union[:k]
    if not len(union):
        return 0.0
    return float((both[:-1][same] <= union[-1]).sum()) / len(union)


def _passing(pairs: DataFrame, sets: DataFrame, least: float, percent: int) -> DataFrame:
    """Pairs whose set sizes and estimate allow the similarity."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_estimate(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) >= least for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return rows.select("a", "b", "sa", "sb").mapInArrow(keep, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, blob): the compressed text of each vertex of ``wanted(id, doc, f1, f2)``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text", TEXTS):
            sets = _sets(*shingles(batch.column("text"), words))  # of rows that share an id, those with this set
            ok = [_marks(s) == m for s, m in zip(sets, zip(batch.column("f1").to_pylist(), batch.column("f2").to_pylist()))]
            batch = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.record_batch([batch.column("id"), pa.array([coder.compress(t) for t in utf8(batch.column("text")).to_pylist()], pa.binary())], ["id", "blob"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    met = rows.join(wanted, F.col("doc").eqNullSafe(F.col("doc_id"))).select("id", "f1", "f2", "text")
    return met.mapInArrow(keep, "id long, blob binary").dropDuplicates(["id"])


def _fine(texts: DataFrame, words: int) -> DataFrame:
    """(id, n, fine): set size and the high halves of the FINE smallest values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = _sets(*shingles(pa.array([coder.decompress(x) for x in part.column("blob").to_pylist()], pa.binary()), words))
                yield pa.record_batch([part.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([np.unique((s[:FINE] >> U64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())], ["id", "n", "fine"])

    return texts.mapInArrow(run, "id long, n long, fine binary")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union of the full sets."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        coder, held = zstandard.ZstdDecompressor(), {}

        def whole(i: int, blob: pa.Scalar) -> np.ndarray:
            if i not in held:
                if sum(map(len, held.values())) > 1 << 20:
                    held.clear()
                held[i] = np.unique(shingles(pa.array([coder.decompress(blob.as_py())], pa.binary()), words)[0])
            return held[i]

        for batch in batches:
            ok = []
            for a, b, ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb")):
                x, y = whole(b, tb), whole(a, ta)
                both = np.sort(np.concatenate([x, y]))
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(x) + len(y) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        given_back()

    left, right = (texts.select(F.col("id").alias(c), F.col("blob").alias(f"t{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def _heads(values: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SKETCH smallest values of each row, and where each row's begin."""
    n = np.diff(edges)
    head = np.arange(len(values)) - np.repeat(edges[:-1], n) < SKETCH
    return values[head], np.append(0, np.cumsum(np.minimum(n, SKETCH)))


def _earlier(keys: pa.ChunkedArray, key: int) -> tuple[np.ndarray, np.ndarray]:
    keys = keys.combine_chunks()
    edges, values = keys.offsets.to_numpy().astype(np.int64), keys.flatten().to_numpy()
    own = values < key
    return values[own], np.append(0, np.cumsum(own))[edges - edges[0]]


def _shared(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], i: int, j: int) -> np.ndarray:
    """How many values each of the rows i..j of ``x`` shares with each row of ``y``: hits added up, or where these are
    many, as a product of two tables of rows and common values."""
    (xv, xo), (yv, yo) = x, y
    m, n_y = j - i, len(yo) - 1
    v, mine = xv[xo[i] : xo[j]], np.repeat(np.arange(m), np.diff(xo[i : j + 1]))
    order = np.argsort(yv, kind="stable")
    sorted_, owner = yv[order], np.repeat(np.arange(n_y), np.diff(yo))[order]
    lo = np.searchsorted(sorted_, v)
    n = np.searchsorted(sorted_, v, "right") - lo
    met = n > 0
    common, column = np.unique(lo[met], return_inverse=True)
    if m * n_y * len(common) < 500 * n.sum():
        left, right = np.zeros((m, len(common)), np.float32), np.zeros((n_y, len(common)), np.float32)
        left[mine[met], column] = 1
        times = np.searchsorted(sorted_, sorted_[common], "right") - common
        at = np.repeat(common - np.cumsum(times) + times, times) + np.arange(times.sum())
        right[owner[at], np.repeat(np.arange(len(common)), times)] = 1
        return (left @ right.T).astype(np.int64)
    hit = owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    return np.bincount(np.repeat(mine, n) * n_y + hit, minlength=m * n_y).reshape(m, n_y)


def _estimates(xv: np.ndarray, xo: np.ndarray, yv: np.ndarray, yo: np.ndarray, k: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows k and b from the FINE smallest values of their union."""
    nx, ny = xo[k + 1] - xo[k], yo[b + 1] - yo[b]
    of = np.arange(len(k), dtype=np.int64)
    both = np.sort(np.concatenate([np.repeat(of, nx) << 32 | gathered(xv, xo[k], nx), np.repeat(of, ny) << 32 | gathered(yv, yo[b], ny)]))
    new = np.append(True, both[1:] != both[:-1])
    pair = both >> 32
    first = np.searchsorted(pair, of)
    rank = np.cumsum(new)
    rank -= (rank[first] - 1)[pair]
    distinct = np.bincount(pair, new, len(k))
    most = np.where((nx >= FINE) | (ny >= FINE), np.minimum(distinct, FINE), distinct)
    return np.bincount(pair, ~new & (rank <= most[pair]), len(k)) / np.maximum(most, 1)


def _across(long_lists: DataFrame, found: DataFrame, fine: DataFrame, least: float, percent: int, best: int | None) -> DataFrame:
    """(a, b, more): pairs of different components within long lists that pass the estimate, each with at least one
    document outside its list's largest component. ``best``: so many for a document and block; ``more``: it had more."""
    rows = long_lists.select("key", "id", "df").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    by = rows.groupBy("key", "component").agg(F.count("*").alias("size"))
    top = by.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    rows = rows.join(top.select("key", F.col("top.component").alias("main"), F.col("top.size").alias("size")), "key").join(fine, "id")
    bins, shares = F.ceil(F.col("df") / BLOCK).cast("int"), F.ceil((F.col("df") - F.col("size")) / BLOCK).cast("int")
    place = lambda n: F.pmod(F.hash("id"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    outside = F.col("component") != F.col("main")
    same = ["key", "id", "component", "n", "fine", "keys", outside.alias("outside")]
    all_ = rows.select(*same, place(bins).alias("c"), every(shares).alias("r"), F.lit(False).alias("asks"))
    asking = rows.where(outside).select(*same, every(bins).alias("c"), place(shares).alias("r"), F.lit(True).alias("asks"))

    doubt = 6 * math.sqrt(percent / 100 * (1 - percent / 100) / FINE)  # six standard errors; whole sets tell all but for equal halves

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        x, y = table.filter(pa.array(asks)).combine_chunks(), table.filter(pa.array(~asks)).combine_chunks()
        out: list[tuple[int, int, bool]] = []
        if x.num_rows and y.num_rows:
            (xi, xc, xn), (yi, yc, yn) = ([t.column(c).to_numpy() for c in ("id", "component", "n")] for t in (x, y))
            (xv, xo), (yv, yo) = ((data.view(np.uint32), edges // 4) for data, edges in (flat(t.column("fine").combine_chunks()) for t in (x, y)))
            yout = y.column("outside").to_numpy(zero_copy_only=False)
            key = x.column("key")[0].as_py()
            heads = [_heads(v, o) for v, o in ((xv, xo), (yv, yo))]
            before = [_earlier(t.column("keys"), key) for t in (x, y)]  # the lists compared before this one
            for i in range(0, len(xi), 256):
                j = min(len(xi), i + 256)
                small, large = np.minimum(xn[i:j, None], yn), np.maximum(xn[i:j, None], yn)
                near = (xc[i:j, None] != yc) & (100 * small >= percent * large) & (_shared(*heads, i, j) + 1 >= least * np.minimum(small, SKETCH))
                near &= ~yout | (xi[i:j, None] < yi)  # two documents outside meet twice
                near &= _shared(*before, i, j) == 0
                if near.sum() > 2000:  # bounds from all values at once leave few estimates to make
                    full, whole = _shared((xv, xo), (yv, yo), i, j), large <= FINE
                    near &= np.where(whole, full >= (percent / 100 - 0.01) * (xn[i:j, None] + yn - full), full >= (percent / 100 - doubt) * np.minimum(small, FINE) - 1)
                k, b = np.nonzero(near)
                e = np.concatenate([_estimates(xv, xo, yv, yo, k[c : c + 4000] + i, b[c : c + 4000]) for c in range(0, len(k), 4000)]) if len(k) else np.zeros(0)
                good = e >= percent / 100 - np.where(large[k, b] <= FINE, 0.01, doubt)
                k, b, e = k[good], b[good], e[good]
                by = np.lexsort((-e, k))
                k, b = k[by], b[by]
                rank = np.arange(len(k)) - np.searchsorted(k, k)
                more = np.bincount(k, minlength=j - i)[k] > best if best is not None else np.zeros(len(k), bool)
                use = rank < best if best is not None else np.ones(len(k), bool)
                pair = np.stack([xi[i + k[use]], yi[b[use]]])
                out += zip(pair.min(0).tolist(), pair.max(0).tolist(), more[use].tolist())
        return pa.table([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64()), pa.array([p[2] for p in out], pa.bool_())], ["a", "b", "more"])

    tasks = all_.unionByName(asking)
    return tasks.groupBy("key", "c", "r").applyInArrow(compare, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def _joined(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """(id, component) after ``links``, which are contracted by the components known before."""
    if found is None:
        return written(components(links, "a", "b"), "components")
    for c in "ab":
        links = links.join(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    new = written(components(links, "ca", "cb"), "components").toDF("component", "root")
    old = found.join(new, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return written(old.unionByName(new.toDF("id", "component").join(found.select("id"), "id", "left_anti")), "components")


def groups(docs: DataFrame, words: int, percent: int, slack: float = 0.25) -> DataFrame:
    """(doc_id, rid, n, component, smallest) of the rows of ``docs``: ``component`` names the group (null: empty set),
    ``smallest`` is its smallest id.

    ``slack``: how far the estimate may lie below the threshold; with 64 values its standard error is below 0.05.
    """
    least = percent / 100 - slack
    rows = written(sketches(docs, words), "sketches")
    sets = rows.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("id"), "*"), "sets")
    smallest = -(-percent // (100 - percent))  # smaller sets are similar only to equal ones
    rough = _lists(sets.where(F.col("n") >= smallest).select("id", "n", F.col("sketch").alias("values")), percent)
    crowded = rough.where(F.col("df") > SHORT).select("id").distinct()
    inside = rough.where(F.col("df") <= SHORT).select("id").unionAll(crowded).distinct()
    texts = written(_texts(docs, sets.join(inside, "id", "left_semi").select("id", "doc", "f1", "f2"), words), "texts")
    fine = written(_fine(texts.join(crowded, "id", "left_semi"), words), "fine")
    lists = _lists(fine.select("id", "n", F.col("fine").alias("values")), percent, FINE)
    long_lists = lists.where(F.col("df") > SHORT)
    pairs = _candidates(rough.where(F.col("df") <= SHORT)).unionByName(_candidates(lists))
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("overlaps").alias("overlaps")), "candidates")
    keys = long_lists.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most FINE
    fine = written(fine.join(keys, "id"), "fine")
    checked = lambda found: written(_verified(written(found, "passing"), texts, percent, words).distinct(), "similar")
    first = pairs.groupBy("b").agg(F.max(F.struct("overlaps", "a")).alias("x")).select("x.a", "b")
    found = _joined(None, checked(_passing(first, sets, least, percent)))
    apart = pairs.select("a", "b")
    for c in "ab":
        apart = apart.join(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    others = _passing(apart.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), sets, least, percent)
    new = checked(others)
    if not new.isEmpty():
        found = _joined(found, new)
    for best in (BEST, None):
        across = written(_across(long_lists, found, fine, least, percent, best), "across")
        new = checked(across.select("a", "b"))
        if not new.isEmpty():
            found = _joined(found, new)
        if across.where("more").isEmpty():
            break
    members = sets.select("f1", "f2", "doc", "id").join(found, "id", "left").select("f1", "f2", "doc", F.coalesce("component", "id").alias("component"))
    low = members.groupBy("component").agg(F.min("doc").alias("smallest"))
    return rows.select("doc_id", "rid", "n", "f1", "f2").join(members.join(low, "component").drop("doc"), ["f1", "f2"], "left").select("doc_id", "rid", "n", "component", "smallest")


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, slack: float = 0.25) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``."""
    out = groups(docs, words, percent, slack).withColumn("component_id", F.when(F.col("n") > 0, F.col("smallest")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (five words, 0.8) the row with the smallest id stays, one of equal
    rows. Columns stay as they are; texts without words stay, one of equal rows."""
    rid, times_ = free_name("rid", docs.columns), free_name("times", docs.columns)
    with scratch(spark):
        judged = groups(docs, words=5, percent=80)
        group = F.struct(F.coalesce("component", "rid").alias("g"), F.col("component").isNull().alias("alone"))
        stays = judged.groupBy(group.alias("g")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("x")).select("x.rid")
        times = judged.groupBy("rid").agg(F.count("*").alias("times"))
        stays = written(stays.join(times, "rid"), "stays", keep=True).toDF(rid, times_)
    met = docs.withColumn(rid, row_hash("doc_id", "text")).join(stays, rid)
    out = met.where(F.col(times_) == 1).unionByName(met.where(F.col(times_) > 1).dropDuplicates([rid]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
