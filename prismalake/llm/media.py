"""Copies of images, cropped or edited, by local descriptors.

Corners (smallest eigenvalue of the gradient's second moments) are taken at several scales of a grey image. A corner's
orientation is the direction of the brightness centroid of its patch; the patch, turned by it and smoothed, gives 128
comparisons of two points: a binary descriptor, cut into four words. A key is a place (of the four) with the words that
a corner and one of its ``near`` nearest corners of the same scale have there: two corners with one word intact. Images
meet in a hash join on keys and are candidates where they share ``votes`` keys. For candidates all descriptors are
compared; matches vote for a similarity transform, and ``consensus`` of them link the two. Components of links are the
classes.

Equal images are one vertex. Lists of keys are first compared with one member each (twice, by different orders), which
joins a group of near copies by a number of comparisons that grows with its size only. Lists within one component are
done. In the others the members of different components that share ``votes`` lists have to be found. Lists have one order,
and an image's row in a list holds its lists further on: two images meet in the first list that they share, where
``votes - 1`` of the lists that they hold there are equal. A task sorts these, so the pairs of a list are never made, only
the pairs that are candidates. Lists above ``BLOCK`` members are cut into blocks, every two of which meet. No list is cut
off or left out.

Sizes: an image keeps its ``corners`` strongest corners at each scale; this is what a descriptor set is, not a limit on
candidates. Intact words are a matter of chance for descriptors far apart: the tests measure which copies meet.

Defined results: a null or empty image, one with a side below ``2 * RADIUS + 3`` and one without two corners at a scale
is in a class with equal images only (null images: alone); rows with the same id count once; a null id has a null
component and a class of one; an empty input gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, mix64, written
from .components import components

RADIUS = 10
LONG = 7  # lists of more members come last in the order in which lists are gone through
BLOCK = 4096  # members of a list that a task holds, and as many again of another block
FIELD = np.dtype([("x", "<f4"), ("y", "<f4"), ("angle", "<f4"), ("scale", "<f4"), ("bits", "<u8", 2)])


def _pattern() -> np.ndarray:
    """128 pairs of points within the patch, from a fixed sequence."""
    u = (mix64(np.arange(1, 513, dtype=U64) * U64(0x632BE59BD9B4E019)) >> U64(11)).astype(np.float64) / 2**53
    r, a = (RADIUS - 2) * np.sqrt(u[:256]), 2 * np.pi * u[256:]
    return np.stack([r * np.cos(a), r * np.sin(a)], 1).reshape(128, 2, 2)


PATTERN = _pattern()


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r + 1 in a stack of images, borders repeated."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        s = np.cumsum(np.pad(x, pad, mode="edge"), axis)
        n = x.shape[axis]
        x = (np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(s, range(n), axis)) / (2 * r + 1)
    return x


def _smaller(stack: np.ndarray, scale: float) -> np.ndarray:
    h, w = (max(1, int(n / scale)) for n in stack.shape[1:])
    y, x = (np.minimum((np.arange(n) * scale + scale / 2).astype(int), m - 1) for n, m in zip((h, w), stack.shape[1:]))
    return _box(stack, max(0, int(scale / 2)))[:, y][:, :, x]


def describe(stack: np.ndarray, corners: int = 12, scales: tuple[float, ...] = (1.0, 1.5, 2.0)) -> list[np.ndarray]:
    """Descriptors (``FIELD``) of each of a stack of grey images of one size."""
    out: list[list[np.ndarray]] = [[] for _ in stack]
    for scale in scales:
        g = _box(_smaller(stack.astype(np.float64), scale), 1)
        n, h, w = g.shape
        if min(h, w) < 2 * RADIUS + 3:
            continue
        gy, gx = np.gradient(g, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gx * gy, 2), _box(gy * gy, 2)
        strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
        strength = np.round(strength, 6)
        top = strength.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                top = np.maximum(top, np.roll(strength, (dy, dx), (1, 2)))
        peak = np.where((strength == top) & (strength > 1.0), strength, 0)
        m = RADIUS + 1
        peak[:, :m] = peak[:, -m:] = 0
        peak[:, :, :m] = peak[:, :, -m:] = 0
        best = np.argsort(-peak.reshape(n, -1), 1, kind="stable")[:, :corners]
        i = np.repeat(np.arange(n), best.shape[1])
        y, x = np.divmod(best.ravel(), w)
        ok = peak[i, y, x] > 0
        i, y, x = i[ok], y[ok], x[ok]
        if not len(i):
            continue
        side = np.arange(-RADIUS, RADIUS + 1)
        dy, dx = (z.ravel() for z in np.meshgrid(side, side, indexing="ij"))
        disc = dy * dy + dx * dx <= RADIUS * RADIUS
        dy, dx = dy[disc], dx[disc]
        patch = g[i[:, None], y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2(patch @ dy, patch @ dx)
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px = np.rint(PATTERN[..., 0] * cos - PATTERN[..., 1] * sin).astype(int)
        py = np.rint(PATTERN[..., 0] * sin + PATTERN[..., 1] * cos).astype(int)
        v = _box(g, 2)[i[:, None, None], y[:, None, None] + py, x[:, None, None] + px]
        bits = np.packbits(v[..., 0] < v[..., 1], axis=1, bitorder="little").view("<u8")
        found = np.zeros(len(i), FIELD)
        found["x"], found["y"], found["angle"], found["scale"], found["bits"] = (x + 0.5) * scale, (y + 0.5) * scale, angle, scale, bits
        edges = np.searchsorted(i, np.arange(n + 1))
        for k in range(n):
            out[k].append(found[edges[k] : edges[k + 1]])
    return [np.concatenate(x) if x else np.zeros(0, FIELD) for x in out]


def agreeing(a: np.ndarray, b: np.ndarray, apart: int = 14, tolerance: float = 3.0) -> int:
    """The most matches (at most ``apart`` bits) that one similarity transform explains."""
    d = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(2)
    i, j = np.nonzero(d <= apart)
    if len(i) < 2:
        return len(i)
    scale = b["scale"][j] / a["scale"][i]
    turn = (b["angle"][j] - a["angle"][i]).astype(np.float64)
    cos, sin = scale * np.cos(turn), scale * np.sin(turn)
    ax, ay, bx, by = (v.astype(np.float64) for v in (a["x"][i], a["y"][i], b["x"][j], b["y"][j]))
    # Hypothesis k moves (ax, ay) by its turn and scale so that its own match fits; a match agrees if it fits too.
    tx, ty = bx - (cos * ax - sin * ay), by - (sin * ax + cos * ay)
    ex = cos[:, None] * ax - sin[:, None] * ay + tx[:, None] - bx
    ey = sin[:, None] * ax + cos[:, None] * ay + ty[:, None] - by
    fits = ex * ex + ey * ey <= tolerance * tolerance
    most = 0
    votes = fits.sum(1)
    for k in np.argsort(-votes, kind="stable"):
        if votes[k] <= most:
            break
        most = max(most, min(len(np.unique(i[fits[k]])), len(np.unique(j[fits[k]]))))
    return most


def described(images: DataFrame, corners: int = 12) -> DataFrame:
    """(id, f1, f2, n, marks) of ``images(id, height, width, pixels)``: fingerprint, number of descriptors, descriptors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, pixels = list(zip(batch.column("height").to_pylist(), batch.column("width").to_pylist())), batch.column("pixels").to_pylist()
            good = [p is not None and None not in s and len(p) == s[0] * s[1] > 0 for s, p in zip(size, pixels)]
            prints = [np.frombuffer(hashlib.blake2b(b"%d,%d," % s + p, digest_size=16).digest(), "<i8") if g else None for s, p, g in zip(size, pixels, good)]
            marks: list = [None] * n
            for s in sorted({s for s, g in zip(size, good) if g}):
                rows = [k for k in range(n) if good[k] and size[k] == s]
                step = max(1, (4 << 20) // (s[0] * s[1] * 8))
                for c in range(0, len(rows), step):
                    stack = np.stack([np.frombuffer(pixels[k], np.uint8).reshape(s) for k in rows[c : c + step]])
                    for k, m in zip(rows[c : c + step], describe(stack, corners)):
                        marks[k] = m.tobytes()
            part = lambda w: pa.array([None if p is None else int(p[w]) for p in prints], pa.int64())
            yield pa.record_batch([batch.column("id"), part(0), part(1), pa.array([len(m or b"") // FIELD.itemsize for m in marks], pa.int64()), pa.array(marks, pa.binary())], ["id", "f1", "f2", "n", "marks"])

    rows = images.select(F.col("id").cast("long").alias("id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("pixels").cast("binary").alias("pixels"))
    return rows.mapInArrow(run, "id long, f1 long, f2 long, n long, marks binary")


def keys_of(marks: np.ndarray, near: int = 3) -> np.ndarray:
    """The distinct keys of an image: place and words of two neighbouring corners, hashed to 64 bits."""
    gap = (marks["x"][:, None] - marks["x"]) ** 2 + (marks["y"][:, None] - marks["y"]) ** 2
    gap[marks["scale"][:, None] != marks["scale"]] = np.inf
    np.fill_diagonal(gap, np.inf)
    next_to = np.argsort(gap, 1, kind="stable")[:, :near]
    i, j = np.repeat(np.arange(len(marks)), next_to.shape[1]), next_to.ravel()
    there = np.isfinite(gap[i, j])
    w = np.ascontiguousarray(marks["bits"]).view("<u4").reshape(-1, 4).astype(U64)
    one, two = w[i[there]], w[j[there]]
    key = mix64((np.minimum(one, two) << U64(32) | np.maximum(one, two)) + np.arange(4, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return np.unique(key.ravel()).view(np.int64)


def _keys(reps: DataFrame, near: int) -> DataFrame:
    """(id, key) of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [keys_of(np.frombuffer(m.as_buffer(), FIELD), near) for m in batch.column("marks")]
            ids = np.repeat(batch.column("id").to_numpy(), [len(k) for k in keys])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["id", "key"])

    return reps.where("n > 1").select("id", "marks").mapInArrow(run, "id long, key long")


def _pairs_checked(pairs: DataFrame, reps: DataFrame, consensus: int) -> DataFrame:
    """The pairs (a, b) whose descriptors agree."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [agreeing(np.frombuffer(x.as_buffer(), FIELD), np.frombuffer(y.as_buffer(), FIELD)) >= consensus for x, y in zip(batch.column("ma"), batch.column("mb"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = (reps.select(F.col("id").alias(c), F.col("marks").alias(f"m{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(check, "a long, b long")


def _open_lists(lists: DataFrame, links: DataFrame) -> DataFrame:
    """(key, id, c, members): the lists that still hold members of different components ``c``."""
    found = components(links, "a", "b").select("id", "component")
    rows = lists.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    mixed = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("members")).where("low < high").select("key", "members")
    return rows.join(mixed, "key")


def _stars(lists: DataFrame, order, votes: int) -> DataFrame:
    """Pairs (a, b) of each member with its list's first in ``order``, where they are so in ``votes`` lists."""
    first = lists.groupBy("key").agg(F.min_by(F.struct("id", "c"), order).alias("first"))
    rows = lists.join(first, "key").where("c != first.c")
    return _voted(rows.select(F.least("id", "first.id").alias("a"), F.greatest("id", "first.id").alias("b")), votes)


def _voted(pairs: DataFrame, votes: int) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes).select("a", "b")


def _met(lists: DataFrame) -> DataFrame:
    """(a, b), once for each of ``lists(key, id, c)`` that two images of different components share."""
    other = lists.select("key", F.col("id").alias("b"), F.col("c").alias("d"))
    return lists.withColumnRenamed("id", "a").join(other, "key").where("a < b and c != d").select("a", "b")


def meeting(part: np.ndarray, across: np.ndarray, block: np.ndarray, c: np.ndarray, size: np.ndarray, others: np.ndarray, votes: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one ``part`` and different ``c`` that have ``votes`` of their ``others`` in common, where
    ``across`` only those of different ``block``. Row k has ``size[k]`` others, each once.

    About ``most`` meetings are held at once, or one row's."""
    row = np.repeat(np.arange(len(part)), size)
    order = np.lexsort((others, part[row]))  # stable: rows ascend among equal ones
    row, value = row[order], others[order]
    edge = np.flatnonzero((value[1:] != value[:-1]) | (part[row[1:]] != part[row[:-1]])) + 1
    here = np.arange(len(row))
    later = np.append(edge, len(row))[np.searchsorted(edge, here, "right")] - here - 1
    by = np.argsort(row, kind="stable")
    by = by[later[by] > 0]
    before = np.cumsum(later[by]) - later[by]
    first = np.flatnonzero(np.diff(row[by], prepend=-1))
    cuts = [*first[np.flatnonzero(np.diff(before[first] // most, prepend=-1))].tolist(), len(by)]
    for low, high in zip(cuts, cuts[1:]):
        n = later[by[low:high]]
        i = np.repeat(by[low:high], n)
        j = i + 1 + np.arange(len(i)) - np.repeat(before[low:high] - before[low], n)
        x, y = row[i], row[j]
        ok = (c[x] != c[y]) & ~(across[x] & (block[x] == block[y]))
        pairs, times = np.unique(x[ok] * len(part) + y[ok], return_counts=True)
        yield np.divmod(pairs[times >= votes], len(part))


def _sharing(lists: DataFrame, votes: int) -> DataFrame:
    """The pairs (a, b) of different components that share ``votes`` of ``lists(key, id, c, members)``."""
    if votes < 2:
        return _met(lists.select("key", "id", "c")).distinct()
    # an image's row in a list holds its lists further on, in one order for all images, in which long lists are last
    further = Window.partitionBy("id").orderBy(F.desc(F.col("members") > LONG), F.desc("key")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lists.select("key", "id", "c", "members", F.collect_list("key").over(further).alias("others")).where(F.size("others") >= votes - 1)
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own, zero = F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), F.lit(0)
    whole = rows.where(F.col("members") <= BLOCK).select("key", "id", "c", "others", zero.alias("block"), zero.alias("x"), zero.alias("y"))
    cut = rows.where(F.col("members") > BLOCK).select("key", "id", "c", "others", own, F.explode(F.sequence(zero, blocks - 1)).alias("to"))
    cut = cut.select("key", "id", "c", "others", "block", F.least("block", "to").alias("x"), F.greatest("block", "to").alias("y"))
    dealt = whole.unionByName(cut).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            both = [x for x in (held, batch) if x is not None and x.num_rows]
            if not both:
                continue
            rows = pa.Table.from_batches(both).combine_chunks().to_batches()[0]
            new = np.zeros(rows.num_rows, bool)
            for name in ("key", "x", "y"):
                new[1:] |= np.diff(rows.column(name).to_numpy()) != 0
            end = rows.num_rows if batch is None else int(np.flatnonzero(new).max(initial=0))  # the last part may go on
            held, rows = rows.slice(end), rows.slice(0, end)
            if not end:
                continue
            ids, c, block, x, y = (rows.column(name).to_numpy() for name in ("id", "c", "block", "x", "y"))
            others = rows.column("others")
            for i, j in meeting(np.cumsum(new[:end]), x != y, block, c, pc.list_value_length(others).to_numpy(), others.flatten().to_numpy(), votes - 1):
                yield pa.record_batch([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def copy_links(reps: DataFrame, consensus: int = 6, near: int = 3, votes: int = 2) -> DataFrame:
    """Links (a, b) with the components of all links between candidates among ``reps(id, n, marks)``; not every link."""
    keys = _keys(reps, near)
    shared = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key")
    lists = written(keys.join(shared, "key").select("key", "id", F.col("id").alias("c")), "lists")
    links = written(_pairs_checked(_stars(lists, F.col("id"), votes), reps, consensus), "links")
    rest = written(_open_lists(lists, links), "lists")
    links = written(links.unionByName(_pairs_checked(_stars(rest, F.xxhash64("id"), votes), reps, consensus)), "links")
    rest = written(_open_lists(rest, links), "lists")
    return written(links.unionByName(_pairs_checked(_sharing(rest, votes), reps, consensus)), "links")


def detect_copies(images: DataFrame, consensus: int = 6, corners: int = 12, near: int = 3, votes: int = 2) -> DataFrame:
    """(id, n_keypoints, n_class, component_id, kept) for each row of ``images(id, height, width, pixels)``.

    ``n_class``: distinct ids of the class; ``component_id``: the smallest of them.
    """
    rows = written(described(images, corners), "images")
    same = ["f1", "f2"]
    reps = rows.where("f1 is not null and id is not null").groupBy(*same).agg(F.min("id").alias("id"), F.count_distinct("id").alias("copies"), F.first("n").alias("n"), F.first("marks").alias("marks"))
    reps = written(reps, "vertices")
    found = components(copy_links(reps, consensus, near, votes), "a", "b")
    of = reps.select(*same, "id", "copies").join(found, "id", "left").select(*same, "copies", F.coalesce("component", "id").alias("component"))
    of = of.join(of.groupBy("component").agg(F.sum("copies").alias("size")), "component")
    out = rows.select("id", "n", *same).join(of, same, "left")
    out = out.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    n_class = F.when(F.col("id").isNull(), 1).otherwise(F.coalesce("size", F.lit(1))).cast("long")
    return out.select("id", F.col("n").alias("n_keypoints"), n_class.alias("n_class"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def as_images(embeddings: DataFrame, tile: int = 8) -> DataFrame:
    """Vectors of 64 numbers as grey images: an 8 x 8 grid of tiles, ``floor(256 e + 128)`` clamped to a byte each."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = 8 * tile
        for batch in batches:
            out = []
            for x in batch.column("embedding").to_pylist():
                if x is None or len(x) != 64 or None in x or not np.isfinite(x).all():
                    out.append(None)
                    continue
                v = np.clip(np.floor(np.array(x) * 256 + 128), 0, 255).astype(np.uint8).reshape(8, 8)
                out.append(v.repeat(tile, 0).repeat(tile, 1).tobytes())
            n = batch.num_rows
            yield pa.record_batch([batch.column("vec_id"), pa.array([side] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(out, pa.binary())], ["id", "height", "width", "pixels"])

    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(draw, "id long, height int, width int, pixels binary")


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect_copies(as_images(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
