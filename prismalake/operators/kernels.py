"""Kernels as a dimension table: each image is convolved with the kernel that its row names.

Images meet their kernels in an equi-join of one row an image (or tile), before any pixel is made. A whole image is then
convolved in its row, in Arrow batches and without a shuffle. Of a tile each pixel adds its value, times each tap, to the
places that read it, and one grouping by place sums them up; as all pixels of a row are in the same task, the sums of a
row are combined before the shuffle. Borders of tiles are laid out by giving a border pixel's value to the places beyond
the image that mirror or repeat it, so a kernel may reach over tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import PLANE, C, H, W, div, pixels, whole


def taps_of(kernels: DataFrame) -> DataFrame:
    """(kernel_id, taps, reach_y, reach_x) of ``kernels(kernel_id, ky, kx, w)``, each side odd: as many taps as the kernel has.

    A tap (dy, dx, w) says that a value counts w times at the place (dy, dx) away; that is true convolution."""
    by = kernels.groupBy("kernel_id").agg((F.max("ky") + 1).alias("kh"), (F.max("kx") + 1).alias("kw"), F.count("*").alias("n"), F.collect_list(F.struct("ky", "kx", "w")).alias("k"))
    bad = F.raise_error(F.concat(F.lit("kernel sides must be odd and every place needs one row: "), F.col("kernel_id").cast("string"))).cast("array<struct<ky:int,kx:int,w:double>>")
    good = (F.col("kh") % 2 == 1) & (F.col("kw") % 2 == 1) & (F.col("n") == F.col("kh") * F.col("kw"))
    by = by.withColumn("k", F.when(good, F.col("k").cast("array<struct<ky:int,kx:int,w:double>>")).otherwise(bad))
    taps = F.transform(F.filter("k", lambda t: t["w"] != 0), lambda t: F.struct((t["ky"] - div(F.col("kh"), 2)).alias("dy"), (t["kx"] - div(F.col("kw"), 2)).alias("dx"), t["w"].alias("w")))
    return by.select("kernel_id", taps.alias("taps"), div(F.col("kh"), 2).alias("reach_y"), div(F.col("kw"), 2).alias("reach_x"))


def shown_at(mode: str, place: Column, n: Column, reach: Column) -> Column:
    """The places from -reach to n - 1 + reach that show the value of ``place``."""
    own = F.array(place)
    if mode == "zero":
        return own
    if mode == "replicate":
        some = lambda on, first, last: F.when(on & (reach > 0), F.sequence(whole(first), whole(last))).otherwise(F.array().cast("array<int>"))
        return F.concat(own, some(place == 0, -reach, F.lit(-1)), some(place == n - 1, n, n - 1 + reach))
    if mode == "reflect":
        period = F.greatest(F.lit(1), 2 * (n - 1))
        turns = F.sequence(-whole(F.ceil(reach / period)) - 1, whole(F.ceil(reach / period)) + 1)
        every = F.flatten(F.transform(turns, lambda t: F.array(place + t * period, t * period - place)))
        return F.array_distinct(F.transform(F.filter(every, lambda e: (e >= -reach) & (e < n + reach)), lambda e: whole(e)))
    raise ValueError(f"unknown pad mode {mode!r}; zero, reflect or replicate")


def _met(df: DataFrame, kernels: DataFrame) -> DataFrame:
    """The rows with their kernel's taps and reach; without a kernel one tap of 1."""
    same = F.array(F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(1.0).alias("w")))
    met = df.join(taps_of(kernels), "kernel_id", "left")
    return met.withColumns({"taps": F.coalesce("taps", same), "reach_y": F.coalesce("reach_y", F.lit(0)), "reach_x": F.coalesce("reach_x", F.lit(0))})


PADS = {"zero": "constant", "reflect": "reflect", "replicate": "edge"}


def convolved(images: np.ndarray, taps: list[tuple[int, int, float]], mode: str) -> np.ndarray:
    """A stack (n, height, width, channels): each value added, times each tap, to the place that is the tap away."""
    ry, rx = (max((abs(t[i]) for t in taps), default=0) for i in (0, 1))
    h, w = images.shape[1:3]
    wide = np.pad(images, ((0, 0), (ry, ry), (rx, rx), (0, 0)), PADS[mode])
    out = np.zeros(images.shape)
    for dy, dx, weight in taps:
        out += weight * wide[:, ry - dy : ry - dy + h, rx - dx : rx - dx + w]
    return out


def convolve_planes(df: DataFrame, kernels: DataFrame, pad_mode: str = "zero") -> DataFrame:
    """Plane rows, with a column ``kernel_id``, each convolved with its kernel. Null values count as 0.

    Images whose kernel is null or not in the table are left as they are."""
    if pad_mode not in PADS:
        raise ValueError(f"unknown pad mode {pad_mode!r}; zero, reflect or replicate")
    met = _met(df.select(*PLANE, "kernel_id"), kernels)
    data = F.transform("data", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
    places = [F.col(f"taps.{n}").alias(n) for n in ("dy", "dx", "w")]
    met = met.where("data is not null").select("image_id", *[whole(F.col(n)).alias(n) for n in PLANE[1:4]], data.alias("data"), *places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = lambda n: batch.column(batch.schema.get_field_index(n))
            taps = [tuple(zip(*t)) for t in zip(*(of(n).to_pylist() for n in ("dy", "dx", "w")))]
            alike: dict = {}
            for i, key in enumerate(zip(*(of(n).to_pylist() for n in PLANE[1:4]), taps)):
                alike.setdefault(key, []).append(i)
            ends, values = of("data").offsets.to_numpy(), of("data").values.to_numpy()
            out = [np.zeros(0)] * batch.num_rows
            for (h, w, c, own), rows in alike.items():
                if not h * w * c:
                    continue
                many = max(1, (1 << 20) // (h * w * c))
                for some in (rows[k : k + many] for k in range(0, len(rows), many)):
                    done = convolved(np.stack([values[ends[i] : ends[i + 1]].reshape(h, w, c) for i in some]), own, pad_mode)
                    for i, image in zip(some, done):
                        out[i] = image.ravel()
            data = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in out])).astype(np.int32)), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([*(of(n) for n in PLANE[:4]), data], PLANE)

    types = dict(met.dtypes)
    return met.mapInArrow(run, ", ".join(f"{n} {types[n]}" for n in PLANE))


def convolve_each(df: DataFrame, kernels: DataFrame, pad_mode: str = "zero") -> DataFrame:
    """Pixel rows ``(image_id, c, y, x, v)`` of plane rows, or of tiles, with a column ``kernel_id``, each convolved with its kernel.

    Images whose kernel is null or not in the table are left as they are. Of tiles only places to which a tap adds something
    have a row; see ``dense``."""
    if "ty" not in df.columns:
        return pixels(convolve_planes(df, kernels, pad_mode))
    sized = {"top": F.col("ty") * F.col("side"), "left": F.col("tx") * F.col("side"), "wide": F.least(F.col("side"), W() - F.col("tx") * F.col("side"))}
    met = _met(df.withColumns(sized), kernels)
    rows = met.select("image_id", "height", "width", "channels", "top", "left", "wide", "taps", "reach_y", "reach_x", F.posexplode("data").alias("p", "v"))
    p = F.col("p")
    rows = rows.withColumns({"c": p % C(), "sy": F.col("top") + div(p, F.col("wide") * C()), "sx": F.col("left") + div(p, C()) % F.col("wide")})
    rows = rows.withColumn("py", F.explode(shown_at(pad_mode, F.col("sy"), H(), F.col("reach_y")))).withColumn("px", F.explode(shown_at(pad_mode, F.col("sx"), W(), F.col("reach_x"))))
    spread = rows.select("image_id", "height", "width", "c", "py", "px", "v", F.explode("taps").alias("t"))
    spread = spread.select("image_id", "height", "width", "c", whole(F.col("py") + F.col("t.dy")).alias("y"), whole(F.col("px") + F.col("t.dx")).alias("x"), (F.col("v") * F.col("t.w")).alias("u"))
    inside = spread.where((F.col("y") >= 0) & (F.col("y") < H()) & (F.col("x") >= 0) & (F.col("x") < W()))
    sums = inside.groupBy("image_id", "c", "y", "x").agg(F.sum("u").alias("v"))
    return sums


def dense(sums: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixel rows with a 0 at places to which no tap added anything; ``sizes(image_id, height, width, channels)``."""
    count = lambda n: F.sequence(F.lit(0), n - 1)
    every = sizes.where((H() > 0) & (W() > 0) & (C() > 0)).select("image_id", "width", "channels", F.explode(count(H())).alias("y")).select("image_id", "channels", "y", F.explode(count(W())).alias("x")).select("image_id", F.explode(count(C())).alias("c"), "y", "x")
    return every.join(sums, ["image_id", "c", "y", "x"], "left").select("image_id", "c", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))
