"""Images larger than a row: tables of tiles, with the borders that a stencil reads exchanged by one keyed shuffle.

A tile row is ``image_id, height, width, channels, side, ty, tx, data``: the sizes are those of the whole image, ``data``
holds the pixels of the tile in row ``ty`` and column ``tx`` of the image's grid of ``side`` x ``side`` tiles (less at the
right and bottom). A task holds one tile with its border, whatever the image's size.

``stencil`` widens each tile by the stencil's reach: every tile sends each tile around it the strip which that one reads
(itself the whole), and one grouping by image and tile joins the strips. At the image's own border a widened tile ends
where the image ends, so the operators of ``stencils`` apply their border rule to it as to a whole image; what they
compute beyond the tile's own pixels is cut off.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import C, H, W, border, div, let, need_int, need_number, whole
from . import stencils as st

SIDE = 256
KEY = ["image_id", "ty", "tx"]
SIZES = ["height", "width", "channels", "side"]


def span(n: Column, side: Column, at: Column) -> tuple[Column, Column]:
    """First place and length of tile number ``at`` along an axis of ``n`` places."""
    return whole(at * side), whole(F.least(side, n - at * side))


def own_height() -> Column:
    return span(H(), F.col("side"), F.col("ty"))[1]


def own_width() -> Column:
    return span(W(), F.col("side"), F.col("tx"))[1]


def block(data: Column, width: Column, channels: Column, top: Column, left: Column, high: Column, wide: Column) -> Column:
    """The values of a rectangle of an array of rows of ``width`` pixels; ``high`` and ``wide`` are above 0. The array is
    bound once: it would be computed again for each line."""
    return let(data, lambda d: F.flatten(F.transform(F.sequence(top, top + high - 1), lambda y: F.slice(d, whole((y * width + left) * channels + 1), whole(wide * channels)))))


def tiled(df: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of plane rows. Images without pixels have no tiles."""
    need_int("side", side, 1)
    count = lambda n: F.sequence(F.lit(0), whole(F.ceil(n / side)) - 1)
    df = df.where((H() > 0) & (W() > 0) & (C() > 0)).withColumn("side", F.lit(side))
    rows = df.withColumn("ty", F.explode(count(H()))).withColumn("tx", F.explode(count(W())))
    (top, high), (left, wide) = span(H(), F.col("side"), F.col("ty")), span(W(), F.col("side"), F.col("tx"))
    return rows.select("image_id", *SIZES, "ty", "tx", block(F.col("data"), W(), C(), top, left, high, wide).alias("data"))


def tiles_of_pixels(rows: DataFrame, height, width, channels: int = 1, side: int = SIDE) -> DataFrame:
    """Tiles of pixel rows ``(image_id, c, y, x, v)`` of images of the given size; places without a row hold 0.

    The pixels of a tile meet in one task, never those of an image."""
    need_int("side", side, 1)
    sized = rows.where("v is not null").withColumns({"height": F.lit(height).cast("int"), "width": F.lit(width).cast("int"), "channels": F.lit(channels), "side": F.lit(side), "ty": div(F.col("y"), side), "tx": div(F.col("x"), side)})
    sized = sized.where((F.col("y") >= 0) & (F.col("y") < H()) & (F.col("x") >= 0) & (F.col("x") < W()) & (F.col("c") >= 0) & (F.col("c") < C()))
    place = whole(((F.col("y") % side) * own_width() + F.col("x") % side) * C() + F.col("c"))
    some = sized.select(*KEY, *SIZES, place.alias("p"), F.col("v").cast("double").alias("v")).groupBy(*KEY, *SIZES).agg(F.sort_array(F.collect_list(F.struct("p", "v"))).alias("s"))
    grid = some.select("image_id", *SIZES).distinct()
    count = lambda n: F.sequence(F.lit(0), whole(F.ceil(n / F.col("side"))) - 1)
    every = grid.withColumn("ty", F.explode(count(H()))).withColumn("tx", F.explode(count(W())))
    joined = every.join(some.select(*KEY, "s"), KEY, "left")
    size = whole(own_height() * own_width() * C())
    # gaps before each value, the value, and the gap after the last one
    gap = lambda n: F.array_repeat(F.lit(0.0), whole(n))
    filled = F.flatten(F.transform("s", lambda e, i: F.concat(gap(e["p"] - F.coalesce(F.get(F.col("s"), i - 1)["p"], F.lit(-1)) - 1), F.array(e["v"]))))
    tail = gap(size - 1 - F.element_at("s", -1)["p"])
    return joined.select("image_id", *SIZES, "ty", "tx", F.when(F.col("s").isNull(), gap(size)).otherwise(F.concat(filled, tail)).alias("data"))


def pixels_of_tiles(tiles: DataFrame, *more: str) -> DataFrame:
    """One row for each value of the tiles' ``data`` (and of further arrays of the same length) at its place in the image."""
    names = ["data", *more]
    rows = tiles.select("image_id", "channels", "side", "ty", "tx", own_width().alias("_w"), F.posexplode(F.arrays_zip(*names)).alias("p", "s"))
    p, w = F.col("p"), F.col("_w")
    place = {"c": p % C(), "y": F.col("ty") * F.col("side") + div(p, w * C()), "x": F.col("tx") * F.col("side") + div(p, C()) % w}
    return rows.select("image_id", *[whole(e).alias(n) for n, e in place.items()], F.col("s.data").alias("v"), *[F.col(f"s.{m}").alias(m) for m in more])


def untiled(tiles: DataFrame) -> DataFrame:
    """Plane rows of images whose tiles fit one row each."""
    rows = tiles.groupBy("image_id", *SIZES).agg(F.sort_array(F.collect_list(F.struct("ty", "tx", "data"))).alias("s"))
    line = lambda y: F.flatten(F.transform(F.filter("s", lambda t: t["ty"] == div(y, F.col("side"))), lambda t: F.slice(t["data"], whole((y % F.col("side")) * span(W(), F.col("side"), t["tx"])[1] * C() + 1), whole(span(W(), F.col("side"), t["tx"])[1] * C()))))
    return rows.select("image_id", "height", "width", "channels", F.flatten(F.transform(F.sequence(F.lit(0), H() - 1), line)).alias("data"))


def widened(tiles: DataFrame, reach_y: int, reach_x: int) -> DataFrame:
    """Tiles as plane rows ``(image_id, ty, tx, whole_height, whole_width, side, top, left, height, width, channels, data)``
    that reach so many pixels over each side, as far as the image goes. One shuffle, keyed by image and tile."""
    need_int("reach_y", reach_y, 0)
    need_int("reach_x", reach_x, 0)
    side = F.col("side")
    around = lambda at, n, reach: F.sequence(whole(F.greatest(F.lit(0), F.floor((at * side - reach) / side))), whole(F.least(F.ceil(n / side) - 1, F.floor(((at + 1) * side - 1 + reach) / side))))
    sent = tiles.withColumn("to_y", F.explode(around(F.col("ty"), H(), reach_y))).withColumn("to_x", F.explode(around(F.col("tx"), W(), reach_x)))

    def shared(n: Column, at: Column, to: Column, reach: int) -> tuple[Column, Column]:
        """First place (in the image) and length of what tile ``to`` reads of tile ``at``."""
        (a, own), (b, other) = span(n, side, at), span(n, side, to)
        first, last = F.greatest(a, b - reach), F.least(a + own, b + other + reach)
        return whole(first), whole(last - first)

    (y, high), (x, wide) = shared(H(), F.col("ty"), F.col("to_y"), reach_y), shared(W(), F.col("tx"), F.col("to_x"), reach_x)
    sent = sent.withColumns({"_y": y, "_x": x, "_h": high, "_w": wide}).where("_h > 0 and _w > 0")
    strip = block(F.col("data"), own_width(), C(), F.col("_y") - F.col("ty") * side, F.col("_x") - F.col("tx") * side, F.col("_h"), F.col("_w"))
    strip = F.when((F.col("to_y") == F.col("ty")) & (F.col("to_x") == F.col("tx")), F.col("data")).otherwise(strip)
    sent = sent.select("image_id", *SIZES, "to_y", "to_x", F.struct(F.col("_y").alias("y"), F.col("_x").alias("x"), F.col("_h").alias("h"), F.col("_w").alias("w"), strip.alias("d")).alias("s"))
    met = sent.groupBy("image_id", F.col("to_y").alias("ty"), F.col("to_x").alias("tx")).agg(*[F.first(c).alias(c) for c in SIZES], F.sort_array(F.collect_list("s")).alias("s"))  # the strips of a tile's neighbours
    (top, high), (left, wide) = span(H(), side, F.col("ty")), span(W(), side, F.col("tx"))
    ends = {"top": F.greatest(F.lit(0), top - reach_y), "left": F.greatest(F.lit(0), left - reach_x), "_bottom": F.least(H(), top + high + reach_y), "_right": F.least(W(), left + wide + reach_x)}
    met = met.withColumns({n: whole(e) for n, e in ends.items()})
    line = lambda y: F.flatten(F.transform(F.filter("s", lambda s: (s["y"] <= y) & (y < s["y"] + s["h"])), lambda s: F.slice(s["d"], whole((y - s["y"]) * s["w"] * C() + 1), whole(s["w"] * C()))))
    data = F.flatten(F.transform(F.sequence(F.col("top"), F.col("_bottom") - 1), line))
    return met.select(*KEY, H().alias("whole_height"), W().alias("whole_width"), "side", "top", "left", (F.col("_bottom") - F.col("top")).alias("height"), (F.col("_right") - F.col("left")).alias("width"), "channels", F.explode(F.array(data)).alias("data"))


def stencil(tiles: DataFrame, reach_y: int, reach_x: int, op: Callable[[DataFrame], DataFrame], *more: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tiles after an operator on plane rows whose values depend on pixels up to the given reach.

    ``more``: further arrays that the operator adds; ``keep``: further columns to be carried along."""
    wide = op(widened(tiles, reach_y, reach_x))
    side = F.col("side")
    (top, high), (left, across) = span(F.col("whole_height"), side, F.col("ty")), span(F.col("whole_width"), side, F.col("tx"))
    cut = lambda c: block(F.col(c), W(), C(), whole(top - F.col("top")), whole(left - F.col("left")), high, across)
    wide = wide.withColumns({c: cut(c) for c in ("data", *more)})
    return wide.select("image_id", F.col("whole_height").alias("height"), F.col("whole_width").alias("width"), "channels", "side", "ty", "tx", "data", *more, *keep)


def with_whole(tiles: DataFrame, **values: Callable[[Column], Column]) -> DataFrame:
    """Tiles with values of the whole image, each from an aggregate (min, max) of the tiles' own: numbers travel, not pixels."""
    own = tiles.select("image_id", F.array_min("data").alias("low"), F.array_max("data").alias("high")).groupBy("image_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    found = own.select("image_id", *[value(own).alias(name) for name, value in values.items()])
    return tiles.join(found, "image_id")


def pad_image(tiles: DataFrame, pad_h: int, pad_w: int, mode: str = "zero") -> DataFrame:
    """Tiles of the padded image: each new tile is joined with the tiles that it reads."""
    need_int("pad_h", pad_h, 0)
    need_int("pad_w", pad_w, 0)
    edge = border(mode)
    side = F.col("side")
    sizes = tiles.select("image_id", *SIZES).distinct()
    count = lambda n: F.sequence(F.lit(0), whole(F.ceil(n / side)) - 1)
    new_h, new_w = H() + 2 * pad_h, W() + 2 * pad_w
    grid = sizes.withColumns({"_h": new_h, "_w": new_w}).withColumn("ty", F.explode(count(F.col("_h")))).withColumn("tx", F.explode(count(F.col("_w"))))

    def source(n: Column, new: Column, at: Column, pad: int) -> Column:
        """For each place of the new tile the place along the axis that it shows; null where there is none."""
        first, own = span(new, side, at)
        return F.transform(F.sequence(first, first + own - 1), lambda e: whole(edge(e - pad, n)))

    grid = grid.withColumns({"_sy": source(H(), F.col("_h"), F.col("ty"), pad_h), "_sx": source(W(), F.col("_w"), F.col("tx"), pad_w)})
    of = lambda c: F.array_distinct(F.transform(F.filter(c, lambda s: s.isNotNull()), lambda s: div(s, side)))
    asked = grid.select("image_id", F.col("ty").alias("to_y"), F.col("tx").alias("to_x"), F.explode(of("_sy")).alias("ty"), "_sx", "side").select("image_id", "to_y", "to_x", "ty", F.explode(of("_sx")).alias("tx"))
    parts = asked.join(tiles.select(*KEY, own_width().alias("w"), "data"), KEY)
    parts = parts.groupBy("image_id", "to_y", "to_x").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("ty", "tx"), F.struct("w", "data")))).alias("m"))  # the tiles that a new tile reads
    met = grid.join(parts.withColumnsRenamed({"to_y": "ty", "to_x": "tx"}), KEY, "left")

    def line(y: Column) -> Column:
        def value(x: Column) -> Column:
            part = F.try_element_at(F.col("m"), F.struct(div(y, side).alias("ty"), div(x, side).alias("tx")))
            base = ((y % side) * part["w"] + x % side) * C()
            return F.transform(F.sequence(F.lit(0), C() - 1), lambda c: F.coalesce(F.get(part["data"], whole(base + c)), F.lit(0.0)))

        return F.flatten(F.transform("_sx", value))

    data = F.flatten(F.transform("_sy", line))
    return met.select("image_id", F.col("_h").alias("height"), F.col("_w").alias("width"), "channels", "side", "ty", "tx", data.alias("data"))


def _reach(kernel) -> tuple[int, int]:
    rows = st.checked_kernel(kernel)
    return len(rows) // 2, len(rows[0]) // 2


def convolve2d(tiles: DataFrame, kernel, pad_mode: str = "zero") -> DataFrame:
    return stencil(tiles, *_reach(kernel), lambda d: st.convolve2d(d, kernel, pad_mode))


def spatial_filter(tiles: DataFrame, kernel, pad_mode: str = "zero") -> DataFrame:
    return stencil(tiles, *_reach(kernel), lambda d: st.spatial_filter(d, kernel, pad_mode))


def mean_filter(tiles: DataFrame, ksize: int = 3, pad_mode: str = "reflect") -> DataFrame:
    need_int("ksize", ksize, 1)
    return stencil(tiles, ksize // 2, ksize // 2, lambda d: st.mean_filter(d, ksize, pad_mode))


def gaussian_filter(tiles: DataFrame, ksize: int = 5, sigma: float = 1.0, pad_mode: str = "reflect") -> DataFrame:
    return spatial_filter(tiles, st.gaussian_kernel(ksize, sigma), pad_mode)


def median_filter(tiles: DataFrame, ksize: int = 3) -> DataFrame:
    need_int("ksize", ksize, 1)
    return stencil(tiles, ksize // 2, ksize // 2, lambda d: st.median_filter(d, ksize))


def sobel_gradients(tiles: DataFrame, pad_mode: str = "reflect") -> DataFrame:
    """Adds gx, gy, magnitude and angle arrays."""
    return stencil(tiles, 1, 1, lambda d: st.sobel_gradients(d, pad_mode), "gx", "gy", "magnitude", "angle")


def morphological_op(tiles: DataFrame, kernel=None, op: str = "erode") -> DataFrame:
    kh, kw = (len(kernel), len(kernel[0]) if len(kernel) else 0) if kernel is not None else (3, 3)
    return stencil(tiles, kh // 2, kw // 2, lambda d: st.morphological_op(d, kernel, op))


def threshold_adaptive(tiles: DataFrame, block_size: int = 11, method: str = "mean", C: float = 2.0) -> DataFrame:  # noqa: N803
    """As the plane form: the largest value of the whole image decides the scale."""
    need_int("block_size", block_size, 1)
    need_number("C", C)
    sized = with_whole(tiles, _scale=lambda own: F.when(own["high"] <= 1, 255.0).otherwise(1.0))
    scaled = sized.select(*[F.transform("data", lambda v: v * F.col("_scale")).alias("data") if c == "data" else c for c in tiles.columns])
    return stencil(scaled, block_size // 2, block_size // 2, lambda d: st.above_local(d, block_size, method, C))


def unsharp_mask(tiles: DataFrame, ksize: int = 5, sigma: float = 1, amount: float = 1.5, pad_mode: str = "reflect") -> DataFrame:
    """As the plane form: clipped to the least and greatest value of the whole image."""
    sharp = stencil(tiles, ksize // 2, ksize // 2, lambda d: st.sharpened(d, ksize, sigma, amount, pad_mode))
    bounds = tiles.select("image_id", F.array_min("data").alias("low"), F.array_max("data").alias("high")).groupBy("image_id").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    met = sharp.join(bounds, "image_id")
    return met.select(*[F.transform("data", lambda v: F.least(F.col("_high"), F.greatest(F.col("_low"), v))).alias("data") if c == "data" else c for c in sharp.columns])
