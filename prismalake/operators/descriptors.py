"""Block and texture descriptors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import DATA, H, W, div, let, need_int, over_data, put, whole
from .histograms import counts
from .pointwise import as_gray
from .stencils import sobel_gradients


def hog(df: DataFrame, cell_size: int = 8, block_size: int = 2, n_bins: int = 9) -> DataFrame:
    """(image_id, vec): magnitude-weighted angle histograms of cells, normalised over overlapping blocks; all in the row."""
    for name, v in (("cell_size", cell_size), ("block_size", block_size), ("n_bins", n_bins)):
        need_int(name, v, 1)
    df = sobel_gradients(as_gray(df))
    bins = F.transform("angle", lambda a: F.least(F.floor(a.cast("float") / (180.0 / n_bins)), F.lit(n_bins - 1)).cast("int"))
    df = put(df, _g=F.arrays_zip(bins.alias("b"), F.col("magnitude").alias("m")), _ny=div(H(), cell_size), _nx=div(W(), cell_size))
    df = put(df, _by=F.col("_ny") - block_size + 1, _bx=F.col("_nx") - block_size + 1)
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def cell(g: Column, k: Column) -> Column:
        """Sums of magnitudes by bin over the pixels of cell k, line by line."""
        top, left = div(k, F.col("_nx")) * cell_size, (k % F.col("_nx")) * cell_size
        own = F.flatten(F.transform(upto(F.lit(cell_size)), lambda y: F.slice(g, whole((top + y) * W() + left + 1), F.lit(cell_size))))
        return let(own, lambda some: F.transform(upto(F.lit(n_bins)), lambda b: F.aggregate(some, F.lit(0.0), lambda a, p: a + F.when(p["b"] == b, p["m"]).otherwise(0.0))))

    def block(cells: Column, k: Column) -> Column:
        top, left = div(k, F.col("_bx")), k % F.col("_bx")
        own = F.flatten(F.transform(upto(F.lit(block_size)), lambda y: F.flatten(F.slice(cells, whole((top + y) * F.col("_nx") + left + 1), F.lit(block_size)))))
        return let(own, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)) + 1e-6, lambda n: F.transform(v, lambda x: x / n)))

    cells = let(F.col("_g"), lambda g: F.transform(upto(F.col("_ny") * F.col("_nx")), lambda k: cell(g, k)))
    blocks = let(cells, lambda c: F.flatten(F.transform(upto(F.col("_by") * F.col("_bx")), lambda k: block(c, k))))
    none = F.array_repeat(F.lit(0.0), n_bins)
    return df.select("image_id", F.when((F.col("_by") > 0) & (F.col("_bx") > 0), blocks).otherwise(none).alias("vec"))


def lbp(df: DataFrame, radius: int = 1, n_points: int = 8, bins: int = 64) -> DataFrame:
    """(image_id, vec): shares of the counts of neighbours on a circle that are not darker than the centre.

    For each point on the circle a table by row and one by column, made once an image, hold the two places and the weight
    between which it lies; each pixel looks up both."""
    if radius < 1:
        raise ValueError("radius must be at least 1")
    if n_points < 2:
        raise ValueError("n_points must be at least 2")
    df = as_gray(df)
    angles = [2 * math.pi * p / n_points for p in range(n_points)]
    upto = lambda n: F.sequence(F.lit(0), n - 1)

    def axis(offset: float, n: Column, step: Column) -> Column:
        inside = lambda e: whole(F.greatest(F.lit(0), F.least(n - 1, whole(e))) * step)
        at_ = lambda s: let(F.floor(s), lambda low: F.struct(inside(low).alias("a"), inside(low + 1).alias("b"), (s - low).alias("f")))
        return F.transform(upto(n), lambda i: let(i + F.lit(offset), at_))

    tables = F.array(*[F.struct(axis(radius * math.sin(a), H(), W()).alias("y"), axis(radius * math.cos(a), W(), F.lit(1)).alias("x")) for a in angles])

    def near(data: Column, r: Column, c: Column) -> Column:
        v = lambda i, j: F.get(data, whole(r[i] + c[j]))
        fy, fx = r["f"], c["f"]
        return (1 - fy) * (1 - fx) * v("a", "a") + (1 - fy) * fx * v("a", "b") + fy * (1 - fx) * v("b", "a") + fy * fx * v("b", "b")

    def code(data: Column, points: Column, y: Column, x: Column, centre: Column) -> Column:
        both = lambda t: F.struct(F.get(t["y"], y).alias("r"), F.get(t["x"], x).alias("c"))
        return F.size(F.filter(points, lambda t: let(both(t), lambda s: near(data, s["r"], s["c"]) >= centre))).cast("double")

    df = put(df, _points=tables)
    codes = let(F.struct(F.col("data").alias("d"), F.col("_points").alias("t")), lambda s: F.transform(s["d"], lambda v, i: code(s["d"], s["t"], div(i, W()), i % W(), v)))
    df = put(df, data=codes)
    shares = lambda: F.transform(counts(DATA(), 0.0, float(n_points + 1), bins), lambda n: n / F.size(DATA()))
    return df.select("image_id", over_data(shares).alias("vec"))
