"""Whole-image counts, tables of levels, and what follows from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.planes import DATA, C, by_image, channels_must_be, div, let, over_data, to_byte
from .pointwise import as_gray
from .stencils import sobel_gradients


def _positive(bins: int) -> None:
    if not isinstance(bins, int) or bins < 1:
        raise ValueError(f"bins must be a positive int, got {bins!r}")


def bin_of(v: Column, low, high, bins: int) -> Column:
    """Number of the equal bin that holds a value; the last one includes ``high``; null outside."""
    place = F.floor((v - low) / (high - low) * bins)
    return F.when((v >= low) & (v <= high), F.least(place, F.lit(bins - 1)).cast("int"))


def ends(values: Column, low, high, bins: int) -> Column:
    """For each bin how many of an array's values lie in it or in an earlier one: the bin numbers, each bin once more,
    are sorted, and a bin's last place is read off."""
    numbers = F.transform(values, lambda v: bin_of(v, low, high, bins))
    every = F.sequence(F.lit(0), F.lit(bins - 1))
    last = lambda own: F.filter(F.transform(own, lambda v, i: F.when(F.coalesce(F.get(own, i + 1) != v, F.lit(True)), i + 1)), lambda i: i.isNotNull())
    return F.transform(let(F.sort_array(F.concat(F.filter(numbers, lambda n: n.isNotNull()), every)), last), lambda e, b: (e - b - 1).cast("long"))


def counts(values: Column, low, high, bins: int) -> Column:
    """Array of the counts of an array's values by bin."""
    return let(ends(values, low, high, bins), lambda upto: F.transform(upto, lambda e, b: e - F.coalesce(F.get(upto, b - 1), F.lit(0).cast("long"))))


def histogram(df: DataFrame, bins: int = 256, range_: tuple[float, float] = (0, 256)) -> DataFrame:
    """(image_id, bin, lo, hi, count) of grey images, empty bins included: counted in the row, one row a bin afterwards."""
    _positive(bins)
    low, high = float(range_[0]), float(range_[1])

    def count(v: np.ndarray) -> tuple:
        v = v[(v >= low) & (v <= high)]
        return (np.bincount(np.minimum(np.floor((v - low) / (high - low) * bins), bins - 1).astype(np.int64), minlength=bins),)

    df = to_byte(channels_must_be(df, 1, "histogram"))
    # a null counts nowhere
    found = by_image(df.select("image_id", F.filter("data", lambda v: v.isNotNull()).alias("data")), count, counts="array<bigint>")
    step = (high - low) / bins
    out = found.select("image_id", F.posexplode("counts").alias("bin", "count"))
    return out.select("image_id", "bin", (low + F.col("bin") * step).alias("lo"), (low + (F.col("bin") + 1) * step).alias("hi"), "count")


def histogram_dataframe(df: DataFrame, bins: int = 256) -> DataFrame:
    """(image_id, bin, intensity, count, probability, cdf): the bin's centre, its share and the running share."""
    rows = histogram(df, bins)
    image = Window.partitionBy("image_id")
    total = F.sum("count").over(image)
    upto = F.sum("count").over(image.orderBy("bin"))
    share = lambda n: F.coalesce(n / F.nullif(total, F.lit(0)), F.lit(0.0))
    return rows.select("image_id", "bin", ((F.col("lo") + F.col("hi")) / 2).alias("intensity"), "count", share(F.col("count")).alias("probability"), share(upto).alias("cdf"))


def _levels(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of an image's values, and the number of its values by level."""
    level = np.clip(np.floor(np.nan_to_num(v, nan=0.0)), 0, 255).astype(np.int64)
    return level, np.bincount(level, minlength=256)


def _equalised(v: np.ndarray) -> tuple:
    level, n = _levels(v)
    upto = np.cumsum(n).astype(np.float64)
    first, size = upto[level.min()] if len(v) else 0.0, upto[-1]
    new = np.rint((upto - first) / (size - first) * 255) if size > first else np.zeros(256)
    return (new[level],)


def histogram_equalization(df: DataFrame) -> DataFrame:
    """Grey bytes spread over 0..255 by their running counts; a constant image becomes 0. An image's levels are counted and
    replaced in its row."""
    names = df.columns
    return by_image(to_byte(channels_must_be(df, 1, "histogram_equalization")), _equalised, data="array<double>").select(*names)


def _best_level(v: np.ndarray) -> tuple:
    _, n = _levels(v)
    c, q = np.cumsum(n).astype(np.float64), np.cumsum(n * np.arange(256)).astype(np.float64)
    inner = (c > 0) & (c < c[-1])
    between = np.zeros(256)
    between[inner] = (q * c[-1] - q[-1] * c)[inner] ** 2 / (c * (c[-1] - c))[inner]
    threshold = float(np.argmax(between))
    return np.where(v > threshold, 255.0, 0.0), threshold


def threshold_otsu(df: DataFrame) -> DataFrame:
    """Adds ``threshold``, the first level with the greatest variance between classes; data becomes 255 above it, else 0."""
    names = df.columns
    return by_image(to_byte(channels_must_be(df, 1, "threshold_otsu")), _best_level, data="array<double>", threshold="double").select(*names, "threshold")


def color_histogram(df: DataFrame, bins: int = 32, normalize: bool = True) -> DataFrame:
    """(image_id, vec): counts by channel over (0, 256), each divided by the channel's pixels."""
    _positive(bins)
    df = to_byte(df)

    def build() -> Column:
        channel = lambda c: F.filter(DATA(), lambda v, i: i % C() == c)
        size = F.size(DATA()) / C()
        share = lambda n: (n / size if normalize else n).cast("double")
        return F.flatten(F.transform(F.sequence(F.lit(0), C() - 1), lambda c: F.transform(counts(channel(c), 0.0, 256.0, bins), share)))

    return df.select("image_id", over_data(build).alias("vec"))


def gradient_hist(df: DataFrame, bins: int = 64) -> DataFrame:
    """(image_id, vec): shares of the gradient magnitudes by bin over (0, largest); gradients are summed row by row."""
    _positive(bins)
    df = sobel_gradients(as_gray(df))

    def shares(m: Column) -> Column:
        top = F.when(F.array_max(m) == 0, 1.0).otherwise(F.array_max(m))
        return let(top, lambda t: F.transform(counts(m, F.lit(0.0), t, bins), lambda n: n / F.size(m)))

    return df.select("image_id", let(F.col("magnitude"), shares).alias("vec"))


def hu_moments(df: DataFrame) -> DataFrame:
    """(image_id, vec): the seven invariants as sign * log10(abs + 1e-10); zeros for an empty image."""
    df = as_gray(df)
    w = F.col("width")
    powers = ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))
    moment = lambda f: F.aggregate(F.transform(DATA(), lambda v, i: v * f(div(i, w).cast("double"), (i % w).cast("double"))), F.lit(0.0), lambda a, v: a + v)

    def build() -> Column:
        first = F.struct(F.nullif(moment(lambda y, x: F.lit(1.0)), F.lit(0.0)).alias("m"), moment(lambda y, x: x).alias("x"), moment(lambda y, x: y).alias("y"))
        return let(first, lambda s: let(F.struct(s["m"].alias("m"), (s["x"] / s["m"]).alias("x"), (s["y"] / s["m"]).alias("y")), central))

    def central(s: Column) -> Column:
        eta = [moment(lambda y, x, p=p, q=q: F.pow(x - s["x"], p) * F.pow(y - s["y"], q)) / F.pow(s["m"], 1 + (p + q) / 2) for p, q in powers]
        return let(F.struct(*[e.alias(f"e{p}{q}") for e, (p, q) in zip(eta, powers)]), invariants)

    def invariants(s: Column) -> Column:
        e20, e02, e11, e30, e03, e21, e12 = (s[f"e{p}{q}"] for p, q in powers)
        a, b, c, d = e30 + e12, e21 + e03, e30 - 3 * e12, 3 * e21 - e03
        hu = [
            e20 + e02,
            (e20 - e02) * (e20 - e02) + 4 * e11 * e11,
            c * c + d * d,
            a * a + b * b,
            c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
            (e20 - e02) * (a * a - b * b) + 4 * e11 * a * b,
            d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
        ]
        return F.array(*[F.coalesce(F.signum(h) * F.log10(F.abs(h) + 1e-10), F.lit(0.0)) for h in hu])

    return df.select("image_id", over_data(build).alias("vec"))
