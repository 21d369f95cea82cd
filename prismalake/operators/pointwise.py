"""Colour, normalisation and per-pixel operators on plane rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.planes import DATA, C, H, W, at, channels_must_be, each, grid, largest, let, need_int, put, to_unit


def rgb_to_gray(df: DataFrame) -> DataFrame:
    """0.2989 R + 0.5870 G + 0.1140 B of images of three channels, in [0, 1]."""
    df = to_unit(channels_must_be(df, 3, "rgb_to_gray"))
    zero, one, two = F.lit(0), F.lit(1), F.lit(2)
    gray = grid(H(), W(), one, lambda y, x, c: 0.2989 * at(y, x, zero) + 0.5870 * at(y, x, one) + 0.1140 * at(y, x, two))
    return put(put(df, data=gray), channels=F.lit(1))


def as_gray(df: DataFrame) -> DataFrame:
    """Grey values in [0, 1] of images of one or three channels."""
    gray = grid(H(), W(), F.lit(1), lambda y, x, c: F.when(C() == 1, at(y, x, F.lit(0))).otherwise(0.2989 * at(y, x, F.lit(0)) + 0.5870 * at(y, x, F.lit(1)) + 0.1140 * at(y, x, F.lit(2))))
    return put(put(to_unit(df), data=gray), channels=F.lit(1))


def to_u8(value, floating: bool):
    """Bytes: real values times 255 and clipped, whole ones modulo 256; fractions are cut off."""
    if floating:
        return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), value * 255.0)))
    return F.pmod(F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)), F.lit(256))


def gray_to_rgb(df: DataFrame, floating: bool = False) -> DataFrame:
    """Grey images as bytes in three equal channels."""
    df = channels_must_be(df, 1, "gray_to_rgb")
    return put(df, data=F.flatten(F.transform(DATA(), lambda v: F.array_repeat(to_u8(v, floating).cast("double"), 3))), channels=F.lit(3))


def normalize(df: DataFrame, mode: str = "minmax", *, new_min: float = 0.0, new_max: float = 1.0, mean: float | None = None, std: float | None = None, fixed_min: float = 0, fixed_max: float = 255) -> DataFrame:
    if mode == "minmax":
        if new_min >= new_max:
            raise ValueError("new_min must be less than new_max")
        place = lambda v, lo, hi: F.when(hi == lo, F.lit(float(new_min))).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * float(new_max - new_min) + float(new_min))
        return put(df, data=each(place, lambda: F.array_min(DATA()), lambda: F.array_max(DATA())))
    if mode == "zscore":
        total = lambda f: F.aggregate(DATA(), F.lit(0.0), lambda a, v: a + f(v))
        middle = lambda: F.lit(float(mean)) if mean is not None else total(lambda v: v) / F.size(DATA())
        spread = lambda: F.lit(float(std)) if std is not None else let(middle(), lambda m: F.sqrt(total(lambda v: (v - m) * (v - m)) / F.size(DATA())))
        return put(df, data=each(lambda v, m, s: F.when(s == 0, F.lit(0.0)).otherwise((v - m) / F.nullif(s, F.lit(0.0))), middle, spread))
    if mode == "fixed":
        if fixed_min >= fixed_max:
            raise ValueError("fixed_min must be less than fixed_max")
        a, b = float(fixed_min), float(fixed_max)
        return put(df, data=each(lambda v: (F.least(F.lit(b), F.greatest(F.lit(a), v)) - a) / (b - a)))
    raise ValueError(f"unknown mode {mode!r}; minmax, zscore or fixed")


def clip_pixels(df: DataFrame, low: float = 0, high: float = 255, whole_numbers: bool = False) -> DataFrame:
    """Values between the bounds; of whole numbers fractions are cut off afterwards."""
    if low >= high:
        raise ValueError("low must be less than high")
    cut = (lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))) if whole_numbers else (lambda v: v)
    return put(df, data=each(lambda v: cut(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))))


def threshold_global(df: DataFrame, thresh: float, max_val: float = 255) -> DataFrame:
    return put(channels_must_be(df, 1, "threshold_global"), data=each(lambda v: F.when(v > float(thresh), float(max_val)).otherwise(0.0))).select(*df.columns)


def bit_plane_slice(df: DataFrame, bit: int, floating: bool = False) -> DataFrame:
    """255 where the bit of the value's byte is set, else 0."""
    need_int("bit", bit, 0)
    if bit > 7:
        raise ValueError("bit must be in 0..7")
    df = channels_must_be(df, 1, "bit_plane_slice")
    return put(df, data=each(lambda v: F.shiftright(to_u8(v, floating).cast("int"), bit).bitwiseAND(1) * 255))


def bit_plane_all(df: DataFrame, floating: bool = False) -> DataFrame:
    """All planes, one row each, numbered in ``bit``."""
    df = channels_must_be(df, 1, "bit_plane_all").withColumn("bit", F.explode(F.array(*[F.lit(b) for b in range(8)])))
    return put(df, data=each(lambda v: to_u8(v, floating).cast("int").bitwiseAND(F.pow(F.lit(2.0), F.col("bit")).cast("int")).cast("boolean").cast("int") * 255))


def image_max(df: DataFrame) -> DataFrame:
    return df.select("image_id", largest().alias("max"))
