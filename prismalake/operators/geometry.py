"""Backward-mapped transforms: every target pixel is a gather from its source place."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import C, H, W, at, grid, need_int, need_number, put

METHODS = ("nearest", "bilinear")


def sample(y: Column, x: Column, c: Column, method: str) -> Column:
    """Value at a real place: nearest rounds half to even; bilinear weighs four places; indices stay inside."""
    if method not in METHODS:
        raise ValueError(f"unknown interpolation {method!r}; nearest or bilinear")
    inside = lambda e, n: F.greatest(F.lit(0), F.least(n - 1, e.cast("int")))
    if method == "nearest":
        return at(inside(F.rint(y), H()), inside(F.rint(x), W()), c)
    y0, x0 = F.floor(y), F.floor(x)
    fy, fx = y - y0, x - x0
    v = lambda a, b: at(inside(a, H()), inside(b, W()), c)
    return (1 - fy) * (1 - fx) * v(y0, x0) + (1 - fy) * fx * v(y0, x0 + 1) + fy * (1 - fx) * v(y0 + 1, x0) + fy * fx * v(y0 + 1, x0 + 1)


def resize(df: DataFrame, new_h: int, new_w: int, interpolation: str = "bilinear") -> DataFrame:
    """Corners keep their places; a single row or column takes the first one."""
    need_int("new_h", new_h, 1)
    need_int("new_w", new_w, 1)
    scale = lambda i, n, m: i * (n - 1).cast("double") / float(max(m - 1, 1))
    data = grid(F.lit(new_h), F.lit(new_w), C(), lambda y, x, c: sample(scale(y, H(), new_h), scale(x, W(), new_w), c, interpolation))
    return put(put(df, data=data), height=F.lit(new_h), width=F.lit(new_w))


def rotate(df: DataFrame, angle: float, interpolation: str = "bilinear", fill_value: float = 0.0) -> DataFrame:
    """About the middle on the same canvas; a positive angle turns clockwise on the screen."""
    need_number("angle", angle)
    cos, sin = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    cy, cx = (H() - 1) / 2.0, (W() - 1) / 2.0

    def value(y, x, c):
        sx, sy = cos * (x - cx) + sin * (y - cy) + cx, -sin * (x - cx) + cos * (y - cy) + cy
        ok = (sx >= 0) & (sx <= W() - 1) & (sy >= 0) & (sy <= H() - 1)
        return F.when(ok, sample(sy, sx, c, interpolation)).otherwise(float(fill_value))

    return put(df, data=grid(H(), W(), C(), value))


def translate(df: DataFrame, tx: int, ty: int, fill_value: float = 0.0) -> DataFrame:
    need_int("tx", tx)
    need_int("ty", ty)
    inside = lambda y, x: (y >= 0) & (y < H()) & (x >= 0) & (x < W())
    return put(df, data=grid(H(), W(), C(), lambda y, x, c: F.when(inside(y - ty, x - tx), at(y - ty, x - tx, c)).otherwise(float(fill_value))))
