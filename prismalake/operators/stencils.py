"""Neighbourhood operators. Kernels that are an outer product run as two one-dimensional passes.

Box sums and extremes take two passes whose cost does not depend on the window: each line is cut into blocks as long as
the window, and a window is the end of one block and the beginning of the next. Medians run a histogram along each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.medians import by_shape, running_medians
from ..functions.planes import DATA, C, H, W, at, border, channels_must_be, div, grey_or_colour, grid, let, need_int, need_number, over_data, put, to_byte, whole


def pad_image(df: DataFrame, pad_h: int, pad_w: int, mode: str = "zero") -> DataFrame:
    need_int("pad_h", pad_h, 0)
    need_int("pad_w", pad_w, 0)
    edge = border(mode)
    data = grid(H() + 2 * pad_h, W() + 2 * pad_w, C(), lambda y, x, c: F.coalesce(at(edge(y - pad_h, H()), edge(x - pad_w, W()), c), F.lit(0.0)))
    return put(put(df, data=data), height=H() + 2 * pad_h, width=W() + 2 * pad_w)


def _odd(name: str, value: int) -> None:
    need_int(name, value, 1)
    if value % 2 == 0:
        raise ValueError(f"{name} must be odd, got {value}")


def checked_kernel(kernel) -> list[list[float]]:
    rows = [list(r) for r in kernel]
    if not rows or not rows[0]:
        raise ValueError("kernel is empty")
    if any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("kernel must be two-dimensional")
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "__float__") for r in rows for v in r):
        raise TypeError("kernel must be numeric")
    if len(rows) % 2 == 0 or len(rows[0]) % 2 == 0:
        raise ValueError("kernel sides must be odd")
    return [[float(v) for v in r] for r in rows]


def separated(kernel: list[list[float]]) -> tuple[list[float], list[float]] | None:
    """Column and row whose products are the kernel, if there are any."""
    i, j = max(((i, j) for i in range(len(kernel)) for j in range(len(kernel[0]))), key=lambda p: abs(kernel[p[0]][p[1]]))
    top = kernel[i][j]
    if top == 0:
        return None
    column, row = [r[j] / top for r in kernel], kernel[i]
    close = all(abs(column[a] * row[b] - kernel[a][b]) <= 1e-12 * abs(top) for a in range(len(kernel)) for b in range(len(row)))
    return (column, row) if close else None


def _weighted(taps: list[tuple[int, int, float]], edge) -> Column:
    def value(y, x, c):
        terms = [w * F.coalesce(at(edge(y + dy, H()) if dy else y, edge(x + dx, W()) if dx else x, c), F.lit(0.0)) for dy, dx, w in taps if w]
        return reduce(lambda a, b: a + b, terms, F.lit(0.0))

    return grid(H(), W(), C(), value)


def _correlate(df: DataFrame, kernel: list[list[float]], pad_mode: str) -> DataFrame:
    edge, kh, kw = border(pad_mode), len(kernel), len(kernel[0])
    parts = separated(kernel) if kh > 1 and kw > 1 else None
    if parts:
        column, row = parts
        df = put(df, data=_weighted([(i - kh // 2, 0, w) for i, w in enumerate(column)], edge))
        return put(df, data=_weighted([(0, j - kw // 2, w) for j, w in enumerate(row)], edge))
    return put(df, data=_weighted([(i - kh // 2, j - kw // 2, w) for i, r in enumerate(kernel) for j, w in enumerate(r)], edge))


def convolve2d(df: DataFrame, kernel, pad_mode: str = "zero") -> DataFrame:
    """True convolution of grey images (the kernel is turned by 180 degrees), same size."""
    return spatial_filter(channels_must_be(df, 1, "convolve2d"), kernel, pad_mode)


def spatial_filter(df: DataFrame, kernel, pad_mode: str = "zero") -> DataFrame:
    """The same for each channel of grey or colour images by itself."""
    return _correlate(grey_or_colour(df, "spatial_filter"), [r[::-1] for r in checked_kernel(kernel)[::-1]], pad_mode)


def _scan(block: Column, f: Callable) -> Column:
    """``f`` over the values from the first up to each."""
    return F.aggregate(F.slice(block, F.lit(2), F.greatest(F.lit(1), F.size(block))), F.slice(block, 1, 1), lambda a, v: F.array_append(a, f(F.element_at(a, -1), v)))


def _along(data: Column, lines: Column, length: Column, base: Callable, step: Column, k: int, edge: Callable, f: Callable, twice: bool) -> Column:
    """Line after line, ``f`` over the windows of ``k`` values around each; line l is the values at ``base(l) + i * step``.

    ``twice``: a value may count twice (least, greatest); else windows that are one whole block are taken by themselves."""
    r = k // 2
    source = F.transform(F.sequence(F.lit(-r), whole(length) - 1 + r), lambda e: whole(edge(e, length)))
    starts = F.sequence(F.lit(1), whole(length) + 2 * r, F.lit(k))

    def windows(parts: Column) -> Column:
        inside = lambda i: f(F.get(parts["after"], i), F.get(parts["upto"], i + k - 1))
        value = inside if twice else lambda i: F.when(i % k == 0, F.get(parts["after"], i)).otherwise(inside(i))
        return F.transform(F.sequence(F.lit(0), whole(length) - 1), value)

    def line(places: Column, n: Column) -> Column:
        values = F.transform(places, lambda s: F.coalesce(F.get(data, whole(base(n) + s * step)), F.lit(0.0)))
        blocks = let(values, lambda v: F.transform(starts, lambda i: F.slice(v, i, F.lit(k))))
        scans = let(blocks, lambda b: F.struct(F.flatten(F.transform(b, lambda x: _scan(x, f))).alias("upto"), F.flatten(F.transform(b, lambda x: F.reverse(_scan(F.reverse(x), f)))).alias("after")))
        return let(scans, windows)

    return let(source, lambda places: F.flatten(F.transform(F.sequence(F.lit(0), whole(lines) - 1), lambda n: line(places, n))))


def _windowed(df: DataFrame, kh: int, kw: int, mode: str, f: Callable, twice: bool) -> DataFrame:
    """``f`` over the rectangle of ``kh`` x ``kw`` values around each: columns first, then rows."""
    edge = border(mode)
    full = H() * W() * C() > 0
    down = over_data(lambda: _along(DATA(), W() * C(), H(), lambda n: n, W() * C(), kh, edge, f, twice))
    df = put(df, data=F.when(full, down).otherwise(DATA()))
    across = over_data(lambda: _along(DATA(), H() * C(), W(), lambda n: (n % C()) * H() + div(n, C()), C() * H(), kw, edge, f, twice))
    df = put(df, data=F.when(full, across).otherwise(DATA()))
    ordered = grid(H(), W(), C(), lambda y, x, c: F.get(DATA(), whole((y * C() + c) * W() + x)))
    return put(df, data=F.when(C() == 1, DATA()).otherwise(ordered))


def mean_filter(df: DataFrame, ksize: int = 3, pad_mode: str = "reflect") -> DataFrame:
    _odd("ksize", ksize)
    sums = _windowed(grey_or_colour(df, "mean_filter"), ksize, ksize, pad_mode, lambda a, b: a + b, False)
    return put(sums, data=F.transform("data", lambda v: v / float(ksize * ksize)))


def gaussian_kernel(ksize: int, sigma: float) -> list[list[float]]:
    _odd("ksize", ksize)
    need_number("sigma", sigma, 0)
    r = ksize // 2
    raw = [[math.exp(-(x * x + y * y) / (2 * sigma * sigma)) for x in range(-r, r + 1)] for y in range(-r, r + 1)]
    total = sum(map(sum, raw))
    return [[v / total for v in row] for row in raw]


def gaussian_filter(df: DataFrame, ksize: int = 5, sigma: float = 1.0, pad_mode: str = "reflect") -> DataFrame:
    return spatial_filter(df, gaussian_kernel(ksize, sigma), pad_mode)


def median_filter(df: DataFrame, ksize: int = 3) -> DataFrame:
    """Middle of the neighbourhood, borders repeated."""
    _odd("ksize", ksize)
    return by_shape(grey_or_colour(df, "median_filter"), lambda images: running_medians(images, ksize))


def above_local(df: DataFrame, block_size: int, method: str, C: float) -> DataFrame:  # noqa: N803
    """``threshold_adaptive`` of grey images that are on the scale of bytes."""
    _odd("block_size", block_size)
    if method not in ("mean", "gaussian"):
        raise ValueError(f"unknown method {method!r}; mean or gaussian")
    df = put(df, _own=DATA())
    local = mean_filter(df, block_size) if method == "mean" else gaussian_filter(df, block_size, block_size / 6.0)
    return put(local, data=F.zip_with("_own", "data", lambda v, m: F.when(v > m - float(C), 255.0).otherwise(0.0))).drop("_own")


def threshold_adaptive(df: DataFrame, block_size: int = 11, method: str = "mean", C: float = 2.0) -> DataFrame:  # noqa: N803
    """255 where a value exceeds its neighbourhood's mean (or Gaussian mean) less ``C``, else 0."""
    return above_local(to_byte(channels_must_be(df, 1, "threshold_adaptive")), block_size, method, C)


def sobel_gradients(df: DataFrame, pad_mode: str = "reflect") -> DataFrame:
    """Adds gx, gy, magnitude and angle (degrees in [0, 90]) arrays to grey images."""
    df = channels_must_be(df, 1, "sobel_gradients")
    edge = border(pad_mode)
    kx = [[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]]
    ky = [[-1, -2, -1], [0, 0, 0], [1, 2, 1]]
    turned = lambda k: [(i - 1, j - 1, float(k[2 - i][2 - j])) for i in range(3) for j in range(3)]
    df = put(df, gx=_weighted(turned(kx), edge), gy=_weighted(turned(ky), edge))
    return put(df, magnitude=F.zip_with("gx", "gy", lambda a, b: F.sqrt(a * a + b * b)), angle=F.zip_with("gx", "gy", lambda a, b: F.degrees(F.atan2(F.abs(b), F.abs(a)))))


def sharpened(df: DataFrame, ksize: int, sigma: float, amount: float, pad_mode: str) -> DataFrame:
    """Values plus ``amount`` times what the Gaussian takes away, not yet clipped."""
    if amount < 0:
        raise ValueError("amount must not be negative")
    soft = gaussian_filter(put(df, _raw=DATA()), ksize, sigma, pad_mode)
    return put(soft, data=F.zip_with("_raw", "data", lambda v, b: v + float(amount) * (v - b))).drop("_raw")


def unsharp_mask(df: DataFrame, ksize: int = 5, sigma: float = 1, amount: float = 1.5, pad_mode: str = "reflect") -> DataFrame:
    sharp = sharpened(put(df, _low=F.array_min(DATA()), _high=F.array_max(DATA())), ksize, sigma, amount, pad_mode)
    return put(sharp, data=F.transform("data", lambda v: F.least(F.col("_high"), F.greatest(F.col("_low"), v)))).drop("_low", "_high")


def morphological_op(df: DataFrame, kernel=None, op: str = "erode") -> DataFrame:
    """Least or greatest value in the kernel's rectangle, borders repeated; two passes."""
    if op not in ("erode", "dilate"):
        raise ValueError(f"unknown op {op!r}; erode or dilate")
    kernel = [[1] * 3] * 3 if kernel is None else kernel
    kh, kw = len(kernel), len(kernel[0]) if len(kernel) else 0
    if not kh * kw or kh % 2 == 0 or kw % 2 == 0:
        raise ValueError("kernel sides must be odd")
    return _windowed(channels_must_be(df, 1, "morphological_op"), kh, kw, "replicate", F.least if op == "erode" else F.greatest, True)
