"""Drawing: a shape is a condition on pixel places, overlaid on the canvas; parts beyond the canvas are cut off.

Shapes are drawn in the order of the calls, the last one wins. ``draw_rectangle`` moves corners onto the canvas before it
draws, so that outlines partly beyond it run along its border; with ``clamp=False`` they are cut off.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import DATA, C, H, W, at, div, grid, need_int, over_data, put, whole

# The 5 x 7 font, seven rows of five bits for each character, leftmost pixel first.
FONT: dict[str, list[int]] = {
    " ": [0b00000] * 7,
    "A": [0b01110, 0b10001, 0b10001, 0b11111, 0b10001, 0b10001, 0b10001],
    "B": [0b11110, 0b10001, 0b10001, 0b11110, 0b10001, 0b10001, 0b11110],
    "C": [0b01110, 0b10001, 0b10000, 0b10000, 0b10000, 0b10001, 0b01110],
    "D": [0b11110, 0b10001, 0b10001, 0b10001, 0b10001, 0b10001, 0b11110],
    "E": [0b11111, 0b10000, 0b10000, 0b11110, 0b10000, 0b10000, 0b11111],
    "F": [0b11111, 0b10000, 0b10000, 0b11110, 0b10000, 0b10000, 0b10000],
    "G": [0b01110, 0b10001, 0b10000, 0b10111, 0b10001, 0b10001, 0b01110],
    "H": [0b10001, 0b10001, 0b10001, 0b11111, 0b10001, 0b10001, 0b10001],
    "I": [0b01110, 0b00100, 0b00100, 0b00100, 0b00100, 0b00100, 0b01110],
    "J": [0b00111, 0b00010, 0b00010, 0b00010, 0b00010, 0b10010, 0b01100],
    "K": [0b10001, 0b10010, 0b10100, 0b11000, 0b10100, 0b10010, 0b10001],
    "L": [0b10000, 0b10000, 0b10000, 0b10000, 0b10000, 0b10000, 0b11111],
    "M": [0b10001, 0b11011, 0b10101, 0b10001, 0b10001, 0b10001, 0b10001],
    "N": [0b10001, 0b11001, 0b10101, 0b10011, 0b10001, 0b10001, 0b10001],
    "O": [0b01110, 0b10001, 0b10001, 0b10001, 0b10001, 0b10001, 0b01110],
    "P": [0b11110, 0b10001, 0b10001, 0b11110, 0b10000, 0b10000, 0b10000],
    "Q": [0b01110, 0b10001, 0b10001, 0b10001, 0b10101, 0b10010, 0b01101],
    "R": [0b11110, 0b10001, 0b10001, 0b11110, 0b10100, 0b10010, 0b10001],
    "S": [0b01110, 0b10001, 0b10000, 0b01110, 0b00001, 0b10001, 0b01110],
    "T": [0b11111, 0b00100, 0b00100, 0b00100, 0b00100, 0b00100, 0b00100],
    "U": [0b10001, 0b10001, 0b10001, 0b10001, 0b10001, 0b10001, 0b01110],
    "V": [0b10001, 0b10001, 0b10001, 0b10001, 0b10001, 0b01010, 0b00100],
    "W": [0b10001, 0b10001, 0b10001, 0b10101, 0b10101, 0b11011, 0b10001],
    "X": [0b10001, 0b01010, 0b00100, 0b00100, 0b00100, 0b01010, 0b10001],
    "Y": [0b10001, 0b01010, 0b00100, 0b00100, 0b00100, 0b00100, 0b00100],
    "Z": [0b11111, 0b00001, 0b00010, 0b00100, 0b01000, 0b10000, 0b11111],
    "0": [0b01110, 0b10001, 0b10011, 0b10101, 0b11001, 0b10001, 0b01110],
    "1": [0b00100, 0b01100, 0b00100, 0b00100, 0b00100, 0b00100, 0b01110],
    "2": [0b01110, 0b10001, 0b00001, 0b00110, 0b01000, 0b10000, 0b11111],
    "3": [0b11111, 0b00001, 0b00010, 0b00110, 0b00001, 0b10001, 0b01110],
    "4": [0b00010, 0b00110, 0b01010, 0b10010, 0b11111, 0b00010, 0b00010],
    "5": [0b11111, 0b10000, 0b11110, 0b00001, 0b00001, 0b10001, 0b01110],
    "6": [0b00110, 0b01000, 0b10000, 0b11110, 0b10001, 0b10001, 0b01110],
    "7": [0b11111, 0b00001, 0b00010, 0b00100, 0b01000, 0b01000, 0b01000],
    "8": [0b01110, 0b10001, 0b10001, 0b01110, 0b10001, 0b10001, 0b01110],
    "9": [0b01110, 0b10001, 0b10001, 0b01111, 0b00001, 0b00010, 0b01100],
    ".": [0b00000, 0b00000, 0b00000, 0b00000, 0b00000, 0b01100, 0b01100],
    ",": [0b00000, 0b00000, 0b00000, 0b00000, 0b01100, 0b01100, 0b01000],
    "!": [0b00100, 0b00100, 0b00100, 0b00100, 0b00000, 0b00000, 0b00100],
    "?": [0b01110, 0b10001, 0b00001, 0b00110, 0b00100, 0b00000, 0b00100],
    ":": [0b00000, 0b01100, 0b01100, 0b00000, 0b01100, 0b01100, 0b00000],
    "-": [0b00000, 0b00000, 0b00000, 0b11111, 0b00000, 0b00000, 0b00000],
    "_": [0b00000, 0b00000, 0b00000, 0b00000, 0b00000, 0b00000, 0b11111],
    "/": [0b00001, 0b00010, 0b00100, 0b00100, 0b01000, 0b10000, 0b10000],
    "(": [0b00100, 0b01000, 0b10000, 0b10000, 0b10000, 0b01000, 0b00100],
    ")": [0b00100, 0b00010, 0b00001, 0b00001, 0b00001, 0b00010, 0b00100],
}


def _colour(color) -> Callable[[Column], Column]:
    if isinstance(color, (int, float)):
        return lambda c: F.when(C() == 1, F.lit(float(color))).otherwise(F.raise_error(F.lit("a colour of three values is needed")).cast("double"))
    values = [float(v) for v in color]
    if len(values) != 3:
        raise TypeError("a colour has one or three values")
    return lambda c: F.when(C() == 3, F.get(F.array(*map(F.lit, values)), c)).otherwise(F.raise_error(F.lit("a colour of one value is needed")).cast("double"))


def overlay(df: DataFrame, inside: Callable[[Column, Column], Column], color, lines: tuple[int, int] | None = None) -> DataFrame:
    """The colour where ``inside(y, x)`` holds; ``lines``: first and last line that the shape reaches, others are copied."""
    of = _colour(color)
    if lines is None:
        return put(df, data=grid(H(), W(), C(), lambda y, x, c: F.when(inside(y, x), of(c)).otherwise(at(y, x, c))))
    across = W() * C()
    upto = lambda y: whole(F.greatest(F.lit(0), F.least(H(), F.lit(y))) * across)
    first, end = upto(lines[0]), upto(lines[1] + 1)
    places = F.when(first < end, F.sequence(first, end - 1)).otherwise(F.array().cast("array<int>"))

    def build() -> Column:
        value = lambda i: F.when(inside(div(i, across), div(i, C()) % W()), of(i % C())).otherwise(F.get(DATA(), i))
        return F.concat(F.slice(DATA(), F.lit(1), first), F.transform(places, value), F.slice(DATA(), end + 1, whole(H() * across) - end))

    return put(df, data=over_data(build))


def draw_point(df: DataFrame, x: int, y: int, color=255, radius: int = 1) -> DataFrame:
    """A disc of squared distance below the squared radius."""
    need_int("radius", radius, 1)
    return overlay(df, lambda py, px: (px - x) * (px - x) + (py - y) * (py - y) < radius * radius, color, (y - radius + 1, y + radius - 1))


def _on_line(x0: int, y0: int, x1: int, y1: int, thickness: int) -> Callable[[Column, Column], Column]:
    """Step i along the longer axis lies at ``(2 i short + long - 1) div (2 long)`` along the other."""
    dx, dy = abs(x1 - x0), abs(y1 - y0)
    sx, sy = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1)
    half = thickness // 2
    steep = dx < dy
    long, short = (dy, dx) if steep else (dx, dy)

    def test(y: Column, x: Column) -> Column:
        i = (y - y0) * sy if steep else (x - x0) * sx
        step = div(2 * i * short + long - 1, 2 * long) if long else F.lit(0)
        off = (x - x0 - sx * step) if steep else (y - y0 - sy * step)
        return (i >= 0) & (i <= long) & (F.abs(off) <= half)

    return test


def _thick(thickness: int) -> None:
    need_int("thickness", thickness, 1)


def draw_line(df: DataFrame, x0: int, y0: int, x1: int, y1: int, color=255, thickness: int = 1) -> DataFrame:
    _thick(thickness)
    return overlay(df, _on_line(x0, y0, x1, y1, thickness), color, (min(y0, y1) - thickness // 2, max(y0, y1) + thickness // 2))


def _any(tests: list) -> Callable[[Column, Column], Column]:
    def test(y, x):
        out = F.lit(False)
        for t in tests:
            out = out | t(y, x)
        return out

    return test


def draw_rectangle(df: DataFrame, x0: int, y0: int, x1: int, y1: int, color=255, thickness: int = 1, filled: bool = False, clamp: bool = True) -> DataFrame:
    _thick(thickness)
    left, right, top, bottom = min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1)
    if filled:
        return overlay(df, lambda y, x: (x >= left) & (x <= right) & (y >= top) & (y <= bottom), color, (top, bottom))
    if clamp:
        half = thickness // 2
        inner = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, F.lit(v)))

        def edge(y, x):
            a, b, c, d = inner(left, W()), inner(right, W()), inner(top, H()), inner(bottom, H())
            across, down = (x >= a) & (x <= b), (y >= c) & (y <= d) & (d > c)
            return across & ((F.abs(y - c) <= half) | (F.abs(y - d) <= half)) | down & ((F.abs(x - a) <= half) | (F.abs(x - b) <= half))

        return overlay(df, edge, color)
    corners = [(left, top, right, top), (right, top, right, bottom), (right, bottom, left, bottom), (left, bottom, left, top)]
    return overlay(df, _any([_on_line(*c, thickness) for c in corners]), color, (top - thickness // 2, bottom + thickness // 2))


def draw_polygon(df: DataFrame, vertices, color=255, thickness: int = 1, filled: bool = False) -> DataFrame:
    """Closed outline, or even-odd filling: an edge counts for rows from its upper end (included) to its lower one."""
    if len(vertices) < 3:
        raise ValueError(f"a polygon has at least three vertices, got {len(vertices)}")
    edges = [(*a, *b) for a, b in zip(vertices, [*vertices[1:], vertices[0]])]
    top, bottom = math.floor(min(y for _, y in vertices)), math.ceil(max(y for _, y in vertices))
    if not filled:
        _thick(thickness)
        return overlay(df, _any([_on_line(*e, thickness) for e in edges]), color, (top - thickness // 2, bottom + thickness // 2))
    slanted = [e for e in edges if e[1] != e[3]]

    def inside(y: Column, x: Column) -> Column:
        cross = [F.when((y >= min(ay, by)) & (y < max(ay, by)), ax + (y - ay) * (bx - ax) / F.lit(float(by - ay))) for ax, ay, bx, by in slanted]
        xs = F.sort_array(F.array_compact(F.array(*cross))) if cross else F.array().cast("array<double>")
        out = F.lit(False)
        for k in range(0, len(slanted) - 1, 2):
            out = out | F.coalesce((x >= F.floor(F.get(xs, F.lit(k)))) & (x <= F.ceil(F.get(xs, F.lit(k + 1)))), F.lit(False))
        return out

    return overlay(df, inside, color, (top, bottom))


def put_text(df: DataFrame, text: str, x: int, y: int, font_scale: float = 1.0, color=255) -> DataFrame:
    """Upper-cased text in the built-in font; other characters are blanks."""
    if not isinstance(text, str):
        raise TypeError(f"text must be a str, got {type(text).__name__}")
    if font_scale <= 0:
        raise ValueError("font_scale must be above 0")
    scale = max(1, round(font_scale))
    text = text.upper()
    # seven rows a character, with the blank column as the last bit
    rows = F.array(*[F.lit(2 * bits) for ch in text for bits in FONT.get(ch, FONT[" "])]) if text else None

    def inside(py: Column, px: Column) -> Column:
        if rows is None:
            return F.lit(False)
        cell = lambda e: e if scale == 1 else div(e, scale)
        row, across = cell(py - y), cell(px - x)
        bits = F.get(rows, div(across, 6) * 7 + row)
        return (px >= x) & (across < 6 * len(text)) & F.coalesce(F.getbit(bits, 5 - across % 6) == 1, F.lit(False))

    return overlay(df, inside, color, (y, y + 7 * scale - 1))
