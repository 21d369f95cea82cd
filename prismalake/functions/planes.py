"""Images as rows and expressions over them.

A plane row is ``image_id, height, width, channels, data``; ``data`` holds the values row by row, channels last, as
doubles. A pixel row is ``image_id, c, y, x, v``. Operators work inside the row with higher-order functions, so they
need no shuffle; whole-image values are aggregates of the same array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def H() -> Column:  # noqa: N802
    return F.col("height")


def W() -> Column:  # noqa: N802
    return F.col("width")


def C() -> Column:  # noqa: N802
    return F.col("channels")


_bound: list[Column] = []


def DATA() -> Column:  # noqa: N802
    """The row's data; inside ``over_data`` the value that is bound there."""
    return _bound[-1] if _bound else F.col("data")


def let(value: Column, use: Callable) -> Column:
    """``use(value)`` with the value computed once: the optimiser would copy a column's expression into every lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def over_data(build: Callable[[], Column]) -> Column:
    """An expression in which ``DATA()`` is computed once."""

    def use(d: Column) -> Column:
        _bound.append(d)
        try:
            return build()
        finally:
            _bound.pop()

    return let(DATA(), use)


PLANE = ["image_id", "height", "width", "channels", "data"]


def whole(x: Column) -> Column:
    return x.cast("int")


def div(a: Column, b) -> Column:
    """Whole quotient of non-negative numbers."""
    return whole(F.floor(a / b))


def at(y: Column, x: Column, c: Column, data: Column | None = None) -> Column:
    """The value at a place; null outside the array."""
    return F.get(DATA() if data is None else data, whole((y * W() + x) * C() + c))


def grid(height: Column, width: Column, channels: Column, value: Callable) -> Column:
    """Array of ``value(y, x, c)`` over a canvas."""
    size = height * width * channels
    places = F.when(size > 0, F.sequence(F.lit(0), whole(size) - 1)).otherwise(F.array().cast("array<int>"))
    return over_data(lambda: F.transform(places, lambda i: value(div(i, width * channels), div(i, channels) % width, i % channels).cast("double")))


def each(value: Callable, *wholes: Callable[[], Column]) -> Column:
    """Array of ``value(v, ...)`` over the data; the further arguments are computed once from the whole image."""
    if not wholes:
        return over_data(lambda: F.transform(DATA(), lambda v: value(v).cast("double")))
    names = [f"w{i}" for i in range(len(wholes))]

    def build() -> Column:
        shared = F.struct(*[w().alias(n) for w, n in zip(wholes, names)])
        return let(shared, lambda s: F.transform(DATA(), lambda v: value(v, *[s[n] for n in names]).cast("double")))

    return over_data(build)


def put(df: DataFrame, **new: Column) -> DataFrame:
    return df.withColumns(new)


def border(mode: str) -> Callable:
    """Source index for an index beyond an extent, or null where the border counts as zero."""
    if mode == "zero":
        return lambda e, n: F.when((e >= 0) & (e < n), e)
    if mode == "replicate":
        return lambda e, n: F.greatest(F.lit(0), F.least(n - 1, e))
    if mode == "reflect":
        return lambda e, n: F.when(n == 1, 0).otherwise((n - 1) - F.abs((n - 1) - F.pmod(e, F.greatest(F.lit(1), 2 * (n - 1)))))
    raise ValueError(f"unknown pad mode {mode!r}; zero, reflect or replicate")


def largest() -> Column:
    return F.array_max(DATA())


def to_unit(df: DataFrame) -> DataFrame:
    """Values above 1 anywhere in the image: all divided by 255."""
    return put(df, data=F.when(largest() > 1, each(lambda v: v / 255.0)).otherwise(DATA()))


def to_byte(df: DataFrame) -> DataFrame:
    """No value above 1: all multiplied by 255."""
    return put(df, data=F.when(largest() <= 1, each(lambda v: v * 255.0)).otherwise(DATA()))


def channels_must_be(df: DataFrame, n: int, what: str) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit(f"{what} needs {n} channel(s), got "), C().cast("string"))).cast("array<double>")
    return put(df, data=F.when(C() == n, DATA()).otherwise(bad))


def grey_or_colour(df: DataFrame, what: str) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit(f"{what} needs 1 or 3 channels, got "), C().cast("string"))).cast("array<double>")
    return put(df, data=F.when(C().isin(1, 3), DATA()).otherwise(bad))


ROWS = 1 << 16  # pixel rows of an Arrow batch


def pixels(df: DataFrame, *more: str) -> DataFrame:
    """One row for each value: (image_id, c, y, x, v), with further columns of the image; places are counted in Arrow batches."""
    df = df.select("image_id", *more, whole(W()).alias("width"), whole(C()).alias("channels"), F.col("data").cast("array<double>").alias("data"))
    types = dict(df.dtypes)
    kept = ["image_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("data"))
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = column.flatten()  # those of null rows left out
            ends = np.cumsum(size)
            across, channels = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("width", "channels"))
            for first in range(0, len(values), ROWS):
                at = np.arange(first, min(len(values), first + ROWS))
                row = np.searchsorted(ends, at, "right")
                p = at - (ends - size)[row]
                w, c = across[row].astype(np.int64), channels[row].astype(np.int64)
                place = [p % c, p // (w * c), p // c % w]
                own = [batch.column(batch.schema.get_field_index(n)).take(pa.array(row)) for n in kept]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(e.astype(np.int32)) for e in place], values.slice(first, len(at))], [*kept, "c", "y", "x", "v"])

    out = df.mapInArrow(run, ", ".join([*[f"`{n}` {types[n]}" for n in kept], "c int, y int, x int, v double"]))
    return out.select("image_id", "c", "y", "x", "v", *more)


def by_image(df: DataFrame, fn: Callable[[np.ndarray], tuple], **new: str) -> DataFrame:
    """Plane rows with ``fn(values)`` of each image in place of ``data``, in Arrow batches; ``new``: names and types of what it
    returns. Null values count as 0."""
    names = [c for c in df.columns if c != "data"]
    df = df.select(*names, F.col("data").cast("array<double>").alias("data"))
    types = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "double": pa.float64()}[t] for t in new.values()]
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("data"))
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = pc.fill_null(column.flatten(), 0.0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            found = [fn(values[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())]
            made = [_column([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, *made], [*names, *new])

    return df.mapInArrow(run, ", ".join([*[f"`{n}` {types[n]}" for n in names], *[f"`{n}` {t}" for n, t in new.items()]]))


def _column(values: list, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind):
        return pa.array(values, kind)
    ends = np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind.value_type))


def from_pixels(rows: DataFrame) -> DataFrame:
    """Plane rows of complete pixel tables."""
    by = rows.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), (F.max("c") + 1).alias("channels"), F.sort_array(F.collect_list(F.struct("y", "x", "c", "v"))).alias("s"))
    return by.select("image_id", *[whole(F.col(c)).alias(c) for c in ("height", "width", "channels")], F.transform("s", lambda s: s["v"].cast("double")).alias("data"))


def need_int(name: str, value, least: int | None = None) -> None:
    if not isinstance(value, int):
        raise TypeError(f"{name} must be an int, got {type(value).__name__}")
    if least is not None and value < least:
        raise ValueError(f"{name} must be at least {least}, got {value}")


def need_number(name: str, value, above: float | None = None) -> None:
    if not isinstance(value, (int, float)):
        raise TypeError(f"{name} must be a number, got {type(value).__name__}")
    if above is not None and value <= above:
        raise ValueError(f"{name} must be above {above}, got {value}")
