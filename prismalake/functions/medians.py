"""Medians of whole batches of images: a histogram of ranks runs along the rows of all images side by side.

Each step to the next column takes out the k values that leave a row's window and puts in the k that enter, so its cost grows
with k and not with k * k. Counts of levels are kept singly and by 64, and the median is found in the second, then in
the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COUNTS = 1 << 23  # counts that are held at once
GROUP = 64


def by_shape(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], values: int = 1 << 22) -> DataFrame:
    """Plane rows whose ``data`` is replaced by ``fn`` of stacks (n, height, width, channels) of images of one size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("height", "width", "channels")]
            column = batch.column("data")
            bounds, raw = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            out = [np.zeros(0)] * batch.num_rows
            shapes, of = np.unique(np.stack(size, 1), axis=0, return_inverse=True) if batch.num_rows else (np.zeros((0, 3)), np.zeros(0))
            for k, (h, w, c) in enumerate(shapes.tolist()):
                rows = np.flatnonzero(of.ravel() == k)
                many = max(1, values // max(1, h * w * c))
                for i in range(0, len(rows) if h * w * c else 0, many):
                    some = rows[i : i + many].tolist()
                    done = fn(np.stack([raw[bounds[r] : bounds[r + 1]].reshape(h, w, c) for r in some]))
                    for r, image in zip(some, done):
                        out[r] = image.ravel()
            offsets = np.append(0, np.cumsum([len(x) for x in out])).astype(np.int32)
            data = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64()))
            at = batch.schema.get_field_index("data")
            yield batch.set_column(at, "data", data.cast(batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def running_medians(images: np.ndarray, k: int) -> np.ndarray:
    """Medians of the k x k neighbourhoods of (n, height, width, channels), borders repeated."""
    n, h, w, c = images.shape
    planes = np.moveaxis(images, 3, 1).reshape(n * c, h, w)
    out = np.empty_like(planes)
    many = max(1, COUNTS // (GROUP * 4 * h))
    for i in range(0, len(planes), many):
        out[i : i + many] = _some(planes[i : i + many], k)
    return np.moveaxis(out.reshape(n, c, h, w), 1, 3)


def _some(planes: np.ndarray, k: int) -> np.ndarray:
    levels, rank = np.unique(planes, return_inverse=True)
    rank, groups = rank.reshape(planes.shape), -(-len(levels) // GROUP)
    lines = max(1, COUNTS // (GROUP * groups))
    if len(planes) > 1 and planes.shape[0] * planes.shape[1] > lines:
        half = len(planes) // 2
        return np.concatenate([_some(planes[:half], k), _some(planes[half:], k)])
    r = k // 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(rank, ((0, 0), (r, r), (r, r)), "edge"), k, axis=1)  # plane, row, column, k rows
    out = np.empty(rank.shape, np.int64)
    step = max(1, lines // len(planes))
    for y in range(0, planes.shape[1], step):
        out[:, y : y + step] = _rows(around[:, y : y + step], groups, k)
    return levels[out]


def _rows(around: np.ndarray, groups: int, k: int) -> np.ndarray:
    m, h, wide, _ = around.shape
    single, grouped, own = np.zeros((m * h, groups * GROUP), np.int32), np.zeros((m * h, groups), np.int32), np.arange(m * h)
    out = np.empty((m * h, wide - k + 1), np.int64)

    def count(x: int, sign: int) -> None:
        values = around[:, :, x].reshape(m * h, k)
        np.add.at(single, (own[:, None], values), sign)
        np.add.at(grouped, (own[:, None], values // GROUP), sign)

    for x in range(k - 1):
        count(x, 1)
    for x in range(wide - k + 1):
        count(x + k - 1, 1)
        upto = np.cumsum(grouped, 1)
        at = (upto <= k * k // 2).sum(1)
        left = k * k // 2 - np.where(at > 0, upto[own, at - 1], 0)
        inner = np.cumsum(single.reshape(m * h, groups, GROUP)[own, at], 1)
        out[:, x] = at * GROUP + (inner <= left[:, None]).sum(1)
        count(x, -1)
    return out.reshape(m, h, -1)
