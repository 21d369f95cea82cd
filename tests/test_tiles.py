"""Tiled images against the plane forms and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismalake.functions.medians import running_medians
from prismalake.functions.planes import pixels
from prismalake.operators import stencils as st
from prismalake.operators import tiles as t
from test_images import arrays, planes

SLANTED = [[1, 0, -2, 1, 1], [3, 1, 0, 2, 0], [0, -1, 2, 0, 4]]


@pytest.fixture(scope="module")
def some(spark):
    r = np.random.default_rng(11)
    return planes(spark, r.integers(0, 256, (37, 22)), r.integers(0, 256, (5, 61)), r.integers(0, 256, (1, 1)), r.integers(0, 2, (9, 9)), r.integers(0, 256, (16, 16))).persist()


def same(tiled, plane):
    a, b = arrays(t.untiled(tiled)), arrays(plane)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x.shape == y.shape and np.allclose(x, y)


OPERATORS = {
    "convolve": lambda m, d: m.convolve2d(d, SLANTED, "replicate"),
    "convolve_zero": lambda m, d: m.convolve2d(d, SLANTED),
    "spatial": lambda m, d: m.spatial_filter(d, SLANTED, "reflect"),
    "mean": lambda m, d: m.mean_filter(d, 5),
    "mean_wide": lambda m, d: m.mean_filter(d, 21, "reflect"),
    "gaussian": lambda m, d: m.gaussian_filter(d, 7, 1.3),
    "median": lambda m, d: m.median_filter(d, 5),
    "adaptive": lambda m, d: m.threshold_adaptive(d, 5),
    "adaptive_gaussian": lambda m, d: m.threshold_adaptive(d, 5, "gaussian"),
    "unsharp": lambda m, d: m.unsharp_mask(d, 3, 1.0, 1.5),
    "erode": lambda m, d: m.morphological_op(d, None, "erode"),
    "dilate": lambda m, d: m.morphological_op(d, [[1] * 7] * 3, "dilate"),
    "pad_zero": lambda m, d: m.pad_image(d, 3, 5, "zero"),
    "pad_reflect": lambda m, d: m.pad_image(d, 20, 2, "reflect"),
    "pad_replicate": lambda m, d: m.pad_image(d, 2, 11, "replicate"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_tiles_equal_planes(some, name):
    same(OPERATORS[name](t, t.tiled(some, 8)), OPERATORS[name](st, some))


def test_sobel_arrays_and_pixels(some):
    tiled, plane = t.sobel_gradients(t.tiled(some, 7)), st.sobel_gradients(some)
    want = plane.select("image_id", "width", F.posexplode(F.arrays_zip("gx", "gy", "magnitude", "angle")).alias("p", "s"))
    want = {(r.image_id, r.p // r.width, r.p % r.width): tuple(r.s) for r in want.collect()}
    got = {(r.image_id, r.y, r.x): (r.gx, r.gy, r.magnitude, r.angle) for r in t.pixels_of_tiles(tiled, "gx", "gy", "magnitude", "angle").collect()}
    assert got == want


def test_colour_and_round_trips(spark, some):
    colour = planes(spark, np.random.default_rng(2).integers(0, 256, (11, 14, 3)))
    for df in (some, colour):
        same(t.tiled(df, 5), df)
        assert sorted(map(tuple, t.pixels_of_tiles(t.tiled(df, 6)).collect())) == sorted(map(tuple, pixels(df).collect()))
    same(t.spatial_filter(t.tiled(colour, 4), SLANTED, "reflect"), st.spatial_filter(colour, SLANTED, "reflect"))
    same(t.median_filter(t.tiled(colour, 4), 3), st.median_filter(colour, 3))
    same(t.mean_filter(t.tiled(colour, 4), 5), st.mean_filter(colour, 5))
    one = spark.createDataFrame([(5, 0, 3, 4, 9.0), (5, 0, 12, 1, 4.0), (5, 0, 99, 1, 4.0), (5, 0, 1, 1, None)], "image_id long, c int, y int, x int, v double")
    back = arrays(t.untiled(t.tiles_of_pixels(one, 14, 6, 1, 5)))[0]
    want = np.zeros((14, 6))
    want[3, 4], want[12, 1] = 9, 4
    assert (back == want).all()


def test_one_shuffle_and_no_whole_image(some):
    """A stencil on tiles is one exchange, keyed by image and tile."""
    plan = t.gaussian_filter(t.tiled(some, 8), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(image_id") == plan.count("Exchange") == 1


def test_running_medians():
    r = np.random.default_rng(5)
    for shape, k, high in (((3, 9, 7, 1), 3, 256), ((2, 6, 5, 3), 5, 4), ((1, 40, 30, 1), 9, None), ((1, 1, 8, 1), 3, 9), ((2, 3, 1, 1), 7, 9)):
        a = r.random(shape) if high is None else r.integers(0, high, shape).astype(float)
        p = np.pad(a, ((0, 0), (k // 2, k // 2), (k // 2, k // 2), (0, 0)), "edge")
        windows = np.lib.stride_tricks.sliding_window_view(p, (k, k), (1, 2))
        assert (running_medians(a, k) == np.median(windows, axis=(-2, -1))).all()


def test_channels_are_checked(spark):
    two = planes(spark, np.zeros((4, 4, 2)))
    for op in (lambda: st.spatial_filter(two, [[1.0]]), lambda: st.median_filter(two), lambda: st.mean_filter(two)):
        with pytest.raises(Exception, match="1 or 3 channels"):
            op().collect()


@pytest.mark.parametrize("mode", ["zero", "reflect", "replicate"])
def test_box_windows_equal_numpy(spark, mode):
    r = np.random.default_rng(7)
    a, b = r.integers(0, 256, (13, 8)).astype(float), r.integers(0, 256, (4, 6, 3)).astype(float)
    kind = {"zero": "constant", "reflect": "reflect", "replicate": "edge"}[mode]
    for k in (1, 3, 7):
        got = arrays(st.mean_filter(planes(spark, a, b), k, mode))
        for x, y in zip((a, b), got):
            pad = [(k // 2, k // 2)] * 2 + [(0, 0)] * (x.ndim - 2)
            assert np.allclose(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, kind), (k, k), (0, 1)).mean((-2, -1)), y)
