"""Shapes, texts and kernels from tables against the single-shape operators and NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismalake.functions.planes import pixels
from prismalake.operators import drawing as dr
from prismalake.operators import kernels as kn
from prismalake.operators import shapes as sh
from prismalake.operators import stencils as st
from prismalake.operators import tiles as t
from test_images import arrays, planes

SIZE = (24, 31)


@pytest.fixture(scope="module")
def canvas(spark):
    r = np.random.default_rng(21)
    return planes(spark, *[r.integers(0, 50, SIZE) for _ in range(3)]).persist()


def of(df, image=0):
    out = np.full(SIZE, -1.0)
    for x in df.where(F.col("image_id") == image).collect():
        assert out[x.y, x.x] == -1
        out[x.y, x.x] = x.v
    return out


def table(spark, rows, kind):
    return spark.createDataFrame(rows, f"image_id long, ord int, {kind}, color array<double>")


def test_polygons_equal_the_single_operator(spark, canvas):
    r = np.random.default_rng(3)
    shapes = [[tuple(map(int, p)) for p in r.integers(-8, 36, (n, 2))] for n in (3, 4, 5, 7, 9)]
    rows = [(0, k, v, [100.0 + k]) for k, v in enumerate(shapes)] + [(1, 5, shapes[0], [9.0]), (1, 2, shapes[1], [8.0]), (99, 1, shapes[0], [1.0]), (2, 1, None, [1.0]), (2, 2, shapes[0], None)]
    polygons = table(spark, rows, "vertices array<struct<x:int,y:int>>")
    sizes = sh.canvases(canvas)
    for filled, marks in ((True, sh.filled_polygons(polygons, sizes)), (False, sh.polygon_outlines(polygons, sizes))):
        got = sh.drawn(canvas, marks)
        want = canvas.where("image_id = 0")
        for k, v in enumerate(shapes):
            want = dr.draw_polygon(want, v, 100.0 + k, filled=filled)
        assert (of(got) == arrays(want)[0]).all()
        two = dr.draw_polygon(dr.draw_polygon(canvas.where("image_id = 1"), shapes[1], 8, filled=filled), shapes[0], 9, filled=filled)
        assert (of(got, 1) == arrays(two)[0]).all()
        assert (of(got, 2) == arrays(canvas.where("image_id = 2"))[0]).all()
    with pytest.raises(Exception, match="three vertices"):
        sh.filled_polygons(table(spark, [(0, 1, [(1, 1)], [1.0])], "vertices array<struct<x:int,y:int>>"), sizes).collect()


def test_lines_rectangles_points_texts(spark, canvas):
    sizes, image = sh.canvases(canvas), canvas.where("image_id = 0")
    ends = [(2, 5, 28, 9, 1), (30, 0, -4, 40, 2), (5, 5, 5, 5, 3), (-20, 3, 60, 11, 1), (7, 23, 7, -3, 4), (3, 2, 9, 14, 1), (-9, -9, -2, -2, 1)]
    want = image
    for k, (ax, ay, bx, by, n) in enumerate(ends):
        want = dr.draw_line(want, ax, ay, bx, by, 60 + k, n)
    marks = sh.lines(table(spark, [(0, k, *e, [60.0 + k]) for k, e in enumerate(ends)], "ax int, ay int, bx int, by int, thickness int"), sizes)
    assert (of(sh.drawn(canvas, marks)) == arrays(want)[0]).all()

    boxes = [(2, 3, 9, 8, 1, False), (-5, 4, 12, 40, 3, False), (20, 1, 25, 3, 1, True), (28, 20, 90, 90, 1, True), (-9, -9, -2, -2, 1, True), (40, 2, 60, 9, 1, False)]
    want = image
    for k, (a, b, c, d, n, filled) in enumerate(boxes):
        want = dr.draw_rectangle(want, a, b, c, d, 70 + k, n, filled)
    marks = sh.rectangles(table(spark, [(0, k, *b, [70.0 + k]) for k, b in enumerate(boxes)], "x0 int, y0 int, x1 int, y1 int, thickness int, filled boolean"), sizes)
    assert (of(sh.drawn(canvas, marks)) == arrays(want)[0]).all()

    discs = [(4, 4, 1), (30, 23, 5), (-2, 7, 4), (12, 12, 6)]
    want = image
    for k, (x, y, radius) in enumerate(discs):
        want = dr.draw_point(want, x, y, 80 + k, radius)
    marks = sh.points(table(spark, [(0, k, *d, [80.0 + k]) for k, d in enumerate(discs)], "x int, y int, radius int"), sizes)
    assert (of(sh.drawn(canvas, marks)) == arrays(want)[0]).all()

    labels = [("aB?~é", 1, 2, 1.0), ("Wide", -3, 9, 2.5), ("", 0, 0, 1.0), (None, 0, 0, 1.0), ("x", 99, 99, 1.0), ("7/3", 12, 20, 0.2)]
    want = image
    for k, (text, x, y, scale) in enumerate(labels):
        want = dr.put_text(want, text, x, y, scale, 90 + k) if text else want
    marks = sh.texts(table(spark, [(0, k, *v, [90.0 + k]) for k, v in enumerate(labels)], "text string, x int, y int, scale double"), sizes)
    assert (of(sh.drawn(canvas, marks)) == arrays(want)[0]).all()


def test_overlay_on_colour_and_tiles(spark):
    rgb = planes(spark, np.zeros((9, 7, 3)))
    marks = spark.createDataFrame([(0, 1, 2, 3, [1.0, 2.0, 3.0]), (0, 0, 2, 3, [9.0, 9.0, 9.0]), (0, 5, 99, 0, [4.0, 4.0, 4.0])], "image_id long, ord int, y int, x int, color array<double>")
    for rows in (pixels(rgb), t.pixels_of_tiles(t.tiled(rgb, 4))):
        got = {(x.c, x.y, x.x): x.v for x in sh.overlay(rows, marks).collect()}
        assert len(got) == 9 * 7 * 3 and [got[c, 2, 3] for c in range(3)] == [1, 2, 3] and sum(got.values()) == 6
    with pytest.raises(Exception, match="each channel"):
        sh.overlay(pixels(rgb), marks.withColumn("color", F.array(F.lit(1.0)))).collect()


@pytest.mark.parametrize("mode", ["zero", "reflect", "replicate"])
def test_kernels_by_row_equal_single_kernels(spark, mode):
    r = np.random.default_rng(9)
    images = [r.integers(0, 256, s).astype(float) for s in ((12, 9), (5, 14), (1, 6), (3, 3))]
    kernels = {1: [[1, 0, -2], [3, 1, 0], [0, -1, 2]], 2: r.integers(-3, 4, (5, 7)).tolist(), 3: [[2]]}
    rows = spark.createDataFrame([(k, y, x, float(v)) for k, m in kernels.items() for y, line in enumerate(m) for x, v in enumerate(line)], "kernel_id int, ky int, kx int, w double")
    df = planes(spark, *images).withColumn("kernel_id", F.expr("element_at(array(1, 2, 2, null), cast(image_id + 1 as int))"))
    sizes = df.select("image_id", "height", "width", "channels")
    for source in (df, t.tiled(df, 4).join(df.select("image_id", "kernel_id"), "image_id")):
        got = {}
        for x in kn.dense(kn.convolve_each(source, rows, mode), sizes).collect():
            got.setdefault(x.image_id, np.full(images[x.image_id].shape, np.nan))[x.y, x.x] = x.v
        for k, a in enumerate(images):
            want = a if k == 3 else arrays(st.convolve2d(planes(spark, a), kernels[1 if k == 0 else 2], mode))[0]
            assert np.allclose(got[k], want)
    with pytest.raises(Exception, match="must be odd"):
        kn.convolve_each(df, rows.where("ky < 2"), mode).collect()
