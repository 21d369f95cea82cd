"""Values on small images, degenerate images and argument errors."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismalake.functions.planes import from_pixels, pixels
from prismalake.operators import descriptors as D
from prismalake.operators import drawing as dr
from prismalake.operators import geometry as g
from prismalake.operators import histograms as hi
from prismalake.operators import pointwise as pw
from prismalake.operators import stencils as st
from prismalake.sources import images as im
from prismalake.streaming import images as live

SCHEMA = "image_id long, height int, width int, channels int, data array<double>"


def planes(spark, *arrays):
    rows = []
    for k, a in enumerate(arrays):
        a = np.asarray(a, float)
        rows.append((k, a.shape[0], a.shape[1], a.shape[2] if a.ndim == 3 else 1, a.ravel().tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def arrays(df):
    return [np.array(r.data).reshape((r.height, r.width, r.channels) if r.channels > 1 else (r.height, r.width)) for r in df.orderBy("image_id").collect()]


@pytest.fixture(scope="module")
def gray(spark):
    return np.random.default_rng(1).integers(0, 256, (12, 9)).astype(float)


def padded(a, h, w, mode):
    return np.pad(a, ((h, h), (w, w)), mode={"zero": "constant", "reflect": "reflect", "replicate": "edge"}[mode])


@pytest.mark.parametrize("mode", ["zero", "reflect", "replicate"])
def test_convolution_and_padding(spark, gray, mode):
    k = np.array([[1, 0, -2, 1, 0], [3, 1, 0, 2, 2], [0, -1, 2, 0, 1]], float)
    p = padded(gray, 1, 2, mode)
    want = sum(k[::-1, ::-1][i, j] * p[i : i + 12, j : j + 9] for i in range(3) for j in range(5))
    df = planes(spark, gray)
    assert np.allclose(arrays(st.convolve2d(df, k.tolist(), mode))[0], want)
    assert (arrays(st.pad_image(df, 3, 2, mode))[0] == padded(gray, 3, 2, mode)).all()


def test_identity_separable_and_spike(spark, gray):
    df = planes(spark, gray)
    assert (arrays(st.convolve2d(df, [[0, 0, 0], [0, 1, 0], [0, 0, 0]]))[0] == gray).all()
    assert st.separated([[1, 2, 1], [2, 4, 2], [1, 2, 1]]) and st.separated([[1, 0], [0, 1]]) is None
    assert abs(sum(map(sum, st.gaussian_kernel(5, 1.1))) - 1) < 1e-12
    assert arrays(st.mean_filter(df, 5))[0].var() < gray.var()
    spike = np.zeros((20, 20))
    spike[10, 10] = 255
    assert arrays(st.median_filter(planes(spark, spike)))[0].max() == 0


def test_degenerate_images(spark):
    cases = [np.full((1, 1), 7), np.full((1, 5), 3), np.zeros((4, 4)), np.full((4, 4), 128), np.array([[0, 1], [1, 0]])]
    df = planes(spark, *cases)
    assert all(len(a) for a in arrays(st.gaussian_filter(df, 7, 2.0)))
    assert arrays(pw.normalize(df))[3].max() == 0 and arrays(pw.normalize(df, "zscore"))[3].max() == 0
    assert arrays(hi.histogram_equalization(df))[3].max() == 0
    assert [r.threshold for r in hi.threshold_otsu(df).orderBy("image_id").collect()][3] == 0
    assert [len(r.vec) for r in D.hog(df).orderBy("image_id").collect()] == [9] * 5
    assert all(v == 0 for v in hi.hu_moments(df).orderBy("image_id").collect()[2].vec)
    assert [r["sum(count)"] for r in hi.histogram(df).groupBy("image_id").sum("count").orderBy("image_id").collect()] == [1, 5, 16, 16, 4]


def test_lbp_hog_shapes(spark, gray):
    big = np.random.default_rng(4).integers(0, 256, (32, 40, 3))
    row = D.hog(planes(spark, big)).first()
    assert len(row.vec) == 3 * 4 * 4 * 9 and all(v == 0 for i, v in enumerate(row.vec) if i % 9 > 4)
    assert abs(sum(D.lbp(planes(spark, gray)).first().vec) - 1) < 1e-9


def test_geometry(spark, gray):
    df = planes(spark, gray)
    moved = arrays(g.translate(df, 2, 3, 5))[0]
    assert (moved[3:, 2:] == gray[:-3, :-2]).all() and (moved[:3] == 5).all()
    assert (arrays(g.translate(g.translate(df, 1, 1), -1, -1))[0][:-1, :-1] == gray[:-1, :-1]).all()
    assert arrays(g.resize(df, 1, 1))[0][0, 0] == gray[0, 0]
    assert (arrays(g.resize(df, 12, 9))[0] == gray).all()
    assert (arrays(g.rotate(df, 0))[0] == gray).all()


def test_morphology_order(spark, gray):
    df = planes(spark, gray)
    low, high = arrays(st.morphological_op(df, None, "erode"))[0], arrays(st.morphological_op(df, None, "dilate"))[0]
    assert (low <= gray).all() and (gray <= high).all()


def test_lines_take_the_nearest_places(spark):
    import duckdb

    from prismalake.plans.catalog import line_sql

    for end in [(9, 4), (3, 9), (0, 0), (-3, 12), (9, 9), (5, 0), (2, 5), (4, 1)]:
        a = arrays(dr.draw_line(planes(spark, np.zeros((10, 10))), 2, 5, *end, 1))[0]
        got = {(int(y), int(x)) for y, x in np.argwhere(a)}
        assert got == {p for p in duckdb.sql(line_sql(2, 5, *end)).fetchall() if 0 <= p[0] < 10 and 0 <= p[1] < 10}
        long = max(abs(end[0] - 2), abs(end[1] - 5))
        for i in range(long + 1):  # each place lies within half a step of the line
            x, y = 2 + (end[0] - 2) * i / max(1, long), 5 + (end[1] - 5) * i / max(1, long)
            assert not (0 <= x <= 9 and 0 <= y <= 9) or any(abs(px - x) <= 0.5 and abs(py - y) <= 0.5 for py, px in got)


def test_drawing_off_canvas_and_colours(spark):
    df = planes(spark, np.zeros((20, 20)))
    assert arrays(dr.draw_rectangle(df, -50, -50, -40, -40, 9, filled=True))[0].max() == 0
    assert arrays(dr.draw_rectangle(df, -5, 3, 4, 8, 9))[0][:, 0].max() == 9
    assert arrays(dr.draw_rectangle(df, -5, 3, 4, 8, 9, clamp=False))[0][4:8, 0].max() == 0
    assert arrays(dr.draw_polygon(df, [(-30, 0), (-20, 0), (-25, 9)], 9, filled=True))[0].max() == 0
    assert arrays(dr.put_text(df, "A", 50, 50))[0].max() == 0
    rgb = planes(spark, np.zeros((6, 6, 3)))
    assert (arrays(dr.draw_point(rgb, 2, 2, (1, 2, 3)))[0][2, 2] == [1, 2, 3]).all()
    with pytest.raises(Exception):
        dr.draw_point(df, 2, 2, (1, 2, 3)).collect()


def test_argument_errors(spark, gray):
    df = planes(spark, gray)
    for call in (lambda: st.mean_filter(df, 4), lambda: st.gaussian_kernel(3, 0), lambda: st.convolve2d(df, []), lambda: st.convolve2d(df, [[1, 2]]), lambda: pw.normalize(df, "x"), lambda: pw.clip_pixels(df, 5, 5), lambda: st.pad_image(df, -1, 0), lambda: pw.bit_plane_slice(df, 8), lambda: hi.histogram(df, 0), lambda: g.resize(df, 0, 1), lambda: D.lbp(df, 0), lambda: dr.draw_polygon(df, [(0, 0)]), lambda: dr.put_text(df, "a", 0, 0, 0), lambda: im.checked_path(" ")):
        with pytest.raises(ValueError):
            call()
    for call in (lambda: st.mean_filter(df, 3.0), lambda: st.pad_image(df, 1.5, 0), lambda: pw.bit_plane_slice(df, "1"), lambda: dr.put_text(df, 5, 0, 0), lambda: im.checked_path(5), lambda: g.rotate(df, "a")):
        with pytest.raises(TypeError):
            call()
    with pytest.raises(Exception):
        pw.rgb_to_gray(df).collect()


def test_png_round_trip(spark, gray, tmp_path):
    rgb = np.random.default_rng(2).integers(0, 256, (5, 7, 3)).astype(float)
    files = im.export_image(planes(spark, gray, rgb), str(tmp_path / "out")).collect()
    assert len(files) == 2
    back = {r.origin.rsplit("/", 1)[1]: r for r in im.read_image(spark, str(tmp_path / "out" / "*.png")).collect()}
    assert back["0.png"].data == gray.ravel().tolist() and back["1.png"].data == rgb.ravel().tolist()


def test_missing_and_broken_files(spark, gray, tmp_path):
    im.export_image(planes(spark, gray), str(tmp_path / "in")).collect()
    (tmp_path / "in" / "9.png").write_bytes(b"no image at all")
    with pytest.raises(FileNotFoundError):
        im.read_image(spark, str(tmp_path / "none" / "*.png"))
    with pytest.raises(Exception, match="cannot decode"):
        im.read_image(spark, str(tmp_path / "in" / "*.png")).collect()
    for as_gray in (False, True):
        rows = im.read_image(spark, str(tmp_path / "in" / "*.png"), as_gray, broken="report").collect()
        assert sorted((r.origin.rsplit("/", 1)[1], r.error, r.data is None) for r in rows) == [("0.png", None, False), ("9.png", "cannot be decoded", True)]
    with pytest.raises(ValueError):
        im.read_image(spark, str(tmp_path / "in" / "*.png"), broken="skip")


def test_layouts_and_stream(spark, gray, tmp_path):
    df = planes(spark, gray)
    assert (arrays(from_pixels(pixels(df)))[0] == gray).all()
    df.write.parquet(str(tmp_path / "in"))
    q = live.start(live.stream_planes(spark, str(tmp_path / "in")), lambda d: st.mean_filter(d, 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert np.allclose(arrays(spark.read.parquet(str(tmp_path / "out")))[0], arrays(st.mean_filter(df, 3))[0])


def test_bytes_wrap_and_clip(spark):
    df = planes(spark, [[300.0, -1.0, 255.0]])
    assert arrays(pw.gray_to_rgb(df))[0][0, :, 0].tolist() == [44, 255, 255]
    assert arrays(pw.gray_to_rgb(planes(spark, [[0.5, 2.0, -1.0]]), floating=True))[0][0, :, 0].tolist() == [127, 255, 0]
    assert math.isclose(arrays(pw.rgb_to_gray(planes(spark, np.full((1, 1, 3), 255))))[0][0, 0], 0.9999)


def test_jpeg_export(spark, tmp_path):
    """Written by NumPy, read by Spark's decoder: smooth images come back within a few levels, at odd sizes, too."""
    y, x = np.mgrid[:37, :50]
    grey = np.rint(128 + 60 * np.sin(x / 9) + 50 * np.cos(y / 7)).astype(np.uint8)
    rgb = np.stack([grey, grey[::-1], 255 - grey], 2)
    flat, noise = np.full((1, 1), 77, np.uint8), np.random.default_rng(1).integers(0, 256, (24, 40), np.uint8)
    files = im.export_image(planes(spark, grey, rgb, flat, noise), str(tmp_path / "out"), extension="jpg", quality=95).collect()
    assert sorted(r.image_id for r in files) == [0, 1, 2, 3] and all(r.bytes == os.path.getsize(r.file) for r in files)
    back = {r.origin.rsplit("/", 1)[1]: r for r in im.read_image(spark, str(tmp_path / "out" / "*.jpg")).collect()}
    for name, want, most in (("0.jpg", grey, 6), ("1.jpg", rgb, 12), ("2.jpg", flat, 1), ("3.jpg", noise, 40)):
        got = np.array(back[name].data).reshape(want.shape)
        assert (back[name].height, back[name].width) == want.shape[:2] and np.abs(got - want).max() <= most, name
    im.export_image(planes(spark, rgb), str(tmp_path / "best"), extension="jpeg", quality=100).collect()
    got = np.array(im.read_image(spark, str(tmp_path / "best" / "*.jpeg")).collect()[0].data).reshape(rgb.shape)
    assert np.abs(got - rgb).max() <= 3


def test_export_all_or_none(spark, gray, tmp_path):
    out = tmp_path / "out"
    two = np.zeros((4, 4, 2))
    with pytest.raises(Exception, match="channels, got 2"):
        im.export_image(planes(spark, gray, gray, two).repartition(3), str(out))
    assert not out.exists() or not [p for p in out.rglob("*") if p.is_file()]
    with pytest.raises(Exception, match="jpeg has 1 or 3 channels"):
        im.export_image(planes(spark, np.zeros((4, 4, 4))), str(out), extension="jpeg")
    with pytest.raises(Exception, match="no image to export in the row of id 0"):
        im.export_image(planes(spark, gray).withColumn("data", F.lit(None).cast("array<double>")), str(out))
    for bad, error in (("gif", ValueError), (7, TypeError)):
        with pytest.raises(error):
            im.export_image(planes(spark, gray), str(out), extension=bad)
    with pytest.raises(ValueError):
        im.export_image(planes(spark, gray), str(out), quality=0)
    assert im.export_image(planes(spark, gray).where("image_id < 0"), str(out)).count() == 0
    assert im.export_image(planes(spark, gray), str(out), extension="PNG").count() == 1
    assert im.export_image(planes(spark, gray), str(out), extension="jpg").collect()[0].file.endswith("/0.jpg")
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith("_")) == ["0.PNG", "0.jpg"]
