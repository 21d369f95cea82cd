"""Queries and steps that differed from their SQL, or whose cost grew too fast, on larger tables."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from prismalake.operators import drawing as dr
from prismalake.operators import histograms as hi
from prismalake.operators import kernels as kn
from prismalake.operators import shapes as sh
from prismalake.operators import tiles as ti
from prismalake.plans import catalog
from prismalake.sources.tables import mosaic, mosaic_pixels


def vectors(path, n: int, first: int = 0) -> str:
    """A table of n vectors of byte levels."""
    levels = np.random.default_rng(7).integers(-128, 128, (n, 64)).astype(np.float32) / np.float32(256)
    table = pa.table({"vec_id": pa.array(range(first, first + n), pa.int64()), "embedding": pa.array(list(levels), pa.list_(pa.float32())), "label": pa.array([i % 10 for i in range(n)], pa.int32())})
    pq.write_table(table, path / "embeddings.parquet")
    return str(path)


def same_as_sql(spark, name: str, sf: str, tables=("embeddings",)) -> None:
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found, expected = catalog.queries()[name](spark, sf).toArrow(), con.sql(catalog.oracle_sql()[name]).to_arrow_table()
    names = sorted(expected.column_names)
    con.register("a", found.select(names)), con.register("b", expected.select(names))
    assert found.num_rows == expected.num_rows
    assert con.sql("select * from a except all select * from b").fetchall() == []


def test_gradient_bins_do_not_depend_on_the_order_of_a_sum(spark, tmp_path):
    same_as_sql(spark, "gradient_hist", vectors(tmp_path, 6000))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_the_lines_of_a_shape_are_computed(spark):
    df = spark.createDataFrame([(1, 5, 2, 1, [float(i) for i in range(10)])], "image_id long, height int, width int, channels int, data array<double>")
    low = lambda y, x: F.when(y > 1, F.raise_error(F.lit("beyond the lines")).cast("boolean")).otherwise(x == 1)
    assert dr.overlay(df, low, 9, (-3, 1)).first()["data"] == [0, 9, 2, 9, 4, 5, 6, 7, 8, 9]
    assert dr.overlay(df, low, 9, (-3, -1)).first()["data"] == df.first()["data"]
    assert dr.overlay(df, lambda y, x: x == 0, 9, (4, 70)).first()["data"] == [0, 1, 2, 3, 4, 5, 6, 7, 9, 9]
    assert dr.put_text(df, "I", 0, 3).first()["data"] == [0, 1, 2, 3, 4, 5, 6, 255, 8, 9]


def test_images_are_counted_without_a_shuffle(spark):
    df = spark.createDataFrame([(1, 1, 4, 1, [0.0, 2.0, None, 255.0]), (2, 1, 0, 1, []), (3, 1, 1, 1, [7.0])], "image_id long, height int, width int, channels int, data array<double>")
    for made in (hi.histogram(df), hi.histogram_equalization(df), hi.threshold_otsu(df)):
        assert "Exchange" not in plan(made)
    counted = {(r["image_id"], r["bin"]): r["count"] for r in hi.histogram(df).where("count > 0").collect()}
    assert counted == {(1, 0): 1, (1, 2): 1, (1, 255): 1, (3, 7): 1}
    assert [r["data"] for r in hi.histogram_equalization(df).orderBy("image_id").collect()] == [[0, 128, 0, 255], [], [0]]


def test_a_mosaic_moves_vectors_and_not_pixels(spark, tmp_path):
    sf = vectors(tmp_path, 20, 3)
    made = mosaic(spark, sf, 3, 5)
    assert "explode(data" not in plan(made)
    pixels = {(r["image_id"], r["y"] * 40 + r["x"]): r["v"] for r in mosaic_pixels(spark, sf, 3, 5).collect()}
    for r in made.collect():
        assert r["data"] == [pixels.get((r["image_id"], p), 0.0) for p in range(24 * 40)]


def test_a_tile_is_computed_once_and_not_for_each_line(spark):
    df = spark.createDataFrame([(1, 4, 4, 1, [float(i) for i in range(16)])], "image_id long, height int, width int, channels int, data array<double>")
    one = F.lit(1)
    cut = df.select(ti.block(F.transform("data", lambda v: v + 1), F.col("width"), F.col("channels"), one, one, one + 1, one + 1).alias("data"))
    assert cut.first()["data"] == [6, 7, 10, 11]
    assert "slice(transform" not in plan(cut) and "slice(lambda" in plan(cut)


def test_the_font_needs_no_task(spark):
    assert "LocalTableScan" in plan(sh.font_table(spark)) and sh.font_table(spark).count() == 7 * len(dr.FONT)


def test_images_meet_their_kernels_without_a_row_for_each_pixel(spark):
    taps = spark.createDataFrame([(1, 0, x, float(x)) for x in range(3)] + [(2, 0, 0, 0.0)], "kernel_id int, ky int, kx int, w double")
    rows = [(i, 1, 3, 1, d, k) for i, (d, k) in enumerate([([1.0, 2.0, None], 1), ([1.0, 2.0, 4.0], 2), ([5.0, 6.0, 7.0], None)])] + [(3, 1, 0, 1, [], 1), (4, 1, 1, 1, None, 1)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, data array<double>, kernel_id int")
    found = kn.convolve_each(df, taps, "zero")
    assert "explode(data" not in plan(found) and "explode(taps" not in plan(found)
    assert [r["v"] for r in found.orderBy("image_id", "x").collect()] == [1 * 0 + 1 * 1 + 2 * 0, 1 * 2 + 2 * 1, 2 * 2, 0, 0, 0, 5, 6, 7]
