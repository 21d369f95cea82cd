"""Image collections from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL = "cast(least(255D, greatest(0D, floor(cast(e as double) * 256D + 128D))) as double)"


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey 8 x 8 images: one for each vector of 64 numbers."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.expr(f"transform(embedding, e -> {LEVEL})").alias("data"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour 8 x 8 images: three consecutive vectors are the channels; a channel without a vector is 0."""
    rows = gray8(spark, sf_dir).select(F.floor(F.col("image_id") / 3).cast("long").alias("id"), (F.col("image_id") % 3).alias("c"), "data")
    by = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("c", "data"))).alias("s"))  # three rows at most
    data = F.expr("transform(sequence(0, 191), i -> coalesce(get(try_element_at(s, cast(i % 3 as bigint)), cast(i div 3 as int)), 0D))")
    return by.select(F.col("id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), data.alias("data"))


def mosaic_pixels(spark: SparkSession, sf_dir: str, down: int, across: int) -> DataFrame:
    """Pixel rows of grey images of ``down`` x ``across`` consecutive 8 x 8 images; only pixels that there are."""
    rows = gray8(spark, sf_dir).select("image_id", F.posexplode("data").alias("p", "v"))
    t = F.col("image_id") % (down * across)
    place = {"y": F.floor(t / across) * 8 + F.floor(F.col("p") / 8), "x": t % across * 8 + F.col("p") % 8}
    return rows.select(F.floor(F.col("image_id") / (down * across)).cast("long").alias("image_id"), F.lit(0).alias("c"), *[e.cast("int").alias(n) for n, e in place.items()], "v")


def mosaic(spark: SparkSession, sf_dir: str, down: int = 3, across: int = 5) -> DataFrame:
    """The same as plane rows; places without an image are 0. Vectors travel whole, and lines of eight values are put together."""
    n = down * across
    rows = gray8(spark, sf_dir).where("size(data) > 0")
    bad = F.raise_error(F.concat(F.lit("an image of 8 x 8 has 64 values at most, got "), F.size("data").cast("string"))).cast("array<double>")
    data = F.when(F.size("data") <= 64, F.col("data")).otherwise(bad)
    rows = rows.select(F.floor(F.col("image_id") / n).cast("long").alias("image_id"), (F.col("image_id") % n).cast("int").alias("t"), data.alias("data"))
    by = rows.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("t", "data"))).alias("s"))  # n rows at most
    part = "coalesce(try_element_at(s, cast(t as int)), array())"
    parts = F.expr(f"transform(sequence(0, {n - 1}), t -> concat({part}, array_repeat(0D, 64 - size({part}))))")
    by = by.select("image_id", F.explode(F.array(parts)).alias("parts"))
    lines = F.expr(f"flatten(transform(sequence(0, {8 * down - 1}), y -> flatten(transform(slice(parts, y div 8 * {across} + 1, {across}), d -> slice(d, y % 8 * 8 + 1, 8)))))")
    data = F.transform(lines, lambda v: F.coalesce(v, F.lit(0.0)))
    return by.select("image_id", F.lit(8 * down).alias("height"), F.lit(8 * across).alias("width"), F.lit(1).alias("channels"), F.explode(F.array(data)).alias("data"))


def text32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey images 32 wide: the characters of each whole text row by row, code points modulo 256, the last row filled up
    with 0. Null and empty texts are no images."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text != ''")
    data = F.expr("concat(transform(split(text, ''), ch -> cast(ascii(ch) % 256 as double)), array_repeat(0D, cast(pmod(-length(text), 32) as int)))")
    height = F.ceil(F.length("text") / 32).cast("int")
    return rows.select(F.col("doc_id").alias("image_id"), height.alias("height"), F.lit(32).alias("width"), F.lit(1).alias("channels"), F.explode(F.array(data)).alias("data"))
