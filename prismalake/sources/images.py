"""Reading image files into plane rows and writing plane rows as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.planes import DATA, C
from ..operators.pointwise import as_gray as gray_of
from ..operators.pointwise import to_u8
from .image_writer import EXPORTED, MADE, ImageFiles, checked_extension, opened


def checked_path(path: str) -> str:
    if not isinstance(path, str):
        raise TypeError(f"path must be a str, got {type(path).__name__}")
    if not path.strip():
        raise ValueError("path is empty")
    return path


def from_image_rows(rows: DataFrame) -> DataFrame:
    """Plane rows (with ``origin``) of Spark's image source: blue-green-red becomes red-green-blue, alpha goes."""
    raw = rows.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("raw"))
    byte = lambda i: F.conv(F.hex(F.substring("raw", i + 1, F.lit(1))), 16, 10).cast("double")
    channels = F.when(F.col("n") == 1, 1).otherwise(3)
    size = F.col("height") * F.col("width") * channels
    place = lambda i: F.when(F.col("n") == 1, i).otherwise(F.floor(i / 3) * F.col("n") + 2 - i % 3).cast("int")
    data = F.transform(F.sequence(F.lit(0), size - 1), lambda i: byte(place(i)))
    return raw.select(F.xxhash64("origin").alias("image_id"), "height", "width", channels.alias("channels"), data.alias("data"), "origin")


def read_image(spark: SparkSession, path: str, as_gray: bool = False, broken: str = "raise") -> DataFrame:
    """Plane rows of the PNG, JPEG and other files at a path or glob (read by Spark, so any of its stores will do).

    A path without files raises FileNotFoundError at once. A file that cannot be decoded raises when it is read; with
    ``broken="report"`` it is a row with its ``origin``, an ``error`` and null for all that is not known."""
    if broken not in ("raise", "report"):
        raise ValueError(f"unknown handling of broken files {broken!r}; raise or report")
    at = spark._jvm.org.apache.hadoop.fs.Path(checked_path(path))
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        raise FileNotFoundError(path)
    rows = spark.read.format("image").load(path)
    bad = F.col("image.height") <= 0
    if broken == "raise":
        error = F.raise_error(F.concat(F.lit("cannot decode "), F.col("image.origin"))).cast(rows.schema["image"].dataType)
        df = from_image_rows(rows.withColumn("image", F.when(bad, error).otherwise(F.col("image"))))
        return gray_of(df) if as_gray else df
    good = from_image_rows(rows.where(~bad))
    good = (gray_of(good) if as_gray else good).withColumn("error", F.lit(None).cast("string"))
    lost = rows.where(bad).select(F.col("image.origin").alias("origin"), F.lit("cannot be decoded").alias("error"))
    lost = lost.select(*[F.xxhash64("origin").alias(c) if c == "image_id" else F.col(c) if c in ("origin", "error") else F.lit(None).cast(good.schema[c].dataType).alias(c) for c in good.columns])
    return good.unionByName(lost)


def export_image(df: DataFrame, path: str, floating: bool = False, extension: str = "png", quality: int = 90) -> DataFrame:
    """Write each row as ``<image_id>.<extension>`` (png, jpg or jpeg) in the folder ``path``; returns (image_id, file, bytes).

    The files appear when all tasks are done; a job that fails leaves none. Images of 1, 3 or 4 channels are written, as
    JPEG (baseline, ``quality`` from 1 to 100) of 1 or 3. Of rows with one id one file stays; a null id or image raises.
    """
    kind = checked_extension(extension)
    if not isinstance(quality, int) or not 1 <= quality <= 100:
        raise ValueError(f"quality lies between 1 and 100, got {quality!r}")
    job, spark = uuid.uuid4().hex, df.sparkSession
    store, folder = opened(checked_path(path))
    allowed = (1, 3, 4) if kind == "png" else (1, 3)
    bad = lambda what: F.raise_error(F.concat(*what))
    whole = F.col("image_id").isNotNull() & DATA().isNotNull() & (F.size(DATA()) == F.col("height") * F.col("width") * C()) & (F.size(DATA()) > 0)
    raw = F.transform(DATA(), lambda v: to_u8(v, floating).cast("int"))
    raw = F.when(~C().isin(*allowed), bad([F.lit(f"{kind} has {' or '.join(map(str, allowed))} channels, got "), C().cast("string")]).cast("array<int>")).otherwise(raw)
    raw = F.when(~F.coalesce(whole, F.lit(False)), bad([F.lit("no image to export in the row of id "), F.coalesce(F.col("image_id").cast("string"), F.lit("null"))]).cast("array<int>")).otherwise(raw)
    rows = df.select("image_id", "height", "width", "channels", raw.alias("data"))
    spark.dataSource.register(ImageFiles)
    rows.write.format(ImageFiles.name()).mode("append").options(path=path, extension=extension, kind=kind, quality=quality, job=job).save()
    made = f"{MADE}/{job}"
    return spark.read.schema(EXPORTED).parquet(f"{path.rstrip('/')}/{made}" if "://" in path or path.startswith("file:") else f"file://{folder}/{made}")


def write_planes(df: DataFrame, path: str) -> None:
    df.write.parquet(checked_path(path))


def write_histograms(table: DataFrame, path: str) -> None:
    table.write.csv(checked_path(path), header=True)
