"""Shapes and texts from tables, drawn on many images at once.

Every drawing table becomes ``marks(image_id, ord, y, x, color)``, one row for each place that a shape covers. Edges
meet the scanlines that they cross, lines their steps, texts the font's dimension table; marks beyond a canvas are left
out before they are made, so a shape costs no more than its visible part (and its rows). ``overlay`` keeps the mark of the
greatest ``ord`` at each place (the last writer) and joins the marks to the pixels by image and place: a shape or an image with
very many marks is spread over all tasks.

``color`` is an array with one value for each channel. Canvas sizes come from ``canvases(image_id, height, width)``.
Rows whose image, coordinates, text or colour are null draw nothing; shapes of images that are not there neither.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import H, W, div, pixels, whole
from .drawing import FONT

MARK = ["image_id", "ord", "y", "x", "color"]


def canvases(df: DataFrame) -> DataFrame:
    """(image_id, height, width) of plane or tile rows."""
    return df.select("image_id", "height", "width").distinct()


def _between(first: Column, last: Column) -> Column:
    """The whole numbers from one to the other; none if the last lies before the first."""
    return F.when(first <= last, F.sequence(whole(first), whole(last))).otherwise(F.array().cast("array<int>"))


def edges(polygons: DataFrame) -> DataFrame:
    """(image_id, ord, color, ax, ay, bx, by, ...) of closed polygons ``(image_id, ord, vertices array<struct<x, y>>, color)``."""
    bad = F.raise_error(F.concat(F.lit("a polygon has at least three vertices, got "), F.size("vertices").cast("string"))).cast(dict(polygons.dtypes)["vertices"])
    v = F.when(F.size("vertices") >= 3, F.col("vertices")).otherwise(bad)
    rows = polygons.where("vertices is not null").withColumn("vertices", v)
    pair = F.transform("vertices", lambda a, i: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), F.get("vertices", (i + 1) % F.size("vertices"))["x"].alias("bx"), F.get("vertices", (i + 1) % F.size("vertices"))["y"].alias("by")))
    rest = [c for c in polygons.columns if c != "vertices"]
    return rows.select(*rest, F.explode(pair).alias("e")).select(*rest, "e.ax", "e.ay", "e.bx", "e.by")


def filled_polygons(polygons: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of even-odd filling: edges meet the scanlines from their upper end (included) to the lower one."""
    e = edges(polygons).where("ay != by").join(sizes, "image_id")
    rows = e.withColumn("y", F.explode(_between(F.greatest(F.lit(0), F.least("ay", "by")), F.least(H(), F.greatest("ay", "by")) - 1)))
    cross = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")).cast("double")
    lines = rows.withColumn("xi", cross).groupBy("image_id", "ord", "y").agg(F.first("color").alias("color"), F.first("width").alias("width"), F.sort_array(F.collect_list("xi")).alias("xs"))  # as many as edges
    spans = F.transform(_between(F.lit(0), F.floor(F.size("xs") / 2) - 1), lambda k: F.struct(F.floor(F.get("xs", 2 * k)).alias("a"), F.ceil(F.get("xs", 2 * k + 1)).alias("b")))
    rows = lines.select("image_id", "ord", "y", "color", "width", F.explode(spans).alias("s"))
    return rows.select("image_id", "ord", "y", F.explode(_between(F.greatest(F.lit(0), F.col("s.a")), F.least(W() - 1, F.col("s.b")))).alias("x"), "color")


def lines(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of ``(image_id, ord, ax, ay, bx, by, thickness, color)``: one step for each place on the longer axis, the other
    coordinate the nearest (of two the one nearer to the start), thickness across the longer axis."""
    t = table.join(sizes, "image_id")
    dx, dy = F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))
    t = t.withColumns({"steep": dx < dy, "long": F.greatest(dx, dy), "short": F.least(dx, dy), "sx": F.when(F.col("bx") >= F.col("ax"), 1).otherwise(-1), "sy": F.when(F.col("by") >= F.col("ay"), 1).otherwise(-1)})
    # the steps that lie on the canvas
    start, sign, n = (F.when(F.col("steep"), F.col(a)).otherwise(F.col(b)) for a, b in (("ay", "ax"), ("sy", "sx"), ("height", "width")))
    ahead = F.when(sign > 0, -start).otherwise(start - n + 1)
    last = F.when(sign > 0, n - 1 - start).otherwise(start)
    t = t.withColumn("i", F.explode(_between(F.greatest(F.lit(0), ahead), F.least(F.col("long"), last))))
    aside = F.when(F.col("long") == 0, 0).otherwise(F.ceil((2 * F.col("i") * F.col("short") - F.col("long")) / F.greatest(F.lit(1), 2 * F.col("long"))))
    half = div(F.coalesce("thickness", F.lit(1)), 2)
    t = t.withColumn("k", F.explode(_between(-half, half))).withColumn("aside", aside)
    y = F.when(F.col("steep"), F.col("ay") + F.col("sy") * F.col("i")).otherwise(F.col("ay") + F.col("sy") * F.col("aside") + F.col("k"))
    x = F.when(F.col("steep"), F.col("ax") + F.col("sx") * F.col("aside") + F.col("k")).otherwise(F.col("ax") + F.col("sx") * F.col("i"))
    return t.select("image_id", "ord", whole(y).alias("y"), whole(x).alias("x"), "color", "height", "width").where("y >= 0 and y < height and x >= 0 and x < width").select(*MARK)


def polygon_outlines(polygons: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of closed outlines; a column ``thickness`` is optional."""
    rows = edges(polygons)
    return lines(rows if "thickness" in rows.columns else rows.withColumn("thickness", F.lit(1)), sizes)


def rectangles(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of ``(image_id, ord, x0, y0, x1, y1, thickness, filled, color)``, corners moved onto the canvas first; a filled
    one that lies beyond the canvas draws nothing."""
    t = table.join(sizes, "image_id")
    inner = lambda v, n: F.greatest(F.lit(0), F.least(n - 1, v))
    low = {"ax": inner(F.least("x0", "x1"), W()), "ay": inner(F.least("y0", "y1"), H()), "bx": inner(F.greatest("x0", "x1"), W()), "by": inner(F.greatest("y0", "y1"), H())}
    full = t.where("filled").where((F.greatest("x0", "x1") >= 0) & (F.greatest("y0", "y1") >= 0) & (F.least("x0", "x1") < W()) & (F.least("y0", "y1") < H())).withColumns(low)
    full = full.withColumn("y", F.explode(_between(F.col("ay"), F.col("by")))).select("image_id", "ord", "y", F.explode(_between(F.col("ax"), F.col("bx"))).alias("x"), "color")
    corner = t.where("not filled").withColumns(low)
    sides = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(pick, ("pa", "qa", "pb", "qb"))]) for pick in (("ax", "ay", "bx", "ay"), ("bx", "ay", "bx", "by"), ("bx", "by", "ax", "by"), ("ax", "by", "ax", "ay"))])
    four = corner.select("image_id", "ord", "thickness", "color", F.explode(sides).alias("s")).select("image_id", "ord", "thickness", "color", F.col("s.pa").alias("ax"), F.col("s.qa").alias("ay"), F.col("s.pb").alias("bx"), F.col("s.qb").alias("by"))
    return full.unionByName(lines(four, sizes))


def points(table: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of ``(image_id, ord, x, y, radius, color)``: discs of squared distance below the squared radius."""
    t = table.join(sizes, "image_id").withColumnsRenamed({"x": "cx", "y": "cy"})
    r = F.col("radius") - 1
    t = t.withColumn("y", F.explode(_between(F.greatest(F.lit(0), F.col("cy") - r), F.least(H() - 1, F.col("cy") + r))))
    t = t.withColumn("x", F.explode(_between(F.greatest(F.lit(0), F.col("cx") - r), F.least(W() - 1, F.col("cx") + r))))
    near = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) < F.col("radius") * F.col("radius")
    return t.where(near).select(*MARK)


def font_table(spark) -> DataFrame:
    """(ch, row, bits): the dimension table of the font, seven rows for each character."""
    rows = [(ch, row, bits) for ch, rows in FONT.items() for row, bits in enumerate(rows)]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))], ["ch", "row", "bits"]))


def texts(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Marks of ``(image_id, ord, text, x, y, scale, color)``: upper-cased, other characters are blanks."""
    t = labels.where("text is not null and text != ''").join(sizes, "image_id").withColumnsRenamed({"x": "px", "y": "py"})
    t = t.withColumn("scale", F.greatest(F.lit(1), F.rint(F.coalesce("scale", F.lit(1)).cast("double")).cast("int")))
    chars = t.select("*", F.posexplode(F.split(F.upper("text"), "")).alias("n", "ch"))
    left = F.col("px") + 6 * F.col("n") * F.col("scale")
    chars = chars.where((left + 5 * F.col("scale") > 0) & (left < W()))
    inked = chars.join(F.broadcast(font_table(labels.sparkSession).where("bits > 0")), "ch")  # 47 characters of seven rows
    inked = inked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(F.expr("shiftright(bits, 4 - k) & 1 = 1"))
    top, side = F.col("py") + F.col("row") * F.col("scale"), F.col("px") + (6 * F.col("n") + F.col("k")) * F.col("scale")
    inked = inked.withColumn("y", F.explode(_between(F.greatest(F.lit(0), top), F.least(H() - 1, top + F.col("scale") - 1))))
    return inked.select("image_id", "ord", "y", F.explode(_between(F.greatest(F.lit(0), side), F.least(W() - 1, side + F.col("scale") - 1))).alias("x"), "color")


def overlay(values: DataFrame, marks: DataFrame) -> DataFrame:
    """Pixel rows ``(image_id, c, y, x, v)`` under the marks; where several meet, the one of the greatest ``ord`` counts."""
    last = marks.where("color is not null").groupBy("image_id", "y", "x").agg(F.max_by("color", "ord").alias("color"))
    bad = F.raise_error(F.lit("a colour needs a value for each channel")).cast("double")
    new = F.when(F.col("color").isNull(), F.col("v")).otherwise(F.coalesce(F.get("color", F.col("c")).cast("double"), bad))
    return values.join(last, ["image_id", "y", "x"], "left").select("image_id", "c", "y", "x", new.alias("v"))


def drawn(df: DataFrame, marks: DataFrame) -> DataFrame:
    """Pixel rows of plane rows under the marks."""
    return overlay(pixels(df), marks)
