"""The image queries by name, and their SQL over the same tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.planes import pixels
from ..operators import descriptors as D
from ..operators import drawing as dr
from ..operators import geometry as g
from ..operators import histograms as hi
from ..operators import kernels as kn
from ..operators import pointwise as pw
from ..operators import shapes as sh
from ..operators import stencils as st
from ..operators import tiles as ti
from ..sources.tables import gray8, mosaic, mosaic_pixels, rgb8, text32

R = 4  # decimals that are compared
BINOMIAL = [[1, 2, 1], [2, 4, 2], [1, 2, 1]]
SLANTED = [[1, 0, -2], [3, 1, 0], [0, -1, 2]]
TRIANGLE = [(1, 0), (6, 2), (3, 7)]

LEVEL = "least(255, greatest(0, floor(e::double * 256 + 128)))::double"
GRAY = f"img AS (SELECT vec_id AS image_id, 0 AS c, (p // 8)::int AS y, (p % 8)::int AS x, {LEVEL} AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"
RGB = f"have AS (SELECT vec_id // 3 AS image_id, (vec_id % 3)::int AS c, (p // 8)::int AS y, (p % 8)::int AS x, {LEVEL} AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)), img AS (SELECT g.image_id, g.c, g.y, g.x, coalesce(v, 0)::double AS v FROM (SELECT image_id, k.c, y.y, x.x FROM (SELECT DISTINCT image_id FROM have), (SELECT unnest(range(3))::int AS c) k, (SELECT unnest(range(8))::int AS y) y, (SELECT unnest(range(8))::int AS x) x) g LEFT JOIN have USING (image_id, c, y, x))"
TEXT = "img AS (SELECT doc_id AS image_id, 0 AS c, (p // 32)::int AS y, (p % 32)::int AS x, (CASE WHEN p < length(text) THEN unicode(text[p + 1]) % 256 ELSE 0 END)::double AS v FROM (SELECT doc_id, text, unnest(range(((length(text) + 31) // 32) * 32)) AS p FROM documents WHERE text <> ''))"


def mosaic_sql(down: int, across: int) -> str:
    """Images of ``down`` x ``across`` vectors; places without one are 0."""
    n = down * across
    have = f"have AS (SELECT vec_id // {n} AS image_id, ((vec_id % {n}) // {across} * 8 + p // 8)::int AS y, ((vec_id % {n}) % {across} * 8 + p % 8)::int AS x, {LEVEL} AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"
    return f"{have}, img AS (SELECT image_id, 0 AS c, y, x, coalesce(v, 0)::double AS v FROM (SELECT image_id, y.y, x.x FROM (SELECT DISTINCT image_id FROM have), (SELECT unnest(range({8 * down}))::int AS y) y, (SELECT unnest(range({8 * across}))::int AS x) x) LEFT JOIN have USING (image_id, y, x))"


SMALL, LARGE, SIDE = (3, 5), (16, 32), 40  # mosaics of 24 x 40 and, cut into tiles that do not divide them, 128 x 256 pixels


def out(value: str = "v") -> str:
    return f"image_id::bigint AS image_id, c::int AS c, y::int AS y, x::int AS x, round(({value})::double, {R}) + 0.0 AS v"


def rounded(v) -> Column:
    """``R`` decimals; whole numbers, which most values are, are not rounded by way of a decimal."""
    v = F.col(v)
    return F.when(v == F.rint(v), v + 0.0).otherwise(F.round(v, R) + 0.0)


def shown(df: DataFrame, *more: str) -> DataFrame:
    return pixels(df, *more).select(F.col("image_id").cast("long").alias("image_id"), "c", "y", "x", rounded("v").alias("v"), *more)


def shown_pixels(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("image_id").cast("long").alias("image_id"), "c", "y", "x", rounded("v").alias("v"))


def vector(df: DataFrame) -> DataFrame:
    rows = df.select(F.col("image_id").cast("long").alias("image_id"), F.posexplode("vec").alias("i", "v"))
    return rows.select("image_id", "i", (F.round("v", R) + 0.0).alias("v"))


def of(source, op, show=shown):
    return lambda spark, sf_dir: show(op(source(spark, sf_dir)))


def pixel_sql(value: str, source: str = GRAY) -> str:
    return f"WITH {source}, w AS (SELECT *, min(v) OVER i AS lo, max(v) OVER i AS hi, avg(v) OVER i AS mu, stddev_pop(v) OVER i AS sd FROM img WINDOW i AS (PARTITION BY image_id)) SELECT {out(value)} FROM w"


def edge_sql(mode: str, e: str, n: int) -> str:
    if mode == "zero":
        return e
    if mode == "replicate":
        return f"greatest(0, least({n - 1}, {e}))"
    return f"({n - 1} - abs({n - 1} - ((({e}) % {2 * (n - 1)}) + {2 * (n - 1)}) % {2 * (n - 1)}))"


def taps(kernel) -> str:
    kh, kw = len(kernel), len(kernel[0])
    return "taps(dy, dx, w) AS (VALUES " + ", ".join(f"({i - kh // 2}, {j - kw // 2}, {float(w)!r}::double)" for i, r in enumerate(kernel) for j, w in enumerate(r)) + ")"


def turned(kernel):
    return [r[::-1] for r in kernel[::-1]]


def near_sql(mode: str, n: int = 8, wide: int | None = None) -> str:
    """Every pixel with its neighbours ``q`` under the taps; images are ``n`` high and ``wide`` across (else ``n``)."""
    return f"near AS (SELECT p.image_id, p.c, p.y, p.x, p.v, t.dy, t.dx, t.w, coalesce(q.v, 0) AS q FROM img p CROSS JOIN taps t LEFT JOIN img q ON q.image_id = p.image_id AND q.c = p.c AND q.y = {edge_sql(mode, 'p.y + t.dy', n)} AND q.x = {edge_sql(mode, 'p.x + t.dx', wide or n)})"


def stencil_sql(kernel, mode: str, agg: str = "sum(q * w)", source: str = GRAY, value: str = "s", n: int = 8, wide: int | None = None) -> str:
    return f"WITH {source}, {taps(kernel)}, {near_sql(mode, n, wide)}, s AS (SELECT image_id, c, y, x, any_value(v) AS v, {agg} AS s FROM near GROUP BY ALL), z AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM s) SELECT {out(value)} FROM z".replace("GROUP BY ALL)", "GROUP BY image_id, c, y, x)")


def ones(k: int):
    return [[1] * k] * k


def pad_sql(h: int, w: int, mode: str) -> str:
    grid = f"grid AS (SELECT image_id, gy.y, gx.x FROM (SELECT DISTINCT image_id FROM img), (SELECT unnest(range({8 + 2 * h}))::int AS y) gy, (SELECT unnest(range({8 + 2 * w}))::int AS x) gx)"
    return f"WITH {GRAY}, {grid}, o AS (SELECT g.image_id, 0 AS c, g.y, g.x, coalesce(i.v, 0) AS v FROM grid g LEFT JOIN img i ON i.image_id = g.image_id AND i.y = {edge_sql(mode, f'(g.y - {h})', 8)} AND i.x = {edge_sql(mode, f'(g.x - {w})', 8)}) SELECT {out()} FROM o"


def gather_sql(new_h: int, new_w: int, sy: str, sx: str, method: str, valid: str = "TRUE", fill: float = 0) -> str:
    """Target places with real source places (sy, sx), sampled."""
    clamp = lambda e: f"greatest(0, least(7, ({e})::int))"
    grid = f"g AS (SELECT image_id, y, x, {sy} AS sy, {sx} AS sx FROM (SELECT DISTINCT image_id FROM img), (SELECT unnest(range({new_h}))::int AS y), (SELECT unnest(range({new_w}))::int AS x))"
    join = lambda a, ey, ex: f"LEFT JOIN img {a} ON {a}.image_id = g.image_id AND {a}.y = {clamp(ey)} AND {a}.x = {clamp(ex)}"
    if method == "nearest":
        body, value = join("a", "round_even(sy, 0)", "round_even(sx, 0)"), "a.v"
    else:
        fy, fx = "(sy - floor(sy))", "(sx - floor(sx))"
        body = " ".join(join(n, f"floor(sy) + {i}", f"floor(sx) + {j}") for n, i, j in (("a", 0, 0), ("b", 0, 1), ("d", 1, 0), ("e", 1, 1)))
        value = f"(1 - {fy}) * (1 - {fx}) * a.v + (1 - {fy}) * {fx} * b.v + {fy} * (1 - {fx}) * d.v + {fy} * {fx} * e.v"
    return f"WITH {GRAY}, {grid}, o AS (SELECT g.image_id, 0 AS c, g.y, g.x, CASE WHEN {valid} THEN {value} ELSE {float(fill)} END AS v FROM g {body}) SELECT {out()} FROM o"


def rotate_sql(angle: float, method: str, fill: float) -> str:
    cos, sin = repr(math.cos(math.radians(angle))), repr(math.sin(math.radians(angle)))
    sx, sy = f"({cos}::double * (x - 3.5::double) + {sin}::double * (y - 3.5::double) + 3.5::double)", f"(-({sin}::double) * (x - 3.5::double) + {cos}::double * (y - 3.5::double) + 3.5::double)"
    return gather_sql(8, 8, sy, sx, method, "sx >= 0 AND sx <= 7 AND sy >= 0 AND sy <= 7", fill)


def line_sql(x0: int, y0: int, x1: int, y1: int, thickness: int = 1) -> str:
    """(py, px) of a line: for each place on the longer axis the nearest one on the other, of two the one nearer to the
    start (a quotient less a half, rounded up), and the places beside it along that axis."""
    across, down = abs(x1 - x0), abs(y1 - y0)
    to_x, to_y = (1 if x1 >= x0 else -1), (1 if y1 >= y0 else -1)
    long, short = max(across, down), min(across, down)
    aside = f"-((({long} - 2 * i * {short}) - (({long} - 2 * i * {short}) % {2 * long} + {2 * long}) % {2 * long}) // {2 * long})" if long else "0"
    flat = (f"{y0} + {to_y} * ({aside}) + k", f"{x0} + {to_x} * i")
    steep = (f"{y0} + {to_y} * i", f"{x0} + {to_x} * ({aside}) + k")
    py, px = flat if across >= down else steep
    return f"SELECT ({py})::int AS py, ({px})::int AS px FROM (SELECT unnest(range({long + 1})) AS i), (SELECT unnest(range({-(thickness // 2)}, {thickness // 2 + 1})) AS k)"


def lines_sql(corners: list, color) -> str:
    """The overlay of lines between consecutive corners."""
    return overlay_sql(" UNION ".join(line_sql(*a, *b) for a, b in zip(corners, corners[1:])), color)


def overlay_sql(places, color) -> str:
    """``places``: pairs (y, x), or SQL of (py, px)."""
    source, value = (RGB, f"CASE c WHEN 0 THEN {color[0]} WHEN 1 THEN {color[1]} ELSE {color[2]} END") if isinstance(color, tuple) else (GRAY, str(color))
    if not isinstance(places, str):
        listed = ", ".join(f"({y}, {x})" for y, x in sorted(places)) or "(-1, -1)"
        places = f"SELECT * FROM (VALUES {listed}) AS l(py, px)"
    return f"WITH {source}, places AS (SELECT DISTINCT py, px FROM ({places})) SELECT {out(f'CASE WHEN places.py IS NULL THEN v ELSE {value} END')} FROM img LEFT JOIN places ON y = places.py AND x = places.px"


def polygon_sql(vertices, color) -> str:
    edges = ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(vertices, [*vertices[1:], vertices[0]]))
    return f"""WITH {GRAY}, edges(ax, ay, bx, b_y) AS (VALUES {edges}), rows AS (SELECT unnest(range(8))::int AS y),
crossings AS (SELECT y, ax + (y - ay) * (bx - ax) / (b_y - ay)::double AS xi FROM rows, edges WHERE ay != b_y AND y >= least(ay, b_y) AND y < greatest(ay, b_y)),
ranked AS (SELECT y, xi, row_number() OVER (PARTITION BY y ORDER BY xi) AS k FROM crossings),
spans AS (SELECT a.y, floor(a.xi) AS x0, ceil(b.xi) AS x1 FROM ranked a JOIN ranked b ON a.y = b.y AND b.k = a.k + 1 WHERE a.k % 2 = 1)
SELECT {out(f'CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.y = img.y AND img.x BETWEEN s.x0 AND s.x1) THEN {color} ELSE v END')} FROM img"""


def text_pixels(text: str, x: int, y: int, scale: int) -> set:
    found = set()
    for i, ch in enumerate(text.upper()):
        for r, bits in enumerate(dr.FONT.get(ch, dr.FONT[" "])):
            for k in range(5):
                if bits >> (4 - k) & 1:
                    found |= {(y + r * scale + a, x + (6 * i + k) * scale + b) for a in range(scale) for b in range(scale)}
    return found


HIST = f"WITH {{source}}, n AS (SELECT image_id, least(floor(v)::int, 255) AS level, count(*) AS n FROM img GROUP BY 1, 2), every AS (SELECT image_id, unnest(range(256))::int AS level FROM (SELECT DISTINCT image_id FROM img)), h AS (SELECT e.image_id, e.level, coalesce(n.n, 0)::bigint AS n FROM every e LEFT JOIN n USING (image_id, level))"


def hist_sql(source: str) -> str:
    return HIST.replace("{source}", source) + " SELECT image_id::bigint AS image_id, level AS bin, level::double AS lo, (level + 1)::double AS hi, n AS count FROM h"


EQUALIZE = (
    HIST
    + f""", cdf AS (SELECT image_id, level, sum(n) OVER (PARTITION BY image_id ORDER BY level)::double AS s FROM h),
f AS (SELECT image_id, min(s) FILTER (WHERE s > 0) AS f, max(s) AS n FROM cdf GROUP BY 1)
SELECT {out("CASE WHEN f.n = f.f THEN 0 ELSE round_even(greatest(s - f.f, 0) / nullif(f.n - f.f, 0) * 255, 0) END")} FROM img JOIN cdf USING (image_id) JOIN f USING (image_id) WHERE level = floor(v)::int"""
)

OTSU = (
    HIST.replace("{source}", TEXT)
    + f""", run AS (SELECT image_id, level, (sum(n) OVER w)::double AS c, (sum(n * level) OVER w)::double AS s FROM h WINDOW w AS (PARTITION BY image_id ORDER BY level)),
tot AS (SELECT image_id, max(c) AS tc, max(s) AS ts FROM run GROUP BY 1),
b AS (SELECT image_id, level, CASE WHEN c > 0 AND c < tc THEN (s * tc - ts * c) ** 2 / (c * (tc - c)) ELSE 0.0 END AS b FROM run JOIN tot USING (image_id)),
best AS (SELECT image_id, min(level)::double AS threshold FROM (SELECT *, max(b) OVER (PARTITION BY image_id) AS mb FROM b) WHERE b = mb GROUP BY 1)
SELECT {out("CASE WHEN v > threshold THEN 255 ELSE 0 END")}, threshold FROM img JOIN best USING (image_id)"""
)

LUMA = "img AS (SELECT image_id, 0 AS c, y, x, 0.2989::double * max(u) FILTER (WHERE c = 0) + 0.5870::double * max(u) FILTER (WHERE c = 1) + 0.1140::double * max(u) FILTER (WHERE c = 2) AS v FROM (SELECT *, CASE WHEN max(v) OVER (PARTITION BY image_id) > 1 THEN v / 255.0::double ELSE v END AS u FROM raw) GROUP BY image_id, y, x)"
GRAY_UNIT = GRAY.replace("img AS", "raw AS", 1) + ", img AS (SELECT image_id, c, y, x, CASE WHEN max(v) OVER (PARTITION BY image_id) > 1 THEN v / 255.0::double ELSE v END AS v FROM raw)"
SOBEL = f"{taps([[0] * 3] * 3)}, {near_sql('reflect')}, sob AS (SELECT image_id, c, y, x, sum(q * -dx * (2 - abs(dy))) AS gx, sum(q * -dy * (2 - abs(dx))) AS gy FROM near GROUP BY image_id, c, y, x)"


def sobel_rows(df: DataFrame) -> DataFrame:
    s = st.sobel_gradients(df)
    rows = s.select("image_id", "width", F.posexplode(F.arrays_zip("gx", "gy", "magnitude", "angle")).alias("p", "s"))
    r = lambda c: (F.round(F.col(f"s.{c}"), R) + 0.0).alias(c)
    return rows.select(F.col("image_id").cast("long").alias("image_id"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), r("gx"), r("gy"), r("magnitude"), r("angle"))


def _hist_rows(df: DataFrame) -> DataFrame:
    h = hi.histogram(df)
    return h.select(F.col("image_id").cast("long").alias("image_id"), "bin", "lo", "hi", "count")


def _table_rows(df: DataFrame) -> DataFrame:
    h = hi.histogram_dataframe(df)
    r = lambda c: (F.round(c, 8) + 0.0).alias(c)
    return h.select(F.col("image_id").cast("long").alias("image_id"), "bin", "intensity", "count", r("probability"), r("cdf"))


def _bits(df: DataFrame) -> DataFrame:
    rows = pw.bit_plane_all(df)
    out_rows = rows.select("image_id", "bit", "width", F.posexplode("data").alias("p", "v"))
    return out_rows.select(F.col("image_id").cast("long").alias("image_id"), "bit", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).alias("x"), F.col("v").cast("int").alias("v"))


def _kernel(spark, sf_dir) -> DataFrame:
    k = st.gaussian_kernel(5, 1.2)
    return spark.createDataFrame([(i, j, w) for i, r in enumerate(k) for j, w in enumerate(r)], "ky int, kx int, w double").select("ky", "kx", F.round("w", 10).alias("w"))


def _gauss(k, s):
    return st.gaussian_kernel(k, s)


def _vec_sql(body: str) -> str:
    return f"SELECT image_id::bigint AS image_id, i::int AS i, round(v::double, {R}) + 0.0 AS v FROM ({body})"


def _color_sql(bins: int = 32) -> str:
    return f"WITH {RGB}, n AS (SELECT image_id, c, least(floor(v / 256 * {bins})::int, {bins - 1}) AS b, count(*) AS n FROM img GROUP BY 1, 2, 3), every AS (SELECT image_id, c, unnest(range({bins}))::int AS b FROM (SELECT DISTINCT image_id, c FROM img)) " + _vec_sql(f"SELECT image_id, c * {bins} + b AS i, coalesce(n, 0) / 64.0::double AS v FROM every LEFT JOIN n USING (image_id, c, b)")


def _gradient_sql(bins: int = 64) -> str:
    """A bin is cut off from a real number, so the nine terms of a sum are added in the order of ``_weighted``, row by row."""
    sobel = SOBEL.replace("(2 - abs(dy)))", "(2 - abs(dy)) ORDER BY dy, dx)").replace("(2 - abs(dx)))", "(2 - abs(dx)) ORDER BY dy, dx)")
    return f"WITH {GRAY_UNIT}, {sobel}, m AS (SELECT image_id, sqrt(gx * gx + gy * gy) AS m FROM sob), t AS (SELECT *, CASE WHEN max(m) OVER (PARTITION BY image_id) = 0 THEN 1 ELSE max(m) OVER (PARTITION BY image_id) END AS top FROM m), n AS (SELECT image_id, least(floor(m / top * {bins})::int, {bins - 1}) AS b, count(*) AS n FROM t GROUP BY 1, 2), every AS (SELECT image_id, unnest(range({bins}))::int AS b FROM (SELECT DISTINCT image_id FROM img)) " + _vec_sql("SELECT image_id, b AS i, coalesce(n, 0) / 64.0::double AS v FROM every LEFT JOIN n USING (image_id, b)")


HU = f"""WITH {GRAY_UNIT}, m AS (SELECT image_id, sum(v) AS m, sum(x * v) / sum(v) AS cx, sum(y * v) / sum(v) AS cy FROM img GROUP BY 1),
e AS (SELECT image_id, any_value(m) AS m, """ + ", ".join(f"sum(v * (x - cx) ** {p} * (y - cy) ** {q}) / any_value(m) ** {1 + (p + q) / 2} AS e{p}{q}" for p, q in ((2, 0), (0, 2), (1, 1), (3, 0), (0, 3), (2, 1), (1, 2))) + f""" FROM img JOIN m USING (image_id) GROUP BY 1),
u AS (SELECT image_id, e20, e02, e11, e30 + e12 AS a, e21 + e03 AS b, e30 - 3 * e12 AS c, 3 * e21 - e03 AS d FROM e),
h AS (SELECT image_id, [e20 + e02, (e20 - e02) ** 2 + 4 * e11 ** 2, c * c + d * d, a * a + b * b, c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
 (e20 - e02) * (a * a - b * b) + 4 * e11 * a * b, d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b)] AS h FROM u)
""" + _vec_sql("SELECT image_id, i, sign(v) * log10(abs(v) + 1e-10) AS v FROM (SELECT image_id, generate_subscripts(h, 1) - 1 AS i, unnest(h) AS v FROM h)")


def _hog_sql(cell: int = 2, block: int = 2, bins: int = 9) -> str:
    n = 8 // cell
    b = n - block + 1
    return f"""WITH {GRAY_UNIT}, {SOBEL}, p AS (SELECT image_id, y // {cell} AS cy, x // {cell} AS cx, sqrt(gx * gx + gy * gy) AS m, least(floor(degrees(atan2(abs(gy), abs(gx)))::float::double / {180 / bins}), {bins - 1})::int AS bin FROM sob),
cells AS (SELECT image_id, cy, cx, bin, sum(m) AS m FROM p GROUP BY ALL),
dense AS (SELECT i.image_id, cy, cx, bin, coalesce(m, 0) AS m FROM (SELECT DISTINCT image_id FROM img) i CROSS JOIN (SELECT unnest(range({n})) AS cy) CROSS JOIN (SELECT unnest(range({n})) AS cx) CROSS JOIN (SELECT unnest(range({bins}))::int AS bin) LEFT JOIN cells USING (image_id, cy, cx, bin)),
placed AS (SELECT image_id, cy - dy AS b_y, cx - dx AS bx, dy, dx, bin, m FROM dense, (SELECT unnest(range({block})) AS dy), (SELECT unnest(range({block})) AS dx) WHERE cy - dy BETWEEN 0 AND {b - 1} AND cx - dx BETWEEN 0 AND {b - 1})
""" + _vec_sql(f"SELECT image_id, (((b_y * {b} + bx) * {block} + dy) * {block} + dx) * {bins} + bin AS i, m / (sqrt(sum(m * m) OVER (PARTITION BY image_id, b_y, bx)) + 1e-6) AS v FROM placed")


def _lbp_sql(points: int = 8, bins: int = 64) -> str:
    clamp = lambda e: f"greatest(0, least(7, ({e})::int))"
    values = ", ".join(f"({k}, {math.sin(2 * math.pi * k / points)!r}::double, {math.cos(2 * math.pi * k / points)!r}::double)" for k in range(points))
    joins = " ".join(f"JOIN img {a} ON {a}.image_id = s.image_id AND {a}.y = {clamp(f'y0 + {i}')} AND {a}.x = {clamp(f'x0 + {j}')}" for a, i, j in (("a", 0, 0), ("b", 0, 1), ("d", 1, 0), ("e", 1, 1)))
    return f"""WITH {GRAY_UNIT}, pts(k, dy, dx) AS (VALUES {values}),
s AS (SELECT image_id, y, x, v, floor(y + dy) AS y0, floor(x + dx) AS x0, (y + dy) - floor(y + dy) AS fy, (x + dx) - floor(x + dx) AS fx FROM img, pts),
code AS (SELECT s.image_id, s.y, s.x, sum(CASE WHEN (1 - fy) * (1 - fx) * a.v + (1 - fy) * fx * b.v + fy * (1 - fx) * d.v + fy * fx * e.v >= s.v THEN 1 ELSE 0 END) AS code FROM s {joins} GROUP BY 1, 2, 3),
n AS (SELECT image_id, least(floor(code / {points + 1}.0::double * {bins})::int, {bins - 1}) AS b, count(*) AS n FROM code GROUP BY 1, 2),
every AS (SELECT image_id, unnest(range({bins}))::int AS b FROM (SELECT DISTINCT image_id FROM img))
""" + _vec_sql("SELECT image_id, b AS i, coalesce(n, 0) / 64.0::double AS v FROM every LEFT JOIN n USING (image_id, b)")


def _translate_sql(tx: int, ty: int, fill: float) -> str:
    return f"WITH {GRAY} SELECT p.image_id::bigint AS image_id, p.c::int AS c, p.y::int AS y, p.x::int AS x, coalesce(q.v, {float(fill)}::double) AS v FROM img p LEFT JOIN img q ON q.image_id = p.image_id AND q.y = p.y - ({ty}) AND q.x = p.x - ({tx})"


def _tiled(op, show=shown_pixels):
    """A query over large mosaics that are only ever held as tiles."""

    def run(spark, sf_dir) -> DataFrame:
        rows = mosaic_pixels(spark, sf_dir, *LARGE)
        return show(ti.pixels_of_tiles(op(ti.tiles_of_pixels(rows, 8 * LARGE[0], 8 * LARGE[1], 1, SIDE))))

    return run


def _tiled_sobel(spark, sf_dir) -> DataFrame:
    tiles = ti.sobel_gradients(ti.tiles_of_pixels(mosaic_pixels(spark, sf_dir, *LARGE), 8 * LARGE[0], 8 * LARGE[1], 1, SIDE))
    r = lambda c: (F.round(c, R) + 0.0).alias(c)
    return ti.pixels_of_tiles(tiles, "gx", "gy", "magnitude", "angle").select(F.col("image_id").cast("long").alias("image_id"), "y", "x", r("gx"), r("gy"), r("magnitude"), r("angle"))


PLACE = "greatest(-8, least(50, floor((e[{k}] + 0.5) * 40)))"  # vertices on and around a mosaic


def _polygons(spark, sf_dir) -> DataFrame:
    """A polygon of five corners for each vector, on the mosaic that holds the vector; later ones cover earlier ones."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("e", F.col("embedding").cast("array<double>"))
    corner = [F.struct(F.expr(PLACE.format(k=2 * k)).cast("int").alias("x"), F.expr(PLACE.format(k=2 * k + 1)).cast("int").alias("y")) for k in range(5)]
    return rows.select(F.floor(F.col("vec_id") / (SMALL[0] * SMALL[1])).cast("long").alias("image_id"), F.col("vec_id").alias("ord"), F.array(*corner).alias("vertices"), F.array((F.col("vec_id") % 256).cast("double")).alias("color"))


def _drawn_polygons(filled: bool):
    def run(spark, sf_dir) -> DataFrame:
        df = mosaic(spark, sf_dir, *SMALL)
        marks = (sh.filled_polygons if filled else sh.polygon_outlines)(_polygons(spark, sf_dir), sh.canvases(df))
        return shown_pixels(sh.drawn(df, marks))

    return run


def _polygons_sql(filled: bool) -> str:
    corner = ", ".join(f"{{'x': {PLACE.format(k=2 * k + 1)}::int, 'y': {PLACE.format(k=2 * k + 2)}::int}}" for k in range(5))
    edges = f"""{mosaic_sql(*SMALL)}, shapes AS (SELECT vec_id // {SMALL[0] * SMALL[1]} AS image_id, vec_id AS ord, (vec_id % 256)::double AS color, [{corner}] AS v FROM (SELECT vec_id, embedding::double[] AS e FROM embeddings)),
edges AS (SELECT image_id, ord, color, v[k].x AS ax, v[k].y AS ay, v[k % 5 + 1].x AS bx, v[k % 5 + 1].y AS b_y FROM shapes, (SELECT unnest(range(1, 6)) AS k))"""
    if filled:
        marks = f"""rows AS (SELECT unnest(range({8 * SMALL[0]}))::int AS y),
cross_ AS (SELECT image_id, ord, color, y, ax + (y - ay) * (bx - ax) / (b_y - ay)::double AS xi FROM edges JOIN rows ON ay != b_y AND y >= least(ay, b_y) AND y < greatest(ay, b_y)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ord, y ORDER BY xi) AS k FROM cross_),
spans AS (SELECT a.image_id, a.ord, a.color, a.y, floor(a.xi) AS x0, ceil(b.xi) AS x1 FROM ranked a JOIN ranked b ON a.ord = b.ord AND a.y = b.y AND b.k = a.k + 1 WHERE a.k % 2 = 1),
marks AS (SELECT image_id, ord, color, y, x FROM spans, (SELECT unnest(range({8 * SMALL[1]}))::int AS x) WHERE x BETWEEN x0 AND x1)"""
    else:
        marks = """steps AS (SELECT *, greatest(abs(bx - ax), abs(b_y - ay)) AS long, least(abs(bx - ax), abs(b_y - ay)) AS short, unnest(range(greatest(abs(bx - ax), abs(b_y - ay)) + 1)) AS i FROM edges),
sides AS (SELECT *, CASE WHEN long = 0 THEN 0 ELSE ceil((2 * i * short - long) / (2.0::double * greatest(long, 1))) END AS aside, abs(bx - ax) < abs(b_y - ay) AS steep, CASE WHEN bx >= ax THEN 1 ELSE -1 END AS sx, CASE WHEN b_y >= ay THEN 1 ELSE -1 END AS sy FROM steps),
marks AS (SELECT image_id, ord, color, (ay + sy * CASE WHEN steep THEN i ELSE aside END)::int AS y, (ax + sx * CASE WHEN steep THEN aside ELSE i END)::int AS x FROM sides)"""
    return f"WITH {edges}, {marks}, last AS (SELECT image_id, y, x, arg_max(color, ord) AS color FROM marks GROUP BY 1, 2, 3) SELECT {out('coalesce(color, v)').replace('image_id::', 'img.image_id::').replace(' y::', ' img.y::').replace(' x::', ' img.x::')} FROM img LEFT JOIN last ON last.image_id = img.image_id AND last.y = img.y AND last.x = img.x"


LABEL = "concat_ws(':', cast(label as string), cast(vec_id as string))"


def _labels(spark, sf_dir) -> DataFrame:
    """Each vector's label and number, written on the mosaic that holds the vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    number = F.col("vec_id")
    labels = rows.select(F.floor(number / (SMALL[0] * SMALL[1])).cast("long").alias("image_id"), number.alias("ord"), F.expr(LABEL).alias("text"), (number % 43 - 9).cast("int").alias("x"), (number % 31 - 5).cast("int").alias("y"), (number % 3).cast("double").alias("scale"), F.array((number % 256).cast("double")).alias("color"))
    df = mosaic(spark, sf_dir, *SMALL)
    return shown_pixels(sh.drawn(df, sh.texts(labels, sh.canvases(df))))


def _labels_sql() -> str:
    font = ", ".join(f"('{ch}', {row}, {bits})" for ch, rows in dr.FONT.items() for row, bits in enumerate(rows) if bits)
    return f"""WITH {mosaic_sql(*SMALL)}, font(ch, r, bits) AS (VALUES {font}),
labels AS (SELECT vec_id // {SMALL[0] * SMALL[1]} AS image_id, vec_id AS ord, {LABEL.replace("string", "varchar")} AS t, vec_id % 43 - 9 AS px, vec_id % 31 - 5 AS py, greatest(1, vec_id % 3) AS s FROM embeddings),
chars AS (SELECT *, unnest(range(length(t))) AS n FROM labels),
dots AS (SELECT image_id, ord, py + r * s AS top, px + (6 * n + k) * s AS side, s FROM chars JOIN font ON ch = t[n + 1], (SELECT unnest(range(5)) AS k) WHERE (bits >> (4 - k)) & 1 = 1),
marks AS (SELECT image_id, ord, top + a AS y, side + b AS x FROM dots, (SELECT unnest(range(2)) AS a), (SELECT unnest(range(2)) AS b) WHERE a < s AND b < s),
last AS (SELECT image_id, y, x, max(ord) % 256 AS color FROM marks GROUP BY 1, 2, 3)
SELECT {out('coalesce(color, v)').replace('image_id::', 'img.image_id::').replace(' y::', ' img.y::').replace(' x::', ' img.x::')} FROM img LEFT JOIN last ON last.image_id = img.image_id AND last.y = img.y AND last.x = img.x"""


def _kernels_by_row(spark, sf_dir) -> DataFrame:
    """Each mosaic convolved with the kernel of a label: means over all vectors of the label, places folded to 3 x 3."""
    values = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("kernel_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("p", "e"))
    kernels = values.groupBy("kernel_id", (F.floor(F.col("p") / 8) % 3).cast("int").alias("ky"), (F.col("p") % 8 % 3).alias("kx")).agg(F.avg("e").alias("w"))
    df = mosaic(spark, sf_dir, *SMALL).withColumn("kernel_id", (F.col("image_id") % 10).cast("int"))
    return shown(kn.convolve_planes(df, kernels, "reflect"))


def _kernels_sql() -> str:
    high, wide = 8 * SMALL[0], 8 * SMALL[1]
    return f"""WITH {mosaic_sql(*SMALL)}, taps AS (SELECT label AS kernel_id, 1 - (p // 8) % 3 AS dy, 1 - (p % 8) % 3 AS dx, avg(e::double) AS w FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) GROUP BY 1, 2, 3)
SELECT {out('sum(q.v * w)').replace('image_id::', 'p.image_id::').replace(' c::', ' p.c::').replace(' y::', ' p.y::').replace(' x::', ' p.x::')} FROM img p JOIN taps t ON kernel_id = p.image_id % 10 JOIN img q ON q.image_id = p.image_id AND q.y = {edge_sql('reflect', 'p.y + t.dy', high)} AND q.x = {edge_sql('reflect', 'p.x + t.dx', wide)} GROUP BY p.image_id, p.c, p.y, p.x"""


def _larger() -> dict:
    """Images that are not square, images in tiles, and shapes, texts and kernels from tables."""
    small = lambda op, show=shown: of(lambda s, d: mosaic(s, d, *SMALL), op, show)
    at_small = {"source": mosaic_sql(*SMALL), "n": 8 * SMALL[0], "wide": 8 * SMALL[1]}
    at_large = {"source": mosaic_sql(*LARGE), "n": 8 * LARGE[0], "wide": 8 * LARGE[1]}
    sobel = SOBEL.replace(near_sql("reflect"), near_sql("reflect", 8 * LARGE[0], 8 * LARGE[1]))
    return {
        "mosaic_convolve": (small(lambda d: st.convolve2d(d, SLANTED, "reflect")), stencil_sql(turned(SLANTED), "reflect", **at_small)),
        "mosaic_mean_wide": (small(lambda d: st.mean_filter(d, 9)), stencil_sql(ones(9), "reflect", "sum(q) / 81.0::double", **at_small)),
        "mosaic_median_wide": (small(lambda d: st.median_filter(d, 7)), stencil_sql(ones(7), "replicate", "median(q)", **at_small)),
        "mosaic_dilate_wide": (small(lambda d: st.morphological_op(d, [[1] * 11] * 7, "dilate")), stencil_sql([[1] * 11] * 7, "replicate", "max(q)", **at_small)),
        "mosaic_translate": (small(lambda d: g.translate(d, 7, -3, 9.0)), _translate_sql(7, -3, 9.0).replace(GRAY, mosaic_sql(*SMALL))),
        "tiled_convolve": (_tiled(lambda t: ti.convolve2d(t, SLANTED, "replicate")), stencil_sql(turned(SLANTED), "replicate", **at_large)),
        "tiled_gaussian": (_tiled(lambda t: ti.gaussian_filter(t, 5, 1.2)), stencil_sql(_gauss(5, 1.2), "reflect", **at_large)),
        "tiled_median": (_tiled(lambda t: ti.median_filter(t, 5)), stencil_sql(ones(5), "replicate", "median(q)", **at_large)),
        "tiled_adaptive": (_tiled(lambda t: ti.threshold_adaptive(t, 5)), stencil_sql(ones(5), "reflect", "sum(q) / 25.0::double", value="CASE WHEN v > s - 2 THEN 255 ELSE 0 END", **at_large)),
        "tiled_unsharp": (_tiled(lambda t: ti.unsharp_mask(t, 3, 1.0, 1.5)), stencil_sql(_gauss(3, 1.0), "reflect", value="least(hi, greatest(lo, v + 1.5::double * (v - s)))", **at_large)),
        "tiled_erode": (_tiled(lambda t: ti.morphological_op(t, [[1] * 5] * 3, "erode")), stencil_sql([[1] * 5] * 3, "replicate", "min(q)", **at_large)),
        "tiled_sobel": (_tiled_sobel, f"WITH {mosaic_sql(*LARGE)}, {sobel} SELECT image_id::bigint AS image_id, y, x, round(gx::double, 4) + 0.0 AS gx, round(gy::double, 4) + 0.0 AS gy, round(sqrt(gx * gx + gy * gy), 4) AS magnitude, round(degrees(atan2(abs(gy), abs(gx))), 4) AS angle FROM sob"),
        "polygons_filled_by_table": (_drawn_polygons(True), _polygons_sql(True)),
        "polygons_outlined_by_table": (_drawn_polygons(False), _polygons_sql(False)),
        "labels_by_table": (_labels, _labels_sql()),
        "kernels_by_table": (_kernels_by_row, _kernels_sql()),
    }


def _entries() -> dict:
    binomial16 = [[v / 16 for v in r] for r in BINOMIAL]
    sharp = lambda d: st.unsharp_mask(d, 3, 1.0, 1.5)
    adaptive = "CASE WHEN v > s - 2 THEN 255 ELSE 0 END"
    rect = [(1, 2), (6, 2), (6, 5), (1, 5), (1, 2)]
    clamped = [(0, 3), (5, 3), (5, 7), (0, 7), (0, 3)]
    gray = lambda op, sql: (of(gray8, op), sql)
    return {
        "rgb_to_gray": (of(rgb8, pw.rgb_to_gray), f"WITH {RGB.replace('img AS', 'raw AS', 1)}, {LUMA} SELECT {out()} FROM img"),
        "gray_to_rgb": gray(pw.gray_to_rgb, f"WITH {GRAY} SELECT {out('v').replace('c::int AS c', 'k::int AS c')} FROM img, (SELECT unnest(range(3)) AS k)"),
        "norm_minmax": gray(lambda d: pw.normalize(d, "minmax", new_min=-1.0, new_max=1.0), pixel_sql("CASE WHEN hi = lo THEN -1 ELSE (v - lo) / nullif(hi - lo, 0) * 2 - 1 END")),
        "norm_zscore": gray(lambda d: pw.normalize(d, "zscore"), pixel_sql("CASE WHEN sd = 0 THEN 0 ELSE (v - mu) / nullif(sd, 0) END")),
        "norm_fixed": gray(lambda d: pw.normalize(d, "fixed", fixed_min=40, fixed_max=200), pixel_sql("(least(200, greatest(40, v)) - 40) / 160.0::double")),
        "clip_pixels": gray(lambda d: pw.clip_pixels(d, 60, 190), pixel_sql("least(greatest(v, 60), 190)")),
        "threshold_global": gray(lambda d: pw.threshold_global(d, 127), pixel_sql("CASE WHEN v > 127 THEN 255 ELSE 0 END")),
        "bit_plane_slice": gray(lambda d: pw.bit_plane_slice(d, 5), pixel_sql("((v::int >> 5) & 1) * 255")),
        "bit_plane_all": (of(gray8, _bits, lambda d: d), f"WITH {GRAY} SELECT image_id::bigint AS image_id, b::int AS bit, y, x, (((v::int >> b::int) & 1) * 255)::int AS v FROM img, (SELECT unnest(range(8)) AS b)"),
        "pad_zero": gray(lambda d: st.pad_image(d, 2, 1, "zero"), pad_sql(2, 1, "zero")),
        "pad_reflect": gray(lambda d: st.pad_image(d, 9, 3, "reflect"), pad_sql(9, 3, "reflect")),
        "pad_replicate": gray(lambda d: st.pad_image(d, 2, 3, "replicate"), pad_sql(2, 3, "replicate")),
        "convolve2d": gray(lambda d: st.convolve2d(d, SLANTED, "zero"), stencil_sql(turned(SLANTED), "zero")),
        "convolve2d_replicate": gray(lambda d: st.convolve2d(d, SLANTED, "replicate"), stencil_sql(turned(SLANTED), "replicate")),
        "spatial_filter": (of(rgb8, lambda d: st.spatial_filter(d, binomial16, "reflect")), stencil_sql(binomial16, "reflect", source=RGB)),
        "mean_filter": gray(lambda d: st.mean_filter(d, 3), stencil_sql(ones(3), "reflect", "sum(q) / 9.0::double")),
        "gaussian_kernel": (_kernel, "WITH r AS (SELECT unnest(range(5))::int AS k), g AS (SELECT a.k AS ky, b.k AS kx, exp(-((a.k - 2) ** 2 + (b.k - 2) ** 2) / (2 * 1.2::double * 1.2::double)) AS w FROM r a, r b) SELECT ky, kx, round(w / sum(w) OVER (), 10) AS w FROM g"),
        "gaussian_filter": gray(lambda d: st.gaussian_filter(d, 5, 1.2), stencil_sql(_gauss(5, 1.2), "reflect")),
        "median_filter": gray(lambda d: st.median_filter(d, 3), stencil_sql(ones(3), "replicate", "median(q)")),
        "threshold_adaptive_mean": gray(lambda d: st.threshold_adaptive(d, 5), stencil_sql(ones(5), "reflect", "sum(q) / 25.0::double", value=adaptive)),
        "threshold_adaptive_gaussian": gray(lambda d: st.threshold_adaptive(d, 5, "gaussian"), stencil_sql(_gauss(5, 5 / 6), "reflect", value=adaptive)),
        "sobel_gradients": (of(gray8, sobel_rows, lambda d: d), f"WITH {GRAY}, {SOBEL} SELECT image_id::bigint AS image_id, y, x, round(gx::double, 4) + 0.0 AS gx, round(gy::double, 4) + 0.0 AS gy, round(sqrt(gx * gx + gy * gy), 4) AS magnitude, round(degrees(atan2(abs(gy), abs(gx))), 4) AS angle FROM sob"),
        "unsharp_mask": gray(sharp, stencil_sql(_gauss(3, 1.0), "reflect", value="least(hi, greatest(lo, v + 1.5::double * (v - s)))")),
        "morph_erode": gray(lambda d: st.morphological_op(d, None, "erode"), stencil_sql(ones(3), "replicate", "min(q)")),
        "morph_dilate": gray(lambda d: st.morphological_op(d, [[1] * 5] * 3, "dilate"), stencil_sql([[1] * 5] * 3, "replicate", "max(q)")),
        "histogram": (of(text32, _hist_rows, lambda d: d), hist_sql(TEXT)),
        "histogram_dataframe": (of(gray8, _table_rows, lambda d: d), HIST.replace("{source}", GRAY) + " SELECT image_id::bigint AS image_id, level AS bin, level + 0.5::double AS intensity, n AS count, round(n / 64.0::double, 8) AS probability, round((sum(n) OVER (PARTITION BY image_id ORDER BY level))::double / 64, 8) AS cdf FROM h"),
        "histogram_equalization": (of(text32, hi.histogram_equalization), EQUALIZE.replace("{source}", TEXT)),
        "threshold_otsu": (of(text32, hi.threshold_otsu, lambda d: shown(d, "threshold")), OTSU),
        "color_histogram": (of(rgb8, hi.color_histogram, vector), _color_sql()),
        "hu_moments": (of(gray8, hi.hu_moments, vector), HU),
        "gradient_hist": (of(gray8, hi.gradient_hist, vector), _gradient_sql()),
        "hog": (of(gray8, lambda d: D.hog(d, 2, 2, 9), vector), _hog_sql()),
        "lbp": (of(gray8, D.lbp, vector), _lbp_sql()),
        "resize_nearest": gray(lambda d: g.resize(d, 13, 5, "nearest"), gather_sql(13, 5, "(y * 7::double / 12)", "(x * 7::double / 4)", "nearest")),
        "resize_bilinear": gray(lambda d: g.resize(d, 13, 5), gather_sql(13, 5, "(y * 7::double / 12)", "(x * 7::double / 4)", "bilinear")),
        "rotate_bilinear": gray(lambda d: g.rotate(d, 30, "bilinear", 7.0), rotate_sql(30, "bilinear", 7.0)),
        "rotate_nearest": gray(lambda d: g.rotate(d, 90, "nearest"), rotate_sql(90, "nearest", 0.0)),
        "translate": gray(lambda d: g.translate(d, 2, -1, 9.0), _translate_sql(2, -1, 9.0)),
        "draw_point": gray(lambda d: dr.draw_point(d, 3, 4, 255, 3), overlay_sql({(y, x) for y in range(8) for x in range(8) if (y - 4) ** 2 + (x - 3) ** 2 < 9}, 255)),
        "draw_line": gray(lambda d: dr.draw_line(d, -2, 1, 7, 5, 200), overlay_sql(line_sql(-2, 1, 7, 5), 200)),
        "draw_line_thick": (of(rgb8, lambda d: dr.draw_line(d, 6, 7, 3, 0, (10, 20, 30), 2)), overlay_sql(line_sql(6, 7, 3, 0, 2), (10, 20, 30))),
        "rectangle_outline": gray(lambda d: dr.draw_rectangle(d, 6, 5, 1, 2, 1), lines_sql(rect, 1)),
        "rectangle_clamped": gray(lambda d: dr.draw_rectangle(d, -4, 3, 5, 30, 1), lines_sql(clamped, 1)),
        "rectangle_filled": gray(lambda d: dr.draw_rectangle(d, 1, 2, 9, 5, 1, filled=True), overlay_sql({(y, x) for y in range(2, 6) for x in range(1, 8)}, 1)),
        "polygon_outline": gray(lambda d: dr.draw_polygon(d, TRIANGLE, 99), lines_sql([*TRIANGLE, TRIANGLE[0]], 99)),
        "polygon_filled": gray(lambda d: dr.draw_polygon(d, TRIANGLE, 99, filled=True), polygon_sql(TRIANGLE, 99)),
        "put_text": (of(text32, lambda d: dr.put_text(d, "Ab1?~:", 1, 3, 1.0, 255)), overlay_sql(text_pixels("Ab1?~:", 1, 3, 1), 255).replace(GRAY, TEXT)),
        **_larger(),
        "put_text_scaled": (of(text32, lambda d: dr.put_text(d, "K8", -3, 20, 2.4, 254)), overlay_sql(text_pixels("K8", -3, 20, 2), 254).replace(GRAY, TEXT)),
    }


def queries() -> dict:
    return {name: run for name, (run, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items()}
