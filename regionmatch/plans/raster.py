"""Queries over gray rasters: neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.operators import grid
from regionmatch.operators.tiles import halo_tiles
from regionmatch.plans import fixtures as fx

AT = ("image", "y", "x")


def _r(df, *names):
    return df.select(*AT, *[F.round(n, 6).alias(n) for n in names])


def block_mean(spark, sf):
    return _r(grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4), "v")


def block_mean_padded(spark, sf):
    return _r(grid.block_means(fx.px(spark, sf), {"ink": (F.col("gray") < 128).cast("int")}, 7, pad=0.0), "ink")


def box_mean(spark, sf):
    return _r(grid.box_means(fx.px(spark, sf), {"m4": ("gray", 4), "m12": ("gray", 12)}), "m4", "m12")


def local_std(spark, sf):
    return _r(grid.local_std(fx.px(spark, sf), "gray", 4, "s"), "s")


def dilate(spark, sf):
    d = grid.dilate(fx.px(spark, sf), {"d4": ("gray", 4), "d2": ("gray", 2)}, tile=32)
    return d.select(*AT, "d2", "d4")


def median3(spark, sf):
    return grid.median_filter(fx.px(spark, sf), "gray", 1, "m", tile=32).select(*AT, "m")


def gaussian(spark, sf):
    return _r(grid.gaussian(fx.px(spark, sf), "gray", 1.5, "g"), "g")


def ink_density(spark, sf):
    ink = grid.block_means(fx.px(spark, sf), {"ink": (F.col("gray") < 128).cast("int")}, 4)
    return _r(grid.box_means(ink, {"density": ("ink", 4)}), "density")


def adaptive_ink(spark, sf):
    p = grid.adaptive_ink(fx.px(spark, sf))
    return p.groupBy("image", "y").agg(F.count_if("ink").alias("ink"), F.sum(F.when(F.col("ink"), F.col("x"))).alias("sum_x"))


def background_tone(spark, sf):
    small = grid.block_means(fx.px(spark, sf), {"v": F.col("gray") / 255.0}, 4)
    b = grid.background(small, "v", {"bg4": 4})
    return _r(b, "bg4")


def paper_tone(spark, sf):
    t = grid.tone_maps(_bright(spark, sf), radii=(4,))
    return _r(t, "mean4", "std4", "ink4", "paper4", "paperfrac4")


def _bright(spark, sf):
    """The rasters with their contrast stretched, so that paper and ink both occur."""
    return fx.px(spark, sf).withColumn("gray", F.least(F.greatest((F.col("gray") - 100) * 5, F.lit(0)), F.lit(255)))


def gradient(spark, sf):
    g = grid.gradient(fx.px(spark, sf), "gray", tile=32)
    return g.select(*AT, "gx", "gy", F.round(F.sqrt((F.col("gx") ** 2 + F.col("gy") ** 2)), 6).alias("magnitude"),
                    F.round(grid.orientation(F.col("gx"), F.col("gy")), 6).alias("angle"))


def orientation_histogram(spark, sf):
    m = grid.histogram_maps(fx.px(spark, sf), radii=(4,))
    return m.select(*AT, *[F.round(F.col("ori4")[i], 5).alias(f"o{i}") for i in range(8)])


def intensity_histogram(spark, sf):
    m = grid.histogram_maps(fx.px(spark, sf), radii=(4,))
    return m.select(*AT, *[F.round(F.col("int4")[i], 6).alias(f"i{i}") for i in range(8)])


def structure_tensor(spark, sf):
    m = grid.structure_tensor(fx.px(spark, sf), radii=(4,))
    return m.select(*AT, F.round("energy4", 5).alias("energy"), F.round("coh4", 5).alias("coherence"),
                    F.round(F.cos("phi4"), 4).alias("cos_phi"))


def cell_tone(spark, sf):
    return _r(grid.cell_tone(fx.px(spark, sf)), "mean", "std", "ink", "edge")


def guided_filter(spark, sf):
    """Accept map (gray share of white) smoothed with the ink density as guide."""
    p = _bright(spark, sf)
    small = grid.block_means(p, {"p": F.col("gray") / 255.0, "guide": (F.col("gray") < 160).cast("int")}, 4)
    return small.transform(lambda d: grid.guided_filter(d, "p", "guide", 2, 0.01, "g")).select(*AT, F.round("g", 5).alias("g"))


def _query_maps(spark, sf):
    """One coarse map per query, with the query's box area."""
    small = grid.block_means(_bright(spark, sf), {"p": F.col("gray") / 255.0}, 4)
    b = fx.boxes(spark, sf).withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return small.join(b.select("image", "query", "area"), "image")


def box_scaled_blur(spark, sf):
    m = _query_maps(spark, sf).withColumn("sigma", grid.box_scaled_size(F.col("area").cast("double"), 0.15, 0.5, 1.0))
    return grid.scaled_gaussian(m, "p", "sigma", 1.0, "g").select("query", "y", "x", F.round("g", 6).alias("g"))


def box_scaled_median(spark, sf):
    size = grid.box_scaled_size(F.col("area").cast("double"), 0.6, 3, 7)
    m = _query_maps(spark, sf).withColumn("size", (F.floor(F.round(size) / 2) * 2 + 1).cast("int"))
    return grid.scaled_median(m, "p", "size", 7, "m").select("query", "y", "x", F.round("m", 6).alias("m"))


def tiles_with_halo(spark, sf):
    """Overlapping tiles: cells per tile with a halo of five, and the core they keep."""
    t = halo_tiles(fx.px(spark, sf), 5, "none", 16)
    own = (F.floor(F.col("y") / 16) == F.col("ty")) & (F.floor(F.col("x") / 16) == F.col("tx"))
    return t.groupBy("image", "ty", "tx").agg(F.count("*").alias("cells"), F.count_if(own).alias("core"),
                                              F.sum("gray").alias("gray"))


QUERIES = {f.__name__: f for f in (
    block_mean, block_mean_padded, box_mean, local_std, dilate, median3, gaussian, ink_density, adaptive_ink,
    background_tone, paper_tone, gradient, orientation_histogram, intensity_histogram, structure_tensor, cell_tone,
    guided_filter, box_scaled_blur, box_scaled_median, tiles_with_halo)}


# ---- SQL twins --------------------------------------------------------------------------


def mirror(i, n):
    """SQL for a coordinate mirrored into [0, n), however far outside it lies."""
    p = f"(2 * ({n} - 1))"
    m = f"((({i}) % {p} + {p}) % {p})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {p} - {m} END)"


def box_sql(src, cols, r, out, key="image"):
    """Two-pass mirrored box means of ``cols`` of a CTE, as CTEs ``{out}_h`` and ``{out}``."""
    h = ", ".join(f"sum(n.{c}) AS {c}" for c in cols)
    v = ", ".join(f"sum(n.{c}) / {float((2 * r + 1) ** 2)} AS {c}" for c in cols)
    return f"""{out}_h AS (SELECT a.{key}, a.h, a.w, a.y, a.x, {h} FROM {src} a, range(-{r}, {r + 1}) d(d)
   JOIN {src} n ON n.{key} = a.{key} AND n.y = a.y AND n.x = {mirror('a.x + d', 'a.w')} GROUP BY ALL),
 {out} AS (SELECT a.{key}, a.h, a.w, a.y, a.x, {v} FROM {out}_h a, range(-{r}, {r + 1}) d(d)
   JOIN {out}_h n ON n.{key} = a.{key} AND n.x = a.x AND n.y = {mirror('a.y + d', 'a.h')} GROUP BY ALL)"""


def block_sql(src, exprs, out, c=4):
    e = ", ".join(f"avg({x}) AS {n}" for n, x in exprs.items())
    return f"""{out} AS (SELECT image, (h + {c - 1}) // {c} AS h, (w + {c - 1}) // {c} AS w, y // {c} AS y, x // {c} AS x, {e} FROM {src} GROUP BY ALL)"""


_PX = f"WITH {fx.PX}"
_BRIGHT = f"{_PX}, bright AS (SELECT * REPLACE (least(greatest((gray - 100) * 5, 0), 255) AS gray) FROM px)"


def sobel_sql(src, value, out="sob"):
    at = lambda dy, dx: f"(dy = {dy} AND dx = {dx})"
    k = lambda parts: " + ".join(f"{w} * sum({value}) FILTER {at(dy, dx)}" for w, dy, dx in parts)
    gx = k([(1, -1, 1), (2, 0, 1), (1, 1, 1), (-1, -1, -1), (-2, 0, -1), (-1, 1, -1)])
    gy = k([(1, 1, -1), (2, 1, 0), (1, 1, 1), (-1, -1, -1), (-2, -1, 0), (-1, -1, 1)])
    return f"""{out} AS (SELECT a.image, a.h, a.w, a.y, a.x, any_value(a.gray) AS gray, {gx} AS gx, {gy} AS gy
  FROM {src} a, range(-1, 2) d1(dy), range(-1, 2) d2(dx)
  JOIN {src} n ON n.image = a.image AND n.y = {mirror('a.y + dy', 'a.h')} AND n.x = {mirror('a.x + dx', 'a.w')}
  GROUP BY a.image, a.h, a.w, a.y, a.x)"""


_PI = "pi()"
_ANGLE = "(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() WHEN atan2(gy, gx) >= pi() THEN atan2(gy, gx) - pi() ELSE atan2(gy, gx) END)"
_MAG = "sqrt(CAST(gx * gx + gy * gy AS DOUBLE))"


def near_sql(r, agg, out, clamp):
    rule = (lambda i, n: f"least(greatest({i}, 0), {n} - 1)") if clamp else (lambda i, n: i)
    return f"""SELECT a.image, a.y, a.x, {agg} AS {out} FROM px a, range(-{r}, {r + 1}) d1(dy), range(-{r}, {r + 1}) d2(dx)
  JOIN px n ON n.image = a.image AND n.y = {rule('a.y + dy', 'a.h')} AND n.x = {rule('a.x + dx', 'a.w')} GROUP BY ALL"""


def gauss_sql(src, value, sigma, out, key="image"):
    r = len(grid.gaussian_taps(sigma)) // 2
    return f"""taps AS (SELECT d, exp(-(d * d) / (2.0 * {sigma} * {sigma})) / sum(exp(-(d * d) / (2.0 * {sigma} * {sigma}))) OVER () AS wt
    FROM range(-{r}, {r + 1}) t(d)),
  {out}_h AS (SELECT a.{key}, a.h, a.w, a.y, a.x, sum(n.{value} * wt) AS v FROM {src} a, taps
    JOIN {src} n ON n.{key} = a.{key} AND n.y = a.y AND n.x = {mirror('a.x + d', 'a.w')} GROUP BY ALL),
  {out} AS (SELECT a.{key}, a.h, a.w, a.y, a.x, sum(n.v * wt) AS v FROM {out}_h a, taps
    JOIN {out}_h n ON n.{key} = a.{key} AND n.x = a.x AND n.y = {mirror('a.y + d', 'a.h')} GROUP BY ALL)"""


_QMAPS = f"""{_BRIGHT}, {block_sql('bright', {'p': 'gray / 255.0'}, 'small')}, {fx.BOXES},
  qm AS (SELECT query, s.h, s.w, s.y, s.x, p, (x1 - x0) * (y1 - y0) AS area FROM small s JOIN boxes USING (image))"""

_AT = "image, CAST(y AS INT) AS y, CAST(x AS INT) AS x"

ORACLE = {
    "block_mean": f"{_PX}, {block_sql('px', {'v': 'gray'}, 's')} SELECT {_AT}, round(v, 6) AS v FROM s",
    "block_mean_padded": f"{_PX} SELECT image, CAST(y // 7 AS INT) AS y, CAST(x // 7 AS INT) AS x, round(count(*) FILTER (gray < 128) / 49.0::DOUBLE, 6) AS ink FROM px GROUP BY ALL",
    "box_mean": f"{_PX}, {box_sql('px', ['gray'], 4, 'a')}, {box_sql('px', ['gray'], 12, 'b')} SELECT {_AT}, round(a.gray, 6) AS m4, round(b.gray, 6) AS m12 FROM a JOIN b USING (image, y, x)",
    "local_std": f"{_PX}, q AS (SELECT *, gray * gray AS sq FROM px), {box_sql('q', ['gray', 'sq'], 4, 'a')} SELECT {_AT}, round(sqrt(greatest(sq - gray * gray, 0)), 6) AS s FROM a",
    "dilate": f"{_PX}, a AS ({near_sql(4, 'max(n.gray)', 'd4', False)}), b AS ({near_sql(2, 'max(n.gray)', 'd2', False)}) SELECT image, y, x, d2, d4 FROM a JOIN b USING (image, y, x)",
    "median3": f"{_PX} SELECT image, y, x, CAST(m AS INT) AS m FROM ({near_sql(1, 'median(n.gray)', 'm', True)})",
    "gaussian": f"{_PX}, {gauss_sql('px', 'gray', 1.5, 'g')} SELECT {_AT}, round(v, 6) AS g FROM g",
    "ink_density": f"{_PX}, {block_sql('px', {'ink': 'CAST(gray < 128 AS INT)'}, 's')}, {box_sql('s', ['ink'], 4, 'a')} SELECT {_AT}, round(ink, 6) AS density FROM a",
    "adaptive_ink": f"{_PX}, a AS ({near_sql(4, 'max(n.gray)', 'd', False)}) SELECT image, y, count(*) FILTER (d - gray > 40) AS ink, CAST(sum(x) FILTER (d - gray > 40) AS BIGINT) AS sum_x FROM a JOIN px USING (image, y, x) GROUP BY image, y",
    "background_tone": f"""{_PX}, {block_sql('px', {'v': 'gray / 255.0'}, 's')}, lv AS (SELECT image, h, w, y, x, floor(v * 255.0) AS gray FROM s),
      md AS ({near_sql(2, 'median(n.gray)', 'gray', True).replace('px', 'lv')}),
      bg AS ({near_sql(4, 'max(n.gray)', 'd', False).replace('px', 'md')}) SELECT {_AT}, round(d / 255.0, 6) AS bg4 FROM bg""",
    "paper_tone": f"""{_BRIGHT}, {block_sql('bright', {'v': 'gray / 255.0', 'ink': 'CAST(gray < 160 AS INT)'}, 's0')},
      s AS (SELECT *, v * v AS v2, CAST(ink < 0.05 AS DOUBLE) AS paper, v * CAST(ink < 0.05 AS DOUBLE) AS vp FROM s0),
      {box_sql('s', ['v', 'v2', 'ink', 'paper', 'vp'], 4, 'a')}
      SELECT {_AT}, round(v, 6) AS mean4, round(sqrt(greatest(v2 - v * v, 0)), 6) AS std4, round(ink, 6) AS ink4,
      round(vp / (paper + 1e-3), 6) AS paper4, round(paper, 6) AS paperfrac4 FROM a""",
    "gradient": f"{_PX}, {sobel_sql('px', 'n.gray')} SELECT image, y, x, CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy, round({_MAG}, 6) AS magnitude, round({_ANGLE}, 6) AS angle FROM sob",
    "orientation_histogram": f"""{_PX}, {sobel_sql('px', 'n.gray')}, ob AS (SELECT *, {_MAG} / 255.0 AS mag, CAST(least(floor({_ANGLE} / pi() * 8), 7) AS INT) AS b FROM sob),
      {block_sql('ob', {f'o{i}': f'CASE WHEN b = {i} THEN mag ELSE 0 END' for i in range(8)}, 's')}, {box_sql('s', [f'o{i}' for i in range(8)], 4, 'a')}
      SELECT {_AT}, {", ".join(f"round(o{i}, 5) AS o{i}" for i in range(8))} FROM a""",
    "intensity_histogram": f"""{_PX}, ob AS (SELECT *, CAST(least(floor(gray / 255.0 * 8), 7) AS INT) AS b FROM px),
      {block_sql('ob', {f'i{i}': f'CASE WHEN b = {i} THEN 1 ELSE 0 END' for i in range(8)}, 's')}, {box_sql('s', [f'i{i}' for i in range(8)], 4, 'a')}
      SELECT {_AT}, {", ".join(f"round(i{i}, 6) AS i{i}" for i in range(8))} FROM a""",
    "structure_tensor": f"""{_PX}, {sobel_sql('px', 'n.gray')}, g AS (SELECT * REPLACE (gx / 255.0 AS gx, gy / 255.0 AS gy) FROM sob),
      {block_sql('g', {'xx': 'gx * gx', 'xy': 'gx * gy', 'yy': 'gy * gy'}, 's')}, {box_sql('s', ['xx', 'xy', 'yy'], 4, 'a')}
      SELECT {_AT}, round(xx + yy, 5) AS energy, round(sqrt((xx - yy) * (xx - yy) + 4 * xy * xy) / (xx + yy + 1e-6), 5) AS coherence,
      round(cos(atan2(2 * xy, xx - yy)), 4) AS cos_phi FROM a""",
    "cell_tone": f"""{_PX}, {sobel_sql('px', 'n.gray')}, c AS (SELECT image, y // 14 AS y, x // 14 AS x, (sum(gray / 255.0) + 196 - count(*)) / 196.0 AS m,
      (sum((gray / 255.0) * (gray / 255.0)) + 196 - count(*)) / 196.0 AS m2, count(*) FILTER (gray < 160) / 196.0::DOUBLE AS ink,
      sum({_MAG} / 255.0) / 196.0 AS edge FROM sob GROUP BY ALL)
      SELECT {_AT}, round(m, 6) AS mean, round(sqrt(greatest(m2 - m * m, 0)), 6) AS std, round(ink, 6) AS ink, round(edge, 6) AS edge FROM c""",
    "guided_filter": f"""{_BRIGHT}, {block_sql('bright', {'p': 'gray / 255.0', 'gd': 'CAST(gray < 160 AS INT)'}, 's0')},
      s AS (SELECT *, gd * p AS gp, gd * gd AS gg FROM s0), {box_sql('s', ['p', 'gd', 'gp', 'gg'], 2, 'a')},
      ab AS (SELECT image, h, w, y, x, (gp - gd * p) / (gg - gd * gd + 0.01) AS a, p - (gp - gd * p) / (gg - gd * gd + 0.01) * gd AS b FROM a),
      {box_sql('ab', ['a', 'b'], 2, 'm')} SELECT {_AT}, round(least(greatest(m.a * s.gd + m.b, 0), 1), 5) AS g FROM m JOIN s USING (image, y, x)""",
    "box_scaled_blur": f"""{_QMAPS}, sg AS (SELECT *, greatest(least(sqrt(area) * 0.15, 1.0), 0.5) AS sigma FROM qm),
      rr AS (SELECT *, (CAST(round(sigma * 8 + 1) AS INT) + (CAST(round(sigma * 8 + 1) AS INT) + 1) % 2) // 2 AS r FROM sg),
      hh AS (SELECT a.query, a.h, a.w, a.y, a.x, a.sigma, a.r, sum(n.p * exp(-(d * d) / (2.0 * a.sigma * a.sigma))) / sum(exp(-(d * d) / (2.0 * a.sigma * a.sigma))) AS v
        FROM rr a, range(-9, 10) t(d) JOIN rr n ON n.query = a.query AND n.y = a.y AND n.x = {mirror('a.x + d', 'a.w')} WHERE abs(d) <= a.r GROUP BY ALL),
      vv AS (SELECT a.query, a.y, a.x, sum(n.v * exp(-(d * d) / (2.0 * a.sigma * a.sigma))) / sum(exp(-(d * d) / (2.0 * a.sigma * a.sigma))) AS v
        FROM hh a, range(-9, 10) t(d) JOIN hh n ON n.query = a.query AND n.x = a.x AND n.y = {mirror('a.y + d', 'a.h')} WHERE abs(d) <= a.r GROUP BY a.query, a.y, a.x)
      SELECT query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) AS g FROM vv""",
    "box_scaled_median": f"""{_QMAPS}, kk AS (SELECT *, CAST(floor(round(greatest(least(sqrt(area) * 0.6, 7), 3)) / 2) AS INT) AS r FROM qm)
      SELECT a.query, CAST(a.y AS INT) AS y, CAST(a.x AS INT) AS x, round(median(n.p), 6) AS m FROM kk a, range(-3, 4) d1(dy), range(-3, 4) d2(dx)
      JOIN kk n ON n.query = a.query AND n.y = least(greatest(a.y + dy, 0), a.h - 1) AND n.x = least(greatest(a.x + dx, 0), a.w - 1)
      WHERE abs(dy) <= a.r AND abs(dx) <= a.r GROUP BY a.query, a.y, a.x""",
    "tiles_with_halo": f"""{_PX}, tl AS (SELECT DISTINCT image, y // 16 AS ty, x // 16 AS tx FROM px)
      SELECT image, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx, count(*) AS cells, count(*) FILTER (y // 16 = ty AND x // 16 = tx) AS core, CAST(sum(gray) AS BIGINT) AS gray
      FROM tl JOIN px USING (image) WHERE y >= ty * 16 - 5 AND y < ty * 16 + 21 AND x >= tx * 16 - 5 AND x < tx * 16 + 21 GROUP BY ALL""",
}
