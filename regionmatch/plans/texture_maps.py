"""Queries over texture maps: spectra, blobs, template correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.operators import grid, texture
from regionmatch.plans import fixtures as fx
from regionmatch.plans.raster import _BRIGHT, _PX, _bright, box_sql, block_sql
from regionmatch.plans.regions import labelled_sql
from regionmatch.session import cut_lineage

EDGES = (1, 2, 3, 4.5, 9)


def spectra(spark, sf):
    """Windowed spectra of 8 x 8 pixels at every fourth pixel, four period rings by eight angles."""
    s = texture.spectra(fx.px(spark, sf), window=8, stride=4, edges=EDGES, tile=32)
    return s.select("image", "gy", "gx", F.round("loge", 5).alias("loge"), *[F.round(F.col("desc")[i], 5).alias(f"d{i}") for i in range(32)])


def _ink(spark, sf):
    return cut_lineage(grid.adaptive_ink(_bright(spark, sf).select("image", "h", "w", "y", "x", F.floor(F.col("gray") / 4).cast("int").alias("gray")), r=1))


def blob_table(spark, sf):
    _, b = texture.blob_table(_ink(spark, sf), tile=64)
    return b.select("image", "label", "area", "bh", "bw", F.col("size_class").cast("int").alias("size_class"),
                    F.col("shape_class").cast("int").alias("shape_class"), F.round("cy", 6).alias("cy"), F.round("cx", 6).alias("cx"))


def blob_maps(spark, sf):
    m = texture.blob_maps(_ink(spark, sf), radii=(3,), tile=64)
    return m.select("image", "y", "x", *[F.round(F.col(f"{n}3")[i], 6).alias(f"{n}{i}") for n, ks in (("cnt", (0, 1, 2)), ("area", (0, 1, 2)), ("shape", (0, 1, 2))) for i in ks])


def correlation(spark, sf):
    """Centre crop of each query box over its drawing, pooled."""
    px = fx.px(spark, sf)
    shapes = texture.templates(px, fx.boxes(spark, sf), rotated=False)
    return texture.correlate(px, shapes, 14, tile=32).select("query", "y", "x", F.round("ncc", 6).alias("ncc"))


def template_table(spark, sf):
    t = texture.templates(fx.px(spark, sf), fx.boxes(spark, sf))
    return t.select("query", "variant", "th", "tw", "pool", F.round("std", 6).alias("std"), F.round(F.element_at("t", 2), 6).alias("second"),
                    F.round(F.element_at("t", -2), 6).alias("last_but_one"))


def correlation_bundle(spark, sf):
    """Correlation maps with turned and mirrored templates on the half-size grid."""
    m, _ = texture.correlation_bundle(fx.px(spark, sf), fx.boxes(spark, sf), tile=64)
    return m.select("query", "y", "x", *[F.round(n, 5).alias(n) for n in ("ncc_c", "ncc_rot", "ncc_best", "ncc_max", "ncc_med")])


def rotation_bundle(spark, sf):
    px = fx.px(spark, sf)
    shapes = texture.usable_turns(texture.rotated_templates(px, fx.wide_boxes(spark, sf)))
    m = texture.rotation_bundle(texture.correlate(px, shapes, 40, tile=64))
    return m.select("query", "y", "x", *[F.round(n, 4).alias(n) for n in ("ev_nr0", "ev_nr90", "ev_nr45", "ev_nr180", "ev_nrgap90", "ev_nrgap45", "ev_nrgap180", "ev_nrang")])


QUERIES = {f.__name__: f for f in (
    spectra, blob_table, blob_maps, correlation, template_table, correlation_bundle, rotation_bundle)}

_FY = "(CASE WHEN ky < 4 THEN ky ELSE ky - 8 END / 8.0::DOUBLE)"
_FX = "(kx / 8.0::DOUBLE)"
_ANG = f"atan2({_FY}, {_FX})"
_PER = f"(1 / sqrt({_FY} * {_FY} + {_FX} * {_FX}))"

_TPL = f"""{_PX}, {fx.BOXES}, vr AS (SELECT b.*, v, x1 - x0 AS bw, y1 - y0 AS bh FROM boxes b, (VALUES ('c'), ('rot90'), ('flip')) t(v)),
  tp AS (SELECT query, vr.image, v, gray / 255.0::DOUBLE AS g, CASE v WHEN 'rot90' THEN bw - 1 - (x - x0) ELSE y - y0 END AS i,
     CASE v WHEN 'rot90' THEN y - y0 WHEN 'flip' THEN bw - 1 - (x - x0) ELSE x - x0 END AS j,
     CASE v WHEN 'rot90' THEN bw ELSE bh END AS th, CASE v WHEN 'rot90' THEN bh ELSE bw END AS tw
     FROM vr JOIN px ON px.image = vr.image AND y >= y0 AND y < y1 AND x >= x0 AND x < x1),
  ts AS (SELECT *, g - avg(g) OVER (PARTITION BY query, v) AS g0, greatest(3, least(th, tw) // 2) // 2 * 2 + 1 AS pool FROM tp),
  pt AS (SELECT query, v, image, h, w, th, tw, pool, p.y - i AS oy, p.x - j AS ox, g0, gray / 255.0::DOUBLE AS f FROM ts JOIN px p USING (image)),
  po AS (SELECT query, v, image, th, tw, pool, oy, ox, sum(g0 * f) AS cross_, sum(f) AS s, sum(f * f) AS ss, sum(g0 * g0) AS gg
    FROM pt WHERE oy >= 0 AND ox >= 0 AND oy + th <= h AND ox + tw <= w GROUP BY ALL),
  sc AS (SELECT query, v, image, oy + th // 2 AS y, ox + tw // 2 AS x, pool,
      CASE WHEN greatest(ss - s * s / (th * tw), 0) * gg > 1e-18 THEN least(greatest(cross_ / sqrt((ss - s * s / (th * tw)) * gg), -1), 1) ELSE 0 END AS r FROM po),
  fl AS (SELECT DISTINCT q.query, q.v, px.image, px.h, px.w, px.y, px.x, q.pool FROM px JOIN (SELECT DISTINCT query, v, image, pool FROM ts) q USING (image)),
  fu AS (SELECT fl.*, coalesce(r, 0) AS r FROM fl LEFT JOIN sc USING (query, v, image, y, x)),
  pl1 AS (SELECT a.query, a.v, a.image, a.h, a.w, a.y, a.x, a.pool, max(n.r) AS r FROM fu a, range(-8, 9) t(d) JOIN fu n ON n.query = a.query AND n.v = a.v AND n.y = a.y AND n.x = a.x + d WHERE abs(d) <= a.pool // 2 GROUP BY ALL),
  pl AS (SELECT a.query, a.v, a.image, a.h, a.w, a.y, a.x, max(n.r) AS r FROM pl1 a, range(-8, 9) t(d) JOIN pl1 n ON n.query = a.query AND n.v = a.v AND n.x = a.x AND n.y = a.y + d WHERE abs(d) <= a.pool // 2 GROUP BY ALL)"""

_INK = f"""{_BRIGHT}, b4 AS (SELECT * REPLACE (gray // 4 AS gray) FROM bright),
  ink AS (SELECT a.image, a.h, a.w, a.y, a.x, max(n.gray) - any_value(a.gray) > 40 AS ink FROM b4 a, range(-1, 2) d1(dy), range(-1, 2) d2(dx)
    JOIN b4 n ON n.image = a.image AND n.y = a.y + dy AND n.x = a.x + dx GROUP BY a.image, a.h, a.w, a.y, a.x)"""
_BLOB = labelled_sql(_INK, "ink", "ink", eight=True) + """, bl AS (SELECT image, label, count(*) AS area, max(y) - min(y) + 1 AS bh, max(x) - min(x) + 1 AS bw, avg(y) AS cy, avg(x) AS cx FROM lab GROUP BY ALL),
  cl AS (SELECT *, len(list_filter([3, 8, 20, 50, 150, 500], lambda e: e <= area)) AS size_class,
    len(list_filter([8, 50, 300], lambda e: e <= area)) * 2 + CAST(greatest(bw, bh) / CAST(least(bw, bh) AS DOUBLE) >= 2.5 AS INT) AS shape_class FROM bl)"""

_CELLS9 = [(n, i) for n in ("cnt", "area", "shape") for i in (0, 1, 2)]

_WINDOWS = "cl AS (SELECT DISTINCT image, gy, gx FROM (SELECT image, h, w FROM px), range(0, 100) a(gy), range(0, 16) b(gx) WHERE gy < ceil(h / 4.0)),"
#: The same windows for rasters of any height.
_ALL_WINDOWS = """cl AS (SELECT *, unnest(range(0, CAST(ceil(w / 4.0) AS BIGINT))) AS gx FROM (SELECT image, w, unnest(range(0, CAST(ceil(h / 4.0) AS BIGINT))) AS gy
        FROM (SELECT DISTINCT image, h, w FROM px))),"""
_SPECTRUM = f"""{_WINDOWS}
      wn AS (SELECT cl.image, gy, gx, wy, wx, coalesce(gray / 255.0::DOUBLE, 1.0::DOUBLE) AS v FROM cl, range(0, 8) a(wy), range(0, 8) b(wx)
        LEFT JOIN px ON px.image = cl.image AND px.y = gy * 4 - 2 + wy AND px.x = gx * 4 - 2 + wx),
      hn AS (SELECT image, gy, gx, wy, wx, (v - avg(v) OVER (PARTITION BY image, gy, gx)) * (0.5 - 0.5 * cos(2 * pi() * wy / 7)) * (0.5 - 0.5 * cos(2 * pi() * wx / 7)) AS v FROM wn),
      pw AS (SELECT image, gy, gx, ky, kx, sum(v * cos(2 * pi() * (ky * wy + kx * wx) / 8)) ** 2 + sum(v * sin(2 * pi() * (ky * wy + kx * wx) / 8)) ** 2 AS p
        FROM hn, range(0, 8) a(ky), range(0, 5) b(kx) WHERE ky > 0 OR kx > 0 GROUP BY ALL),
      bn AS (SELECT image, gy, gx, (len(list_filter([1, 2, 3, 4.5, 9], lambda e: e <= {_PER})) - 1) * 8
          + CAST(least(floor(CASE WHEN {_ANG} < 0 THEN {_ANG} + pi() WHEN {_ANG} >= pi() THEN 0 ELSE {_ANG} END / pi() * 8), 7) AS INT) AS b,
          sum(p * CASE WHEN kx IN (0, 4) THEN 0.5 ELSE 1.0 END) AS p FROM pw GROUP BY ALL),
      tt AS (SELECT image, gy, gx, sum(p) AS t FROM bn WHERE b BETWEEN 0 AND 31 GROUP BY ALL)"""


def loge_sql(out):
    """Log energy of the windows of ``spectra`` as a map."""
    return f"{_SPECTRUM}, {out} AS (SELECT image, CAST(gy AS INT) AS y, CAST(gx AS INT) AS x, ln(t + 1e-4) AS loge FROM tt)"


ORACLE = {
    "spectra": f"""{_PX}, {_SPECTRUM.replace(_WINDOWS, _ALL_WINDOWS)}
      SELECT image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(ln(any_value(t) + 1e-4), 5) AS loge,
        {", ".join(f"round(coalesce(sum(p) FILTER (b = {i}), 0) / (any_value(t) + 1e-6), 5) AS d{i}" for i in range(32))}
      FROM bn JOIN tt USING (image, gy, gx) GROUP BY image, gy, gx""",
    "blob_table": f"{_BLOB} SELECT image, label, area, bh, bw, CAST(size_class AS INT) AS size_class, CAST(shape_class AS INT) AS shape_class, round(cy, 6) AS cy, round(cx, 6) AS cx FROM cl",
    "blob_maps": f"""{_BLOB}, fr AS (SELECT image, (h + 3) // 4 AS h, (w + 3) // 4 AS w, y // 4 AS y, x // 4 AS x, count(*) AS cells FROM px GROUP BY ALL),
      cn AS (SELECT image, least(floor(cy / 4), hh - 1) AS y, floor(cx / 4) AS x, {", ".join([f"count(*) FILTER (size_class = {i}) AS cnt{i}" for i in range(3)] + [f"count(*) FILTER (shape_class = {i}) AS shape{i}" for i in range(3)])}
        FROM cl JOIN (SELECT DISTINCT image, (h + 3) // 4 AS hh FROM px) USING (image) GROUP BY ALL),
      ar AS (SELECT image, y // 4 AS y, x // 4 AS x, {", ".join(f"count(*) FILTER (size_class = {i}) AS area{i}" for i in range(3))} FROM lab JOIN cl USING (image, label) GROUP BY ALL),
      al AS (SELECT fr.image, fr.h, fr.w, fr.y, fr.x, {", ".join(f"coalesce({n}{i}, 0) / CAST({'cells' if n == 'area' else 1} AS DOUBLE) AS {n}{i}" for n, i in _CELLS9)} FROM fr LEFT JOIN cn USING (image, y, x) LEFT JOIN ar USING (image, y, x)),
      {box_sql('al', [f'{n}{i}' for n, i in _CELLS9], 3, 'bx')} SELECT image, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {", ".join(f"round({n}{i}, 6) AS {n}{i}" for n, i in _CELLS9)} FROM bx""",
    "correlation": _TPL.replace("('c'), ('rot90'), ('flip')", "('c')") + " SELECT query, y, x, round(r, 6) AS ncc FROM pl",
    "template_table": f"""{_TPL} SELECT query, v AS variant, th, tw, CAST(pool AS INT) AS pool, round(stddev_pop(g), 6) AS std,
      round(max(g) FILTER (i = 0 AND j = 1), 6) AS second, round(max(g) FILTER (i = th - 1 AND j = tw - 2), 6) AS last_but_one FROM ts GROUP BY ALL""",
    "correlation_bundle": f"""{_TPL}, ok AS (SELECT query, v FROM ts GROUP BY query, v HAVING stddev_pop(g) >= 3 / 255.0 AND any_value(least(th, tw)) >= 4),
      lo AS (SELECT query, v, y // 2 AS y, x // 2 AS x, avg(r) AS r FROM pl SEMI JOIN ok USING (query, v) WHERE query IN (SELECT query FROM ok WHERE v = 'c') GROUP BY ALL)
      SELECT query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(max(r) FILTER (v = 'c'), 5) AS ncc_c, round(max(r) FILTER (v <> 'c'), 5) AS ncc_rot, round(max(r), 5) AS ncc_best,
        round(max(r) FILTER (v = 'c'), 5) AS ncc_max, round(max(r) FILTER (v = 'c'), 5) AS ncc_med FROM lo GROUP BY query, y, x""",
}
