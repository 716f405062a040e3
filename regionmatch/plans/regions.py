"""Queries over connected components and the edits built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.operators import components, grid
from regionmatch.plans import fixtures as fx
from regionmatch.plans.raster import _AT, _PX, block_sql, gauss_sql, mirror  # SQL text helpers

AT = ("image", "y", "x")
CUT = 132  # gray level that splits the rasters about in half
TILE = 64


def _prob(spark, sf):
    """The rasters as maps of values near one half."""
    return fx.px(spark, sf).withColumn("p", F.round((F.col("gray") - CUT) / 64.0 + 0.5, 6))


def components4(spark, sf):
    """Four-connected regions, stitched over small tiles."""
    cells = fx.px(spark, sf).filter(F.col("gray") > CUT).select("image", "h", "w", "y", "x")
    return components.label(cells, tile=16).select(*AT, "label")


def components8(spark, sf):
    cells = fx.px(spark, sf).filter(F.col("gray") > CUT + 12).select("image", "h", "w", "y", "x")
    return components.label(cells, eight=True, tile=TILE).select(*AT, "label")


def _out(df):
    return df.select(*AT, F.round("p", 6).alias("p"))


def fill_holes(spark, sf):
    return _out(components.fill_holes(_prob(spark, sf), "p", 0.5, tile=TILE, keep_higher=False))


def fill_small_holes(spark, sf):
    return _out(components.fill_holes(_prob(spark, sf), "p", 0.5, max_area=20, tile=TILE))


def fill_small_any(spark, sf):
    return _out(components.fill_holes(_prob(spark, sf), "p", 0.5, max_area=20, include_border=True, tile=TILE))


def hysteresis(spark, sf):
    return _out(components.hysteresis(_prob(spark, sf), "p", 0.55, 0.9, tile=TILE))


def component_mean_keep(spark, sf):
    return _out(components.keep_by_mean(_prob(spark, sf), "p", 0.55, 0.7, tile=TILE))


def min_area(spark, sf):
    return _out(components.drop_small(_prob(spark, sf), "p", 0.5, F.lit(6), tile=TILE))


def _query_prob(spark, sf):
    """A coarse probability map per query."""
    small = grid.block_means(_prob(spark, sf), {"p": F.col("p")}, 2)
    return small.join(fx.boxes(spark, sf), "image").withColumn("p", F.round(F.col("p") + (F.col("query") % 4 - 1) / 64.0, 6))


def min_area_relative(spark, sf):
    """Drop regions smaller than half of the query box."""
    m = _query_prob(spark, sf)
    need = 0.5 * (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    d = components.drop_small(m, "p", 0.5, need, stride=2, tile=TILE, keys=("query",))
    return d.select("query", "y", "x", F.round("p", 6).alias("p"))


def post_process(spark, sf):
    m = _query_prob(spark, sf).select("query", "h", "w", "y", "x", "p")
    return components.post_process(m, "p", 0.5, 0.8, tile=TILE).select("query", "y", "x", F.round("p", 5).alias("p"))


def component_stats(spark, sf):
    lab = components.label_where(_prob(spark, sf), F.col("p") > 0.55, tile=TILE)
    s = components.component_stats(lab, "p")
    return s.select("image", "label", "cells", "y0", "y1", "x0", "x1", "border",
                    *[F.round(n, 6).alias(n) for n in ("cy", "cx", "mean", "max", "compact", "aspect")])


def _query_labels(spark, sf):
    m = _query_prob(spark, sf).select("query", "h", "w", "y", "x", "p")
    return components.label_where(m, F.col("p") > 0.5, tile=TILE, keys=("query",))


def component_ranks(spark, sf):
    s = components.component_stats(_query_labels(spark, sf), "p", 2, ("query",))
    r = components.with_query_context(s, fx.boxes(spark, sf), 2)
    return r.select("query", "label", "area", "area_rank", "components",
                    *[F.round(n, 6).alias(n) for n in ("accepted_share", "log_area_query", "query_distance")])


def query_component(spark, sf):
    return components.query_component(_query_labels(spark, sf), fx.boxes(spark, sf), 2)


QUERIES = {f.__name__: f for f in (
    components4, components8, fill_holes, fill_small_holes, fill_small_any, hysteresis, component_mean_keep, min_area,
    min_area_relative, post_process, component_stats, component_ranks, query_component)}


# ---- SQL twins --------------------------------------------------------------------------


def label_sql(src, cond, out, key="image", eight=False):
    """Labels by spreading the smallest position to neighbours until nothing changes."""
    near = "greatest(abs(n.y - l.y), abs(n.x - l.x)) = 1" if eight else "abs(n.y - l.y) + abs(n.x - l.x) = 1"
    return f"""{out}_m AS (SELECT {key}, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(y AS BIGINT) * w + x AS id FROM {src} WHERE {cond}),
  {out}_e AS (SELECT l.{key}, l.id AS a, n.id AS b FROM {out}_m l, range(-1, 2) d1(dy), range(-1, 2) d2(dx)
    JOIN {out}_m n ON n.{key} = l.{key} AND n.y = l.y + dy AND n.x = l.x + dx WHERE {near}),
  {out} AS (SELECT {out}_m.{key}, y, x, r.label FROM {out}_m JOIN {out}_r r USING ({key}, id))"""


def labelled_sql(base, src, cond, key="image", eight=False, name="lab"):
    """WITH clause holding a recursive label table ``name`` over ``src``."""
    body = label_sql(src, cond, name, key, eight)
    first, last = body.rsplit(f",\n  {name} AS", 1)
    rec = f""",
  {name}_r({key}, id, label) USING KEY ({key}, id) AS (SELECT {key}, id, id FROM {name}_m
    UNION SELECT e.{key}, e.b, min(r.label) FROM {name}_r r JOIN {name}_e e ON e.{key} = r.{key} AND e.a = r.id
      JOIN recurring.{name}_r t ON t.{key} = e.{key} AND t.id = e.b GROUP BY e.{key}, e.b, t.label HAVING min(r.label) < t.label)"""
    return base.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + first + rec + f",\n  {name} AS" + last


_PROB = f"{_PX}, prob AS (SELECT image, h, w, y, x, round((gray - {CUT}) / 64.0 + 0.5, 6) AS p FROM px)"
_EDGE = "bool_or(y = 0 OR x = 0 OR y = h - 1 OR x = w - 1)"


def edit_sql(cond, pick, change, other="p", base=_PROB, src="prob", key="image"):
    return labelled_sql(base, src, cond, key) + f""", g AS (SELECT s.*, label FROM {src} s LEFT JOIN lab USING ({key}, y, x)),
  c AS (SELECT {key}, label, {pick} AS hit FROM g WHERE label IS NOT NULL GROUP BY {key}, label)
  SELECT {key}, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN hit THEN {change} ELSE {other} END, 6) AS p
  FROM g LEFT JOIN c USING ({key}, label)"""


_QPROB = f"""{_PROB}, {block_sql('prob', {'p': 'p'}, 'small', 2)}, {fx.BOXES},
  qp AS (SELECT query, s.h, s.w, s.y, s.x, round(p + (query % 4 - 1) / 64.0, 6) AS p, x0, y0, x1, y1 FROM small s JOIN boxes USING (image))"""
_QLAB = labelled_sql(_QPROB, "qp", "p > 0.5", "query")

ORACLE = {
    "components4": labelled_sql(_PX, "px", f"gray > {CUT}") + " SELECT image, y, x, label FROM lab",
    "components8": labelled_sql(_PX, "px", f"gray > {CUT + 12}", eight=True) + " SELECT image, y, x, label FROM lab",
    "fill_holes": edit_sql("p <= 0.5", f"NOT {_EDGE}", "0.51"),
    "fill_small_holes": edit_sql("p <= 0.5", f"NOT {_EDGE} AND count(*) < 20", "greatest(p, 0.51)"),
    "fill_small_any": edit_sql("p <= 0.5", "count(*) < 20", "greatest(p, 0.51)"),
    "hysteresis": edit_sql("p > 0.55", "max(p) > 0.9", "greatest(p, 0.51)", "least(p, 0.49)"),
    "component_mean_keep": edit_sql("p > 0.55", "avg(p) > 0.7", "greatest(p, 0.51)", "least(p, 0.49)"),
    "min_area": edit_sql("p > 0.5", "count(*) < 6", "least(p, 0.49)"),
    "min_area_relative": edit_sql("p > 0.5", "count(*) * 4 < 0.5 * max((x1 - x0) * (y1 - y0))", "least(p, 0.49)", base=_QPROB, src="qp", key="query"),
    "post_process": labelled_sql(f"{_QPROB}, {gauss_sql('qp', 'p', 0.8, 'bl', 'query')}", "bl", "v <= 0.5", "query") + f""",
      g AS (SELECT s.*, label FROM bl s LEFT JOIN lab USING (query, y, x)), c AS (SELECT query, label, NOT {_EDGE} AS hit FROM g WHERE label IS NOT NULL GROUP BY query, label)
      SELECT query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN hit THEN 0.51 ELSE v END, 5) AS p FROM g LEFT JOIN c USING (query, label)""",
    "component_stats": labelled_sql(_PROB, "prob", "p > 0.55") + f""" SELECT image, label, count(*) AS cells, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1,
      {_EDGE} AS border, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, round(avg(p), 6) AS mean, round(max(p), 6) AS max,
      round(count(*) / CAST((max(y) + 1 - min(y)) * (max(x) + 1 - min(x)) AS DOUBLE), 6) AS compact,
      round(ln(greatest(max(y) + 1 - min(y), max(x) + 1 - min(x)) / CAST(least(max(y) + 1 - min(y), max(x) + 1 - min(x)) AS DOUBLE)), 6) AS aspect
      FROM prob JOIN lab USING (image, y, x) GROUP BY image, label""",
    "component_ranks": _QLAB + """, s AS (SELECT query, label, count(*) * 4 AS area, avg(y) * 2 AS cy, avg(x) * 2 AS cx FROM lab GROUP BY ALL)
      SELECT query, label, area, row_number() OVER (PARTITION BY query ORDER BY area DESC, label) - 1 AS area_rank,
      count(*) OVER (PARTITION BY query) AS components,
      round(area / CAST(sum(area) OVER (PARTITION BY query) AS DOUBLE), 6) AS accepted_share,
      round(ln(area / CAST((x1 - x0) * (y1 - y0) AS DOUBLE)), 6) AS log_area_query,
      round(ln(1 + sqrt((cy - (y0 + y1) / 2.0) ** 2 + (cx - (x0 + x1) / 2.0) ** 2) / sqrt((x1 - x0) * (y1 - y0))), 6) AS query_distance
      FROM s JOIN boxes USING (query)""",
    "query_component": _QLAB + """, hit AS (SELECT query, label, count(*) AS cells FROM lab JOIN boxes USING (query)
      WHERE y BETWEEN y0 // 2 AND (y1 - 1) // 2 AND x BETWEEN x0 // 2 AND (x1 - 1) // 2 GROUP BY ALL)
      SELECT query, label, cells FROM hit QUALIFY row_number() OVER (PARTITION BY query ORDER BY cells DESC, label) = 1""",
}
