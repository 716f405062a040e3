"""Queries by example: similarity of every cell to the cells of a query box."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.functions import vectors as V
from regionmatch.operators import grid, metrics, points, selection, similarity as sim
from regionmatch.plans import fixtures as fx
from regionmatch.session import cut_lineage
from regionmatch.plans.raster import _PX, block_sql, box_sql, sobel_sql

STRIDE = 8.0
LEVELS = (0.05, 0.15, 0.25, 0.35, 0.45)


def _parts(spark, sf):
    g = cut_lineage(sim.normalized(fx.grid_vectors(spark, sf)))  # every later step reads it
    return g, sim.exemplars(g, fx.boxes(spark, sf), STRIDE)


def box_cells(spark, sf):
    g = fx.grid_vectors(spark, sf).select("image", "gh", "gw").distinct()
    return points.box_cells(fx.boxes(spark, sf), g, STRIDE).select("query", "gy", "gx")


def _protos(spark, sf):
    g, ex = _parts(spark, sf)
    return g, sim.prototypes(ex)


def _show(df, column, *more):
    return df.select("query", "n", *more, *[F.round(F.col(column)[i], 6).alias(f"v{i}") for i in (0, 1, 31, 63)],
                     F.round(V.total(F.col(column)), 6).alias("total"))


def prototype(spark, sf):
    return _show(_protos(spark, sf)[1], "proto")


def robust_prototype(spark, sf):
    return _show(_protos(spark, sf)[1], "robust", "kept")


def self_similarity(spark, sf):
    p = _protos(spark, sf)[1]
    return p.select("query", "n", F.round("self_mean", 6).alias("self_mean"), F.round("self_min", 6).alias("self_min"))


def cosine_map(spark, sf):
    g, p = _protos(spark, sf)
    return sim.cosine_map(g, p, "proto").select("query", "gy", "gx", F.round("sim", 6).alias("sim"))


def robust_cosine(spark, sf):
    g, p = _protos(spark, sf)
    return sim.cosine_map(g, p, "robust").select("query", "gy", "gx", F.round("sim", 6).alias("sim"))


def exemplar_cosines(spark, sf):
    """Largest similarity to the query's cells, and the mean of the three largest."""
    g, ex = _parts(spark, sf)
    m = sim.exemplar_maps(g, ex)
    return m.select("query", "gy", "gx", F.round("max_sim", 6).alias("max_sim"), F.round("topk_sim", 6).alias("topk_sim"))


def exemplar_lda(spark, sf):
    """Whitened direction map: the query's own mean scores one, the drawing's mean zero."""

    g, p = _protos(spark, sf)
    d = sim.whitened_directions(p, sim.image_statistics(g), "raw_mean")
    return sim.whitened_map(g, d).withColumn("lda", F.round("lda", 4))


def image_moments(spark, sf):
    """Mean and covariance entries of every drawing, over all its grid cells."""
    m = sim.image_moments(fx.grid_vectors(spark, sf)).select("image", "n", "mu", F.posexplode("cov").alias("at", "cov"), F.size("mu").alias("d"))
    i, j = F.floor(F.col("at") / F.col("d")).cast("int"), (F.col("at") % F.col("d")).cast("int")
    return m.select("image", "n", i.alias("i"), j.alias("j"), F.round(F.get("mu", i), 9).alias("mean_i"), F.round("cov", 9).alias("cov"))


def similarity_rank(spark, sf):
    g, p = _protos(spark, sf)
    m = sim.cosine_map(g, p, "proto").withColumn("sim", F.round("sim", 6))
    return sim.with_rank(m, ["sim"]).select("query", "gy", "gx", F.round("sim_rank", 4).alias("sim_rank"))


def value_channels(spark, sf):
    """Clipped and ranked channels of the similarity map, stretched so that some values are cut."""
    g, p = _protos(spark, sf)
    m = sim.cosine_map(g, p, "proto").withColumn("sim", F.round(F.col("sim") * 20, 4))
    return sim.value_channels(m, ["sim"]).select("query", "gy", "gx", F.round("sim_clip", 6).alias("sim_clip"), F.round("sim_rank", 4).alias("sim_rank"))


def relative_similarity(spark, sf):
    """Similarity minus the query's own mean and minimum self-similarity."""
    g, p = _protos(spark, sf)
    m = sim.cosine_map(g, p, "proto").join(p.select("query", "self_mean", "self_min"), "query")
    return m.select("query", "gy", "gx", F.round(F.col("sim") - F.col("self_mean"), 6).alias("rm"),
                    F.round(F.col("sim") - F.col("self_min"), 6).alias("rmin"))


def _spectra(spark, sf):
    """The vectors read as 8 x 8 (period x angle) spectra, with a log energy."""
    g = fx.grid_vectors(spark, sf)
    mag = F.transform("vec", lambda v: F.abs(v.cast("double")))
    g = g.select("image", "gh", "gw", "gy", "gx", mag.alias("raw"))
    return g.select("image", "gh", "gw", "gy", "gx", V.share(F.col("raw")).alias("desc"), F.ln(V.total(F.col("raw")) + 1e-4).alias("loge"))


def _spectrum_pairs(spark, sf):
    s = _spectra(spark, sf)
    q = sim.box_mean(s, fx.boxes(spark, sf), ["desc"], ["loge"], STRIDE)
    q = q.withColumn("q_desc", V.share(F.col("q_desc")))
    return s.join(q, "image")


CENTRES = tuple(float(i) for i in range(8))


def spectrum_compare(spark, sf):
    m = sim.spectrum_compare(_spectrum_pairs(spark, sf), 8, 8, CENTRES, ["query", "gy", "gx"])
    return m.select("query", "gy", "gx", *[F.round(n, 6).alias(n) for n in sim.SPECTRUM_FIELDS])


def histogram_compare(spark, sf):
    p = _spectrum_pairs(spark, sf)
    out = sim.histogram_compare(F.col("desc"), F.col("q_desc"))
    return p.select("query", "gy", "gx", *[F.round(v, 6).alias(n) for n, v in out.items()])


def bhattacharyya(spark, sf):
    p = _spectrum_pairs(spark, sf)
    return p.select("query", "gy", "gx", F.round(V.bhattacharyya(F.col("desc"), F.col("q_desc")), 6).alias("bc"))


def blob_compare(spark, sf):
    """Seven size classes read from the spectra's first entries."""
    s = _spectra(spark, sf).select("image", "gh", "gw", "gy", "gx", F.slice("desc", 1, 7).alias("cnt"), F.slice("desc", 8, 7).alias("area"))
    q = sim.box_mean(s, fx.boxes(spark, sf), ["cnt", "area"], [], STRIDE)
    b = sim.blob_compare(s.join(q, "image"))
    names = ("b_bccnt", "b_bcarea", "b_lcnt", "b_larea", "b_ldom", "qb_lcnt", "qb_dom")
    return b.select("query", "gy", "gx", *[F.round(n, 6).alias(n) for n in names])


def texture_evidence(spark, sf):
    """Ink, energy and orientation of coarse cells against the query box."""
    px = fx.px(spark, sf)
    st = grid.structure_tensor(px, radii=(4,))
    ink = grid.block_means(px, {"ink": (F.col("gray") < 128).cast("int")}, 4)
    m = st.join(ink.select("image", "y", "x", "ink"), ["image", "y", "x"]).select(
        "image", F.col("h").alias("gh"), F.col("w").alias("gw"), F.col("y").alias("gy"), F.col("x").alias("gx"), "ink",
        "xx", "xy", "yy", F.col("energy4").alias("energy"), F.col("phi4").alias("phi"), F.col("coh4").alias("coh"))
    q = sim.box_mean(m, fx.boxes(spark, sf), [], ["ink", "xx", "xy", "yy"], 4.0)
    tr, phi, coh = grid.tensor_parts(F.col("q_xx"), F.col("q_xy"), F.col("q_yy"))
    q = q.select("query", "image", "q_ink", tr.alias("q_energy"), phi.alias("q_phi"), coh.alias("q_coh"))
    e = sim.texture_evidence(m.join(q, "image"))
    return e.select("query", "gy", "gx", *[F.round(n, 4).alias(n) for n in ("ev_ink", "ev_ge", "ev_stcos", "ev_stsin", "ev_stw")])


def box_medians(spark, sf):
    """Median, mean and tenth percentile of a tone map over each query box."""
    from regionmatch.operators.ordering import exact_quantiles

    s = grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4).select(
        "image", F.col("h").alias("gh"), F.col("w").alias("gw"), F.col("y").alias("gy"), F.col("x").alias("gx"), "v")
    inside = points.slice_cells(fx.boxes(spark, sf), s.select("image", "gh", "gw").distinct(), 4).join(s, ["image", "gy", "gx"])
    q = exact_quantiles(inside, ["query"], "v", [0.1, 0.5], F.floor("_v").cast("long"))
    mean = inside.groupBy("query").agg(F.avg("v").alias("mean"))
    return q.join(mean, "query").select("query", F.round(F.col("quantiles")[0], 6).alias("p10"),
                                        F.round(F.col("quantiles")[1], 6).alias("median"), F.round("mean", 6).alias("mean"))


def quantile_table(spark, sf):
    """Decile table of each raster's tone map."""
    from regionmatch.operators.ordering import exact_quantiles

    s = grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4)
    q = exact_quantiles(s, ["image"], "v", [i / 10 for i in range(11)], F.floor("_v").cast("long"))
    return q.select("image", F.posexplode("quantiles").alias("decile", "v")).withColumn("v", F.round("v", 6))


def _tone_points(spark, sf):
    p = fx.px(spark, sf)
    s = grid.block_means(p, {"v": F.col("gray")}, 4)
    pts = p.select("image", F.ceil(F.col("h") / 4).cast("int").alias("gh"), F.ceil(F.col("w") / 4).cast("int").alias("gw"),
                   F.col("y").alias("py"), F.col("x").alias("px"))
    return s, pts


def bilinear(spark, sf):
    """A coarse map sampled at every native pixel."""
    s, pts = _tone_points(spark, sf)
    return points.bilinear(pts, s, ["v"], 4.0, ["image"], tile=64).select("image", "py", "px", F.round("v", 6).alias("v"))


def nearest_cell(spark, sf):
    s, pts = _tone_points(spark, sf)
    n = points.nearest_cell(pts, 4.0).groupBy("image", "y", "x").agg(F.count("*").alias("points"), F.sum("px").alias("sum_px"))
    return n


def regrid_labels(spark, sf):
    """Labels of a stride-4 grid at the centres of a stride-14 grid."""
    s = grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4)
    lab = s.select("image", "y", "x", (F.col("y") * 100 + F.col("x")).alias("label"))
    c = s.select("image", F.col("h").alias("lh"), F.col("w").alias("lw")).distinct()
    c = c.withColumn("gy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("lh") * 4 / 14).cast("int") - 1)))
    c = c.withColumn("gx", F.explode(F.sequence(F.lit(0), F.ceil(F.col("lw") * 4 / 14).cast("int") - 1)))
    return points.regrid_labels(c, lab, 14.0, 4.0, ["image"]).select("image", "gy", "gx", "label")


def upsample2(spark, sf):
    s = grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4)
    return points.upsample(s, "v", 2, ["image"], tile=64).select("image", "y", "x", F.round("v", 6).alias("v"))


def zero_shot(spark, sf):
    """Cosine map, sampled at native pixels, swept over thresholds; bright pixels are the targets."""
    g, p = _protos(spark, sf)
    m = sim.cosine_map(g, p, "proto").join(fx.boxes(spark, sf).select("query", "image"), "query")
    size = g.select("image", "gh", "gw").distinct()
    m = m.join(size, "image").select("query", F.col("gh").alias("h"), F.col("gw").alias("w"), F.col("gy").alias("y"),
                                     F.col("gx").alias("x"), F.round("sim", 6).alias("sim"))
    px = fx.px(spark, sf).select("image", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("gray") > 140).alias("pos"))
    pts = px.join(fx.boxes(spark, sf).select("query", "image"), "image").join(size, "image")
    at = points.bilinear(pts, m, ["sim"], STRIDE, ["query"], tile=64).withColumn("sim", F.round("sim", 6))
    c = metrics.threshold_counts(at, "sim", LEVELS, ["query", "image"]).withColumnRenamed("image", "document_id")
    s = metrics.threshold_sweep(metrics.threshold_ious(c), LEVELS)
    return s.withColumns({n: F.round(n, 6) for n in ("doc_macro", "query_mean")})


def _rival_maps(spark, sf):
    """One coarse map per query: the drawing's tone seen through the query's own contrast."""
    px = fx.px(spark, sf)
    s = grid.block_means(px, {"v": F.col("gray")}, 4)
    m = s.join(fx.boxes(spark, sf).select("image", "query"), "image")
    k = F.col("query") % 4
    p = F.round(F.when(k % 2 == 0, F.col("v") - 127).otherwise(127 - F.col("v")) / 32.0 + 0.5 + k / 100.0, 6)
    return m.select("image", "query", "y", "x", "h", "w", p.alias("p"))


def _rival_boxes(spark, sf):
    m = _rival_maps(spark, sf)
    size = m.select("image", F.col("h").alias("gh"), F.col("w").alias("gw")).distinct()
    inside = points.slice_cells(fx.boxes(spark, sf), size, 4, closed=True)
    return inside.select("query", "image", F.col("gy").alias("y"), F.col("gx").alias("x"))


def alias_pairs(spark, sf):
    """Pairs of queries that look for the same thing."""
    return selection.alias_pairs(cut_lineage(_rival_maps(spark, sf)), _rival_boxes(spark, sf), 0.5)


def compete(spark, sf):
    m = cut_lineage(_rival_maps(spark, sf))
    a = selection.alias_pairs(m, _rival_boxes(spark, sf), 0.5)
    return selection.compete(m, a, 0.1).select("query", "y", "x", F.round("p", 6).alias("p"))


QUERIES = {f.__name__: f for f in (
    box_cells, prototype, robust_prototype, self_similarity, cosine_map, robust_cosine, exemplar_cosines, exemplar_lda,
    similarity_rank, value_channels, relative_similarity, spectrum_compare, histogram_compare, bhattacharyya, blob_compare,
    texture_evidence, box_medians, quantile_table, bilinear, nearest_cell, regrid_labels, upsample2, zero_shot,
    alias_pairs, compete, image_moments)}


# ---- SQL twins --------------------------------------------------------------------------


def box_cells_sql(stride, sizes, out):
    """Cells of each box by the centre rule, from a table ``sizes(image, gh, gw)``."""
    def axis(lo, hi, n, name):
        return f"""{out}_{name} AS (SELECT query, image, least(greatest(i, 0), {n} - 1) AS {name} FROM (
    SELECT query, image, {n}, i, (i + 0.5) * {stride} >= {lo} AND (i + 0.5) * {stride} < {hi} AS ok
    FROM (SELECT *, unnest(range(CAST(floor({lo} / {stride}) AS BIGINT), CAST(ceil({hi} / {stride}) AS BIGINT))) AS i FROM boxes JOIN {sizes} USING (image)))
    QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY query) )"""
    return f"""{axis('y0', 'y1', 'gh', 'gy')}, {axis('x0', 'x1', 'gw', 'gx')},
  {out} AS (SELECT DISTINCT query, image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx FROM {out}_gy JOIN {out}_gx USING (query, image))"""


def slice_cells_sql(stride, sizes, out, closed=False):
    """Cells of each box by whole division of its corners, from a table ``sizes(image, gh, gw)``."""
    last = (lambda lo, hi: f"{hi} // {stride}") if closed else (lambda lo, hi: f"greatest({hi} // {stride} - 1, {lo} // {stride})")
    axis = lambda lo, hi, n: f"unnest(range({lo} // {stride}, least({last(lo, hi)}, {n} - 1) + 1))"
    return f"""{out} AS (SELECT query, image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx FROM (
    SELECT *, {axis('x0', 'x1', 'gw')} AS gx FROM (SELECT *, {axis('y0', 'y1', 'gh')} AS gy FROM boxes JOIN {sizes} USING (image))))"""


def vmean(src, vec, out, by="query, image"):
    return f"""{out} AS (SELECT {by}, list(m ORDER BY i) AS v, any_value(n) AS n FROM (
    SELECT {by}, i, avg({vec}[i]) AS m, count(*) AS n FROM {src}, range(1, 65) t(i) GROUP BY {by}, i) GROUP BY {by})"""


def unit_sql(v):
    return f"list_transform({v}, lambda e: e / (sqrt(list_inner_product({v}, {v})) + 1e-6))"


_BASE = f"""WITH {fx.GRID}, {fx.BOXES}, gs AS (SELECT DISTINCT image, gh, gw FROM grid), {box_cells_sql(8.0, 'gs', 'bc')},
  u AS (SELECT image, gh, gw, gy, gx, {unit_sql('vec')} AS vec FROM grid),
  ex AS (SELECT bc.*, vec FROM bc JOIN u USING (image, gy, gx)),
  {vmean('ex', 'vec', 'mv')}, mp AS (SELECT query, image, n, {unit_sql('v')} AS proto FROM mv),
  own AS (SELECT ex.*, n, proto, list_inner_product(vec, proto) AS self FROM ex JOIN mp USING (query, image)),
  cut AS (SELECT query, quantile_cont(self, 0.34) AS c FROM own GROUP BY query),
  kp AS (SELECT own.* FROM own JOIN cut USING (query) WHERE n < 3 OR self >= c),
  {vmean('kp', 'vec', 'rv')}, rp AS (SELECT query, image, n AS kept, {unit_sql('v')} AS robust FROM rv),
  st AS (SELECT query, avg(self) AS self_mean, min(self) AS self_min, any_value(n) AS n FROM own GROUP BY query)"""


def _proto_show(table, col, n, more=""):
    vals = ", ".join(f"round({col}[{i + 1}], 6) AS v{i}" for i in (0, 1, 31, 63))
    return f"{_BASE} SELECT query, {n}{more}, {vals}, round(list_sum({col}), 6) AS total FROM {table}"


_SPEC = f"""WITH {fx.GRID}, {fx.BOXES}, gs AS (SELECT DISTINCT image, gh, gw FROM grid), {box_cells_sql(8.0, 'gs', 'bc')},
  raw AS (SELECT image, gh, gw, gy, gx, list_transform(vec, lambda v: abs(v)) AS r FROM grid),
  s AS (SELECT image, gh, gw, gy, gx, list_transform(r, lambda v: v / (list_sum(r) + 1e-6)) AS d, ln(list_sum(r) + 1e-4) AS e FROM raw),
  qs AS (SELECT bc.query, s.* FROM bc JOIN s USING (image, gy, gx)), {vmean('qs', 'd', 'q0')},
  qe AS (SELECT query, avg(e) AS qe FROM qs GROUP BY query),
  q AS (SELECT query, image, list_transform(v, lambda x: x / (list_sum(v) + 1e-6)) AS qd, qe FROM q0 JOIN qe USING (query)),
  pr AS (SELECT query, gy, gx, d, e, qd, qe FROM s JOIN q USING (image)),
  el AS (SELECT query, gy, gx, (i - 1) // 8 AS r, (i - 1) % 8 AS a, d[i] AS p, qd[i] AS q FROM pr, range(1, 65) t(i))"""

_BLOB = f"""WITH {fx.GRID}, {fx.BOXES}, gs AS (SELECT DISTINCT image, gh, gw FROM grid), {box_cells_sql(8.0, 'gs', 'bc')},
  raw AS (SELECT image, gy, gx, list_transform(vec, lambda v: abs(v)) AS r FROM grid),
  s AS (SELECT image, gy, gx, list_transform(r, lambda v: v / (list_sum(r) + 1e-6)) AS d FROM raw),
  qs AS (SELECT bc.query, s.* FROM bc JOIN s USING (image, gy, gx)), {vmean('qs', 'd', 'q0')},
  pr AS (SELECT query, gy, gx, d[1:7] AS c, d[8:14] AS a, v[1:7] AS qc, v[8:14] AS qa FROM s JOIN q0 USING (image)),
  k AS (SELECT *, list_sum(c) AS cs, list_sum(qc) AS qcs, list_sum(a) AS asum, list_sum(qa) AS qas, list_position(qa, list_max(qa)) AS dom FROM pr)"""

_TONE = f"{_PX}, {block_sql('px', {'v': 'gray'}, 's')}"


def bilinear_sql(pts, grid_name, stride, key, value, out):
    return f"""{out}_f AS (SELECT *, least(greatest((py + 0.5) / {stride} - 0.5, 0), gh - 1) AS fy, least(greatest((px + 0.5) / {stride} - 0.5, 0), gw - 1) AS fx FROM {pts}),
  {out} AS (SELECT p.* EXCLUDE (fy, fx), a.{value} * (1 - (fy - floor(fy))) * (1 - (fx - floor(fx))) + b.{value} * (1 - (fy - floor(fy))) * (fx - floor(fx))
      + c.{value} * (fy - floor(fy)) * (1 - (fx - floor(fx))) + d.{value} * (fy - floor(fy)) * (fx - floor(fx)) AS bil
    FROM {out}_f p JOIN {grid_name} a ON a.{key} = p.{key} AND a.y = floor(fy) AND a.x = floor(fx)
    JOIN {grid_name} b ON b.{key} = p.{key} AND b.y = floor(fy) AND b.x = least(floor(fx) + 1, gw - 1)
    JOIN {grid_name} c ON c.{key} = p.{key} AND c.y = least(floor(fy) + 1, gh - 1) AND c.x = floor(fx)
    JOIN {grid_name} d ON d.{key} = p.{key} AND d.y = least(floor(fy) + 1, gh - 1) AND d.x = least(floor(fx) + 1, gw - 1))"""


_RIVAL = f"""{_TONE}, {fx.BOXES}, gs AS (SELECT DISTINCT image, h AS gh, w AS gw FROM s), {slice_cells_sql(4, 'gs', 'bc', True)},
  rm AS (SELECT image, query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN query % 4 % 2 = 0 THEN v - 127 ELSE 127 - v END / 32.0 + 0.5 + query % 4 / 100.0, 6) AS p
    FROM s JOIN boxes USING (image)),
  md AS (SELECT bc.query AS host, rm.query AS guest, median(p) AS m FROM bc JOIN rm ON rm.image = bc.image AND rm.y = gy AND rm.x = gx GROUP BY ALL),
  al AS (SELECT a.host AS query, a.guest AS alias FROM md a JOIN md b ON a.host = b.guest AND a.guest = b.host
    WHERE a.host <> a.guest AND a.m > 0.5 AND b.m > 0.5)"""



_EV = f"""{_PX}, {sobel_sql('px', 'n.gray')}, g AS (SELECT * REPLACE (gx / 255.0 AS gx, gy / 255.0 AS gy) FROM sob),
  {block_sql('g', {'xx': 'gx * gx', 'xy': 'gx * gy', 'yy': 'gy * gy', 'ink': 'CAST(gray < 128 AS INT)'}, 's')},
  {box_sql('s', ['xx', 'xy', 'yy'], 4, 'a')}, {fx.BOXES}, gs AS (SELECT DISTINCT image, h AS gh, w AS gw FROM s), {box_cells_sql(4.0, 'gs', 'bc')},
  q AS (SELECT query, bc.image, avg(ink) AS qi, avg(xx) AS qxx, avg(xy) AS qxy, avg(yy) AS qyy FROM bc JOIN s ON s.image = bc.image AND s.y = gy AND s.x = gx GROUP BY ALL),
  e AS (SELECT query, a.y, a.x, s.ink, qi, a.xx + a.yy AS tr, atan2(2 * a.xy, a.xx - a.yy) AS phi,
    sqrt((a.xx - a.yy) ** 2 + 4 * a.xy * a.xy) / (a.xx + a.yy + 1e-6) AS coh, qxx + qyy AS qtr, atan2(2 * qxy, qxx - qyy) AS qphi,
    sqrt((qxx - qyy) ** 2 + 4 * qxy * qxy) / (qxx + qyy + 1e-6) AS qcoh FROM a JOIN s USING (image, y, x) JOIN q USING (image))"""

_RANKS = ", ".join(f"{i}::DOUBLE / 100" for i in range(101))

ORACLE = {
    "box_cells": f"{_BASE} SELECT query, gy, gx FROM bc",
    "prototype": _proto_show("mp", "proto", "n"),
    "robust_prototype": _proto_show("rp JOIN mp USING (query, image)", "robust", "n", ", kept"),
    "self_similarity": f"{_BASE} SELECT query, n, round(self_mean, 6) AS self_mean, round(self_min, 6) AS self_min FROM st",
    "cosine_map": f"{_BASE} SELECT query, gy, gx, round(list_inner_product(vec, proto), 6) AS sim FROM u JOIN mp USING (image)",
    "robust_cosine": f"{_BASE} SELECT query, gy, gx, round(list_inner_product(vec, robust), 6) AS sim FROM u JOIN rp USING (image)",
    "exemplar_cosines": f"""{_BASE}, pairs AS (SELECT ex.query, u.gy, u.gx, list_inner_product(u.vec, ex.vec) AS c FROM u JOIN ex USING (image))
      SELECT query, gy, gx, round(max(c), 6) AS max_sim, round(avg(c) FILTER (r <= 3), 6) AS topk_sim
      FROM (SELECT *, row_number() OVER (PARTITION BY query, gy, gx ORDER BY c DESC) AS r FROM pairs) GROUP BY query, gy, gx""",
    "similarity_rank": f"""{_BASE}, m AS (SELECT query, gy, gx, round(list_inner_product(vec, proto), 6) AS sim FROM u JOIN mp USING (image)),
      tb AS (SELECT query, quantile_cont(sim, [{_RANKS}]) AS k FROM m GROUP BY query),
      b AS (SELECT m.*, k, len(list_filter(k, lambda e: e <= sim)) AS n FROM m JOIN tb USING (query))
      SELECT query, gy, gx, round(CASE WHEN n <= 0 THEN 0.0 WHEN n > 100 THEN 1.0 ELSE (n - 1 + (sim - k[n]) / (k[n + 1] - k[n])) / 100 END, 4) AS sim_rank FROM b""",
    "value_channels": f"""{_BASE}, m AS (SELECT query, gy, gx, round(list_inner_product(vec, proto) * 20, 4) AS sim FROM u JOIN mp USING (image)),
      tb AS (SELECT query, quantile_cont(sim, [{_RANKS}]) AS k FROM m GROUP BY query),
      b AS (SELECT m.*, k, len(list_filter(k, lambda e: e <= sim)) AS n FROM m JOIN tb USING (query))
      SELECT query, gy, gx, round(greatest(least(sim, 10), -10) / 4, 6) AS sim_clip, round(CASE WHEN n <= 0 THEN 0.0 WHEN n > 100 THEN 1.0 ELSE (n - 1 + (sim - k[n]) / (k[n + 1] - k[n])) / 100 END, 4) AS sim_rank FROM b""",
    "relative_similarity": f"""{_BASE} SELECT query, gy, gx, round(list_inner_product(vec, proto) - self_mean, 6) AS rm,
      round(list_inner_product(vec, proto) - self_min, 6) AS rmin FROM u JOIN mp USING (image) JOIN st USING (query)""",
    "image_moments": f"""WITH {fx.GRID}, e AS (SELECT image, gy, gx, i, vec[i + 1] AS v FROM grid, range(0, 64) t(i)),
      m AS (SELECT image, i, avg(v) AS mean_i, count(*) AS n FROM e GROUP BY ALL),
      c AS (SELECT a.image, a.i, b.i AS j, sum((a.v - ma.mean_i) * (b.v - mb.mean_i)) AS s FROM e a JOIN e b USING (image, gy, gx)
        JOIN m ma ON ma.image = a.image AND ma.i = a.i JOIN m mb ON mb.image = b.image AND mb.i = b.i GROUP BY ALL)
      SELECT image, n, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(mean_i, 9) AS mean_i, round(s / greatest(n - 1, 1), 9) AS cov FROM c JOIN m USING (image, i)""",
    "spectrum_compare": f"""{_SPEC}, rot AS (SELECT x.query, x.gy, x.gx, k, sum(sqrt(x.p) * sqrt(y.q)) AS v FROM el x, range(0, 8) t(k)
        JOIN el y ON y.query = x.query AND y.gy = x.gy AND y.gx = x.gx AND y.r = x.r AND y.a = (x.a - k + 8) % 8 GROUP BY ALL),
      rb AS (SELECT query, gy, gx, max(v) FILTER (k = 0) AS bc, max(v) AS bcrot, arg_max(k, (round(v, 12), -k)) AS sh FROM rot GROUP BY ALL),
      rd AS (SELECT query, gy, gx, sum(sqrt(p) * sqrt(q)) AS bcrad, sum(abs(p - q)) AS l1rad, sum((p - q) * r) AS centd
        FROM (SELECT query, gy, gx, r, sum(p) AS p, sum(q) AS q FROM el GROUP BY ALL) GROUP BY ALL),
      ag AS (SELECT query, gy, gx, sum(sqrt(p) * sqrt(q)) AS bcang FROM (SELECT query, gy, gx, a, sum(p) AS p, sum(q) AS q FROM el GROUP BY ALL) GROUP BY ALL),
      al AS (SELECT query, gy, gx, sum(abs(p - q)) AS l1, max(p) - max(q) AS peakd FROM el GROUP BY ALL)
      SELECT query, gy, gx, round(bc, 6) AS bc, round(l1, 6) AS l1, round(bcrot, 6) AS bcrot, CAST(least(sh, 8 - sh) AS DOUBLE) AS rotd,
        round(bcrad, 6) AS bcrad, round(l1rad, 6) AS l1rad, round(bcang, 6) AS bcang, round(centd, 6) AS centd, round(e - qe, 6) AS ed, round(peakd, 6) AS peakd
      FROM rb JOIN rd USING (query, gy, gx) JOIN ag USING (query, gy, gx) JOIN al USING (query, gy, gx) JOIN pr USING (query, gy, gx)""",
    "histogram_compare": f"""{_SPEC} SELECT query, gy, gx, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)) + 1e-6), 6) AS cos,
      round(sum(abs(p / (tp + 1e-6) - q / (tq + 1e-6))), 6) AS l1, round(any_value(tp) - any_value(tq), 6) AS total_diff
      FROM (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS tq FROM el WINDOW w AS (PARTITION BY query, gy, gx)) GROUP BY query, gy, gx""",
    "bhattacharyya": f"{_SPEC} SELECT query, gy, gx, round(sum(sqrt(p) * sqrt(q)), 6) AS bc FROM el GROUP BY query, gy, gx",
    "blob_compare": f"""{_BLOB} SELECT query, gy, gx,
      round(list_sum(list_transform(range(1, 8), lambda i: sqrt(c[i] / (cs + 1e-6)) * sqrt(qc[i] / (qcs + 1e-6)))), 6) AS b_bccnt,
      round(list_sum(list_transform(range(1, 8), lambda i: sqrt(a[i] / (asum + 1e-6)) * sqrt(qa[i] / (qas + 1e-6)))), 6) AS b_bcarea,
      round(ln((cs + 1e-3) / (qcs + 1e-3)), 6) AS b_lcnt, round(ln((asum + 1e-3) / (qas + 1e-3)), 6) AS b_larea,
      round(ln((a[dom] + 1e-3) / (qa[dom] + 1e-3)), 6) AS b_ldom, round(ln(qcs + 1e-3), 6) AS qb_lcnt, CAST(dom - 1 AS DOUBLE) AS qb_dom FROM k""",
    "texture_evidence": f"""{_EV} SELECT query, CAST(y AS INT) AS gy, CAST(x AS INT) AS gx, round(ln((ink + 1e-3) / (qi + 1e-3)), 4) AS ev_ink,
      round(ln((tr + 1e-5) / (qtr + 1e-5)), 4) AS ev_ge, round(cos(phi - qphi), 4) AS ev_stcos, round(sin(phi - qphi), 4) AS ev_stsin,
      round(cos(phi - qphi) * sqrt(coh * qcoh), 4) AS ev_stw FROM e""",
    "box_medians": f"""{_TONE}, {fx.BOXES}, gs AS (SELECT DISTINCT image, h AS gh, w AS gw FROM s), {slice_cells_sql(4, 'gs', 'bc')}
      SELECT query, round(quantile_cont(v, 0.1), 6) AS p10, round(median(v), 6) AS median, round(avg(v), 6) AS mean
      FROM bc JOIN s ON s.image = bc.image AND s.y = gy AND s.x = gx GROUP BY query""",
    "quantile_table": f"""{_TONE} SELECT image, CAST(i AS INT) AS decile, round(quantile_cont(v, [{", ".join(f"{i / 10}::DOUBLE" for i in range(11))}])[i + 1], 6) AS v
      FROM s, range(0, 11) t(i) GROUP BY image, i""",
    "bilinear": f"""{_TONE}, pts AS (SELECT image, (h + 3) // 4 AS gh, (w + 3) // 4 AS gw, y AS py, x AS px FROM px), {bilinear_sql('pts', 's', 4.0, 'image', 'v', 'b')}
      SELECT image, py, px, round(bil, 6) AS v FROM b""",
    "nearest_cell": f"""{_PX} SELECT image, CAST(least(round_even((y + 0.5) / 4 - 0.5, 0), (h + 3) // 4 - 1) AS INT) AS y, CAST(least(round_even((x + 0.5) / 4 - 0.5, 0), (w + 3) // 4 - 1) AS INT) AS x,
      count(*) AS points, CAST(sum(px.x) AS BIGINT) AS sum_px FROM px GROUP BY 1, 2, 3""",
    "regrid_labels": f"""{_TONE}, c AS (SELECT DISTINCT image, h, w FROM s)
      SELECT image, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, CAST(least(floor((gy + 0.5) * 14 / 4), h - 1) * 100 + least(floor((gx + 0.5) * 14 / 4), w - 1) AS INT) AS label
      FROM (SELECT *, unnest(range(0, CAST(ceil(w * 4 / 14.0) AS BIGINT))) AS gx FROM (SELECT *, unnest(range(0, CAST(ceil(h * 4 / 14.0) AS BIGINT))) AS gy FROM c))""",
    "upsample2": f"""{_TONE}, pts AS (SELECT image, h AS gh, w AS gw, y * 2 + dy AS py, x * 2 + dx AS px FROM s, range(0, 2) a(dy), range(0, 2) b(dx)),
      {bilinear_sql('pts', 's', 2.0, 'image', 'v', 'b')} SELECT image, CAST(py AS INT) AS y, CAST(px AS INT) AS x, round(bil, 6) AS v FROM b""",
    "zero_shot": f"""{_BASE}, px AS (SELECT image, y AS py, CAST(i - 1 AS INT) AS px, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT) > 140 AS pos
        FROM rowsofimages, range(1, 65) t(i)),
      m AS (SELECT query, gy AS y, gx AS x, round(list_inner_product(vec, proto), 6) AS sim FROM u JOIN mp USING (image)),
      pts AS (SELECT query, image, gh, gw, py, px, pos FROM px JOIN boxes USING (image) JOIN gs USING (image)), {bilinear_sql('pts', 'm', 8.0, 'query', 'sim', 'b')},
      it AS (SELECT query, image, t, count(*) FILTER (pos AND round(bil, 6) > t) / CAST(count(*) FILTER (pos OR round(bil, 6) > t) AS DOUBLE) AS iou
        FROM b, (VALUES {", ".join(f"({t}::DOUBLE)" for t in LEVELS)}) l(t) GROUP BY ALL HAVING count(*) FILTER (pos) > 0)
      SELECT t AS threshold, round(avg(d), 6) AS doc_macro, round(sum(s) / sum(n), 6) AS query_mean FROM
        (SELECT t, image, avg(iou) AS d, sum(iou) AS s, count(*) AS n FROM it GROUP BY ALL) GROUP BY t""",
    "alias_pairs": f"{_RIVAL} SELECT query, alias FROM al",
    "compete": f"""{_RIVAL} SELECT query, y, x, round(CASE WHEN p + 0.1 < mx THEN least(p, 0.49) ELSE p END, 6) AS p FROM (
      SELECT a.query, a.y, a.x, a.p, max(b.p) AS mx FROM rm a LEFT JOIN rm b ON b.image = a.image AND b.y = a.y AND b.x = a.x AND b.query <> a.query
        AND NOT EXISTS (SELECT 1 FROM al WHERE al.query = a.query AND al.alias = b.query) GROUP BY ALL)""",
}
