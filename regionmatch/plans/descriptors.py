"""Queries over region descriptors, corner and turned templates, pooled texture maps and native masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from regionmatch.functions import vectors as V
from regionmatch.operators import descriptors, evidence, grid, texture
from regionmatch.operators import similarity as sim
from regionmatch.plans import end_to_end as e2e
from regionmatch.plans import fixtures as fx
from regionmatch.plans.matching import _spectra, bilinear_sql, box_cells_sql, slice_cells_sql, unit_sql
from regionmatch.plans.raster import _PX, block_sql, box_sql, gauss_sql, sobel_sql
from regionmatch.plans.regions import _EDGE, _PROB, _QLAB, _prob, _query_prob, labelled_sql
from regionmatch.plans.texture_maps import _BLOB, EDGES as TEXTURE_EDGES, _ink, loge_sql
from regionmatch.session import cut_lineage

TONE = {"mean4": "v", "std4": "abs(v - 0.5)", "ink4": "v * v", "bg4": "1 - v", "paper4": "floor(v * 8) / 8", "paperfrac4": "v * (1 - v)",
        "mean12": "sqrt(v)", "paper12": "v * v * v", "ink12": "floor(v * 50)"}


def _tone(spark, sf):
    """Maps of the coarse rasters. Whole grays are averaged before they are scaled: such a mean is exact, so no order of sums
    moves it past a cut of ``TONE``."""
    v = grid.block_means(fx.px(spark, sf), {"v": F.col("gray")}, 4).withColumn("v", F.col("v") / 255.0)
    return v.withColumns({n: F.expr(e).cast("double") for n, e in TONE.items()})


def region_descriptors(spark, sf):
    """All 35 descriptors of the accepted components; spectra, size classes and vectors are read from the vector grid."""
    c = F.col
    lab = cut_lineage(_query_prob(spark, sf).select("query", "image", "h", "w", "y", "x", F.when(c("p") > 0.5, c("p")).alias("_p")))
    from regionmatch.operators import components

    lab = cut_lineage(components.label_where(lab, c("_p").isNotNull(), tile=64, keys=("query",)))
    s = cut_lineage(_spectra(spark, sf))
    at = ["image", "gh", "gw", "gy", "gx"]
    g = cut_lineage(fx.grid_vectors(spark, sf))
    part = lambda first: descriptors.Vectors(cut_lineage(sim.normalized(g.select(*at, F.transform(F.slice("vec", first, 2), lambda v: v.cast("double")).alias("vec")))), 8.0)
    blobs = {r: (s.select(*at, F.slice("desc", a, 7).alias("cnt"), F.slice("desc", a + 7, 7).alias("area")), 8.0) for r, a in ((6, 1), (16, 15))}
    spectra = [descriptors.Spectrum(s, 8.0, 8, 8), descriptors.Spectrum(s.withColumn("desc", F.slice("desc", 1, 32)), 8.0, 4, 8)]
    tone = _tone(spark, sf)
    tone = cut_lineage(tone.withColumnsRenamed({"h": "gh", "w": "gw", "y": "gy", "x": "gx"}))
    out = descriptors.region_descriptors(lab, fx.boxes(spark, sf), spectra, blobs, [part(1), part(3)], tone, list(TONE), 4, 2.0)
    return out.select("query", "label", *[F.round(n, 5).alias(n) for n in out.columns if n.startswith("r_")])


CORNER_MAPS = ("ncc_c", "ncc_rot", "ncc_best", "ncc_max", "ncc_med", "ncc_cblur")


def correlation_corners(spark, sf):
    """All correlation maps of query boxes large enough for corner crops, with the self score of the crops."""
    m, own = texture.correlation_bundle(fx.px(spark, sf), fx.wide_boxes(spark, sf), tile=32)
    return m.join(own, "query", "left").select("query", "y", "x", *[F.round(n, 5).alias(n) for n in (*CORNER_MAPS, "q_nccself")])


def quarter_turns(spark, sf):
    """Turned templates at quarter turns: scores, gaps and the best angle."""
    px = fx.px(spark, sf)
    shapes = texture.usable_turns(texture.rotated_templates(px, fx.wide_boxes(spark, sf), (0, 90, 180, 270)))
    m = texture.rotation_bundle(texture.correlate(px, shapes, 40, tile=32, down=2))
    return m.select("query", "y", "x", *[F.round(n, 5).alias(n) for n in ("ev_nr0", "ev_nr90", "ev_nr180", "ev_nrgap90", "ev_nrgap180")])


def pooled_texture(spark, sf):
    """Region-pooled correlation maps, the native-scale correlation, and shape classes against the query box."""
    px, boxes = fx.px(spark, sf), fx.wide_boxes(spark, sf)
    m, _ = texture.correlation_bundle(px, boxes, tile=64)
    x = texture.pooled_maps(cut_lineage(m), {"ncc_best": (4, 9), "ncc_max": (9,)}, tile=64)
    native = texture.native_correlation(px, boxes, down=2, blur=6, tile=64)
    out = x.join(native.select("query", "y", "x", "x_ncc1", "x_ncc1_b6"), ["query", "y", "x"])
    return out.select("query", "y", "x", *[F.round(n, 5).alias(n) for n in ("x_ncc_best_b4", "x_ncc_best_b9", "x_ncc_max_b9", "x_ncc1", "x_ncc1_b6")])


def pooled_shapes(spark, sf):
    """Shape-class densities of every coarse cell against those of the query box."""
    b = cut_lineage(texture.blob_maps(_ink(spark, sf), radii=(3,), tile=64)).select(
        "image", F.col("h").alias("gh"), F.col("w").alias("gw"), F.col("y").alias("gy"), F.col("x").alias("gx"), F.slice("shape3", 1, 3).alias("shape"))
    q = sim.box_mean(b, fx.wide_boxes(spark, sf), ["shape"], [], 4.0)
    s = texture.shape_compare(b.join(q, "image"), "x_sb3")
    return s.select("query", "gy", "gx", *[F.round(n, 5).alias(n) for n in ("x_sb3_bc", "x_sb3_ldom", "x_sb3_qdom")])


def native_masks(spark, sf):
    """Accepted native pixels per raster row; the last grid row and column reach past the drawing and are cropped."""
    small = grid.block_means(_prob(spark, sf), {"p": F.col("p")}, 4)
    m = small.join(fx.boxes(spark, sf), "image").withColumn("p", F.round(F.col("p") + (F.col("query") % 4 - 1) / 64.0, 6))
    size = fx.px(spark, sf).select("image", F.col("h").alias("native_h"), F.col("w").alias("native_w")).distinct()
    native = fx.boxes(spark, sf).select("query", "image").join(size, "image").drop("image")
    a = e2e.masks(cut_lineage(m.select("query", "h", "w", "y", "x", "p")), 0.5, 0.8, 64, native)
    return a.groupBy("query", "y").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"))


EV_INK, EV_TENSOR = (2, 4, 6), (2, 3)
EV_NAMES = (*[f"ev_ink{r}" for r in EV_INK], "ev_inkmx", *[f"ev_{n}{r}" for r in EV_TENSOR for n in ("ge", "coh", "stcos", "stsin", "stw")], "ev_sepool",
            *evidence.TURN_MAPS, "ev_q_ink", "ev_q_coh", *evidence.SYMMETRY)


def evidence_row(spark, sf):
    """All 29 raw evidence columns at the centres of the coarse grid."""
    px, boxes = cut_lineage(fx.px(spark, sf)), fx.wide_boxes(spark, sf)
    energy = texture.spectra(px, window=8, stride=4, edges=TEXTURE_EDGES, tile=64).withColumnsRenamed({"gh": "h", "gw": "w", "gy": "y", "gx": "x"})
    turns = evidence.turn_maps(px, boxes, 4, 40, tile=64)
    rows = evidence.evidence_rows(e2e.grid_points(px, boxes), px, boxes, energy, 4.0, turns, 4, EV_INK, EV_TENSOR, 3, 2, 64)
    return rows.select("query", "y", "x", *[F.round(n, 0 if n == "ev_nrang" else 4).alias(n) for n in EV_NAMES])


QUERIES = {f.__name__: f for f in (region_descriptors, correlation_corners, quarter_turns, pooled_texture, pooled_shapes, native_masks, evidence_row)}


# ---- SQL twins --------------------------------------------------------------------------


def _spectrum_sql(p, q, rings):
    """Columns bc, bcrot, bcrad and l1 of two lists laid ring by ring."""
    n = rings * 8
    turned = lambda k: f"list_sum(list_transform(range(1, {n + 1}), lambda i: sqrt({p}[i]) * sqrt({q}[(i - 1) // 8 * 8 + ((i - 1) % 8 - {k} + 8) % 8 + 1])))"
    ring = lambda v: f"list_sum({v}[8 * r + 1:8 * r + 8])"
    return {"bc": turned(0), "bcrot": f"list_max(list_transform(range(0, 8), lambda k: {turned('k')}))",
            "bcrad": f"list_sum(list_transform(range(0, {rings}), lambda r: sqrt({ring(p)}) * sqrt({ring(q)})))",
            "l1": f"list_sum(list_transform(range(1, {n + 1}), lambda i: abs({p}[i] - {q}[i])))"}


def _share(v):
    return f"list_transform({v}, lambda e: e / (list_sum({v}) + 1e-6))"


def _overlap(a, b):
    return f"list_sum(list_transform(range(1, 8), lambda i: sqrt({a}[i] / (list_sum({a}) + 1e-6)) * sqrt({b}[i] / (list_sum({b}) + 1e-6))))"


def _descriptor_sql():
    cols, froms = [], []
    for i, rings in ((0, 8), (1, 4)):
        n = rings * 8
        froms.append(f"s{i} AS (SELECT p.query, label, {_share(f'p.v[1:{n}]')} AS p, {_share(f'q.v[1:{n}]')} AS q, p.v[{n + 1}] - q.v[{n + 1}] AS ed "
                     f"FROM pool p JOIN qv q USING (query) WHERE p.f = 's{i}' AND q.f = 's{i}')")
        cols += [f"round({e}, 5) AS r_s{i}_{k}" for k, e in _spectrum_sql(f"s{i}.p", f"s{i}.q", rings).items()] + [f"round(s{i}.ed, 5) AS r_s{i}_ed"]
    for r in (6, 16):
        froms.append(f"b{r} AS (SELECT p.query, label, p.v AS p, q.v AS q FROM pool p JOIN qv q USING (query) WHERE p.f = 'b{r}' AND q.f = 'b{r}')")
        for kind, part in (("cnt", "1:7"), ("area", "8:14")):
            a, b = f"b{r}.p[{part}]", f"b{r}.q[{part}]"
            cols += [f"round({_overlap(a, b)}, 5) AS r_b{r}_bc{kind}", f"round(ln((list_sum({a}) + 1e-3) / (list_sum({b}) + 1e-3)), 5) AS r_b{r}_l{kind}"]
    for i in (0, 1):
        froms.append(f"""x{i} AS (SELECT query, image, x FROM bc JOIN fam USING (image, gy, gx), LATERAL (SELECT v AS x) WHERE f = 'd{i}'),
  o{i} AS (SELECT x{i}.*, q.v AS raw, list_inner_product(x, {unit_sql('q.v')}) AS self FROM x{i} JOIN qv q USING (query) WHERE q.f = 'd{i}'),
  c{i} AS (SELECT query, quantile_cont(self, 0.34) AS cut, count(*) AS n FROM o{i} GROUP BY query),
  k{i} AS (SELECT query, image, any_value(raw) AS raw, [avg(x[1]) FILTER (n < 3 OR self >= cut), avg(x[2]) FILTER (n < 3 OR self >= cut)] AS rob FROM o{i} JOIN c{i} USING (query) GROUP BY query, image),
  m{i} AS (SELECT image, avg(v[1]) AS a, avg(v[2]) AS b, var_samp(v[1]) AS aa, var_samp(v[2]) AS bb, covar_samp(v[1], v[2]) AS ab FROM fam WHERE f = 'd{i}' GROUP BY image),
  n{i} AS (SELECT image, a, b, aa + 0.05 * (aa + bb) AS aa, bb + 0.05 * (aa + bb) AS bb, ab FROM m{i}),
  w{i} AS (SELECT query, raw, rob, [a, b] AS mu, [(bb * (raw[1] - a) - ab * (raw[2] - b)) / (aa * bb - ab * ab), (aa * (raw[2] - b) - ab * (raw[1] - a)) / (aa * bb - ab * ab)] AS w
    FROM k{i} JOIN n{i} USING (image)),
  d{i} AS (SELECT p.query, label, p.v AS m, raw, rob, mu, w FROM pool p JOIN w{i} USING (query) WHERE p.f = 'd{i}')""")
        m = f"d{i}.m"
        cols += [f"round(list_inner_product({unit_sql(m)}, {unit_sql(f'd{i}.raw')}), 5) AS r_d{i}_cos", f"round(list_inner_product({unit_sql(m)}, {unit_sql(f'd{i}.rob')}), 5) AS r_d{i}_cosrob",
                 f"round((list_inner_product({m}, d{i}.w) - list_inner_product(mu{i}, d{i}.w)) / (list_inner_product(d{i}.raw, d{i}.w) - list_inner_product(mu{i}, d{i}.w) + 1e-6), 5) AS r_d{i}_lda".replace(f"mu{i}", f"d{i}.mu"),
                 f"round(sqrt(list_inner_product({m}, {m})), 5) AS r_d{i}_coh"]
    tone = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in TONE.items())
    gaps = ", ".join(f"abs(any_value(o.{n}) - any_value(b.{n})) AS {n}" for n in TONE)
    meds = ", ".join(f"median({n}) AS {n}" for n in TONE)
    cols += [f"round(tg.{n}, 5) AS r_t_{n}_ad" for n in TONE]
    return f"""{_QLAB}, rowsofimages2 AS (SELECT label AS image, CAST(count(*) OVER (PARTITION BY label) AS INT) AS h, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS y, embedding FROM embeddings),
  grid AS (SELECT image, gh, 8 AS gw, CAST(i // 8 AS INT) AS gy, CAST(i % 8 AS INT) AS gx, vec
    FROM (SELECT image, (h + 7) // 8 AS gh, unnest(range(y, (h + 7) // 8 * 8, h)) AS i, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM rowsofimages2)),
  gs AS (SELECT DISTINCT image, gh, gw FROM grid), {box_cells_sql(8.0, 'gs', 'bc')}, sz AS (SELECT DISTINCT query, h, w FROM qp),
  ce AS (SELECT boxes.query, image, gy, gx, least(CAST(floor((gy + 0.5) * 4) AS INT), sz.h - 1) AS y, least(CAST(floor((gx + 0.5) * 4) AS INT), sz.w - 1) AS x FROM grid JOIN boxes USING (image) JOIN sz ON sz.query = boxes.query),
  cl AS (SELECT ce.query, label, image, gy, gx FROM ce JOIN lab USING (query, y, x)),
  raw AS (SELECT image, gy, gx, vec, list_transform(vec, lambda v: abs(v)) AS r FROM grid),
  cell AS (SELECT image, gy, gx, {_share('r')} AS d, ln(list_sum(r) + 1e-4) AS e, {unit_sql('vec[1:2]')} AS a, {unit_sql('vec[3:4]')} AS b FROM raw),
  fam AS (SELECT image, gy, gx, unnest(['s0', 's1', 'b6', 'b16', 'd0', 'd1']) AS f, unnest([list_append(d, e), list_append(d[1:32], e), d[1:14], d[15:28], a, b]) AS v FROM cell),
  el AS (SELECT image, gy, gx, f, i, v[i] AS x FROM fam, range(1, 66) t(i) WHERE i <= len(v)),
  pool AS (SELECT query, label, f, list(m ORDER BY i) AS v FROM (SELECT query, label, f, i, avg(x) AS m FROM cl JOIN el USING (image, gy, gx) GROUP BY ALL) GROUP BY ALL),
  qv AS (SELECT query, f, list(m ORDER BY i) AS v FROM (SELECT query, f, i, avg(x) AS m FROM bc JOIN el USING (image, gy, gx) GROUP BY ALL) GROUP BY ALL),
  {", ".join(froms)},
  {block_sql('px', {'v': 'gray'}, 'tb')}, tn AS (SELECT image, h AS gh, w AS gw, y AS gy, x AS gx, {tone} FROM (SELECT * REPLACE (v / 255.0::DOUBLE AS v) FROM tb)), ts AS (SELECT DISTINCT image, gh, gw FROM tn),
  {slice_cells_sql(4, 'ts', 'tc')}, tq AS (SELECT query, {meds} FROM tc JOIN tn USING (image, gy, gx) GROUP BY query),
  te AS (SELECT boxes.query, image, gy, gx, least(CAST(floor((gy + 0.5) * 2) AS INT), sz.h - 1) AS y, least(CAST(floor((gx + 0.5) * 2) AS INT), sz.w - 1) AS x FROM tn JOIN boxes USING (image) JOIN sz ON sz.query = boxes.query),
  tl AS (SELECT te.query, label, {meds} FROM te JOIN lab USING (query, y, x) JOIN tn USING (image, gy, gx) GROUP BY te.query, label),
  tg AS (SELECT o.query, o.label, {gaps} FROM tl o JOIN tq b USING (query) GROUP BY o.query, o.label),
  every AS (SELECT DISTINCT query, label FROM pool)
  SELECT query, label, {", ".join(cols)} FROM every {" ".join(f"LEFT JOIN {t} USING (query, label)" for t in ('s0', 's1', 'b6', 'b16', 'd0', 'd1', 'tg'))}"""


def _correlated_sql(boxes, parts, reach=12):
    """Pooled score maps ``pl(query, v, image, h, w, y, x, r)`` of the templates ``parts``, which gives
    (query, image, v, i, j, g, th, tw)."""
    return f"""{_PX}, {boxes}, {parts},
  ts AS (SELECT *, g - avg(g) OVER (PARTITION BY query, v) AS g0, greatest(3, least(th, tw) // 2) // 2 * 2 + 1 AS pool FROM tp),
  pt AS (SELECT query, v, image, h, w, th, tw, pool, p.y - i AS oy, p.x - j AS ox, g0, gray / 255.0::DOUBLE AS f FROM ts JOIN px p USING (image)
    WHERE p.y >= i AND p.x >= j AND p.y - i + th <= h AND p.x - j + tw <= w),
  po AS (SELECT query, v, image, th, tw, pool, oy, ox, sum(g0 * f) AS cross_, sum(f) AS s, sum(f * f) AS ss, sum(g0 * g0) AS gg FROM pt GROUP BY ALL),
  sc AS (SELECT query, v, image, oy + th // 2 AS y, ox + tw // 2 AS x, pool,
      CASE WHEN greatest(ss - s * s / (th * tw), 0) * gg > 1e-18 THEN least(greatest(cross_ / sqrt((ss - s * s / (th * tw)) * gg), -1), 1) ELSE 0 END AS r FROM po),
  fl AS (SELECT q.query, q.v, px.image, px.h, px.w, px.y, px.x, q.pool FROM px JOIN (SELECT DISTINCT query, v, image, pool FROM ts) q USING (image)),
  fu AS (SELECT fl.*, coalesce(r, 0) AS r FROM fl LEFT JOIN sc USING (query, v, image, y, x)),
  pl1 AS (SELECT a.query, a.v, a.image, a.h, a.w, a.y, a.x, a.pool, max(n.r) AS r FROM fu a, range({-reach}, {reach + 1}) t(d) JOIN fu n ON n.query = a.query AND n.v = a.v AND n.y = a.y AND n.x = a.x + d WHERE abs(d) <= a.pool // 2 GROUP BY ALL),
  pl AS (SELECT a.query, a.v, a.image, a.h, a.w, a.y, a.x, max(n.r) AS r FROM pl1 a, range({-reach}, {reach + 1}) t(d) JOIN pl1 n ON n.query = a.query AND n.v = a.v AND n.x = a.x AND n.y = a.y + d WHERE abs(d) <= a.pool // 2 GROUP BY ALL)"""


_WIDE = fx.WIDE_BOXES
_PARTS = """cr AS (SELECT *, x1 - x0 AS bw, y1 - y0 AS bh, greatest(least(CAST(floor(least(y1 - y0, x1 - x0) * 0.6) AS INT), 40), 10) AS side FROM boxes),
  vr AS (SELECT query, image, v, ty, tx, ph, pw FROM (SELECT *, unnest(['c', 'rot90', 'flip', 'tile0', 'tile1', 'tile2', 'tile3']) AS v,
      unnest([y0 + (bh - least(bh, 48)) // 2, y0 + (bh - least(bh, 48)) // 2, y0 + (bh - least(bh, 48)) // 2, y0, y0, y1 - side, y1 - side]) AS ty,
      unnest([x0 + (bw - least(bw, 48)) // 2, x0 + (bw - least(bw, 48)) // 2, x0 + (bw - least(bw, 48)) // 2, x0, x1 - side, x0, x1 - side]) AS tx,
      unnest([least(bh, 48), least(bh, 48), least(bh, 48), side, side, side, side]) AS ph, unnest([least(bw, 48), least(bw, 48), least(bw, 48), side, side, side, side]) AS pw FROM cr)),
  tp AS (SELECT query, vr.image, v, gray / 255.0::DOUBLE AS g, CASE v WHEN 'rot90' THEN pw - 1 - (x - tx) ELSE y - ty END AS i,
     CASE v WHEN 'rot90' THEN y - ty WHEN 'flip' THEN pw - 1 - (x - tx) ELSE x - tx END AS j, CASE v WHEN 'rot90' THEN pw ELSE ph END AS th, CASE v WHEN 'rot90' THEN ph ELSE pw END AS tw,
     ty + ph // 2 AS cy, tx + pw // 2 AS cx FROM vr JOIN px ON px.image = vr.image AND y >= ty AND y < ty + ph AND x >= tx AND x < tx + pw)"""
_BUNDLE = f"""{_correlated_sql(_WIDE, _PARTS)}, ok AS (SELECT query, v, any_value(cy) AS cy, any_value(cx) AS cx FROM ts GROUP BY query, v HAVING stddev_pop(g) >= 3 / 255.0),
  good AS (SELECT query, count(*) FILTER (v LIKE 'tile%') AS tiles FROM ok GROUP BY query HAVING bool_or(v = 'c')),
  lo AS (SELECT query, image, v, (h + 1) // 2 AS h, (w + 1) // 2 AS w, y // 2 AS y, x // 2 AS x, avg(r) AS r FROM pl SEMI JOIN ok USING (query, v) WHERE query IN (SELECT query FROM good) GROUP BY ALL),
  nb AS (SELECT query, image, h, w, y, x, max(r) FILTER (v = 'c') AS ncc_c, max(r) FILTER (v IN ('rot90', 'flip')) AS ncc_rot, max(r) FILTER (v LIKE 'tile%') AS tmax, median(r) FILTER (v LIKE 'tile%') AS tmed FROM lo GROUP BY ALL),
  ns AS (SELECT nb.* , greatest(ncc_c, ncc_rot) AS ncc_best, CASE WHEN tiles >= 2 THEN greatest(tmax, ncc_c) ELSE ncc_c END AS ncc_max, CASE WHEN tiles >= 2 THEN tmed ELSE ncc_c END AS ncc_med FROM nb JOIN good USING (query)),
  sf AS (SELECT a.query, avg(r) AS q_nccself FROM ok a JOIN ok b ON a.query = b.query AND a.v <> b.v AND a.v LIKE 'tile%' AND b.v LIKE 'tile%' JOIN pl ON pl.query = a.query AND pl.v = a.v AND pl.y = b.cy AND pl.x = b.cx GROUP BY a.query)"""

_TURNS = """sq AS (SELECT query, image, least(y1 - y0, x1 - x0, 68) AS s, x0, y0, x1, y1 FROM boxes),
  sr AS (SELECT query, image, s, y0 + (y1 - y0 - s) // 2 AS sy, x0 + (x1 - x0 - s) // 2 AS sx, CAST(floor(s / sqrt(2)) AS INT) AS n, (s - CAST(floor(s / sqrt(2)) AS INT)) // 2 AS o FROM sq),
  tv AS (SELECT sr.*, y - sy AS a, x - sx AS b, gray / 255.0::DOUBLE AS g FROM sr JOIN px ON px.image = sr.image AND y >= sy AND y < sy + s AND x >= sx AND x < sx + s),
  tt AS (SELECT query, image, n, o, g, unnest(['0', '90', '180', '270']) AS v, unnest([a, s - 1 - b, s - 1 - a, b]) AS i, unnest([b, a, s - 1 - b, s - 1 - a]) AS j FROM tv),
  tp AS (SELECT query, image, v, i - o AS i, j - o AS j, g, n AS th, n AS tw FROM tt WHERE i >= o AND i < o + n AND j >= o AND j < o + n)"""

_ANGLES = """sq AS (SELECT query, image, least(y1 - y0, x1 - x0, 68) AS s, x0, y0, x1, y1 FROM boxes),
  sr AS (SELECT query, image, s, y0 + (y1 - y0 - s) // 2 AS sy, x0 + (x1 - x0 - s) // 2 AS sx, CAST(floor(s / sqrt(2)) AS INT) AS n, (s - CAST(floor(s / sqrt(2)) AS INT)) // 2 AS o FROM sq),
  tg AS (SELECT *, i + o - (s - 1) / 2.0::DOUBLE AS yy, j + o - (s - 1) / 2.0::DOUBLE AS xx, radians(deg) AS t
    FROM sr, (SELECT unnest([0, 45, 90, 135, 180, 225, 270, 315]) AS deg), LATERAL (SELECT unnest(range(0, n)) AS i), LATERAL (SELECT unnest(range(0, n)) AS j)),
  tf AS (SELECT *, sin(t) * xx + cos(t) * yy + (s - 1) / 2.0::DOUBLE AS fy, cos(t) * xx - sin(t) * yy + (s - 1) / 2.0::DOUBLE AS fx FROM tg),
  tc AS (SELECT tf.*, (CAST(floor(fy) AS INT) + dy + 2 * s) % (2 * s) AS ky, (CAST(floor(fx) AS INT) + dx + 2 * s) % (2 * s) AS kx,
      CASE dy WHEN 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE dx WHEN 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS wt FROM tf, range(0, 2) a(dy), range(0, 2) b(dx)),
  tp AS (SELECT query, tc.image, CAST(deg AS VARCHAR) AS v, i, j, sum(wt * gray / 255.0::DOUBLE) AS g, n AS th, n AS tw FROM tc
    JOIN px ON px.image = tc.image AND px.y = sy + CASE WHEN ky < s THEN ky ELSE 2 * s - 1 - ky END AND px.x = sx + CASE WHEN kx < s THEN kx ELSE 2 * s - 1 - kx END GROUP BY ALL)"""


def _evidence_sql():
    tensors = ", ".join(box_sql("sb", ["xx", "xy", "yy"], r, f"t{r}") for r in EV_TENSOR)
    inks = ", ".join(box_sql("sb", ["ink"], r, f"i{r}") for r in EV_INK)
    maps = [f"ln(i{r}.ink + 1e-3) AS ink{r}" for r in EV_INK] + ["ln(mx.m + 1e-3) AS inkmx"]
    for r in EV_TENSOR:
        tr, phi = f"(t{r}.xx + t{r}.yy)", f"atan2(2 * t{r}.xy, t{r}.xx - t{r}.yy)"
        coh = f"(sqrt((t{r}.xx - t{r}.yy) ** 2 + 4 * t{r}.xy * t{r}.xy) / ({tr} + 1e-6))"
        maps += [f"ln({tr} + 1e-5) AS ge{r}", f"{coh} AS coh{r}", f"{phi} AS phi{r}"]
    joins = " ".join(f"JOIN {t} ON {t}.image = sb.image AND {t}.y = sb.y AND {t}.x = sb.x" for t in (*[f"i{r}" for r in EV_INK], "mx", *[f"t{r}" for r in EV_TENSOR], "le"))
    own = [f"ink{r} - qink AS ev_ink{r}" for r in EV_INK] + ["inkmx - qink AS ev_inkmx", "top - qe AS ev_sepool"]
    for r in EV_TENSOR:
        own += [f"ge{r} - qge AS ev_ge{r}", f"coh{r} AS ev_coh{r}", f"cos(phi{r} - qphi) AS ev_stcos{r}", f"sin(phi{r} - qphi) AS ev_stsin{r}", f"cos(phi{r} - qphi) * sqrt(coh{r} * qcoh) AS ev_stw{r}"]
    names = [n for n in EV_NAMES if not n.startswith("ev_q_")]
    wide = f"[{', '.join(names)}] AS v"
    bil = ", ".join(f"round(v[{i + 1}], {0 if n == 'ev_nrang' else 4}) AS {n}" for i, n in enumerate(names))
    return f"""{_correlated_sql(_WIDE, _ANGLES)}, {loge_sql('le0')},
  {sobel_sql('px', 'n.gray')}, g AS (SELECT * REPLACE (gx / 255.0 AS gx, gy / 255.0 AS gy) FROM sob),
  bgx AS (SELECT a.image, a.y, a.x, max(n.gray) AS m FROM px a, range(-4, 5) t(d) JOIN px n ON n.image = a.image AND n.y = a.y AND n.x = a.x + d GROUP BY ALL),
  bg AS (SELECT a.image, a.y, a.x, max(n.m) AS m FROM bgx a, range(-4, 5) t(d) JOIN bgx n ON n.image = a.image AND n.x = a.x AND n.y = a.y + d GROUP BY ALL),
  gi AS (SELECT g.*, CAST(m - gray > 40 AS INT) AS ink FROM g JOIN bg USING (image, y, x)),
  {block_sql('gi', {'xx': 'gx * gx', 'xy': 'gx * gy', 'yy': 'gy * gy', 'ink': 'ink'}, 'sb')}, {tensors}, {inks},
  mx AS (SELECT a.image, a.y, a.x, max(n.ink) AS m FROM i{EV_INK[0]} a, range(-3, 4) s(dy), range(-3, 4) t(dx) JOIN i{EV_INK[0]} n ON n.image = a.image AND n.y = a.y + dy AND n.x = a.x + dx GROUP BY ALL),
  le AS (SELECT a.image, a.y, a.x, any_value(a.loge) AS loge, max(n.loge) AS top FROM le0 a, range(-2, 3) s(dy), range(-2, 3) t(dx) JOIN le0 n ON n.image = a.image AND n.y = a.y + dy AND n.x = a.x + dx GROUP BY a.image, a.y, a.x),
  dm AS (SELECT sb.image, sb.h, sb.w, sb.y, sb.x, sb.ink, sb.xx, sb.xy, sb.yy, le.loge, le.top, {", ".join(maps)} FROM sb {joins}),
  gs AS (SELECT DISTINCT image, h AS gh, w AS gw FROM dm), {box_cells_sql(4.0, 'gs', 'bc')},
  q0 AS (SELECT query, avg(ink) AS qi, avg(xx) AS qxx, avg(xy) AS qxy, avg(yy) AS qyy, avg(loge) AS qe FROM bc JOIN dm ON dm.image = bc.image AND dm.y = gy AND dm.x = gx GROUP BY query),
  q1 AS (SELECT query, qi, ln(qi + 1e-3) AS qink, ln(qxx + qyy + 1e-5) AS qge, atan2(2 * qxy, qxx - qyy) AS qphi, sqrt((qxx - qyy) ** 2 + 4 * qxy * qxy) / (qxx + qyy + 1e-6) AS qcoh, qe FROM q0),
  ok AS (SELECT query FROM ts WHERE v = '0' GROUP BY query HAVING stddev_pop(g) >= 3 / 255.0 AND any_value(th) >= 4),
  lo AS (SELECT query, image, v, y // 4 AS y, x // 4 AS x, avg(r) AS r FROM pl SEMI JOIN ok USING (query) GROUP BY ALL),
  tn AS (SELECT query, image, y, x, max(r) FILTER (v = '0') AS ev_nr0, max(r) FILTER (v IN ('90', '270')) AS ev_nr90, max(r) FILTER (v IN ('45', '135', '225', '315')) AS ev_nr45, max(r) FILTER (v = '180') AS ev_nr180,
    CAST(arg_max(least(CAST(v AS INT), 360 - CAST(v AS INT)), (r, -CAST(v AS INT))) AS DOUBLE) AS ev_nrang FROM lo GROUP BY ALL),
  qt AS (SELECT bc.query, avg(ev_nr90) AS ev_q_sym90, avg(ev_nr45) AS ev_q_sym45, avg(ev_nr180) AS ev_q_sym180, avg(ev_nr0) AS ev_q_nr0 FROM bc JOIN tn ON tn.query = bc.query AND tn.y = gy AND tn.x = gx GROUP BY bc.query),
  ev AS (SELECT q1.query, dm.h, dm.w, dm.y, dm.x, {", ".join(own)}, ev_nr0, ev_nr90, ev_nr45, ev_nr180, ev_nr0 - ev_nr90 AS ev_nrgap90, ev_nr0 - ev_nr45 AS ev_nrgap45, ev_nr0 - ev_nr180 AS ev_nrgap180, ev_nrang
    FROM dm JOIN boxes USING (image) JOIN q1 ON q1.query = boxes.query LEFT JOIN tn ON tn.query = q1.query AND tn.y = dm.y AND tn.x = dm.x),
  mp AS (SELECT query, h, w, y, x, {wide} FROM ev),
  pnt AS (SELECT query, y, x, least(greatest((y * 4 + 2 + 0.5) / 4 - 0.5, 0), h - 1) AS fy, least(greatest((x * 4 + 2 + 0.5) / 4 - 0.5, 0), w - 1) AS fx, h, w FROM mp),
  sa AS (SELECT pnt.query, pnt.y, pnt.x, list_transform(range(1, {len(names) + 1}), lambda i: a.v[i] * (1 - (fy - floor(fy))) * (1 - (fx - floor(fx))) + b.v[i] * (1 - (fy - floor(fy))) * (fx - floor(fx))
      + c.v[i] * (fy - floor(fy)) * (1 - (fx - floor(fx))) + d.v[i] * (fy - floor(fy)) * (fx - floor(fx))) AS v
    FROM pnt JOIN mp a ON a.query = pnt.query AND a.y = floor(fy) AND a.x = floor(fx) JOIN mp b ON b.query = pnt.query AND b.y = floor(fy) AND b.x = least(floor(fx) + 1, pnt.w - 1)
    JOIN mp c ON c.query = pnt.query AND c.y = least(floor(fy) + 1, pnt.h - 1) AND c.x = floor(fx) JOIN mp d ON d.query = pnt.query AND d.y = least(floor(fy) + 1, pnt.h - 1) AND d.x = least(floor(fx) + 1, pnt.w - 1))
  SELECT query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {bil}, round(qi, 4) AS ev_q_ink, round(qcoh, 4) AS ev_q_coh, {", ".join(f"round({n}, 4) AS {n}" for n in evidence.SYMMETRY)}
  FROM sa JOIN q1 USING (query) LEFT JOIN qt USING (query)"""


_SHAPES = f"""{_BLOB}, fr AS (SELECT DISTINCT image, (h + 3) // 4 AS h, (w + 3) // 4 AS w, y // 4 AS y, x // 4 AS x FROM px),
  cn AS (SELECT image, least(floor(cy / 4), hh - 1) AS y, floor(cx / 4) AS x, {", ".join(f"count(*) FILTER (shape_class = {i}) AS shape{i}" for i in range(3))}
    FROM cl JOIN (SELECT DISTINCT image, (h + 3) // 4 AS hh FROM px) USING (image) GROUP BY ALL),
  al AS (SELECT fr.image, fr.h, fr.w, fr.y, fr.x, {", ".join(f"coalesce(shape{i}, 0) AS shape{i}" for i in range(3))} FROM fr LEFT JOIN cn USING (image, y, x)),
  {box_sql('al', ['shape0', 'shape1', 'shape2'], 3, 'bx')}, {_WIDE}, gs AS (SELECT DISTINCT image, h AS gh, w AS gw FROM al), {box_cells_sql(4.0, 'gs', 'bc')},
  sh AS (SELECT image, y AS gy, x AS gx, [shape0, shape1, shape2] AS v FROM bx),
  qs AS (SELECT query, bc.image, [avg(v[1]), avg(v[2]), avg(v[3])] AS q FROM bc JOIN sh ON sh.image = bc.image AND sh.gy = bc.gy AND sh.gx = bc.gx GROUP BY ALL)"""

_NATIVE = labelled_sql(f"""{_PROB}, {block_sql('prob', {'p': 'p'}, 'small', 4)}, {fx.BOXES},
  qp AS (SELECT query, s.h, s.w, s.y, s.x, round(p + (query % 4 - 1) / 64.0, 6) AS p FROM small s JOIN boxes USING (image)), {gauss_sql('qp', 'p', 0.8, 'bl', 'query')}""", "bl", "v <= 0.5", "query") + f""",
  g AS (SELECT s.*, label FROM bl s LEFT JOIN lab USING (query, y, x)), c AS (SELECT query, label, NOT {_EDGE} AS hit FROM g WHERE label IS NOT NULL GROUP BY query, label),
  pp AS (SELECT query, h, w, y, x, CASE WHEN hit THEN 0.51::DOUBLE ELSE v END AS p FROM g LEFT JOIN c USING (query, label)),
  nt AS (SELECT DISTINCT query, px.h AS nh, px.w AS nw FROM px JOIN boxes USING (image)),
  pts AS (SELECT query, pp.h AS gh, pp.w AS gw, y * 4 + dy AS py, x * 4 + dx AS px FROM pp JOIN nt USING (query), range(0, 4) a(dy), range(0, 4) b(dx) WHERE y * 4 + dy < nh AND x * 4 + dx < nw),
  {bilinear_sql('pts', 'pp', 4.0, 'query', 'p', 'up')}"""

ORACLE = {
    "region_descriptors": _descriptor_sql(),
    "correlation_corners": f"""{_BUNDLE}, {box_sql('ns', ['ncc_c'], 6, 'cb', 'query')} SELECT query, CAST(ns.y AS INT) AS y, CAST(ns.x AS INT) AS x,
      {", ".join(f"round(ns.{n}, 5) AS {n}" for n in CORNER_MAPS[:5])}, round(cb.ncc_c, 5) AS ncc_cblur, round(q_nccself, 5) AS q_nccself FROM ns JOIN cb USING (query, y, x) LEFT JOIN sf USING (query)""",
    "quarter_turns": f"""{_correlated_sql(_WIDE, _TURNS)}, ok AS (SELECT query FROM ts WHERE v = '0' GROUP BY query HAVING stddev_pop(g) >= 3 / 255.0 AND any_value(th) >= 4),
      lo AS (SELECT query, v, y // 2 AS y, x // 2 AS x, avg(r) AS r FROM pl SEMI JOIN ok USING (query) GROUP BY ALL),
      t AS (SELECT query, CAST(y AS INT) AS y, CAST(x AS INT) AS x, max(r) FILTER (v = '0') AS a, max(r) FILTER (v IN ('90', '270')) AS b, max(r) FILTER (v = '180') AS c FROM lo GROUP BY ALL)
      SELECT query, y, x, round(a, 5) AS ev_nr0, round(b, 5) AS ev_nr90, round(c, 5) AS ev_nr180, round(a - b, 5) AS ev_nrgap90, round(a - c, 5) AS ev_nrgap180 FROM t""",
    "pooled_texture": f"""{_BUNDLE}, na AS (SELECT query, image, (h + 1) // 2 AS h, (w + 1) // 2 AS w, y // 2 AS y, x // 2 AS x, avg(r) AS n FROM pl WHERE v = 'c' AND query IN (SELECT query FROM good) GROUP BY ALL),
      {box_sql('ns', ['ncc_best'], 4, 'b4', 'query')}, {box_sql('ns', ['ncc_best', 'ncc_max'], 9, 'b9', 'query')}, {box_sql('na', ['n'], 6, 'n6', 'query')}
      SELECT query, CAST(b4.y AS INT) AS y, CAST(b4.x AS INT) AS x, round(b4.ncc_best, 5) AS x_ncc_best_b4, round(b9.ncc_best, 5) AS x_ncc_best_b9, round(b9.ncc_max, 5) AS x_ncc_max_b9,
        round(na.n, 5) AS x_ncc1, round(n6.n, 5) AS x_ncc1_b6 FROM b4 JOIN b9 USING (query, y, x) JOIN na USING (query, y, x) JOIN n6 USING (query, y, x)""",
    "evidence_row": _evidence_sql(),
    "pooled_shapes": f"""{_SHAPES} SELECT query, CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx,
      round(list_sum(list_transform([1, 2, 3], lambda i: sqrt(v[i] / (list_sum(v) + 1e-6)) * sqrt(q[i] / (list_sum(q) + 1e-6)))), 5) AS x_sb3_bc,
      round(ln((v[list_position(q, list_max(q))] + 1e-3) / (list_max(q) + 1e-3)), 5) AS x_sb3_ldom, CAST(list_position(q, list_max(q)) - 1 AS DOUBLE) AS x_sb3_qdom FROM sh JOIN qs USING (image)""",
    "native_masks": f"{_NATIVE} SELECT query, CAST(py AS INT) AS y, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_x FROM up WHERE bil > 0.5 GROUP BY query, py",
}
