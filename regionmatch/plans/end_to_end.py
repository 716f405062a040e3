"""Whole runs: scoring files, building feature rows, matching regions by example."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from regionmatch.operators import components, contracts, domains, evidence, grid, metrics, models, points, sampling, selection, texture, verify
from regionmatch.operators import similarity as sim
from regionmatch.operators.ordering import exact_quantiles, unit_bucket
from regionmatch.plans import fixtures as fx
from regionmatch.plans.matching import bilinear_sql, unit_sql, vmean, box_cells_sql
from regionmatch.plans.raster import gauss_sql
from regionmatch.plans.regions import _EDGE, _QLAB, _QPROB, _query_labels, _query_prob, labelled_sql
from regionmatch.session import by_shuffle, cut_lineage, join_measured, passing_tables, settled
from regionmatch.sources import manifest as manifests

DOWN = 4


def score_files(spark: SparkSession, manifest_path: str, mask_runs: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Check a manifest, rebuild its reviewed domains and score predicted runs.

    ``mask_runs``: query, kind, y, x0, x1 of label masks; ``predictions``: query, y, x0, x1, with
    a row (possibly y = -1, an empty mask) for every request. Returns per-query and summary rows.
    """
    m = manifests.load_manifest(spark, manifest_path)
    absent = m.select(F.col("id").alias("query")).join(predictions.select("query"), "query", "left_anti")
    contracts.require_clean(absent.withColumn("rule", F.lit("missing_prediction")))
    explicit = manifests.explicit_known(m)
    drawn = predictions.filter("y >= 0").select("query", F.lit("predicted").alias("kind"), "y", "x0", "x1")
    shapes = manifests.label_region_boxes(m).unionByName(domains.run_shapes(mask_runs.unionByName(drawn)))
    flags = domains.with_known(domains.flag_runs(domains.slabs(domains.mark_explicit(shapes, explicit))))
    totals = cut_lineage(domains.domain_totals(flags))
    requests = m.select(F.col("id").alias("query"), "document_id", "kind", "width", "height")
    contracts.require_clean(domains.violations_of(totals, requests))
    counts = domains.confusion_of(totals)
    contracts.require_clean(metrics.count_violations(counts))
    rows = metrics.query_metrics(counts.join(requests.select("query", "document_id", "kind"), "query"))
    rows = rows.join(domains.metadata_of(totals, requests), "query")
    return rows, metrics.summary(rows)


# ---- feature rows -----------------------------------------------------------------------

TONE = ("mean", "std", "ink", "bg", "paper", "paperfrac")
RADII = (4, 12)
AT = ("query", "image", "py", "px")


def _sample(pts: DataFrame, maps: DataFrame, values: Sequence[str], stride: float, keys: Sequence[str]) -> DataFrame:
    """Sample maps (keys, h, w, y, x) at points and keep the point columns."""
    size = maps.select(*keys, F.col("h").alias("gh"), F.col("w").alias("gw")).distinct()
    return points.bilinear(pts.join(size, list(keys)), maps, values, stride, keys).drop("gh", "gw")


def _by_few(rows: DataFrame, values: DataFrame, on: str) -> DataFrame:
    """``rows`` with the written ``values`` of their query or drawing; few of them go to every task, so that the rows stay where they are."""
    return join_measured(rows, values, on, 100_000)


def feature_rows(cells: DataFrame, vector_grids: Sequence[tuple[DataFrame, float]], boxes: DataFrame, pts: DataFrame,
                 spectrum: Sequence[tuple[int, int, int]] = ((1, 64, 16), (2, 64, 16)), blob_radii: Sequence[int] = (6, 16),
                 edges: Sequence[float] = texture.PERIOD_EDGES) -> DataFrame:
    """All classifier columns of points (query, image, py, px).

    Drawing-level maps are made once per drawing, query-level maps once per query; points then meet each map
    family through one join. A family is written as its points and what was sampled for them, its maps go then,
    and a query's own values are one row each. Whole rows are many times the rasters, so they are not written here:
    families meet in one join, and columns that follow from others are worked out after it.
    """
    c, spark = F.col, cells.sparkSession
    flat = lambda df: df.withColumns({"gh": c("h"), "gw": c("w"), "gy": c("y"), "gx": c("x")})
    [where] = settled(spark, lambda: [boxes.select("query", "image", "x0", "y0", "x1", "y1")])
    [pts] = settled(spark, lambda: [pts])
    [place] = settled(spark, lambda: [pts.select(*AT).distinct()])
    with_queries = lambda df: _by_few(df, where.select("query", "image"), "image")
    families, own, names, order = [], [], {}, []

    def family(build: Callable[[], tuple[DataFrame, DataFrame]]) -> None:
        sampled, values = settled(spark, build)
        families.append(sampled)
        own.append(values)

    # Tone and histograms against the box.
    tone_names = [f"{n}{r}" for r in RADII for n in TONE]

    def tones():
        tone = cut_lineage(grid.tone_maps(cells, DOWN, RADII))
        inside = points.slice_cells(where, tone.select("image", c("h").alias("gh"), c("w").alias("gw")).distinct(), DOWN)
        at_box = inside.join(tone.withColumnsRenamed({"y": "gy", "x": "gx"}), ["image", "gy", "gx"])
        long = at_box.unpivot(["query"], tone_names, "name", "v")
        med = exact_quantiles(long, ["query", "name"], "v", [0.5]).select("query", "name", c("quantiles")[0].alias("v"))
        q_tone = med.groupBy("query").pivot("name", tone_names).agg(F.first("v"))
        return _sample(place, tone, tone_names, float(DOWN), ["image"]).select(*AT, *tone_names), q_tone.withColumnsRenamed({n: f"q_{n}" for n in tone_names})

    family(tones)
    order += [*tone_names, *[f"q_{n}" for n in tone_names], *[f"{n}_{k}" for n in tone_names for k in ("d", "ad")]]

    hist_names = [f"{n}{r}" for r in RADII for n in ("ori", "int")]

    def histograms():
        hist = cut_lineage(grid.histogram_maps(cells, DOWN, RADII))
        bins = {f"_{n}_{i}": c(n)[i] for n in hist_names for i in range(grid.BINS)}
        q_hist = cut_lineage(sim.box_mean(flat(hist), where, hist_names, [], float(DOWN), True).drop("image"))
        out = _by_few(_sample(place, hist.withColumns(bins).drop(*hist_names), list(bins), float(DOWN), ["image"]), q_hist, "query")
        for n in hist_names:
            cmp = sim.histogram_compare(F.array(*[c(f"_{n}_{i}") for i in range(grid.BINS)]), c(f"q_{n}"))
            out = out.withColumns({f"{n}_cos": cmp["cos"], f"{n}_l1": cmp["l1"], f"{n}_totd": cmp["total_diff"]})
        totals = [F.aggregate(c(f"q_{n}"), F.lit(0.0), lambda a, v: a + v).alias(f"q_{n}_tot") for n in hist_names]
        return out.select(*AT, *[f"{n}_{k}" for n in hist_names for k in ("cos", "l1", "totd")]), q_hist.select("query", *totals)

    family(histograms)
    order += [m for n in hist_names for m in (f"{n}_cos", f"{n}_l1", f"{n}_totd", f"q_{n}_tot")]

    # Vector similarity on every grid.
    for g, (vectors, stride) in enumerate(vector_grids):
        names[g] = [f"{k}{g}" for k in ("sm", "sr", "tk", "lda", "ldar")]

        def similarities():
            v = cut_lineage(sim.normalized(vectors))
            ex = sim.exemplars(v, where, stride)
            protos = cut_lineage(sim.prototypes(ex))
            stats = cut_lineage(sim.image_statistics(v))
            d, dr = (cut_lineage(sim.whitened_directions(protos, stats, n)) for n in ("raw_mean", "raw_robust"))
            rows = None
            for kind, t, col in (("sm", protos, "proto"), ("sr", protos, "robust"), ("lda", d, "w"), ("ldar", dr, "w")):
                r = t.select("image", "query", F.lit(kind).alias("kind"), c(col).alias("vec"))
                rows = r if rows is None else rows.unionByName(r)
            rows = rows.unionByName(ex.select("image", "query", F.lit("tk").alias("kind"), c("vec").cast("array<double>").alias("vec")))
            best = sim.match_blocks(v, rows)
            take = lambda k: F.max(F.when(c("kind") == k, c("best")[0]))
            top = F.max(F.when(c("kind") == "tk", F.aggregate("best", F.lit(0.0), lambda a, b: a + b) / F.size("best")))
            maps = best.groupBy("query", "gy", "gx").agg(take("sm").alias(f"sm{g}"), take("sr").alias(f"sr{g}"), top.alias(f"tk{g}"),
                                                         take("lda").alias("_l"), take("ldar").alias("_lr"))
            span = d.select("query", c("lo"), c("hi")).join(dr.select("query", c("lo").alias("lor"), c("hi").alias("hir")), "query")
            size = v.select("image", c("gh").alias("h"), c("gw").alias("w")).distinct()
            maps = _by_few(maps, cut_lineage(span.join(where.select("query", "image"), "query").join(size, "image")), "query").withColumns({
                f"lda{g}": (c("_l") - c("lo")) / (c("hi") - c("lo") + 1e-6), f"ldar{g}": (c("_lr") - c("lor")) / (c("hir") - c("lor") + 1e-6)})
            maps = cut_lineage(maps.select("query", "h", "w", c("gy").alias("y"), c("gx").alias("x"), *names[g]))
            out = sim.with_rank(maps, names[g], _sample(place, maps, names[g], stride, ["query"]))
            return (out.select(*AT, *names[g], *[f"{n}_rank" for n in names[g]]),
                    protos.select("query", c("self_mean").alias(f"selfmean{g}"), c("self_min").alias(f"selfmin{g}"), c("n").alias(f"n{g}")))

        family(similarities)
        order += [*names[g], *[f"{n}_rank" for n in names[g]], f"selfmean{g}", f"selfmin{g}", f"n{g}", *[f"{n}_{k}" for k in ("rm", "rmin") for n in names[g]]]

    # Texture: spectra at each scale, blobs, template correlation.
    rings = len(edges) - 1
    logc = [0.5 * (_ln(edges[i]) + _ln(edges[i + 1])) for i in range(rings)]
    for i, (shrink, window, stride) in enumerate(spectrum):
        fields = {n: f"s{i}_{n}" for n in sim.SPECTRUM_FIELDS}

        def waves():
            src = cells if shrink == 1 else grid.block_means(cells, {"gray": c("gray")}, shrink)
            s = cut_lineage(texture.spectra(src, window, stride // shrink, edges))
            q = sim.box_mean(s, where, ["desc"], ["loge"], float(stride)).drop("image")
            q = cut_lineage(q.withColumn("q_desc", F.transform("q_desc", lambda e: e / (F.aggregate("q_desc", F.lit(0.0), lambda a, b: a + b) + 1e-6))))
            m = sim.spectrum_compare(_by_few(with_queries(s), q, "query"), rings, texture.ANGLES, logc, ["query", "gh", "gw", "gy", "gx"])
            m = cut_lineage(m.withColumnsRenamed({"gh": "h", "gw": "w", "gy": "y", "gx": "x", **fields}))
            radial = F.transform(F.sequence(F.lit(0), F.lit(rings - 1)), lambda r: F.aggregate(
                F.slice("q_desc", r * texture.ANGLES + 1, texture.ANGLES), F.lit(0.0), lambda a, b: a + b))
            centroid = F.aggregate(F.zip_with(radial, F.array(*[F.lit(v) for v in logc]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            return (_sample(place, m, list(fields.values()), float(stride), ["query"]).select(*AT, *fields.values()),
                    q.select("query", c("q_loge").alias(f"qs{i}_e"), F.array_max("q_desc").alias(f"qs{i}_peak"), centroid.alias(f"qs{i}_cent")))

        family(waves)
        order += [*fields.values(), f"qs{i}_e", f"qs{i}_peak", f"qs{i}_cent"]

    [blobs] = settled(spark, lambda: [texture.blob_maps(grid.adaptive_ink(cells), DOWN, blob_radii)])
    for r in blob_radii:
        kinds = [f"b{r}_{n}" for n in ("bccnt", "bcarea", "lcnt", "larea", "ldom")]

        def densities():
            b = flat(blobs.select("image", "h", "w", "y", "x", c(f"cnt{r}").alias("cnt"), c(f"area{r}").alias("area")))
            q = cut_lineage(sim.box_mean(b, where, ["cnt", "area"], [], float(DOWN)).drop("image"))
            pairs = sim.blob_compare(_by_few(with_queries(b), q, "query"), prefix=f"b{r}")
            dom = F.array_position(q["q_area"], F.array_max("q_area")) - 1
            return (_sample(place, pairs.select("query", "h", "w", "y", "x", *kinds), kinds, float(DOWN), ["query"]).select(*AT, *kinds),
                    q.select("query", F.ln(F.aggregate("q_cnt", F.lit(0.0), lambda a, v: a + v) + 1e-3).alias(f"qb{r}_lcnt"), dom.cast("double").alias(f"qb{r}_dom")))

        family(densities)
        order += [*kinds, f"qb{r}_lcnt", f"qb{r}_dom"]

    maps_of = ["ncc_c", "ncc_rot", "ncc_best", "ncc_max", "ncc_med", "ncc_cblur"]
    ranked = ["ncc_c", "ncc_best"]

    def templates():
        half, half_boxes = half_size(cells, where)
        ncc, self_scores = texture.correlation_bundle(half, half_boxes, down=DOWN // 2)
        ncc = cut_lineage(ncc.select("query", "h", "w", "y", "x", *maps_of))
        has = ncc.select("query").distinct()
        flat_queries = place.join(has, "query", "left_anti").withColumns({n: F.lit(None).cast("double") for n in maps_of})
        out = _sample(place, ncc, maps_of, float(DOWN), ["query"]).unionByName(flat_queries)
        out = sim.with_rank(ncc, ranked, out)
        contrast = texture.templates(half, half_boxes).filter("variant = 'c'").select("query", c("std").alias("q_tstd"))
        return out.select(*AT, *maps_of, *[f"{n}_rank" for n in ranked]), where.select("query").join(self_scores, "query", "left").join(contrast, "query", "left")

    family(templates)
    order += [*maps_of, *[f"{n}_rank" for n in ranked], "q_nccself", "q_tstd", "qw", "qh"]

    def all_own():
        values = where.select("query", (c("x1") - c("x0")).alias("qw"), (c("y1") - c("y0")).alias("qh"))
        for t in own:
            values = values.join(t, "query")
        return [values]

    [values] = settled(spark, all_own)
    out = pts
    for t in families:
        out = out.join(by_shuffle(t), list(AT))
    out = sim.against_query(_by_few(out, values, "query"), tone_names)
    out = out.withColumns({f"{n}_{k}": c(n) - c(f"{v}{g}") for g in names for n in names[g] for k, v in (("rm", "selfmean"), ("rmin", "selfmin"))})
    return out.select(*pts.columns, *order)


def half_size(cells: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drawings and query boxes at half size; a box keeps at least one pixel."""
    c = F.col
    where = boxes.select("query", "image", *[F.bround(c(n) / 2).cast("int").alias(n) for n in ("x0", "y0")],
                         *[F.greatest(F.bround(c(n) / 2), F.bround(c(m) / 2) + 1).cast("int").alias(n) for n, m in (("x1", "x0"), ("y1", "y0"))])
    return grid.block_means(cells, {"gray": c("gray")}, 2), where


def design_rows(rows: DataFrame, cells: DataFrame, boxes: DataFrame, window: int = 64, stride: int = 16, edges: Sequence[float] = texture.PERIOD_EDGES,
                pts: DataFrame | None = None) -> DataFrame:
    """Feature rows (of ``feature_rows``) with the raw evidence of their points and what is derived from both.

    ``pts``: a table with the points of ``rows``, which are otherwise read from the rows themselves.
    """
    def raw():
        half, half_boxes = half_size(cells, boxes)
        turns = evidence.turn_maps(half, half_boxes, DOWN // 2, texture.ROTATED_SIDE)
        energy = texture.spectra(cells, window, stride, edges).withColumnsRenamed({"gh": "h", "gw": "w", "gy": "y", "gx": "x"})
        return [evidence.evidence_rows((rows if pts is None else pts).select(*AT).distinct(), cells, boxes, energy, float(stride), turns, DOWN)]

    [found] = settled(cells.sparkSession, raw)
    return sim.derived_evidence(rows.join(by_shuffle(found), list(AT)))


def _ln(v: float) -> float:
    import math

    return math.log(v)


def grid_points(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Centres of the 4 px grid of every query's drawing, with the grid size."""
    size = cells.select("image", F.ceil(F.col("h") / DOWN).cast("int").alias("h"), F.ceil(F.col("w") / DOWN).cast("int").alias("w")).distinct()
    p = boxes.select("query", "image").join(size, "image")
    p = p.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))
    return p.withColumns({"py": F.col("y") * DOWN + DOWN // 2, "px": F.col("x") * DOWN + DOWN // 2})


def masks(prob: DataFrame, threshold: float, sigma: float = 14 / DOWN, tile: int = 128, native: DataFrame | None = None) -> DataFrame:
    """Native accepted cells of stored probability grids: blur, fill holes, enlarge, crop, compare.

    ``native``: query, native_h, native_w; cells of the last grid row and column that lie past them go.
    """
    done = components.post_process(prob, "p", threshold, sigma, tile)
    up = points.upsample(done, "p", DOWN, ["query"], tile)
    if native is not None:
        up = up.join(native, "query").filter((F.col("y") < F.col("native_h")) & (F.col("x") < F.col("native_w")))
    return up.filter(F.col("p") > threshold).select("query", "y", "x")


# ---- registered queries -----------------------------------------------------------------


def _vector_grids(spark, sf):
    g = fx.grid_vectors(spark, sf)
    half = g.groupBy("image", F.ceil(F.col("gh") / 2).cast("int").alias("gh"), F.lit(4).alias("gw"),
                     F.floor(F.col("gy") / 2).cast("int").alias("gy"), F.floor(F.col("gx") / 2).cast("int").alias("gx"))
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return [(half.agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("vec")), 16.0), (g, 8.0)]


def _features(spark, sf):
    px = cut_lineage(fx.px(spark, sf))
    b = fx.boxes(spark, sf)
    # The target: the coarse cell is brighter than the drawing's usual tone.
    tone = px.groupBy("image", F.floor(F.col("y") / DOWN).alias("y"), F.floor(F.col("x") / DOWN).alias("x")).agg((F.avg("gray") > 127).alias("pos"))
    pts = grid_points(px, b)
    edges = (1, 2, 2.83, 4, 5.66, 8, 16.01)
    rows = feature_rows(px, _vector_grids(spark, sf), b, pts.join(tone, ["image", "y", "x"]), spectrum=((1, 16, 8), (2, 16, 8)), edges=edges)
    return px, b, design_rows(rows, px, b, 16, 8, edges, pts)


def feature_row_summary(spark, sf):
    """Every classifier column at every grid point: its count of defined values, mean and range."""
    _, _, rows = _features(spark, sf)
    names = [n for n, t in rows.dtypes if t in ("double", "int", "bigint", "float") and n not in ("image", "query", "y", "x", "py", "px", "h", "w")]
    stats = rows.agg(*[F.array(F.count(n).cast("double"), F.avg(n), F.min(n).cast("double"), F.max(n).cast("double")).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("s")) for n in names])
    return stats.select(F.inline(pairs)).select("column", F.col("s")[0].alias("defined"), *[F.round(F.col("s")[i], 4).alias(n) for i, n in ((1, "mean"), (2, "low"), (3, "high"))])


def match_regions(spark, sf):
    """Fit a head on half of the drawings, mask the other half, and report the score per document."""
    px, b, rows = _features(spark, sf)
    names = [n for n, t in rows.dtypes if t in ("double", "int", "bigint") and n not in ("image", "query", "y", "x", "py", "px", "h", "w")]
    with passing_tables(spark):
        half = cut_lineage(rows.filter("image % 2 = 0").select("query", "pos", *names))
        weights = cut_lineage(sampling.inverse_size_weights(half.select("query")).distinct())
        train, columns = models.with_missing_flags(_by_few(half, weights, "query").withColumn("label", F.col("pos").cast("double")), names)
        head = models.boosted_head(columns, rounds=5, depth=4, min_rows=5).fit(train)
    other, columns = models.with_missing_flags(rows.filter("image % 2 = 1"), names)
    [prob] = settled(spark, lambda: [models.score(head, other, ["query", "h", "w", "y", "x"])])
    size = px.select("image", F.col("h").alias("native_h"), F.col("w").alias("native_w")).distinct()
    native = b.select("query", "image").join(size, "image").drop("image")
    hit = masks(prob, 0.5, sigma=0.8, native=native).withColumn("hit", F.lit(True))
    known = px.join(b.select("image", "query", "x0", "y0", "x1", "y1"), "image").filter("image % 2 = 1")
    known = known.filter("not (x >= x0 and x < x1 and y >= y0 and y < y1)")
    d = known.select("query", F.col("image").alias("document_id"), "y", "x", (F.col("gray") > 127).alias("pos"), F.lit(False).alias("blank"))
    counts = metrics.confusion(d.join(hit, ["query", "y", "x"], "left"), F.col("hit"), ["query", "document_id"])
    return metrics.per_document(metrics.query_metrics(counts)).withColumn("document_iou", F.round("document_iou", 4))


def masks_from_probabilities(spark, sf):
    """Accepted native pixels per raster row, from stored probability grids."""
    m = cut_lineage(_query_prob(spark, sf).select("query", "h", "w", "y", "x", "p"))
    a = masks(m, 0.5, 0.8, 64)
    return a.groupBy("query", "y").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"))


def stored_grid_score(spark, sf):
    """Any stored grid scored at the known pixels only."""
    m = _query_prob(spark, sf).select("query", "image", "h", "w", "y", "x", "p")
    px = fx.px(spark, sf)
    known = px.filter(F.col("gray") % 3 != 0).select("image", F.col("y").alias("py"), F.col("x").alias("px"), (F.col("gray") > 132).alias("pos"))
    pts = known.join(m.select("query", "image", F.col("h").alias("gh"), F.col("w").alias("gw")).distinct(), "image")
    at = points.bilinear(pts, m.drop("image"), ["p"], 2.0, ["query"], tile=64).withColumn("p", F.round("p", 9))
    t = (0.4, 0.5, 0.6)
    c = metrics.threshold_counts(at, "p", t, ["query", "image"]).withColumnRenamed("image", "document_id")
    return metrics.threshold_sweep(metrics.threshold_ious(c), t).withColumns({n: F.round(n, 6) for n in ("doc_macro", "query_mean")})


CANDIDATES: Mapping[str, Callable[[DataFrame], DataFrame]] = {
    "none": lambda d: d,
    "blur": lambda d: grid.gaussian(d, "p", 0.8, "_g", 64, ("query",)).withColumn("p", F.col("_g")).drop("_g"),
    "fill": lambda d: components.fill_holes(d, "p", 0.5, 1e6, 2, tile=64, keys=("query",)),
    "small": lambda d: components.drop_small(d, "p", 0.5, F.lit(16.0), 2, 64, ("query",)),
}
CANDIDATES = {**CANDIDATES, "blur+fill": lambda d: d.transform(CANDIDATES["blur"]).transform(CANDIDATES["fill"])}


def post_process_sweep(spark, sf):
    """Each post-processing candidate scored on the same cells; one row per candidate."""
    m = _query_prob(spark, sf).select("query", "image", "h", "w", "y", "x", "p")
    truth = fx.px(spark, sf).groupBy("image", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        (F.avg("gray") > 132).alias("pos"))
    # The truth travels with the cells: a written table of cells looks small enough to be broadcast for a join, and is not.
    m = cut_lineage(m.join(truth, ["image", "y", "x"]).withColumnRenamed("image", "document_id"))
    out = None
    for name, fn in CANDIDATES.items():
        got = fn(m).select("query", "document_id", "pos", F.round("p", 6).alias("p"))
        c = metrics.threshold_counts(got, "p", (0.5,), ["query", "document_id"])
        s = metrics.threshold_sweep(metrics.threshold_ious(c), (0.5,)).select(F.lit(name).alias("candidate"), *[F.round(n, 6).alias(n) for n in ("doc_macro", "query_mean")])
        out = s if out is None else out.unionByName(s)
    return out


def component_quantiles(spark, sf):
    """Quantiles of the probability within each component."""
    lab = _query_labels(spark, sf).filter("label is not null")
    q = exact_quantiles(lab, ["query", "label"], "p", (0.1, 0.5, 0.9), unit_bucket(F.col("_v"), 256))
    return q.select("query", "label", *[F.round(F.col("quantiles")[i], 9).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


def region_similarity(spark, sf):
    """Components pooled first, compared second: cosine of a region's mean vector to the query prototype."""
    lab = cut_lineage(_query_labels(spark, sf))
    g = cut_lineage(sim.normalized(fx.grid_vectors(spark, sf)))
    b = fx.boxes(spark, sf)
    p = sim.prototypes(sim.exemplars(g, b, 8.0)).select("query", "proto")
    size = lab.select("query", F.col("h").alias("lh"), F.col("w").alias("lw")).distinct()
    cells = g.join(b.select("query", "image"), "image").join(size, "query")
    at = points.regrid_labels(cells, lab, 8.0, 2.0, ["query"]).filter("label is not null")
    pooled = sim.mean_of(at, ["query", "label"], "vec", "mean_vec").join(p, "query")
    from regionmatch.functions import vectors as V

    return pooled.select("query", "label", "n", F.round(V.dot(V.unit(F.col("mean_vec")), F.col("proto")), 6).alias("cos"),
                         F.round(V.norm(F.col("mean_vec")), 6).alias("coherence"))


def region_columns(spark, sf):
    """Component means of map columns over all cells, minus the query box mean."""
    lab = cut_lineage(_query_labels(spark, sf).withColumn("p2", F.col("p") * F.col("p")))
    size = lab.select("query", F.col("h").alias("gh"), F.col("w").alias("gw")).distinct()
    b = fx.boxes(spark, sf)
    inside = points.box_cells(b.drop("image").withColumn("image", F.col("query")), size.withColumnRenamed("query", "image"), 2.0, ("query",))
    q = inside.withColumnsRenamed({"gy": "y", "gx": "x"}).join(lab, ["query", "y", "x"]).groupBy("query").agg(
        F.avg("p").alias("q_p"), F.avg("p2").alias("q_p2"))
    m = verify.pooled_columns(lab, ["p", "p2"], q)
    return m.select("query", "label", F.col("cells"), *[F.round(n, 11).alias(n) for n in ("m_p", "dm_p")],
                    *[F.round(n, 5).alias(n) for n in ("m_p2", "dm_p2")])


QUERIES = {f.__name__: f for f in (
    feature_row_summary, match_regions, masks_from_probabilities, stored_grid_score, post_process_sweep, component_quantiles,
    region_similarity, region_columns)}

_MASKS = labelled_sql(f"{_QPROB}, {gauss_sql('qp', 'p', 0.8, 'bl', 'query')}", "bl", "v <= 0.5", "query") + f""",
  g AS (SELECT s.*, label FROM bl s LEFT JOIN lab USING (query, y, x)), c AS (SELECT query, label, NOT {_EDGE} AS hit FROM g WHERE label IS NOT NULL GROUP BY query, label),
  pp AS (SELECT query, h, w, y, x, CASE WHEN hit THEN 0.51::DOUBLE ELSE v END AS p FROM g LEFT JOIN c USING (query, label)),
  pts AS (SELECT query, h AS gh, w AS gw, y * 4 + dy AS py, x * 4 + dx AS px FROM pp, range(0, 4) a(dy), range(0, 4) b(dx)),
  {bilinear_sql('pts', 'pp', 4.0, 'query', 'p', 'up')}"""

_REGION = f"""{_QLAB}, rows_ AS (SELECT label AS image, count(*) OVER (PARTITION BY label) AS h, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
  grid AS (SELECT image, gh, 8 AS gw, CAST(i // 8 AS INT) AS gy, CAST(i % 8 AS INT) AS gx, vec
    FROM (SELECT image, (h + 7) // 8 AS gh, unnest(range(y, (h + 7) // 8 * 8, h)) AS i, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM rows_)),
  gs AS (SELECT DISTINCT image, gh, gw FROM grid), {box_cells_sql(8.0, 'gs', 'bc')},
  u AS (SELECT image, gy, gx, {unit_sql('vec')} AS vec FROM grid), ex AS (SELECT bc.*, vec FROM bc JOIN u USING (image, gy, gx)),
  {vmean('ex', 'vec', 'mv')}, mp AS (SELECT query, image, {unit_sql('v')} AS proto FROM mv),
  sz AS (SELECT DISTINCT query, h, w FROM qp),
  ce AS (SELECT boxes.query, least(CAST(floor((gy + 0.5) * 4) AS INT), h - 1) AS y, least(CAST(floor((gx + 0.5) * 4) AS INT), w - 1) AS x, vec FROM u JOIN boxes USING (image) JOIN sz ON sz.query = boxes.query),
  cl AS (SELECT ce.query, label, vec FROM ce JOIN lab USING (query, y, x)), {vmean('cl', 'vec', 'rm', 'query, label')}"""

ORACLE = {
    "masks_from_probabilities": f"{_MASKS} SELECT query, CAST(py AS INT) AS y, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_x FROM up WHERE bil > 0.5 GROUP BY query, py",
    "stored_grid_score": f"""{_QPROB}, pts AS (SELECT query, image, gh, gw, y AS py, x AS px, gray > 132 AS pos FROM px JOIN (SELECT DISTINCT query, image, s.h AS gh, s.w AS gw FROM small s JOIN boxes USING (image)) USING (image) WHERE gray % 3 <> 0),
      {bilinear_sql('pts', 'qp', 2.0, 'query', 'p', 'b')},
      it AS (SELECT query, image, t, count(*) FILTER (pos AND round(bil, 9) > t) / CAST(count(*) FILTER (pos OR round(bil, 9) > t) AS DOUBLE) AS iou
        FROM b, (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) l(t) GROUP BY ALL HAVING count(*) FILTER (pos) > 0)
      SELECT t AS threshold, round(avg(d), 6) AS doc_macro, round(sum(s) / sum(n), 6) AS query_mean FROM (SELECT t, image, avg(iou) AS d, sum(iou) AS s, count(*) AS n FROM it GROUP BY ALL) GROUP BY t""",
    "component_quantiles": f"{_QLAB} SELECT query, label, " + ", ".join(f"round(quantile_cont(p, {v}), 9) AS {n}" for v, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))) + " FROM qp JOIN lab USING (query, y, x) GROUP BY query, label",
    "region_similarity": f"""{_REGION} SELECT query, label, n, round(list_inner_product({unit_sql('v')}, proto), 6) AS cos, round(sqrt(list_inner_product(v, v)), 6) AS coherence FROM rm JOIN mp USING (query)""",
    "region_columns": f"""{_QLAB}, sz AS (SELECT DISTINCT query AS image, h AS gh, w AS gw FROM qp), bx AS (SELECT query AS image, query, x0, y0, x1, y1 FROM boxes),
      {box_cells_sql(2.0, 'sz', 'bc').replace('FROM boxes', 'FROM bx')},
      qm AS (SELECT bc.query, avg(p) AS q_p, avg(p * p) AS q_p2 FROM bc JOIN qp ON qp.query = bc.query AND qp.y = gy AND qp.x = gx GROUP BY bc.query),
      sm AS (SELECT query, label, p FROM qp JOIN lab USING (query, y, x))
      SELECT query, label, count(*) AS cells, round(avg(p), 11) AS m_p, round(avg(p * p), 5) AS m_p2, round(avg(p) - any_value(q_p), 11) AS dm_p, round(avg(p * p) - any_value(q_p2), 5) AS dm_p2
      FROM sm JOIN qm USING (query) GROUP BY query, label""",
}
