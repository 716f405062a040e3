"""Correlation, slabs, attributed regions, drop rules and descriptors against plain numpy."""
import numpy as np
import pytest
from conftest import array_of, cells
from pyspark.sql import functions as F

from regionmatch.operators import components, descriptors, domains, evidence, grid, metrics, sampling, selection, texture, verify
from regionmatch.operators import similarity as sim


def plain_scores(a, t, pool):
    """Pooled correlation by sliding every window."""
    (h, w), (th, tw) = a.shape, t.shape
    score, t0 = np.zeros((h, w)), t - t.mean()
    for y in range(h - th + 1):
        for x in range(w - tw + 1):
            v = a[y:y + th, x:x + tw]
            v = v - v.mean()
            norm = np.sqrt((v * v).sum() * (t0 * t0).sum())
            score[y + th // 2, x + tw // 2] = (v * t0).sum() / norm if norm > 1e-9 else 0
    r = pool // 2
    padded = np.pad(score, r, constant_values=-np.inf)
    return np.lib.stride_tricks.sliding_window_view(padded, (pool, pool)).max((2, 3))


@pytest.mark.parametrize("tile, down", [(16, 1), (32, 2), (128, 4)])
def test_correlation_equals_sliding_windows(spark, tile, down):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (37, 43))
    a[:12, :20] = 77  # flat windows score zero
    px = cells(spark, a, rng.integers(0, 256, (30, 33)))
    boxes = spark.createDataFrame([(0, 5, 10, 8, 36, 34), (0, 6, 1, 1, 8, 7), (1, 7, 2, 3, 30, 28)], "image int, query int, x0 int, y0 int, x1 int, y1 int")
    shapes = texture.templates(px, boxes)
    got = texture.correlate(px, shapes, 40, tile=tile, down=down, block=2)
    for s in shapes.filter("image = 0").collect():
        full = plain_scores(a / 255.0, np.array(s.t).reshape(s.th, s.tw), s.pool)
        want = np.array([[full[y:y + down, x:x + down].mean() for x in range(0, 43, down)] for y in range(0, 37, down)])
        own = array_of(got.filter((F.col("query") == s["query"]) & (F.col("variant") == s["variant"])), "ncc")
        assert own.shape == want.shape and np.abs(own - want).max() < 1e-9, (s["query"], s["variant"])


def test_self_scores_come_from_the_maps(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (60, 60))
    px = cells(spark, a)
    boxes = spark.createDataFrame([(0, 1, 5, 7, 41, 43)], "image int, query int, x0 int, y0 int, x1 int, y1 int")
    _, own = texture.correlation_bundle(px, boxes, tile=32)
    corners = [s for s in texture.templates(px, boxes).collect() if s["variant"].startswith("tile")]
    maps = [plain_scores(a / 255.0, np.array(s.t).reshape(s.th, s.tw), s.pool) for s in corners]
    want = np.mean([maps[j][corners[i].cy, corners[i].cx] for i in range(4) for j in range(4) if i != j])
    assert len(corners) == 4 and abs(own.first().q_nccself - want) < 1e-9


def test_flat_and_small_turned_templates_are_left_out(spark):
    a = np.full((40, 40), 9)
    a[20:, 20:] = np.random.default_rng(1).integers(0, 256, (20, 20))
    boxes = spark.createDataFrame([(0, 1, 0, 0, 12, 12), (0, 2, 22, 22, 38, 38), (0, 3, 22, 22, 27, 27)], "image int, query int, x0 int, y0 int, x1 int, y1 int")
    kept = texture.usable_turns(texture.rotated_templates(cells(spark, a), boxes))
    assert {r["query"] for r in kept.collect()} == {2} and kept.count() == 8


def test_edge_blocks_are_means_of_the_cells_they_have(spark):
    a = np.arange(7 * 10).reshape(7, 10)
    m = array_of(grid.block_means(cells(spark, a), {"v": F.col("gray")}, 4), "v")
    assert m.shape == (2, 3)
    assert m[1, 2] == a[4:, 8:].mean() and m[0, 2] == a[:4, 8:].mean() and m[1, 0] == a[4:, :4].mean()


def test_slabs_cost_edges_and_not_heights(spark):
    shapes = spark.createDataFrame([("q", "positive", 0, 0, 5, 1000), ("q", "negative", 3, 400, 9, 600), ("q", "blank", 0, 5, 0, 9), ("q", "known", 2, 7, 4, 7)],
                                   "query string, kind string, x0 int, y0 int, x1 int, y1 int")
    cut = domains.slabs(shapes)
    assert sorted((r.kind, r.y, r.rows) for r in cut.collect()) == [("negative", 400, 200), ("positive", 0, 400), ("positive", 400, 200), ("positive", 600, 400)]
    flags = domains.flag_runs(cut)
    assert flags.filter("positive and negative").agg(F.sum(domains.area())).first()[0] == 2 * 200


def test_fractions_of_tall_slabs(spark):
    rng = np.random.default_rng(8)
    want = {k: np.zeros((23, 30), bool) for k in ("positive", "excluded")}
    rows = []
    for k, n in (("positive", 5), ("excluded", 3)):
        for _ in range(n):
            x0, y0 = rng.integers(0, 20), rng.integers(0, 12)
            x1, y1 = x0 + rng.integers(1, 10), y0 + rng.integers(1, 11)
            want[k][y0:y1, x0:x1] = True
            rows.append(("q", False, k, int(x0), int(y0), int(x1), int(y1)))
    flags = domains.with_known(domains.flag_runs(domains.slabs(spark.createDataFrame(rows, "query string, explicit boolean, kind string, x0 int, y0 int, x1 int, y1 int"))))
    scored = want["positive"] & ~want["excluded"]
    got = {(r.gy, r.gx): r.known for r in domains.cell_fractions(flags, 4).collect()}
    padded = np.pad(scored, ((0, 1), (0, 2)))
    assert got == {(i, j): padded[4 * i:4 * i + 4, 4 * j:4 * j + 4].mean() for i in range(6) for j in range(8) if padded[4 * i:4 * i + 4, 4 * j:4 * j + 4].any()}
    assert sorted((r.y, r.x) for r in domains.pixels_of(flags).collect()) == sorted(map(tuple, np.argwhere(scored)))


@pytest.mark.parametrize("tile", [4, 9, 64])
def test_attributes_merge_across_tiles(spark, tile):
    """Maxima, means, areas and border contact of components that wind through many tiles."""
    from test_components import flood

    rng = np.random.default_rng(4)
    v = rng.random((26, 31)).round(3)
    v[3:22, 5] = v[21, 5:28] = v[9:22, 27] = 0.9
    v[6:18, 8:20] = 0.8
    v[8:16, 10:18] = 0.2
    df = cells(spark, v, name="p").withColumn("other", F.lit("kept"))

    def parts(mask):
        lab = flood(mask, False)
        return [lab == k for k in np.unique(lab[lab >= 0])]

    border = np.ones_like(v, bool)
    border[1:-1, 1:-1] = False
    filled, hot, mean, small = v.copy(), np.minimum(v, 0.49), np.minimum(v, 0.49), v.copy()
    for m in parts(v <= 0.5):
        if not (m & border).any() and m.sum() < 90:
            filled[m] = np.maximum(v[m], 0.51)
    for m in parts(v > 0.6):
        if v[m].max() > 0.95:
            hot[m] = np.maximum(v[m], 0.51)
        if v[m].mean() > 0.8:
            mean[m] = np.maximum(v[m], 0.51)
        if m.sum() < 6:
            small[m] = np.minimum(v[m], 0.59)
    for want, got in ((filled, components.fill_holes(df, "p", 0.5, 90, tile=tile)), (hot, components.hysteresis(df, "p", 0.6, 0.95, tile)),
                      (mean, components.keep_by_mean(df, "p", 0.6, 0.8, tile)), (small, components.drop_small(df, "p", 0.6, F.lit(6.0), tile=tile))):
        assert got.columns == df.columns and np.abs(array_of(got, "p") - want).max() < 1e-12


def test_rules_of_both_sides_equal_dropping(spark):
    rng = np.random.default_rng(6)
    comps = [(q, c, int(t), int(rng.integers(0, t + 1)), float(rng.integers(0, 9)), None if rng.random() < 0.1 else float(rng.random())) for q in range(12) for c in range(5) for t in [rng.integers(1, 20)]]
    base = [(q, sum(p for a, _, _, p, _, _ in comps if a == q) + 1, sum(t - p for a, _, t, p, _, _ in comps if a == q), 3) for q in range(12)]
    c = spark.createDataFrame(comps, "query int, comp int, tot int, pos int, f double, g double")
    b = spark.createDataFrame(base, "query int, tp int, fp int, fn int")
    docs = spark.createDataFrame([(q, q // 3) for q in range(12)], "query int, document_id int")
    low, high = (0.1, 0.3, 0.5), (0.5, 0.9)
    got = {(r.document_id, r.feature, r.side, None if r["cut"] is None else round(r["cut"], 9)): r.score for r in verify.rule_scores(c, b, docs, ["f", "g"], low, high).collect()}
    want = {}
    for k, name in ((4, "f"), (5, "g")):
        values = [r[k] for r in comps if r[k] is not None]
        for side, levels in (("low", low), ("high", high)):
            for cut in [*np.unique(np.quantile(values, levels)), None]:
                ious = {}
                for q, tp, fp, fn in base:
                    gone = [r for r in comps if cut is not None and r[0] == q and r[k] is not None and (r[k] < cut if side == "low" else r[k] > cut)]
                    p, n = sum(r[3] for r in gone), sum(r[2] - r[3] for r in gone)
                    ious.setdefault(q // 3, []).append((tp - p) / (tp + fn + fp - n))
                for d, v in ious.items():
                    want[d, name, side, None if cut is None else round(float(cut), 9)] = float(np.mean(v))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    scores = spark.createDataFrame([(d, d % 2, f, s, str(x), v) for (d, f, s, x), v in want.items()], "document_id int, fold int, feature string, side string, candidate string, score double")
    picked = selection.nested_choice(scores, ["feature", "side"])
    assert picked.count() == 8


def test_leaks_are_rows_without_a_fitting_model(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1)], "query int, own_fold int")
    scores = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 0)], "query int, model_fold int")
    assert [(r["query"], r.own_fold, r.seen) for r in sampling.cross_fit_leaks(rows, scores, "query").collect()] == [(2, 1, 2)]


def test_threshold_features_of_few_accepted_cells(spark):
    rows = [(1, v / 20, v < 5) for v in range(20)] + [(2, 0.1, True), (2, 0.9, False)] + [(3, 0.4, False)]
    got = {r["query"]: r for r in metrics.threshold_features(spark.createDataFrame(rows, "query int, p double, box boolean"), "p", F.col("box"), least=3).collect()}
    v = np.arange(20) / 20
    assert abs(got[1].q25 - np.quantile(v[v > 0.5], 0.25)) < 1e-12 and abs(got[1].box_p10 - np.quantile(v[:5], 0.1)) < 1e-12
    assert abs(got[1].log_share_90 - np.log(1 / 20 + 1e-6)) < 1e-12 and abs(got[1].log_area_ratio - np.log(9 / 5 + 1e-3)) < 1e-12
    assert got[2].q50 == 0 and got[3].box_mean is None and got[3].log_area_ratio is None


def test_values_are_clipped_before_they_are_scaled(spark):
    m = spark.createDataFrame([(1, v) for v in (-40.0, -2.0, 0.0, 3.0, 99.0)], "query int, v double")
    got = sorted((r.v, r.v_clip, r.v_rank) for r in sim.value_channels(m, ["v"]).collect())
    assert [g[1] for g in got] == [-2.5, -0.5, 0.0, 0.75, 2.5] and [round(g[2], 6) for g in got] == [0, 0.25, 0.5, 0.75, 1]


def test_pooled_vectors_of_several_grids(spark):
    """Components pooled on grids of two strides, one of which has no cell centre in the small component."""
    lab = [(1, 0, 8, 8, y, x, 10 if x < 4 else (20 if (y, x) == (7, 7) else None)) for y in range(8) for x in range(8)]
    labelled = spark.createDataFrame(lab, "query int, image int, h int, w int, y int, x int, label long")
    fine = spark.createDataFrame([(0, 8, 8, y, x, [float(y), float(x)]) for y in range(8) for x in range(8)], "image int, gh int, gw int, gy int, gx int, vec array<double>")
    coarse = spark.createDataFrame([(0, 2, 2, y, x, [float(10 * y + x)]) for y in range(2) for x in range(2)], "image int, gh int, gw int, gy int, gx int, vec array<double>")
    got = {r.label: (r.a, r.b) for r in descriptors.pooled_vectors(labelled, {"a": (fine, 4.0), "b": (coarse, 16.0)}, 4.0).collect()}
    assert got.keys() == {10, 20} and got[20] == ([7.0, 7.0], None) and np.abs(np.array(got[10][0] + got[10][1]) - [3.5, 1.5, 5.0]).max() < 1e-12


def test_steered_evidence_equals_the_map_against_the_query(spark):
    """Cosine and sine of the angle to the query's direction, sampled, equal sampling the angle's own maps."""
    rng = np.random.default_rng(7)
    px = cells(spark, rng.integers(0, 256, (24, 32)))
    boxes = spark.createDataFrame([(0, 1, 4, 4, 20, 18)], "image int, query int, x0 int, y0 int, x1 int, y1 int")
    pts = spark.createDataFrame([(1, 0, y, x) for y in (0, 5, 11, 23) for x in (1, 17, 31)], "query int, image int, py int, px int")
    energy = texture.spectra(px, window=8, stride=4, edges=(1, 2, 4, 9), tile=64).withColumnsRenamed({"gh": "h", "gw": "w", "gy": "y", "gx": "x"})
    rows = evidence.evidence_rows(pts, px, boxes, energy, 4.0, evidence.turn_maps(px, boxes, 4, 40, tile=64), 4, (2,), (2,), 1, 1, 64).collect()
    t = {(r.y, r.x): r for r in grid.structure_tensor(px, 4, (2,)).collect()}
    ys, xs = [1, 2, 3], [1, 2, 3, 4]  # cells whose centres lie in the box
    xx, xy, yy = (np.mean([t[y, x][n] for y in ys for x in xs]) for n in ("xx", "xy", "yy"))
    qphi, qcoh = np.arctan2(2 * xy, xx - yy), np.sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy + 1e-6)
    for r in rows:
        fy, fx = (min(max((v + 0.5) / 4 - 0.5, 0), n - 1) for v, n in ((r.py, 6), (r.px, 8)))
        y, x = int(fy), int(fx)
        wy, wx = fy - y, fx - x

        def at(f):
            return sum(f(t[min(y + a, 5), min(x + b, 7)]) * (wy if a else 1 - wy) * (wx if b else 1 - wx) for a in (0, 1) for b in (0, 1))

        assert abs(r.ev_stcos2 - at(lambda c: np.cos(c.phi2 - qphi))) < 1e-9 and abs(r.ev_stsin2 - at(lambda c: np.sin(c.phi2 - qphi))) < 1e-9
        assert abs(r.ev_stw2 - at(lambda c: np.cos(c.phi2 - qphi) * np.sqrt(c.coh2 * qcoh))) < 1e-9
        assert abs(r.ev_ge2 - at(lambda c: np.log((c.energy2 + 1e-5) / (xx + yy + 1e-5)))) < 1e-9
