import numpy as np
import pytest
from conftest import array_of, cells

from regionmatch.operators import grid, points
from regionmatch.operators.tiles import core, halo_tiles

RNG = np.random.default_rng(0)
BIG, SMALL = RNG.integers(0, 256, (23, 31)), RNG.integers(0, 256, (5, 7))


def mirrored(a, r):
    return np.pad(a, r, mode="reflect")


def box(a, r, fn, pad):
    return fn(np.lib.stride_tricks.sliding_window_view(pad, (2 * r + 1, 2 * r + 1)).reshape(*a.shape, -1))


@pytest.mark.parametrize("tile", [8, 128])
def test_box_mean_also_when_the_radius_exceeds_the_raster(spark, tile):
    df = grid.box_means(cells(spark, BIG, SMALL), {"m": ("gray", 3), "n": ("gray", 9)}, tile)
    for i, a in enumerate((BIG, SMALL)):
        for c, r in (("m", 3), ("n", 9)):
            np.testing.assert_allclose(array_of(df, c, i), box(a, r, lambda w: w.mean(-1), mirrored(a, r)))


@pytest.mark.parametrize("tile", [8, 128])
def test_dilate_and_median(spark, tile):
    df = grid.dilate(cells(spark, BIG), {"d": ("gray", 2)}, tile)
    np.testing.assert_array_equal(array_of(df, "d"), box(BIG, 2, lambda w: w.max(-1), np.pad(BIG, 2, constant_values=-1)))
    df = grid.median_filter(cells(spark, BIG), "gray", 2, "m", tile)
    np.testing.assert_array_equal(array_of(df, "m"), box(BIG, 2, lambda w: np.median(w, -1), np.pad(BIG, 2, mode="edge")))


def test_gaussian_keeps_a_constant_and_matches_numpy(spark):
    taps = np.array(grid.gaussian_taps(1.3))
    assert len(grid.gaussian_taps(3.5)) == 29 and taps.sum() == pytest.approx(1)
    df = grid.gaussian(cells(spark, BIG), "gray", 1.3, "g", 16)
    r = len(taps) // 2
    p = mirrored(BIG, r)
    rows = np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 1, p)
    np.testing.assert_allclose(array_of(df, "g"), np.apply_along_axis(lambda v: np.convolve(v, taps, "valid"), 0, rows))


def test_gradient(spark):
    df = grid.gradient(cells(spark, BIG), "gray", 8)
    p = mirrored(BIG, 1).astype(int)
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    np.testing.assert_array_equal(array_of(df, "gx"), gx)


def test_guided_filter_spans_tiles(spark):
    p, g = RNG.random((18, 20)), RNG.random((18, 20))
    df = cells(spark, p, name="p").join(cells(spark, g, name="g").select("image", "y", "x", "g"), ["image", "y", "x"])
    got = array_of(grid.guided_filter(df, "p", "g", 2, 0.01, "o", 8), "o")
    m = lambda a: box(a, 2, lambda w: w.mean(-1), mirrored(a, 2))
    a = (m(g * p) - m(g) * m(p)) / (m(g * g) - m(g) ** 2 + 0.01)
    b = m(p) - a * m(g)
    np.testing.assert_allclose(got, np.clip(m(a) * g + m(b), 0, 1), atol=1e-9)


def test_every_cell_comes_back_once(spark):
    df = core(halo_tiles(cells(spark, BIG), 5, "reflect", 8), 8)
    assert df.count() == BIG.size == df.select("y", "x").distinct().count()


def test_tiles_follow_one_exchange(spark):
    df = grid.box_means(cells(spark, BIG), {"m": ("gray", 3), "n": ("gray", 5)}, 8)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_box_cells_fall_back_to_overlap(spark):
    b = spark.createDataFrame([(1, 0, 0, 0, 3, 3), (2, 0, 6, 6, 30, 9)], "query int, image int, x0 int, y0 int, x1 int, y1 int")
    s = spark.createDataFrame([(0, 2, 3)], "image int, gh int, gw int")
    got = sorted((r["query"], r["gy"], r["gx"]) for r in points.box_cells(b, s, 8.0).collect())
    # query 1 holds no centre and keeps the cell it touches; query 2 clips to the grid
    assert got == [(1, 0, 0), (2, 0, 1), (2, 0, 2), (2, 1, 1), (2, 1, 2)]


def test_bilinear_at_grid_points_keeps_the_eighth_mix(spark):
    g = cells(spark, np.array([[0.0, 8.0], [16.0, 24.0]]), name="v").withColumnRenamed("image", "query")
    pts = spark.createDataFrame([(0, 2, 2, 2, 2)], "query int, gh int, gw int, py int, px int")
    assert points.bilinear(pts, g, ["v"], 4.0, ["query"]).first()["v"] == pytest.approx(8 / 8 + 16 / 8)
