import numpy as np
import pytest
from conftest import array_of, cells
from pyspark.sql import functions as F

from regionmatch.operators import components, verify
from regionmatch.plans.end_to_end import masks


def flood(mask, eight):
    h, w = mask.shape
    out = np.full((h, w), -1)
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for y in range(h):
        for x in range(w):
            if mask[y, x] and out[y, x] < 0:
                todo, out[y, x] = [(y, x)], y * w + x
                while todo:
                    i, j = todo.pop()
                    for a, b in steps:
                        p, q = i + a, j + b
                        if 0 <= p < h and 0 <= q < w and mask[p, q] and out[p, q] < 0:
                            out[p, q] = y * w + x
                            todo.append((p, q))
    return out


def spiral(n):
    a = np.zeros((n, n), int)
    for k in range(0, n // 2, 2):
        a[k, k:n - k] = a[n - 1 - k, k:n - k] = a[k:n - k, k] = a[k:n - k, n - 1 - k] = 1
        a[k + 1, k] = 0
        if k + 2 < n:
            a[k + 2, k + 1] = 1
    return a


@pytest.mark.parametrize("eight", [False, True])
def test_labels_match_a_flood_fill_across_tiles(spark, eight):
    rng = np.random.default_rng(5)
    pics = [(rng.random((29, 37)) < 0.55).astype(int), spiral(24)]
    lab = components.label(cells(spark, *pics).filter("gray = 1").select("image", "h", "w", "y", "x"), eight, tile=5).collect()
    for i, a in enumerate(pics):
        want = flood(a == 1, eight)
        got = np.full(a.shape, -1)
        for r in lab:
            if r["image"] == i:
                got[r["y"], r["x"]] = r["label"]
        np.testing.assert_array_equal(got, want)


def test_large_hole_is_filled_and_the_border_kept(spark):
    p = np.full((50, 50), 0.1)
    p[5:45, 5:45] = 0.9
    p[12:38, 12:38] = 0.1
    prob = cells(spark, p, name="p").withColumnRenamed("image", "query")
    got = masks(prob, 0.5, sigma=0.9, tile=16)
    a = np.zeros((200, 200), bool)
    for r in got.collect():
        a[r["y"], r["x"]] = True
    assert a[60:140, 60:140].all() and not a[:10].any() and not a[:, -10:].any()


@pytest.mark.parametrize("value,expected", [(0.1, 0), (0.8, 8 * 9 * 16)])
def test_uniform_maps(spark, value, expected):
    prob = cells(spark, np.full((8, 9), value), name="p").withColumnRenamed("image", "query")
    assert masks(prob, 0.6).count() == expected


def test_dropping_a_component_changes_counts_exactly(spark):
    base = spark.createDataFrame([(1, 10, 6, 4)], "query int, tp long, fp long, fn long")
    comp = spark.createDataFrame([(1, 1, 5, 1)], "query int, comp int, tot long, pos long")
    g = verify.with_gain(comp, base).first()
    after = verify.drop_and_score(base, comp).first()
    assert (after["tp"], after["fp"], after["fn"]) == (9, 2, 5)
    assert g["gain"] == pytest.approx(9 / 16 - 10 / 20)
