"""Box rules, mask crop and address rules on known cases."""
import numpy as np
from conftest import array_of, cells
from pyspark.sql import functions as F

from regionmatch.operators import contracts, points
from regionmatch.plans.end_to_end import masks


def test_slice_cells_divide_corners(spark):
    boxes = spark.createDataFrame([(0, 0, 3, 5, 6, 13), (1, 0, 8, 8, 8, 9), (2, 0, 18, 2, 30, 4)], "query int, image int, x0 int, y0 int, x1 int, y1 int")
    sizes = spark.createDataFrame([(0, 4, 5)], "image int, gh int, gw int")
    for closed in (False, True):
        got = {}
        for r in points.slice_cells(boxes, sizes, 4, closed=closed).collect():
            got.setdefault(r.query, set()).add((r.gy, r.gx))
        for q, (x0, y0, x1, y1) in {0: (3, 5, 6, 13), 1: (8, 8, 8, 9), 2: (18, 2, 30, 4)}.items():
            a = np.arange(20).reshape(4, 5)
            if closed:
                part = a[y0 // 4:y1 // 4 + 1, x0 // 4:x1 // 4 + 1]
            else:
                part = a[y0 // 4:max(y1 // 4, y0 // 4 + 1), x0 // 4:max(x1 // 4, x0 // 4 + 1)]
            assert got.get(q, set()) == {(int(v) // 5, int(v) % 5) for v in part.ravel()}


def test_masks_are_cropped_to_the_native_size(spark):
    prob = cells(spark, np.full((5, 6), 0.9), name="p").withColumnRenamed("image", "query")
    native = spark.createDataFrame([(0, 17, 23)], "query int, native_h int, native_w int")
    got = masks(prob, 0.5, native=native)
    assert got.count() == 17 * 23 and array_of(got.withColumn("v", F.lit(1)), "v", key="query").shape == (17, 23)


def test_addresses(spark):
    good = ["https://example.org/a", "HTTPS://Example.org:443/a", "https://example.org:65535/"]
    bad = ["http://example.org/", "https://host.INVALID/r", "https://user@example.org/", "https://example.org:65536/", "https://example.org:99999999999/", "https:///x", "REPLACE_ME", None]
    rows = spark.createDataFrame([(u,) for u in good + bad], "u string").select("u", contracts.bad_https(F.col("u")).alias("b")).collect()
    assert [r.b for r in rows] == [False] * len(good) + [True] * len(bad)
