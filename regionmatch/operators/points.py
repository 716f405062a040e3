"""Joins between boxes, grid cells and sample points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from regionmatch.operators.tiles import TILE, along_columns, along_rows, core, halo_tiles
from regionmatch.session import by_shuffle


def _axis_cells(lo: Column, hi: Column, stride: float, n: Column) -> Column:
    """Cells of one axis whose centres lie in [lo, hi), or all overlapping ones when none does."""
    touched = F.sequence(F.floor(lo / stride).cast("int"), (F.ceil(hi / stride) - 1).cast("int"))
    inside = F.filter(touched, lambda i: ((i + 0.5) * stride >= lo) & ((i + 0.5) * stride < hi))
    chosen = F.when(F.size(inside) > 0, inside).otherwise(touched)
    return F.array_distinct(F.transform(chosen, lambda i: F.greatest(F.least(i, n - 1), F.lit(0))))


def box_cells(boxes: DataFrame, sizes: DataFrame, stride: float, keep: Sequence[str] = ("query", "image")) -> DataFrame:
    """Grid cells of each box: one row per (query, gy, gx).  ``sizes``: image, gh, gw."""
    b = boxes.join(sizes, "image")
    c = F.col
    b = b.withColumn("gy", F.explode(_axis_cells(c("y0"), c("y1"), stride, c("gh"))))
    b = b.withColumn("gx", F.explode(_axis_cells(c("x0"), c("x1"), stride, c("gw"))))
    return b.select(*keep, "gy", "gx")


def slice_cells(boxes: DataFrame, sizes: DataFrame, stride: int, keep: Sequence[str] = ("query", "image"), closed: bool = False) -> DataFrame:
    """Grid cells of each box by whole division of its corners: one row per (query, gy, gx).

    An axis runs from lo // stride to hi // stride, the last cell only when ``closed`` or when it is the
    first as well; cells past the grid are left out. ``sizes``: image, gh, gw.
    """
    c = F.col

    def axis(lo, hi, n):
        first, last = F.floor(c(lo) / stride).cast("int"), F.floor(c(hi) / stride).cast("int")
        last = F.least(last if closed else F.greatest(last - 1, first), c(n) - 1)
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    b = boxes.join(sizes, "image").withColumn("gy", F.explode(axis("y0", "y1", "gh")))
    return b.withColumn("gx", F.explode(axis("x0", "x1", "gw"))).select(*keep, "gy", "gx")


def corner_values(grid: DataFrame, values: Sequence[str], keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Give every cell the values of its right, lower and diagonal neighbours (its own at the edge)."""
    t = halo_tiles(grid, 1, "replicate", tile, keys)
    rows, cols = along_rows(keys), along_columns(keys)
    t = t.withColumns({f"{v}_01": F.lead(v, 1).over(rows) for v in values})
    t = t.withColumns({f"{v}_10": F.lead(v, 1).over(cols) for v in values}
                      | {f"{v}_11": F.lead(f"{v}_01", 1).over(cols) for v in values})
    return core(t, tile)


def bilinear(points: DataFrame, grid: DataFrame, values: Sequence[str], stride: float, keys: Sequence[str],
             py: str = "py", px: str = "px", tile: int = TILE) -> DataFrame:
    """Sample grid maps at native points with half-pixel centres.

    The grid (keys, h, w, y, x, values) first learns its neighbours, so that each point needs a
    single equi join on its upper-left cell and no regrouping.  ``points`` carry the grid size
    as ``gh, gw``.
    """
    c = F.col

    def axis(p, n):
        f = (c(p) + 0.5) / stride - 0.5
        return F.greatest(F.least(f, (c(n) - 1).cast("double")), F.lit(0.0))

    pts = points.withColumns({"_fy": axis(py, "gh"), "_fx": axis(px, "gw")})
    pts = pts.withColumns({"_cy": F.floor("_fy").cast("int"), "_cx": F.floor("_fx").cast("int")})
    quad = corner_values(grid, values, keys, tile)
    quad = quad.select(*keys, c("y").alias("_cy"), c("x").alias("_cx"), *[f for v in values for f in (v, f"{v}_01", f"{v}_10", f"{v}_11")])
    j = by_shuffle(pts).join(quad, [*keys, "_cy", "_cx"])
    wy, wx = c("_fy") - c("_cy"), c("_fx") - c("_cx")
    out = {v: c(v) * (1 - wy) * (1 - wx) + c(f"{v}_01") * (1 - wy) * wx + c(f"{v}_10") * wy * (1 - wx) + c(f"{v}_11") * wy * wx for v in values}
    return j.withColumns(out).drop("_fy", "_fx", "_cy", "_cx", *[f"{v}_{s}" for v in values for s in ("01", "10", "11")])


def nearest_cell(points: DataFrame, stride: float, py: str = "py", px: str = "px") -> DataFrame:
    """Cell whose centre is nearest to each point; halves go to the even cell."""
    c = F.col
    near = lambda p, n: F.greatest(F.least(F.bround((c(p) + 0.5) / stride - 0.5), c(n) - 1), F.lit(0)).cast("int")
    return points.withColumns({"y": near(py, "gh"), "x": near(px, "gw")})


def regrid_labels(cells: DataFrame, labelled: DataFrame, stride: float, base: float, keys: Sequence[str]) -> DataFrame:
    """Label at each coarse cell's centre, read from a labelled grid of stride ``base``.

    ``cells``: keys, gy, gx, lh, lw (size of the labelled grid).
    """
    c = F.col
    at = lambda g, n: F.least(F.floor((c(g) + 0.5) * stride / base), c(n) - 1).cast("int")
    looked = cells.withColumns({"y": at("gy", "lh"), "x": at("gx", "lw")})
    return looked.join(labelled.select(*keys, "y", "x", "label"), [*keys, "y", "x"], "left").drop("y", "x")


def upsample(grid: DataFrame, value: str, factor: int, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """Enlarge a map by a whole factor, bilinear with half-pixel centres."""
    c = F.col
    size = grid.select(*keys, c("h").alias("gh"), c("w").alias("gw"), "y", "x")
    sub = F.sequence(F.lit(0), F.lit(factor - 1))
    pts = size.withColumn("_dy", F.explode(sub)).withColumn("_dx", F.explode(sub))
    pts = pts.select(*keys, "gh", "gw", (c("y") * factor + c("_dy")).alias("py"), (c("x") * factor + c("_dx")).alias("px"))
    out = bilinear(pts, grid, [value], float(factor), keys, tile=tile)
    return out.select(*keys, (c("gh") * factor).alias("h"), (c("gw") * factor).alias("w"), c("py").alias("y"), c("px").alias("x"), value)
