"""Two-dimensional neighbourhood operators on raster tables.

Inputs are ``cells(image, h, w, y, x, <values>)`` with the raster size on every row. Separable
filters run as two window passes inside halo tiles, with running sums so that the cost of a box
filter does not depend on its radius; several maps and radii share the same two passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionmatch.operators.tiles import (
    TILE, along_columns, along_rows, core, halo_tiles, in_raster, on_tiles,
)

# Gray level below which a pixel is ink, and the contrast of adaptive ink.
INK_LEVEL = 160
INK_CONTRAST = 40
BINS = 8

Boxes = Mapping[str, tuple[str, int]]


def _box_pass(df: DataFrame, specs: Boxes, window) -> DataFrame:
    """Windowed sums of radius r along one axis, from running sums."""
    upto = window.rowsBetween(W.unboundedPreceding, 0)
    inputs = sorted({src for src, _ in specs.values()})
    df = df.withColumns({f"_run_{s}": F.sum(s).over(upto) for s in inputs})
    outs = {
        name: F.lead(f"_run_{src}", r).over(window) - F.coalesce(F.lag(f"_run_{src}", r + 1).over(window), F.lit(0))
        for name, (src, r) in specs.items()
    }
    return df.withColumns(outs).drop(*[f"_run_{s}" for s in inputs])


def tiled_box_means(tiled: DataFrame, specs: Boxes, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Box means inside tiles; valid for cells at least r away from the tile's halo edge."""
    across = {f"_h_{n}": spec for n, spec in specs.items()}
    df = _box_pass(tiled, across, along_rows(keys))
    df = _box_pass(df, {n: (f"_h_{n}", r) for n, (_, r) in specs.items()}, along_columns(keys))
    df = df.withColumns({n: F.col(n) / float((2 * r + 1) ** 2) for n, (_, r) in specs.items()})
    return df.drop(*across)


def box_means(cells: DataFrame, specs: Boxes, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Mean over (2r+1)^2 boxes with mirrored borders, for any number of (column, r) pairs at once."""
    halo = max(r for _, r in specs.values())
    return core(tiled_box_means(halo_tiles(cells, halo, "reflect", tile, keys), specs, keys), tile)


def local_std(cells: DataFrame, column: str, r: int, out: str, tile: int = TILE) -> DataFrame:
    """sqrt of the non-negative part of E[v^2] - E[v]^2 over a box."""
    sq = cells.withColumn("_sq", F.col(column) * F.col(column))
    m = box_means(sq, {"_m": (column, r), "_m2": ("_sq", r)}, tile)
    return m.withColumn(out, F.sqrt(F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_sq", "_m", "_m2")


def tiled_dilate(tiled: DataFrame, specs: Boxes, keys: Sequence[str] = ("image",)) -> DataFrame:
    rows, cols = along_rows(keys), along_columns(keys)
    df = tiled.withColumns({f"_d_{n}": F.max(src).over(rows.rangeBetween(-r, r)) for n, (src, r) in specs.items()})
    df = df.withColumns({n: F.max(f"_d_{n}").over(cols.rangeBetween(-r, r)) for n, (_, r) in specs.items()})
    return df.drop(*[f"_d_{n}" for n in specs])


def dilate(cells: DataFrame, specs: Boxes, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Maximum over (2r+1)^2 boxes; places outside the raster are ignored."""
    halo = max(r for _, r in specs.values())
    return core(tiled_dilate(halo_tiles(cells, halo, "none", tile, keys), specs, keys), tile)


def _tiled_median(tiled: DataFrame, column: str, r: int, out: str, keys) -> DataFrame:
    """Median of a small odd box: neighbour lists of bounded length, sorted in place."""
    df = tiled.withColumn("_near", F.collect_list(column).over(along_rows(keys).rangeBetween(-r, r)))
    df = df.withColumn("_near", F.sort_array(F.flatten(F.collect_list("_near").over(along_columns(keys).rangeBetween(-r, r)))))
    return df.withColumn(out, F.get("_near", F.floor(F.size("_near") / 2).cast("int"))).drop("_near")


def median_filter(cells: DataFrame, column: str, r: int, out: str, tile: int = TILE) -> DataFrame:
    """Median over a (2r+1)^2 box with repeated border values."""
    return core(_tiled_median(halo_tiles(cells, r, "replicate", tile), column, r, out, ("image",)), tile)


def background(cells: DataFrame, column: str, radii: Mapping[str, int], tile: int = TILE) -> DataFrame:
    """Dilated 5x5 median of the map in 256 levels: the tone of the paper around each cell."""
    halo = 2 + max(radii.values())
    levels = cells.withColumn("_lv", F.floor(F.col(column) * 255.0).cast("int"))
    t = _tiled_median(halo_tiles(levels, halo, "replicate", tile), "_lv", 2, "_md", ("image",))
    t = t.withColumn("_md", F.when(in_raster(), F.col("_md")))
    out = core(tiled_dilate(t, {n: ("_md", r) for n, r in radii.items()}), tile)
    return out.withColumns({n: F.col(n) / 255.0 for n in radii}).drop("_lv", "_md")


def gaussian_taps(sigma: float) -> list[float]:
    """Normalized taps out to four sigma."""
    r = (int(round(sigma * 8 + 1)) | 1) // 2
    w = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    s = sum(w)
    return [v / s for v in w]


def _weighted_pass(df: DataFrame, column: str, taps: Sequence[float], window, out: str) -> DataFrame:
    r = len(taps) // 2
    terms = [F.lead(column, d).over(window) * taps[d + r] if d > 0 else
             F.lag(column, -d).over(window) * taps[d + r] if d < 0 else F.col(column) * taps[r] for d in range(-r, r + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return df.withColumn(out, total)


def gaussian(cells: DataFrame, column: str, sigma: float, out: str, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Gaussian blur in cells with mirrored borders, as two weighted passes."""
    taps = gaussian_taps(sigma)
    t = halo_tiles(cells, len(taps) // 2, "reflect", tile, keys)
    t = _weighted_pass(t, column, taps, along_rows(keys), "_g")
    t = _weighted_pass(t, "_g", taps, along_columns(keys), out)
    return core(t.drop("_g") if out != "_g" else t, tile)


def block_means(
    cells: DataFrame, values: Mapping[str, Column], c: int, pad: float | None = None, keys: Sequence[str] = ("image",)
) -> DataFrame:
    """Mean over c x c blocks. An edge block that the raster does not fill is the mean of the cells it has;
    with ``pad`` the raster is first extended by that value."""
    gh, gw = (F.ceil(F.col(n) / c).cast("int") for n in ("h", "w"))
    block = cells.select(
        *keys, gh.alias("h"), gw.alias("w"), F.floor(F.col("y") / c).cast("int").alias("y"),
        F.floor(F.col("x") / c).cast("int").alias("x"), *[v.cast("double").alias(n) for n, v in values.items()],
    )
    n = float(c * c)
    mean = F.avg if pad is None else (lambda v: (F.sum(v) + F.lit(float(pad)) * (F.lit(n) - F.count("*"))) / n)
    return block.groupBy(*keys, "h", "w", "y", "x").agg(*[mean(v).alias(v) for v in values])


def gradient(cells: DataFrame, column: str, tile: int = TILE) -> DataFrame:
    """3x3 Sobel derivatives ``gx, gy`` with mirrored borders."""
    t = halo_tiles(cells, 1, "reflect", tile)
    rows, cols = along_rows(("image",)), along_columns(("image",))
    v = F.col(column)
    before, after = (lambda e, w: F.lag(e, 1).over(w)), (lambda e, w: F.lead(e, 1).over(w))
    t = t.withColumns({"_dx": after(column, rows) - before(column, rows), "_sx": before(column, rows) + 2 * v + after(column, rows)})
    t = t.withColumns({"gx": before("_dx", cols) + 2 * F.col("_dx") + after("_dx", cols),
                       "gy": after("_sx", cols) - before("_sx", cols)})
    return core(t.drop("_dx", "_sx"), tile)


def orientation(gx: Column, gy: Column) -> Column:
    """Undirected edge angle in [0, pi)."""
    return F.pmod(F.atan2(gy, gx), F.lit(math.pi))


def orientation_bin(gx: Column, gy: Column, bins: int = BINS) -> Column:
    return F.least(F.floor(orientation(gx, gy) / math.pi * bins), F.lit(bins - 1)).cast("int")


def adaptive_ink(cells: DataFrame, column: str = "gray", r: int = 4, tile: int = TILE) -> DataFrame:
    """Pixels darker than their neighbourhood's brightest by more than the ink contrast."""
    d = dilate(cells, {"_bg": (column, r)}, tile)
    return d.withColumn("ink", F.col("_bg") - F.col(column) > INK_CONTRAST).drop("_bg")


def tone_maps(cells: DataFrame, down: int = 4, radii: Sequence[int] = (4, 12), tile: int = TILE) -> DataFrame:
    """Mean, deviation, ink share, background, paper tone and paper share maps on the coarse grid."""
    g = F.col("gray") / 255.0
    small = block_means(cells, {"v": g, "ink": (F.col("gray") < INK_LEVEL).cast("int")}, down)
    small = small.withColumn("paper", (F.col("ink") < 0.05).cast("double"))
    small = small.withColumns({"v2": F.col("v") * F.col("v"), "vp": F.col("v") * F.col("paper")})
    specs = {}
    for r in radii:
        specs |= {f"mean{r}": ("v", r), f"_m2{r}": ("v2", r), f"ink{r}": ("ink", r), f"_vp{r}": ("vp", r), f"paperfrac{r}": ("paper", r)}
    m = box_means(small, specs, tile)
    for r in radii:
        m = m.withColumn(f"std{r}", F.sqrt(F.greatest(F.col(f"_m2{r}") - F.col(f"mean{r}") ** 2, F.lit(0.0))))
        m = m.withColumn(f"paper{r}", F.col(f"_vp{r}") / (F.col(f"paperfrac{r}") + 1e-3))
    bg = background(small.select("image", "h", "w", "y", "x", "v"), "v", {f"bg{r}": r for r in radii}, tile)
    names = [f"{n}{r}" for r in radii for n in ("mean", "std", "ink", "paper", "paperfrac")]
    at = ["image", "y", "x"]
    return m.select("image", "h", "w", "y", "x", *names).join(bg.select(*at, *[f"bg{r}" for r in radii]), at)


def histogram_maps(cells: DataFrame, down: int = 4, radii: Sequence[int] = (4, 12), tile: int = TILE) -> DataFrame:
    """Orientation (magnitude weighted) and intensity histograms, box-averaged, as 8-element arrays."""
    # Whole-number derivatives keep the angles on bin edges exact.
    g = gradient(cells, "gray", tile)
    mag = F.sqrt((F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")).cast("double")) / 255.0
    ob = orientation_bin(F.col("gx"), F.col("gy"))
    ib = F.least(F.floor(F.col("gray") / 255.0 * BINS), F.lit(BINS - 1))
    values = {f"_o{i}": F.when(ob == i, mag).otherwise(0.0) for i in range(BINS)}
    values |= {f"_i{i}": (ib == i).cast("int") for i in range(BINS)}
    small = block_means(g, values, down)
    specs = {f"_{k}{i}r{r}": (f"_{k}{i}", r) for r in radii for k in "oi" for i in range(BINS)}
    m = box_means(small, specs, tile)
    arrays = {f"{n}{r}": F.array(*[F.col(f"_{k}{i}r{r}") for i in range(BINS)]) for r in radii for n, k in (("ori", "o"), ("int", "i"))}
    return m.select("image", "h", "w", "y", "x", *[v.alias(n) for n, v in arrays.items()])


def structure_tensor(cells: DataFrame, down: int = 4, radii: Sequence[int] = (4, 12), tile: int = TILE) -> DataFrame:
    """Gradient energy, doubled-angle orientation and coherence at several scales; ``xx, xy, yy`` stay unblurred."""
    g = gradient(cells.withColumn("g", F.col("gray") / 255.0), "g", tile)
    gx, gy = F.col("gx"), F.col("gy")
    small = block_means(g, {"xx": gx * gx, "xy": gx * gy, "yy": gy * gy}, down)
    m = box_means(small, {f"_{n}{r}": (n, r) for r in radii for n in ("xx", "xy", "yy")}, tile)
    for r in radii:
        tr, phi, coh = tensor_parts(F.col(f"_xx{r}"), F.col(f"_xy{r}"), F.col(f"_yy{r}"))
        m = m.withColumns({f"energy{r}": tr, f"phi{r}": phi, f"coh{r}": coh})
    return m.drop(*[f"_{n}{r}" for r in radii for n in ("xx", "xy", "yy")])


def tensor_parts(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column, Column]:
    """Trace, doubled-angle orientation and coherence of a structure tensor."""
    d = xx - yy
    return xx + yy, F.atan2(2 * xy, d), F.sqrt(d * d + 4 * xy * xy) / (xx + yy + 1e-6)


def cell_tone(cells: DataFrame, c: int = 14) -> DataFrame:
    """Mean, deviation, ink share and edge strength per c x c cell; the raster is extended with paper."""
    g = gradient(cells.withColumn("g", F.col("gray") / 255.0), "g")
    v = F.col("g")
    edge = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)
    base = block_means(g, {"mean": v, "_m2": v * v}, c, pad=1.0)
    marks = block_means(g, {"ink": (F.col("gray") < INK_LEVEL).cast("int"), "edge": edge}, c, pad=0.0)
    at = ["image", "h", "w", "y", "x"]
    out = base.join(marks, at)
    return out.withColumn("std", F.sqrt(F.greatest(F.col("_m2") - F.col("mean") ** 2, F.lit(0.0)))).drop("_m2")


def guided_filter(cells: DataFrame, p: str, guide: str, r: int, eps: float, out: str, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Edge-keeping smoothing of ``p`` by a guide map; both rounds of boxes share one shuffle."""
    t = halo_tiles(cells, 2 * r, "reflect", tile, keys)
    t = t.withColumns({"_gp": F.col(guide) * F.col(p), "_gg": F.col(guide) * F.col(guide)})
    t = tiled_box_means(t, {"_mi": (guide, r), "_mp": (p, r), "_mgp": ("_gp", r), "_mgg": ("_gg", r)}, keys)
    t = t.withColumn("_a", (F.col("_mgp") - F.col("_mi") * F.col("_mp")) / (F.col("_mgg") - F.col("_mi") * F.col("_mi") + eps))
    t = t.withColumn("_b", F.col("_mp") - F.col("_a") * F.col("_mi"))
    t = tiled_box_means(t, {"_ma": ("_a", r), "_mb": ("_b", r)}, keys)
    t = t.withColumn(out, F.greatest(F.least(F.col("_ma") * F.col(guide) + F.col("_mb"), F.lit(1.0)), F.lit(0.0)))
    return core(t.drop("_gp", "_gg", "_mi", "_mp", "_mgp", "_mgg", "_a", "_b", "_ma", "_mb"), tile)


def ink_guide(cells: DataFrame, c: int, sigma: float, out: str = "guide") -> DataFrame:
    """Lightly smoothed ink density on a coarse grid that covers the whole raster."""
    d = block_means(cells, {"_ink": (F.col("gray") < INK_LEVEL).cast("int")}, c, pad=0.0)
    return gaussian(d, "_ink", max(sigma, 0.3), out).drop("_ink")


# ---- operators whose size follows the query box -----------------------------------------


def box_scaled_size(area: Column, c: float, lo: float, hi: float) -> Column:
    return F.greatest(F.least(F.sqrt(area) * c, F.lit(float(hi))), F.lit(float(lo)))


def scaled_gaussian(cells: DataFrame, column: str, sigma: str, max_sigma: float, out: str, tile: int = TILE,
                    keys: Sequence[str] = ("query",)) -> DataFrame:
    """Gaussian blur whose sigma is a column, constant per query and at most ``max_sigma``.

    Every value is spread to its neighbours along rows, then along columns; both sums group
    within a tile, so they follow the tile shuffle without another one.
    """
    halo = (int(round(max_sigma * 8 + 1)) | 1) // 2
    t = halo_tiles(cells, halo, "reflect", tile, keys)
    s = F.col(sigma)
    k = F.round(s * 8 + 1).cast("int")
    r = F.floor((k + F.when(k % 2 == 0, 1).otherwise(0)) / 2).cast("int")
    taps = F.transform(F.sequence(-r, r), lambda d: F.struct(d.alias("d"), F.exp(-(d * d) / (2.0 * s * s)).alias("e")))
    head = [*keys, "ty", "tx", "h", "w", sigma]
    t = t.withColumn("_taps", taps)
    t = t.withColumn("_norm", F.aggregate("_taps", F.lit(0.0), lambda acc, p: acc + p["e"]))

    def spread(df, axis, other, value):
        p = df.select(*head, other, "_taps", "_norm", (F.col(axis)).alias("_c"), F.col(value).alias("_v"), F.explode("_taps").alias("_t"))
        p = p.withColumn(axis, F.col("_c") + F.col("_t.d")).groupBy(*head, other, axis).agg(
            F.sum(F.col("_v") * F.col("_t.e") / F.col("_norm")).alias("_s"), F.any_value("_taps").alias("_taps"),
            F.any_value("_norm").alias("_norm"))
        return p

    t = spread(t, "x", "y", column)
    t = spread(t, "y", "x", "_s").withColumnRenamed("_s", out)
    return core(t.drop("_taps", "_norm"), tile)


def scaled_median(cells: DataFrame, column: str, size: str, max_size: int, out: str, tile: int = TILE,
                  keys: Sequence[str] = ("query",)) -> DataFrame:
    """Median over an odd box whose side is a column, constant per query; repeated borders."""
    names = [*keys, "h", "w", "y", "x"]
    kinds = dict(cells.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + f", {out} double"

    def kernel(pdf):
        import numpy as np

        ty, tx, h, w = (int(pdf[n].iloc[0]) for n in ("ty", "tx", "h", "w"))
        k = int(pdf[size].iloc[0])
        r = k // 2
        y0, x0 = ty * tile, tx * tile
        y1, x1 = min(y0 + tile, h), min(x0 + tile, w)
        a = np.empty((y1 - y0 + 2 * r, x1 - x0 + 2 * r))
        iy, ix = pdf["y"].to_numpy() - y0 + r, pdf["x"].to_numpy() - x0 + r
        ok = (iy >= 0) & (iy < a.shape[0]) & (ix >= 0) & (ix < a.shape[1])
        a[iy[ok], ix[ok]] = pdf[column].to_numpy()[ok]
        win = np.lib.stride_tricks.sliding_window_view(a, (k, k)).reshape(-1, k * k)
        med = np.concatenate([np.partition(win[i:i + 512], k * k // 2, axis=1)[:, k * k // 2] for i in range(0, len(win), 512)])
        gy, gx = np.mgrid[y0:y1, x0:x1]
        out_pdf = {n: pdf[n].iloc[0] for n in (*keys, "h", "w")}
        import pandas as pd

        frame = pd.DataFrame({"y": gy.ravel(), "x": gx.ravel(), out: med})
        return frame.assign(**out_pdf)[[*names, out]]

    return on_tiles(cells, max_size // 2, kernel, schema, "replicate", tile, keys)
