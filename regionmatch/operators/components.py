"""Connected components of raster regions, and the region edits built on them.

Labelling runs in two steps. Each tile is labelled on its own; neighbouring tiles share one row
and one column of cells, so a shared cell that got two labels is an edge between tile
components. Only those edges, far fewer than cells, go through rounds of star contraction.
Every label is the smallest ``y * w + x`` of its component.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from regionmatch.operators.grid import gaussian
from regionmatch.operators.tiles import TILE
from regionmatch.session import by_shuffle, cut_lineage


def _smallest_label(n: int, a, b):
    """Smallest member of each node's group, for nodes 0..n-1 joined by the pairs (a, b)."""
    import numpy as np

    parent = np.arange(n)
    while True:
        ra, rb = parent[a], parent[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        if (lo == hi).all():
            return parent
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _label_tiles(cells: DataFrame, keys: Sequence[str], eight: bool, tile: int) -> DataFrame:
    """Label the cells of each tile; cells on a shared border appear once per tile that sees them."""
    c = F.col
    kinds = dict(cells.dtypes)

    def seen(p, n):
        # A tile also reads the first row (column) of its successor.
        own = F.floor(p / tile).cast("int")
        return F.when((p % tile == 0) & (p > 0), F.array(own - 1, own)).otherwise(F.array(own))

    t = cells.select(*keys, "w", "y", "x", F.explode(seen(c("y"), c("h"))).alias("ty"))
    t = t.withColumn("tx", F.explode(seen(c("x"), c("w"))))

    def kernel(pdf):
        import numpy as np
        import pandas as pd

        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        w = int(pdf["w"].iloc[0])
        y0, x0 = y.min(), x.min()
        index = np.full((y.max() - y0 + 1, x.max() - x0 + 1), -1)
        order = np.lexsort((x, y))
        y, x = y[order], x[order]
        index[y - y0, x - x0] = np.arange(len(y))
        steps = [(index[:, :-1], index[:, 1:]), (index[:-1], index[1:])]
        if eight:
            steps += [(index[:-1, :-1], index[1:, 1:]), (index[:-1, 1:], index[1:, :-1])]
        a = np.concatenate([p.ravel() for p, _ in steps])
        b = np.concatenate([q.ravel() for _, q in steps])
        both = (a >= 0) & (b >= 0)
        root = _smallest_label(len(y), a[both], b[both])
        lin = y.astype(np.int64) * w + x
        out = {k: pdf[k].iloc[0] for k in keys}
        frame = pd.DataFrame({"ty": pdf["ty"].iloc[0], "tx": pdf["tx"].iloc[0], "y": y, "x": x, "label": lin[root]})
        return frame.assign(**out)[[*keys, "ty", "tx", "y", "x", "label"]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ty int, tx int, y int, x int, label bigint"
    return t.groupBy(*keys, "ty", "tx").applyInPandas(kernel, schema)


def _contract(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connect labels to the smallest label they reach (alternating large and small stars).

    ``edges``: keys, a, b with a > b.  Every round joins each edge with one row per node, so a
    node with very many edges is split by the engine's skew handling; the smallest neighbour
    itself is found with map-side combining.
    """
    keys = list(keys)

    def minimum(pairs):
        return pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))

    def large_star(e):
        both = e.select(*keys, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            e.select(*keys, F.col("b").alias("u"), F.col("a").alias("v")))
        low = minimum(both).withColumn("m", F.least("m", "u"))
        return both.filter(F.col("v") > F.col("u")).join(low, [*keys, "u"]).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(e):
        down = e.select(*keys, F.col("a").alias("u"), F.col("b").alias("v"))
        low = minimum(down)
        moved = down.join(low, [*keys, "u"])
        hang = moved.filter(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("a"), F.col("m").alias("b"))
        return hang.unionByName(low.select(*keys, F.col("u").alias("a"), F.col("m").alias("b")))

    mark = None
    while True:
        edges = cut_lineage(small_star(large_star(edges).filter("a <> b").distinct()).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges
        mark = now


def label(cells: DataFrame, eight: bool = False, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Label a set of cells (keys, h, w, y, x): adds ``label``; four-connected unless ``eight``."""
    keys = list(keys)
    local = cut_lineage(_label_tiles(cells, keys, eight, tile))
    shared = ((F.col("y") % tile == 0) & (F.col("y") > 0)) | ((F.col("x") % tile == 0) & (F.col("x") > 0))
    seams = local.filter(shared).groupBy(*keys, "y", "x").agg(
        F.min("label").alias("_lo"), F.collect_set("label").alias("_all")  # at most four tiles see a cell
    )
    edges = cut_lineage(
        seams.select(*keys, F.explode("_all").alias("a"), F.col("_lo").alias("b")).filter("a <> b").distinct()
    )
    own = local.filter((F.floor(F.col("y") / tile) == F.col("ty")) & (F.floor(F.col("x") / tile) == F.col("tx"))).drop("ty", "tx")
    if edges.isEmpty():
        return own
    roots = _contract(edges, keys).select(*keys, F.col("a").alias("label"), F.col("b").alias("_root"))
    return own.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("_root", "label")).drop("_root")


def _whole_tiles(grid: DataFrame, cond: Column, keys: Sequence[str], eight: bool, tile: int) -> DataFrame:
    """All cells of a grid with the tile-local label of those that meet the condition (null elsewhere).

    Each cell goes to its tile once; only labelled cells of a shared border come again, with ``_own`` false, for the
    tile before. Every other column travels along, so nothing is joined back to the grid.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    c = F.col

    def seen(p):
        own = F.floor(c(p) / tile).cast("int")
        return F.when(c("_in") & (c(p) % tile == 0) & (c(p) > 0), F.array(own - 1, own)).otherwise(F.array(own))

    t = grid.withColumn("_in", F.coalesce(cond, F.lit(False)))
    t = t.withColumn("_ty", F.explode(seen("y"))).withColumn("_tx", F.explode(seen("x")))
    schema = StructType([*grid.schema.fields, StructField("label", LongType()), StructField("_own", BooleanType())])
    names, result = grid.columns, to_arrow_schema(schema)

    def kernel(table):
        import numpy as np
        import pyarrow as pa

        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        inside = table.column("_in").to_numpy(zero_copy_only=False)
        y0, x0 = int(y.min()), int(x.min())
        lin = y.astype(np.int64) * table.column("w")[0].as_py() + x
        at = np.flatnonzero(inside)
        at = at[np.argsort(lin[at], kind="stable")]
        index = np.full((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), -1)
        index[y[at] - y0, x[at] - x0] = np.arange(len(at))
        steps = [(index[:, :-1], index[:, 1:]), (index[:-1], index[1:])]
        if eight:
            steps += [(index[:-1, :-1], index[1:, 1:]), (index[:-1, 1:], index[1:, :-1])]
        one, two = (np.concatenate([p[k].ravel() for p in steps]) for k in (0, 1))
        both = (one >= 0) & (two >= 0)
        label = np.zeros(len(y), np.int64)
        if len(at):
            label[at] = lin[at][_smallest_label(len(at), one[both], two[both])]
        own = (y // tile == table.column("_ty")[0].as_py()) & (x // tile == table.column("_tx")[0].as_py())
        columns = [table.column(n) for n in names]
        return pa.table([*columns, pa.array(label, mask=~inside), pa.array(own)], names=[*names, "label", "_own"]).cast(result)

    return t.groupBy(*keys, "_ty", "_tx").applyInArrow(kernel, schema)


def _roots(local: DataFrame, keys: Sequence[str], tile: int) -> DataFrame | None:
    """(keys, label, _root) of the local labels that another tile's labels join to a smaller one; None if there are none."""
    shared = ((F.col("y") % tile == 0) & (F.col("y") > 0)) | ((F.col("x") % tile == 0) & (F.col("x") > 0))
    seams = local.filter(shared & F.col("label").isNotNull()).groupBy(*keys, "y", "x").agg(
        F.min("label").alias("_lo"), F.collect_set("label").alias("_all")  # at most four tiles see a cell
    )
    edges = cut_lineage(seams.select(*keys, F.explode("_all").alias("a"), F.col("_lo").alias("b")).filter("a <> b").distinct())
    return None if edges.isEmpty() else _contract(edges, keys).select(*keys, F.col("a").alias("label"), F.col("b").alias("_root"))


def label_where(grid: DataFrame, cond: Column, eight: bool = False, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Label the cells that meet a condition and attach the label to the whole grid (null elsewhere)."""
    local = cut_lineage(_whole_tiles(grid, cond, list(keys), eight, tile))
    roots, own = _roots(local, list(keys), tile), local.filter("_own").drop("_own")
    if roots is None:
        return own
    return own.join(roots, [*keys, "label"], "left").withColumn("label", F.coalesce("_root", "label")).select(*grid.columns, "label")


def on_border() -> Column:
    c = F.col
    return (c("y") == 0) | (c("x") == 0) | (c("y") == c("h") - 1) | (c("x") == c("w") - 1)


#: Name to the value of one cell and the function that combines cells and parts of components alike.
Attributes = dict[str, tuple[Column, Callable]]


def _selected(grid: DataFrame, cond: Column, attributes: Attributes, pick: Column, tile: int, keys: Sequence[str]) -> DataFrame:
    """The grid with ``_hit``: whether a cell lies in a component that ``pick`` selects by its attributes.

    Attributes are combined per tile-local label, and again where tiles' labels meet, so a component's decision takes
    one pass over the written tiles and none over whole components; only the chosen labels go back to the cells.
    """
    keys = list(keys)
    by = [*keys, "label"]
    local = cut_lineage(_whole_tiles(grid, cond, keys, False, tile))
    parts = local.filter("_own and label is not null").groupBy(*by).agg(*[how(v).alias(n) for n, (v, how) in attributes.items()])
    roots = _roots(local, keys, tile)
    if roots is None:
        chosen = parts.filter(pick).select(*by)
    else:
        parts = cut_lineage(parts.join(roots, by, "left").withColumn("_root", F.coalesce("_root", "label")))
        whole = parts.groupBy(*keys, "_root").agg(*[how(F.col(n)).alias(n) for n, (_, how) in attributes.items()])
        chosen = parts.select(*by, "_root").join(whole.filter(pick).select(*keys, "_root"), [*keys, "_root"]).select(*by)
    return local.filter("_own").join(chosen.withColumn("_hit", F.lit(True)), by, "left").select(*grid.columns, "_hit")


def _edit(grid: DataFrame, cond: Column, attributes: Attributes, pick: Column, change: Column, value: str,
          tile: int, keys: Sequence[str]) -> DataFrame:
    """Change a value on all cells of the components that ``pick`` selects by their attributes."""
    out = _selected(grid, cond, attributes, pick, tile, keys)
    return out.withColumn(value, F.when(F.col("_hit"), change).otherwise(F.col(value))).drop("_hit")


def fill_holes(grid: DataFrame, value: str, t: float, max_area: float | None = None, stride: int = 1,
               include_border: bool = False, keep_higher: bool = True, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Lift enclosed components at or below ``t`` to just above it.

    Components that touch the raster border stay unless ``include_border``; with ``max_area``
    only components of a smaller native area are filled.
    """
    pick = F.lit(True) if include_border else ~F.col("_edge")
    if max_area is not None:
        pick = pick & (F.col("_n") * stride * stride < max_area)
    lifted = F.greatest(F.col(value), F.lit(t + 0.01)) if keep_higher else F.lit(t + 0.01)
    return _edit(grid, F.col(value) <= t, {"_edge": (on_border(), F.bool_or), "_n": (F.lit(1), F.sum)}, pick, lifted, value, tile, keys)


def _keep_components(grid, value, lo, pick, attributes, tile, keys):
    """Lift kept components above one half, push everything else below it."""
    out = _selected(grid, F.col(value) > lo, attributes, pick, tile, keys)
    v = F.col(value)
    return out.withColumn(value, F.when(F.col("_hit"), F.greatest(v, F.lit(0.51))).otherwise(F.least(v, F.lit(0.49)))).drop("_hit")


def hysteresis(grid: DataFrame, value: str, lo: float, hi: float, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Keep the components above ``lo`` that hold a cell above ``hi``."""
    return _keep_components(grid, value, lo, F.col("_m") > hi, {"_m": (F.col(value), F.max)}, tile, keys)


def keep_by_mean(grid: DataFrame, value: str, lo: float, hi: float, tile: int = TILE, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Keep the components above ``lo`` whose mean is above ``hi``."""
    return _keep_components(grid, value, lo, F.col("_s") / F.col("_n") > hi, {"_s": (F.col(value), F.sum), "_n": (F.lit(1), F.sum)}, tile, keys)


def drop_small(grid: DataFrame, value: str, t: float, min_area: Column, stride: int = 1, tile: int = TILE,
               keys: Sequence[str] = ("image",)) -> DataFrame:
    """Push components above ``t`` with a native area under ``min_area`` (an expression over grid columns) below it."""
    marked = grid.withColumn("_min", min_area)
    stats = {"_n": (F.lit(1), F.sum), "_need": (F.col("_min"), F.max)}
    out = _edit(marked, F.col(value) > t, stats, F.col("_n") * stride * stride < F.col("_need"),
                F.least(F.col(value), F.lit(t - 0.01)), value, tile, keys)
    return out.drop("_min")


def post_process(prob: DataFrame, value: str, t: float, sigma: float, tile: int = TILE, keys: Sequence[str] = ("query",)) -> DataFrame:
    """Blur, then fill every enclosed hole of any size."""
    g = gaussian(prob, value, sigma, "_blur", tile, keys)
    g = g.withColumn(value, F.col("_blur")).drop("_blur")
    return fill_holes(g, value, t, keep_higher=False, tile=tile, keys=keys)


# ---- component tables -------------------------------------------------------------------


def component_stats(labelled: DataFrame, value: str, stride: int = 1, keys: Sequence[str] = ("image",)) -> DataFrame:
    """One row per component: area, box, centroid, value statistics, border flag, compactness."""
    c = F.col
    s = labelled.filter("label is not null").groupBy(*keys, "label").agg(
        F.count("*").alias("cells"),
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"),
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.bool_or(on_border()).alias("border"),
    )
    bw, bh = c("x1") - c("x0"), c("y1") - c("y0")
    return s.withColumns({
        "area": c("cells") * stride * stride,
        "compact": c("cells") / (bw * bh).cast("double"),
        "aspect": F.ln(F.greatest(bw, bh) / F.least(bw, bh).cast("double")),
    })


def with_query_context(stats: DataFrame, boxes: DataFrame, stride: int = 1) -> DataFrame:
    """Area against the query box, accepted share, area rank, distance to the query box."""
    from regionmatch.operators.ordering import position

    c = F.col
    totals = stats.groupBy("query").agg(F.sum("area").alias("_all"), F.count("*").alias("components"))
    b = boxes.select("query", ((c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("_qa"),
                     ((c("y0") + c("y1")) / 2).alias("_qy"), ((c("x0") + c("x1")) / 2).alias("_qx"))
    ranked = position(stats, ["query"], [F.desc("area"), c("label")], -F.floor(F.log2(c("area").cast("double")) * 64).cast("long"), "area_rank")
    j = ranked.join(totals, "query").join(b, "query")
    dist = F.hypot(c("cy") * stride - c("_qy"), c("cx") * stride - c("_qx"))
    return j.withColumns({
        "area_rank": c("area_rank") - 1,
        "accepted_share": c("area") / c("_all").cast("double"),
        "log_area_query": F.ln(c("area") / c("_qa").cast("double")),
        "query_distance": F.log1p(dist / F.sqrt(c("_qa").cast("double"))),
    }).drop("_all", "_qa", "_qy", "_qx")


def query_component(labelled: DataFrame, boxes: DataFrame, stride: int = 1) -> DataFrame:
    """The component covering most of each query box (smallest label on ties)."""
    c = F.col
    b = boxes.select("query", *[F.floor((c(n) - e) / stride).alias(n) for n, e in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))])
    rows = b.select("query", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    wanted = rows.select("query", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    hits = labelled.filter("label is not null").join(by_shuffle(wanted), ["query", "y", "x"]).groupBy("query", "label").agg(F.count("*").alias("_n"))
    best = F.max_by(F.struct("label", "_n"), F.struct(c("_n"), -c("label"))).alias("_b")
    return hits.groupBy("query").agg(best).select("query", c("_b.label").alias("label"), c("_b._n").alias("cells"))
