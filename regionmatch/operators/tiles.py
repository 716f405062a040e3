"""Halo tiles: the unit of work of every neighbourhood operator.

A raster table ``cells(image, h, w, y, x, ...)`` is cut into square tiles. Each cell is sent to
its own tile and to the neighbours whose halo it lies in, and cells near the raster border also
appear at the mirrored (or repeated) coordinates the border rule asks for. After one shuffle by
(image, ty, tx) every row window, column window and group within a tile is local, so a chain of
passes costs a single exchange, and no task ever holds more than one tile of even the largest
raster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

TILE = 128
HEADER = ("h", "w", "y", "x")


def _copies(c: str, n: str, halo: int, border: str) -> str:
    """SQL array of all coordinates in [-halo, n + halo) that show the value of coordinate ``c``."""
    if border == "none" or halo == 0:
        return f"array({c})"
    if border == "replicate":
        return (
            f"CASE WHEN {n} = 1 THEN sequence({-halo}, {halo}) WHEN {c} = 0 THEN sequence({-halo}, 0) "
            f"WHEN {c} = {n} - 1 THEN sequence({c}, {c} + {halo}) ELSE array({c}) END"
        )
    if border != "reflect":
        raise ValueError(f"unknown border rule {border}")
    period = f"greatest(2 * ({n} - 1), 1)"
    turns = f"(CAST(ceil({halo} / {period}) AS INT) + 1)"
    shown = f"flatten(transform(sequence(-{turns}, {turns}), k -> array({c} + k * {period}, k * {period} - {c})))"
    return (
        f"CASE WHEN {c} > {halo} AND {c} < {n} - 1 - {halo} THEN array({c}) "
        f"WHEN {n} = 1 THEN sequence({-halo}, {halo}) "
        f"ELSE array_distinct(filter({shown}, p -> p >= {-halo} AND p <= {n} - 1 + {halo})) END"
    )


def _places(c: str, n: str, halo: int, border: str, tile: int, at: str) -> str:
    """SQL array of (coordinate, tile index) pairs for one axis."""
    first = f"greatest(CAST(floor((p - {halo}) / {tile}) AS INT), 0)"
    last = f"least(CAST(floor((p + {halo}) / {tile}) AS INT), CAST(floor(({n} - 1) / {tile}) AS INT))"
    pair = f"t -> named_struct('{c}', CAST(p AS INT), '{at}', t)"
    none = f"CAST(array() AS ARRAY<STRUCT<{c}: INT, {at}: INT>>)"
    return (
        f"flatten(transform({_copies(c, n, halo, border)}, p -> "
        f"CASE WHEN {first} <= {last} THEN transform(sequence({first}, {last}), {pair}) ELSE {none} END))"
    )


def halo_tiles(
    cells: DataFrame, halo: int, border: str = "reflect", tile: int = TILE, keys: Sequence[str] = ("image",)
) -> DataFrame:
    """Send cells to tiles; adds ``ty, tx`` and rewrites ``y, x`` to the shown coordinates."""
    out = cells.withColumn("_py", F.expr(f"explode({_places('y', 'h', halo, border, tile, 'ty')})"))
    out = out.withColumn("_px", F.expr(f"explode({_places('x', 'w', halo, border, tile, 'tx')})"))
    rest = [n for n in cells.columns if n not in ("y", "x")]
    out = out.select(*rest, "_py.y", "_px.x", "_py.ty", "_px.tx")
    return out.repartition(*keys, "ty", "tx")


def in_raster() -> Column:
    c = F.col
    return (c("y") >= 0) & (c("y") < c("h")) & (c("x") >= 0) & (c("x") < c("w"))


def core(tiled: DataFrame, tile: int = TILE) -> DataFrame:
    """Keep each raster cell once, in the tile it belongs to."""
    c = F.col
    own = (F.floor(c("y") / tile) == c("ty")) & (F.floor(c("x") / tile) == c("tx"))
    return tiled.filter(in_raster() & own).drop("ty", "tx")


def along_rows(keys: Sequence[str]):
    return W.partitionBy(*keys, "ty", "tx", "y").orderBy("x")


def along_columns(keys: Sequence[str]):
    return W.partitionBy(*keys, "ty", "tx", "x").orderBy("y")


def on_tiles(
    cells: DataFrame,
    halo: int,
    fn: Callable,
    schema: str,
    border: str = "none",
    tile: int = TILE,
    keys: Sequence[str] = ("image",),
) -> DataFrame:
    """Run a numeric kernel on each tile; it sees the tile with its halo as one pandas frame."""
    tiled = halo_tiles(cells, halo, border, tile, keys)
    return tiled.groupBy(*keys, "ty", "tx").applyInPandas(fn, schema)


def pair_blocks(tiled: DataFrame, rows: DataFrame, identity: Sequence[str], block: int, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn(tile frame, block frame)`` to every tile of a drawing and every block of its rows.

    ``tiled`` (image, ty, tx, ...) and ``rows`` (image, ...) meet through their image. Rows are
    numbered within the image and cut into blocks of at most ``block``, so one call sees one
    tile and one block however many tiles or rows the image has.
    """
    from regionmatch.operators.ordering import position

    c = F.col
    keyed = rows.withColumn("_id", F.xxhash64(*identity))
    placed = position(keyed, ["image"], [c("_id"), *[c(n) for n in identity]], F.shiftright(c("_id"), 52), "_at")
    placed = placed.withColumn("block", F.floor((c("_at") - 1) / block).cast("int")).drop("_id", "_at")
    left = tiled.join(placed.select("image", "block").distinct(), "image")
    where = tiled.select("image", "ty", "tx").distinct()
    right = placed.join(where, "image").select(
        *[c(n).alias(f"b_{n}") for n in ("image", "ty", "tx", "block")], *[n for n in rows.columns if n != "image"])
    by = ["image", "ty", "tx", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"b_{n}" for n in by])).applyInPandas(fn, schema)


def packed_tiles(cells: DataFrame, value: str, halo: int, tile: int = TILE) -> DataFrame:
    """One row per tile: image, ty, tx, h, w, the row and column of its first cell, and its cells with the halo as
    an array row by row. Places outside the raster are left out."""
    kind = dict(cells.dtypes)["image"]

    def pack(table):
        import numpy as np
        import pyarrow as pa

        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        top, left = int(y.min()), int(x.min())
        a = np.zeros((int(y.max()) - top + 1, int(x.max()) - left + 1))
        a[y - top, x - left] = table.column(value).to_numpy()
        head = {n: table.column(n).slice(0, 1) for n in ("image", "ty", "tx", "h", "w")}
        return pa.table({**head, "top": pa.array([top], pa.int32()), "left": pa.array([left], pa.int32()), "across": pa.array([a.shape[1]], pa.int32()), "data": pa.array([a.tobytes()], pa.binary())})

    tiled = halo_tiles(cells.select("image", "h", "w", "y", "x", F.col(value).cast("double").alias(value)), halo, "none", tile)
    return tiled.groupBy("image", "ty", "tx").applyInArrow(pack, f"image {kind}, ty int, tx int, h int, w int, top int, left int, across int, data binary")


def pair_packed(tiles: DataFrame, blocks: DataFrame, fn: Callable, schema: str, salts: int = 64) -> DataFrame:
    """Apply ``fn(tile table, rows table)`` to every packed tile of a drawing and every block of its rows.

    ``blocks`` (image, block, ...) hold rows of bounded number. The numbers of tiles and blocks meet first, salted so
    that a drawing with very many tiles is spread; then each tile and each block goes to its pairs. Three joins read
    the tiles, so they are packed once and written.
    """
    from regionmatch.session import cut_lineage

    c = F.col
    tiles = cut_lineage(tiles)
    salt = F.pmod(F.xxhash64("ty", "tx"), F.lit(salts)).cast("int")
    named = blocks.select("image", "block").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = tiles.select("image", "ty", "tx", salt.alias("salt")).join(named, ["image", "salt"]).select("image", "ty", "tx", "block")
    left = tiles.join(pairs.groupBy("image", "ty", "tx").agg(F.collect_set("block").alias("block")), ["image", "ty", "tx"])
    left = left.withColumn("block", F.explode("block"))
    spread = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    where = pairs.withColumn("salt", salt)
    right = spread.join(where, ["image", "block", "salt"]).drop("salt")
    right = right.withColumnsRenamed({n: f"b_{n}" for n in ("image", "ty", "tx", "block")})
    by = ["image", "ty", "tx", "block"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"b_{n}" for n in by])).applyInArrow(fn, schema)
