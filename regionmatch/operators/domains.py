"""Region algebra on horizontal runs.

A region is a set of half-open runs ``[x0, x1)`` on slabs of raster rows. The upper and lower edges of all
shapes of a query cut its raster to slabs, inside which every row looks the same, so a box costs its edges
and not its height; a mask's runs are shapes of one row. All kinds of regions of a query are swept together:
run ends become signed events, and a running sum along each slab gives disjoint runs with one flag per kind.
The shapes of a query go to one task, before they are cut: slabs, events and everything added up per query or
cell of a query are made there without another exchange. Sorts and windows spill, so a query of very many runs
costs time in its task and not memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

KINDS = ("positive", "negative", "blank", "known", "excluded", "predicted")


def mark_explicit(shapes: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Tell boxes or runs whether their query has an explicit known region: it is in ``explicit``, or, without that
    table, one of its own shapes is of the kind known.

    Done on the short tables of shapes, so that the swept runs never have to be joined for it.
    """
    if explicit is None:
        return shapes.withColumn("explicit", F.bool_or(F.col("kind") == "known").over(W.partitionBy("query")))
    names = explicit.select("query").distinct().withColumn("explicit", F.lit(True))
    return shapes.join(names, "query", "left").withColumn("explicit", F.coalesce("explicit", F.lit(False)))


def run_shapes(runs: DataFrame) -> DataFrame:
    """Runs (query, kind, y, x0, x1) as shapes of one row."""
    return runs.withColumns({"y0": F.col("y"), "y1": F.col("y") + 1}).drop("y")


def slabs(shapes: DataFrame) -> DataFrame:
    """Cut shapes (query, kind, x0, y0, x1, y1) at all upper and lower edges of their query: query, kind, y, rows, x0, x1.

    Empty shapes vanish. A query's edges are at most its raster's height in number.
    """
    c = F.col
    solid = shapes.filter((c("x0") < c("x1")) & (c("y0") < c("y1")))
    own = W.partitionBy("query")
    edges = F.sort_array(F.array_union(F.collect_set("y0").over(own), F.collect_set("y1").over(own)))
    head = [n for n in ("query", "explicit", "kind") if n in shapes.columns]
    first = F.array_position("_edges", c("y0")).cast("int")
    n = F.array_position("_edges", c("y1")).cast("int") - first
    cut = F.arrays_zip(F.slice("_edges", first, n).alias("y"), F.slice("_edges", first + 1, n).alias("_end"))
    return solid.withColumn("_edges", edges).select(*head, "x0", "x1", F.inline(cut)).select(*head, "y", (c("_end") - c("y")).alias("rows"), "x0", "x1")


def flag_runs(runs: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """Disjoint maximal runs (query, y, rows, x0, x1) with a boolean column per kind; uncovered stretches are left out.

    The exchange by query of ``slabs`` serves the sum of the events and the sweep.
    """
    head = [n for n in ("query", "explicit", "y", "rows") if n in runs.columns]
    end = lambda x, d: F.struct(F.col(x).alias("x"), F.lit(d).alias("d"))
    ends = runs.select(*head, "kind", F.inline(F.array(end("x0", 1), end("x1", -1))))
    events = ends.groupBy(*head, "x").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("d")).otherwise(0)).alias(f"_{k}") for k in kinds]
    )
    row = W.partitionBy("query", "y").orderBy("x")
    upto = row.rowsBetween(W.unboundedPreceding, 0)
    flags = events.select(*head, "x", F.struct(*[(F.sum(f"_{k}").over(upto) > 0).alias(k) for k in kinds]).alias("_f"))
    turns = flags.withColumn("_before", F.lag("_f").over(row)).filter(~F.col("_f").eqNullSafe(F.col("_before")))
    swept = turns.select(*head, F.col("x").alias("x0"), F.lead("x").over(row).alias("x1"), "_f.*")
    any_kind = F.lit(False)
    for k in kinds:
        any_kind = any_kind | F.col(k)
    return swept.filter(F.col("x1").isNotNull() & any_kind)


def with_known(flags: DataFrame) -> DataFrame:
    """Add ``reviewed``: the explicit known region where a query has one, else every labelled pixel.

    ``scored`` then leaves out the query and context boxes.
    """
    labelled = F.col("positive") | F.col("negative") | F.col("blank")
    reviewed = F.when(F.col("explicit"), F.col("known")).otherwise(labelled)
    return (
        flags.withColumn("reviewed", reviewed)
        .withColumn("scored", F.col("reviewed") & ~F.col("excluded"))
        .withColumn("outside_known", labelled & ~F.col("reviewed"))
        .drop("explicit")
    )


def area() -> Column:
    """Pixels of a swept run."""
    return (F.col("x1") - F.col("x0")) * F.col("rows")


def _pixels(cond):
    return F.sum(F.when(cond, area()).otherwise(0)).cast("long")


def domain_totals(flags: DataFrame) -> DataFrame:
    """One row per query with every pixel total that metadata, violations and confusion counts need.

    The prediction is one more kind of the sweep, so counting it takes no join.
    """
    c = F.col
    known, pos, hit = c("scored"), c("positive"), c("predicted") if "predicted" in flags.columns else F.lit(False)
    return flags.groupBy("query").agg(*[_pixels(cond).alias(name) for name, cond in {
        "reviewed": c("reviewed"), "left_out": c("reviewed") & c("excluded"), "scored": known, "scored_positive": known & pos,
        "overlap": pos & (c("negative") | c("blank")), "outside": c("outside_known"),
        "tp": known & pos & hit, "fp": known & ~pos & hit, "fn": known & pos & ~hit, "tn": known & ~pos & ~hit,
        "blank_fp": known & c("blank") & hit, "blank_pixels": known & c("blank")}.items()])


def metadata_of(totals: DataFrame, requests: DataFrame) -> DataFrame:
    """Pixel totals of each request; requests without any label get zeros."""
    c = F.col
    used = ["reviewed", "left_out", "scored", "scored_positive"]
    size = (c("width") * c("height")).cast("long")
    j = requests.join(totals.select("query", *used), "query", "left").fillna(0, used)
    return j.select(
        "query",
        c("reviewed").alias("original_known_pixels"),
        c("left_out").alias("excluded_known_pixels"),
        (size - c("scored")).alias("unscored_pixels"),
        (size - c("reviewed")).alias("unknown_pixels"),
        ((c("scored_positive") > 0) & (c("scored_positive") == c("scored"))).alias("positive_only"),
    )


def violations_of(totals: DataFrame, requests: DataFrame) -> DataFrame:
    """Overlaps and labels outside the known region (before exclusion), and empty domains (after)."""
    c = F.col
    used = ["overlap", "outside", "scored"]
    j = requests.select("query").join(totals.select("query", *used), "query", "left").fillna(0, used)
    rule = lambda name, n, cond: F.when(cond, F.struct(F.lit(name).alias("rule"), n.alias("pixels")))
    found = F.filter(
        F.array(
            rule("overlapping_labels", c("overlap"), c("overlap") > 0),
            rule("outside_known", c("outside"), c("outside") > 0),
            rule("nothing_scored", c("scored"), c("scored") == 0),
        ),
        lambda r: r.isNotNull(),
    )
    return j.select("query", F.inline(found))


def confusion_of(totals: DataFrame) -> DataFrame:
    return totals.select("query", "tp", "fp", "fn", "tn", "blank_fp", "blank_pixels")


def domain_metadata(flags: DataFrame, requests: DataFrame) -> DataFrame:
    return metadata_of(domain_totals(flags), requests)


def domain_violations(flags: DataFrame, requests: DataFrame) -> DataFrame:
    return violations_of(domain_totals(flags), requests)


def run_confusion(flags: DataFrame) -> DataFrame:
    """Confusion counts straight from the swept runs."""
    return confusion_of(domain_totals(flags))


def pixels_of(flags: DataFrame) -> DataFrame:
    """Sparse pixel form of the scored region, with its flags."""
    rows = flags.filter("scored").withColumn("y", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("rows") - 1)))
    return rows.select(
        "query", "y", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("x"),
        F.col("positive").alias("pos"), F.col("blank"),
    )


def cell_fractions(flags: DataFrame, c: int, kinds: Sequence[str] = ("positive",)) -> DataFrame:
    """Known share, and the share of each kind, of every c x c cell that holds a scored pixel."""
    end = F.col("y") + F.col("rows")
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / c), F.floor((hi - 1) / c)))
    overlap = lambda lo, hi, g: F.least(hi, (F.col(g) + 1) * c) - F.greatest(lo, F.col(g) * c)
    runs = flags.filter("scored").select("query", "y", end.alias("_end"), "x0", "x1", *kinds, span(F.col("y"), end).alias("gy"))
    parts = runs.select("query", "gy", "y", "_end", "x0", "x1", *kinds, span(F.col("x0"), F.col("x1")).alias("gx"))
    n = overlap(F.col("x0"), F.col("x1"), "gx") * overlap(F.col("y"), F.col("_end"), "gy")
    cell = float(c * c)
    return parts.groupBy("query", "gy", "gx").agg(
        (F.sum(n) / cell).alias("known"),
        *[(F.sum(F.when(F.col(k), n).otherwise(0)) / cell).alias(k) for k in kinds],
    )


def majority_pool(fractions: DataFrame) -> DataFrame:
    """Class of each cell by majority of its known pixels."""
    return fractions.withColumn("is_positive", F.col("positive") >= 0.5 * F.col("known"))


def changed_pixels(flags: DataFrame, a: str, b: str) -> DataFrame:
    """Pixels per query on which two swept region kinds differ."""
    return flags.groupBy("query").agg(_pixels(F.col(a) != F.col(b)).alias("changed")).filter("changed > 0")


def runs_from_cells(cells: DataFrame, keys: Sequence[str], y: str = "y", x: str = "x") -> DataFrame:
    """Maximal horizontal runs of a set of cells."""
    row = W.partitionBy(*keys, y).orderBy(x)
    tagged = cells.select(*keys, y, x).withColumn("_g", F.col(x) - F.row_number().over(row))
    return tagged.groupBy(*keys, y, "_g").agg(F.min(x).alias("x0"), (F.max(x) + 1).alias("x1")).drop("_g")


def run_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = 1024) -> DataFrame:
    """Overlap length of two run tables per key.

    Runs are cut at block borders and matched on (keys, block), so a join bucket never holds
    more than one block of one raster row.
    """
    def cut(t, side):
        span = F.sequence(F.floor(F.col("x0") / block), F.floor((F.col("x1") - 1) / block))
        p = t.select(*keys, "x0", "x1", F.explode(span).alias("_k"))
        return p.select(*keys, "_k", F.greatest("x0", F.col("_k") * block).alias(f"{side}0"),
                        F.least("x1", (F.col("_k") + 1) * block).alias(f"{side}1"))

    j = cut(a, "a").join(cut(b, "b"), [*keys, "_k"]).filter((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    return j.groupBy(*keys).agg(F.sum(F.least("a1", "b1") - F.greatest("a0", "b0")).alias("overlap"))
