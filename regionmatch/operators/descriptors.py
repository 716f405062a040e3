"""Descriptors of regions: maps are pooled over a component first and compared with the query box second."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from regionmatch.functions import vectors as V
from regionmatch.operators import points
from regionmatch.operators import similarity as sim
from regionmatch.operators.ordering import exact_quantiles
from regionmatch.session import by_shuffle, cut_lineage


class Spectrum(NamedTuple):
    """``cells``: image, gh, gw, gy, gx, desc (ring by ring), loge."""

    cells: DataFrame
    stride: float
    rings: int
    angles: int


class Vectors(NamedTuple):
    """``cells``: image, gh, gw, gy, gx, vec (unit length)."""

    cells: DataFrame
    stride: float


def labelled_cells(labelled: DataFrame, sizes: DataFrame, stride: float, base: float) -> DataFrame:
    """(query, label, image, gy, gx): the grid cells whose centres lie in a component.

    ``labelled``: query, image, h, w, y, x, label on the grid of stride ``base``; ``sizes``: image, gh, gw.
    """
    c = F.col
    queries = labelled.select("query", "image", c("h").alias("lh"), c("w").alias("lw")).distinct().join(sizes, "image")
    at = queries.withColumn("gy", F.explode(F.sequence(F.lit(0), c("gh") - 1))).withColumn("gx", F.explode(F.sequence(F.lit(0), c("gw") - 1)))
    inside = labelled.filter("label is not null")
    return points.regrid_labels(by_shuffle(at), inside, stride, base, ["query"]).filter("label is not null").select("query", "label", "image", "gy", "gx")


def pooled_vectors(labelled: DataFrame, families: Mapping[str, tuple[DataFrame, float]], base: float) -> DataFrame:
    """One row per component with the mean vector of every family, null where no cell centre lies in it.

    ``families``: name to (image, gh, gw, gy, gx, vec) and its stride. All families go through one aggregation,
    whose partial sums are merged by (component, family); a vector travels only if its cell lies in a component.
    """
    long, known = None, {}
    for name, (cells, stride) in families.items():
        sizes = cells.select("image", "gh", "gw").distinct()
        places = known.setdefault(stride, cut_lineage(labelled_cells(labelled, sizes, stride, base))) if stride not in known else known[stride]
        rows = by_shuffle(places).join(cells.select("image", "gy", "gx", "vec"), ["image", "gy", "gx"]).select(
            "query", "label", F.lit(name).alias("family"), F.col("vec").cast("array<double>").alias("vec"))
        long = rows if long is None else long.unionByName(rows)
    means = sim.mean_of(long, ["query", "label", "family"], "vec", "mean")
    return means.groupBy("query", "label").agg(*[F.any_value(F.when(F.col("family") == n, F.col("mean")), True).alias(n) for n in families])


def region_descriptors(labelled: DataFrame, boxes: DataFrame, spectra: Sequence[Spectrum], blobs: Mapping[int, tuple[DataFrame, float]],
                       grids: Sequence[Vectors], tone: DataFrame, tone_names: Sequence[str], tone_stride: int = 4, base: float = 4.0) -> DataFrame:
    """One row per component: 5 columns a spectrum, 4 a blob radius, 4 a vector grid, one a tone map.

    ``blobs``: radius to (image, gh, gw, gy, gx, cnt, area) and stride; ``tone``: image, gh, gw, gy, gx and the maps.
    """
    c = F.col
    families = {f"s{i}": (s.cells.withColumn("vec", F.array_append(c("desc").cast("array<double>"), c("loge"))), s.stride) for i, s in enumerate(spectra)}
    families |= {f"b{r}": (cells.withColumn("vec", F.concat("cnt", "area")), stride) for r, (cells, stride) in blobs.items()}
    families |= {f"d{i}": (g.cells, g.stride) for i, g in enumerate(grids)}
    out = cut_lineage(pooled_vectors(labelled, families, base))
    keys = ["query", "label"]
    parts = []
    for i, s in enumerate(spectra):
        n = s.rings * s.angles
        q = sim.box_mean(s.cells, boxes, ["desc"], ["loge"], s.stride).withColumn("q_desc", V.share(c("q_desc"))).drop("image")
        pairs = out.select(*keys, V.share(F.slice(f"s{i}", 1, n)).alias("desc"), F.get(f"s{i}", F.lit(n)).alias("loge")).filter("loge is not null").join(q, "query")
        got = sim.spectrum_compare(pairs, s.rings, s.angles, [0.0] * s.rings, keys)
        parts.append(got.select(*keys, *[c(k).alias(f"r_s{i}_{k}") for k in ("bc", "bcrot", "bcrad", "l1", "ed")]))
    for r, (cells, stride) in blobs.items():
        q = sim.box_mean(cells, boxes, ["cnt", "area"], [], stride).drop("image")
        half = F.floor(F.size(f"b{r}") / 2).cast("int")
        pairs = out.filter(c(f"b{r}").isNotNull()).select(*keys, F.slice(f"b{r}", F.lit(1), half).alias("cnt"), F.slice(f"b{r}", half + 1, half).alias("area")).join(q, "query")
        got = sim.blob_compare(pairs, prefix=f"r_b{r}")
        parts.append(got.select(*keys, *[f"r_b{r}_{k}" for k in ("bccnt", "lcnt", "bcarea", "larea")]))
    for i, g in enumerate(grids):
        protos = cut_lineage(sim.prototypes(sim.exemplars(g.cells, boxes, g.stride)))
        d = sim.whitened_directions(protos, sim.image_statistics(g.cells), "raw_mean").select("query", "w", "lo", "hi")
        pairs = out.filter(c(f"d{i}").isNotNull()).select(*keys, c(f"d{i}").alias("m")).join(protos.select("query", "proto", "robust"), "query").join(d, "query")
        unit = V.unit(c("m"))
        parts.append(pairs.select(*keys, V.dot(unit, c("proto")).alias(f"r_d{i}_cos"), V.dot(unit, c("robust")).alias(f"r_d{i}_cosrob"),
                                  ((V.dot(c("m"), c("w")) - c("lo")) / (c("hi") - c("lo") + 1e-6)).alias(f"r_d{i}_lda"), V.norm(c("m")).alias(f"r_d{i}_coh")))
    parts.append(_tone_gaps(labelled, boxes, tone, tone_names, tone_stride, base))
    out = out.select(*keys)
    for p in parts:
        out = out.join(p, keys, "left")
    return out


def _tone_gaps(labelled: DataFrame, boxes: DataFrame, tone: DataFrame, names: Sequence[str], stride: int, base: float) -> DataFrame:
    """Distance between the median of each tone map in a component and in the query box."""
    c = F.col
    sizes = tone.select("image", "gh", "gw").distinct()
    at = ["image", "gy", "gx"]

    def medians(cells, keys):
        long = by_shuffle(cells).join(tone.select(*at, *names), at).unpivot(keys, list(names), "name", "v")
        return exact_quantiles(long, [*keys, "name"], "v", [0.5]).select(*keys, "name", c("quantiles")[0].alias("median"))

    own = medians(labelled_cells(labelled, sizes, float(stride), base), ["query", "label"])
    box = medians(points.slice_cells(boxes, sizes, stride), ["query"]).withColumnRenamed("median", "q")
    gaps = own.join(box, ["query", "name"]).withColumn("gap", F.abs(c("median") - c("q")))
    return gaps.groupBy("query", "label").agg(*[F.any_value(F.when(c("name") == n, c("gap")), True).alias(f"r_t_{n}_ad") for n in names])
