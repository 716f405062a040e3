"""Component verification: which accepted regions to drop, and what dropping them is worth.

A component table holds, per query and component, the labelled pixels ``tot`` and positives
``pos`` it covers; ``base`` holds each query's tp, fp, fn. Dropping a component moves pos from
tp to fn and removes tot - pos from fp, so re-scoring needs no pixels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from regionmatch.functions.scalars import ratio
from regionmatch.session import cut_lineage


def label_counts(points: DataFrame, keys: Sequence[str] = ("query", "comp")) -> DataFrame:
    """Labelled and positive pixels of each component (points outside any component have none)."""
    return points.filter("comp is not null").groupBy(*keys).agg(
        F.count("*").alias("tot"), F.count_if("pos").alias("pos"))


def with_gain(components: DataFrame, base: DataFrame) -> DataFrame:
    """Purity of each component and the IoU change of dropping it; queries without positives are left out."""
    c = F.col
    j = components.join(base.select("query", "tp", "fp", "fn"), "query").filter((c("tp") + c("fn") > 0) & (c("tot") > 0))
    union = c("tp") + c("fp") + c("fn")
    gain = ratio(c("tp") - c("pos"), union - (c("tot") - c("pos"))) - ratio(c("tp"), union)
    return j.withColumns({"purity": ratio(c("pos"), c("tot")), "gain": gain}).drop("tp", "fp", "fn")


def drop_and_score(base: DataFrame, dropped: DataFrame) -> DataFrame:
    """Per-query counts after dropping components: base counts plus summed changes."""
    c = F.col
    change = dropped.groupBy("query").agg(F.sum("pos").alias("_p"), F.sum(c("tot") - c("pos")).alias("_n"))
    j = base.join(change, "query", "left").fillna(0, ["_p", "_n"])
    return j.withColumns({"tp": c("tp") - c("_p"), "fp": c("fp") - c("_n"), "fn": c("fn") + c("_p")}).drop("_p", "_n")


def majority_wrong(components: DataFrame) -> DataFrame:
    """Components that an oracle would drop: fewer positives than negatives."""
    return components.filter((F.col("tot") > 0) & (2 * F.col("pos") < F.col("tot")))


def within_query(components: DataFrame, names: Sequence[str], is_query: str = "is_query") -> DataFrame:
    """Each feature minus its maximum over the query's components, and minus the query component's value."""
    best = components.groupBy("query").agg(
        *[F.max(n).alias(f"_m_{n}") for n in names], *[F.max(F.when(F.col(is_query), F.col(n))).alias(f"_q_{n}") for n in names])
    j = components.join(best, "query")
    out = {f"rmax_{n}": F.col(n) - F.col(f"_m_{n}") for n in names} | {f"rq_{n}": F.col(n) - F.col(f"_q_{n}") for n in names}
    return j.withColumns(out).drop(*[f"_{k}_{n}" for k in "mq" for n in names])


def verifier_rows(components: DataFrame, documents: DataFrame, target: str = "gain") -> DataFrame:
    """Keep-or-drop labels and weights: each query an equal share of its document.

    ``gain``: keep when dropping does not help, weighted by the size of the IoU change;
    ``gaincap``: the same with each change capped at 0.1; ``purity``: keep when the majority is
    positive, weighted by the component's share of labelled pixels (at most ten times the mean).
    """
    c = F.col
    share = documents.groupBy("document_id").agg((1.0 / F.count("*")).alias("_w"))
    j = components.join(documents.select("query", "document_id"), "query").join(share, "document_id")
    if target == "purity":
        mean = components.agg(F.avg("tot")).scalar()
        keep, weight = c("purity") >= 0.5, c("_w") * F.least(c("tot") / mean, F.lit(10.0))
    else:
        size = F.abs("gain") if target == "gain" else F.least(F.abs("gain"), F.lit(0.1))
        keep, weight = c("gain") <= 0, size * c("_w") + 1e-6
    return j.withColumns({"label": keep.cast("double"), "weight": weight}).drop("_w")


def cut_candidates(components: DataFrame, feature: str, levels: Sequence[float], bucket: Column) -> DataFrame:
    """Distinct candidate cuts of a feature at the given quantiles."""
    from regionmatch.operators.ordering import exact_quantiles

    q = exact_quantiles(components, [], feature, levels, bucket)
    return q.select(F.explode(F.array_distinct("quantiles")).alias("cut"))


def cut_scores(components: DataFrame, base: DataFrame, documents: DataFrame, feature: str, cuts: DataFrame, low: bool) -> DataFrame:
    """Per document, the mean IoU under every cut rule: drop components on the bad side of the cut.

    ``cuts`` is a short list of candidates (a parameter-sized table), so pairing it with the
    components multiplies them by a constant.  One more candidate drops nothing.
    """
    c = F.col
    side = (c(feature) < c("cut")) if low else (c(feature) > c("cut"))
    changes = components.filter(c(feature).isNotNull()).join(F.broadcast(cuts), side).groupBy("query", "cut").agg(
        F.sum("pos").alias("_p"), F.sum(c("tot") - c("pos")).alias("_n"))
    some = base.filter(c("tp") + c("fn") > 0).select("query", "tp", "fp", "fn")
    untouched = cuts.select(F.collect_list("cut")).scalar()
    every = some.withColumn("cut", F.explode(F.array_append(untouched, F.lit(None).cast("double"))))
    key = F.coalesce(c("cut"), F.lit(float("inf") if not low else float("-inf")))
    j = every.withColumn("cut", key).join(changes, ["query", "cut"], "left").fillna(0, ["_p", "_n"])
    iou = ratio(c("tp") - c("_p"), c("tp") + c("fn") + c("fp") - c("_n"))
    return j.withColumn("iou", iou).join(documents.select("query", "document_id"), "query").groupBy("document_id", "cut").agg(
        F.avg("iou").alias("score"))


def rule_scores(components: DataFrame, base: DataFrame, documents: DataFrame, features: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Per document, the mean IoU under every drop rule of every feature: document_id, feature, side, cut, score.

    A rule drops the components under a cut (side ``low``) or over it (``high``); the cuts are quantiles of the feature,
    one more rule drops nothing (null cut). A component is put into the bin of the cuts it passes, and what each cut
    drops are running sums over a query's few bins, so components meet no list of cuts.
    """
    from regionmatch.operators.ordering import exact_quantiles

    c = F.col
    long = components.unpivot(["query", "pos", "tot"], [c(f).cast("double").alias(f) for f in features], "feature", "value").filter("value is not null")
    levels = [*low, *high]
    cuts = exact_quantiles(long, ["feature"], "value", levels)
    sides = {"low": F.slice("quantiles", 1, len(low)), "high": F.slice("quantiles", len(low) + 1, len(high))}
    made = [F.struct(F.lit(n).alias("side"), F.array_sort(F.array_distinct(q)).alias("cuts")) for n, q in sides.items()]
    cuts = cut_lineage(cuts.select("feature", F.inline(F.array(*made))))  # two rows a feature
    placed = long.join(F.broadcast(cuts), "feature")
    passed = F.size(F.filter("cuts", lambda v: F.when(c("side") == "low", v <= c("value")).otherwise(v < c("value"))))
    most = max(len(low), len(high)) + 1
    lost = lambda v: F.array(*[F.sum(F.when(c("_bin") == b, v).otherwise(0)) for b in range(most)])
    sums = placed.withColumn("_bin", passed).groupBy("query", "feature", "side").agg(lost(c("pos")).alias("_p"), lost(c("tot") - c("pos")).alias("_n"))
    some = base.filter(c("tp") + c("fn") > 0).select("query", "tp", "fp", "fn").join(documents.select("query", "document_id"), "query")
    every = some.crossJoin(F.broadcast(cuts)).join(sums, ["query", "feature", "side"], "left")  # a constant number of rules a query
    none = F.array_repeat(F.lit(0).cast("long"), most)
    run = lambda a, i: F.aggregate(F.when(c("side") == "low", F.slice(a, 1, i + 1)).otherwise(F.slice(a, i + 2, most)), F.lit(0).cast("long"), lambda x, y: x + y)
    every = every.withColumns({"_p": F.coalesce("_p", none), "_n": F.coalesce("_n", none)})
    rules = F.transform("cuts", lambda v, i: F.struct(v.alias("cut"), run(c("_p"), i).alias("p"), run(c("_n"), i).alias("n")))
    idle = F.struct(F.lit(None).cast("double").alias("cut"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"))
    # A query's rules go to its document as arrays, and become rows only there.
    every = every.repartition("document_id", "feature", "side").select("document_id", "feature", "side", "tp", "fp", "fn", F.inline(F.array_append(rules, idle)))
    iou = ratio(c("tp") - c("p"), c("tp") + c("fn") + c("fp") - c("n"))
    return every.withColumn("iou", iou).groupBy("document_id", "feature", "side", "cut").agg(F.avg("iou").alias("score"))


def pooled_columns(labelled: DataFrame, names: Sequence[str], box_means: DataFrame) -> DataFrame:
    """Component means of map columns over all cells, also minus the query box mean."""
    m = labelled.filter("label is not null").groupBy("query", "label").agg(F.count("*").alias("cells"), *[F.avg(F.coalesce(F.col(n), F.lit(0.0))).alias(f"m_{n}") for n in names])
    j = m.join(box_means, "query")
    return j.withColumns({f"dm_{n}": F.col(f"m_{n}") - F.col(f"q_{n}") for n in names}).drop(*[f"q_{n}" for n in names])
