"""Scoring of masks and probabilities against reviewed pixels.

Everything starts from one map-side combined aggregation per query; later levels work on
one row per query, per document, or on a single row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionmatch.functions.scalars import ratio
from regionmatch.operators.ordering import MOST, hot_groups, running_sums, value_bucket

COUNTS = ("tp", "fp", "fn", "tn", "blank_fp", "blank_pixels")


def confusion(domain: DataFrame, mask: Column, keys: Sequence[str] = ("query",)) -> DataFrame:
    """Confusion counts over known pixels; ``pos`` and ``blank`` flag the reviewed classes."""
    m = F.coalesce(mask, F.lit(False))
    pos, blank = F.col("pos"), F.col("blank")
    return domain.groupBy(*keys).agg(
        F.count_if(m & pos).alias("tp"),
        F.count_if(m & ~pos).alias("fp"),
        F.count_if(~m & pos).alias("fn"),
        F.count_if(~m & ~pos).alias("tn"),
        F.count_if(m & blank).alias("blank_fp"),
        F.count_if(blank).alias("blank_pixels"),
    )


def count_violations(counts: DataFrame, key: str = "query") -> DataFrame:
    """Rows that break the count contract, with the first rule each one breaks."""
    some_bad = F.lit(False)
    for c in COUNTS:
        some_bad = some_bad | F.col(c).isNull() | (F.col(c) < 0)
    rule = (
        F.when(some_bad, "negative_count")
        .when(
            (F.col("blank_fp") > F.least("fp", "blank_pixels")) | (F.col("blank_pixels") > F.col("fp") + F.col("tn")),
            "blank_not_subset",
        )
        .when(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") == 0, "empty_domain")
    )
    return counts.select(F.col(key), rule.alias("rule")).filter(F.col("rule").isNotNull())


def query_metrics(counts: DataFrame) -> DataFrame:
    """Per-query ratios; an empty target has no IoU and reports its false positive share instead."""
    positive = F.col("tp") + F.col("fn")
    known = positive + F.col("fp") + F.col("tn")
    has = positive > 0
    return counts.withColumns(
        {
            "reviewed_pixels": known,
            "positive_pixels": positive,
            "iou": F.when(has, ratio(F.col("tp"), positive + F.col("fp"))),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), positive),
            "empty_target_false_positive_rate": F.when(~has, ratio(F.col("fp"), known)),
            "blank_false_positive_rate": ratio(F.col("blank_fp"), F.col("blank_pixels")),
        }
    )


def per_document(metrics: DataFrame, iou: str = "iou") -> DataFrame:
    """Mean IoU of the non-empty queries of each document; documents without any are left out."""
    return (
        metrics.filter(F.col(iou).isNotNull())
        .groupBy("document_id")
        .agg(F.count("*").alias("queries"), F.avg(iou).alias("document_iou"))
    )


def summary(metrics: DataFrame) -> DataFrame:
    """One row: document-macro IoU, mean query IoU, pooled and empty-target rates.

    Queries without a reviewed pixel count as examples and are reported as ``nothing_scored``.
    """
    empty = F.col("iou").isNull()
    by_doc = metrics.groupBy("document_id").agg(
        F.avg("iou").alias("doc_iou"),
        F.count("*").alias("examples"),
        F.count("iou").alias("nonempty"),
        F.sum("iou").alias("iou_sum"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.sum(F.when(empty, F.col("fp"))).alias("empty_fp"),
        F.sum(F.when(empty, F.col("reviewed_pixels"))).alias("empty_known"),
        F.count_if(F.col("reviewed_pixels") == 0).alias("unscored"),
    )
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    pooled = by_doc.agg(
        s("examples").alias("examples"),
        F.count("*").alias("documents"),
        s("nonempty").alias("nonempty_target_examples"),
        s("unscored").alias("nothing_scored"),
        F.avg("doc_iou").alias("document_macro_iou"),
        ratio(F.sum("iou_sum"), F.sum("nonempty")).alias("mean_query_iou"),
        *[s(c).alias(c) for c in COUNTS],
        s("empty_fp").alias("empty_target_false_positive_pixels"),
        s("empty_known").alias("empty_target_reviewed_pixels"),
    )
    return pooled.select(
        "examples",
        "documents",
        "nonempty_target_examples",
        (F.col("examples") - F.col("nonempty_target_examples") - F.col("nothing_scored")).alias("empty_target_examples"),
        "nothing_scored",
        "document_macro_iou",
        "mean_query_iou",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("global_precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("global_recall"),
        "empty_target_false_positive_pixels",
        "empty_target_reviewed_pixels",
        ratio(F.col("empty_target_false_positive_pixels"), F.col("empty_target_reviewed_pixels")).alias(
            "empty_target_false_positive_rate"
        ),
        ratio(F.col("blank_fp"), F.col("blank_pixels")).alias("blank_false_positive_rate"),
        *COUNTS,
    )


def dev_score(counts: DataFrame) -> DataFrame:
    """Selection-time score: zero denominators give zero, not null."""
    rows = counts.withColumn(
        "iou", F.when(F.col("tp") + F.col("fn") > 0, ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))
    )
    docs = rows.groupBy("document_id").agg(
        F.avg("iou").alias("doc_iou"), F.sum("iou").alias("iou_sum"), F.count("iou").alias("n"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
    )
    one = F.lit(1)
    return docs.agg(
        F.avg("doc_iou").alias("doc_macro"),
        ratio(F.sum("iou_sum"), F.sum("n")).alias("query_mean"),
        (F.sum("tp") / F.greatest(F.sum("tp") + F.sum("fp"), one)).alias("precision"),
        (F.sum("tp") / F.greatest(F.sum("tp") + F.sum("fn"), one)).alias("recall"),
    )


# ---- thresholds -------------------------------------------------------------------------


def threshold_counts(domain: DataFrame, prob: str, thresholds: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """True and false positives of ``prob > t`` for every threshold.

    A row only adds to the bin that says how many thresholds it passes; bins are combined on the
    map side, and the counts of all thresholds follow from sums over a query's few bins.
    Thresholds must ascend. Result: ``keys``, ``positives``, and the arrays ``tp`` and ``fp``.
    """
    p, pos, n = F.col(prob), F.col("pos"), len(thresholds)
    passed = sum((F.when(p > t, 1).otherwise(0) for t in thresholds), F.lit(0))
    bins = domain.groupBy(*keys, passed.alias("_bin")).agg(
        F.count_if(pos).alias("_p"), F.count_if(~pos).alias("_n")
    )
    few = bins.groupBy(*keys).agg(
        F.sum("_p").alias("positives"), F.collect_list(F.struct("_bin", "_p", "_n")).alias("_bins")  # at most n + 1 entries
    )
    above = lambda name: F.expr(
        f"transform(sequence(0, {n - 1}), k -> aggregate(_bins, 0L, (acc, b) -> acc + IF(b._bin > k, b.{name}, 0L)))"
    )
    return few.select(*keys, "positives", above("_p").alias("tp"), above("_n").alias("fp"))


def threshold_ious(counts: DataFrame) -> DataFrame:
    """Per-query IoU array over the thresholds; queries without positives are dropped."""
    at = F.zip_with("tp", "fp", lambda tp, fp: ratio(tp, F.col("positives") + fp))
    return counts.filter(F.col("positives") > 0).withColumn("ious", at)


def threshold_sweep(ious: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Document-macro and mean query IoU for each threshold."""
    # The sums of all thresholds travel in one row per document.
    at = [F.col("ious")[k] for k in range(len(thresholds))]
    docs = ious.groupBy("document_id").agg(F.count("*").alias("_n"), *[F.sum(v).alias(f"_s{k}") for k, v in enumerate(at)])
    one = docs.agg(F.sum("_n").alias("_n"), *[F.struct(
        F.lit(float(t)).alias("threshold"), F.avg(ratio(F.col(f"_s{k}"), F.col("_n"))).alias("doc_macro"),
        ratio(F.sum(f"_s{k}"), F.sum("_n")).alias("query_mean")).alias(f"_t{k}") for k, t in enumerate(thresholds)])
    return one.filter("_n is not null").select(F.inline(F.array(*[F.col(f"_t{k}") for k in range(len(thresholds))])))


def best_threshold(ious: DataFrame, thresholds: Sequence[float], default: float) -> DataFrame:
    """Best threshold of each query (first maximum), with its gain over the default threshold."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    at_default = list(thresholds).index(default)
    best = F.array_max("ious")
    return ious.withColumns(
        {
            "best_iou": best,
            "best_threshold": F.element_at(grid, F.array_position("ious", best).cast("int")),
            "default_iou": F.col("ious")[at_default],
            "gain": best - F.col("ious")[at_default],
        }
    )


def iou_gain_curve(ious: DataFrame, thresholds: Sequence[float], default: float) -> DataFrame:
    """Long form: IoU at each threshold minus the IoU at the default one."""
    at_default = list(thresholds).index(default)
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.col("ious")[k].alias("iou"),
                     (F.col("ious")[k] - F.col("ious")[at_default]).alias("gain"))
            for k, t in enumerate(thresholds)
        ]
    )
    return ious.select("query", "document_id", F.inline(rows))


def accepted_stats(cells: DataFrame, prob: str, levels: Sequence[float], keys: Sequence[str] = ("query",)) -> DataFrame:
    """Label-free statistics of a probability map: share of cells above each level."""
    p = F.col(prob)
    return cells.groupBy(*keys).agg(
        F.count("*").alias("cells"),
        *[(F.count_if(p > t) / F.count("*")).alias(f"share_{int(round(t * 100)):02d}") for t in levels],
    )


def threshold_features(cells: DataFrame, prob: str, inside: Column, levels: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9, 0.97), accept: float = 0.5, least: int = 10) -> DataFrame:
    """What a threshold model knows of a map without labels, one row per query: log shares above the levels, quantiles of
    the accepted cells (zeros unless more than ``least`` are accepted), mean and tenth percentile of the query box
    (``inside``), and the log of the accepted area over that of the box."""
    from regionmatch.operators.ordering import exact_quantiles, unit_bucket

    c, p, hot = F.col, F.col(prob), F.col(prob) > accept
    names = [f"log_share_{int(round(t * 100)):02d}" for t in levels]
    base = cells.groupBy("query").agg(
        *[F.ln(F.count_if(p > t) / F.count("*") + 1e-6).alias(n) for n, t in zip(names, levels)], F.avg(F.when(inside, p)).alias("box_mean"),
        F.ln(F.try_divide(F.count_if(hot), F.count_if(inside)) + 1e-3).alias("log_area_ratio"), F.count_if(hot).alias("_hot"))
    accepted = exact_quantiles(cells.filter(hot), ["query"], prob, (0.1, 0.25, 0.5, 0.75), unit_bucket(c("_v")))
    box = exact_quantiles(cells.filter(inside), ["query"], prob, (0.1,), unit_bucket(c("_v"))).select("query", c("quantiles")[0].alias("box_p10"))
    q = lambda i: F.when(c("_hot") > least, c("quantiles")[i]).otherwise(0.0)
    return base.join(accepted, "query", "left").join(box, "query", "left").select(
        "query", *names, *[q(i).alias(f"q{k}") for i, k in enumerate((10, 25, 50, 75))], "box_mean", "box_p10", "log_area_ratio")


# ---- separability -----------------------------------------------------------------------


def feature_auc(rows: DataFrame, features: Sequence[str], most: int = MOST) -> DataFrame:
    """Folded AUC of features per query; undefined values take the query's minimum.

    Rows go to their query once and all features are ranked there. A query of more than ``most``
    rows is ranked through distributed running counts, so that it need not fit in one task.
    """
    rows = rows.filter("query is not null").select("query", "pos", *[F.col(f).cast("double").alias(f) for f in features])
    hot = hot_groups(rows, ["query"], most)
    if hot.isEmpty():
        return _folded_auc(_ranked_in_place(rows, features))
    apart = lambda how: rows.join(F.broadcast(hot), "query", how)
    parts = _ranked_in_place(apart("left_anti"), features), _ranked_in_buckets(apart("left_semi"), features)
    return _folded_auc(parts[0]).unionByName(_folded_auc(parts[1]))


def _values(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form (query, pos, feature, _v). An explode keeps the rows where their query is; unpivot would not."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("_v")) for f in features])
    return rows.select("query", "pos", F.inline(pairs))


def _ranked_in_place(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Each row of (query, feature) with the negatives up to its value and those of equal value, after one exchange by query."""
    whole = W.partitionBy("query")
    own = rows.repartition("query").withColumns({f: F.coalesce(f, F.min(f).over(whole)) for f in features})
    of = ["query", "feature"]
    long = _values(own, features).filter("_v is not null").withColumns({"_hp": F.col("pos").cast("long"), "_hn": (~F.col("pos")).cast("long")})
    upto = W.partitionBy(*of).orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    return long.withColumns({"_below": F.sum("_hn").over(upto), "_tied": F.sum("_hn").over(W.partitionBy(*of, "_v"))})


def _ranked_in_buckets(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """The same counts with the rows of a query spread over tasks: equal values are merged first, then ranked through
    running counts over buckets."""
    by = ["query", "feature"]
    merged = _values(rows, features).groupBy(*by, "_v").agg(
        F.count_if("pos").alias("_hp"), F.count_if(~F.col("pos")).alias("_hn"))
    lows = merged.groupBy(*by).agg(F.min("_v").alias("_low")).filter("_low is not null")
    # A null ties with the minimum of its query.
    filled = merged.join(lows, by).groupBy(*by, F.coalesce("_v", "_low").alias("_v")).agg(
        F.sum("_hp").alias("_hp"), F.sum("_hn").alias("_hn"))
    return running_sums(filled, by, [F.col("_v")], value_bucket(F.col("_v"), 16), {"_below": F.col("_hn")}).withColumn("_tied", F.col("_hn"))


def _folded_auc(ranked: DataFrame) -> DataFrame:
    # Each positive beats the negatives strictly below it and half of those it ties with.
    wins = ranked.groupBy("query", "feature").agg(
        F.sum(F.col("_hp") * (F.col("_below") - F.col("_tied") / 2.0)).alias("_w"),
        F.sum("_hp").alias("_p"),
        F.sum("_hn").alias("_n"),
    ).filter((F.col("_p") > 0) & (F.col("_n") > 0))
    auc = ratio(F.col("_w"), F.col("_p") * F.col("_n"))
    return wins.select("query", "feature", F.greatest(auc, 1.0 - auc).alias("auc"))
